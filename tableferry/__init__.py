"""Table synchronisation and sync analytics as Spark jobs."""

from tableferry.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
