"""Progress of streams as rows, through Spark's own listener."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class ProgressEvents(StreamingQueryListener):
    """Calls back on start, progress and end of every query of the session."""

    def __init__(self, on_event: Callable[[str, str, int], None]):
        self.on_event = on_event

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        self.on_event("started", str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.on_event("progress", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.on_event("idle", str(event.id), 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.on_event("failed" if event.exception else "ended", str(event.id), 0)
