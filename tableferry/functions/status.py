"""Run states, activity classes and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a run that count as done well, as failed and as open.
SUCCESS = ("completed", "success")
FAILED = ("failed", "error")
RUNNING = ("running",)

# Text and severity of a job's last state, and severity of an audit action.
JOB_ACTIVITY = {
    "completed": ("Sinkronisasi selesai", "success"),
    "running": ("Sinkronisasi berjalan", "running"),
    "failed": ("Sinkronisasi gagal", "error"),
}
JOB_ACTIVITY_OTHER = ("Job terjadwal", "pending")
AUDIT_SEVERITY = {"LOGIN": "success", "DELETE": "error", "CREATE": "success", "UPDATE": "success"}
AUDIT_SEVERITY_OTHER = "info"
AUDIT_TARGET_OTHER = "System Action"


def outcome(status: Column) -> Column:
    """``success``, ``failed``, ``running``, or NULL for a state that only counts in the total."""
    return (
        F.when(status.isin(*SUCCESS), "success")
        .when(status.isin(*FAILED), "failed")
        .when(status.isin(*RUNNING), "running")
    )


def _recode(col: Column, pairs: dict[str, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(table[F.coalesce(col, F.lit(""))], F.lit(other))


def job_action(status: Column) -> Column:
    return _recode(status, {k: v[0] for k, v in JOB_ACTIVITY.items()}, JOB_ACTIVITY_OTHER[0])


def job_severity(status: Column) -> Column:
    return _recode(status, {k: v[1] for k, v in JOB_ACTIVITY.items()}, JOB_ACTIVITY_OTHER[1])


def audit_severity(action: Column) -> Column:
    return _recode(action, AUDIT_SEVERITY, AUDIT_SEVERITY_OTHER)


def audit_text(action: Column, entity: Column) -> Column:
    return F.trim(F.concat_ws(" ", action, F.coalesce(entity, F.lit(""))))


def is_valid(revoked: Column, expires_at: Column, as_of: Column) -> Column:
    """Not revoked, and without an expiry or not past it."""
    return ~F.coalesce(revoked, F.lit(False)) & (expires_at.isNull() | (expires_at >= as_of))
