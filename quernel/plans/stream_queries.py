"""Queries on streams."""

from __future__ import annotations

from ..streaming import resume
from . import fragments as S
from .catalogue import query


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts)::VARCHAR AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_hours(spark, d):
    """Hourly counts of the event stream, run to the end of what is there."""
    return resume.hourly_counts(spark, d)


@query(f"SELECT DISTINCT sha256({S.key('text')}) AS h FROM documents")
def stream_resume_dedup(spark, d):
    """Hashes of documents not seen in earlier batches, with the state kept in the checkpoint."""
    return resume.deduplicated_stream(spark, d)
