"""The rate audit as a stream: same plan, with a watermark which bounds its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql.streaming import StreamingQuery

from sparkboard.operators.audit import DELIVERY, LIMIT, WIDTH, rate_audit, with_own_id


def rate_audit_stream(
    events: DataFrame, time: str, key: Column, delay: str, limit: int = LIMIT, width: str = WIDTH,
    event_id: str | None = None,
) -> DataFrame:
    """A window is reported once the watermark (latest event minus `delay`) has passed its end.

    With `event_id`, an event delivered again counts once: ids are remembered until the watermark is `delay` past
    their event, and a later delivery is too late for its window as it is. Events without an id all
    count. Watermarks are points in time: local times are read in the time zone of the session.
    """
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):
        events = events.withColumn(time, events[time].cast("timestamp"))
    if event_id is not None:
        events = with_own_id(events, event_id)
    events = events.withWatermark(time, delay)
    if event_id is not None:
        events = events.dropDuplicatesWithinWatermark([DELIVERY])
    return rate_audit(events, time, key, limit, width)


def write_audit(audit: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append the closed windows to `path`, and stop.

    The checkpoint lets a restarted query go on where the last one stopped.
    """
    return (
        audit.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
