"""Who asked more often than the limit allows, window by window. Works on a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Requests per caller, and per how long.
LIMIT, WIDTH = 30, "1 minute"
DELIVERY = "__delivery"


def caller(user: Column, address: Column) -> Column:
    """The user where one is known, else the address."""
    return F.coalesce(
        F.concat(F.lit("user:"), user.cast("string")), F.concat(F.lit("ip:"), address.cast("string"))
    )


def with_own_id(events: DataFrame, event_id: str) -> DataFrame:
    """The events, those without an id given one of their own: they are no deliveries of each other."""
    known = F.col(event_id).cast("string")
    return events.withColumn(DELIVERY, F.when(known.isNull(), F.concat(F.lit("?"), F.uuid())).otherwise(F.concat(F.lit("="), known)))


def delivered_once(events: DataFrame, event_id: str) -> DataFrame:
    """One row per event id of a table, whichever delivery it is from; events without an id all stay."""
    return with_own_id(events, event_id).dropDuplicates([DELIVERY]).drop(DELIVERY)


def rate_audit(
    events: DataFrame, time: str, key: Column, limit: int = LIMIT, width: str = WIDTH
) -> DataFrame:
    """Windows in which a caller made more than `limit` requests."""
    counted = events.groupBy(F.window(time, width), key.alias("caller")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counted.filter(F.col("requests") > limit).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "caller",
        "requests",
    )
