"""Conversations and the event audit on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkboard.operators import audit, convo
from sparkboard.plans.common import Query, on, plain, table
from sparkboard.sources.buckets import Table
from sparkboard.sources.scratch import new_path
from sparkboard.streaming.audit import rate_audit_stream, write_audit

AUDIT_LIMIT, AUDIT_WIDTH, AUDIT_DELAY = 2, "1 hour", "10 minutes"


def listed_sessions(orders: DataFrame) -> DataFrame:
    """Orders as the sessions of customers, the latest first."""
    return convo.sessions_of(
        orders, owner_column="o_custkey", updated="o_orderdate", id="o_orderkey",
        columns=("o_orderkey", "o_orderstatus", "o_orderdate"),
    )


def listed_messages(talk: DataFrame) -> DataFrame:
    return convo.messages_of(
        talk, session_column="conv_id", created="turn", columns=("turn", "role", "text")
    )


def saved_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions as they stood after each opening message, touched by the messages that followed."""
    talk = table(spark, folder, "conversations")
    opened = talk.filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("id"), F.col("turn").alias("updated_at")
    )
    return convo.save_messages(opened, talk, session="conv_id", created="turn")


def kept_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with a system message are deleted; the rest stays."""
    talk = table(spark, folder, "conversations")
    sessions = convo.session_rollup(talk, "conv_id", "turn")
    gone = talk.filter(F.col("role") == "system").select("conv_id").distinct()
    kept_sessions, kept = convo.delete_sessions(sessions, talk, gone, "conv_id", "conv_id")
    counted = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages_left"))
    return kept_sessions.join(counted, "conv_id")


def all_titles(talk: DataFrame) -> DataFrame:
    """A title from every message, as if each opened a session."""
    return talk.select("conv_id", "turn", convo.title_of(F.col("text")).alias("title"))


def audit_table(events: DataFrame) -> DataFrame:
    key = audit.caller(
        F.when(F.col("event_type") != "error", F.col("user_id")), F.col("user_id") % 7
    )
    return audit.rate_audit(events, "ts", key, AUDIT_LIMIT, AUDIT_WIDTH)


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same audit as a stream over the events file; windows still open are not reported."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    events = (
        spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    key = audit.caller(
        F.when(F.col("event_type") != "error", F.col("user_id")), F.col("user_id") % 7
    )
    result = rate_audit_stream(events, "ts", key, AUDIT_DELAY, AUDIT_LIMIT, AUDIT_WIDTH)
    path, checkpoint = new_path(spark, "audit"), new_path(spark, "audit-state")
    query = write_audit(result, path, checkpoint)
    query.awaitTermination()
    return plain(spark.read.schema(result.schema).parquet(path))


def audit_redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of events which all arrive three times: twice in one delivery, and once in another one."""
    source = new_path(spark, "deliveries")
    events = table(spark, folder, "events")
    events.unionByName(events).write.parquet(source)
    events.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    key = audit.caller(F.when(F.col("event_type") != "error", F.col("user_id")), F.col("user_id") % 7)
    result = rate_audit_stream(stream, "ts", key, AUDIT_DELAY, AUDIT_LIMIT, AUDIT_WIDTH, event_id="event_id")
    path, checkpoint = new_path(spark, "audit"), new_path(spark, "audit-state")
    write_audit(result, path, checkpoint).awaitTermination()
    return plain(spark.read.schema(result.schema).parquet(path))


def stored_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Messages in a stored table, saved twice as by a retry; sessions that hold a system message are deleted from it."""
    messages = table(spark, folder, "conversations")
    stored = Table(spark, new_path(spark, "messages"), "conv_id", messages.schema, buckets=32)
    for _ in range(2):
        stored.append(messages, "first")
    stored.delete(messages.where("role = 'system'").select("conv_id"))
    return convo.session_rollup(stored.read(), "conv_id", "turn")


AUDIT_SQL = f"""
    SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS window_start,
        CAST(time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS VARCHAR) AS window_end,
        CASE WHEN event_type <> 'error' THEN 'user:' || user_id ELSE 'ip:' || (user_id % 7) END AS caller,
        COUNT(*) AS requests
    FROM events GROUP BY 1, 2, 3 HAVING COUNT(*) > {AUDIT_LIMIT}
"""
_CLOSED_SQL = f"""SELECT * FROM ({AUDIT_SQL}) AS windows WHERE CAST(window_end AS TIMESTAMP)
    <= (SELECT MAX(ts) - INTERVAL '10 minutes' FROM events)"""
_BLANK = "[\\s\\x0B\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _titles(where: str) -> str:
    return f"""
    SELECT conv_id, turn, CASE
            WHEN stop BETWEEN 2 AND 60 THEN substr(t, 1, stop)
            WHEN length(t) > 50 THEN substr(t, 1, 47) || '...' ELSE t END AS title
    FROM (SELECT conv_id, turn, t, CASE WHEN regexp_matches(t, '[.!?]{_BLANK}')
              THEN length(regexp_extract(t, '^((?s).*?[.!?]){_BLANK}', 1)) END AS stop
          FROM (SELECT conv_id, turn, regexp_replace(
                    regexp_replace(text, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS t
                FROM conversations {where}) AS trimmed) AS found
"""


QUERIES = {
    "sessions_by_owner": Query(
        "H1", on("orders", listed_sessions),
        """SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS VARCHAR) AS o_orderdate
           FROM orders""",
    ),
    "messages_in_order": Query(
        "H2", on("conversations", listed_messages), "SELECT conv_id, turn, role, text FROM conversations"
    ),
    "session_rollup": Query(
        "H3", on("conversations", lambda c: convo.session_rollup(c, "conv_id", "turn")),
        "SELECT conv_id, MAX(turn) AS updated_at, COUNT(*) AS n_messages FROM conversations GROUP BY 1",
    ),
    "saved_messages": Query(
        "H3", saved_messages,
        "SELECT conv_id AS id, MAX(turn) AS updated_at FROM conversations GROUP BY 1 HAVING MIN(turn) = 0",
    ),
    "session_titles": Query(
        "H4", on("conversations", lambda c: convo.session_titles(c, "conv_id", "turn", "text")),
        f"""SELECT conv_id, arg_min(title, turn) AS title
            FROM ({_titles("WHERE role = 'user'")}) AS titles GROUP BY conv_id""",
    ),
    "message_titles": Query("H4", on("conversations", all_titles), _titles("")),
    "kept_after_delete": Query(
        "H5", kept_messages,
        """SELECT conv_id, MAX(turn) AS updated_at, COUNT(*) AS n_messages, COUNT(*) AS messages_left
           FROM conversations GROUP BY conv_id HAVING COUNT(*) FILTER (WHERE role = 'system') = 0""",
    ),
    "stored_sessions": Query(
        "E8 H3 H5", stored_sessions,
        """SELECT conv_id, MAX(turn) AS updated_at, COUNT(*) AS n_messages FROM conversations
           GROUP BY conv_id HAVING COUNT(*) FILTER (WHERE role = 'system') = 0""",
    ),
    "dashboard_flags": Query(
        "H6", on("conversations", lambda c: convo.dashboard_flags(c, F.col("role") == "system", "conv_id")),
        "SELECT conv_id, bool_or(role = 'system') AS has_dashboard FROM conversations GROUP BY 1",
    ),
    "first_dashboards": Query(
        "H7", on("conversations", lambda c: convo.first_dashboards(
            c, F.when(F.col("role") != "user", F.col("text")), "conv_id", "turn")),
        """SELECT conv_id, arg_min(text, turn) AS dashboard_data FROM conversations
           WHERE role <> 'user' GROUP BY conv_id""",
    ),
    "rate_audit": Query("L1", on("events", audit_table), AUDIT_SQL),
    "rate_audit_stream": Query("L1", audit_stream, _CLOSED_SQL),
    "rate_audit_redelivered": Query("L1", audit_redelivered, _CLOSED_SQL),
}
