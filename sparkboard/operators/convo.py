"""Chat sessions and their messages: listings, rollups, titles, deletion and dashboard flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.functions.values import quoted

# The blanks a browser trims from a message.
BLANKS = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)
# A title ends with the first sentence when that ends before this place, else a
# message longer than LONG_TITLE is cut to CUT_TITLE characters and three dots.
SENTENCE_BEFORE, LONG_TITLE, CUT_TITLE = 60, 50, 47


def sessions_of(
    sessions: DataFrame,
    owner: str | int | None = None,
    owner_column: str = "owner_uid",
    updated: str = "updated_at",
    id: str = "id",
    columns: Sequence[str] = ("id", "title", "dataset_id", "created_at", "updated_at"),
) -> DataFrame:
    """Sessions of one owner, the latest first; without an owner, those of everyone by owner."""
    if owner is not None:
        mine = sessions.filter(quoted(owner_column) == F.lit(owner))
        return mine.orderBy(F.desc(updated), F.asc(id)).select(*columns)
    return sessions.orderBy(F.asc(owner_column), F.desc(updated), F.asc(id)).select(
        owner_column, *columns
    )


def messages_of(
    messages: DataFrame,
    session: str | int | None = None,
    session_column: str = "session_id",
    created: str = "created_at",
    columns: Sequence[str] = ("id", "role", "content", "chart", "metadata", "timestamp"),
) -> DataFrame:
    """Messages of one session in time order; without a session, those of all, session by session.

    The listing of all is a range-partitioned sort: one long session spreads over many tasks.
    """
    if session is not None:
        own = messages.filter(quoted(session_column) == F.lit(session))
        return own.orderBy(F.asc(created)).select(*columns)
    return messages.orderBy(F.asc(session_column), F.asc(created)).select(session_column, *columns)


def session_rollup(
    messages: DataFrame, session: str = "session_id", created: str = "created_at"
) -> DataFrame:
    """Per session: when the latest message came, and how many there are."""
    return messages.groupBy(session).agg(
        F.max(created).alias("updated_at"), F.count(F.lit(1)).alias("n_messages")
    )


def save_messages(
    sessions: DataFrame, new: DataFrame, id: str = "id", session: str = "session_id",
    created: str = "created_at",
) -> DataFrame:
    """Sessions after new messages: `updated_at` moves to the latest one."""
    latest = new.groupBy(F.col(session).alias(id)).agg(F.max(created).alias("__latest"))
    touched = sessions.join(latest, id, "left")
    return touched.withColumn("updated_at", F.greatest("updated_at", "__latest")).drop("__latest")


def title_of(message: Column) -> Column:
    """A title from a message: its first sentence if short, else its beginning."""
    text = F.regexp_replace(message, f"^{BLANKS}+|{BLANKS}+$", "")
    stop = F.regexp_instr(text, F.lit(f"[.!?]{BLANKS}")) - 1
    return (
        F.when((stop > 0) & (stop < SENTENCE_BEFORE), F.substring(text, F.lit(1), stop + 1))
        .when(F.length(text) > LONG_TITLE, F.concat(F.substring(text, 1, CUT_TITLE), F.lit("...")))
        .otherwise(text)
    )


def session_titles(
    messages: DataFrame, session: str = "session_id", created: str = "created_at",
    content: str = "content", role: str = "role", id: str | None = None,
) -> DataFrame:
    """The title of every session, from its first message by the user.

    Of messages of one time the one with the smallest id (without ids: the smallest title) counts.

    Titles are made before the first message is chosen, so that only short texts are aggregated.
    """
    asked = messages.filter(F.col(role) == "user").select(
        session, created, title_of(F.col(content)).alias("title"), F.col(id or content).alias("__id")
    )
    first = F.struct(F.col(created), F.col("__id")) if id else F.struct(F.col(created), F.col("title"))
    return asked.groupBy(session).agg(F.min_by("title", first).alias("title"))


def rename_sessions(sessions: DataFrame, titles: DataFrame, id: str = "id", updated: str | None = "updated_at") -> DataFrame:
    """Sessions with the new titles of (id, title); with `updated`, they count as changed now."""
    new = titles.groupBy(F.col(id).alias("__of")).agg(F.max("title").alias("__title"))
    joined = sessions.join(new, sessions[id] == new["__of"], "left")
    changed = {"title": F.coalesce("__title", "title")}
    if updated:
        changed[updated] = F.when(F.col("__title").isNotNull(), F.current_timestamp()).otherwise(F.col(updated))
    return joined.withColumns(changed).select(*sessions.columns)


def delete_sessions(
    sessions: DataFrame, messages: DataFrame, ids: DataFrame, id: str = "id",
    session: str = "session_id",
) -> tuple[DataFrame, DataFrame]:
    """What stays of sessions and messages once the sessions in `ids` are gone."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    return (
        sessions.join(gone, sessions[id] == gone["__gone"], "left_anti"),
        messages.join(gone, messages[session] == gone["__gone"], "left_anti"),
    )


def dashboard_flags(
    messages: DataFrame, has_dashboard: Column, session: str = "session_id"
) -> DataFrame:
    """Whether any message of a session carries a dashboard."""
    return messages.groupBy(session).agg(
        F.coalesce(F.bool_or(has_dashboard), F.lit(False)).alias("has_dashboard")
    )


def first_dashboards(
    messages: DataFrame, payload: Column, session: str = "session_id", created: str = "created_at",
    id: str | None = None,
) -> DataFrame:
    """The first dashboard payload of every session which has one; of one time, the one with the smallest id."""
    held = messages.select(
        session, created, payload.alias("dashboard_data"), (F.col(id) if id else payload).alias("__id")
    ).filter(F.col("dashboard_data").isNotNull())
    first = F.struct(created, "__id")
    return held.groupBy(session).agg(F.min_by("dashboard_data", first).alias("dashboard_data"))
