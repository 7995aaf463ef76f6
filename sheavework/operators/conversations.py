"""Sessions and messages: appending, clearing, transcripts and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .catalog import duplicate_keys, upsert
from .spread import first_n, latest_per_key, number_within, salted_join

UNTITLED = "Untitled chat"
MESSAGE_LIMIT = 200
SUMMARY_TURNS = 12


def start_sessions(starts: DataFrame, key: str, created_at: Column, user: Column | None = None) -> DataFrame:
    """New session rows with id ``sess_<key>``; title and user get their defaults."""
    return starts.select(
        F.concat(F.lit("sess_"), F.col(key).cast("string")).alias("session_id"),
        F.lit(UNTITLED).alias("title"),
        (user if user is not None else F.lit("user")).alias("user"),
        created_at.alias("created_at"),
    )


def append_messages(current: DataFrame, batch: DataFrame, order: Sequence[str] = ("created_at", "seq")) -> DataFrame:
    """Current messages and those of the batch, numbered on per session (from 1) in the order they were made.

    ``order`` names columns of the batch, by default the time and, if the batch has one, its sequence number. Messages of a session
    that share all of them have no order and are refused. Positions come from a distributed sort, so one session may
    hold any share of the batch.
    """
    order = [c for c in order if c in batch.columns]
    if not duplicate_keys(batch, ["session_id", *order]).isEmpty():
        raise ValueError(f"messages of a session share {order}; give the batch a sequence column")
    numbered = number_within(batch, ["session_id"], order, "_n")
    last = current.groupBy("session_id").agg(F.max("msg_no").alias("_last"))
    placed = salted_join(numbered, last, ["session_id"], ["_n"], "left").withColumn(
        "msg_no", (F.coalesce("_last", F.lit(0)) + F.col("_n") + 1).cast("long")
    )
    return current.unionByName(placed.select(*current.columns))


def rename_sessions(sessions: DataFrame, titles: DataFrame, order: Column) -> DataFrame:
    """New titles by session id, the last by ``order`` if a session has several; unknown ids are not added."""
    last = latest_per_key(titles, ["session_id"], [order.desc()])
    known = sessions.join(last.select("session_id", F.col("title").alias("_title")), "session_id")
    changed = known.withColumn("title", F.col("_title")).drop("_title")
    return upsert(sessions, changed.select(*sessions.columns), ["session_id"])


def session_titles(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, title, shown_title): NULL if unknown, and what a user sees then."""
    found = salted_join(asked, sessions.select("session_id", "title"), ["session_id"], ["session_id"], "left")
    shown = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))
    return found.select("session_id", "title", shown.alias("shown_title"))


def clear_sessions(messages: DataFrame, cleared: DataFrame) -> DataFrame:
    return salted_join(messages, cleared.select("session_id").distinct(), ["session_id"], ["msg_no"], "left_anti")


def messages_of(messages: DataFrame, limit: int = MESSAGE_LIMIT, tail: int | None = None) -> DataFrame:
    """The first ``limit`` messages of every session, of these the last ``tail`` if given."""
    head = first_n(messages, ["session_id"], [F.col("msg_no")], limit, "_n")
    if tail is not None:
        head = first_n(head, ["session_id"], [F.col("_n").desc()], tail, "_m").drop("_m")
    return head.drop("_n")


def last_messages(messages: DataFrame, limit: int) -> DataFrame:
    return first_n(messages, ["session_id"], [F.col("msg_no").desc()], limit, "_n").drop("_n")


def transcript(messages: DataFrame, max_turns: int = SUMMARY_TURNS, mode: str = "first") -> DataFrame:
    """(session_id, transcript): ``Role: content`` lines of 2 x ``max_turns`` messages, the first or the last ones."""
    if mode not in ("first", "last"):
        raise ValueError(f"unknown mode {mode!r}")
    bounded = (messages_of if mode == "first" else last_messages)(messages, 2 * max_turns)
    line = F.concat(text.title_case(F.col("role")), F.lit(": "), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct("msg_no", line.alias("line"))))
    return bounded.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


# The words around the transcript.
SUMMARY_REQUEST = (
    "Summarize the following chat succinctly for future context. "
    "Capture goals, constraints, definitions, and decisions.\n\n"
)
SUMMARY_END = "\n\nSummary:"


def summary_prompts(sessions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(session_id, prompt); the empty string for a session without messages."""
    prompt = F.concat(F.lit(SUMMARY_REQUEST), F.col("transcript"), F.lit(SUMMARY_END))
    return sessions.select("session_id").join(transcripts, "session_id", "left").select(
        "session_id", F.coalesce(prompt, F.lit("")).alias("prompt")
    )


def export_sessions(asked: DataFrame, sessions: DataFrame, messages: DataFrame, part_messages: int = 1000) -> DataFrame:
    """(session_id, part_no, n_parts, session, messages): a session with its messages in order.

    An unknown session has a NULL ``session`` and no messages. ``part_messages`` message numbers make one part, so
    a session of up to that many messages is one row and a longer one several; no array grows with the session.
    """
    wanted = asked.select("session_id").distinct()
    part = F.floor((F.col("msg_no") - 1) / part_messages).cast("int")
    of_interest = salted_join(messages, wanted, ["session_id"], ["msg_no"], "left_semi")
    entry = F.struct("msg_no", "role", "content", "created_at")
    parts = (
        of_interest.withColumn("part_no", part).groupBy("session_id", "part_no")
        .agg(F.array_sort(F.collect_list(entry)).alias("m"))
        .select("session_id", "part_no", F.transform("m", lambda m: F.struct(
            m["role"].alias("role"), m["content"].alias("content"), m["created_at"].alias("created_at"))).alias("messages"))
    )
    head = sessions.select(
        "session_id", F.struct(F.col("session_id").alias("id"), "title", "user", "created_at").alias("session")
    )
    known = wanted.join(head, "session_id", "left")
    none = F.array().cast("array<struct<role:string,content:string,created_at:%s>>" % messages.schema["created_at"].dataType.simpleString())
    known = known.join(parts.groupBy("session_id").agg(F.count("*").cast("int").alias("n_parts")), "session_id", "left")
    return known.join(parts, "session_id", "left").select(
        "session_id", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.coalesce("n_parts", F.lit(1)).alias("n_parts"), "session", F.coalesce("messages", none).alias("messages")
    )


def export_json(exports: DataFrame) -> DataFrame:
    """(session_id, part_no, json) with the keys ``session`` and ``messages``, and ``part_no`` and ``n_parts`` where a session has
    several parts."""
    several = F.col("n_parts") > 1
    part = [F.when(several, F.col(c)).alias(c) for c in ("part_no", "n_parts")]
    whole, split = F.struct("session", "messages"), F.struct("session", *part, "messages")
    return exports.select(
        "session_id", "part_no", F.when(several, F.to_json(split, {"ignoreNullFields": "false"})).otherwise(F.to_json(whole, {"ignoreNullFields": "false"})).alias("json")
    )
