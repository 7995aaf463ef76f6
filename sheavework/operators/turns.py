"""One chat turn for a table of queries: history, summary, retrieved context and inventory go to a model, the answers to the store.

A prompt is held as a list of parts. What belongs to one query is in its row; what many share, an inventory or a session's history, is a
key, and its text is stored once. Prompts are put together where the model is called: each writer gets the shared texts that its
queries name, once, and nothing but the answers leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import NO_SHEETS
from .conversations import MESSAGE_LIMIT, SUMMARY_TURNS, append_messages, messages_of, summary_prompts, transcript
from .prompts import Completer, generate
from .search import INVENTORY_TITLE, route_inventory
from .spread import salted_join, settled

WRITER_QUERIES = 512  # queries whose prompts one group puts together

Message = tuple[str, str]
Chat = Callable[[list[list[Message]]], list[str]]
TEXTS = "key string, part_no long, role string, text string"


def history_key(session: str = "session_id"):
    return F.concat(F.lit("history "), F.col(session))


def inventory_key(report: str = "report_key"):
    return F.concat(F.lit("inventory "), F.col(report))


def shared_texts(messages: DataFrame, blocks: DataFrame, asked: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """(key, part_no, role, text): the first ``limit`` messages of the asked sessions, and the blocks of the asked inventories.

    ``asked`` has the prompts (session_id, report_key). Each text is in once, however many prompts name it.
    """
    sessions = asked.select("session_id").distinct()
    recent = messages_of(salted_join(messages, sessions, ["session_id"], ["msg_no"], "left_semi"), limit)
    told = recent.select(history_key().alias("key"), F.col("msg_no").cast("long").alias("part_no"), "role", F.col("content").alias("text"))
    reports = asked.where("report_key is not null").select("report_key").distinct()
    listed = salted_join(blocks, reports, ["report_key"], ["block_no"], "left_semi")
    return told.unionByName(listed.select(inventory_key().alias("key"), F.col("block_no").cast("long").alias("part_no"), F.lit(None).cast("string").alias("role"), "text"))


def _inventory(report: str, blocks: list[str]) -> str:
    if blocks:
        return "\n".join(blocks)
    return NO_SHEETS if report == "*" else f"{report} — sheets: (none)"


def rendered(row: dict, shared: dict[str, list[tuple[str, str]]]) -> list[Message]:
    """The message list of one prompt: system, summary, text context, structured context, history; blank parts are left out."""
    structured = row["structured"] or ""
    if row["report_key"] is not None:
        blocks = [text for _, text in shared.get(f"inventory {row['report_key']}", [])]
        structured += ("\n\n" if structured else "") + INVENTORY_TITLE + "\n" + _inventory(row["report_key"], blocks)
    # Titles of the context messages.
    titled = [("Prior summary:", row["summary"]), ("Retrieved text context:", row["context"]), ("Structured data context (read-only):", structured)]
    head = [("system", row["system"])] + [("system", f"{title}\n{text}") for title, text in titled if text]
    return head + shared.get(f"history {row['session_id']}", [])


def digest_chat() -> Chat:
    """Stand-in for a model: a digest of all messages."""

    def answer(prompts: list[list[Message]]) -> list[str]:
        return ["digest " + hashlib.md5("\x1e".join(f"{role}\x1f{text}" for role, text in p).encode()).hexdigest() for p in prompts]

    return answer


ANSWERS = "query_id {}, session_id string, answer string, n_messages int, n_chars long, error string"


def answers(prompts: DataFrame, texts: DataFrame, chat: Callable[[], Chat] = digest_chat, batch: int = 16) -> DataFrame:
    """(query_id, session_id, answer, n_messages, n_chars, error) of ``prompts`` (query_id, session_id, system, summary, context, structured, report_key).

    ``chat`` is a factory called once per writer; it returns a function from message lists to texts. A prompt that comes back
    blank is asked once more with its system text alone. A writer has about ``WRITER_QUERIES`` prompts and, of ``texts``, one copy of what they name.
    """
    writers = max(1, -(-prompts.count() // WRITER_QUERIES))
    dealt = prompts.withColumn("writer", F.pmod(F.xxhash64("query_id"), F.lit(writers)))
    keys = F.array(history_key(), inventory_key())
    named = dealt.select("writer", F.explode(F.array_compact(keys)).alias("key")).distinct()
    # A key that all writers name meets its parts divided by salt.
    sent = salted_join(texts, named, ["key"], ["part_no"]).select(F.col("writer").alias("to_writer"), "key", "part_no", "role", "text")
    schema = ANSWERS.format(prompts.schema["query_id"].dataType.simpleString())

    def run(asked: pa.Table, parts: pa.Table) -> pa.Table:
        shared: dict[str, list[Message]] = {}
        for key, role, text in zip(*(parts.sort_by([("key", "ascending"), ("part_no", "ascending")]).column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
            shared.setdefault(key, []).append((role, text))
        answer = chat()
        rows = asked.sort_by("session_id")
        out = {name.split(" ")[0]: [] for name in schema.split(", ")}
        for start in range(0, rows.num_rows, batch):
            some = rows.slice(start, batch).to_pylist()
            messages = [rendered(row, shared) for row in some]
            try:
                got = [(a or "").strip() for a in answer(messages)]
                again = [i for i, a in enumerate(got) if not a]
                if again:
                    for i, a in zip(again, answer([[("system", some[i]["system"])] for i in again]), strict=True):
                        got[i] = (a or "").strip()
                problems = [None] * len(some)
            except Exception as problem:  # noqa: BLE001 - reported per row
                got, problems = [None] * len(some), [f"{type(problem).__name__}: {problem}"] * len(some)
            out["query_id"] += [row["query_id"] for row in some]
            out["session_id"] += [row["session_id"] for row in some]
            out["answer"] += got
            out["n_messages"] += [len(m) for m in messages]
            out["n_chars"] += [sum(len(text or "") for _, text in m) for m in messages]
            out["error"] += problems
        kinds = [asked.schema.field("query_id").type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))

    columns = ["writer", "query_id", "session_id", "system", "summary", "context", "structured", "report_key"]
    return dealt.select(*columns).groupBy("writer").cogroup(sent.groupBy("to_writer")).applyInArrow(run, schema)


def chat_turn(queries: DataFrame, messages: DataFrame, contexts: DataFrame, snippets: DataFrame, blocks: DataFrame, system: str, chat: Callable[[], Chat] = digest_chat,
              summarise: Callable[[], Completer] | None = None, turns: int = SUMMARY_TURNS) -> tuple[DataFrame, DataFrame]:
    """The answers to ``queries`` (query_id, session_id, query, created_at), and all messages with the questions and answers of this turn.

    A question is appended to its session first, so that it is in the history and in what is summarised. ``contexts``
    (query_id, context) and ``snippets`` (query_id, structured) were retrieved for the queries, ``blocks`` (report_key, block_no, text) are the
    inventories; a query that asks for one gets it by key. A failed model call leaves no answer in the session.
    """
    ask = queries.select("session_id", F.lit("user").alias("role"), F.col("query").alias("content"), "created_at", F.col("query_id").alias("seq"))
    columns = ["session_id", "msg_no", "role", "content", "created_at"]
    stored = settled(append_messages(messages.select(*columns), ask))
    asked_sessions = queries.select("session_id").distinct()
    talked = salted_join(stored, asked_sessions, ["session_id"], ["msg_no"], "left_semi")
    summaries = generate(summary_prompts(asked_sessions, transcript(talked, turns)), "prompt", summarise).select("session_id", F.col("completion").alias("summary"))
    routed = route_inventory(queries).select("query_id", "report_key")
    known = salted_join(queries.select("query_id", "session_id", "created_at"), summaries, ["session_id"], ["query_id"], "left")
    known = known.join(contexts, "query_id", "left").join(snippets, "query_id", "left").join(routed, "query_id", "left")
    prompts = settled(known.select("query_id", "session_id", "created_at", F.lit(system).alias("system"), "summary", "context", "structured", "report_key"))
    told = settled(answers(prompts, shared_texts(stored, blocks, prompts), chat))
    said = told.where("answer is not null").join(prompts.select("query_id", "created_at"), "query_id")
    replies = said.select("session_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), "created_at", F.col("query_id").alias("seq"))
    return told, append_messages(stored, replies)
