"""Prompt texts and message lists for a table of queries; the model itself is a hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .conversations import MESSAGE_LIMIT, messages_of
from .spread import salted_join

NO_TEXT_CONTEXT = "(no text context)"
NO_CONTEXT = "(no context provided)"
NO_CONSTRAINTS = "N/A"
SHORT_CHARS = 300


def _hit_lines(hits: DataFrame, text: Column, start: int, separator: str) -> DataFrame:
    page = F.coalesce(F.nullif("page", F.lit(0)).cast("string"), F.lit("-"))
    number = (F.col("rank") + (start - 1)).cast("string")
    line = F.concat(F.lit("["), number, F.lit("] "), F.col("source"), F.lit(" p"), page, F.lit(" — "), text)
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), separator).alias("context"))


def context_block(queries: DataFrame, hits: DataFrame, start: int = 1) -> DataFrame:
    """(query_id, context): numbered hits with their text, set apart by blank lines."""
    blocks = _hit_lines(hits, F.col("text"), start, "\n\n")
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(NO_TEXT_CONTEXT)).alias("context")
    )


def context_block_short(queries: DataFrame, hits: DataFrame, start: int = 1) -> DataFrame:
    """The same on one line each, the text cut at 300 characters."""
    cut = F.concat(F.substring("text", 1, SHORT_CHARS), F.lit("..."))
    blocks = _hit_lines(hits, cut, start, "\n")
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")
    )


def system_prompt(assistant: str, organisation: str, answering: str, strict_text: str, strict: Column) -> Column:
    """The three parts on lines of their own, and the strict part where ``strict`` holds."""
    return F.concat_ws("\n", F.lit(assistant), F.lit(organisation), F.lit(answering), F.when(strict, F.lit(strict_text)))


def chat_messages(queries: DataFrame, messages: DataFrame, history_limit: int = MESSAGE_LIMIT) -> DataFrame:
    """(query_id, messages): the ordered list a model is given.

    ``queries(query_id, session_id, system, summary, context, structured)``: the system text, then the summary, the
    text context and the structured context where present, then the first ``history_limit`` messages of the session. A list
    holds its whole history; ``turns`` puts lists together where the model is called instead.
    """

    def system_message(text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.lit("system").alias("role"), text.alias("content")))

    def titled(title: str, col: str) -> Column:
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(title + "\n"), F.col(col)))

    # Titles of the context messages.
    head = F.array_compact(F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        system_message(titled("Prior summary:", "summary")),
        system_message(titled("Retrieved text context:", "context")),
        system_message(titled("Structured data context (read-only):", "structured")),
    ))
    asked = queries.select(F.col("session_id")).distinct()
    recent = messages_of(salted_join(messages, asked, ["session_id"], ["msg_no"], "left_semi"), history_limit)
    ordered = F.array_sort(F.collect_list(F.struct("msg_no", "role", "content")))
    history = recent.groupBy("session_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history")
    )
    none = F.array().cast("array<struct<role:string,content:string>>")
    return salted_join(queries, history, ["session_id"], ["query_id"], "left").select(
        "query_id", F.concat(head, F.coalesce("history", none)).alias("messages")
    )


def parse_constraints(col: Column) -> Column:
    """Comma-separated entries, stripped, without blank ones."""
    from ..functions.text import strip

    return F.filter(F.transform(F.split(col, ","), strip), lambda c: c != "")


def render_template(template: str, feature: Column, component: Column, scenarios: Column, constraints: Column,
                    context: Column) -> Column:
    """Fill ``{feature_name}``, ``{component}``, ``{scenarios}``, ``{constraints}`` and ``{context}``.

    The template is cut at its placeholders, so braces in the values are left alone.
    """
    import re

    values = {
        "feature_name": feature,
        "component": F.when(F.coalesce(component, F.lit("")) != "", F.concat(F.lit(" in component "), component)).otherwise(""),
        "scenarios": scenarios.cast("string"),
        "constraints": F.when(F.size(constraints) > 0, F.array_join(constraints, ", ")).otherwise(NO_CONSTRAINTS),
        "context": F.when(F.coalesce(context, F.lit("")) != "", context).otherwise(NO_CONTEXT),
    }
    pieces = re.split(r"\{(%s)\}" % "|".join(values), template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


Completer = Callable[[list[str]], list[str]]


def generate(df: DataFrame, prompt_col: str, completer: Callable[[], Completer] | None = None, batch_rows: int = 64) -> DataFrame:
    """Add ``completion`` (stripped) and ``error``.

    ``completer`` is a factory called once per task; it returns a function from a list of prompts to as many texts.
    Prompts that come back empty are sent once more. Without a completer the answer is a digest of the prompt.
    """
    from ..functions.text import strip

    if completer is None:
        digest = F.concat(F.lit("digest "), F.md5(F.encode(F.col(prompt_col), "utf-8")))
        return df.withColumn("completion", strip(digest)).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = completer()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows].copy()
                prompts = part[prompt_col].tolist()
                try:
                    answers = [(a or "").strip() for a in complete(prompts)]
                    empty = [i for i, a in enumerate(answers) if not a]
                    if empty:
                        for i, again in zip(empty, complete([prompts[i] for i in empty])):
                            answers[i] = (again or "").strip()
                    if len(answers) != len(prompts):
                        raise ValueError(f"{len(prompts)} prompts, {len(answers)} answers")
                    part["completion"], part["error"] = answers, None
                except Exception as problem:  # noqa: BLE001 - reported per row
                    part["completion"], part["error"] = None, f"{type(problem).__name__}: {problem}"
                yield part

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("completion", StringType()), StructField("error", StringType())]))


def generate_cases(requests: DataFrame, hits: DataFrame, template: str, completer: Callable[[], Completer] | None = None) -> DataFrame:
    """(query_id, file_name, prompt, completion, error, meta) of ``requests`` (query_id, feature, component, scenarios, constraints).

    The hits that were retrieved for a request go into its prompt, shortened. ``meta`` holds what was asked for: feature, scenarios
    and the single constraints. The file is named after the feature.
    """
    shown = context_block_short(requests, hits)
    listed = requests.withColumn("_constraints", parse_constraints(F.col("constraints"))).join(shown, "query_id")
    prompt = render_template(template, F.col("feature"), F.col("component"), F.col("scenarios"), F.col("_constraints"), F.col("context"))
    meta = F.struct("feature", "scenarios", F.col("_constraints").alias("constraints"))
    name = F.concat(F.translate("feature", " ", "_"), F.lit(".feature"))
    asked = listed.select("query_id", name.alias("file_name"), prompt.alias("prompt"), meta.alias("meta"))
    return generate(asked, "prompt", completer)
