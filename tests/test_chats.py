import json

import pytest
from pyspark.sql import functions as F

from sheavework.operators import catalog, search
from sheavework.operators import conversations as G
from sheavework.operators import prompts as H
from sheavework.operators import turns as T
from sheavework.sources import sinks

MESSAGES = "session_id string, msg_no long, role string, content string, created_at double"


def test_roundtrip(spark):
    starts = spark.createDataFrame([(17,)], "ms long")
    sessions = G.start_sessions(starts, "ms", F.lit(1.5), F.lit("u"))
    assert sessions.first() == ("sess_17", "Untitled chat", "u", 1.5)
    none = spark.createDataFrame([], MESSAGES)
    batch = spark.createDataFrame([("sess_17", "user", "hello", 1.0), ("sess_17", "assistant", "world", 2.0)], "session_id string, role string, content string, created_at double")
    messages = G.append_messages(none, batch)
    assert G.messages_of(messages).orderBy("msg_no").first().content == "hello"
    prompts = G.summary_prompts(sessions, G.transcript(messages))
    answer = H.generate(prompts, "prompt", lambda: lambda ps: ["summary"] * len(ps)).first()
    assert answer.completion == "summary" and answer.prompt.endswith("User: hello\nAssistant: world\n\nSummary:")
    more = G.append_messages(messages, spark.createDataFrame([("sess_17", "user", "again", 3.0)], batch.schema))
    assert [r.msg_no for r in more.orderBy("msg_no").collect()] == [1, 2, 3]


def test_hot_session(spark):
    batch = spark.range(5000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.col("id").cast("string")).alias("session_id"), F.lit("user").alias("role"),
                                     F.format_string("%05d", "id").alias("content"), F.lit(1.0).alias("created_at"), F.col("id").alias("seq"))
    messages = G.append_messages(spark.createDataFrame([], MESSAGES), batch)
    hot = messages.where("session_id = 'hot'").orderBy("msg_no").collect()
    assert [r.msg_no for r in hot] == list(range(1, 4001)) and [r.content for r in hot] == sorted(r.content for r in hot)
    assert G.messages_of(messages).where("session_id = 'hot'").count() == 200
    tail = G.messages_of(messages, 24, 4).where("session_id = 'hot'").orderBy("msg_no").collect()
    assert [r.msg_no for r in tail] == [21, 22, 23, 24]
    last = G.transcript(messages, 1, "last").where("session_id = 'hot'").first().transcript
    assert last == "\n".join(f"User: {r.content}" for r in hot[-2:])
    sessions = spark.createDataFrame([("hot", "t", "u", 1.0)], "session_id string, title string, user string, created_at double")
    parts = G.export_sessions(sessions, sessions, messages, 500).orderBy("part_no").collect()
    assert len(parts) == 8 and [m.content for p in parts for m in p.messages] == [r.content for r in hot]


def test_export_unknown(spark, tmp_path):
    sessions = spark.createDataFrame([("a", "t", "u", 1.0)], "session_id string, title string, user string, created_at double")
    messages = spark.createDataFrame([("a", 1, "user", "x", 2.0)], MESSAGES)
    asked = spark.createDataFrame([("a",), ("zz",)], "session_id string")
    got = {r.session_id: json.loads(r.json) for r in G.export_json(G.export_sessions(asked, sessions, messages)).collect()}
    assert got["zz"] == {"session": None, "messages": []}
    assert got["a"] == {"session": {"id": "a", "title": "t", "user": "u", "created_at": 1.0}, "messages": [{"role": "user", "content": "x", "created_at": 2.0}]}
    sinks.export_session_json(asked, sessions, messages, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_rename_title_clear(spark):
    sessions = spark.createDataFrame([("a", "t", "u", 1.0), ("b", "t", "u", 1.0)], "session_id string, title string, user string, created_at double")
    titles = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("zz", "no", 1)], "session_id string, title string, n int")
    named = G.rename_sessions(sessions, titles, F.col("n"))
    assert {r.session_id: r.title for r in named.collect()} == {"a": "two", "b": "t"}
    shown = {r.session_id: (r.title, r.shown_title) for r in G.session_titles(titles.select("session_id").distinct(), named).collect()}
    assert shown == {"a": ("two", "two"), "zz": (None, "Untitled chat")}
    messages = spark.createDataFrame([("a", 1, "user", "x", 1.0), ("b", 1, "user", "y", 1.0)], MESSAGES)
    left = G.clear_sessions(messages, spark.createDataFrame([("a",), ("a",)], "session_id string"))
    assert [r.session_id for r in left.collect()] == ["b"]
    assert {r.session_id: r.prompt for r in G.summary_prompts(sessions, G.transcript(left)).collect()}["a"] == ""


def test_contexts(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 2, "b", 0, "y" * 400), (1, 1, "a", 3, "x")], "query_id int, rank int, source string, page int, text string")
    got = {r.query_id: r.context for r in H.context_block(queries, hits).collect()}
    assert got == {1: "[1] a p3 — x\n\n[2] b p- — " + "y" * 400, 2: "(no text context)"}
    assert H.context_block(queries, hits, start=2).where("query_id = 1").first().context.startswith("[2] a")
    short = {r.query_id: r.context for r in H.context_block_short(queries, hits).collect()}
    assert short == {1: "[1] a p3 — x...\n[2] b p- — " + "y" * 300 + "...", 2: "(no context provided)"}


def test_chat_messages(spark):
    q = spark.createDataFrame([(1, "a", "S", "sum", "ctx", "tab"), (2, "b", "S", "", None, "")], "query_id int, session_id string, system string, summary string, context string, structured string")
    messages = spark.createDataFrame([("a", i, "user", f"m{i}", 1.0) for i in range(1, 300)], MESSAGES)
    got = {r.query_id: [tuple(m) for m in r.messages] for r in H.chat_messages(q, messages).collect()}
    assert got[2] == [("system", "S")]
    assert got[1][:4] == [("system", "S"), ("system", "Prior summary:\nsum"), ("system", "Retrieved text context:\nctx"), ("system", "Structured data context (read-only):\ntab")]
    assert [m[1] for m in got[1][4:]] == [f"m{i}" for i in range(1, 201)]


def test_templates(spark):
    df = spark.createDataFrame([("F {context}", "", 3, " GDPR, ,P95 < 250ms ,", None)], "f string, c string, n int, k string, x string")
    parsed = H.parse_constraints(F.col("k"))
    text = H.render_template("<{feature_name}>{component} {scenarios} {constraints} {context} {other}", F.col("f"), F.col("c"), F.col("n"), parsed, F.col("x"))
    assert df.select(text).first()[0] == "<F {context}> 3 GDPR, P95 < 250ms (no context provided) {other}"
    strict = H.system_prompt("a", "b", "c", "d", F.col("n") > 2)
    assert df.select(strict).first()[0] == "a\nb\nc\nd"


def test_generate_retries_and_reports(spark):
    def completer():
        calls = []

        def complete(prompts):
            calls.append(len(prompts))
            if "boom" in prompts:
                raise RuntimeError("down")
            return ["" if len(calls) == 1 else " again "] * len(prompts)

        return complete

    df = spark.createDataFrame([("p",)], "t string").coalesce(1)
    assert H.generate(df, "t", completer).first().completion == "again"
    bad = H.generate(spark.createDataFrame([("boom",)], "t string"), "t", completer).first()
    assert bad.completion is None and "down" in bad.error


def _turn(spark, queries, messages, chat, blocks=(), contexts=(), snippets=(), summarise=None):
    asked = spark.createDataFrame(queries, "query_id string, session_id string, query string, created_at double")
    return T.chat_turn(asked, messages, spark.createDataFrame(list(contexts), "query_id string, context string"), spark.createDataFrame(list(snippets), "query_id string, structured string"),
                       spark.createDataFrame(list(blocks), "report_key string, block_no int, text string"), "Answer.", chat, summarise)


def echo():
    """A model that says what it was told; made here so that it travels with the job."""
    return lambda: lambda prompts: ["|".join(f"{r}:{t}" for r, t in p) for p in prompts]


def test_a_session_from_start_to_answer(spark):
    """Start, ask, read back, summarise: the whole way of one conversation."""
    sessions = G.start_sessions(spark.createDataFrame([(17,)], "ms long"), "ms", F.lit(1.5), F.lit("u"))
    sid = sessions.first().session_id
    none = spark.createDataFrame([], MESSAGES)
    told, stored = _turn(spark, [("q1", sid, "hello", 1.0)], none, lambda: lambda ps: ["world"] * len(ps), summarise=lambda: lambda ps: ["summary"] * len(ps))
    assert [(r.msg_no, r.role, r.content) for r in stored.orderBy("msg_no").collect()] == [(1, "user", "hello"), (2, "assistant", "world")]
    assert G.messages_of(stored).orderBy("msg_no").first().content == "hello"
    prompts = G.summary_prompts(sessions, G.transcript(stored))
    assert isinstance(H.generate(prompts, "prompt", lambda: lambda ps: ["summary"] * len(ps)).first().completion, str)
    told, stored = _turn(spark, [("q2", sid, "more", 2.0)], stored, echo(), summarise=lambda: lambda ps: ["summary"] * len(ps))
    assert told.first().answer == "system:Answer.|system:Prior summary:\nsummary|user:hello|assistant:world|user:more"
    assert stored.count() == 4


def test_shared_texts_are_sent_once_for_each_writer(spark, monkeypatch):
    monkeypatch.setattr(T, "WRITER_QUERIES", 40)
    messages = spark.createDataFrame([("hot", i, "user", f"m{i}", float(i)) for i in range(1, 301)], MESSAGES)
    queries = [(f"q{i:03d}", "hot" if i % 3 else f"s{i}", ["all sheets", 'columns of "b.xlsx"', "plain", 'fields of "zz.xls"'][i % 4], 1000.0) for i in range(120)]
    blocks = [("*", i, f"line {i}") for i in range(30)] + [("b.xlsx", 0, "b.xlsx — sheets:\n- x (1 cols × 1 rows)")]
    asked = spark.createDataFrame([(q, s, "a", "", "c", None, None) for q, s, _, _ in queries], "query_id string, session_id string, system string, summary string, context string, structured string, report_key string")
    texts = T.shared_texts(messages, spark.createDataFrame(blocks, "report_key string, block_no int, text string"), asked.withColumn("report_key", F.lit("*")))
    assert texts.count() == 230
    told, stored = _turn(spark, queries, messages, echo(), blocks, [(q, f"ctx {q}") for q, *_ in queries], [(q, f"snip {q}") for q, *_ in queries[::2]])
    got = {r.query_id: r for r in told.collect()}
    assert len(got) == 120 and all(r.error is None for r in got.values())
    history = "|".join(f"user:m{i}" for i in range(1, 201))
    assert got["q004"].answer.endswith("system:Structured data context (read-only):\nsnip q004\n\nSheet inventory:\n" + "\n".join(f"line {i}" for i in range(30)) + "|" + history)
    assert got["q001"].answer.endswith("system:Structured data context (read-only):\nSheet inventory:\nb.xlsx — sheets:\n- x (1 cols × 1 rows)|" + history)
    assert "zz.xls — sheets: (none)|user:" in got["q003"].answer and got["q003"].answer.endswith("|user:fields of \"zz.xls\"")
    assert got["q002"].answer.endswith("system:Structured data context (read-only):\nsnip q002|" + history) and "Prior summary:\ndigest " in got["q002"].answer
    hot = [r.role for r in stored.where("session_id = 'hot'").orderBy("msg_no").collect()]
    assert hot == ["user"] * 380 + ["assistant"] * 80


def test_blank_and_failing_answers(spark):
    def moody():
        def answer(prompts):
            if any("fail" in t for p in prompts for _, t in p):
                raise RuntimeError("no model")
            return ["" if len(p) > 1 else " from the system " for p in prompts]

        return answer

    told, stored = _turn(spark, [("a", "s1", "blank", 1.0)], spark.createDataFrame([], MESSAGES), moody)
    assert told.first().answer == "from the system"
    told, stored = _turn(spark, [("a", "s1", "fail", 1.0)], spark.createDataFrame([], MESSAGES), moody)
    assert told.first().answer is None and "no model" in told.first().error and [r.role for r in stored.collect()] == ["user"]


def test_order_is_required(spark):
    none = spark.createDataFrame([], MESSAGES)
    tied = spark.createDataFrame([("s", "user", "b", 1.0, 1), ("s", "user", "a", 1.0, 2)], "session_id string, role string, content string, created_at double, seq int")
    with pytest.raises(ValueError, match="sequence column"):
        G.append_messages(none, tied.drop("seq"))
    assert [r.content for r in G.append_messages(none, tied).orderBy("msg_no").collect()] == ["b", "a"]
    twice = spark.createDataFrame([("a", "csv", 1), ("a", "xls", 2)], "source string, kind string, n int")
    with pytest.raises(ValueError, match="give it an order"):
        catalog.upsert(twice.limit(0), twice, ["source"])
    assert catalog.upsert(twice.limit(0), twice, ["source"], [F.col("n").desc()]).first().kind == "xls"


def test_cases_and_resources(spark):
    requests = spark.createDataFrame([("q", "Log in", None, 2, " GDPR ,, fast"), ("r", "Out", "shop", 1, "")], "query_id string, feature string, component string, scenarios int, constraints string")
    hits = spark.createDataFrame([("q", 1, "c", "t" * 400, "a.pdf", 3, 0.5)], "query_id string, rank int, chunk_id string, text string, source string, page int, score double")
    made = {r.query_id: r for r in H.generate_cases(requests, hits, "{feature_name}{component}/{scenarios}/{constraints}/{context}", lambda: lambda ps: [f" {len(ps)} cases "] * len(ps)).collect()}
    assert made["q"].file_name == "Log_in.feature" and made["q"].meta == ("Log in", 2, ["GDPR", "fast"]) and made["q"].completion.endswith("cases")
    assert made["q"].prompt == "Log in/2/GDPR, fast/[1] a.pdf p3 — " + "t" * 300 + "..."
    assert made["r"].prompt == "Out in component shop/1/N/A/(no context provided)"
    tables = spark.createDataFrame([("q", 2, "d", "s"), ("q", 1, "e", "s")], "query_id string, rank int, document string, sheet string")
    texts = spark.createDataFrame([("q", 1, "a.pdf", 3, ["h"])], "query_id string, rank int, document string, page int, headings array<string>")
    both = {r.query_id: r for r in search.resources(requests, tables, texts).collect()}
    assert [t.document for t in both["q"].structured] == ["e", "d"] and both["q"].text[0].headings == ["h"]
    assert both["r"].structured == [] and both["r"].text == []


def test_turns_find_chunks_by_their_whole_text(spark, tmp_path):
    """The asked words stand behind the first 160 characters of the one document, and in no preview; decoys show some of them at once."""
    from sheavework.plans import chats, inputs

    filler = " ".join(["filler"] * 40)
    texts = [filler + " zebra quagga okapi"] + [f"zebra other{i} {filler}" for i in range(8)]
    spark.createDataFrame([(i, "en", t, len(t)) for i, t in enumerate(texts)], "doc_id long, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.createDataFrame([("q", "zebra quagga okapi quagga okapi")], "query_id string, query string")
    found = {kind: [r.source for r in chats._hits(spark, str(tmp_path), asked, kind).orderBy("rank").collect()] for kind in ("preview", "text")}
    assert found["text"][0] == "doc_0.txt" and "doc_0.txt" not in found["preview"]
    assert inputs.text_base(spark, str(tmp_path), "text")["vectors"].count() == 9
    assert "whole_vectors" in chats.sql("", "whole_vectors")
