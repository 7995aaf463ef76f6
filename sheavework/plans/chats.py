"""Queries over conversations and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, search, vectors
from ..operators import conversations as G
from ..operators import prompts as H
from ..operators import turns as T
from ..session import scratch_path
from ..sources import sinks
from . import inputs as I
from .inputs import sql, strip_sql
from .catalogs import INVENTORY_BLOCKS
from .lookup import _MATCHED, _SAMPLED, _SNIPPETS, STORED, lookup_steps
from .nearest import hits_sql, text_hits
from .registry import register


@register("start_sessions", "SELECT DISTINCT 'sess_' || conv_id AS session_id, 'Untitled chat' AS title, 'user' AS \"user\", 1704067200 + conv_id * 60 AS created_at FROM conversations")
def start_sessions(spark, sf):
    starts = I.table(spark, sf, "conversations").select("conv_id").distinct()
    return G.start_sessions(starts, "conv_id", F.lit(1704067200) + F.col("conv_id") * 60)


@register("append_messages", sql("SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, msg_no) AS msg_no, role, content, created_at FROM messages", "messages"))
def append_messages(spark, sf):
    """All messages, numbered by time and by their sequence in what was sent."""
    everything = I.messages(spark, sf)
    stored = G.append_messages(everything.where(F.lit(False)), everything.withColumnRenamed("msg_no", "seq"))
    return stored.select("session_id", "msg_no", "role", "content", "created_at")


@register("append_messages_to_stored", sql("""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY role <> 'user', created_at, msg_no) AS msg_no, role, content FROM messages""", "messages"))
def append_messages_to_stored(spark, sf):
    """User messages are stored; the others come later and go on with the numbers."""
    everything = I.messages(spark, sf)
    sent = everything.withColumnRenamed("msg_no", "seq")
    stored = G.append_messages(everything.where(F.lit(False)), sent.where("role = 'user'"))
    both = G.append_messages(stored, sent.where("role <> 'user'"))
    return both.select("session_id", "msg_no", "role", "content")


@register("rename_sessions", sql("""SELECT session_id, coalesce(n.title, s.title) AS title FROM sessions s LEFT JOIN
    (SELECT session_id, max_by(content, msg_no) AS title FROM messages WHERE role = 'user' GROUP BY session_id) n USING (session_id)""", "sessions", "messages"))
def rename_sessions(spark, sf):
    """A session is named after its last user message."""
    titles = I.messages(spark, sf).where("role = 'user'").select("session_id", F.col("content").alias("title"), "msg_no")
    return G.rename_sessions(I.sessions(spark, sf), titles, F.col("msg_no")).select("session_id", "title")


@register("session_title", """SELECT 'sess_' || user_id AS session_id, CASE WHEN c.conv_id IS NOT NULL THEN 'Chat ' || user_id END AS title,
    CASE WHEN c.conv_id IS NOT NULL THEN 'Chat ' || user_id ELSE 'Untitled chat' END AS shown_title FROM (SELECT DISTINCT user_id FROM events) e
    LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = e.user_id""")
def session_title(spark, sf):
    asked = I.table(spark, sf, "events").select(F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id")).distinct()
    return G.session_titles(asked, I.sessions(spark, sf))


@register("clear_sessions", sql("SELECT session_id, msg_no, content FROM messages WHERE session_id NOT IN (SELECT session_id FROM messages WHERE role = 'system')", "messages"))
def clear_sessions(spark, sf):
    """Sessions with a system message are cleared."""
    messages = I.messages(spark, sf)
    return G.clear_sessions(messages, messages.where("role = 'system'")).select("session_id", "msg_no", "content")


@register("messages_of", sql("SELECT session_id, msg_no, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_no) AS n FROM messages) WHERE n <= 200", "messages"))
def messages_of(spark, sf):
    return G.messages_of(I.messages(spark, sf)).select("session_id", "msg_no", "content")


@register("messages_of_tail", sql("""SELECT session_id, msg_no, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_no DESC) AS m FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_no) AS n FROM messages) WHERE n <= 5)) WHERE m <= 2""", "messages"))
def messages_of_tail(spark, sf):
    return G.messages_of(I.messages(spark, sf), limit=5, tail=2).select("session_id", "msg_no", "content")


def _transcript_sql(direction: str) -> str:
    return f"""SELECT session_id, string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY msg_no) AS transcript FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_no {direction}) AS n FROM messages) WHERE n <= {{0}} GROUP BY session_id"""


@register("transcript", sql(_transcript_sql("").format(24), "messages"))
def transcript(spark, sf):
    return G.transcript(I.messages(spark, sf))


@register("transcript_last", sql(_transcript_sql("DESC").format(4), "messages"))
def transcript_last(spark, sf):
    return G.transcript(I.messages(spark, sf), max_turns=2, mode="last")


@register("summary_prompt", sql(f"""SELECT s.session_id, coalesce('{G.SUMMARY_REQUEST}' || transcript || '{G.SUMMARY_END}', '') AS prompt FROM sessions s LEFT JOIN (
    {_transcript_sql('').format(24).replace('FROM messages)', "FROM messages WHERE session_id NOT IN (SELECT session_id FROM messages WHERE role = 'system'))")}) t USING (session_id)""", "sessions", "messages"))
def summary_prompt(spark, sf):
    """Cleared sessions have no history and so an empty prompt."""
    messages = I.messages(spark, sf)
    left = G.clear_sessions(messages, messages.where("role = 'system'"))
    return G.summary_prompts(I.sessions(spark, sf), G.transcript(left))


_EXPORT_ROWS = """SELECT 'sess_' || user_id AS session_id FROM events UNION SELECT session_id FROM sessions"""


@register("export_sessions", sql(f"""SELECT a.session_id, coalesce(m.part_no, 0) AS part_no, s.title, s.created_at, coalesce(m.n, 0) AS n_messages, m.texts FROM ({_EXPORT_ROWS}) a LEFT JOIN sessions s USING (session_id)
    LEFT JOIN (SELECT session_id, (msg_no - 1) // 4 AS part_no, count(*) AS n, string_agg(role || '=' || content || '@' || created_at, chr(10) ORDER BY msg_no) AS texts FROM messages GROUP BY ALL) m USING (session_id)""", "sessions", "messages"))
def export_sessions(spark, sf):
    """All sessions and unknown ones, in parts of four messages."""
    sessions = I.sessions(spark, sf)
    unknown = I.table(spark, sf, "events").select(F.concat(F.lit("sess_"), F.col("user_id").cast("string")).alias("session_id"))
    out = G.export_sessions(sessions.select("session_id").unionByName(unknown), sessions, I.messages(spark, sf), 4)
    texts = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"], F.lit("@"), m["created_at"].cast("string")))
    return out.select("session_id", "part_no", "session.title", "session.created_at", F.size("messages").alias("n_messages"),
                      F.when(F.size("messages") > 0, F.array_join(texts, "\n")).alias("texts"))


@register("export_session_json", sql("""SELECT 'sess_' || json_extract_string(j, '$.conv') AS session_id, json_extract_string(j, '$.title') AS title, n AS n_messages, first AS first_text FROM (
    SELECT to_json({conv: conv_id::VARCHAR, title: 'Chat ' || conv_id}) AS j, count(*) AS n, min_by(text, turn) AS first FROM conversations GROUP BY conv_id)"""))
def export_session_json(spark, sf):
    """Written as JSON lines and read back."""
    path = scratch_path(spark, "sessions")
    sessions = I.sessions(spark, sf)
    sinks.export_session_json(sessions, sessions, I.messages(spark, sf), path)
    schema = "session STRUCT<id: STRING, title: STRING, user: STRING, created_at: BIGINT>, messages ARRAY<STRUCT<role: STRING, content: STRING, created_at: BIGINT>>"
    back = spark.read.schema(schema).json(path)
    return back.select(F.col("session.id").alias("session_id"), "session.title", F.size("messages").alias("n_messages"), F.col("messages")[0]["content"].alias("first_text"))


# ------------------------------------------------------------------ prompts

CONTEXT = """contexts AS (SELECT q.query_id, coalesce(c.context, '(no text context)') AS context FROM {0} q LEFT JOIN (SELECT query_id,
    string_agg('[' || rank || '] ' || source || ' p' || coalesce(nullif(page, 0)::VARCHAR, '-') || ' — ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hydrated GROUP BY query_id) c USING (query_id))"""


def _hits(spark, sf, queries, embedded="preview"):
    return vectors.hydrate_hits(text_hits(spark, sf, queries, embedded=embedded), I.text_base(spark, sf, embedded)["chunks"])


@register("context_block", hits_sql(", " + CONTEXT.format("text_queries") + " SELECT * FROM contexts"))
def context_block(spark, sf):
    queries = I.text_queries(spark, sf)
    return H.context_block(queries, _hits(spark, sf, queries))


@register("context_block_short", hits_sql("""SELECT q.query_id, coalesce(c.context, '(no context provided)') AS context FROM text_queries q LEFT JOIN (SELECT query_id,
    string_agg('[' || rank || '] ' || source || ' p' || CASE WHEN page = 1 THEN '-' ELSE page::VARCHAR END || ' — ' || substr(text, 1, 300) || '...', chr(10) ORDER BY rank) AS context FROM hydrated WHERE rank <> 2 GROUP BY query_id) c USING (query_id)"""))
def context_block_short(spark, sf):
    """Page 1 is taken as unknown here, so that the dash occurs."""
    queries = I.text_queries(spark, sf)
    hits = _hits(spark, sf, queries).where("rank <> 2").withColumn("page", F.nullif("page", F.lit(1)))
    return H.context_block_short(queries, hits)


@register("system_prompt", "SELECT conv_id, turn, 'Answer briefly.' || chr(10) || 'We test.' || chr(10) || 'Start with the answer.' || CASE WHEN role = 'user' THEN chr(10) || 'Be strict.' ELSE '' END AS system FROM conversations")
def system_prompt(spark, sf):
    text = H.system_prompt("Answer briefly.", "We test.", "Start with the answer.", "Be strict.", F.col("role") == "user")
    return I.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("system"))


@register("chat_messages", hits_sql(", " + lookup_steps("chat_queries", 3, _MATCHED, _SAMPLED, _SNIPPETS) + ", " + CONTEXT.format("chat_queries") + f""",
    summaries AS (SELECT session_id, 'digest ' || md5('{G.SUMMARY_REQUEST}' || transcript || '{G.SUMMARY_END}') AS summary FROM ({_transcript_sql("").format(24)})),
    listed AS (SELECT query_id, 0 AS n, 'system' AS role, 'Answer.' AS content FROM chat_queries UNION ALL SELECT query_id, 1, 'system', 'Prior summary:' || chr(10) || summary FROM chat_queries JOIN summaries USING (session_id)
      UNION ALL SELECT query_id, 2, 'system', 'Retrieved text context:' || chr(10) || context FROM contexts UNION ALL SELECT query_id, 3, 'system', 'Structured data context (read-only):' || chr(10) || structured FROM snippets WHERE structured <> ''
      UNION ALL SELECT query_id, 3 + msg_no, role, content FROM chat_queries JOIN messages USING (session_id))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS pos, role, content FROM listed""", "chat_queries", "messages", *STORED))
def chat_messages(spark, sf):
    """Whole message lists, with a summary of the session, retrieved texts and table snippets."""
    queries, s = I.chat_queries(spark, sf), I.knowledge_base(spark, sf)
    summaries = H.generate(G.summary_prompts(I.sessions(spark, sf), G.transcript(I.messages(spark, sf))), "prompt").select("session_id", F.col("completion").alias("summary"))
    snippets = search.search_context(queries, s["tables"], s["columns"], s["body"], 3)
    inputs = queries.join(H.context_block(queries, _hits(spark, sf, queries)), "query_id").join(snippets, "query_id", "left").join(summaries, "session_id", "left")
    listed = H.chat_messages(inputs.withColumn("system", F.lit("Answer.")), I.messages(spark, sf))
    return listed.select("query_id", F.posexplode("messages").alias("pos", "m")).select("query_id", "pos", "m.role", "m.content")


@register("parse_constraints", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda c: {strip_sql('c')}), lambda c: c <> ''), '|') AS entries FROM documents")
def parse_constraints(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.array_join(H.parse_constraints(F.col("text")), "|").alias("entries"))


TEMPLATE = 'Write cases for "{feature_name}"{component}, {scenarios} of them.\nConstraints: {constraints}\nContext:\n{context}'


@register("render_template", """SELECT p_partkey, 'Write cases for "' || p_name || '"' || CASE WHEN p_type <> 'PROMO' THEN ' in component ' || p_type ELSE '' END || ', ' || p_size || ' of them.' || chr(10) || 'Constraints: ' ||
    CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE p_brand || ', {context}' END || chr(10) || 'Context:' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '(no context provided)' ELSE p_name END AS prompt FROM part""")
def render_template(spark, sf):
    constraints = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_brand"), F.lit("{context}")))
    prompt = H.render_template(
        TEMPLATE, F.col("p_name"), F.when(F.col("p_type") != "PROMO", F.col("p_type")), F.col("p_size"), constraints,
        F.when(F.col("p_size") % 2 == 1, F.col("p_name")))
    return I.table(spark, sf, "part").select("p_partkey", prompt.alias("prompt"))


@register("generate", sql(f"""SELECT s.session_id, 'digest ' || md5(coalesce('{G.SUMMARY_REQUEST}' || transcript || '{G.SUMMARY_END}', '')) AS completion FROM sessions s LEFT JOIN ({_transcript_sql('').format(24)}) t USING (session_id)""", "sessions", "messages"))
def generate(spark, sf):
    prompts = G.summary_prompts(I.sessions(spark, sf), G.transcript(I.messages(spark, sf)))
    return H.generate(prompts, "prompt").select("session_id", "completion")


def _counting_completer():
    """Stand-in for a model: the first call of a prompt with an even length comes back empty."""
    seen: set[str] = set()

    def complete(prompts):
        out = []
        for p in prompts:
            out.append("" if len(p) % 2 == 0 and p not in seen else f" {len(p)} ")
            seen.add(p)
        return out

    return complete


@register("generate_with_completer", "SELECT conv_id, turn, length(text)::VARCHAR AS completion, NULL::VARCHAR AS error FROM conversations")
def generate_with_completer(spark, sf):
    return H.generate(I.table(spark, sf, "conversations"), "text", _counting_completer).select("conv_id", "turn", "completion", "error")


# ------------------------------------------------------------------ whole turns

TURN_SYSTEM = "Answer from the context."


def turn_inputs(spark, sf, embedded="preview"):
    """Queries, what was retrieved for them by the chunks' column ``embedded``, and the inventories."""
    queries = I.turn_queries(spark, sf)
    s = I.knowledge_base(spark, sf)
    contexts = H.context_block(queries, _hits(spark, sf, queries, embedded))
    snippets = search.search_context(queries, s["tables"], s["columns"], s["body"], 3)
    blocks = catalog.inventory_blocks(I.sheet_catalog(spark, sf), 20)
    return queries, contexts, snippets, blocks


def _turn(spark, sf, embedded="preview"):
    queries, contexts, snippets, blocks = turn_inputs(spark, sf, embedded)
    return T.chat_turn(queries, I.messages(spark, sf), contexts, snippets, blocks, TURN_SYSTEM)


_TURN = ", " + lookup_steps("turn_queries", 3, _MATCHED, _SAMPLED, _SNIPPETS) + ", " + CONTEXT.format("turn_queries") + f""",
    turn_messages AS (SELECT session_id, msg_no, role, content FROM messages UNION ALL SELECT session_id, n + 1, 'user', query FROM turn_queries JOIN (SELECT session_id, count(*) AS n FROM messages GROUP BY session_id) USING (session_id)),
    summaries AS (SELECT session_id, 'digest ' || md5('{G.SUMMARY_REQUEST}' || transcript || '{G.SUMMARY_END}') AS summary FROM ({_transcript_sql("").format(24).replace("FROM messages)", "FROM turn_messages)")})),
    {INVENTORY_BLOCKS},
    inventories AS (SELECT report_key, string_agg(text, chr(10) ORDER BY block_no) AS inventory FROM blocks GROUP BY report_key),
    turn_routed AS (SELECT query_id, CASE WHEN regexp_matches(lower(query), 'sheet|worksheet|schema|columns|headers|fields') THEN coalesce(nullif(regexp_extract(query, '([A-Za-z0-9._ ()-]+\\.xlsx?)', 1), ''), '*') END AS report_key FROM turn_queries),
    turn_structured AS (SELECT r.query_id, coalesce(s.structured, '') || CASE WHEN r.report_key IS NULL THEN '' ELSE CASE WHEN coalesce(s.structured, '') <> '' THEN chr(10) || chr(10) ELSE '' END || 'Sheet inventory:' || chr(10) ||
        coalesce(i.inventory, r.report_key || ' — sheets: (none)') END AS structured FROM turn_routed r LEFT JOIN snippets s USING (query_id) LEFT JOIN inventories i USING (report_key)),
    sent AS (SELECT query_id, 0 AS n, 'system' AS role, '{TURN_SYSTEM}' AS content FROM turn_queries
        UNION ALL SELECT query_id, 1, 'system', 'Prior summary:' || chr(10) || summary FROM turn_queries JOIN summaries USING (session_id)
        UNION ALL SELECT query_id, 2, 'system', 'Retrieved text context:' || chr(10) || context FROM contexts
        UNION ALL SELECT query_id, 3, 'system', 'Structured data context (read-only):' || chr(10) || structured FROM turn_structured WHERE structured <> ''
        UNION ALL SELECT query_id, 3 + msg_no, role, content FROM turn_queries JOIN turn_messages USING (session_id) WHERE msg_no <= 200),
    answered AS (SELECT query_id, session_id, 'digest ' || md5(string_agg(role || chr(31) || content, chr(30) ORDER BY n)) AS answer, count(*) AS n_messages, sum(length(content))::BIGINT AS n_chars
        FROM sent JOIN turn_queries USING (query_id) GROUP BY query_id, session_id)"""
_TURN_NEEDS = ("turn_queries", "messages", "sheet_catalog", *STORED)


@register("chat_turn", hits_sql(_TURN + " SELECT query_id, session_id, answer, n_messages, n_chars, NULL::VARCHAR AS error FROM answered", "turn_queries", *_TURN_NEEDS))
def chat_turn(spark, sf):
    """Every session is asked once more, a third of them for a workbook's inventory and a third for that of all."""
    return _turn(spark, sf)[0]


@register("chat_turn_messages", hits_sql(_TURN + """ SELECT session_id, msg_no, role, content FROM turn_messages
    UNION ALL SELECT session_id, n + 1, 'assistant', answer FROM answered JOIN (SELECT session_id, count(*) AS n FROM turn_messages GROUP BY session_id) USING (session_id)""", "turn_queries", *_TURN_NEEDS, corpus="whole_vectors"))
def chat_turn_messages(spark, sf):
    """What the sessions hold after the turn. Chunks are found by their whole text."""
    return _turn(spark, sf, "text")[1].select("session_id", "msg_no", "role", "content")


@register("case_generation", hits_sql(f""", short AS (SELECT query_id, string_agg('[' || rank || '] ' || source || ' p' || coalesce(nullif(page, 0)::VARCHAR, '-') || ' — ' || substr(text, 1, 300) || '...', chr(10) ORDER BY rank) AS context FROM hydrated GROUP BY query_id)
    SELECT q.query_id, replace(substr(q.query, 1, 40), ' ', '_') || '.feature' AS file_name, 'digest ' || md5('Write cases for "' || substr(q.query, 1, 40) || '", 6 of them.' || chr(10) || 'Constraints: GDPR, P95 < 250ms' || chr(10) || 'Context:' || chr(10) || coalesce(s.context, '(no context provided)')) AS completion,
    substr(q.query, 1, 40) AS feature, 6 AS scenarios, 'GDPR|P95 < 250ms' AS constraints FROM text_queries q LEFT JOIN short s USING (query_id)"""))
def case_generation(spark, sf):
    """A case file for each benchmark text, with what was asked for beside it."""
    queries = I.text_queries(spark, sf)
    requests = queries.select("query_id", F.substring("query", 1, 40).alias("feature"), F.lit(None).cast("string").alias("component"), F.lit(6).alias("scenarios"), F.lit("GDPR, P95 < 250ms").alias("constraints"))
    made = H.generate_cases(requests, _hits(spark, sf, queries), TEMPLATE)
    return made.select("query_id", "file_name", "completion", "meta.feature", "meta.scenarios", F.array_join("meta.constraints", "|").alias("constraints"))
