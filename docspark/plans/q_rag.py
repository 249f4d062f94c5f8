"""DOM-2 to DOM-4 and the prompt functions: retrieval for a table of questions, routes, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import rag as G
from docspark.operators import search as S
from docspark.plans import tables as B
from docspark.plans.register import query
from docspark.plans.q_vector import RANKED, SCORED, questions

HITS = f"{SCORED}, ranked AS ({RANKED} WHERE score >= -1), hits AS (SELECT r.*, c.text, c.file_id, c.position FROM ranked r JOIN chunks c USING (id) WHERE rank <= 8)"


def hits(spark, sf):
    """The best eight chunks of each question, with their texts."""
    c = B.chunks(spark, sf)
    found = S.top_k(c, questions(spark, sf), k=8, min_score=-1.0)
    return found.join(c.select("id", "text", "file_id", "position"), "id")


def asked(spark, sf):
    return questions(spark, sf).select(F.col("id").alias("question_id"), F.concat(F.lit("What about "), F.col("id"), F.lit("?")).alias("question"))


@query("txt17_numbered_context", f"WITH {HITS} SELECT question_id, string_agg('【' || rank || '】' || text || chr(10) || chr(10), '' ORDER BY rank) AS context FROM hits GROUP BY question_id")
def numbered_context(spark, sf):
    return G.numbered_context(hits(spark, sf))


KEPT = "kept AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS source FROM (SELECT *, row_number() OVER (PARTITION BY question_id, text ORDER BY rank) AS n FROM hits) WHERE n = 1 AND score >= 0.3)"
CONTEXT = f"""{HITS}, {KEPT}, ctx AS (
  SELECT q.question_id, CASE WHEN NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = q.question_id) THEN '{G.NO_CONTEXT}' ELSE coalesce((SELECT string_agg('[SOURCE_' || source || '] ' || text, chr(10) || chr(10) ORDER BY source) FROM kept k WHERE k.question_id = q.question_id), '') END AS context
  FROM questions q)"""


def made_contexts(spark, sf):
    return G.contexts(asked(spark, sf), hits(spark, sf), 0.3, sources=True)


@query("txt18_set3_win4_context", f"WITH {CONTEXT} SELECT question_id, context FROM ctx")
def contexts(spark, sf):
    return made_contexts(spark, sf)


@query("set3_distinct_context", f"WITH {HITS} SELECT question_id, text, CAST(min(rank) AS INTEGER) AS rank FROM hits GROUP BY question_id, text")
def distinct_context(spark, sf):
    return G.context_rows(hits(spark, sf), 0).select("question_id", "text", "rank")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FILLED = f"replace(replace({sql_text(G.DEFAULT_TEMPLATE)}, '{{question}}', 'What about ' || question_id || '?'), '{{context}}', context)"


@query(
    "txt19_txt20_dom4_prompts",
    f"WITH {CONTEXT} SELECT question_id, prompt, CAST(trunc(len(regexp_split_to_array(trim(prompt, ' ' || chr(10)), '[ \\n]+')) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS prompt_tokens FROM (SELECT question_id, {FILLED} AS prompt FROM ctx)",
)
def prompts(spark, sf):
    return G.prompts(asked(spark, sf), made_contexts(spark, sf)).select("question_id", "prompt", "prompt_tokens")


@query("txt21_wrapped_prompt", f"WITH {CONTEXT} SELECT question_id, 'Context information is below.' || chr(10) || repeat('-', 21) || chr(10) || context || chr(10) || repeat('-', 21) || chr(10) || 'Given the context information and not prior knowledge, answer the question: ' || 'What about ' || question_id || '?' AS prompt FROM ctx")
def wrapped(spark, sf):
    both = asked(spark, sf).join(made_contexts(spark, sf), "question_id")
    return both.select("question_id", G.wrap_prompt(F.col("question"), F.col("context")).alias("prompt"))


@query("prj5_top9_sources", f"WITH {HITS} SELECT question_id, CAST(rank AS INTEGER) AS rank, file_id, position, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, round(score, 2) AS score FROM hits WHERE rank <= 3")
def sources(spark, sf):
    return G.sources(hits(spark, sf), 3).select("question_id", F.explode("sources").alias("s")).select("question_id", "s.*")


@query("j14_known_files", B.sql("SELECT session_id, turn FROM messages WHERE 'file' || (session_id % 13) IN (SELECT file_id FROM chunks)", B.MESSAGES, B.CHUNKS))
def known_files(spark, sf):
    m = B.messages(spark, sf).withColumn("file_id", F.concat(F.lit("file"), F.col("session_id") % 13))
    return m.join(B.chunks(spark, sf).select("file_id").distinct(), "file_id", "left_semi").select("session_id", "turn")


@query(
    "dom2_retrieve_scoped",
    f"""WITH {SCORED}, r AS (SELECT question_id, id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored
        WHERE score >= 0 AND (question_id % 100 <> 0 OR q_file = c_file) AND id % 2 = 0) SELECT * FROM r WHERE rank <= 5""",
)
def retrieve(spark, sf):
    """Every second question in its own file, all under the metadata parity = even."""
    c = S.filter_chunks(B.chunks(spark, sf), metadata={"parity": "even"})
    q = questions(spark, sf).withColumn("file_id", F.when(F.col("id") % 100 == 0, F.col("file_id")))
    return S.top_k(c, q, chunk_scope="file_id", question_scope="file_id")


ROUTES = """routed AS (
  SELECT m.session_id, m.turn, CASE WHEN list_contains(['hi'], lower(q)) THEN 'greeting' WHEN m.turn % 5 = 1 THEN 'cached' WHEN m.turn % 3 = 0 AND m.session_id % 13 >= 10 THEN 'file_not_found'
    WHEN m.session_id % 4 > 0 THEN 'rag' WHEN m.turn % 3 = 0 THEN 'not_in_file' WHEN m.turn % 2 = 0 THEN 'not_under_metadata' ELSE 'general' END AS route, q
  FROM (SELECT *, CASE WHEN session_id % 10 = 0 THEN 'Hi' ELSE 'topic ' || turn END AS q FROM messages WHERE role = 'user') m)"""


def routed(spark, sf):
    m = B.messages(spark, sf).filter("role = 'user'")
    q = F.when(F.col("session_id") % 10 == 0, "Hi").otherwise(F.concat(F.lit("topic "), F.col("turn")))
    way = G.route(q, F.when(F.col("turn") % 5 == 1, "an answer"), F.col("turn") % 3 == 0, F.col("session_id") % 13 < 10, F.col("turn") % 2 == 0, F.col("session_id") % 4)
    return m.select("session_id", "turn", q.alias("question"), way.alias("route"))


@query("dom3_routes", B.sql("SELECT session_id, turn, route FROM routed", B.MESSAGES, ROUTES))
def routes(spark, sf):
    return routed(spark, sf).select("session_id", "turn", "route")


def prompt_case() -> str:
    fill = lambda s: f"replace({sql_text(s)}, '{{question}}', q)"
    return (
        f"CASE route WHEN 'greeting' THEN {fill(G.GREETING_PROMPT)} WHEN 'general' THEN {fill(G.GENERAL_PROMPT)} WHEN 'not_in_file' THEN {fill(G.NOT_IN_FILE)} "
        f"WHEN 'not_under_metadata' THEN {fill(G.NOT_UNDER_METADATA)} WHEN 'file_not_found' THEN {sql_text(G.NO_FILE)} WHEN 'rag' THEN 'with context: ' || q END"
    )


@query("txt25_route_prompts", B.sql(f"SELECT session_id, turn, {prompt_case()} AS prompt FROM routed", B.MESSAGES, ROUTES))
def route_prompts(spark, sf):
    r = routed(spark, sf)
    return r.select("session_id", "turn", G.route_prompt(F.col("route"), F.col("question"), F.concat(F.lit("with context: "), F.col("question"))).alias("prompt"))


@query("txt5_prompt_budget", f"WITH {CONTEXT} SELECT question_id, length(context) AS raw_length, greatest(len(list_filter(regexp_split_to_array(context, '{X.WS}+'), lambda x: x <> '')), length(context) // 4) AS n_tokens FROM ctx")
def prompt_budget(spark, sf):
    return made_contexts(spark, sf).select("question_id", X.raw_length("context").alias("raw_length"), X.estimate_tokens("context").alias("n_tokens"))
