"""FLT, J, AGG, TOP, WIN and DOM on chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import chat as H
from docspark.operators import registry as R
from docspark.plans import tables as B
from docspark.plans.register import query

FIRST_WORD = "regexp_extract(content, '^[^ ]+')"


def first_word(c):
    """Questions here are all different; their first words are not."""
    return F.regexp_extract(c, "^[^ ]+", 0)


def chat(body: str, *more: str) -> str:
    return B.sql(body, B.MESSAGES, *more)


@query("flt15_title_search", chat("SELECT session_id, title FROM sessions WHERE contains(lower(title), lower('TH'))", B.SESSIONS))
def title_search(spark, sf):
    return B.sessions(spark, sf).filter(F.contains(F.lower("title"), F.lower(F.lit("TH")))).select("session_id", "title")


@query("flt16_valid_messages", chat("SELECT session_id, turn, role <> 'system' AND content <> '' AS valid FROM messages"))
def valid_messages(spark, sf):
    m = B.messages(spark, sf).withColumn("content", F.when(F.col("role") == "system", "").otherwise(F.col("content")))
    yes, no = H.valid_messages(m)
    return yes.select("session_id", "turn", F.lit(True).alias("valid")).unionByName(no.select("session_id", "turn", F.lit(False).alias("valid")))


@query("prj4_display", chat("SELECT session_id, turn, role = 'user' AS is_user, turn % 2 = 1 AS has_references FROM messages"))
def display(spark, sf):
    sources = F.when(F.col("turn") % 2 == 1, F.array(F.col("content"))).otherwise(F.array().cast("array<string>"))
    return H.display(B.messages(spark, sf).withColumn("sources", sources)).select("session_id", "turn", "is_user", "has_references")


@query("j2_session_counts", chat("SELECT session_id, (SELECT count(*) FROM messages m WHERE m.session_id = s.session_id AND role = 'assistant') AS n_messages FROM sessions s", B.SESSIONS))
def session_counts(spark, sf):
    return H.with_counts(B.sessions(spark, sf), B.messages(spark, sf).filter("role = 'assistant'")).select("session_id", "n_messages")


@query("j9_orphans", chat("SELECT session_id, turn, session_id % 5 <> 0 AS known FROM messages"))
def orphans(spark, sf):
    yes, no = H.split_by_session(B.messages(spark, sf), B.sessions(spark, sf).filter("session_id % 5 <> 0"))
    return yes.select("session_id", "turn", F.lit(True).alias("known")).unionByName(no.select("session_id", "turn", F.lit(False).alias("known")))


@query("j11_delete_sessions", chat("SELECT 'sessions' AS name, count(*) AS n FROM sessions WHERE user_id <> 2 UNION ALL SELECT 'messages', count(*) FROM messages WHERE user_id <> 2", B.SESSIONS))
def delete_sessions(spark, sf):
    s, m = B.sessions(spark, sf), B.messages(spark, sf)
    gone = s.filter("user_id = 2").select("session_id")
    left = R.without(s, gone, "session_id", "session_id").agg(F.count("*").alias("n")).select(F.lit("sessions").alias("name"), "n")
    return left.unionByName(R.without(m, gone, "session_id", "session_id").agg(F.count("*").alias("n")).select(F.lit("messages").alias("name"), "n"))


@query(
    "j13_answer_reuse",
    chat(
        """SELECT q.session_id, q.turn, a.answer AS cached FROM (SELECT *, """ + FIRST_WORD + """ AS question, 'u' || user_id AS scope FROM messages WHERE role = 'user') q
        LEFT JOIN (SELECT """ + FIRST_WORD + """ AS question, 'u' || user_id AS scope, max_by(content, {'a': created_at, 'b': content}) AS answer FROM messages
                   WHERE role = 'user' AND created_at + INTERVAL 24 HOUR > TIMESTAMP '2024-01-03 12:00:00' GROUP BY ALL) a USING (scope, question)""",
    ),
)
def answer_reuse(spark, sf):
    asked = B.messages(spark, sf).filter("role = 'user'").withColumns({"question": first_word(F.col("content")), "scope": F.concat(F.lit("u"), F.col("user_id"))})
    answers = asked.select("scope", "question", F.col("content").alias("answer"), "created_at")
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    return H.reuse_answers(asked, answers, now).select("session_id", "turn", "cached")


@query("agg8_chat_stats", chat("SELECT count(*) AS n_sessions, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_activity FROM sessions", B.SESSIONS))
def chat_stats(spark, sf):
    return B.sessions(spark, sf).agg(F.count("*").alias("n_sessions"), F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@query(
    "agg9_message_estimate",
    chat(
        """SELECT (SELECT count(*) FROM sessions) AS n_sessions, CAST(floor(avg(n) * (SELECT count(*) FROM sessions) + 0.5) AS BIGINT) AS estimated_messages, (SELECT count(*) FROM messages) AS exact_messages
        FROM (SELECT s.session_id, count(*) AS n FROM (SELECT * FROM sessions ORDER BY updated_at DESC, session_id LIMIT 10) s JOIN messages USING (session_id) GROUP BY 1)""",
        B.SESSIONS,
    ),
)
def message_estimate(spark, sf):
    return H.message_estimate(B.sessions(spark, sf), B.messages(spark, sf))


@query("agg10_top_questions", chat(f"SELECT {FIRST_WORD} AS question, count(*) AS n FROM messages WHERE role = 'user' AND {FIRST_WORD} <> '' GROUP BY 1 ORDER BY n DESC, question LIMIT 10"))
def top_questions(spark, sf):
    return H.top_questions(B.messages(spark, sf), 10, first_word)


@query("top4_session_page", chat("SELECT session_id, title FROM sessions ORDER BY updated_at DESC, session_id OFFSET 20 LIMIT 20", B.SESSIONS))
def session_page(spark, sf):
    return R.page(B.sessions(spark, sf), "updated_at", 2, 20, "session_id").select("session_id", "title")


@query("top5_message_page", chat("SELECT session_id, turn, content FROM messages WHERE session_id = (SELECT max(conv_id) FROM conversations) ORDER BY created_at, turn LIMIT 10"))
def message_page(spark, sf):
    m = B.messages(spark, sf)
    last = m.agg(F.max("session_id")).first()[0]
    return R.page(m.filter(F.col("session_id") == last), "created_at", 1, 10, "turn", descending=False).select("session_id", "turn", "content")


@query("top6_recent_messages", chat("SELECT session_id, turn FROM messages ORDER BY created_at DESC, session_id DESC, turn DESC LIMIT 25"))
def recent_messages(spark, sf):
    return H.recent(B.messages(spark, sf), 25).select("session_id", "turn")


RECENT = f"r AS (SELECT {FIRST_WORD} AS question, role, created_at FROM (SELECT * FROM messages ORDER BY created_at DESC, session_id DESC, turn DESC LIMIT 40))"


@query("top7_recent_questions", chat("SELECT question, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS asked_at FROM r WHERE role = 'user' AND question <> '' GROUP BY question ORDER BY max(created_at) DESC, question LIMIT 20", RECENT))
def recent_questions(spark, sf):
    found = H.recent_questions(B.messages(spark, sf), 20, first_word)
    return found.select("question", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("asked_at"))


@query("win3_first_of_each", chat(f"SELECT k AS key, m.s AS session_id, m.t AS turn FROM (SELECT {FIRST_WORD} AS k, max({{'a': created_at, 's': session_id, 't': turn}}) AS m FROM messages WHERE role = 'user' GROUP BY 1)"))
def first_of_each(spark, sf):
    return H.first_of_each(B.messages(spark, sf).filter("role = 'user'"), first_word(F.col("content")))


@query(
    "win6_question_answer_pairs",
    chat("SELECT session_id, turn, question, answer FROM (SELECT session_id, turn, role, content AS question, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(content) OVER w END AS answer FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn, role, content)) WHERE role = 'user'"),
)
def question_answer_pairs(spark, sf):
    return H.pairs(B.messages(spark, sf))


@query("dom7_transcript", chat("SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn, role, content) AS transcript, count(*) AS n FROM messages GROUP BY session_id"))
def transcript(spark, sf):
    return H.transcript(B.messages(spark, sf))


@query("dom8_rename_session", chat("SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'Renamed ' || session_id ELSE title END AS title FROM sessions", B.SESSIONS))
def rename(spark, sf):
    s = B.sessions(spark, sf).select("session_id", "title")
    changes = s.filter("session_id % 3 = 0").select("session_id", F.concat(F.lit("Renamed "), F.col("session_id")).alias("title"))
    return R.update(s, changes, "session_id")


@query("dom10_touch_session", chat("SELECT session_id, strftime(CASE WHEN session_id % 2 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM sessions", B.SESSIONS))
def touch(spark, sf):
    late = F.col("created_at") + F.make_dt_interval(F.lit(1))
    m = B.messages(spark, sf).filter("session_id % 2 = 0").withColumn("created_at", late)
    return H.touch(B.sessions(spark, sf), m).select("session_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(
    "dom11_append_turns",
    chat(
        f"""SELECT session_id, turn * 2 AS turn, 'user' AS role, content FROM messages WHERE role = 'user' UNION ALL
        SELECT session_id, turn * 2 + 1, 'assistant', CASE WHEN turn % 3 = 0 THEN '{H.APOLOGY}' || 'timeout' ELSE 'Re: ' || content END FROM messages WHERE role = 'user'"""
    ),
)
def append_turns(spark, sf):
    asked = B.messages(spark, sf).filter("role = 'user'")
    answers = asked.select("session_id", "turn", F.col("content").alias("question"), F.concat(F.lit("Re: "), F.col("content")).alias("answer"), F.when(F.col("turn") % 3 == 0, "timeout").alias("error"))
    return H.append_turns(answers)


@query("jsn2_sources", "SELECT conv_id, turn, 'f' || (turn % 3) AS file_id, CAST(turn AS INTEGER) AS position, substr(text, 1, 20) AS text FROM conversations")
def sources(spark, sf):
    m = B.read(spark, sf, "conversations")
    one = F.struct(F.concat(F.lit("f"), F.col("turn") % 3).alias("file_id"), F.lit("n").alias("file_name"), F.col("turn").cast("int").alias("position"), F.substring("text", 1, 20).alias("text"), F.lit(0.5).alias("score"))
    stored = m.select("conv_id", "turn", H.serialise_sources(F.array(one)).alias("json"))
    back = stored.select("conv_id", "turn", F.explode_outer(H.read_sources(F.col("json"))).alias("s"))
    return back.select("conv_id", "turn", "s.file_id", "s.position", "s.text")
