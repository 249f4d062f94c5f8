"""Chat sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X

SOURCE = "array<struct<file_id:string,file_name:string,position:int,text:string,score:double>>"
APOLOGY = "Sorry, your question could not be answered. "


def valid_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that have a session and content, and the others."""
    ok = F.col("session_id").isNotNull() & (F.coalesce(F.col("content"), F.lit("")) != "")
    return df.filter(ok), df.filter(~ok)


def with_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    n = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    return sessions.join(n, "session_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def split_by_session(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages whose session exists, and the orphans."""
    known = sessions.select("session_id")
    return messages.join(known, "session_id", "left_semi"), messages.join(known, "session_id", "left_anti")


def display(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"is_user": F.col("role") == "user", "has_references": F.coalesce(F.size("sources"), F.lit(0)) > 0})


def serialise_sources(sources: Column) -> Column:
    return F.to_json(sources)


def read_sources(json: Column) -> Column:
    return F.from_json(json, SOURCE)


def recent(messages: DataFrame, n: int) -> DataFrame:
    return messages.orderBy(F.col("created_at").desc(), F.col("session_id").desc(), F.col("turn").desc()).limit(n)


def first_of_each(messages: DataFrame, key: Column) -> DataFrame:
    """(key, session_id, turn): the newest message of each key."""
    newest = F.max(F.struct("created_at", "session_id", "turn"))
    return messages.groupBy(key.alias("key")).agg(newest.alias("m")).select("key", "m.session_id", "m.turn")


def recent_questions(messages: DataFrame, n: int, key=X.strip) -> DataFrame:
    """Distinct questions among the newest 2n messages, newest first; may be fewer than n."""
    asked = recent(messages, 2 * n).filter("role = 'user'").withColumn("question", key(F.col("content"))).filter("question <> ''")
    newest = asked.groupBy("question").agg(F.max(F.struct("created_at", "session_id", "turn")).alias("at"))
    return newest.orderBy(F.col("at").desc(), "question").limit(n).select("question", F.col("at.created_at").alias("created_at"))


def top_questions(messages: DataFrame, n: int, key=X.strip) -> DataFrame:
    asked = messages.filter("role = 'user'").withColumn("question", key(F.col("content"))).filter("question <> ''")
    return asked.groupBy("question").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "question").limit(n)


def message_estimate(sessions: DataFrame, messages: DataFrame, sample: int = 10) -> DataFrame:
    """The message count guessed from the newest sessions, and the exact one."""
    newest = sessions.orderBy(F.col("updated_at").desc(), F.col("session_id").asc()).limit(sample)
    mean = with_counts(newest, messages).agg(F.coalesce(F.avg("n_messages"), F.lit(0.0)).alias("mean"))
    total = sessions.agg(F.count("*").alias("n_sessions"))
    exact = messages.agg(F.count("*").alias("exact_messages"))
    return mean.join(total).join(exact).select("n_sessions", F.floor(F.col("mean") * F.col("n_sessions") + 0.5).alias("estimated_messages"), "exact_messages")


def pairs(messages: DataFrame) -> DataFrame:
    """Each question with the answer that follows it in its session, if one does."""
    w = Window.partitionBy("session_id").orderBy("turn", "role", "content")
    both = messages.withColumns({"next_role": F.lead("role").over(w), "next_content": F.lead("content").over(w)})
    return both.filter("role = 'user'").select("session_id", "turn", F.col("content").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_content")).alias("answer"))


def transcript(messages: DataFrame) -> DataFrame:
    """One row for each session: its messages in order."""
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("transcript"), F.count("*").alias("n"))


def touch(sessions: DataFrame, new_messages: DataFrame) -> DataFrame:
    """Sessions whose time of change is not before their newest message."""
    last = new_messages.groupBy("session_id").agg(F.max("created_at").alias("last"))
    return sessions.join(last, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "last")).drop("last")


def append_turns(answers: DataFrame) -> DataFrame:
    """(session_id, turn, question, answer, error) as two messages each: the question, then the answer or an apology with the error."""
    said = F.when(F.col("error").isNull(), F.col("answer")).otherwise(F.concat(F.lit(APOLOGY), F.col("error")))
    both = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), said.alias("content")))
    return answers.select("session_id", "turn", F.explode(both).alias("m")).select("session_id", (F.col("turn") * 2 + F.col("m.part")).alias("turn"), "m.role", "m.content")


def reuse_answers(questions: DataFrame, answers: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Questions with the newest answer to the same question in the same scope that has not expired, if any."""
    live = answers.filter(F.col("created_at") + F.make_dt_interval(hours=F.lit(hours)) > now)
    newest = live.groupBy("scope", "question").agg(F.max_by("answer", F.struct("created_at", "answer")).alias("cached"))
    return questions.join(newest, ["scope", "question"], "left")
