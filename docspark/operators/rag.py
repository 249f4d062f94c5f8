"""Prompts for a table of questions: contexts, templates, sources, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.functions import vector as V

#: Fixed value: what stands for a context without hits.
NO_CONTEXT = "No relevant context information found."
DEFAULT_TEMPLATE = "Answer from the context alone; say so if it does not suffice.\n\nContext:\n{context}\n\nQuestion: {question}\n"
REASONING_TEMPLATE = "Think step by step, then answer from the context alone; say so if it does not suffice.\n\nContext:\n{context}\n\nQuestion: {question}\n"
CITATION_TEMPLATE = "Answer from the context alone and name the source of each sentence as [SOURCE_n]; say so if it does not suffice.\n\nContext:\n{context}\n\nQuestion: {question}\n"
TEMPLATES = {"default": DEFAULT_TEMPLATE, "reasoning": REASONING_TEMPLATE, "citation": CITATION_TEMPLATE}
GREETING_PROMPT = "The user greets you: \"{question}\". Answer in a few friendly words."
GENERAL_PROMPT = "Answer from what you know in general: {question}"
NOT_IN_FILE = "The file has nothing on this question. Answer from what you know in general and say so: {question}"
NOT_UNDER_METADATA = "No document with these properties has anything on this question. Answer from what you know in general and say so: {question}"
NO_FILE = "Sorry, this file is not there."


def numbered_context(hits: DataFrame) -> DataFrame:
    """(question_id, context): each hit as `【n】text`, in order of rank."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("【"), x["rank"].cast("string"), F.lit("】"), x["text"], F.lit("\n\n"))), "").alias("context"))


def context_rows(hits: DataFrame, min_score: float = 0.6, dedupe: bool = True) -> DataFrame:
    """The hits that go into a context, with their source number: first of equal texts, by score, at least `min_score`."""
    rows = hits
    if dedupe:
        first = Window.partitionBy("question_id", "text").orderBy("rank")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = rows.filter(F.col("score") >= min_score) if min_score > 0 else rows
    number = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "rank")
    return rows.withColumn("source", F.row_number().over(number))


def contexts(questions: DataFrame, hits: DataFrame, min_score: float = 0.6, dedupe: bool = True, sources: bool = False) -> DataFrame:
    """(question_id, context): `- text`, or `[SOURCE_n] text`; a fixed sentence without hits, empty if all are filtered."""
    kept = context_rows(hits, min_score, dedupe)
    mark = F.concat(F.lit("[SOURCE_"), F.col("source").cast("string"), F.lit("] ")) if sources else F.lit("- ")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", F.concat(mark, F.col("text")).alias("said")))), lambda x: x["said"]), "\n\n")
    made = kept.groupBy("question_id").agg(said.alias("context"))
    asked = hits.groupBy("question_id").agg(F.count("*").alias("_hits"))
    both = questions.select("question_id").join(made, "question_id", "left").join(asked, "question_id", "left")
    return both.select("question_id", F.when(F.col("_hits").isNull(), NO_CONTEXT).otherwise(F.coalesce("context", F.lit(""))).alias("context"))


def prompts(questions: DataFrame, made: DataFrame, style: Column | str = "default") -> DataFrame:
    """(question_id, question, prompt, prompt_tokens): the template of each question's style, filled."""
    style = F.lit(style) if isinstance(style, str) else style
    template = F.lit(DEFAULT_TEMPLATE)
    for name, said in TEMPLATES.items():
        template = F.when(style == name, F.lit(said)).otherwise(template)
    both = questions.join(made, "question_id")
    prompt = X.fill_template(template, F.col("question"), F.col("context"))
    return both.select("question_id", "question", prompt.alias("prompt"), F.coalesce("context", F.lit("")).alias("context")).withColumn("prompt_tokens", (X.count_words("prompt") * 1.3).cast("int"))


def wrap_prompt(question: Column, context: Column) -> Column:
    """The question behind its context, in fixed sentences."""
    rule = "-" * 21
    return F.concat(F.lit(f"Context information is below.\n{rule}\n"), context, F.lit(f"\n{rule}\nGiven the context information and not prior knowledge, answer the question: "), question)


def route(question: Column, cached: Column, file_given: Column, file_known: Column, metadata_given: Column, hits: Column) -> Column:
    """How a question is answered."""
    return (
        F.when(X.is_greeting(question), "greeting")
        .when(cached.isNotNull(), "cached")
        .when(file_given & ~file_known, "file_not_found")
        .when(hits > 0, "rag")
        .when(file_given, "not_in_file")
        .when(metadata_given, "not_under_metadata")
        .otherwise("general")
    )


def route_prompt(route: Column, question: Column, rag_prompt: Column) -> Column:
    fill = lambda said: F.replace(F.lit(said), F.lit("{question}"), question)
    return (
        F.when(route == "greeting", fill(GREETING_PROMPT))
        .when(route == "general", fill(GENERAL_PROMPT))
        .when(route == "not_in_file", fill(NOT_IN_FILE))
        .when(route == "not_under_metadata", fill(NOT_UNDER_METADATA))
        .when(route == "file_not_found", NO_FILE)
        .when(route == "rag", rag_prompt)
    )


def sources(hits: DataFrame, k: int) -> DataFrame:
    """(question_id, sources): the first k hits as retrieved, with previews of their texts."""
    one = F.struct("rank", "file_id", "position", X.preview("text").alias("text"), V.rounded(F.col("score"), 2).alias("score"))
    return hits.filter(F.col("rank") <= k).groupBy("question_id").agg(F.sort_array(F.collect_list(one)).alias("sources"))
