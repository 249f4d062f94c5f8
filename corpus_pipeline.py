"""From raw documents to token ids: five stages, each over all that its predecessor kept.

The stages filter or change documents; all but the last return the columns of
the table documents.  Each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, langid, minhash, pieces, substrings
from docspark.llm.frames import set_aside, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and texts that resemble no language learned from the labelled rows.

    Documents are not dropped for a label that differs from the prediction.
    Where no row has a label there is nothing to judge by: all texts with a
    letter stay.  Repeated rows are judged each, very long texts as a whole; all
    columns are kept, also those named as the prediction's; an empty table stays empty.
    """
    columns = docs.columns
    model = langid.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*columns)
    # Names of the prediction that the table happens to have are set aside meanwhile.
    made = ("lang_pred", "score", "resembles")
    held, back = set_aside(docs, made)
    kept = langid.predict(held, model).filter("resembles").drop(*made).withColumnsRenamed(back)
    return kept.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the least id.

    Null and empty texts are copies of each other; of repeated rows one stays; of
    null ids all others come first.  All columns are kept, whatever their names.
    """
    return minhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word of a 35-word window that occurs twice; a document of which nothing is left goes.

    n_chars, where the table has it, is counted again.  Null and empty
    texts have no words and go; repeated rows are
    repeats of each other.
    """
    columns = docs.columns
    cut = substrings.remove_repeats(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words lies in 13-word windows of the benchmark.

    Null and empty texts stay, as does everything if the benchmark is empty;
    repeated rows are judged each; all columns are kept, whatever their names.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, decoded_sha256, round_trip): the ids of each text, checked by decoding.

    A null or empty text has no ids; repeated rows are encoded each; other columns
    end here.
    """
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has no language model, no weighted sampling and no best segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
