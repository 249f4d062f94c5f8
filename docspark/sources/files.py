"""Files and tables in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as X

#: The character references that texts have mostly; others are numbers.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, size, mime, path, modified_at) of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(X.file_stem(name).alias("id"), name.alias("name"), F.col("length").alias("size"), X.mime_type(name).alias("mime"), "path", F.col("modificationTime").alias("modified_at"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def html_to_text(html: Column) -> Column:
    """The text between tags, blocks separated by blank lines; scripts, styles and comments are left out."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, said in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(said))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n\n")


def markdown_to_text(markdown: Column) -> Column:
    """Without heading marks, emphasis, link targets and fences."""
    t = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"(?m)^\s{0,3}(#{1,6}\s+|>\s?|```.*$)", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return X.strip(F.regexp_replace(t, r"(\*\*|__|`)", ""))


#: A function from the content to its text for each file type.
PARSERS: dict[str, Callable[[Column], Column]] = {"txt": X._text, "md": markdown_to_text, "markdown": markdown_to_text, "html": html_to_text, "htm": html_to_text}


def parse(df: DataFrame, name: str = "file_name", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows with their text by the parser of their file type; and rows of types without one."""
    kind = F.substring(X.file_extension(F.col(name)), 2, 20)
    said = F.lit(None).cast("string")
    for ext, parser in PARSERS.items():
        said = F.when(kind == ext, parser(F.col(content))).otherwise(said)
    return df.filter(kind.isin(*PARSERS)).withColumn("text", said), df.filter(~kind.isin(*PARSERS))


def merge_sections(df: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """(key, text, page_count): the sections of each document in order, joined by blank lines."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.groupBy(key).agg(F.array_join(ordered, "\n\n").alias(text), F.count("*").alias("page_count"))


def write_by_date(df: DataFrame, path: str, time: str, file_rows: int = 5_000_000) -> None:
    """Partitioned by year, month and day, so that readers skip days that they don't want.

    Days of more than `file_rows` rows are divided among several tasks by a hash
    of their rows; rows without a time are a partition of their own.
    """
    day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(""))
    large = df.groupBy(day.alias("_day")).agg(F.ceil(F.count("*") / file_rows).alias("_files")).filter("_files > 1")
    dated = df.withColumns({"year": F.date_format(time, "yyyy"), "month": F.date_format(time, "MM"), "day": F.date_format(time, "dd"), "_day": day}).join(large, "_day", "left")
    row = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    file = F.pmod(F.xxhash64(*row), F.coalesce("_files", F.lit(1)))
    # A stated number of tasks, as Spark would otherwise join small ones and write thousands of days in a few.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated.repartition(tasks, "year", "month", "day", file).drop("_day", "_files").write.mode("overwrite").partitionBy("year", "month", "day").parquet(path)


def storage_path(id_column: Column, name: Column, time: Column) -> Column:
    return F.concat(F.date_format(time, "yyyy/MM/dd/"), id_column, X.file_extension(name))


def write_chunks(chunks: DataFrame, path: str, buckets: int = 16) -> None:
    """The vector table, partitioned by a hash of the file's id."""
    chunks.withColumn("file_bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("file_bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("file_bucket")


def append(df: DataFrame, path: str) -> None:
    """All rows by one write; tasks, not the caller, divide it."""
    df.write.mode("append").parquet(path)


def ingest(df: DataFrame, path: str, kind: str = "sentence", size: int = 1000, overlap: int = 200, model: str | None = None) -> None:
    """Documents (doc_id, file_name, content) to chunks with vectors, segments and the registry below `path`."""
    from docspark.functions import chunks as C
    from docspark.operators.embed import embed

    parsed, rejected = parse(df)
    clean = parsed.select("doc_id", "file_name", X.clean_text("text").alias("text"))
    cut = C.chunk(clean.select("doc_id", "text"), kind, size, overlap)
    vectors, _ = embed(cut, "text", model)
    vectors.withColumns({"id": C.chunk_id(F.col("doc_id"), F.col("index")), "file_id": F.col("doc_id").cast("string")}).write.mode("overwrite").parquet(f"{path}/chunks")
    stored = df.sparkSession.read.parquet(f"{path}/chunks")
    stored.select(F.col("file_id").alias("document_id"), F.col("id").alias("segment_id"), F.col("index").alias("position"), "text").write.mode("overwrite").parquet(f"{path}/segments")
    counts = stored.groupBy("doc_id").agg(F.count("*").alias("segment_count"))
    done = clean.join(counts, "doc_id", "left").select("doc_id", "file_name", F.lit("completed").alias("status"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"))
    failed = rejected.select("doc_id", "file_name", F.lit("failed").alias("status"), F.lit(0).cast("bigint").alias("segment_count"))
    done.unionByName(failed).write.mode("overwrite").parquet(f"{path}/registry")
