"""Merging nested metadata: many JSON objects of a key, in order, become one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose results are handed back to Spark at once.
OUT_ROWS = 5_000


def _exact(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def merge_into(result: dict, later: dict) -> dict:
    """`result` with what a later object adds.

    A key that is missing or empty gets the later value.  Of two values that are
    there, lists become their union in order of first occurrence, objects merge key
    by key, and a text gives way to a later one that contains it; everything else
    stays as it is.
    """
    for key, value in later.items():
        now = result.get(key)
        if not now:
            if value or key not in result:
                result[key] = value
        elif not value:
            continue
        elif isinstance(now, list) and isinstance(value, list):
            if _exact(now) != _exact(value):
                result[key] = list({_exact(x): x for x in (*now, *value)}.values())
        elif isinstance(now, str) and isinstance(value, str):
            if now in value:
                result[key] = value
        elif isinstance(now, dict) and isinstance(value, dict):
            merge_into(now, value)
    return result


def _object(said: str | None) -> dict:
    try:
        found = json.loads(said) if said else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def merge_metadata(df: DataFrame, key: str, order: str, metadata: str) -> DataFrame:
    """(key, metadata as JSON): the metadata of each key's rows merged in ascending order.

    `metadata` is a column of JSON texts, or a map, struct or variant.  Rows are
    sorted, not gathered: a key's rows pass one after the other and only the merged
    object is held, however many there are (the order matters, so one key is one
    task's).

    Null rows, broken JSON and JSON that is no object add nothing; a key of which all
    rows are so has `{}`; a null key is a key; null orders come first, equal ones in
    the order of their texts; other columns end here.
    """
    kind = df.schema[metadata].dataType
    said = F.col(metadata) if isinstance(kind, T.StringType) else F.to_json(metadata)
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("place"), said.alias("said"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.col("place").asc_nulls_first(), "said").select("key", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, merged, now, state = [], [], None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array(keys, kind_of_key), pa.array(merged, pa.string())], names=["key", "said"])
        kind_of_key = None
        for batch in batches:
            kind_of_key = batch.schema.field(0).type
            for k, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != now:
                    if state is not None:
                        keys.append(now)
                        merged.append(json.dumps(state, ensure_ascii=False))
                    now, state = k, {}
                merge_into(state, _object(said))
            if len(keys) >= OUT_ROWS:
                yield made()
                keys, merged = [], []
        if state is not None:
            keys.append(now)
            merged.append(json.dumps(state, ensure_ascii=False))
            yield made()

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("said", T.StringType())])
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), F.col("said").alias(metadata))
