"""Reading and writing of labelled text records."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import SPACES

TEXT, KLASS, VALUE = (os.environ.get(k, k.lower()) for k in ("TEXT", "KLASS", "VALUE"))
STATIC = "static:"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): non-blank lines of a text file, gzipped or not, without white space of any kind at both ends."""
    ends = f"^[{SPACES}]+|[{SPACES}]+$"
    return spark.read.text(path).select(F.regexp_replace("value", ends, "").alias("value")).filter("value <> ''")


def read_records(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, id_col: str = "doc_id") -> DataFrame:
    """JSON lines as a table with an id in file order. Malformed lines fail. Paths that begin with 'static:' are rows
    that are always trained on and never tested (is_static)."""
    out = None
    for p in [path] if isinstance(path, str) else path:
        fixed = p.startswith(STATIC)
        reader = spark.read.option("mode", "FAILFAST")
        d = (reader.schema(schema) if schema else reader).json(p.removeprefix(STATIC)).withColumn("is_static", F.lit(fixed))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if id_col in out.columns:
        return out
    # ids follow the order of files and lines; a stable number needs no shuffle
    return out.withColumn(id_col, F.monotonically_increasing_id())


def read_data(df: DataFrame, text: str | Column = TEXT, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text); text may be any expression over the record."""
    d = df.select(id_col, (F.col(text) if isinstance(text, str) else text).alias("text"))
    return d if limit is None else d.orderBy(id_col).limit(limit)


def _need(c: Column, name: str) -> Column:
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"a record without {name}")))


def read_labels(df: DataFrame, text: str | Column = TEXT, klass: str = KLASS, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text, klass): labels as strings; a missing label fails."""
    d = df.select(id_col, (F.col(text) if isinstance(text, str) else text).alias("text"), _need(F.col(klass).cast("string"), klass).alias("klass"))
    return d if limit is None else d.orderBy(id_col).limit(limit)


def read_values(df: DataFrame, text: str | Column = TEXT, value: str = VALUE, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text, value): targets as doubles; a missing target fails."""
    d = df.select(id_col, (F.col(text) if isinstance(text, str) else text).alias("text"), _need(F.col(value).cast("double"), value).alias("value"))
    return d if limit is None else d.orderBy(id_col).limit(limit)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_params(path: str) -> list[dict]:
    import gzip

    with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8") as f:
        return json.load(f)


def write_params(found: list[dict], path: str) -> None:
    """Configurations, best first, without those that failed; fails if none is left."""
    good = [c for c in found if "_error" not in c]
    if not good:
        raise ValueError("no configuration could be evaluated")
    good.sort(key=lambda c: -c["_score"])
    with open(path, "w", encoding="utf-8") as f:
        json.dump(good, f, indent=1, sort_keys=True)
