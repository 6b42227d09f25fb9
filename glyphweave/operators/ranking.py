"""Row numbers and ranks over whole tables without a window that gathers the table in one task.

The order is cut into buckets by a function of the order's first column alone, so that buckets don't depend on how rows
are partitioned or how often they are computed. Rows are numbered within their bucket and the sums of the buckets before
it are added. Only the buckets' sizes, BUCKETS for each group at most, are summed up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at most, rows from which a further bucket is made, and values that the cuts are taken from, about.
BUCKETS, BUCKET_ROWS, CUT_SAMPLE = 1024, 500_000, 20_000


def hash_bucket(hashed: Column) -> Column:
    """Bucket of a 64-bit hash, in the hash's order."""
    return F.shiftright(hashed, 64 - (BUCKETS.bit_length() - 1)).cast("int")


def value_bucket(values: DataFrame, key: str, rows: int, bucket_rows: int | None = None) -> Column:
    """Bucket of a column of distinct values, in their order. The cuts between buckets come from a sample by hash of about
    CUT_SAMPLE values (a fixed bound); which values they are alters the buckets' sizes only, never results."""
    wanted = min(BUCKETS, -(-rows // (bucket_rows or BUCKET_ROWS)))
    cuts = []
    if wanted > 1:
        step = max(1, rows // CUT_SAMPLE)
        some = values.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(step)) == 0))
        seen = some.select(F.array_sort(F.collect_set(key)).alias("s")).first().s
        cuts = [seen[i] for i in sorted({i * len(seen) // wanted for i in range(1, wanted)})] if seen else []
    below = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(below)


def numbered(df: DataFrame, bucket: Column, order: list[Column], out: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """The rows with out: 0, 1, ... in the order, within each group if any; with a weight the weights' sum of the rows
    before. bucket must not fall where the order rises."""
    g = F.lit(0) if group is None else F.col(group)
    d = df.withColumns({"_group": g, "_bucket": bucket})
    sizes = d.groupBy("_group", "_bucket").agg(F.sum(F.lit(1) if weight is None else F.col(weight)).alias("_size"))
    upto = Window.partitionBy("_group").orderBy("_bucket")
    before = sizes.select(F.col("_group").alias("_g"), F.col("_bucket").alias("_b"), (F.sum("_size").over(upto) - F.col("_size")).alias("_before"))
    within = Window.partitionBy("_group", "_bucket").orderBy(*order)
    own = F.row_number().over(within) - 1 if weight is None else F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    # the sizes are few rows: the join broadcasts them if Spark's own measure of them allows it, else it shuffles
    got = d.withColumn("_own", own).join(before, F.col("_group").eqNullSafe(F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return got.withColumn(out, F.col("_own") + F.col("_before")).drop("_group", "_bucket", "_own", "_g", "_b", "_before")


def value_ranks(counts: DataFrame, col: str, n: str, rank: str, place: str, bucket_rows: int | None = None) -> DataFrame:
    """(col, rank, place) from distinct values and the number n of rows that have each: the mean rank, from 1, of these
    rows, and the place, from 0, of the value among the distinct ones."""
    bucket = value_bucket(counts, col, counts.count(), bucket_rows)
    got = numbered(numbered(counts, bucket, [F.col(col)], "_upto", weight=n), bucket, [F.col(col)], place)
    return got.select(col, (F.col("_upto") + (F.col(n) + 1) / 2.0).alias(rank), place)
