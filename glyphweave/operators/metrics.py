"""Evaluation of predictions with aggregates: class metrics from the confusion matrix, regression metrics, voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranking import value_ranks

CLASS_SCORES = ("macrof1", "macrorecall", "macrof1accuracy", "weightedf1", "accuracy", "avgf1", "geometricf1", "harmonicf1")
VALUE_SCORES = ("r2", "pearsonr", "spearmanr")


def confusion(rows: DataFrame, gold: str = "klass", pred: str = "predicted") -> DataFrame:
    """(klass, predicted, n)."""
    return rows.groupBy(F.col(gold).cast("string").alias("klass"), F.col(pred).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """(klass, support, precision, recall, f1) of each class that is in either column; 0 where undefined."""
    both = conf.select(F.explode(F.array(F.struct(F.col("klass").alias("k"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("k"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), "n", (F.col("klass") == F.col("predicted")).cast("int").alias("hit"))
    s = both.groupBy(F.col("x.k").alias("klass")).agg(F.sum(F.col("n") * F.col("x.g")).alias("support"), F.sum(F.col("n") * F.col("x.p")).alias("guessed"), F.sum(F.col("n") * F.col("x.g") * F.col("hit")).alias("tp"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp = F.col("tp")
    return s.select("klass", "support", part(tp, F.col("guessed")).alias("precision"), part(tp, F.col("support")).alias("recall"), part(2 * tp, F.col("guessed") + F.col("support")).alias("f1"))


def class_scores(conf: DataFrame) -> DataFrame:
    """One row of scores over all classes. With two classes the micro and weighted F1 are the F1 of the second one."""
    c = per_class(conf).withColumn("i", F.row_number().over(Window.orderBy("klass")))
    acc = conf.agg((F.sum(F.when(F.col("klass") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    eps = F.col("f1") + 1e-4
    k = F.count("*")
    a = c.agg(
        F.avg("f1").alias("macrof1"),
        (F.sum(F.when(F.col("support") > 0, F.col("recall"))) / k).alias("macrorecall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf1"),
        F.max(F.when(F.col("i") == 2, F.col("f1"))).alias("second"),
        k.alias("k"),
        F.exp(F.sum(F.log(eps))).alias("geometricf1"),
        (k / F.sum(1 / eps)).alias("harmonicf1"),
    ).crossJoin(acc)
    two = F.col("k") == 2
    return a.select(
        "accuracy", "macrof1", "macrorecall", "geometricf1", "harmonicf1",
        (F.col("macrof1") * F.col("accuracy")).alias("macrof1accuracy"),
        F.when(two, F.col("second")).otherwise(F.col("accuracy")).alias("microf1"),
        F.when(two, F.col("second")).otherwise(F.col("wf1")).alias("weightedf1"),
    )


def average_f1(conf: DataFrame, classes: list[str]) -> DataFrame:
    """(avgf1): mean F1 of the named classes; one that is absent counts 0."""
    c = per_class(conf).filter(F.col("klass").isin(classes))
    return c.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / len(classes)).alias("avgf1"))


def quadratic_kappa(conf: DataFrame) -> DataFrame:
    """(kappa): agreement weighted by the squared distance of the classes' ranks."""
    labels = conf.select(F.col("klass").alias("l")).union(conf.select("predicted")).distinct().withColumn("r", F.row_number().over(Window.orderBy("l")))
    g, p = labels.withColumnRenamed("l", "klass").withColumnRenamed("r", "i"), labels.withColumnRenamed("l", "predicted").withColumnRenamed("r", "j")
    rows = conf.groupBy("klass").agg(F.sum("n").alias("a")).join(g, "klass")
    cols = conf.groupBy("predicted").agg(F.sum("n").alias("b")).join(p, "predicted")
    w = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    seen = conf.join(g, "klass").join(p, "predicted").agg(F.sum(w * F.col("n")).alias("o"), F.sum("n").alias("t"))
    due = rows.crossJoin(cols).agg(F.sum(w * F.col("a") * F.col("b")).alias("e"))
    return seen.crossJoin(due).select(F.when(F.col("e") > 0, 1 - F.col("o") * F.col("t") / F.col("e")).alias("kappa"))


def value_scores(rows: DataFrame, gold: str = "value", pred: str = "predicted", rank_target: bool = False) -> DataFrame:
    """(r2, pearsonr, spearmanr); null where a side doesn't vary. Rows without a gold value or a prediction are left out.
    rank_target scores the dense ranks of the gold values in their stead. Equal pairs are counted before any is ranked."""
    pairs = rows.select(F.col(gold).cast("double").alias("y"), F.col(pred).cast("double").alias("p")).filter("y is not null and p is not null")
    pairs = stored(pairs.groupBy("y", "p").agg(F.count("*").alias("n")), "pairs")
    ranks = lambda c: value_ranks(pairs.groupBy(c).agg(F.sum("n").alias("n")), c, "n", f"r{c}", f"{c}_place")
    d = pairs.join(ranks("y"), "y").join(ranks("p"), "p")
    d = d.select((F.col("y_place").cast("double") if rank_target else F.col("y")).alias("y"), "p", "ry", "rp", "n")
    names = ("y", "p", "ry", "rp")
    mean = d.agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m_{c}") for c in names])
    c = {x: F.col(x) - F.col(f"m_{x}") for x in names}
    total = lambda x: F.sum(x * F.col("n"))
    corr = lambda a, b: F.try_divide(total(c[a] * c[b]), F.sqrt(total(c[a] * c[a]) * total(c[b] * c[b])))
    off = F.col("y") - F.col("p")
    # one row on the other side
    return d.crossJoin(F.broadcast(mean)).agg((1 - F.try_divide(total(off * off), total(c["y"] * c["y"]))).alias("r2"), corr("y", "p").alias("pearsonr"), corr("ry", "rp").alias("spearmanr"))


def mismatches(rows: DataFrame, gold: str = "klass", pred: str = "predicted") -> DataFrame:
    return rows.filter(~F.col(gold).cast("string").eqNullSafe(F.col(pred).cast("string")))


def majority_vote(votes: DataFrame, id_col: str = "doc_id", voter_col: str = "voter", pred: str = "predicted") -> DataFrame:
    """(id, predicted): the most frequent prediction, ties to the one that the earliest voter gave."""
    n = votes.groupBy(id_col, pred).agg(F.count("*").alias("n"), F.min(voter_col).alias("first"))
    return n.groupBy(id_col).agg(F.min_by(pred, F.struct((-F.col("n")).alias("m"), "first")).alias(pred))


def ordinal(value: Column, low: int, high: int) -> Column:
    """The nearest whole number (half to even) within the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(value, 0).cast("int")))


def encoded(rows: DataFrame, label_col: str = "klass", out: str = "label") -> DataFrame:
    """Labels numbered from 0 in their order as strings. The table of labels is joined, not ranked over all rows."""
    k = F.col(label_col).cast("string")
    labels = rows.select(k.alias("_k")).filter("_k is not null").distinct().withColumn(out, F.row_number().over(Window.orderBy("_k")) - 1)
    return rows.join(labels, k == F.col("_k"), "left").drop("_k")
