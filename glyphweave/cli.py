"""Command line: python -m glyphweave.cli VERB ... (params, train, predict, textmodel, retrain, kfolds, perf, ensemble)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import TextConfig
from .operators import metrics, splits
from .plans import search
from .plans.model import TextClassifier, TextModel
from .sources import records as R


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("glyphweave").getOrCreate()


def _rows(a: argparse.Namespace, path: list[str] | str, target: bool = True) -> DataFrame:
    d = R.read_records(session(), path)
    if not target:
        return d
    col = R.VALUE if getattr(a, "regression", False) else R.KLASS
    return d.withColumn(col, F.col(col).cast("double" if col == R.VALUE else "string"))


def _target(a: argparse.Namespace) -> str:
    return R.VALUE if a.regression else R.KLASS


def _config(a: argparse.Namespace) -> TextConfig:
    if getattr(a, "conf", None):
        return TextConfig.from_dict(json.loads(a.conf))
    if getattr(a, "params", None):
        return TextConfig.from_dict(R.read_params(a.params)[a.index])
    return TextConfig()


def do_params(a: argparse.Namespace) -> str:
    docs = _rows(a, a.files)
    score = a.score if not a.regression or a.score in metrics.VALUE_SCORES else "r2"
    fun = search.make_scorer(docs, score, a.folds, splits.parse_ratio(a.ratio) if a.ratio else None, R.TEXT, _target(a), seed=a.seed)
    if a.conf:
        found = [fun(json.loads(a.conf))]
    else:
        s = search.Search(fun, batch=a.bsize, seed=a.seed, threads=a.threads)
        found = s.run(climb=a.hill, best=R.read_params(a.resume) if a.resume else None, rounds=a.rounds)
    out = a.output or f"{a.files[0]}.params"
    R.write_params(found, out)
    return out


def _fit(a: argparse.Namespace, docs: DataFrame, model: TextModel | None = None, labels: list[str] | None = None) -> TextClassifier:
    text = R.TEXT
    if getattr(a, "balance", False) and not a.regression:
        b = splits.balanced(docs, R.KLASS, R.TEXT).withColumn("doc_id", F.xxhash64("klass", "slot"))
        docs, text = b.select("doc_id", F.col("texts").alias(R.TEXT), F.col("klass").alias(R.KLASS)), R.TEXT
    return TextClassifier.fit(docs, _config(a), text, _target(a), labels=labels, regression=a.regression, text_model=model)


def do_train(a: argparse.Namespace) -> str:
    out = a.output or f"{a.files[0]}.model"
    _fit(a, _rows(a, a.files), labels=a.labels.split(",") if a.labels else None).save(out)
    return out


def do_predict(a: argparse.Namespace) -> str:
    model = TextClassifier.load(session(), a.model)
    docs = R.read_records(session(), a.files)
    got = model.predict(docs, R.TEXT, proba=a.proba)
    if model.linear.labels is None:
        value = F.col("predicted")
        if a.ordinal:
            low, high = map(int, a.ordinal.split(":"))
            value = metrics.ordinal(value, low, high)
        new = got.select("doc_id", value.alias("_value"))
        out = docs.join(new, "doc_id").withColumn(R.VALUE, F.col("_value")).drop("_value")
    else:
        more = ["predict_proba"] if a.proba else []
        new = got.select("doc_id", F.col("decision").alias("decision_function"), "predicted", *more)
        out = docs.drop("decision_function", "predicted", *more).join(new, "doc_id").withColumn(R.KLASS, F.col("predicted"))
    path = a.output or f"{a.files}.predicted"
    R.write_records(out.drop("is_static"), path)
    return path


def do_textmodel(a: argparse.Namespace) -> str:
    docs = R.read_records(session(), a.files)
    vec = TextClassifier.load(session(), a.model).model.transform(docs, R.TEXT)
    pairs = F.transform("vec", lambda p: F.array(p["token_id"].cast("double"), p["value"]))
    path = a.output or f"{a.files}.vec"
    R.write_records(docs.drop("vec", "vecsize", "is_static").join(vec.select("doc_id", pairs.alias("vec"), "vecsize"), "doc_id"), path)
    return path


def do_retrain(a: argparse.Namespace) -> str:
    old = TextClassifier.load(session(), a.model)
    a.regression = old.linear.labels is None
    _fit(a, _rows(a, a.files), old.model, old.linear.labels).save(a.output)
    return a.output


def do_kfolds(a: argparse.Namespace) -> str:
    """Out-of-fold decisions of each row; the text model is fitted on all rows, or on those of the classes that
    TEXTMODEL_KLASSES in the environment names, with commas between."""
    docs = splits.folds(_rows(a, a.files), a.folds, None if a.regression else R.KLASS, seed=a.seed).persist()
    some = os.environ.get("TEXTMODEL_KLASSES")
    base = docs.filter(F.col(R.KLASS).isin(some.split(","))) if some and not a.regression else docs
    model = TextModel.fit(base, _config(a), R.TEXT, _target(a))
    labels = None if a.regression else sorted(r[0] for r in docs.select(R.KLASS).distinct().collect())
    got = None
    for i in range(a.folds):
        c = TextClassifier.fit(docs.filter(F.col("fold") != i), None, R.TEXT, _target(a), labels=labels, regression=a.regression, text_model=model)
        p = c.predict(docs.filter(F.col("fold") == i), R.TEXT)
        got = p if got is None else got.unionByName(p)
    path = a.output or f"{a.files[0]}.kfolds"
    new = got.select("doc_id", F.col("decision").alias("decision_function"), F.col("predicted"))
    R.write_records(docs.drop("fold", "is_static", "decision_function", "predicted").join(new, "doc_id"), path)
    return path


def do_perf(a: argparse.Namespace) -> dict:
    """Metrics of predictions against gold records, joined by doc_id (line order where the files have none)."""
    gold, pred = R.read_records(session(), a.gold), R.read_records(session(), a.predicted)
    col = R.VALUE if a.regression else R.KLASS
    rows = gold.select("doc_id", F.col(col).alias("gold")).join(pred.select("doc_id", F.col(col).alias("predicted")), "doc_id").persist()
    if a.regression:
        return metrics.value_scores(rows, "gold").first().asDict()
    conf = metrics.confusion(rows, "gold").persist()
    out = metrics.class_scores(conf).first().asDict() | {"quadratic_weighted_kappa": metrics.quadratic_kappa(conf).first().kappa}
    out |= {f"f1_{r.klass}": r.f1 for r in metrics.per_class(conf).collect()}
    if a.avgf1:
        out[f"avgf1_{a.avgf1}"] = metrics.average_f1(conf, a.avgf1.split(":")).first().avgf1
    if a.mismatches:
        R.write_records(metrics.mismatches(rows, "gold").join(gold.drop("is_static"), "doc_id"), a.mismatches)
    return out


def do_ensemble(a: argparse.Namespace) -> str:
    first, votes = None, None
    for i, p in enumerate(a.files):
        d = R.read_records(session(), p)
        first = d if first is None else first
        v = d.select("doc_id", F.lit(i).alias("voter"), F.col(R.KLASS).cast("string").alias("predicted"))
        votes = v if votes is None else votes.unionByName(v)
    new = metrics.majority_vote(votes).withColumnRenamed("predicted", R.KLASS)
    R.write_records(first.drop(R.KLASS, "predicted", "is_static").join(new, "doc_id"), a.output)
    return a.output


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphweave", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, many: bool = True, model: bool = False) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        v.add_argument("files", nargs="+" if many else None)
        v.add_argument("-o", "--output", required=name in ("retrain", "ensemble"))
        if model:
            v.add_argument("-m", "--model", required=True)
        return v

    def learning(v: argparse.ArgumentParser) -> None:
        v.add_argument("-R", "--regression", action="store_true")
        v.add_argument("--conf")
        v.add_argument("-m", "--params")
        v.add_argument("-i", "--index", type=int, default=0)

    v = verb("params")
    v.add_argument("-k", "--folds", type=int, default=3)
    v.add_argument("-s", "--bsize", type=int, default=32)
    v.add_argument("-H", "--hill", action="store_true")
    v.add_argument("-r", "--resume")
    v.add_argument("-n", "--threads", type=int, default=1)
    v.add_argument("-S", "--score", default="macrof1")
    v.add_argument("--ratio")
    v.add_argument("--rounds", type=int)
    v.add_argument("--conf")
    v.add_argument("--seed", type=int, default=0)
    v.add_argument("-R", "--regression", action="store_true")
    v = verb("train")
    learning(v)
    v.add_argument("-b", "--balance", action="store_true")
    v.add_argument("-l", "--labels")
    v = verb("predict", many=False, model=True)
    v.add_argument("--ordinal")
    v.add_argument("--proba", action="store_true")
    verb("textmodel", many=False, model=True)
    v = verb("retrain", model=True)
    v = verb("kfolds")
    learning(v)
    v.add_argument("-k", "--folds", type=int, default=5)
    v.add_argument("--seed", type=int, default=0)
    v = verbs.add_parser("perf")
    v.add_argument("gold")
    v.add_argument("predicted")
    v.add_argument("-a", "--avgf1")
    v.add_argument("-r", "--regression", action="store_true")
    v.add_argument("--mismatches")
    verb("ensemble")
    return p


def main(args: list[str] | None = None) -> object:
    a = parser().parse_args(args)
    return globals()[f"do_{a.verb}"](a)


def params(*args: str) -> object:
    return main(["params", *args])


def train(*args: str) -> object:
    return main(["train", *args])


def predict(*args: str) -> object:
    return main(["predict", *args])


def textmodel(*args: str) -> object:
    return main(["textmodel", *args])


def retrain(*args: str) -> object:
    return main(["retrain", *args])


def kfolds(*args: str) -> object:
    return main(["kfolds", *args])


if __name__ == "__main__":
    print(main(sys.argv[1:]))
