"""Vocabulary, weights, metrics, splits, models, search, command line and streaming on small tables."""

import json
import math

import pytest

from glyphweave import cli
from glyphweave.config import TextConfig
from glyphweave.operators import metrics, splits
from glyphweave.operators import vocabulary as V
from glyphweave.operators import weighting as W
from glyphweave.plans import search
from glyphweave.plans.model import TextClassifier, TextModel
from glyphweave.sources import records as R
from glyphweave.streaming.incremental import grow_vocabulary, read_vocabulary

TEXTS = {
    "POS": ["me gusta mucho este dia tan bueno", "que alegria y que buen dia", "excelente servicio me encanta"],
    "NEG": ["odio este dia tan malo", "que tristeza y que mal servicio", "pesimo no me gusta nada"],
    "NEU": ["la mesa es de madera", "el tren sale a las nueve", "hay una casa en la calle"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, k, float(len(t))) for i, (k, t) in enumerate((k, t) for k, ts in TEXTS.items() for t in ts)]
    return spark.createDataFrame(rows, "doc_id long, text string, klass string, value double").cache()


def test_idf_by_hand(spark):
    t = spark.createDataFrame([(1, list("abcd")), (2, list("ad")), (3, list("cd")), (4, ["d"])], "doc_id long, tokens array<string>")
    v = W.idf(V.vocabulary(t, TextConfig(), 4), 4)
    assert {r.token: (r.token_id, r.weight) for r in v.collect()} == {"a": (0, 1.0), "b": (1, 2.0), "c": (2, 1.0)}
    counts = W.token_counts(t)
    x = {(r.doc_id, r.token): r.value for r in W.tfidf(counts, v).collect()}
    assert math.isclose(x[1, "b"], 2 / math.sqrt(6)) and x[3, "c"] == 1 and (4, "d") not in x
    vec = {r.doc_id: r for r in W.as_vectors(W.tfidf(counts, v), t).collect()}
    assert vec[4].vecsize == 0 and vec[1].vecsize == 3
    for rows in (1, 2, 100):
        assert V.with_ids(V.doc_freq(t), rows).orderBy("token").select("token_id").collect() == [(i,) for i in range(4)]


def test_bounds():
    assert V.bounds(9, 0, 1) == V.bounds(9, -1, 1.0) == (None, None)
    assert V.bounds(9, 0.01, 1) == (1, None) and V.bounds(9, 0, 0.5) == (1, 4) and V.bounds(9, 3, 5) == (3, 5)


def test_counters(spark):
    one = V.Counter.of(spark.createDataFrame([(["a", "b", "a"],), (["a"],)], "tokens array<string>"))
    two = V.Counter.of(spark.createDataFrame([(["b", "c"],)], "tokens array<string>"))
    plus, minus = one + two, one - two
    assert json.loads(plus.to_json()) == {"dict": {"a": 2, "b": 2, "c": 1}, "update_calls": 3}
    assert json.loads(minus.to_json()) == {"dict": {"a": 2}, "update_calls": 1}
    assert V.Counter.from_json(spark, plus.to_json()).to_json() == plus.to_json()
    assert {r.token: r.weight for r in one.weights().collect()} == {"a": 0.0, "b": 1.0}


@pytest.mark.parametrize("weighting", ["tfidf", "tf", "entropy"])
def test_model_round_trip(spark, docs, tmp_path, weighting):
    m = TextModel.fit(docs, TextConfig(weighting=weighting, token_list=(-1, 3)))
    m.save(str(tmp_path / "m"))
    again = TextModel.load(spark, str(tmp_path / "m"))
    a, b = ({r.doc_id: [(p.token_id, round(p.value, 9)) for p in r.vec] for r in x.transform(docs).collect()} for x in (m, again))
    assert a == b and again.config == m.config and len(a) == 9
    if weighting == "tfidf":
        assert all(math.isclose(sum(v * v for _, v in x), 1, abs_tol=1e-6) for x in a.values())
        raw = {r.doc_id: sum(p.value**2 for p in r.vec) for r in m.transform(docs, unit=False).collect()}
        assert any(not math.isclose(v, 1, abs_tol=1e-3) for v in raw.values())


def test_max_dimension(docs):
    assert TextModel.fit(docs, TextConfig(token_list=(-1, 2, 3, 4), max_dimension=True, token_max_filter=16)).num_terms == 16
    with pytest.raises(ValueError):
        TextModel.fit(docs, TextConfig(max_dimension=True, token_max_filter=0.5))


def test_classifier_and_regressor(spark, docs, tmp_path):
    c = TextClassifier.fit(docs, TextConfig(token_list=(-1, 3)))
    got = {r.doc_id: r.predicted for r in c.predict(docs).collect()}
    assert got == {r.doc_id: r.klass for r in docs.collect()}
    c.save(str(tmp_path / "c"))
    assert {r.doc_id: r.predicted for r in TextClassifier.load(spark, str(tmp_path / "c")).predict(docs).collect()} == got
    r = TextClassifier.fit(docs, TextConfig(token_list=(-1,)), target_col="value", regression=True)
    rows = r.predict(docs).join(docs.select("doc_id", "value"), "doc_id")
    assert metrics.value_scores(rows).first().pearsonr > 0.5
    with pytest.raises(ValueError):
        TextClassifier.fit(docs.filter("klass = 'POS'"))


def test_partitioned_training_gives_the_same_model(docs, monkeypatch):
    from glyphweave.operators import linear

    a = TextClassifier.fit(docs, TextConfig()).linear.weights
    monkeypatch.setattr(linear, "PART_ENTRIES", 10)
    monkeypatch.setattr(linear, "SLICE", 7)
    b = TextClassifier.fit(docs, TextConfig()).linear.weights
    assert abs(a - b).max() < 1e-3


def test_proba_and_named_parts(docs):
    c = TextClassifier.fit(docs, TextConfig(weighting="glyphweave.operators.weighting.tfidf"), estimator="glyphweave.operators.linear.LinearModel")
    for r in c.predict(docs, proba=True).collect():
        assert math.isclose(sum(r.predict_proba), 1) and c.linear.labels[max(range(3), key=r.predict_proba.__getitem__)] == r.predicted
    two = TextClassifier.fit(docs.filter("klass <> 'NEU'"), TextConfig())
    assert all((r.predict_proba[1] > 0.5) == (r.predicted == "POS") for r in two.predict(docs, proba=True).collect())
    with pytest.raises(ValueError):
        W.named("nothing")


def test_ranks_against_pandas(spark):
    import pandas as pd

    from glyphweave.operators.ranking import value_ranks

    v = [float((i * 37) % 23) if i % 3 else 5.0 for i in range(300)]
    want = pd.Series(v).rank()
    counts = spark.createDataFrame([(x,) for x in v], "v double").groupBy("v").count()
    for rows in (2, 5, 1000):
        got = {r.v: (r.rank, r.place) for r in value_ranks(counts, "v", "count", "rank", "place", rows).collect()}
        assert all(got[x][0] == y for x, y in zip(v, want, strict=True)) and [got[x][1] for x in sorted(got)] == list(range(len(got)))


def test_environment_of_searches(monkeypatch):
    monkeypatch.setenv("TOKENLIST", "[[2, 1], -1, 3]")
    s = search.default_space()["token_list"]
    assert s.items == [(2, 1), -1, 3] and s.most == 2


def test_splits(docs):
    parts = [r.part for r in splits.holdout(docs, 0.5, 0.25).collect()]
    assert parts.count("train") == 5 and parts.count("test") == 3 and parts.count(None) == 1
    f = splits.folds(docs, 3, "klass").groupBy("klass", "fold").count().collect()
    assert len(f) == 9 and all(r["count"] == 1 for r in f)
    assert [r.fold for r in splits.folds(docs, 9).orderBy("fold").collect()] == list(range(9))
    twice = docs.unionByName(docs)  # rows that repeat an id are rows of their own
    assert splits.holdout(twice, 0.5).filter("part = 'train'").count() == 9 and splits.folds(twice, 2, "klass").count() == 18
    f = splits.balanced(docs.filter("doc_id <> 0"), "klass", faithful=True).collect()
    assert len(f) == 6 and all(1 <= len(r.texts) <= 2 for r in f)
    b = splits.balanced(docs.filter("doc_id <> 0"), "klass").collect()
    assert len(b) == 6 and sum(len(r.texts) for r in b) == 8
    assert splits.parse_ratio("0.5:0.2") == (0.5, 0.2) and splits.parse_ratio("0.7") == (0.7, None)


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "klass string, predicted string")
    s = metrics.class_scores(metrics.confusion(rows)).first()
    assert s.accuracy == 0.75 and math.isclose(s.macrof1, (2 / 3 + 0.8) / 2) and s.microf1 == s.weightedf1 == 0.8
    assert math.isclose(metrics.quadratic_kappa(metrics.confusion(rows)).first().kappa, 0.5)
    v = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (2, 1, "y"), (2, 2, "y")], "doc_id long, voter int, predicted string")
    assert {r.doc_id: r.predicted for r in metrics.majority_vote(v).collect()} == {1: "x", 2: "y"}


def test_parameter_kinds():
    rng = search.random.Random(0)
    s = search.Subset([1, 2, 3, 4])
    assert s.most == 3 and all(1 <= len(s.draw(rng)) <= 3 for _ in range(20))
    near = s.near([1, 2])
    assert [1] in near and [1, 2, 3] in near and [2, 3] in near and [1, 2] not in near
    assert search.Normal(5, 0).draw(rng) == 5 and 0 <= search.Uniform(0, 1).draw(rng) <= 1
    with pytest.raises(ValueError):
        search.space_from({"lc": search.Boolean()})


def test_search_never_tries_twice_and_resumes():
    seen = []

    def score(c):
        seen.append(search.code(c))
        return c | {"_score": len(c["token_list"]) + c["lc"]}

    s = search.Search(score, batch=6, seed=1)
    found = s.run(rounds=3)
    assert len(seen) == len(set(seen)) and [c["_score"] for c in found] == sorted((c["_score"] for c in found), reverse=True)
    assert found[0]["_score"] == 8
    again = search.Search(score, batch=2, seed=2)
    n = len(seen)
    again.run(best=found, rounds=1)
    assert not set(seen[n:]) & set(seen[:n])


def test_command_line(spark, docs, tmp_path, monkeypatch):
    data = str(tmp_path / "data.json")
    with open(data, "w", encoding="utf-8") as f:
        for r in docs.orderBy("doc_id").collect():
            f.write(json.dumps({"doc_id": r.doc_id, "text": r.text, "klass": r.klass, "value": r.value}) + "\n")
    out = cli.params("--conf", json.dumps(TextConfig(token_list=(-1, 3)).to_dict()), "-k", "3", data)
    assert "_score" in R.read_params(out)[0]
    model = cli.train("-m", out, "-o", str(tmp_path / "model"), data)
    pred = cli.predict("-m", model, data)
    assert pred == data + ".predicted"
    s = cli.main(["perf", data, pred])
    assert s["accuracy"] == 1.0 and s["f1_POS"] == 1.0
    assert "predict_proba" in spark.read.json(cli.predict("-m", model, "--proba", "-o", str(tmp_path / "p"), data)).columns
    assert "vec" in spark.read.json(cli.textmodel("-m", model, "-o", str(tmp_path / "vec"), data)).columns
    assert cli.retrain("-m", model, "-o", str(tmp_path / "model2"), data)
    assert spark.read.json(cli.kfolds("-k", "3", "-o", str(tmp_path / "kf"), data)).count() == 9
    monkeypatch.setenv("TEXTMODEL_KLASSES", "POS,NEG")
    assert spark.read.json(cli.kfolds("-k", "3", "-o", str(tmp_path / "kf2"), data)).count() == 9
    assert spark.read.json(cli.main(["ensemble", pred, pred, "-o", str(tmp_path / "ens")])).count() == 9
    cli.train("-R", "-o", str(tmp_path / "reg"), data)
    got = spark.read.json(cli.predict("-m", str(tmp_path / "reg"), "--ordinal", "0:30", "-o", str(tmp_path / "regp"), data))
    assert all(0 <= r.value <= 30 for r in got.collect())


def test_records(spark, tmp_path):
    p = str(tmp_path / "x.json")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"text": "a", "klass": 1}\n{"text": "b"}\n')
    d = R.read_records(spark, [p, "static:" + p])
    assert d.count() == 4 and d.filter("is_static").count() == 2
    with pytest.raises(Exception, match="without klass"):
        R.read_labels(d).collect()
    assert R.read_lines(spark, p).count() == 2
    with open(p, "w", encoding="utf-8") as f:
        f.write("\t x\u00a0\n \t\r\n\u2003\n\ny z\x0b\n")
    assert [r.value for r in R.read_lines(spark, p).collect()] == ["x", "y z"]
    with pytest.raises(ValueError):
        R.write_params([{"_error": "x", "_score": 0}], str(tmp_path / "p"))


def test_streaming_vocabulary(spark, docs, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.select("doc_id", "text").repartition(3).write.json(src)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(src)
    grow_vocabulary(stream, TextConfig(), out, str(tmp_path / "cp")).awaitTermination(90)
    df, n = read_vocabulary(spark.read.parquet(out))
    want = V.doc_freq(TextModel.tokenize(docs, TextConfig()))
    assert n == 9 and sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_registered_queries():
    import __spark_entry__ as E

    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and "tfidf_unit" in q and len(q) > 60
