"""Text models and text classifiers: fit, transform, predict, save and load."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TextConfig
from ..functions.tokens import tokenized, tokenized_parts
from ..operators import vocabulary as V
from ..operators import weighting as W
from ..operators.linear import MOST_LABELS, LinearModel
from ..sources.tables import stored


def _put(spark: SparkSession, path: str, obj: dict) -> None:
    spark.createDataFrame([(json.dumps(obj),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@dataclass
class TextModel:
    """A configuration with its fitted vocabulary (token, df, token_id, weight)."""

    config: TextConfig
    vocab: DataFrame
    n_docs: int
    num_terms: int

    @staticmethod
    def tokenize(docs: DataFrame, config: TextConfig, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
        kind = dict(docs.dtypes)[text_col]
        if kind.startswith("array"):
            t = tokenized_parts(docs, config, text_col, id_col)
            return t.join(docs.select(id_col, *keep), id_col) if keep else t
        return tokenized(docs, config, text_col, keep=(id_col, *keep))

    @classmethod
    def counts(cls, docs: DataFrame, config: TextConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """(id, token, n), written: texts are normalised and cut into tokens once, whatever is made of them later."""
        return stored(W.token_counts(cls.tokenize(docs, config, text_col, id_col), id_col), "counts")

    @classmethod
    def fit(cls, docs: DataFrame, config: TextConfig | None = None, text_col: str = "text", label_col: str = "klass", id_col: str = "doc_id", counts: DataFrame | None = None) -> TextModel:
        """counts: those of docs, if they are there already."""
        config = config or TextConfig()
        counts = cls.counts(docs, config, text_col, id_col) if counts is None else counts
        n = docs.select(id_col).distinct().count()
        vocab = V.vocabulary_of(counts.groupBy("token").agg(F.count("*").alias("df")), config, n)
        if config.weighting == "entropy":
            vocab = W.entropy(vocab, counts, docs.select(id_col, label_col), label_col, id_col)
        else:
            vocab = W.unit_weights(vocab, n) if config.weighting == "tf" else W.idf(vocab, n)
        vocab = stored(vocab, "vocabulary")
        return cls(config, vocab, n, vocab.count())

    @classmethod
    def fit_long(cls, docs: DataFrame, config: TextConfig | None = None, text_col: str = "text", label_col: str = "klass", id_col: str = "doc_id", counts: DataFrame | None = None) -> tuple[TextModel, DataFrame]:
        """A model and the long vectors of the documents it is fitted on, from one pass over their texts."""
        config = config or TextConfig()
        counts = cls.counts(docs, config, text_col, id_col) if counts is None else counts
        model = cls.fit(docs, config, text_col, label_col, id_col, counts)
        return model, model.weighted(counts, id_col)

    def weighted(self, counts: DataFrame, id_col: str = "doc_id", unit: bool | None = None) -> DataFrame:
        return W.rows_of(self.config.weighting)(counts, self.vocab, self.config.unit_vector if unit is None else unit, id_col, terms=self.num_terms)

    def long(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: bool | None = None, counts: DataFrame | None = None) -> DataFrame:
        """counts: those of docs, if they are there already."""
        counts = W.token_counts(self.tokenize(docs, self.config, text_col, id_col), id_col) if counts is None else counts
        return self.weighted(counts, id_col, unit)

    def transform(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: bool | None = None, counts: DataFrame | None = None) -> DataFrame:
        """(id, vec, vecsize) for every document."""
        return W.as_vectors(self.long(docs, text_col, id_col, unit, counts), docs, id_col)

    def token2id(self) -> DataFrame:
        return self.vocab.select("token", "token_id")

    def id2token(self) -> DataFrame:
        return self.vocab.select("token_id", "token")

    def token_weight(self) -> DataFrame:
        return self.vocab.select("token_id", "weight")

    def save(self, path: str) -> None:
        spark = self.vocab.sparkSession
        _put(spark, f"{path}/config", {"config": self.config.to_dict(), "n_docs": self.n_docs, "num_terms": self.num_terms})
        self.vocab.select("token", "df", "token_id", "weight").write.mode("overwrite").parquet(f"{path}/vocab")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        d = _get(spark, f"{path}/config")
        return cls(TextConfig.from_dict(d["config"]), spark.read.parquet(f"{path}/vocab"), d["n_docs"], d["num_terms"])


@dataclass
class TextClassifier:
    """A text model and the linear model on its vectors; without labels a regressor."""

    model: TextModel
    linear: LinearModel

    @classmethod
    def fit(cls, docs: DataFrame, config: TextConfig | None = None, text_col: str = "text", target_col: str = "klass", id_col: str = "doc_id", labels: list[str] | None = None, regression: bool = False, text_model: TextModel | None = None, estimator: type | str = LinearModel, counts: DataFrame | None = None, vectors: DataFrame | None = None) -> TextClassifier:
        """estimator: LinearModel, or a class with its fit and decide, or the dotted path of one. counts: those of docs, if
        they are there already; vectors: text_model's of docs, other documents' among them, one row for each id."""
        estimator = W.named(estimator) if isinstance(estimator, str) else estimator
        if text_model:
            model, vec = text_model, text_model.transform(docs, text_col, id_col, counts=counts) if vectors is None else vectors
        else:
            model, long = TextModel.fit_long(docs, config, text_col, target_col, id_col, counts)
            vec = W.as_vectors(long, docs, id_col)
        if regression:
            y = docs.select(id_col, F.col(target_col).cast("double").alias("y"))
            return cls(model, estimator.fit(vec.join(y, id_col), model.num_terms, None))
        k = F.col(target_col).cast("string")
        if labels is None:
            labels = sorted(r.k for r in docs.select(k.alias("k")).distinct().limit(MOST_LABELS + 1).collect() if r.k is not None)
        index = F.array_position(F.array(*[F.lit(x) for x in labels]), k) - 1
        y = docs.select(id_col, F.when(k.isNotNull(), index).otherwise(F.raise_error(F.lit("a row without label")).cast("long")).alias("y"))
        return cls(model, estimator.fit(vec.join(y, id_col), model.num_terms, labels))

    def predict(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", proba: bool = False, counts: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """(id, decision, predicted), and predict_proba if asked for. counts and vectors as in fit()."""
        more = ["predict_proba"] if proba and self.linear.labels is not None else []
        vec = self.model.transform(docs, text_col, id_col, counts=counts) if vectors is None else docs.select(id_col).join(vectors, id_col)
        return self.linear.decide(vec, bool(more)).select(id_col, "decision", "predicted", *more)

    def save(self, path: str) -> None:
        self.model.save(path)
        w = self.linear.weights
        _put(self.model.vocab.sparkSession, f"{path}/linear", {"labels": self.linear.labels, "weights": w.tolist()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        d = _get(spark, f"{path}/linear")
        return cls(TextModel.load(spark, path), LinearModel(np.array(d["weights"]), d["labels"]))
