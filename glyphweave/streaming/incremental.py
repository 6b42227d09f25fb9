"""Fitted models on streams, and vocabularies that grow with one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import TextConfig
from ..functions.tokens import tokenized


def stream_tokens(stream: DataFrame, cfg: TextConfig, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens of a stream of texts: stateless, so it runs in any output mode."""
    return tokenized(stream, cfg, text_col, keep=keep)


def grow_vocabulary(stream: DataFrame, cfg: TextConfig, path: str, checkpoint: str, text_col: str = "text", id_col: str = "doc_id") -> StreamingQuery:
    """Adds each batch's document frequencies to path as one file set a batch; a batch that is run again replaces its
    own, so counts are exact after failures. read_vocabulary() sums them."""

    def add(batch: DataFrame, epoch: int) -> None:
        t = tokenized(batch, cfg, text_col, keep=(id_col,)).persist()
        n = t.count()
        counts = t.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        counts.withColumn("n_docs", F.lit(n)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        t.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_vocabulary(df: DataFrame) -> tuple[DataFrame, int]:
    """(token, df) and the number of documents, of all batches under the path that df was read from."""
    n = df.select("epoch", "n_docs").distinct().agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    return df.groupBy("token").agg(F.sum("df").alias("df")), n
