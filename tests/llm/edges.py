"""Small tables with every awkward row."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog and runs far away from here"
FR = "le renard brun saute par dessus le chien paresseux et part bien loin"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def edge_rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, EN, "en", "a", len(EN)),
        (2, None, "en", "a", None),
        (3, "", "fr", None, 0),
        (None, FR, "fr", "b", len(FR)),
        (5, long, "en", "b", len(long)),
        (6, FR + "\n" + EN, None, "a", None),
        (7, EN, "en", "a", len(EN)),
        (7, EN, "en", "a", len(EN)),
        (8, "  \n\t\n", "en", "a", 5),
        (9, "!!! ... ###", "en", None, 11),
        (10, "\U0001f600 ñandú   x", None, None, 13),
    ]
    return rows


def edges(spark):
    return table(spark, edge_rows())


def clashing(df):
    """Extra columns with names that operators use themselves."""
    for c in ("row", "s", "u", "n", "c", "rate", "copy", "tokens", "shard", "lang_id", "lines_in", "lines_kept", "_id", "_text", "_kept", "_media", "id", "v", "h", "i", "label", "n_tokens", "error"):
        df = df.withColumn(c, F.lit(1))
    return df


def empty(spark):
    return table(spark, [])


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
