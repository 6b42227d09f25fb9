"""Word n-grams, skip-grams and character n-grams as built-in array expressions.

Arrays that a lambda reads are bound by let(): were they columns of an earlier projection, a filter that Catalyst infers
and pushes down would carry the split into the lambda and repeat it for each position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TextConfig
from .normalize import PUNCTUATION, SPACE_CHARS, normalized


def _empty() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's variable is never expanded."""
    return F.get(F.transform(F.array(value), use), 0)


def words(norm: Column) -> Column:
    """Words of a normalised text, whose first and last characters are dropped whatever they are."""
    inner = F.substring(norm, F.lit(2), F.greatest(F.length(norm) - 2, F.lit(0)))
    apart = PUNCTUATION + SPACE_CHARS
    return F.filter(F.split(F.translate(inner, apart, " " * len(apart)), " "), lambda w: w != "")


def ngrams(w: Column, n: int) -> Column:
    """Runs of n words joined by '~'; none if there are fewer. No word has a '~', so they are found in the words' own join."""
    if n == 1:
        return w
    word = "[^~]++"
    return F.regexp_extract_all(F.array_join(w, "~"), F.lit(rf"\G(?=({'~'.join([word] * n)})){word}~?"), F.lit(1))


def skipgrams(w: Column, q: int, s: int) -> Column:
    """q words with s words left out between each two."""
    span = q + (q - 1) * s
    at = F.sequence(F.lit(0), F.size(w) - span)
    pick = lambda i: F.concat_ws("~", *[F.get(w, i + F.lit(j * (s + 1))) for j in range(q)])
    return F.when(F.size(w) >= span, F.transform(at, pick)).otherwise(_empty())


#: Stands between q-grams while they are cut; texts that have it take another way.
_CUT = "\u0001"


def _runs(text: Column, q: int, char: str) -> Column:
    """Runs of q characters that char matches, each before the next one's start."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=({char * q})){char}"), F.lit(1)), lambda t: F.concat(F.lit("q:"), t))


def qgrams(norm: Column, q: int) -> Column:
    """Runs of q characters with the prefix 'q:'."""
    cut = F.split(F.regexp_replace(norm, f"(?s)(?=({'.' * q})).", f"q:$1{_CUT}"), _CUT)
    # the last part is what is left, fewer than q characters
    return F.when(norm.contains(_CUT), _runs(norm, q, ".")).otherwise(let(cut, lambda t: F.slice(t, 1, F.size(t) - 1)))


def word_qgrams(w: Column, q: int) -> Column:
    """Character runs of each '~word~' by itself: no word has a blank, and no run goes over one."""
    return F.when(F.size(w) > 0, _runs(F.concat(F.lit("~"), F.array_join(w, "~ ~"), F.lit("~")), q, "[^ ]")).otherwise(_empty())


def selected(tokens: Column, cfg: TextConfig) -> Column:
    """select_suff: tokens that end in a symbol or blank; select_conn: tokens with an inner '~' and none at the ends."""
    if cfg.select_suff:
        ends = PUNCTUATION + "\t\n\r "
        tokens = F.filter(tokens, lambda t: F.lit(ends).contains(F.substring(t, -1, 1)) & (t != ""))
    if cfg.select_conn:
        tokens = F.filter(tokens, lambda t: t.contains("~") & ~t.startswith("~") & ~t.endswith("~"))
    return tokens


def _token_column(cfg: TextConfig, norm: Column) -> Column:
    def grams(t: Column, w: Column | None) -> Column:
        parts = [ngrams(w, n) for n in cfg.ngrams] + [skipgrams(w, q, s) for q, s in cfg.skipgrams]
        parts += [word_qgrams(w, q) if cfg.q_grams_words else qgrams(t, q) for q in cfg.qgrams]
        return selected(F.concat(*parts) if parts else _empty(), cfg)

    need_words = bool(cfg.ngrams or cfg.skipgrams or (cfg.qgrams and cfg.q_grams_words))
    found = let(norm, lambda t: let(words(t), lambda w: grams(t, w)) if need_words else grams(t, None))
    return let(found, lambda t: F.when(F.size(t) == 0, F.array(F.lit("~"))).otherwise(t))


def tokenized(df: DataFrame, cfg: TextConfig, text_col: str = "text", out: str = "tokens", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., tokens): n-grams, then skip-grams, then q-grams; a text without any has the one token '~'."""
    d = normalized(df.select(*keep, F.col(text_col).alias("_t")), cfg, "_t", "_n")
    return d.select(*keep, _token_column(cfg, F.col("_n")).alias(out))


def tokenized_parts(df: DataFrame, cfg: TextConfig, parts_col: str, id_col: str = "doc_id", out: str = "tokens") -> DataFrame:
    """The same for texts in parts (ARRAY<STRING>): tokens of the parts in order, none across two parts."""
    rows = df.select(id_col, F.posexplode_outer(parts_col).alias("_p", "_x"), F.col(parts_col).isNull().alias("_null"))
    t = tokenized(rows, cfg, "_x", "_tok", (id_col, "_p"))
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_tok")))
    none = F.col("_p").isNull()
    return t.groupBy(id_col).agg(F.flatten(F.transform(ordered, lambda s: F.when(s["_p"].isNull(), _empty()).otherwise(s["_tok"]))).alias(out), F.max(none).alias("_e")).drop("_e")
