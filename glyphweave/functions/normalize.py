"""Text normalisation as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DELETE, GROUP, NONE, TextConfig

#: Deleted by del_punc; spaces between words. '~' is among them.
PUNCTUATION = "!\"'(),-./:;<>?@[\\]{|}~" + "¡¿’“”…・"
BLANKS = "\n\r \t\u00a0"
_BLANK = "\\n\\r \\t\\u00A0"
#: Python's idea of a space, for Java's regex engine.
SPACES = "\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same, character by character.
SPACE_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SOLID = f"[^{SPACES}]"
NUMBER = r"\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+"


def swap(text: Column, pattern: str, option: str, marker: str) -> Column:
    """Matches become the marker (group), vanish (delete) or stay (any other option)."""
    if option not in (GROUP, DELETE):
        return text
    return F.regexp_replace(text, pattern, marker if option == GROUP else "")


def numbers(text: Column, option: str = GROUP) -> Column:
    return swap(text, NUMBER, option, "_num")


def urls(text: Column, option: str = GROUP) -> Column:
    return swap(text, f"https?://{_SOLID}+", option, "_url")


def users(text: Column, option: str = GROUP) -> Column:
    return swap(text, f"@{_SOLID}+", option, "_usr")


def hashtags(text: Column, option: str = GROUP) -> Column:
    return swap(text, f"#{_SOLID}+", option, "_htag")


def entities(text: Column, option: str = GROUP) -> Column:
    return swap(text, "[A-Z][a-z]+", option, "_ent")


def only_entities(text: Column) -> Column:
    """Users, hashtags and capitalised words, joined by spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"([@#A-Z]{_SOLID}+)"), F.lit(1)), " ")


def decomposed(text: Column) -> Column:
    """Canonical decomposition inside the JVM. Spark counts the call as nondeterministic, so it belongs in a projection
    of its own, after the filters."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(False))


def norm_chars(nfd: Column, del_diac: bool = True, del_dup: bool = False, del_punc: bool = False) -> Column:
    """Characters of a decomposed text: marks, runs and punctuation out as asked; blanks and both ends become '~'."""
    t = nfd
    if del_diac:
        t = F.regexp_replace(t, "[\\u0300-\\u036F]+", "")
    if del_dup:
        t = F.regexp_replace(t, f"([^{_BLANK}])\\1+", "$1")
        t = F.regexp_replace(t, f"(^|[{_BLANK}])~", "$1")
    gone = PUNCTUATION if del_punc else ""  # what has no counterpart vanishes, in the same pass
    return F.concat(F.lit("~"), F.translate(t, BLANKS + gone, "~" * len(BLANKS)), F.lit("~"))


def before_chars(text: Column, cfg: TextConfig) -> Column:
    """The word-level steps, in their order: entities see case, URLs come after numbers."""
    t = F.coalesce(text, F.lit(""))
    if cfg.select_ent:
        t = only_entities(t)
    t = entities(hashtags(t, cfg.hashtag_option), cfg.ent_option)
    if cfg.lc:
        t = F.lower(t)
    return users(urls(numbers(t, cfg.num_option), cfg.url_option), cfg.usr_option)


def normalized(df: DataFrame, cfg: TextConfig, text_col: str = "text", out: str = "norm") -> DataFrame:
    """The table with the normalised text in column out; a null text counts as empty."""
    if cfg.disable_text_transformations:
        return df.withColumn(out, F.coalesce(F.col(text_col), F.lit("")))
    source = text_col
    if cfg.emo_option != NONE:
        from .emoji import emoticons

        df, source = df.withColumn(out, emoticons(F.coalesce(F.col(text_col), F.lit("")), cfg.emo_option)), out
    df = df.withColumn(out, decomposed(before_chars(F.col(source), cfg)))
    df = df.withColumn(out, norm_chars(F.col(out), cfg.del_diac, cfg.del_dup, cfg.del_punc))
    if cfg.norm_emojis:
        from .emoji import replace_emojis

        df = df.withColumn(out, replace_emojis(df.sparkSession, F.col(out)))
    return df
