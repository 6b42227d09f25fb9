"""Emoticons and emojis. The tables are our own: emoticons from a short list, emojis from the properties that the ICU
library inside Spark knows; the scanners are state machines that no built-in expression matches, so they run as Arrow
UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import DELETE, NONE

EMOTICONS = {":)": "_pos", ":-)": "_pos", ":d": "_pos", ";)": "_pos", "=)": "_pos", "<3": "_pos", "xd": "_pos", "lol": "_pos", ":(": "_neg", ":-(": "_neg", ":'(": "_neg", "=(": "_neg", ">:(": "_neg", ":/": "_neg", ":|": "_neu", ":-|": "_neu", "-_-": "_neu"}
SKIN = {chr(c) for c in range(0x1F3FB, 0x1F400)}
SELECTOR, KEY_CAP = "\ufe0f", "\u20e3"


class EmoticonTable:
    """Codes to classes. Alphabetic codes match as whole words in any case; others are tried at each place from the
    shortest on, and never at the very end of the text."""

    def __init__(self, table: dict[str, str] | None = None):
        table = EMOTICONS if table is None else table
        self.words = [(re.compile(rf"\b{c}\b", re.IGNORECASE), k) for c, k in table.items() if c.isalpha()]
        rest = {c: k for c, k in table.items() if not c.isalpha()}
        self.codes = [(n, {c: k for c, k in rest.items() if len(c) == n and k}) for n in sorted(set(map(len, rest)))]

    def replace(self, text: str, option: str) -> str:
        if option == NONE:
            return text
        for pattern, klass in self.words:
            text = pattern.sub("" if option == DELETE else klass, text)
        low, out, at = text.lower(), [], 0
        if len(low) != len(text):  # a letter that grows in lower case: keep places aligned
            low = "".join(c.lower()[0] for c in text)
        while at < len(text):
            for n, codes in self.codes:
                if at + n < len(text) and (klass := codes.get(low[at : at + n])):
                    out.append("" if option == DELETE else klass)
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join(out)


def emoticons(text: Column, option: str, table: dict[str, str] | None = None) -> Column:
    if option == NONE:
        return text

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        t = EmoticonTable(table)
        return s.map(lambda x: t.replace(x or "", option))

    return run(text)


def code_points(spec: str) -> str | list[str]:
    """'26BD' is a character, 'A B' a sequence, 'A..B' all characters between."""
    if ".." in spec:
        a, b = (int(x, 16) for x in spec.split(".."))
        return [chr(c) for c in range(a, b + 1)]
    return "".join(chr(int(x, 16)) for x in spec.split())


def read_emoji_lines(lines: Iterable[str], held: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Emoji to its types from lines of a Unicode emoji file, added to those held."""
    held = {} if held is None else held
    for line in lines:
        body, mark, _ = line.partition("#")
        cells = [c.strip() for c in body.split(";")]
        if not mark or len(cells) < 2:
            continue
        got = code_points(cells[0])
        for e in [got] if isinstance(got, str) else got:
            held.setdefault(e, []).append(cells[1])
    return held


def bare(emoji: str) -> str:
    """Without skin tones, variation selectors and key caps."""
    return "".join(c for c in emoji if c not in SKIN and c not in (SELECTOR, KEY_CAP))


def emoji_table(spark: SparkSession) -> dict[str, str]:
    """Emoji to the spaced bare emoji: all that ICU recommends for interchange, sequences of flags, key caps and joined
    emojis included, and all other code points with the emoji property but digits and signs that stand in texts. Of fixed
    size (Unicode's)."""
    jvm = spark._jvm
    listed = lambda pattern: jvm.java.lang.String.join("\n", jvm.com.ibm.icu.text.UnicodeSet(pattern)).split("\n")
    sequences = listed("[:RGI_Emoji:]")
    points = [e for e in listed("[[:Emoji:]-[:Emoji_Modifier:]]") if not e.isascii()]
    table = {}
    for e in {*sequences, *points}:
        spaced = f"~{bare(e)}~"
        table |= {e: spaced, e.replace(SELECTOR, ""): spaced}
        if len(e) == 1:
            table |= {e + s: spaced for s in (*SKIN, SELECTOR)}
    table = {e: spaced for e, spaced in table.items() if not e.isascii() and e not in SKIN}
    return table | {"\U0001f9d1\u200d": "~\U0001f9d1~", SELECTOR: "", KEY_CAP: ""}


def build_trie(keys: Iterable[str]) -> dict:
    root: dict = {}
    for key in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[None] = True
    return root


def find_spans(trie: dict, text: str) -> list[tuple[int, int]]:
    """Longest matches from left to right. A failure after some progress starts again where it stopped, not one further
    than it began; a match or stop of two characters or more that ends in '~' leaves that '~' for the next."""
    spans, begin, at, stop, node = [], 0, 0, 0, trie
    while at < len(text):
        if text[at] in node:
            node = node[text[at]]
            at += 1
            if None in node:
                stop = at
            continue
        node = trie
        if stop > begin:
            spans.append((begin, stop))
            reach = stop
        else:
            reach = at
        if reach == begin:
            reach += 1
        elif reach - begin >= 2 and text[reach - 1] == "~":
            reach -= 1
        begin = at = stop = reach
    return [*spans, (begin, stop)] if stop > begin else spans


def replace_spans(table: dict[str, str], trie: dict, text: str) -> str:
    spans = find_spans(trie, text)
    if not spans:
        return text
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a], table.get(text[a:b], text[a:b])]
        last = b
    return re.sub("~{2,}", "~", "".join([*out, text[last:]]))


def replace_emojis(spark: SparkSession, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(emoji_table(spark))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        table = shared.value
        trie = build_trie(table)
        return s.map(lambda x: x if x is None or x.isascii() else replace_spans(table, trie, x))

    return run(text)
