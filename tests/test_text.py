"""Normalisation, tokens, emoticons and emojis against worked examples and plain-Python state machines."""

import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glyphweave.config import TextConfig, code
from glyphweave.functions import emoji
from glyphweave.functions.normalize import PUNCTUATION, decomposed, norm_chars, normalized
from glyphweave.functions.tokens import tokenized, tokenized_parts

CFG = TextConfig()


def norm(spark, texts, **changes):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.norm for r in normalized(d, replace(CFG, **changes)).orderBy("doc_id").collect()]


def tokens(spark, texts, **changes):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.tokens for r in tokenized(d, replace(CFG, **changes)).orderBy("doc_id").collect()]


@pytest.mark.parametrize("x", ["1", ".1", "1.", "1.1", "10", "10.0"])
def test_numbers(spark, x):
    assert norm(spark, [f"tok {x} tok"]) == ["~tok~_num~tok~"]


def test_examples(spark):
    assert norm(spark, ["hola h adios", "hola 'adios'", None, "", "1.2.3 abc12"]) == ["~hola~h~adios~", "~hola~adios~", "~~", "~~", "~_num_num~abc_num~"]
    assert norm(spark, ["see http://a.b/12 me@x.org #Tag"], hashtag_option="group") == ["~see~_url~me_usr~_htag~"]
    assert norm(spark, ["I met Ana and @bob #x"], select_ent=True, usr_option="none") == ["~ana~bob~#x~"]
    assert norm(spark, ["I met Ana"], ent_option="group") == ["~i~met~_ent~"]


def state_machine(text, diac, dup, punc):
    out, prev = [], "~"
    for c in unicodedata.normalize("NFD", text):
        if diac and 0x300 <= ord(c) <= 0x36F:
            continue
        if c in "\n\r \t ":
            c = "~"
        elif dup and c == prev:
            continue
        elif punc and c in PUNCTUATION:
            prev = c
            continue
        out.append(c)
        prev = c
    return "~" + "".join(out) + "~"


def test_characters_against_a_state_machine(spark):
    texts = ["Life is good at Méxicoo.", "a,a aa  b", "~~x ~y", "ééé ñ́", "\U0001f600\U0001f600!!", "..a..", "\t\t x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decomposed(F.col("t")).alias("n"))
    for diac in (False, True):
        for dup in (False, True):
            for punc in (False, True):
                got = {r.t: r.x for r in d.select("t", norm_chars(F.col("n"), diac, dup, punc).alias("x")).collect()}
                assert got == {t: state_machine(t, diac, dup, punc) for t in texts}, (diac, dup, punc)


def test_tokens(spark):
    assert tokens(spark, ["Someone's house.", None, "!!"]) == [["someones", "house"], ["~"], ["~"]]
    assert tokens(spark, ["Someone's house."], del_punc=False) == [["someone", "s", "house"]]
    assert tokens(spark, ["a b c d"], token_list=(-2, (2, 1), -1)) == [["a~b", "b~c", "c~d", "a", "b", "c", "d", "a~c", "b~d"]]
    assert tokens(spark, ["ab \U0001f600"], token_list=(3,)) == [["q:~ab", "q:ab~", "q:b~\U0001f600", "q:~\U0001f600~"]]
    assert tokens(spark, ["ab cd"], token_list=(3,), q_grams_words=True) == [["q:~ab", "q:ab~", "q:~cd", "q:cd~"]]
    assert tokens(spark, ["a b"], token_list=(-3, 9)) == [["~"]]


def test_many_skipgrams(spark):
    text = " ".join("abcdefghijklmno")
    (got,) = tokens(spark, [text], token_list=((2, 1), (2, 2), -1))
    assert len(got) == 40 and got[:15] == text.split() and got[15] == "a~c" and got[28] == "a~d"


def test_parts(spark):
    d = spark.createDataFrame([(1, ["a b", None, "c"]), (2, []), (3, None)], "doc_id long, parts array<string>")
    got = {r.doc_id: r.tokens for r in tokenized_parts(d, replace(CFG, token_list=(-2, -1)), "parts").collect()}
    assert got == {1: ["a~b", "a", "b", "~", "c"], 2: [], 3: []}


def test_emoticons(spark):
    t = emoji.EmoticonTable()
    assert t.replace("so :) good", "group") == "so _pos good"
    assert t.replace("ends :)", "group") == "ends :)"
    assert t.replace("LOL this", "group") == "_pos this" and t.replace("lol x", "delete") == " x"
    assert norm(spark, ["ok :( then"], emo_option="group") == ["~ok~_neg~then~"]


def test_find_spans():
    trie = emoji.build_trie(["mario", "ma", "g", "marx"])
    text = "maxmarxgmlr"
    assert [text[a:b] for a, b in emoji.find_spans(trie, text)] == ["ma", "marx", "g"]


def test_emojis(spark):
    got = norm(spark, ["\U0001f923\U0001f923 bla x \U0001f923", "\U0001f44f\U0001f3fb"], norm_emojis=True)
    assert got == ["~\U0001f923~\U0001f923~bla~x~\U0001f923~", "~\U0001f44f~"]
    assert emoji.code_points("26BD") == "⚽" and len(emoji.code_points("2753..2755")) == 3 and len(emoji.code_points("1F4EA FE0E")) == 2
    held = emoji.read_emoji_lines(["# c", "26BD ; Emoji # ball", "no mark ; x", "2753..2754 ; Basic # q"])
    assert held == {"⚽": ["Emoji"], "❓": ["Basic"], "❔": ["Basic"]}


def test_config_round_trip():
    c = replace(CFG, token_list=(-1, [2, 1], 3))
    assert TextConfig.from_dict({**c.to_dict(), "_score": 1}) == c
    assert c.ngrams == [1] and c.skipgrams == [(2, 1)] and c.qgrams == [3]
    assert code({"b": 1, "a": 2, "_x": 3}) == "a=2-b=1"
