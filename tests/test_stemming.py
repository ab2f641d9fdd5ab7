"""Stems against published examples and a plain version of the same rules;
accents folded; phrases in raw texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dictgraph.functions.stemming import STEP_2, STEP_3, STEP_4, with_stems
from dictgraph.functions.tokens import fold_accents
from dictgraph.operators import search as S
from dictgraph.operators.search import phrase_search_texts, stemmed, text_index, text_index_frame, text_search
from tests.fixtures import make_terms, req
from tests.test_plans import plan

# Examples from Porter's 1980 paper, words and their stems.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def plain_stem(word):
    """The same rules letter by letter."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word

    def vowel(w, i):
        return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))

    def m(w):
        return len(re.findall("v+c+", "".join("v" if vowel(w, i) else "c" for i in range(len(w)))))

    def short(w):
        return len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1) and not vowel(w, len(w) - 2)

    def has_vowel(w):
        return any(vowel(w, i) for i in range(len(w)))

    w = word
    for s, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: -len(s)] + by
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                w = w[: -len(s)] + table[s] if m(w[: -len(s)]) > 0 else w
                break
    for s in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if m(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w) > 1:
        w = w[:-1]
    return w


def test_published_examples(spark):
    df = spark.createDataFrame([(w,) for w in EXAMPLES[::2]], "token string")
    got = {r.token: r.stem for r in with_stems(df).collect()}
    assert [(w, got[w]) for w in EXAMPLES[::2]] == list(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    assert all(plain_stem(w) == s for w, s in zip(EXAMPLES[::2], EXAMPLES[1::2]))


def test_random_words_against_the_plain_version(spark):
    rng = random.Random(11)
    ends = [*STEP_2, *STEP_3, *STEP_4, "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "yy", "e", "ll", "ying", "tted", ""]
    words = {"".join(rng.choices("aeiouybdlstwxz", k=rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(ends) for _ in range(4000)}
    words |= {"as", "y", "aping", "yes", "sayyid", "x1ing", "über", "ed", "ing", "", "a b"}
    got = {r.token: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert {w: s for w, s in got.items() if s != plain_stem(w)} == {}
    assert with_stems(spark.createDataFrame([(None,)], "token string")).collect()[0].stem is None


def test_stemmed_search(spark):
    docs = [("a", "Relational operators were conflated"), ("b", "a relation and an operation"), ("c", "nothing"), ("d", None)]
    index = stemmed(text_index_frame(spark.createDataFrame(docs, "doc string, text string"), "doc", "text"))
    q = req(spark, [(1, "relate"), (2, "operating relations"), (3, "conflating"), (4, "relational operator")], "query_id int, text string")
    assert {tuple(r) for r in text_search(index, q, "all", stem=True).collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "b")}
    assert {tuple(r) for r in text_search(index, q, "phrase", stem=True).collect()} == {(1, "a"), (1, "b"), (3, "a"), (4, "a")}
    with pytest.raises(ValueError):
        text_search(index, q, "phrase", stem=True, pairs=index)


def test_accents_are_folded(spark):
    values = ["México", "México", "ÅNGSTRÖM", "Łódź straße ø", "Ελλάδα", "plain", "", None, "日本 é"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(fold_accents("v")).collect()] == ["Mexico", "Mexico", "ANGSTROM", "Łodz straße ø", "Ελλαδα", "plain", "", None, "日本 e"]
    terms = make_terms(spark, [{"_code": {"_gid": "mx"}, "_info": {"_title": {"ISO_639_3_eng": "Estados Unidos de México"}}}])
    q = req(spark, [(1, "mexico"), (2, "MÉXICO"), (3, "de mexico")], "query_id int, text string")
    assert {r.query_id for r in text_search(text_index(terms, fold=True), q, "phrase", fold=True).collect()} == {1, 2, 3}
    assert {r.query_id for r in text_search(text_index(terms), q, "phrase").collect()} == {2}


def test_raw_phrases_carry_no_text_beside_exploded_words(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=rng.randrange(40)))) for i in range(150)] + [(7, "w1 w2 w3"), (8, None)]
    queries = [(i, " ".join(rng.choices([f"w{k}" for k in range(42)], k=rng.randrange(4)))) for i in range(60)]
    df, q = spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame(queries, "query_id int, text string")
    want = {(i, d) for i, p in queries if p for d, t in texts if t is not None and f" {p} " in f" {t} "}
    plans = []
    cut = S.cut_lineage_observed
    monkeypatch.setattr(S, "cut_lineage_observed", lambda d, **k: (plans.append(plan(d)), cut(d, **k))[1])
    for most in (S.MAX_PUSHED_TOKENS, 3):  # below and above the tokens that are pushed
        monkeypatch.setattr(S, "MAX_PUSHED_TOKENS", most)
        assert {tuple(r) for r in phrase_search_texts(df, q, "doc", "text").collect()} == want
    for text in plans[::2]:  # the plans with the exploded words
        generate = [b for b in text.split("\n\n") if b.strip() and "Generate" in b.strip().splitlines()[0]]
        assert generate and all(re.search(r", \[doc#\d+, at#\d+L\], false, \[token", b) for b in generate), generate
