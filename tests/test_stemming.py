"""Stems and token classes against a plain Python version of the same published rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import stemming
from lodeframe.operators import retrieval
from lodeframe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def vowels(w):
    out = []
    for i, c in enumerate(w):
        out.append(c in "aeiou" or c == "y" and i > 0 and not out[i - 1])
    return out


def measure(w):
    runs = [k for k, _ in itertools.groupby(vowels(w))]
    return sum(1 for a, b in itertools.pairwise(runs) if a and not b)


def cvc(w):
    return len(w) > 2 and vowels(w)[-3:] == [False, True, False] and w[-1] not in "wxy"


def longest(w, ends):
    return max((e for e in ends if w.endswith(e) and len(w) > len(e)), key=len, default=None)


def porter(w):
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e):
                if any(vowels(w[: -len(e)])):
                    w = w[: -len(e)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and not vowels(w)[-1] and not vowels(w)[-2] and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and cvc(w):
                        w += "e"
                break
    if w.endswith("y") and any(vowels(w[:-1])):
        w = w[:-1] + "i"
    for table in (stemming.STEP2, stemming.STEP3):
        e = longest(w, table)
        if e and measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = longest(w, stemming.STEP4)
    if e and measure(w[: -len(e)]) > 1 and (e != "ion" or w[-4] in "st"):
        w = w[: -len(e)]
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def test_published_pairs():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat rational ration digitizer digit formality formal triplicate triplic electrical electr goodness good revival reviv adjustment adjust adoption adopt rate rate cease ceas controll control roll roll".split()
    assert {a: porter(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


def test_stems_of_all_words(spark):
    found = QUERIES["word_stems"](spark, SF).collect()
    assert len({r["token"] for r in found}) == len(found) > 1000
    assert [(r["token"], r["stem"]) for r in found if r["stem"] != porter(r["token"])] == []
    stems = ["", "a", "y", "by", "hop", "fall", "yell", "syzyg", "toy", "tr", "ee", "relat", "happ", "box", "snow", "buzz", "controll", "oat", "trouble", "triv", "probat", "ay", "eye", "yy"]
    ends = ["", "s", "es", "ed", "eed", "ing", "y", "ies", "ll", "e", "ion", "tion", "sion", *stemming.STEP2, *stemming.STEP3, *stemming.STEP4]
    made = sorted({a + b + c for a in stems for b in ends for c in ("", "s", "ed", "ing", "ly", "li", "e")} | {"été", "x1y", "naïves"})
    got = spark.createDataFrame([(w,) for w in made], "w string").select("w", stemming.stem(F.col("w")).alias("s")).collect()
    assert len(got) > 5000
    assert [(r["w"], r["s"]) for r in got if r["s"] != porter(r["w"])] == []


@pytest.mark.parametrize(
    ("text", "simple", "compound"),
    [
        ("Well-known up-to-date fact", "well known up to date fact", "well-known well known up-to-date up to date fact"),
        ("snake_case 3x", "snake case 3x", "snake case 3x"),
        ("see https://Example.org/a/b?q=1, now", "see https example org a b q 1 now", "see example.org/a/b?q=1 example.org /a/b?q=1 now"),
        ("at example.org.", "at example org", "at example.org"),
        ("open /usr/local/lib/x.py and ./a/b", "open usr local lib x py and a b", "open /usr/local/lib/x.py and ./a/b"),
        ("- -- / a-", "a", "a"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_token_classes(spark, text, simple, compound):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*(stemming.tokens(F.col("t"), c).alias(c) for c in ("simple", "compound"))).first()
    assert got["simple"] == (None if simple is None else simple.split())
    assert got["compound"] == (None if compound is None else compound.split())


def test_unknown_config():
    with pytest.raises(ValueError, match="text configuration"):
        stemming.tokens(None, "klingon")


def test_index_and_question_are_cut_alike(spark):
    chunks = spark.createDataFrame([("d1", "c1", "Relational stores were motoring on"), ("d2", "c2", "a well-known rational plan"), ("d3", "c3", "known plans, but well hidden"), ("d4", "c4", None)], "doc_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(1, "relate motor"), (2, "well-known"), (3, "plans"), (4, None)], "query_id bigint, query_text string")

    def found(config):
        terms = retrieval.query_terms(asked, config=config)
        plain = retrieval.keyword_topk(retrieval.postings(chunks, config=config), terms, 5)
        blocks = retrieval.block_topk(retrieval.posting_blocks(chunks, 4, config=config), terms, 5)
        one, two = ({(r["query_id"], r["chunk_id"]) for r in df.collect()} for df in (plain, blocks))
        assert one == two
        return one

    assert found("simple") == {(2, "c2"), (2, "c3"), (3, "c3")}
    assert found("compound") == {(2, "c2"), (3, "c3")}
    assert found("english") == {(1, "c1"), (2, "c2"), (3, "c2"), (3, "c3")}
