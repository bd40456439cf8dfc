"""Long words and many matches, large families, parts of buckets, many rules, held-out figures: against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import jaccard, packing, pii, registry, secret_scan, spans, substrings, toxicity, urls

from .test_operators import classes, kept, pii_spans, rows, same, secret_spans, spans_of, sha
from .fixtures import tables

DATA = "/root/testdata/sf0.1"


def written(spark, path, given):
    spark.createDataFrame(given, "doc_id bigint, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def long_words():
    """Texts that differ in nothing but the order of blocks inside long words, or in Thue-Morse words."""
    rng = random.Random(4)
    x, y = ("".join(rng.choice("abcdefgh") for _ in range(4096)) for _ in range(2))
    odd = [x + y, y + x, thue_morse(2048, 0), thue_morse(2048, 1), thue_morse(64, 0), thue_morse(64, 1), thue_morse(65, 0), thue_morse(65, 1)]
    tail = " ".join(f"w{i}" for i in range(20))
    return [(i, w) for i, w in enumerate(odd)] + [(20 + i, " ".join([w] * 13)) for i, w in enumerate(odd)] + [(40 + i, f"{w} {tail}") for i, w in enumerate(odd)]


@pytest.mark.parametrize(("name", "brute"), [("op9_jaccard", classes), ("op10_substrings", kept)])
def test_long_words(spark, tmp_path, name, brute):
    docs = long_words()
    same([tuple(r) for r in rows(spark, written(spark, tmp_path, docs), name)], brute(docs))


def test_alternating_windows_have_their_own_hashes():
    from lodeframe.llm.wordhash import Block, windows

    for n in (8, 13):
        a, b = (" ".join("xy"[(i.bit_count() + f) % 2] for i in range(n)).encode() for f in (0, 1))
        for which in (0, 1):
            assert windows(Block(a).words(which), n, which)[0] != windows(Block(b).words(which), n, which)[0]


def family():
    """A large family of sets around one, some beyond its reach, and others with a very common passage."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(70)]
    out = []
    for _ in range(600):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            own[rng.randrange(70)] = rng.choice(words)
        out.append(" ".join(own[: rng.choice([50, 60, 70, 70])]))
    passage = "this passage stands in very many of the texts here"
    for _ in range(200):
        own = [rng.choice(words) for _ in range(rng.choice([2, 6, 25]))]
        out += [" ".join([*own, passage]), " ".join([passage, *own])]
    return list(enumerate(out))


def test_large_family(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 24)
    docs = family()
    same([tuple(r) for r in rows(spark, written(spark, tmp_path, docs), "op9_jaccard")], classes(docs))


def test_buckets_in_parts(spark, tmp_path, monkeypatch):
    docs = family()[:300]
    want = list(kept(docs))
    taken = []
    for most in (7, 3_000_000):
        monkeypatch.setattr(substrings, "MAX_WINDOWS", most)
        sort = substrings._sort(13)
        dealt = [b for part in (docs[::2], docs[1::2]) for b in substrings._deal(4, 13, 4)(batches(part))]
        whole = batch_by_bucket(dealt)
        cut = collections.defaultdict(set)
        for b in sort(iter(whole)):
            for d, a, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                cut[d].update(range(a, e))
        taken.append({d: len(c) for d, c in cut.items()})
    assert taken[0] == taken[1] == {d: n for d, _, n, _ in want if n}


def batches(part):
    import pyarrow as pa

    return iter([pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part])], names=["doc_id", "t"])])


def batch_by_bucket(found):
    import pyarrow as pa

    return pa.Table.from_batches(found).sort_by("bucket").to_batches()


def test_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    text = " ".join(f"u{i}@b.cd" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = pii.find_pii(df).select(F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("end")).first()
    assert (found["n"], found["end"]) == (n, len(text))
    assert pii.redact(df).first()["text"] == " ".join(["[EMAIL]"] * n)
    secrets = " ".join(f"token=abcdef{i}" for i in range(n // 2))
    found = secret_scan.find_secrets(spark.createDataFrame([(1, secrets)], "doc_id bigint, text string"), ["doc_id"]).select(F.size("spans").alias("n")).first()
    assert found["n"] == n // 2


def test_spans_apart(spark):
    rng = random.Random(3)
    kind = "struct<start:bigint,end:bigint>"
    made = []
    for i in range(300):
        draw = lambda: sorted((a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 9))))
        made.append((i, draw(), draw()))
    df = spark.createDataFrame(made, f"i int, a array<{kind}>, b array<{kind}>")
    for r in df.select("a", "b", spans.apart(F.col("a"), F.col("b"), kind).alias("c")).collect():
        assert sorted(map(tuple, r["c"])) == sorted(tuple(x) for x in r["a"] if not any(y[0] < x[1] and x[0] < y[1] for y in r["b"]))


def luhn(t):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed([int(c) for c in t if c.isdigit()]))) % 10 == 0


def added_pii(t):
    """What the method adds to the base spans of a text: (start, end, kind)."""
    near = lambda m, ends, words: re.search(words, f"{t[max(ends[0], m.start() - 48):m.start()].lower()} {t[m.end():min(ends[1], m.end() + 32)].lower()}")
    base = pii_spans(t)
    out = []
    for kind in pii.ADDED:
        found = list(re.finditer(kind.pattern, t))
        edges = [0, *(m.end() for m in found)], [*(m.start() for m in found), len(t)]
        for i, m in enumerate(found):
            if kind.name == "iban":
                bare = m[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
                    continue
            if kind.name == "card_13" and not luhn(m[0]):
                continue
            score = pii.PRIOR[kind.name] + (pii.CONTEXT_BONUS if near(m, (edges[0][i], edges[1][i + 1]), pii.WORDS[kind.name]) else 0)
            if min(1, score) >= pii.MIN_SCORE - 1e-9 and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                out.append((m.start(), len(pii.BASE) + pii.ADDED.index(kind), m.end(), kind.name))
    return out


def test_every_column_of_op1_and_op3(spark, tmp_path_factory):
    sf = tables(spark, tmp_path_factory.mktemp("columns"))
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000 + i, t) for i, t in enumerate(["call me on my phone 555-010-9999 or 555-010-1234x", "ssn 123-45-6789, social", "123-45-6789", "card 4222222222222 pay", "4222222222222", "konto GB82 WEST 1234 5698 7654 32.", "GB82WEST12345698765433"])]
    at = written(spark, tmp_path_factory.mktemp("docs"), docs)
    count = lambda found, kinds: [sum(x[3] == k for x in found) for k in kinds]
    want = [(d, *count(pii_spans(t), ("email", "ip", "card", "phone")), sha(spans_of(pii_spans(t))), spans_of(pii_spans(t) + added_pii(t))) for d, t in docs]
    same([tuple(r) for r in rows(spark, at, "op1_pii")], want)
    got = {r["doc_id"]: r for r in rows(spark, at, "op3_secrets")}
    for d, t in docs:
        base = secret_spans(t)
        if d is None:
            continue
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == count(base, ("assign", "access", "hex")) and got[d]["base_sha256"] == sha(spans_of(base))
        more = [s for s in got[d]["spans"].split(",") if s.startswith("random:")]
        tokens = {f"random:{m.start()}:{m.end()}" for m in re.finditer(secret_scan.TOKEN.pattern, t) if not any(s < m.end() and m.start() < e for s, _, e, _ in base)}
        assert set(more) <= tokens and set(got[d]["spans"].split(",")) - set(more) - {""} == set(spans_of(base).split(",")) - {""}


def battery(token):
    """The tests of one token, written down from the textbook: class and cell of its p-value."""
    import math

    bare = token.replace("-", "+").replace("_", "/").replace("=", "")
    name, form, alphabet, like = next(e for e in secret_scan.ENCODINGS if re.search(e[1], token))
    v = [alphabet.find(c) for c in (bare if name == "base64" else bare.lower())]
    n, a = len(v), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi2 = a * sum(c * c for c in collections.Counter(v).values()) / n - n
    expected = a + a * (n - 1) * like - n
    p = tail((expected - chi2) / math.sqrt(2 * (a - 1) + 4 * max(0, expected - (a - 1))))
    mean = sum(v) / n
    d = [x - mean for x in v]
    high = [x >= a / 2 for x in v]
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    n1 = sum(high)
    mr = 1 + 2 * n1 * (n - n1) / n
    vr = (mr - 1) * (mr - 2) / (n - 1)
    zr = (runs - mr) / math.sqrt(vr) if vr > 0 else 30
    zs = sum(x * y for x, y in zip(d, d[1:], strict=False)) / sum(x * x for x in d) * math.sqrt(n) if any(d) else 30
    random_ = 2 * tail(abs(zr)) >= secret_scan.REJECT and 2 * tail(abs(zs)) >= secret_scan.REJECT
    return n, p if random_ else 1.0


def test_battery_gives_the_textbook_p_values(spark):
    rng = random.Random(6)
    given = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 90))) for _, _, alphabet, _ in secret_scan.ENCODINGS for _ in range(25)] + ["ab" * 20, "a" * 30, "thequickbrownfoxjumpsoverthelazydog"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, match string").select("i", F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), "match").alias("s"))
    found = df.select("i", secret_scan._moments(secret_scan._encoded(F.col("s"))).alias("m")).select("i", secret_scan._tested(F.col("m")).alias("t")).collect()
    for r in found:
        n, p = battery(given[r["i"]])
        cell = min(secret_scan.CELLS, int(np.floor(-10 * np.log10(max(p, 1e-30)))))
        assert r["t"]["klass"] == min(int(np.log2(n)), secret_scan.MAX_CLASS) and abs(r["t"]["cell"] - cell) <= 1


def test_many_rules_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(["http://a.b.org/x/y", "http://org/", "http://zorg/x", "https://b.org/x", None, "no", "q://x.com/fr/1", "q://B.org/x/yz?"])], "page_id int, url string, html string")
    rules = (urls.Rule("allow", "org", "/"), urls.Rule("block", "b.org", "/x"), urls.Rule("allow", "a.b.org", "/x/y"), urls.Rule("block", "com", "/fr/"), *(urls.Rule("block", f"h{i}.net", "/") for i in range(30)))
    few = sorted(map(tuple, urls.judge(pages, rules).collect()))
    monkeypatch.setattr(urls, "INLINE_RULES", 0)
    assert sorted(map(tuple, urls.judge(pages, rules).collect())) == few and sum(r[3] is not None for r in few) == 5


def test_distrust_travels_far_backward(spark):
    """Each host of a chain links to the next one; only the last one is blocked. All before it are suspect."""
    page = lambda i: (i, f"http://h{i}.net/x", f'<a href="http://h{i + 1}.net/">' if i < 19 else "")
    pages = spark.createDataFrame([page(i) for i in range(20)], "page_id int, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, (urls.Rule("block", "h19.net", "/"),)).collect()}
    assert set(got.values()) == {"block"} and len(got) == 20


def test_other_token_files_are_left_to_tokenizers():
    import json

    import public_tokenizers

    with open(packing.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.fast_vocabulary(spec)
    spec["model"]["merges"][5], spec["model"]["merges"][6] = spec["model"]["merges"][6], spec["model"]["merges"][5]
    assert packing.fast_vocabulary(spec) is None
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        assert packing.fast_vocabulary(json.load(f)) is None


def test_held_out_toxicity(spark):
    """Figures on the documents whose labels the model never saw; the README repeats them."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = registry.QUERIES["op5_toxicity"](spark, DATA).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "toxic").collect()
    y, s = np.array([r["toxic"] for r in found]), np.array([r["score"] for r in found])
    above = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    hit = (s >= 0.5) & (y == 1)
    assert above > 0.95 and hit.sum() / y.sum() > 0.9 and hit.sum() / (s >= 0.5).sum() > 0.95


def test_long_labelled_texts_do_not_shrink_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 10)
    docs = spark.createDataFrame([(i, "x " * (8000 if i % 2 else 5)) for i in range(100)] + [(2, "again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(100)], "doc_id bigint, toxic int")
    found, (clean, _) = toxicity.training_sample(docs, labels)
    n = toxicity.open_labels(labels).count()
    assert len(found) == 10 and abs(clean - n / 10) < 1e-9
