"""Benchmark items made from templates: blocks that many items share, against brute force and in time."""

import random
import time

from lodeframe.llm import decontaminate
from lodeframe.llm.decontaminate import Scanner


def brute(items, doc, size=10):
    """Hit word numbers and the items with occurring windows, by trying all windows."""
    hit, names = set(), set()
    for name, own in items:
        n = min(size, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(doc) - n + 1 if own else 0):
            if tuple(doc[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                names.add(name)
    return hit, sorted(names)


def shown(scanner, doc):
    runs, names = scanner.hits(doc)
    return {i for a, b in runs for i in range(a, b)}, names


def test_templates_against_brute_force(monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT", 3)
    rng = random.Random(11)
    word = lambda: b"w%d" % rng.randrange(9)
    for seed in range(40):
        template = [b"t%d" % rng.randrange(4) for _ in range(rng.choice([5, 9, 10, 14, 21]))]
        items = [(str(i), [word() for _ in range(rng.randrange(6))] * (i % 2) + template + [word() for _ in range(rng.randrange(12))]) for i in range(14)]
        items += [("short", template[:4]), ("none", []), ("same", items[0][1])]
        scanner = Scanner([(n, b" ".join(t)) for n, t in items])
        for _ in range(6):
            doc = []
            for _ in range(5):
                own = rng.choice(items)[1]
                a = rng.randrange(len(own) + 1)
                doc += rng.choice([own, own[a:], own[:a], template, [word()] * 2])
            assert shown(scanner, doc) == brute(items, doc), (seed, doc)


def test_a_frequent_phrase_costs_little():
    """16,000 questions of one form and a document that holds its phrase 500 times without a hit."""
    rng = random.Random(12)
    phrase = b"which of the following statements is true about".split()
    items = [(str(i), b" ".join(phrase + [b"q%d" % rng.randrange(50_000) for _ in range(20)])) for i in range(16_000)]
    scanner = Scanner(items)
    doc = []
    for i in range(500):
        doc += phrase + [b"d%d" % (i * 20 + k) for k in range(12)]
    began = time.perf_counter()
    assert scanner.hits(doc) == ([], [])
    assert time.perf_counter() - began < 1
    runs, names = scanner.hits(doc[:100] + items[7][1].split() + doc[:50])
    assert runs == [(100, 128)] and names == ["7"]


def test_several_automata(spark, monkeypatch):
    """A benchmark beyond one automaton's bytes gives the same rows, one part on the driver at a time."""
    rng = random.Random(13)
    text = lambda n: " ".join(f"v{rng.randrange(30)}" for _ in range(n))
    items = [(i, text(14)) for i in range(30)] + [(90, None), (91, "short one")]
    docs = [(i, " ".join([text(20), items[i % 30][1], text(9), "short one" if i % 3 else ""]), "x") for i in range(40)] + [(None, None, "x"), (5, "", "y")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string, k string"), spark.createDataFrame(items, "item_id bigint, text string")
    run = lambda: (sorted(map(str, decontaminate.contamination(d, b).collect())), sorted(map(str, decontaminate.clean_documents(d, b).collect())))
    one = run()
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 400)
    several = run()
    assert [r.replace("'", "") for r in several[0]] == [r.replace("'", "") for r in one[0]] and several[1] == one[1] and len(one[1]) < len(docs)
