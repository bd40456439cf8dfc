"""Inverted lists and posting blocks against exact search: same ranks, fewer files, lists and blocks read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import retrieval, vectors
from lodeframe.plans.registry import QUERIES
from lodeframe.sources.store import Store

SF = "/root/testdata/sf0.01"


def pairs(df, key="vec_id"):
    return {(r["query_id"], r[key]) for r in df.collect()}


def test_recall_of_inverted_lists(spark):
    exact = pairs(QUERIES["vector_topk"](spark, SF).where("rn <= 10"))
    found = pairs(QUERIES["vector_probe_topk"](spark, SF))
    assert len(exact & found) >= 0.95 * len(exact)


def test_lists_of_clusters(spark):
    """Clustered vectors need few lists: recall with an eighth of them, and only probed lists are read."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(16, 24))
    rows = [(i, (middle[i % 16] + 0.15 * rng.normal(size=24)).tolist()) for i in range(1600)] + [(9001, [0.0] * 24), (9002, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = vectors.fit_lists(df, lists=16)
    assert np.array_equal(centres, vectors.fit_lists(df.repartition(3), lists=16))
    index = vectors.assign(df, centres)
    assert index.count() == len(rows)
    found = pairs(vectors.probe_topk(index, asked, centres, 10, 2))
    exact = pairs(vectors.exact_topk(df, asked, 10))
    assert len(exact & found) >= 0.95 * len(exact)
    one = asked.limit(1)
    assert vectors.probed(index, one, centres, 2).select("list").distinct().count() <= 2


@pytest.mark.parametrize("blocks", [(7, 3), (20_000, 2_000)])
def test_blocks_of_both_sides(spark, monkeypatch, blocks):
    """Any block sizes give the exact nearest, ties to the smaller key; empty sides give nothing."""
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    data = rng.integers(-1, 2, size=(40, 3)).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rn"]): r["vec_id"] for r in vectors.exact_topk(df, asked, 4).collect()}
    with np.errstate(invalid="ignore"):
        unit = data / np.linalg.norm(data, axis=1)[:, None]
    for q in range(9):
        order = sorted(range(40), key=lambda i: (np.inf if np.isnan(d := 1 - unit[i] @ unit[q]) else round(d, 12), i))
        assert [got[q, n] for n in range(1, 5)] == order[:4]
    assert vectors.exact_topk(df.limit(0), asked, 3).count() == 0 and vectors.exact_topk(df, asked.limit(0), 3).count() == 0


def chunks_of(spark, n=400):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    rows = [(f"d{i // 3}", f"c{i:04}", " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, chunk_id string, text string")


def test_posting_blocks(spark):
    """The ranks of all postings, for questions of one to twelve words, inside documents or not."""
    rng = random.Random(3)
    chunks = chunks_of(spark).cache()
    some = [r["text"].split() for r in chunks.collect()]
    asked = [(i, " ".join(rng.choices(rng.choice([s for s in some if s]), k=1 + i % 12))) for i in range(24)] + [(50, "nowhere w1"), (51, ""), (52, "W1 w1 w2")]
    terms = retrieval.query_terms(spark.createDataFrame(asked, "query_id bigint, query_text string"))
    blocks = retrieval.posting_blocks(chunks, 32).cache()
    shown = lambda df: {(r["query_id"], r["krank"], r["chunk_id"], round(r["rank"], 9)) for r in df.collect()}
    every = shown(retrieval.keyword_topk(retrieval.postings(chunks), terms, 5))
    assert len(every) > 40 and shown(retrieval.block_topk(blocks, terms, 5)) == every
    within = chunks.where("doc_id < 'd5'").select("doc_id").distinct()
    scoped = shown(retrieval.keyword_topk(retrieval.postings(chunks.join(within, "doc_id")), terms, 5))
    assert shown(retrieval.block_topk(blocks, terms, 5, within)) == scoped
    areas = spark.createDataFrame([(q, "d1") for q, _ in asked if q % 2 == 0] + [(q, f"d{k}") for q, _ in asked for k in range(60, 90)], "query_id bigint, doc_id string")
    found = shown(retrieval.block_topk(blocks, terms, 5, areas))
    allowed = {(r["query_id"], r["doc_id"]) for r in areas.collect()}
    doc = {r["chunk_id"]: r["doc_id"] for r in chunks.collect()}
    full = [(r["query_id"], r["chunk_id"], round(r["rank"], 9)) for r in retrieval.keyword_topk(retrieval.postings(chunks), terms, 10_000).collect()]
    want = set()
    for q, _ in asked:
        own = sorted(((-rank, c) for qq, c, rank in full if qq == q and (q, doc[c]) in allowed))[:5]
        want |= {(q, k + 1, c, -rank) for k, (rank, c) in enumerate(own)}
    assert found == want


def test_blocks_that_are_not_opened(spark):
    """Of a term that is rare in most slots and frequent in one, only slots that may reach the k-th rank are opened."""
    rows = [(f"d{i}", f"c{i:04}", "filler rare word") for i in range(300)] + [(f"e{i}", f"x{i}", "rare " * 9) for i in range(12)]
    blocks = retrieval.posting_blocks(spark.createDataFrame(rows, "doc_id string, chunk_id string, text string"), 64)
    terms = retrieval.query_terms(spark.createDataFrame([(1, "rare")], "query_id bigint, query_text string"))
    bounds = {r["slot"]: r["bound"] for r in retrieval.block_bounds(blocks, terms).collect()}
    high = [s for s, b in bounds.items() if b >= 9]
    assert len(bounds) > 50 and len(high) <= 12
    top = retrieval.block_topk(blocks, terms, 3).collect()
    assert sorted(r["chunk_id"] for r in top) == ["x0", "x1", "x10"] and all(abs(r["rank"] - 9) < 1e-9 for r in top)


def test_files_read_fall_with_the_terms(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.commit({"postings": retrieval.posting_blocks(chunks_of(spark), store.slots())})
    asked = lambda *ws: spark.createDataFrame([(w,) for w in ws], "token string")
    files = lambda *ws: len(store.read("postings", parts=store.parts_of("postings", asked(*ws), "token")).inputFiles())
    every = len(store.read("postings").inputFiles())
    assert files("w1") <= every / 4 and files("w1") <= files("w1", "w2", "w3") < every
