"""What grows with the tables stays small: tasks, repeated chunks, and the memory of a block product."""

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeframe.functions import text as tx
from lodeframe.functions.arrays import BLOCK, running
from lodeframe.operators import chunking, embedding, retrieval, vectors
from lodeframe.plans import views as v
from lodeframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_code_view_uses_all_cores(spark):
    """One small file of parts is costly work for every core."""
    assert v.code(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_memory_of_a_block_product():
    """A full pair of blocks needs no matrix of all products; the nearest are those of the plain product."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(20_000, 16)), rng.normal(size=(2_000, 16))
    a[5] = a[9] = a[7]
    b[3] = a[7]
    table = lambda key, name, rows: pa.table({key: pa.array(np.arange(len(rows))), name: pa.array(rows.tolist(), pa.list_(pa.float64()))})
    left, right = table("vec_id", "_v", a), table("query_id", "_q", b)
    tracemalloc.start()
    got = vectors._nearest(8, None, "vec_id", 12)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    found = {}
    for q, key, d in zip(*(c.to_pylist() for c in got.columns)):
        found.setdefault(q, []).append((round(d, 12), key))
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    for q in range(0, 2_000, 97):
        d = np.round(1 - unit @ (b[q] / np.linalg.norm(b[q])), 10)
        assert [k for _, k in sorted(found[q])][:8] == sorted(range(len(d)), key=lambda i: (d[i], i))[:8]
    assert sorted(found[3])[0][1] == 5 and len(found[3]) == 8


def test_copies_and_zero_vectors_give_k_rows_of_a_block(spark):
    """Ties go to the smaller key inside the block already, vectors without a distance too."""
    rows = pa.table({"vec_id": pa.array(range(3000)), "_v": pa.array([[1.0, 0.0]] * 1500 + [[0.0, 0.0]] * 1500)})
    asked = pa.table({"query_id": pa.array([1, 2]), "_q": pa.array([[1.0, 0.0], [0.0, 0.0]])})
    got = vectors._nearest(4, None, "vec_id", 12)(rows, asked).to_pylist()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(q, k) for q in (1, 2) for k in range(4)]


def test_chunks_are_not_shuffled_for_their_words(spark):
    """Ranks from texts are those of all postings, for questions of any length, repeated ones and areas too."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(150)]
    rows = [(f"c{i:03}", f"{'ab'[i % 2]}/x{i}", " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(240)]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, text string")
    asked = [(i, rows[i * 3][2] if i % 2 else " ".join(rows[i][2].split()[:2])) for i in range(60)]
    asked += [(100, asked[2][1]), (101, " ".join(reversed(asked[2][1].split()))), (102, "nowhere w1"), (103, "")]
    queries = spark.createDataFrame(asked, "query_id bigint, query_text string")
    terms = retrieval.query_terms(queries)
    shown = lambda df: {(r["query_id"], r["krank"], r["chunk_id"], round(r["rank"], 9)) for r in df.collect()}
    every = shown(retrieval.keyword_topk(retrieval.postings(chunks), terms, 5))
    assert len(every) > 60 and shown(retrieval.text_topk(chunks, terms, 5)) == every
    areas = queries.selectExpr("query_id", "CASE WHEN query_id % 3 = 0 THEN 'A/' WHEN query_id % 3 = 1 THEN NULL ELSE 'none/' END AS prefix")
    inside = shown(retrieval.keyword_topk(retrieval.postings(chunks.where("path LIKE 'a/%'")), terms, 5))
    want = {r for r in every if r[0] % 3 == 1} | {r for r in inside if r[0] % 3 == 0}
    assert shown(retrieval.text_topk(chunks, terms, 5, areas)) == want
    plan = retrieval.text_topk(chunks, terms, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_an_area_is_one_list_for_all_its_questions(spark):
    """A chunk is repeated for the prefixes of its path, not for the questions that share them."""
    index = spark.createDataFrame([(f"c{i}", f"{'ab'[i % 2]}/x{i}", [(i % 5, 1.0), (7, 0.5)]) for i in range(40)], "chunk_id string, path string, vector array<struct<bucket:int,weight:double>>")
    asked = spark.createDataFrame([(q, (None, "A/", "none/")[q % 3], [(q % 5, 1.0)]) for q in range(30)], "query_id bigint, prefix string, vector array<struct<bucket:int,weight:double>>")
    seen, real = [], vectors.block_topk
    try:
        vectors.block_topk = lambda left, *a, **k: (seen.append(left.count()), real(left, *a, **k))[1]
        got = retrieval.prefix_vector_topk(index, asked, 4, 8).collect()
    finally:
        vectors.block_topk = real
    assert seen == [60]
    near = lambda q: [f"c{i}" for i in sorted(range(40), key=lambda i: f"c{i}") if i % 5 == q % 5 and (q % 3 == 0 or i % 2 == 0)][:4]
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["vrank"])):
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert found == {q: near(q) for q in range(30) if q % 3 != 2}


def test_running_states_of_a_long_array_cost_what_many_short_ones_do(spark):
    """A fold copies what it holds: held states must not grow with the array. Values at every level's limits are right."""
    total = lambda xs: running(xs, F.lit(0), lambda a, x: a + x, "bigint")
    for n in (0, 1, BLOCK, BLOCK + 1, BLOCK**2 + 1, BLOCK**3 + 1):
        xs = [i % 7 for i in range(n)]
        assert spark.range(1).select(total(F.array_repeat(F.lit(0), 0).cast("array<bigint>") if not n else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 7)).alias("r")).first()["r"] == list(itertools.accumulate(xs))

    def seconds(rows: int, n: int) -> float:
        began = time.perf_counter()
        made = F.sequence(F.col("id") * 0, F.lit(n - 1).cast("bigint"))
        assert spark.range(0, rows, 1, 1).select(F.element_at(total(made), -1).alias("r")).agg(F.max("r")).first()[0] == n * (n - 1) // 2
        return time.perf_counter() - began

    seconds(4, 20_000)
    assert seconds(1, 600_000) < 4 * seconds(30, 20_000) + 1


def test_blocks_are_ranked_slot_by_slot(spark, monkeypatch):
    """Questions and chunks that hold their terms are no rows of a plan; ties are cut by chunk_id, ranks are the covers'."""
    rows = [(f"d{i}", f"c{i:03}", "a b " * (i % 3) + "b x a " + f"w{i % 7}") for i in range(120)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "w3 a b"), (4, "w3 w4"), (5, "x nowhere")], "query_id bigint, query_text string")
    terms = retrieval.query_terms(queries)
    shown = lambda df: {(r["query_id"], r["krank"], r["chunk_id"], round(r["rank"], 9)) for r in df.collect()}
    want = shown(retrieval.keyword_topk(retrieval.postings(chunks), terms, 5))
    assert {q for q, *_ in want} == {1, 2, 3}
    monkeypatch.setattr(retrieval, "and_matches", None)
    assert shown(retrieval.block_topk(retrieval.posting_blocks(chunks, 8), terms, 5)) == want


def test_hits_that_two_branches_use_are_made_once(spark):
    """What is left to do after the hits were written joins no vectors any more."""
    for name in ("supporting_matches", "search_summary"):
        assert "FlatMapCoGroups" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_symbols_that_three_branches_use_are_made_once(spark):
    assert "interface" not in QUERIES["hard_delete_cascade"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_selection_sees_no_texts(spark, monkeypatch):
    """Candidates are scored and chosen by their chunks' keys; texts join the hits that are taken, by any of the joins."""
    seen, real = [], retrieval.greedy
    monkeypatch.setattr(retrieval, "greedy", lambda fused, o: (seen.append(set(fused.columns)), real(fused, o))[1])
    shown = lambda: {(r["query_id"], r["rank"], r["chunk_id"], r["text"], r["snippet"]) for r in v.hits(spark, SF).collect()}
    want = shown()
    monkeypatch.setattr(retrieval, "FEW_ROWS", 1)
    assert want and shown() == want
    monkeypatch.setattr(retrieval, "FEW_KEYS", 1)
    assert shown() == want
    assert len(seen) == 3 and all("text" not in columns for columns in seen)


def test_a_word_is_hashed_once_for_a_worker(spark, monkeypatch):
    asked, real = [], embedding._bucket
    monkeypatch.setattr(embedding, "_bucket", lambda w, dim: (asked.append(w), real(w, dim))[1])
    count = embedding._counted(8)
    assert count(pa.array([["b", "a", "b"], None, []])).to_pylist()[1:] == [[], []] and count(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    count(pa.array([["a", "b"]] * (embedding.ROWS + 1)))
    assert sorted(asked) == ["a", "b"]
    monkeypatch.undo()
    texts = spark.createDataFrame([(1, "One two, one"), (2, None), (3, "..."), (4, "Ünï_x 中 " * 3)], "id int, text string")
    dense = {r["id"]: r["v"] for r in texts.select("id", embedding.hash_vector(F.coalesce("text", F.lit(""))).alias("v")).collect()}
    for r in embedding.hash_vectors(texts, ["id"]).collect():
        assert [(x["bucket"], x["weight"]) for x in r["vector"]] == [(i, x) for i, x in enumerate(dense[r["id"]]) if x]


def test_windows_of_a_long_text_cost_what_those_of_short_ones_do(spark):
    made = lambda df, size, overlap: df.select(F.transform(chunking.fixed_windows(F.col("text"), size, overlap), lambda c: c["body"]).alias("w"))
    for text in ("ab\nç𝒳\r\nde" * 7, "x", "abcd"):
        for size, overlap in ((4, 1), (5, 4), (5, 0), (12, 3)):
            step = size - overlap
            want = [text[i : i + size] for i in range(0, max(-(-(len(text) - overlap) // step), 1) * step, step)]
            assert made(spark.createDataFrame([(text,)], "text string"), size, overlap).first()["w"] == want

    def seconds(rows: int, n: int) -> float:
        texts = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("word "), F.lit(n) + (F.col("id") % 1).cast("int")).alias("text"))
        began = time.perf_counter()
        made(texts, 1200, 300).select(F.size("w")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(4, 10_000)
    assert seconds(1, 1_600_000) < 4 * seconds(160, 10_000) + 1


def test_only_newlines_are_trimmed(spark):
    """As SQL's trim: a line end behind the last newline keeps it."""
    assert spark.createDataFrame([("\n\na\n\r",), ("\nb\n\n",)], "t string").select(tx.trim_newlines(F.col("t")).alias("r")).collect() == [("a\n\r",), ("b",)]
