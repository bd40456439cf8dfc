"""Text functions and chunkers against short Python versions of what they are to do."""

import random
import re
import uuid

from pyspark.sql import functions as F

from lodeframe.functions import text as tx
from lodeframe.operators import chunking, symbols


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_uuid5_like_python(spark):
    names = [f"repo:path/{i}.md" for i in range(20)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(tx.DOCUMENT_NAMESPACE, r["n"])) for r in rows)


def test_normalized_and_tokens(spark):
    assert one(spark, " \r\na\r\nb\rc \x1f", tx.normalized(F.col("text"))) == "a\nb\nc"
    assert one(spark, "Été_1 x-y", tx.token_count(F.col("text"))) == 3
    assert one(spark, "", tx.token_count(F.col("text"))) == 0


def test_white_space_around_is_what_python_strips(spark):
    """Without a regular expression that tries every run of white space inside a text."""
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, c + " \n" + c + "a " + c + "b" + c + "\t" + c) for c in every], "c string, t string")
    got = {r["c"]: r["x"] for r in rows.select("c", tx.stripped(F.col("t")).alias("x")).collect()}
    assert got == {c: (c + " \n" + c + "a " + c + "b" + c + "\t" + c).strip() for c in every}
    assert one(spark, " \u3000\n", tx.stripped(F.col("text"))) == "" and one(spark, None, tx.stripped(F.col("text"))) is None
    assert "regexp" not in rows.select(tx.stripped(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_suffix_and_types(spark):
    paths = {"a/b.PY": "code", ".env": "text", "x.tar.toml": "config", "README": "text", "d.dir/file": "text", "n.md": "md"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.source_type(F.col("p")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in rows} == paths


def test_snippet(spark):
    assert one(spark, "a" * 500, tx.snippet(F.col("text"), F.lit("zzz"), 60)) == "a" * 57 + "..."
    found = one(spark, "x" * 200 + " needle " + "y" * 200, tx.snippet(F.col("text"), F.lit("the needle"), 60))
    assert "needle" in found and found.startswith("...") and found.endswith("...")


def fixed(text, size, overlap, least):
    out, start = [], 0
    overlap = max(0, min(overlap, size - 1))
    while start < len(text):
        end = min(len(text), start + size)
        out.append((start, end, text[start:end]))
        if end >= len(text):
            break
        start = end - overlap
    out = [c for c in out if c[2].strip()]
    return [c for c in out if len(c[2].strip()) >= least] or out


def test_fixed_windows_like_python(spark):
    rng = random.Random(1)
    texts = ["", " ", "a\nb\nc\n"] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap, least in ((2, 0, 1), (10, 3, 4), (7, 9, 2)):
        got = {}
        for r in chunking.chunk_fixed(df, ["id"], size, overlap, least).collect():
            got.setdefault(r["id"], []).append((r["char_start"], r["char_end"], r["text"], r["line_start"], r["line_end"]))
        for i, t in enumerate(texts):
            want = [(a, b, c.strip("\n"), t[:a].count("\n") + 1, t[: max(a, b - 1)].count("\n") + 1) for a, b, c in fixed(t, size, overlap, least)]
            assert sorted(got.get(i, [])) == want


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "# Title\nLine 1\n## Sub\nLine 2\n# Next\nx")], "id int, text string")
    rows = chunking.chunk_markdown(df, ["id"], 200, 0, 1).orderBy("chunk_index").collect()
    assert [r["section_path"] for r in rows] == ["Title", "Title > Sub", "Next"]


def code(text, size, least):
    head = re.compile(r"^\s*(?:def |class )")
    out, cur, start, pos = [], "", 0, 0
    for line in text.splitlines(keepends=True):
        if head.match(line) and len(cur) >= least:
            out.append((start, start + len(cur)))
            cur, start = line, pos
        else:
            if not cur:
                start = pos
            cur += line
            if len(cur) >= size:
                out.append((start, start + len(cur)))
                cur = ""
        pos += len(line)
    if cur:
        out.append((start, start + len(cur)))
    out = [(a, b) for a, b in out if text[a:b].strip()]
    return [(a, b) for a, b in out if len(text[a:b].strip()) >= least] or out


def test_code_chunks_like_python(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["def f():\n", "    x = 1\n", "\n", "class A:\n", "y = 'long line of code'\n"]) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.chunk_code(df, ["id"], 60, 20).collect():
        got.setdefault(r["id"], []).append((r["char_start"], r["char_end"]))
    assert all(sorted(got.get(i, [])) == code(t, 60, 20) for i, t in enumerate(texts))


def test_very_long_files_take_their_length(spark):
    """Headings, functions and chunks by the hundred thousand in one text: folds that copy their results would not end."""
    n = 100_000
    md = "".join(f"# h{i}\nx\n" for i in range(n))
    code = "".join(f"def f{i}():\n    return {i}\n" for i in range(n))
    df = spark.createDataFrame([(1, md, code, "python")], "id int, md string, code string, language string")
    parts = chunking.chunk_markdown(df, ["id"], least=1, text="md").agg({"line_start": "max", "chunk_index": "max"}).first()
    assert (parts["max(line_start)"], parts["max(chunk_index)"]) == (2 * n - 1, n - 1)
    last = chunking.chunk_code(df, ["id"], 40, 10, "code").agg({"line_end": "max", "chunk_index": "max"}).first()
    assert last["max(line_end)"] == 2 * n and last["max(chunk_index)"] > n / 2
    found = symbols.extract_symbols(df, ["id"], "code").agg({"line_start": "max", "name": "count"}).first()
    assert (found["max(line_start)"], found["count(name)"]) == (2 * n - 1, n)
