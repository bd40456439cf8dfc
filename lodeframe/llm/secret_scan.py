"""Leaked secrets: fixed forms, and tokens that pass a battery of randomness tests.

Base spans are assignments, access keys and long hex runs. The method proposes every other unbroken
token, infers its encoding, and tests it three ways: chi-squared uniformity over the encoding's
alphabet against a language-like alternative (its power grows with length), and the runs and
serial-correlation tests, which must not reject randomness. The uniformity p-values of all
candidates of a length class then go through Benjamini-Hochberg control.

Built-in functions only. One pass over the texts, whose spans and candidates (no texts) are written
to the shared folder; the false-discovery thresholds come from a histogram with a fixed number of
cells. A null or empty text has no spans; repeated rows are judged row by row (and counted as often
in the histogram); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, whole
from .spans import SPAN, Kind, apart, counted, listed, located, pieces

#: False-discovery rate over the candidates of a length class.
FDR = 0.01
#: Level at which the runs and serial-correlation tests reject randomness.
REJECT = 0.001
#: Cells of the p-value histogram: tenths of -log10(p), 0 to 30.
CELLS = 300
MIN_TOKEN = 20
#: Length classes are powers of two of a token's length, up to this one.
MAX_CLASS = 12

BASE = (
    Kind(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        lambda t: t.rlike("(?i:passw|secret|token|api_?key)"),
        lambda s: F.length(F.regexp_extract(s["match"], r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)) >= 6,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", lambda t: F.contains(t, F.lit("AKIA")), lambda s: F.length(s["match"]) >= 20),
    # runs of 24 and more are the same matches as all runs less the short ones
    Kind("hex", r"[0-9a-f]{24,}", lambda t: t.rlike("[0-9a-f]{24}")),
)
TOKEN = Kind("random", rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}", lambda t: t.rlike(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN}}}"))

#: Name, form, alphabet in value order, and the collision probability of language-like text in it.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.10),
    ("base32", "^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 0.065),
    ("lower36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.065),
    ("base64", ".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
)


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by the rational approximation of Abramowitz and Stegun 26.2.17."""
    x = F.least(F.abs(z), F.lit(30.0))
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _values(body: Column, alphabet: str) -> Column:
    return F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))


def _encoded(s: Column) -> Column:
    """Values of the token's characters in its inferred alphabet, with the alphabet's facts."""
    bare = F.regexp_replace(F.translate(s["match"], "-_", "+/"), "=+", "")
    out = None
    for name, form, alphabet, like in reversed(ENCODINGS):
        body = bare if name == "base64" else F.lower(bare)
        this = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("encoding"), F.lit(float(len(alphabet))).alias("a"), F.lit(like).alias("like"), _values(body, alphabet).alias("v"))
        out = this if out is None else F.when(s["match"].rlike(form), this).otherwise(out)
    return out


def _moments(s: Column) -> Column:
    """Sums that the three tests need: folds over the values, and over the sorted ones for symbol counts."""
    v = s["v"]
    n = F.size(v).cast("double")

    def count(acc: Column, x: Column) -> Column:
        same = F.when(x == acc["last"], acc["run"]).otherwise(0.0)
        # a symbol's k-th occurrence adds 2k - 1 to the sum of squared counts
        return F.struct(x.alias("last"), (same + 1.0).alias("run"), (acc["sum"] + 2.0 * same + 1.0).alias("sum"))

    none = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    squares = F.aggregate(F.sort_array(v), none, count, lambda acc: acc["sum"])
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(n, F.lit(1.0))

    def step(acc: Column, x: Column) -> Column:
        d, high = x - acc["mean"], (x >= s["a"] / 2).cast("int")
        return F.struct(
            acc["mean"].alias("mean"),
            (acc["var"] + d * d).alias("var"),
            F.when(acc["first"] == 1, acc["cov"]).otherwise(acc["cov"] + d * acc["last"]).alias("cov"),
            (acc["runs"] + F.when((acc["first"] == 1) | (acc["side"] != high), 1.0).otherwise(0.0)).alias("runs"),
            (acc["n1"] + high).alias("n1"),
            d.alias("last"),
            high.alias("side"),
            F.lit(0).alias("first"),
        )

    zero = F.struct(mean.alias("mean"), F.lit(0.0).alias("var"), F.lit(0.0).alias("cov"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("n1"), F.lit(0.0).alias("last"), F.lit(0).alias("side"), F.lit(1).alias("first"))
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["a"].alias("a"), s["like"].alias("like"), n.alias("n"), squares.alias("squares"), F.aggregate(v, zero, step).alias("m"))


def _tested(s: Column) -> Column:
    n, a, like, m = s["n"], s["a"], s["like"], s["m"]
    chi2 = a * s["squares"] / F.greatest(n, F.lit(1.0)) - n
    expected = a + a * (n - 1) * like - n
    spread = F.sqrt(2 * (a - 1) + 4 * F.greatest(expected - (a - 1), F.lit(0.0)))
    uniform = upper_tail((expected - chi2) / spread)
    n1, n2 = m["n1"], n - m["n1"]
    mean_runs = 1 + 2 * n1 * n2 / F.greatest(n, F.lit(1.0))
    var_runs = (mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0))
    z_runs = F.when(var_runs > 0, (m["runs"] - mean_runs) / F.sqrt(F.greatest(var_runs, F.lit(1e-9)))).otherwise(F.lit(30.0))
    z_serial = F.when(m["var"] > 0, m["cov"] / F.greatest(m["var"], F.lit(1e-9)) * F.sqrt(n)).otherwise(F.lit(30.0))
    random = (2 * upper_tail(F.abs(z_runs)) >= REJECT) & (2 * upper_tail(F.abs(z_serial)) >= REJECT)
    p = F.when(random, F.greatest(uniform, F.lit(1e-30))).otherwise(F.lit(1.0))
    return F.struct(
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.least(F.floor(F.log2(F.greatest(n, F.lit(1.0)))).cast("int"), F.lit(MAX_CLASS)).alias("klass"),
        F.least(F.floor(-10 * F.log10(p)).cast("int"), F.lit(CELLS)).alias("cell"),
    )


def thresholds(found: DataFrame) -> dict[int, int]:
    """The least cell that Benjamini-Hochberg accepts, by length class: at most MAX_CLASS + 1 rows."""
    cells = found.select(F.explode("candidates").alias("c")).groupBy("c.klass", "c.cell").count()
    from_above = Window.partitionBy("klass").orderBy(F.desc("cell"))
    every = Window.partitionBy("klass")
    ranked = cells.select("klass", "cell", F.sum("count").over(from_above).alias("k"), F.sum("count").over(every).alias("m"))
    # a cell's largest p-value is 10 ** (-cell / 10)
    accepted = ranked.where(F.pow(F.lit(10.0), -F.col("cell") / 10) <= FDR * F.col("k") / F.col("m"))
    return {r["klass"]: r["cell"] for r in accepted.groupBy("klass").agg(F.min("cell").alias("cell")).collect()}


def find_secrets(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The ``keys`` columns as struct ``row``, ``base`` and ``spans``: arrays of struct<start, rank, end, kind>."""
    packed = docs.select(F.struct(*keys).alias("row"), whole(text).alias("t"))
    kinds = (*BASE, TOKEN)
    cut = packed.select("row", *(pieces(F.col("t"), k).alias(k.name) for k in kinds))
    at = cut.select("row", F.array_sort(F.concat(*(located(k.name, k, i) for i, k in enumerate(BASE)))).alias("base"), located(TOKEN.name, TOKEN, len(BASE)).alias("tokens"))
    coded = at.select("row", "base", F.transform(apart(F.col("tokens"), F.col("base"), SPAN.removeprefix("array<").removesuffix(">")), _encoded).alias("coded"))
    summed = coded.select("row", "base", F.transform("coded", _moments).alias("summed"))
    short = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    found = settle(summed.select("row", F.transform("base", short).alias("base"), F.transform("summed", _tested).alias("candidates")), "secrets")
    least = thresholds(found)
    accepted = F.lit(False)
    more = lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind"))

    def passes(s: Column) -> Column:
        out = accepted
        for klass, cell in sorted(least.items()):
            out = out | ((s["klass"] == klass) & (s["cell"] >= cell))
        return out

    return found.select("row", "base", F.array_sort(F.concat("base", F.transform(F.filter("candidates", passes), more))).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(counted(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
