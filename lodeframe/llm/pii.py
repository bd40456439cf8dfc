"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built-in functions only; no shuffle. Results per row: a null or empty text has no spans; repeated
rows and ties are judged row by row; an empty table gives an empty result; other columns of the
input pass through ``redact`` untouched and are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole
from .spans import BLOCK, Kind, apart, counted, in_blocks, listed, located, pieces, running

SCORED = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"
#: Score from which a span that only the method adds is kept.
MIN_SCORE = 0.5

_DIGIT = lambda text: text.rlike("[0-9]")
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """True if the digits of a text pass the Luhn check."""
    figures = F.reverse(F.filter(F.split(digits(text), ""), lambda c: c != ""))

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(figures, worth), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """True if an account number in IBAN form leaves 1 modulo 97."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(turned, F.lit(0), step) == 1


def _long(low: int, high: int):
    return lambda s: F.length(digits(s["match"])).between(low, high)


#: Possessive forms of the contract's patterns: they match the same text, without backtracking.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda s: s["match"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _DIGIT, lambda s: _long(14, 19)(s) & luhn(s["match"])),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), _long(10, 15)),
)
#: What the method adds: account numbers confirmed by mod-97, short cards, numbers that need context.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), lambda s: mod97(s["match"])),
    Kind("card_13", r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12}(?![0-9-])", _DIGIT, lambda s: luhn(s["match"])),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _DIGIT),
    Kind("phone_local", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", _DIGIT),
)
#: Score of a confirmed span by itself, and the words nearby that add CONTEXT_BONUS.
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "card_13": 0.3, "ssn": 0.2, "phone_local": 0.3}
CONTEXT_BONUS = 0.3
WORDS = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|credit|pay|tarjeta|karte|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "card_13": "card|visa|credit|pay",
    "ssn": "ssn|social security",
    "phone_local": "phone|tel|call|mobile|fax",
}


def _scored(s: Column) -> Column:
    near = F.concat_ws(" ", s["before"], s["after"])
    score, hit = F.lit(0.0), F.lit(False)
    for kind, prior in PRIOR.items():
        score = F.when(s["kind"] == kind, F.lit(prior)).otherwise(score)
        hit = hit | ((s["kind"] == kind) & near.rlike(WORDS[kind]))
    return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.least(F.lit(1.0), score + F.when(hit, CONTEXT_BONUS).otherwise(0.0)).alias("score"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input's columns), ``base`` and ``spans``: arrays of struct<start, rank,
    end, kind, score> by start, then kind; ``spans`` holds the base ones and what the method adds."""
    kinds = BASE + ADDED
    packed = docs.select(F.struct("*").alias("row"), whole(text).alias("t"))
    cut = packed.select("row", *(pieces(F.col("t"), k).alias(k.name) for k in kinds))
    at = cut.select("row", *(located(k.name, k, i).alias(k.name) for i, k in enumerate(kinds)))
    both = at.select(
        "row",
        F.array_sort(F.transform(F.concat(*(F.col(k.name) for k in BASE)), _scored)).alias("base"),
        F.transform(F.concat(*(F.col(k.name) for k in ADDED)), _scored).alias("more"),
    )
    kept = both.select("row", "base", apart(F.filter("more", lambda s: s["score"] >= MIN_SCORE), F.col("base"), SCORED).alias("more"))
    return kept.select("row", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with every span replaced by its kind in brackets, as ``[EMAIL]``; overlapping spans
    become one. A null text stays null; ``n_chars``, if there, is counted anew for changed texts."""
    found = find_pii(docs, text)
    body = F.col(f"row.{text}")
    reach = running(F.col("spans"), 0, lambda pos, x: F.greatest(pos, x["end"]))
    cuts = F.arrays_zip(F.col("spans").alias("s"), F.concat(F.array(F.lit(0).cast("bigint")), reach).alias("since"))
    fresh = F.transform(F.filter(cuts, lambda x: x["s"]["start"] >= x["since"]), lambda x: F.struct(x["since"].alias("since"), x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind")))
    part = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))
    # a block's own text is cut out once, as a substring's cost grows with its place
    head = lambda k: F.element_at(k, 1)["since"]
    blocks = F.transform(in_blocks(fresh, BLOCK // 4), lambda k: F.struct(k.alias("k"), head(k).alias("since"), part(body, head(k), F.element_at(k, -1)["start"]).alias("t")))
    masked = F.transform(blocks, lambda b: F.array_join(F.transform(b["k"], lambda x: F.concat(part(b["t"], x["since"] - b["since"], x["start"] - b["since"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""))
    rest = F.substring(body, (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"), F.lit(2**31 - 1))
    clean = F.concat(F.array_join(masked, ""), rest)
    out = found.select("row", "spans", F.when(F.size("spans") == 0, body).otherwise(clean).alias("clean"))
    columns = []
    for c in docs.columns:
        old = F.col("row")[c]
        new = F.col("clean") if c == text else F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old
        columns.append(new.alias(c))
    return out.select(*columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(counted(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
