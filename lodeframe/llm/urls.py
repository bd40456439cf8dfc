"""URL filters: host and path rules, and trust propagated over the links between hosts.

A page whose url no rule fits gets its host's verdict: personalised PageRank spreads trust forward
from hosts that allow rules cover and distrust backward (a page that links to blocked hosts is
suspect) from hosts that block rules cover; a host whose distrust exceeds its trust is blocked.

Built-in functions only. Links and seeds are counted per host before the first shuffle, so a host
with a third of all pages is one row per task there; the state has a row per host. The verdicts
come back to the pages as the list of blocked hosts, broadcast if it was counted to be small, else
by a join that AQE splits where a host is hot.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated
rows are judged row by row; null html has no links; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, sized, table

DAMPING = 0.85
#: Propagation ends when the share of all seeds' mass that still moves is at most this.
RESIDUAL = 1e-4
#: A host is blocked when its distrust exceeds its trust by this factor: more than what still moves or
#: the order of a sum could decide.
MARGIN = 1.001
#: Rounds between two writes of the state, after which the moving mass is looked at.
EVERY = 4
#: Rules that are tried one by one in the row; more are joined by host.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def with_rules(at: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``at`` (host, path and others) with rule and ruled.

    Few rules are tried in the row. More are a table: each host meets the rules of its suffixes in one
    join, and a page takes the longest of its host's rules that fits its path."""
    if len(rules) <= INLINE_RULES:
        text, verdict = ruled(F.col("host"), F.col("path"), rules)
        return at.select("*", text.alias("rule"), verdict.alias("ruled"))
    known = at.sparkSession.createDataFrame([(r.host, len(r.text), r.text, r.verdict, r.path) for r in rules], "suffix string, size int, rule string, verdict string, start string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = at.select("host").distinct().select("host", F.explode_outer(suffixes).alias("suffix")).where("suffix IS NOT NULL")
    fits = hosts.join(sized(known), "suffix").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("size", "rule", "verdict", "start")), asc=False).alias("fits"))
    first = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    joined = at.join(sized(settle(fits, "rules")), "host", "left").withColumn("first", first)
    return joined.select(*at.columns, F.col("first.rule").alias("rule"), F.col("first.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, links (pages of src with such a link)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode_outer(found).alias("dst"))
    return linked.where("src <> '' AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, host, score: personalised PageRank; edges: kind, src, dst, links; seeds: kind, host, seed.

    The seeds of both kinds together are one distribution, so that scores of the kinds compare. What
    moves is kept apart from what has arrived: a round sends only the former on, and the rounds end
    when its sum is at most RESIDUAL, which a damping below 1 brings about whatever the graph is."""
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("all"))
    weighted = settle(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("all")).alias("w")), "edges")
    total = seeds.agg(F.sum("seed")).first()[0] or 1.0
    base = settle(seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed") / total).alias("score")), "seeds")
    if weighted.isEmpty():
        return base  # nothing flows: every round gives the seeds' own share
    state = base.withColumn("moving", F.col("score"))
    while True:
        for _ in range(EVERY):
            sent = state.where("moving > 0").select("kind", F.col("host").alias("src"), "moving").join(weighted, ["kind", "src"])
            arrived = sent.select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("score"), (DAMPING * F.col("moving") * F.col("w")).alias("moving"))
            both = state.select("kind", "host", "score", F.lit(0.0).alias("moving")).unionByName(arrived)
            sums = both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving"))
            state = sums.select("kind", "host", (F.col("score") + F.col("moving")).alias("score"), "moving")
        state = settle(state, "trust")
        # mass m that moves can still add at most m / (1 - DAMPING)
        if (state.agg(F.sum("moving")).first()[0] or 0.0) <= RESIDUAL * (1 - DAMPING):
            return state.drop("moving")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = with_rules(at, rules)
    hosts = seen.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    seeds = hosts.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")).where("seed > 0")
    links = host_edges(pages)
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    state = propagate(edges, seeds)
    scores = state.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    blocked = settle(scores.where(F.col("distrust") > MARGIN * F.col("trust")).select("host", F.lit("block").alias("method")), "blocked")
    return seen.join(sized(blocked), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    low = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    host = low % "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"
    rounds = math.ceil(math.log(RESIDUAL) / math.log(DAMPING))
    return f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {rules}),
given AS (SELECT row_number() OVER () AS n, page_id, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
fits AS (SELECT n, arg_max(verdict, (length(rhost || rpath), rhost || rpath)) AS ruled, arg_max(rhost || rpath, (length(rhost || rpath), rhost || rpath)) AS rule
  FROM given JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n),
seen AS (SELECT given.*, rule, ruled FROM given LEFT JOIN fits USING (n)),
hosts AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust FROM seen WHERE host <> '' GROUP BY host),
base AS (SELECT kind, host, {1 - DAMPING!r} * seed / sum(seed) OVER () AS score FROM (SELECT 'trust' AS kind, host, trust AS seed FROM hosts WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust FROM hosts WHERE distrust > 0)),
links AS (SELECT host AS src, dst, count(*) AS links FROM (SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html, '{q(_LINK)}', 1), lambda h: {low % 'h'}))) AS dst FROM given)
  WHERE host <> '' AND host <> dst GROUP BY ALL),
edges AS (SELECT 'trust' AS kind, src, dst, links FROM links UNION ALL SELECT 'distrust', dst, src, links FROM links),
weighted AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) AS w FROM edges),
moved AS (SELECT 0 AS k, kind, host, score FROM base UNION ALL
  SELECT m.k + 1, m.kind, e.dst, sum({DAMPING} * m.score * e.w) FROM moved m JOIN weighted e ON e.kind = m.kind AND e.src = m.host WHERE m.k < {rounds} GROUP BY ALL),
scores AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM moved GROUP BY host)
SELECT page_id, seen.host, path, rule, coalesce(ruled, CASE WHEN distrust > {MARGIN} * trust THEN 'block' END, 'allow') AS verdict
FROM seen LEFT JOIN scores USING (host)
"""


OP2_SQL = _sql()
