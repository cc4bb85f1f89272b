"""URL filtering: rules first, then trust and distrust that spread over the host link graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, tidy


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for the host and its subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: An absolute link's host in HTML; scheme-relative links count too.
LINK_HOST = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(host) -> F.Column:
    """A-Z lower-cased; other letters stay, in urls and in links alike."""
    return F.translate(host, UPPER, LOWER)


def split_url(url) -> tuple[F.Column, F.Column]:
    """(host, path): host after the first :// up to / ? # or end, A-Z lower-cased; path from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return F.when(none, F.lit("")).otherwise(host), F.when(none, F.lit("")).otherwise(path)


def rule_columns(rules: tuple[Rule, ...]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits _host and _path; nulls if none does. Ties: block, then by text."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((F.col("_host") == r.host) | F.col("_host").endswith("." + r.host)) & F.col("_path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank of two kinds at once: kind, host, score.

    edges: kind, from_host, to_host, weight; seeds: kind, host, score (sums to 1 for a kind). Each round is one
    join and one sum with map-side combining, written to the shared folder. Rounds go on until all scores together
    change by less than the tolerance; as a round shrinks the change by the damping at least, that comes. A host without
    outgoing edges leaks its mass, which leaves scores in proportion to those of a walk that returns to the seeds.
    """
    out = edges.groupBy("kind", "from_host").agg(F.sum("weight").alias("_all"))
    steps = scratch.save(edges.join(out, ["kind", "from_host"]).select("kind", "from_host", "to_host", (F.col("weight") / F.col("_all") * damping).alias("share")))
    if steps.isEmpty():
        return seeds
    base = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores = scratch.save(seeds.select("kind", "host", "score", F.lit(0.0).alias("before")))
    while True:
        moved = steps.join(scores.select("kind", F.col("host").alias("from_host"), "score"), ["kind", "from_host"]).select("kind", F.col("to_host").alias("host"), (F.col("share") * F.col("score")).alias("score"))
        new = moved.unionByName(base).withColumn("before", F.lit(0.0))
        old = scores.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        later = scratch.save(new.unionByName(old).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")))
        scratch.drop(scores)
        scores = later
        if later.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < tolerance:
            return scores.drop("before")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    Where a rule fits, the longest gives the verdict. Elsewhere the host's does: hosts of pages that a rule allows
    are trusted seeds, hosts of pages that a rule blocks are blocked seeds, both weighted by their pages. Trust is
    personalised PageRank along links from host to host, distrust the same along reversed links. A host is
    blocked if distrust is over 0 and distrust / (trust + distrust) reaches the threshold; hosts that neither
    reaches, and pages without a host, are allowed. Null url: empty host and path. Null html: no links.
    Rows may repeat: each is judged. Extra columns are left out. No pages: no rows.
    """
    pages = tidy(pages, ("page_id", "url", "html")).select("page_id", "url", "html")
    scratch = Scratch(pages.sparkSession, "hosts")
    host, path = split_url(F.col("url"))
    split = pages.withColumn("_host", host).withColumn("_path", path)
    rule, verdict = rule_columns(rules)
    ruled = split.withColumn("_rule", rule).withColumn("_verdict", verdict)

    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK_HOST), F.lit(1)), lowered))
    # One row for each page's host, links and verdict, kept as counts: host, to_host, verdict.
    facts = scratch.save(
        ruled.filter("_host <> ''")
        .select("_host", "_verdict", F.explode(F.concat(F.array(F.lit(None).cast("string")), targets)).alias("to_host"))
        .groupBy("_host", "_verdict", "to_host")
        .agg(F.count("*").alias("n"))
    )
    links = facts.filter("to_host IS NOT NULL AND to_host <> _host").groupBy("_host", "to_host").agg(F.sum("n").cast("double").alias("weight"))
    edges = links.select(
        F.explode(
            F.array(
                F.struct(F.lit("trust").alias("kind"), F.col("_host").alias("from_host"), F.col("to_host").alias("to_host"), F.col("weight").alias("weight")),
                F.struct(F.lit("distrust").alias("kind"), F.col("to_host").alias("from_host"), F.col("_host").alias("to_host"), F.col("weight").alias("weight")),
            )
        ).alias("e")
    ).select("e.*")
    kind = F.when(F.col("_verdict") == "allow", "trust").otherwise("distrust")
    counted = facts.filter("to_host IS NULL AND _verdict IS NOT NULL").groupBy(kind.alias("kind"), F.col("_host").alias("host")).agg(F.sum("n").cast("double").alias("n"))
    totals = counted.groupBy("kind").agg(F.sum("n").alias("_all"))  # two rows
    seeds = scratch.save(counted.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("_all")).alias("score")))
    scores = propagate(edges, seeds, scratch, damping, tolerance)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    hosts = scratch.save(scores.groupBy(F.col("host").alias("_scored")).agg(of("trust").alias("trust"), of("distrust").alias("distrust")))

    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return (
        ruled.select("page_id", "_host", "_path", "_rule", "_verdict")
        .join(hosts, F.col("_host") == F.col("_scored"), "left")
        .select(
            "page_id",
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_rule").alias("rule"),
            F.coalesce("_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        )
    )


def op4_link_graph_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    """rule and verdict of the longest rule that fits h and p, as SQL."""
    found = {"rule": "", "verdict": ""}
    for r in sorted(RULES, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = f"WHEN (h = '{r.host}' OR h LIKE '%.{r.host}') AND starts_with(p, '{r.path}') THEN"
        found["rule"] += f" {fits} '{r.text}'"
        found["verdict"] += f" {fits} '{r.verdict}'"
    return ", ".join(f"CASE{cases} END AS {name}" for name, cases in found.items())


#: The same in SQL; after 120 rounds nothing changes by 1e-8.
OP4_SQL = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p FROM parts
), ruled AS (
  SELECT *, {_sql_rules()} FROM split
), links AS (
  SELECT h, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK_HOST.replace("'", "''")}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS t FROM ruled WHERE h <> ''
), weights AS (
  SELECT h, t, CAST(count(*) AS DOUBLE) AS w FROM links WHERE t <> h GROUP BY h, t
), edges AS (
  SELECT 'allow' AS kind, h AS a, t AS b, w FROM weights UNION ALL SELECT 'block', t, h, w FROM weights
), steps AS (
  SELECT kind, a, b, w / sum(w) OVER (PARTITION BY kind, a) * 0.85 AS share FROM edges
), counted AS (
  SELECT verdict AS kind, h, CAST(count(*) AS DOUBLE) AS n FROM ruled WHERE h <> '' AND verdict IS NOT NULL GROUP BY 1, 2
), seeds AS (
  SELECT kind, h, n / sum(n) OVER (PARTITION BY kind) AS score FROM counted
), walk AS (
  SELECT 0 AS k, kind, h, score FROM seeds
  UNION ALL
  SELECT k + 1, kind, h, sum(score) FROM (
    SELECT w.k, w.kind, s.b AS h, w.score * s.share AS score FROM walk w JOIN steps s ON w.kind = s.kind AND w.h = s.a
    UNION ALL
    SELECT m.k, s.kind, s.h, s.score * 0.15 FROM (SELECT max(k) AS k FROM walk) m, seeds s
  ) WHERE k < 120 GROUP BY k, kind, h
), scores AS (
  SELECT h, coalesce(sum(score) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'block'), 0) AS distrust FROM walk WHERE k = 120 GROUP BY h
)
SELECT page_id, h AS host, p AS path, rule, coalesce(verdict, CASE WHEN distrust > 0 AND distrust >= 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN scores USING (h)
"""
