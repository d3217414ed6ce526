"""URL filter: host and path rules first, link-graph propagation for all other pages.

A rule names a host and a path; it fits the host and all its subdomains when the page's path starts with the rule's path.
The rule with the longest text wins. Pages that no rule fits get the verdict of their host: trust spreads from hosts with
allowed pages along links (personalised PageRank), distrust from hosts with blocked pages against the direction of links.
A host's seed is the share of its pages that rules allow or block. Ranks are scaled so that a host without links keeps its
seed; a host is blocked when its distrust exceeds its trust by ``threshold`` or more.

Links are the absolute and scheme-relative ``href`` hosts of anchors; links within a host do not count. A host's rank is
split over its distinct targets by number of links; what reaches a host without links ends there. Everything is DataFrame
operations; each round is one join and one aggregation over hosts, written out before the next. Rounds go on until all rank
that can still arrive anywhere is at most ``tolerance`` in sum, so the rank of no host is further than that from its limit.
The SQL twin states a fixed number of rounds and agrees where rank comes to rest within them.

Null urls and urls without ``://`` have an empty host and path: no rule fits, and the host '' has no links. Null html holds
no links. Repeated pages count as often as they occur. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DAMPING = 0.85
#: of the SQL twin only
ROUNDS = 8
TOLERANCE = 1e-4
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""<[aA]\s[^>]*[hH][rR][eE][fF]\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^"'\s<>/?#]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict), both null where none fits. rules: (verdict, host, path)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last one set is the longest
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts; pages has host and html."""
    found = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("target"))
    found = found.withColumn("target", F.translate("target", _UPPER, _LOWER))
    return found.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagated(seeds: DataFrame, edges: DataFrame, source: str, target: str, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) of personalised PageRank from seeds (host, seed), scaled by 1 / (1 - damping), within ``tolerance`` of its limit."""
    out = edges.groupBy(source).agg(F.sum("links").alias("all"))
    steps = cut(edges.join(out, source).select(F.col(source).alias("host"), F.col(target).alias("to"), (F.col("links") / F.col("all")).alias("w")))
    start = seeds.where("seed > 0").select("host", F.col("seed").alias("rank"))
    if steps.isEmpty():
        return start
    # moving: what the last round brought to a host; later rounds bring at most its sum times damping / (1 - damping)
    rank = start.withColumn("moving", F.col("rank"))
    while (rank.agg(F.sum("moving")).first()[0] or 0.0) * damping / (1 - damping) > tolerance:
        moved = rank.join(steps, "host").select(F.col("to").alias("host"), *((F.col(c) * F.col("w") * damping).alias(c) for c in ("rank", "moving")))
        both = start.withColumn("moving", F.lit(0.0)).unionByName(moved)
        rank = cut(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("moving").alias("moving")))
    return rank.select("host", "rank")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumn("rule", rule).withColumn("said", said)
    share = lambda kind: F.avg((F.coalesce("said", F.lit("")) == kind).cast("double"))
    seeds = cut(named.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    edges = cut(host_links(named))
    trust = propagated(seeds.select("host", F.col("allow").alias("seed")), edges, "source", "target", damping, tolerance)
    distrust = propagated(seeds.select("host", F.col("block").alias("seed")), edges, "target", "source", damping, tolerance)
    net = distrust.select("host", "rank").unionByName(trust.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("net"))
    blocked = net.where(F.col("net") >= threshold).select("host", F.lit("block").alias("verdict"))
    kept = named.select("page_id", "host", "path", "rule", "said").join(blocked, "host", "left")
    return kept.select("page_id", "host", "path", "rule", F.coalesce("said", "verdict", F.lit("allow")).alias("verdict"))


def oracle(rules: list[tuple[str, str, str]], rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in SQL over ``pages``, one common table per round."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    fits = [f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {quoted(h + p)}" for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN {quoted(v)}" for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    parts = [
        "rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"named AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)",
        f"ruled AS (SELECT *, {rule} AS rule, {said} AS said FROM named)",
        "seeds AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS allow_share, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS block_share FROM ruled GROUP BY host)",
        f"found AS (SELECT host AS source, {lower.format('unnest(regexp_extract_all(html, ' + quoted(LINK) + ', 1))')} AS target FROM ruled WHERE host <> '')",
        "edges AS (SELECT source, target, count(*) AS links FROM found WHERE source <> target GROUP BY source, target)",
    ]
    for name, seed, a, b in (("t", "allow_share", "source", "target"), ("d", "block_share", "target", "source")):
        parts.append(f"{name}w AS (SELECT {a} AS host, {b} AS to_host, links / sum(links) OVER (PARTITION BY {a}) AS w FROM edges)")
        parts.append(f"{name}0 AS (SELECT host, {seed} AS rank FROM seeds WHERE {seed} > 0)")
        for r in range(1, rounds + 1):
            parts.append(f"{name}{r} AS (SELECT host, sum(rank) AS rank FROM (SELECT host, rank FROM {name}0 UNION ALL SELECT w.to_host, r.rank * w.w * {damping} FROM {name}{r - 1} r JOIN {name}w w ON r.host = w.host) GROUP BY host)")
    parts.append(f"net AS (SELECT host FROM (SELECT host, rank FROM d{rounds} UNION ALL SELECT host, -rank FROM t{rounds}) GROUP BY host HAVING sum(rank) >= {threshold})")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, ruled.host, path, rule, coalesce(said, CASE WHEN net.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN net ON ruled.host = net.host"
