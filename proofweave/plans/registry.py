"""Query registry, shared inputs, and the library of equivalent SQL fragments for the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocabulary as V
from ..operators import access, graph, identity
from ..operators import projection as pj
from ..session import cut
from ..sources.views import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(Inputs) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


_STORED: dict[tuple, DataFrame] = {}


class Inputs(Tables):
    """Views plus the derived tables that reads work on.

    The canonical map and the projection are tables that are rebuilt and then read many times; ``stored`` writes each
    once per session and folder.
    """

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            _STORED[key] = cut(build())
        return _STORED[key]

    def active(self) -> DataFrame:
        return identity.membership_as_of(self.membership)

    def lineage(self) -> DataFrame:
        return identity.lineage_replay(self.membership, self.decision)

    def canonical(self) -> DataFrame:
        return self.stored("canonical", self.build_canonical)

    def build_canonical(self) -> DataFrame:
        return identity.canonical_map(self.entity, self.lineage(), self.membership)

    def resolved(self) -> DataFrame:
        return pj.resolve_claims(self.claim, self.active(), self.canonical())

    def links(self) -> DataFrame:
        return self.stored("links", lambda: pj.edge_claims(self.resolved()))

    def edges(self) -> DataFrame:
        return self.stored("edges", lambda: pj.edge_rows(self.resolved()))

    def readable(self, clearance: int = 1) -> DataFrame:
        return access.readable_by(self.claim, clearance)

    def slugs(self) -> DataFrame:
        from pyspark.sql import functions as F

        from ..functions.names import ascii_key

        return pj.node_slugs(self.entity, self.mention, self.active(), ascii_key(F.col("label")))

    def display_edges(self) -> DataFrame:
        """Display edges over entity ids, from open claims."""
        from pyspark.sql import functions as F

        def build():
            return pj.graph_edges_of(self.resolved(), F.expr(pj.OPEN), None, self.record, self.source).select(
                "edge_id", "source", "target", "relation", "layer", "confidence", "weight", "start_date", "end_date", "source_file"
            )

        return self.stored("display", build)

    def weighted_edges(self) -> DataFrame:
        """The ends, layers and weights of the display edges."""
        from pyspark.sql import functions as F

        def build():
            return pj.weighted_edges_of(pj.resolve_claims(pj.weigh_claims(self.claim, F.expr(pj.OPEN)), self.active(), self.canonical()))

        return self.stored("weighted", build)

    def nation_firsts(self) -> DataFrame:
        """(set_id, entity_id, label, last_id): first and last customer of every nation, the asked-for entities of reads."""
        return self.sql(NATION_FIRSTS)


NATION_FIRSTS = (
    "SELECT c_nationkey AS set_id, concat('ent_c', lpad(CAST(min(c_custkey) AS STRING), 9, '0')) AS entity_id, min(c_name) AS label, "
    "concat('ent_c', lpad(CAST(max(c_custkey) AS STRING), 9, '0')) AS last_id, "
    "concat('ent_c', lpad(CAST(min(c_custkey) + 5 AS STRING), 9, '0')) AS near_id, "
    "concat('ent_o', CAST(c_nationkey % 7 AS STRING)) AS org_id FROM customer GROUP BY c_nationkey"
)

SYMMETRIC = ", ".join(f"'{n}'" for n, s in V.PREDICATES.items() if s[3])
RANK = V.HANDLING_RANK_SQL.format
WEIGHT = V.sql_case("credibility_normalized", V.DISPLAY_WEIGHTS, V.DEFAULT_DISPLAY_WEIGHT)
TAG = V.sql_case("credibility_normalized", V.CONFIDENCE_TAG_OF_CREDIBILITY, "AMBIGUOUS")
CATEGORY = V.sql_case("predicate", {n: s[2] for n, s in V.PREDICATES.items() if s[2]})
EDGE_ID = "concat('edg_', substr(sha256(concat_ws('|', subject_id, object_id, predicate, coalesce(CAST(segment_from AS VARCHAR), ''), coalesce(CAST(segment_to AS VARCHAR), ''))), 1, 32))"

CTES: dict[str, str] = {
    "nation_firsts": NATION_FIRSTS,
    "active": "SELECT mention_id, entity_id FROM fx_membership WHERE closed_revision_id IS NULL",
    "gained": "SELECT DISTINCT opened_revision_id AS rev, entity_id FROM fx_membership",
    "closed": "SELECT DISTINCT closed_revision_id AS rev, entity_id FROM fx_membership WHERE closed_revision_id IS NOT NULL",
    "lost": "SELECT rev, entity_id FROM closed EXCEPT SELECT rev, entity_id FROM gained",
    "winners": "SELECT rev, min(entity_id) AS winner FROM gained GROUP BY rev HAVING count(*) = 1",
    "lineage_events": (
        "SELECT l.entity_id, d.result_revision_id AS rev, w.winner AS parent_id FROM fx_decision d JOIN winners w ON w.rev = d.result_revision_id "
        "JOIN lost l ON l.rev = d.result_revision_id WHERE d.kind IN ('confirm', 'merge') "
        "UNION ALL SELECT g.entity_id, g.rev, NULL FROM fx_decision d JOIN gained g ON g.rev = d.result_revision_id WHERE d.kind = 'split'"
    ),
    "lineage": (
        "SELECT entity_id, parent_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rev DESC) AS rn FROM lineage_events) "
        "WHERE rn = 1 AND parent_id IS NOT NULL"
    ),
    "walk": (
        "SELECT entity_id, entity_id AS cur, 0 AS depth FROM fx_entity "
        "UNION ALL SELECT w.entity_id, l.parent_id, w.depth + 1 FROM walk w JOIN lineage l ON l.entity_id = w.cur"
    ),
    "canon": "SELECT entity_id, arg_max(cur, depth) AS canonical_entity_id FROM walk GROUP BY entity_id",
    "resolved_all": (
        "SELECT claim_id, predicate, record_id, credibility_normalized, handling_code, case_id, valid_from, valid_to, anchored, "
        f"CASE WHEN predicate IN ({SYMMETRIC}) AND o < s THEN o ELSE s END AS subject_id, CASE WHEN predicate IN ({SYMMETRIC}) AND o < s THEN s ELSE o END AS object_id "
        "FROM (SELECT c.*, coalesce(a.entity_id, ms.canonical_entity_id, c.subject_id) AS s, coalesce(mo.canonical_entity_id, c.object_id) AS o, a.entity_id IS NOT NULL AS anchored "
        "FROM fx_claim c LEFT JOIN active a ON a.mention_id = c.subject_mention_id LEFT JOIN canon ms ON ms.entity_id = c.subject_id "
        "LEFT JOIN canon mo ON mo.entity_id = c.object_id WHERE c.object_id IS NOT NULL AND c.retracted_on IS NULL)"
    ),
    "resolved": "SELECT * FROM resolved_all WHERE subject_id <> object_id",
    "ranges": (
        "SELECT *, coalesce(valid_from, DATE '0001-01-01') AS lo, coalesce(CAST(valid_to + 1 AS DATE), DATE '9999-12-31') AS hi FROM resolved"
    ),
    "cuts": (
        "SELECT subject_id, object_id, predicate, lo AS cut FROM ranges UNION SELECT subject_id, object_id, predicate, hi FROM ranges"
    ),
    "spans": (
        "SELECT *, CASE WHEN lo <> DATE '0001-01-01' THEN lo END AS segment_from, CASE WHEN hi <> DATE '9999-12-31' THEN CAST(hi - 1 AS DATE) END AS segment_to FROM "
        "(SELECT subject_id, object_id, predicate, cut AS lo, lead(cut) OVER (PARTITION BY subject_id, object_id, predicate ORDER BY cut) AS hi FROM cuts) WHERE hi IS NOT NULL"
    ),
    "links": (
        f"SELECT {EDGE_ID} AS edge_id, * FROM (SELECT s.subject_id, s.object_id, s.predicate, s.segment_from, s.segment_to, r.claim_id, r.record_id, "
        "r.credibility_normalized, r.handling_code, r.case_id FROM spans s JOIN ranges r ON r.subject_id = s.subject_id AND r.object_id = s.object_id AND r.predicate = s.predicate "
        "AND r.lo <= s.lo AND s.lo < r.hi)"
    ),
    "edges": "SELECT DISTINCT edge_id, subject_id, object_id, predicate, segment_from, segment_to FROM links",
    "relidx": (
        "SELECT from_claim AS claim_id, to_claim AS other_claim, relation FROM fx_relation "
        "UNION ALL SELECT to_claim, from_claim, relation FROM fx_relation"
    ),
    "related": (
        "SELECT edge_id, count(*) FILTER (WHERE relation = 'corroborates') AS corroboration_count, count(*) FILTER (WHERE relation = 'contradicts') AS contradiction_count FROM "
        "(SELECT DISTINCT edge_id, least(l.claim_id, other_claim) AS low, greatest(l.claim_id, other_claim) AS high, relation FROM links l JOIN relidx x ON x.claim_id = l.claim_id) GROUP BY edge_id"
    ),
    "projection": (
        "SELECT l.edge_id, subject_id, object_id, predicate, segment_from, segment_to, count(*) AS claim_count, count(DISTINCT record_id) AS record_count, "
        f"max({RANK('handling_code')}) AS handling_rank, coalesce(max(r.corroboration_count), 0) AS corroboration_count, coalesce(max(r.contradiction_count), 0) AS contradiction_count "
        "FROM links l LEFT JOIN related r ON r.edge_id = l.edge_id GROUP BY l.edge_id, subject_id, object_id, predicate, segment_from, segment_to"
    ),
    "readable": "SELECT * FROM fx_claim WHERE handling_code IN ('open', 'restricted') AND case_id IS NULL AND retracted_on IS NULL",
    "relidx_readable": (
        "SELECT x.* FROM relidx x WHERE x.claim_id IN (SELECT claim_id FROM readable) AND x.other_claim IN (SELECT claim_id FROM readable)"
    ),
    "relation_counts": (
        "SELECT claim_id, count(*) FILTER (WHERE relation = 'corroborates') AS corroborated_by, count(*) FILTER (WHERE relation = 'contradicts') AS contradicted_by FROM relidx_readable GROUP BY claim_id"
    ),
    "record_source": "SELECT r.record_id, s.name AS source_file, s.reliability_normalized FROM fx_record r JOIN fx_source s ON s.source_id = r.source_id",
    "slugs": (
        "SELECT e.entity_id, e.entity_type, e.label, coalesce(m.norm_key, trim(regexp_replace(lower(e.label), '[^a-z0-9]+', '_', 'g'), '_')) AS slug, m.record_id FROM fx_entity e LEFT JOIN "
        "(SELECT a.entity_id, arg_min(n.norm_key, n.mention_id) AS norm_key, arg_min(n.record_id, n.mention_id) AS record_id FROM active a JOIN fx_mention n ON n.mention_id = a.mention_id GROUP BY a.entity_id) m "
        "ON m.entity_id = e.entity_id"
    ),
    "best": (
        f"SELECT *, {WEIGHT} AS w FROM links WHERE handling_code = 'open' AND case_id IS NULL"
    ),
    "display": (
        f"SELECT b.edge_id, b.subject_id AS source, b.object_id AS target, b.predicate AS relation, upper(coalesce({CATEGORY}, 'uncategorized')) AS layer, {TAG} AS confidence, w AS weight, "
        "segment_from AS start_date, segment_to AS end_date, coalesce(rs.source_file, '') AS source_file FROM "
        "(SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY w DESC, claim_id DESC) AS rn FROM best) b LEFT JOIN record_source rs ON rs.record_id = b.record_id WHERE rn = 1"
    ),
}


def oracle(body: str, **extra: str) -> str:
    """SQL text with every view and fragment ``body`` needs as CTEs in dependency order."""
    import re

    known = {**VIEWS, **CTES, **extra}
    order: list[str] = []

    def visit(text: str, seen: tuple = ()):
        for name in known:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                if name not in order:
                    visit(known[name], seen + (name,))
                    order.append(name)

    visit(body)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({known[n].strip()})" for n in order) + " " + body.strip() if order else body.strip()
