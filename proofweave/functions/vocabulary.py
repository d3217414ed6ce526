"""The declared vocabulary: fixed values as constants, exposed as small DataFrames and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
HANDLING_CODES = ("open", "restricted", "sensitive")
UNKNOWN_HANDLING_RANK = 999

RELIABILITY = ("reliable", "generally_reliable", "unknown", "unreliable")
CREDIBILITY = ("confirmed", "probably_true", "possibly_true", "doubtful", "improbable", "cannot_judge")
VERIFICATION = ("unverified", "partially_corroborated", "corroborated", "record_confirmed", "refuted")
ANALYTIC_CONFIDENCE = ("low", "moderate", "high")

DISPLAY_WEIGHTS = {
    "confirmed": 1.0,
    "probably_true": 0.7,
    "possibly_true": 0.55,
    "doubtful": 0.4,
    "improbable": 0.2,
    "cannot_judge": 0.4,
}
DEFAULT_DISPLAY_WEIGHT = 0.4
CONFIDENCE_TAG_OF_CREDIBILITY = {
    "confirmed": "EXTRACTED",
    "probably_true": "INFERRED",
    "possibly_true": "AMBIGUOUS",
    "doubtful": "AMBIGUOUS",
    "improbable": "AMBIGUOUS",
    "cannot_judge": "AMBIGUOUS",
}
# confidence tag -> (credibility, verification, weight)
TAG_GRADES = {
    "EXTRACTED": ("confirmed", "record_confirmed", 1.0),
    "INFERRED": ("probably_true", "partially_corroborated", 0.7),
    "AMBIGUOUS": ("doubtful", "unverified", 0.4),
}
COLLECTION_METHOD_OF_TAG = {"CURATED": "curated", "STRUCTURAL": "structural", "SEMANTIC": "semantic_llm"}
EXTRACTION_TAG_OF_METHOD = {
    "curated": "CURATED",
    "manual": "CURATED",
    "structural": "STRUCTURAL",
    "semantic_llm": "SEMANTIC",
}
# scheme, original grade -> (dimension, normalized value)
GRADING_SCHEMES = {
    ("admiralty", "A"): ("reliability", "reliable"),
    ("admiralty", "B"): ("reliability", "generally_reliable"),
    ("admiralty", "C"): ("reliability", "generally_reliable"),
    ("admiralty", "F"): ("reliability", "unknown"),
}
# object type -> (title property, {property: (type, sensitivity)})
OBJECT_TYPES = {
    "person": ("name", {
        "name": ("text", None), "aliases": ("text", None), "nic": ("identifier", "restricted"),
        "date_of_birth": ("date", None), "notes": ("text", None)}),
    "organization": ("name", {"name": ("text", None), "aliases": ("text", None), "notes": ("text", None)}),
    "location": ("name", {"name": ("text", None), "precision": ("text", None)}),
    "vehicle": ("description", {"registration": ("identifier", None), "description": ("text", None)}),
    "phone_number": ("number", {"number": ("identifier", "restricted")}),
}
P, O = "person", "organization"
LITERAL = "literal"
# predicate -> (subject types, object types, category, symmetric, identifier)
PREDICATES = {
    "known_as": ((P, O), (LITERAL,), None, False, False),
    "has_nic": ((P,), (LITERAL,), None, False, True),
    "born_on": ((P,), (LITERAL,), None, False, False),
    "registered_as": (("vehicle",), (LITERAL,), None, False, True),
    "reachable_on": (("phone_number",), (LITERAL,), None, False, True),
    "affiliated_with": ((P,), (O, LITERAL), "ideological", False, False),
    "assessed_as_criminal_organization": ((O,), (LITERAL,), "ideological", False, False),
    "member_of": ((P,), (O,), "ideological", False, False),
    "founded": ((P,), (O,), "ideological", False, False),
    "pledged_allegiance_to": ((P, O), (O,), "ideological", False, False),
    "splinter_affiliate_of": ((O,), (O,), "ideological", False, False),
    "conspired_with": ((P,), (P,), "ideological", True, False),
    "masterminded_attack_with": ((P,), (P,), "ideological", True, False),
    "co_attacker_with": ((P,), (P,), "ideological", True, False),
    "provided_military_training_to": ((P,), (O, P), "ideological", False, False),
    "successor_leader_of": ((P,), (O,), "ideological", False, False),
    "allied_with": ((P,), (P,), "financial", True, False),
    "partnered_with": ((P,), (P,), "financial", True, False),
    "close_associate_of": ((P,), (P,), "financial", True, False),
    "rival_of": ((P,), (P,), "financial", True, False),
    "conspired_against": ((P,), (P,), "financial", False, False),
    "ordered_killing_of": ((P,), (P,), "financial", False, False),
    "killed_family_of": ((P,), (P,), "financial", False, False),
    "tipped_off_police_on": ((P,), (P,), "financial", False, False),
    "financed_and_supplied_materiel_to": ((P,), (O,), "financial", False, False),
    "co_located_in_prison_with": ((P,), (P,), "prison_co_location", True, False),
    "co_arrested_with": ((P,), (P,), "transnational", True, False),
    "communicated_with": ((P,), (P,), "transnational", True, False),
    "helped_establish_operations_of": ((P,), (P,), "transnational", False, False),
    "trafficked_narcotics_with": ((P,), (P,), "transnational", True, False),
    "foreign_contact_of": ((P,), (O,), "transnational", False, False),
    "sibling_of": ((P,), (P,), "kinship", True, False),
    "spouse_of": ((P,), (P,), "kinship", True, False),
}
NODE_PROPERTY_PREDICATES = ("known_as", "affiliated_with")
# extraction verb -> targets (predicate, credibility cap, default location, window part)
VERB_REMAP = {
    "co_conspirator_in_plot_with": (("conspired_with", None, None, "full"),),
    "co_masterminded_attacks_with": (("masterminded_attack_with", None, None, "full"),),
    "suspected_successor_leader_of": (("successor_leader_of", "possibly_true", None, "full"),),
    "suspected_foreign_is_contact_of": (("foreign_contact_of", "possibly_true", None, "full"),),
    "sibling_co_attacker_of": (("sibling_of", None, None, "full"), ("co_attacker_with", None, None, "full")),
    "spousal_co_attacker_of": (("spouse_of", None, None, "full"), ("co_attacker_with", None, None, "full")),
    "former_ally_turned_rival_of": (
        ("allied_with", None, None, "until_start"), ("rival_of", None, None, "from_start")),
    "avenging_rival_of": (("rival_of", None, None, "full"),),
    "helped_establish_in_dubai": (("helped_establish_operations_of", None, "Dubai", "full"),),
    "ran_narcotics_from_tamil_nadu_with": (("trafficked_narcotics_with", None, "Tamil Nadu route", "full"),),
}
# predicate -> layers whose category mismatch is an accepted correction
CATEGORY_CORRECTIONS = {
    "sibling_of": ("FINANCIAL", "IDEOLOGICAL"),
    "spouse_of": ("IDEOLOGICAL",),
    "partnered_with": ("TRANSNATIONAL",),
}
PREDICATE_RENAMES = {"co_located_with": "co_located_in_prison_with"}
CASE_ROLE_RELATIONS = {
    "analyst": "analyst", "investigator": "investigator", "supervisor": "supervisor", "auditor": "auditor_grant"}
ASSERTION_TYPES = ("observed", "reported", "inferred", "assessed")
ANCHORED_ASSERTIONS = ("observed", "reported")
ANCHOR_EXEMPT_METHODS = ("curated", "manual")
BUILDER_VERSION = "edge-projection-v2"
ONTOLOGY_VERSION = "1.0.0"
# ----------------------------------------------------------------------------------------------


def lookup(column: Column, table: dict, default=None) -> Column:
    """A fixed table as an expression: ``CASE`` while it is short, one map literal beyond that (small generated code)."""
    if len(table) > 8:
        pairs = [F.lit(x) for key, value in table.items() for x in (key, value)]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))
    expr = None
    for key, value in table.items():
        expr = F.when(column == key, F.lit(value)) if expr is None else expr.when(column == key, F.lit(value))
    return expr.otherwise(F.lit(default))


def handling_rank(column: Column) -> Column:
    return lookup(column, {c: i for i, c in enumerate(HANDLING_CODES)}, UNKNOWN_HANDLING_RANK)


def display_weight(credibility: Column) -> Column:
    return lookup(credibility, DISPLAY_WEIGHTS, DEFAULT_DISPLAY_WEIGHT)


def confidence_tag(credibility: Column) -> Column:
    return lookup(credibility, CONFIDENCE_TAG_OF_CREDIBILITY, "AMBIGUOUS")


def credibility_order(credibility: Column) -> Column:
    return lookup(credibility, {c: i for i, c in enumerate(CREDIBILITY)})


def category_of(predicate: Column) -> Column:
    return lookup(predicate, {n: s[2] for n, s in PREDICATES.items() if s[2]})


def is_symmetric(predicate: Column) -> Column:
    return predicate.isin([n for n, s in PREDICATES.items() if s[3]])


def predicates_in_categories(categories: list[str]) -> list[str]:
    wanted = {c.lower() for c in categories}
    return [n for n, s in PREDICATES.items() if s[2] is not None and s[2] in wanted]


def identifier_predicates() -> list[str]:
    return [n for n, s in PREDICATES.items() if s[4]]


def predicate_table(spark: SparkSession) -> DataFrame:
    rows = [
        (n, [t for t in s[0]], [t for t in s[1] if t != LITERAL], LITERAL in s[1],
         any(t != LITERAL for t in s[1]), s[2], s[3], s[4])
        for n, s in PREDICATES.items()
    ]
    return spark.createDataFrame(
        rows,
        "predicate string, subject_types array<string>, object_types array<string>, allows_literal boolean, "
        "allows_entity boolean, category string, symmetric boolean, identifier boolean",
    )


def property_table(spark: SparkSession) -> DataFrame:
    rows = [
        (t, p, kind, sensitivity, p == title)
        for t, (title, properties) in OBJECT_TYPES.items()
        for p, (kind, sensitivity) in properties.items()
    ]
    return spark.createDataFrame(
        rows, "object_type string, property string, type string, sensitivity string, is_title boolean")


def _rank(code: str) -> int:
    return HANDLING_CODES.index(code) if code in HANDLING_CODES else UNKNOWN_HANDLING_RANK


def predicates_above(clearance: int) -> list[str]:
    """Predicates whose own property, or an identifier property of whose subject types, is too sensitive."""
    rated = [(t, p, kind, _rank(code)) for t, (_, properties) in OBJECT_TYPES.items() for p, (kind, code) in properties.items() if code is not None]
    return [n for n, s in PREDICATES.items() if any(r > clearance and (p == n or (s[4] and kind == "identifier" and t in s[0])) for t, p, kind, r in rated)]


def types_above(clearance: int) -> list[str]:
    """Entity types whose display title is too sensitive."""
    return [t for t, (title, properties) in OBJECT_TYPES.items() if title in properties and properties[title][1] is not None and _rank(properties[title][1]) > clearance]


def verb_table(spark: SparkSession) -> DataFrame:
    """Verbs to predicates; a verb without an entry maps to the predicate of the same name."""
    facts = lambda p: (PREDICATES[p][2], PREDICATES[p][3])
    rows = [(v, *t, len(ts) > 1, *facts(t[0])) for v, ts in VERB_REMAP.items() for t in ts]
    rows += [(n, n, None, None, "full", False, *facts(n)) for n in PREDICATES if n not in VERB_REMAP]
    return spark.createDataFrame(
        rows,
        "relation string, predicate string, credibility_cap string, default_location string, "
        "window_part string, split boolean, category string, symmetric boolean",
    )


def sql_values(rows, columns: str) -> str:
    """The same fixed table as a VALUES list, for the checking engine."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS {columns}"


def sql_case(column: str, table: dict, default=None) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"'{v}'"

    return (
        f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"
    )


HANDLING_RANK_SQL = "CASE {0} WHEN 'open' THEN 0 WHEN 'restricted' THEN 1 WHEN 'sensitive' THEN 2 ELSE 999 END"
