"""Every registered query against its SQL twin; PARITY=name,name runs some."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from parity import compare, duck
from proofweave.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = os.environ["PARITY"].split(",") if os.environ.get("PARITY") else list(QUERIES)


@pytest.fixture(scope="module")
def outcomes(spark):
    """All queries against their twins, a few at a time: on a small folder one query leaves most cores idle."""
    con = duck(FOLDER)

    def run(name):
        try:
            return name, compare(spark, con.cursor(), FOLDER, name, QUERIES, ORACLES)
        except Exception as error:  # reported by the query's own test
            return name, (False, repr(error))

    with ThreadPoolExecutor(4) as pool:
        return dict(pool.map(run, NAMES))


@pytest.mark.parametrize("name", NAMES)
def test_matches_twin(outcomes, name):
    ok, message = outcomes[name]
    assert ok, message


def test_entry_is_lazy_and_has_a_schema(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert "edge_id" in contract.entry(spark).columns


def test_projection_does_not_depend_on_row_order(spark):
    from proofweave.operators import projection as pj
    from proofweave.plans.registry import Inputs

    t = Inputs(spark, FOLDER)
    resolved = t.resolved()
    one, two = pj.edge_projection(resolved, t.relation, 1), pj.edge_projection(resolved.repartition(5, "claim_id"), t.relation, 1)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert one.where("subject_id = object_id OR record_count < 1").isEmpty()
    assert one.select("edge_id").distinct().count() == one.count()
