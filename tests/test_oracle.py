"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as driver
from hirelake.plans import catalog

SF = "/root/testdata/sf0.001"
# Approximate or model-based: no SQL twin.
NO_TWIN = {"match_ann", "near_dup_minhash", "comp_by_role_sketch", "comp_trend_sketch", "skill_trend_sketch", "latency_sketch"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin_or_a_reason():
    assert set(catalog.QUERIES) - set(driver.oracle_sql()) == NO_TWIN
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) == ""


def test_entry_explains_every_match(spark):
    rows = driver.entry(spark).collect()
    assert rows and all(r.explanation for r in rows)
    ranks = {}
    for r in rows:
        ranks.setdefault(r.profile_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def test_approximate_match_recalls_most_of_the_exact_one(spark):
    exact = {(r.profile_id, r.job_id) for r in driver.queries()["match_exact"](spark, SF).collect()}
    near = {(r.profile_id, r.job_id) for r in driver.queries()["match_ann"](spark, SF).collect()}
    assert len(exact & near) / len(exact) >= 0.95


def test_minhash_recalls_most_of_the_exact_answer(spark):
    exact = {(r.posting_id, r.dup_of, r.score) for r in driver.queries()["near_dup_text"](spark, SF).collect()}
    near = {(r.posting_id, r.dup_of, r.score) for r in driver.queries()["near_dup_minhash"](spark, SF).collect()}
    assert len(exact & near) >= 0.9 * len(exact) > 0


def test_search_finds_the_texts_that_hold_the_query(spark):
    rows = driver.queries()["search_text"](spark, SF).collect()
    assert {r["rank"] for r in rows} == {1, 2, 3}
    assert max(r.score for r in rows) > 0.5
