"""Catalogue queries against their SQL. All of them with NEARPASS_FULL=1, else a quick selection."""

import os

import pytest

from nearpass.plans import catalog, registry  # noqa: F401
from tests.compare import compare, oracle

SF = "/root/testdata/sf0.001"
QUICK = ("c1_second_dedup", "c4_drop_jumps", "c16_file_day", "g3_flight_phase", "j1_pair_seconds", "j8_landing_controls", "e3_seeded_sample",
         "w1_clock_windows", "b3_count_distributions", "st9_holm", "ag1_outcome_shares", "q6_calibration", "src2_typed_reports")
KEYS = sorted(registry.QUERIES) if os.environ.get("NEARPASS_FULL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    message, _, _ = compare(spark, con, SF, key)
    assert not message


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
