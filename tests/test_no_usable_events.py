"""Tables whose windows are all excluded: the rows that the SQL states, and no error."""

import duckdb
import pytest

from nearpass.plans import catalog, registry  # noqa: F401
from tests.compare import compare

EMPTY = [
    "m4_did_ratio",
    "m8_before_checks",
    "st3_equilibrium",
    "st4_rate_ratio_mle",
    "st7_continuous_medians",
    "st8_signed_rank",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events of value 400 every three hours: a window is empty or holds a value that marks it as bad."""
    path = tmp_path_factory.mktemp("excluded")
    kinds = "['error', 'purchase', 'click', 'view']"
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(3 * i) AS ts, i % 5 AS user_id, {kinds}[1 + (i % 4)::INT] AS event_type,
        400.0::DOUBLE AS value, '' AS props FROM range(60) r(i)) TO '{path}/events.parquet'""")
    return str(path)


@pytest.mark.parametrize("key", EMPTY)
def test_rows_of_the_sql(spark, folder, key):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert compare(spark, con, folder, key)[0] == ""


def test_regression_without_rows_has_no_ratio(spark, folder):
    assert [tuple(r) for r in registry.QUERIES["m9_regression_check"](spark, folder).collect()] == [("T1_any", None, None, None, None)]
