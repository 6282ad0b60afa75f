import duckdb
import pytest

from plumbline.plans import registry
from tests.conftest import DATA
from tests.util import same

ORACLES = registry.oracle_sql()
ROWS_ONLY = sorted(set(registry.queries()) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    same(registry.queries()[name](spark, str(DATA)), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_is_repeatable(spark, name):
    first, again = (sorted(map(repr, registry.queries()[name](spark, str(DATA)).collect())) for _ in range(2))
    assert first and first == again


@pytest.mark.parametrize("name", ["exact_duplicate_groups", "duplicate_membership"])
def test_group_numbers_of_five_digits_and_null_texts_equal_oracle(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    duckdb.sql(f"COPY (SELECT i AS doc_id, CASE WHEN i >= 5 THEN (i // 2)::VARCHAR END AS text, 'en' AS lang, 's' AS source, 1::BIGINT AS n_chars FROM range(20200) r(i)) TO '{path}'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    same(registry.queries()[name](spark, str(tmp_path)), c.sql(ORACLES[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 110
    assert set(e.oracle_sql()) <= set(e.queries())
