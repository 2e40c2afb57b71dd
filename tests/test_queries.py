"""Every registered query against its SQL twin."""

import duckdb
import pytest

from __spark_entry__ import entry
from check_queries import normalised
from veilwork.fixtures import TABLES
from veilwork.plans import oracle
from veilwork.plans.queries import QUERIES

SQL = oracle.build()
ROWS_ONLY = {"trained_tagger"}


def test_every_query_has_a_twin_or_is_listed():
    assert set(QUERIES) == set(SQL) | ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ROWS_ONLY:
        assert len(got) > 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalised(got) == normalised(want)


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["ner_label", "count"]
    assert frame.count() == 10
