"""Check queries beside their SQL on the smallest tables, and the shape of the driver contract."""

from __future__ import annotations

import os

import duckdb
import pytest

from check import TABLES, rows
from edictal.queries import all_queries
from oracles import all_sql

PATH = "/root/testdata/sf0.001"
# A query of every family; EDICTAL_ALL=1 runs them all, as does check.py.
SOME = (
    "closure_summary", "reconcile", "title_key", "clean_title", "html_text", "class_from_table", "notice_class", "scope", "deadline",
    "enrolment_state", "dedup_news", "transitions", "match_follow_up", "best_notice", "digests", "diff_all", "catalogue_list", "my_feed",
    "import_calls", "flatten_summary", "track_seen",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", sorted(all_queries()) if os.environ.get("EDICTAL_ALL") else SOME)
def test_query_equals_sql(spark, db, name):
    df = all_queries()[name](spark, PATH)
    cur = db.execute(all_sql()[name])
    want_columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(want_columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want_columns, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["agency_name", "action", "new_state", "n"] and df.count() > 0
