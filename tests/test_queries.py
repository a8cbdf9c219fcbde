"""Every query against its SQL, on the smallest tables."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from footfall import queries as analytics
from footfall.sources import adapter

DATA = os.environ.get("FOOTFALL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or (len(df) and isinstance(df[c].iloc[0], dt.date)):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d")
        df[c] = df[c].map(lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(analytics.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = analytics.queries()[name](spark, DATA).toPandas(), duck.execute(analytics.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(_comparable(got), _comparable(want), check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["path", "views"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_composites(spark):
    from footfall.plans import composites
    from footfall.sources import adapter

    tables = ("pages", "page_visitors", "sessions", "sources", "devices", "events", "outbound", "page_sources", "goals")
    r = analytics._reports(spark, DATA, *tables)
    parts = {
        "dashboard": composites.dashboard(r), "page": composites.page_detail(r, "/p/12"), "mail": composites.mailed(r, analytics.DEFS), "api": composites.api(r),
        "exports": composites.exports(r, analytics.DEFS, adapter.entries(spark, DATA)), "overview": composites.overview(r),
    }
    assert set(parts["exports"]) == {"pages", "sources", "trend", "devices", "content", "goals"}
    for rows in parts["overview"].values():
        assert rows.count() == 1
    assert {r["group"] for r in parts["exports"]["devices"].collect()} == {"browser", "os", "device_type"}


def test_content_asks_for_seen_elements_only(spark):
    """Entries are asked for by what was seen, so that what nobody saw is neither grouped nor joined."""
    r, asked = analytics._reports(spark, DATA, "pages"), []

    def own(of):
        asked.append(adapter.entries(spark, DATA, of))
        return asked[0]

    every = adapter.entries(spark, DATA)
    assert r.content(own, "author").collect() == r.content(every, "author").collect()
    seen = {x["element_id"] for x in r.rows("pages").select("element_id").collect()}
    assert sorted(map(str, asked[0].collect())) == sorted(str(x) for x in every.collect() if x["element_id"] in seen)
    assert 0 < asked[0].count() < every.count()
