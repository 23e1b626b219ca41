from __future__ import annotations

import os

import duckdb
import pytest

from lexitide.plans import activity, registry
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert oracle.differences(registry.queries()[name](spark, oracle.DATA), con, registry.oracle_sql()[name]) == []


@pytest.fixture(scope="module")
def larger():
    return oracle.connect("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(activity.ORACLES))
def test_matches_sql_on_more_rows(spark, larger, name):
    assert oracle.differences(registry.queries()[name](spark, "/root/testdata/sf0.01"), larger, registry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["dump_ingest", "post_rows"])
def test_matches_sql_with_a_shared_folder_without_scheme(spark, larger, tmp_path, monkeypatch, name):
    monkeypatch.setattr("lexitide.sources.shared.shared_dir", lambda spark: str(tmp_path))
    assert oracle.differences(registry.queries()[name](spark, "/root/testdata/sf0.01"), larger, registry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["post_rows", "epoch_dates"])
def test_matches_sql_whatever_the_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert oracle.differences(registry.queries()[name](spark, oracle.DATA), con, registry.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("lang, text", [("x\r\ny", "a\r\nb"), ("en", "w " * 10_100_000)], ids=["title with line ends", "long text"])
def test_post_rows_of_odd_texts(spark, tmp_path, lang, text):
    spark.createDataFrame([(1, text, lang, "s"), (2, None, "", "")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, "u", "no parent"), (1, 2, "u", text)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    bad = oracle.differences(registry.queries()["post_rows"](spark, str(tmp_path)), con, registry.oracle_sql()["post_rows"])
    assert [x[:300] for x in bad] == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, oracle.DATA).count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["phase", "score", "nposts"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.basename(entry.__file__) == "__spark_entry__.py"
