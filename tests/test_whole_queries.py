from collections import Counter

import pytest

from hitweave import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["standard_spectra_16", "standard_spectra_totals", "hist_registered_all", "waveform_explode_all"])
def test_whole_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("events", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, SF)
    expected = db.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(expected.fetchall())


def test_last_channel_is_counted(spark):
    rows = {(r.module, r.channel): r.total for r in catalogue.QUERIES["hist_registered_all"](spark, SF).collect()}
    assert (3, 4) in rows and rows[2, 2] > 0
    assert {r.channel for r in catalogue.QUERIES["standard_spectra_16"](spark, SF).select("channel").distinct().collect()} == {0, 1, 2, 3, 4}
