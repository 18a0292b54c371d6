"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from anchorage import plans


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name in plans.ORACLES:
        want = sql.sql(plans.ORACLES[name]).df()
        assert sorted(got) == sorted(want) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
