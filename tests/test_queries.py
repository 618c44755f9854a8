"""Every registered query with SQL gives DuckDB's rows on the smallest tables, and the entry point works."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from cairn.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def plain(value):
    value = value.tolist() if hasattr(value, "tolist") else value
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(plain(v) for v in r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    found = entry_point.queries()[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_means_at_the_limit_do_not_depend_on_partitions(spark, tmp_path):
    """Orders whose mean discount is 0.07, over several files: the sums of one thread in the table's order decide."""
    import numpy as np
    import pandas as pd

    rng, parts = np.random.default_rng(2), [[] for _ in range(4)]
    for key in range(3000):
        cents = rng.integers(0, 11, 7)
        cents = np.append(cents, 56 - cents.sum())
        for k, c in enumerate(cents):
            parts[k // 2].append((key, float(c) / 100, 10.0))
    (tmp_path / "lineitem.parquet").mkdir()
    for k, rows_of in enumerate(parts):
        pd.DataFrame(rows_of, columns=["l_orderkey", "l_discount", "l_quantity"]).to_parquet(tmp_path / f"lineitem.parquet/{k}.parquet", index=False)
    connection = duckdb.connect()
    connection.execute("SET threads = 1")
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows(entry_point.queries()["degeneracy_reasons"](spark, str(tmp_path)).toPandas()) == rows(connection.sql(registry.ORACLE_SQL["degeneracy_reasons"]).df())


def test_a_small_negative_shift_keeps_its_sign(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"event_id": [0, 1, 2], "user_id": 1, "value": [2.0, 1.0, 2.00001], "ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 02:00", "2024-01-01 03:00"]).astype("datetime64[us]")})
    frame.to_parquet(tmp_path / "events.parquet", index=False)
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = entry_point.queries()["refined_minima"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(connection.sql(registry.ORACLE_SQL["refined_minima"]).df()) and str(got["shift"][0]) == "-0.0"
