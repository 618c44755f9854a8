"""The registered queries of llm: DuckDB's rows where there is SQL, a row per document or vector elsewhere."""

import pytest

import __spark_entry__ as entry_point
from cairn.llm import queries
from tests.llm.test_documents import telling
from tests.test_queries import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf, name):  # noqa: F811
    found = entry_point.queries()[name](spark, sf).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        key, table = ("vec_id", "embeddings") if "vec_id" in found else ("doc_id", "documents")
        assert found[key].nunique() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pii_sql_finds_disclosing_terms(spark):
    """The SQL and the operator agree where terms do disclose values, which the tables don't hold."""
    import duckdb

    from cairn.llm import pii

    texts = telling() + ["1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +1 (555) 555-1234 é a@b.c_d@e.f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    got = pii.find_pii(docs).toPandas()
    assert got["spans"].str.contains("term").sum() >= 30
    assert rows(got) == rows(connection.sql(queries.ORACLE_SQL["op4_pii"]).df())
