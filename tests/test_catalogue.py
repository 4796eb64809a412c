"""Every registered query against its SQL oracle."""

import duckdb
import pytest

from tests.conftest import TINY, compare
from trawl.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    compare(catalogue.QUERIES[name](spark, TINY), catalogue.ORACLES[name], TINY)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_embed_batches_beside_halves(spark, tmp_path):
    """Texts with an element so near a half that its float rounds to the other side."""
    rows = ", ".join(f"({i}, 'text {i}')" for i in (92701, 289064, 298803, 386500))
    duckdb.sql(f"copy (select * from (values {rows}) as t(doc_id, text)) to '{tmp_path}/documents.parquet'")
    compare(catalogue.QUERIES["embed_batches"](spark, str(tmp_path)), catalogue.ORACLES["embed_batches"], str(tmp_path))


def test_topk_is_a_heap_per_partition(spark):
    plan = catalogue.QUERIES["vector_topk"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = catalogue.QUERIES["tokens_embed_estimate"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
