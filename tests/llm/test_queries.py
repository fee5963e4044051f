"""Every registered query of the subpackage on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from crosstally.llm.queries import QUERIES, SQL
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    ok, note = compare(spark, duck(SF), SF, name)
    assert ok, note


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name,columns", [
    ("op1_simhash_near_dedup", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    ("op3_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}),
    ("op5_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    ("op8_quality_classifier", {"doc_id": "bigint", "score": "double"}),
    ("op9_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})])
def test_rows_and_types(spark, name, columns):
    df = QUERIES[name](spark, SF)
    assert columns.items() <= dict(df.dtypes).items()
    assert df.count() == 200
