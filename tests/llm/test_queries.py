import os
import zlib

import pytest

from cartolith.llm import registry
from tests import sql

pytestmark = pytest.mark.skipif(not os.path.isdir(sql.DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert sql.same(spark, name, registry.QUERIES[name], registry.ORACLES[name]) > 0


COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_reshard": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10_parity_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = registry.QUERIES[name](spark, sql.DATA)
    found = dict(df.dtypes)
    assert {c: found.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sql.DATA}/documents.parquet").collect()}
    rows = df.collect()
    assert {r.doc_id for r in rows} == set(docs)
    if name != "op8_packing":
        assert len(rows) == len(docs)
    if "held_out" in found:
        by = 5 if name == "op1_toxicity" else 4
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == (0 if by == 5 else 2)) for r in rows)
