"""Carried columns that are called like result columns: kept under a free name, and the result can be written."""
import pytest

from fairgauge.llm import mixing, packing, quality_rules, sharding, simhash, suffix_dedup

CASES = [(packing.pack, packing), (mixing.mix, mixing), (sharding.shard, sharding), (simhash.near_duplicates, simhash),
         (quality_rules.judge, quality_rules), (suffix_dedup.dedup, suffix_dedup)]


@pytest.mark.parametrize("operator, module", CASES, ids=[m.__name__.rsplit(".", 1)[1] for _, m in CASES])
def test_clashing_carried_columns(spark, tmp_path, operator, module):
    clash = [c for c in module.RESULT if c not in ("doc_id", "source")]
    rows = spark.createDataFrame([(1, "alpha beta", "a", *[f"mine {c}" for c in clash])], ["doc_id", "text", "source", *clash])
    operator(rows, carry=[*clash, clash[0]]).write.parquet(str(tmp_path / "x"))
    row = spark.read.parquet(str(tmp_path / "x")).first()
    assert all(row[c + "_"] == f"mine {c}" for c in clash)
