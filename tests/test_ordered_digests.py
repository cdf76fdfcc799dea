"""Digests of each key's rows joined in order."""

import hashlib

from blockatlas.operators import ranges
from blockatlas.queries import ORACLES, QUERIES

from .oracle import same


def test_keys_stay_whole_behind_a_join(spark):
    """A join that turns into a broadcast while it runs leaves its input in parts by mapper."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 20_000, 1, 6).selectExpr("id % 7 AS k", "id", "cast(id as string) AS x")
        found = ranges.concat_md5(rows.join(spark.range(7).withColumnRenamed("id", "k"), "k"), "k", "id", rows["x"]).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted(found) == [(k, hashlib.md5("".join(str(i) for i in range(k, 20_000, 7)).encode()).hexdigest()) for k in range(7)]


def test_image_identity_of_odd_documents(spark, tmp_path):
    rows = [
        (1, None, "first is null"), (2, "a", "first is null"), (3, "b", "first is null"),
        (1, "a", "null between"), (2, None, "null between"), (3, "c", "null between"),
        (5, "same", "copies"), (5, "same", "copies"), (5, "same", "copies"), (6, "d", "copies"),
        (1, None, "no text"), (2, None, "no text"), (1, "", "empty"), (2, "", "empty"),
        (1, "x", None), (2, "y", None), (None, "z", "no id"), (7, "w", "no id"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(QUERIES["q36_image_identity"](spark, str(tmp_path)), ORACLES["q36_image_identity"], str(tmp_path)) == 7
