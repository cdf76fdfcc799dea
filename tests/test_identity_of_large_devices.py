"""Identity of a device of more than the 50 MiB that ``file_identity`` digests by default."""

from blockatlas import image_queries
from blockatlas.sources import containers

from .oracle import same


def test_every_byte_counts(spark, tmp_path):
    n = 900_000  # blocks of 64 bytes: 57.6 MB
    orders = spark.range(0, n, 1, 4).selectExpr("id AS o_orderkey", "CASE WHEN id % 30000 = 0 OR id = 899999 THEN 'F' ELSE 'O' END AS o_orderstatus", "'5-LOW' AS o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    assert same(image_queries.q60_file_identity(spark, str(tmp_path)), image_queries.ORACLES["q60_file_identity"], str(tmp_path)) == 1


def test_the_default_is_the_head(tmp_path):
    (tmp_path / "x").write_bytes(b"a" * 100)
    (tmp_path / "y").write_bytes(b"a" * 60 + b"b" * 40)
    whole, head = [], []
    for name in "xy":
        with open(tmp_path / name, "rb") as f:
            whole.append(containers.file_identity(f, "sdb1", 100))
        with open(tmp_path / name, "rb") as f:
            head.append(containers.file_identity(f, "sdb1", 100, head=60))
    assert whole[0] != whole[1] and head[0] == head[1]
