import hashlib

import pytest
from pyspark.sql import functions as F

from ebbgraph.functions import columns as C
from ebbgraph.operators import edges as E
from ebbgraph.operators import graph
from helpers import edges


def test_node_type(spark):
    df = spark.createDataFrame([("User:alice",), ("Machine:C1042",), ("Printer:p",), ("User",), ("x",)], "id string")
    assert [r[0] for r in df.select(C.node_type(F.col("id"))).collect()] == ["User", "Machine", None, "User", None]


def test_float_text_equals_repr(spark):
    values = [0.1, 1451606420.0, 1704067207.179575, 1e16, 1.5e17, 1e-5, 2.5e-7, 0.0, 1e15, 123456789.123, 5.0, 1e22, 1e-4, -3.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(C.float_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_edge_id(spark):
    row = edges(spark, [("User:a", "Machine:b", "Authentication", "RDP", 10.5, 1.0)]).first()
    assert row.edge_id == hashlib.sha256(b"User:a|Machine:b|RDP|10.5").hexdigest()[:32]
    assert (row.src_type, row.dst_type, row.source_system) == ("User", "Machine", "unknown")


def test_validate(spark):
    rows = [
        ("User:a", "Machine:b", "Authentication", "RDP", 1.0, 1.0),
        ("User:a", "Machine:b", "Authentication", "Telnet", 1.0, 1.0),
        ("User:a", "Machine:b", "Lateral", "RDP", 1.0, 1.0),
        ("User:a", None, "Authentication", "RDP", 1.0, -1.0),
    ]
    valid, rejected = E.validate_edges(edges(spark, rows))
    assert valid.count() == 1
    assert sorted(tuple(r.failed) for r in rejected.collect()) == [
        ("dst missing", "w_0 negative"), ("edge_type unknown",), ("protocol unknown",),
    ]


def test_json_round_trip(spark):
    df = edges(spark, [("User:a", "Machine:b", "Authentication", "RDP", 1.0, 1.0)])
    line = E.to_json(df).first().value
    assert line.startswith('{"dst":"Machine:b","dst_type"') and '"w":null' in line
    noisy = spark.createDataFrame([(line[:-1] + ',"extra":1}',), ("  ",)], "value string")
    assert E.from_json(noisy).collect() == df.collect()


def test_upsert_keeps_last_write(spark):
    df = spark.createDataFrame([("e1", 1, 1.0), ("e1", 3, 3.0), ("e1", 2, 2.0), ("e2", 1, 9.0)], "edge_id string, n int, w_0 double")
    assert {r.edge_id: r.w_0 for r in E.upsert_edges(df, "n").collect()} == {"e1": 3.0, "e2": 9.0}


def test_neighbors(spark):
    df = edges(
        spark,
        [
            ("User:a", "Machine:b", "Authentication", "RDP", 1.0, 1.0),
            ("User:a", "Machine:b", "Authentication", "RDP", 2.0, 1.0),
            ("Machine:b", "Machine:c", "Authentication", "RDP", 3.0, 1.0),
            ("Machine:b", "Machine:b", "Authentication", "RDP", 4.0, 1.0),
        ],
    )
    near = lambda d: sorted(r.neighbor for r in E.neighbors(df, d, "Machine:b").collect())
    assert near("out") == ["Machine:b", "Machine:c"]
    assert near("in") == ["Machine:b", "User:a", "User:a"]
    assert near("both") == ["Machine:b", "Machine:c", "User:a", "User:a"]
    with pytest.raises(ValueError):
        E.neighbors(df, "sideways")


def test_shard_index(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string")
    expected = [int.from_bytes(hashlib.sha256(f"k{i}".encode()).digest()[:8], "big") % 7 for i in range(50)]
    assert [r[0] for r in df.select(C.shard_index(F.col("k"), 7)).collect()] == expected
    assert {r[0] for r in df.select(C.shard_index(F.col("k"), 1)).collect()} == {0}
    with pytest.raises(ValueError):
        C.shard_index(F.col("k"), 0)


@pytest.mark.parametrize("split", [False, True])
def test_edge_index(spark, split):
    df = edges(spark, [(f"User:u{i % 7}", f"Machine:m{i % 5}", "Authentication", "RDP", float(i), 1.0) for i in range(60)])
    numbered, index = graph.edge_index(df, split=split)
    names = [r.node for r in numbered.orderBy("idx").collect()]
    assert names == sorted({r.src for r in df.collect()} | {r.dst for r in df.collect()})
    assert [r.idx for r in numbered.orderBy("idx").collect()] == list(range(12))
    ends = {r.edge_id: (names[r.src_idx], names[r.dst_idx]) for r in index.collect()}
    assert ends == {r.edge_id: (r.src, r.dst) for r in df.collect()}
