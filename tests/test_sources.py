import gzip
import os

import pytest
from pyspark.sql import functions as F

from ebbgraph.schema import WINDOWS_EVENT
from ebbgraph.sources import auth_log, tables, windows_events
from helpers import random_edges

LINES = [
    "1,U1@DOM1,U1@DOM1,C1,C2,Kerberos,Network,LogOn,Success",
    "2,U2@DOM1,U2@DOM1,C1,C3,Negotiate,RemoteInteractive,LogOn,Fail",
    "3,U3@DOM1,U3@DOM1,C1,C4,Negotiate,Network,LogOff, success ",
    "4,U4@DOM1,U4@DOM1,C1,C5,?,?,,Success",
    '5,"U5,x@DOM1",U5@DOM1,C1,C6,NTLM,Network,LogOn,Success',
]
BAD = ["", "1,short,row", "x,U1@D,U1@D,C1,C2,K,N,L,S", "1,@D,U1@D,C1,C2,K,N,L,S", "1,U1@D,U1@D,C1,,K,N,L,S"]


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_auth_log(spark):
    rows = auth_log.auth_edges(text(spark, LINES), 1000).orderBy("t_e").collect()
    assert [(r.src, r.dst, r.protocol, r.t_e, r.w_0, r.raw_event_id) for r in rows] == [
        ("User:U1", "Machine:C2", "Kerberos", 1001.0, 1.0, "LogOn"),
        ("User:U2", "Machine:C3", "RDP", 1002.0, 0.6, "LogOn"),
        ("User:U3", "Machine:C4", "SMB", 1003.0, 1.0, "LogOff"),
        ("User:U4", "Machine:C5", "Kerberos", 1004.0, 1.0, None),
        ("User:U5,x", "Machine:C6", "SMB", 1005.0, 1.0, "LogOn"),
    ]
    assert {(r.edge_type, r.source_system) for r in rows} == {("Authentication", "lanl_replay")}


def test_auth_stats(spark):
    stats = auth_log.staging_stats(text(spark, LINES + BAD + [LINES[0] + ",extra"]), shard_size=2).first()
    assert (stats.lines_read, stats.edges_written, stats.lines_skipped, stats.shards_written) == (11, 6, 5, 4)


def test_auth_files(spark, tmp_path):
    with gzip.open(tmp_path / "auth.txt.gz", "wt") as handle:
        handle.write("\n".join(LINES + BAD) + "\n")
    assert auth_log.read_auth_log(spark, str(tmp_path / "auth.txt.gz")).count() == 5
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(LINES))
    stream = auth_log.stream_auth_log(spark, str(folder))
    query = stream.writeStream.format("memory").queryName("auth_rows").option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("auth_rows").count() == 5


def test_labels(spark, tmp_path):
    lines = text(spark, ["100,mallory@CORP,C1,C2", "incomplete,row", ""])
    rows = auth_log.parse_labels(lines, 1000).collect()
    assert [tuple(r) for r in rows] == [(1100.0, "mallory", "C1", "C2")]
    df = spark.createDataFrame([(1001.5, "b", "C1", "C2"), (1000.5, "a", "", "C3")], "t double, user string, source_computer string, destination_computer string")
    auth_log.write_labels(df, str(tmp_path / "labels"), 1000)
    written = [r.value for r in spark.read.text(str(tmp_path / "labels")).collect()]
    assert written == ["0,a@CORP,,C3", "2,b@CORP,C1,C2"]
    back = auth_log.read_labels(spark, str(tmp_path / "labels"), 1000).orderBy("t").collect()
    assert [tuple(r) for r in back] == [(1000.0, "a", "", "C3"), (1002.0, "b", "C1", "C2")]


def windows(spark, *events):
    base = {"TimeCreated": 5.0, "Computer": "C1"}
    names = WINDOWS_EVENT.fieldNames()
    return spark.createDataFrame([tuple({**base, **e}.get(n) for n in names) for e in events], WINDOWS_EVENT)


S, M = "Security", "Microsoft-Windows-Sysmon/Operational"


def test_windows_mappings(spark):
    events = windows(
        spark,
        {"Channel": S, "EventID": 4624, "TargetUserName": "al", "LogonType": "10"},
        {"Channel": S, "EventID": 4625, "TargetUserName": "al", "AuthenticationPackageName": "Kerberos"},
        {"Channel": S, "EventID": 4769, "TargetUserName": "al"},
        {"Channel": S, "EventID": 5140, "SubjectUserName": "bo"},
        {"Channel": M, "EventID": 1, "User": "bo", "ParentImage": "C:\\Windows\\WmiPrvSE.exe"},
        {"Channel": M, "EventID": 3, "DestinationHostname": "", "DestinationIp": "10.0.0.9", "DestinationPort": "3389"},
        {"Channel": M, "EventID": 3, "DestinationHostname": "db", "DestinationPort": "high"},
        {"Channel": M, "EventID": 11, "TargetFilename": "\\\\srv\\share\\a.exe"},
    )
    rows = windows_events.windows_edges(events).collect()
    assert [(r.src, r.dst, r.edge_type, r.protocol, r.w_0, r.raw_event_id) for r in rows] == [
        ("User:al", "Machine:C1", "Authentication", "RDP", 1.0, "4624"),
        ("User:al", "Machine:C1", "Authentication", "Kerberos", 0.7, "4625"),
        ("User:al", "Machine:C1", "Authentication", "Kerberos", 1.0, "4769"),
        ("User:bo", "Machine:C1", "FileTransfer", "SMB", 1.0, "5140"),
        ("User:bo", "Machine:C1", "RemoteCodeExecution", "Kerberos", 1.0, "1"),
        ("Machine:C1", "Machine:10.0.0.9", "Authentication", "RDP", 1.0, "3"),
        ("Machine:C1", "Machine:db", "Authentication", "Kerberos", 1.0, "3"),
        ("Machine:C1", "Machine:srv", "FileTransfer", "SMB", 1.0, "11"),
    ]


def test_windows_rejects(spark):
    events = windows(
        spark,
        {"Channel": S, "EventID": 999}, {"Channel": None, "EventID": 1},
        {"Channel": S, "EventID": 4624, "TargetUserName": ""},
        {"Channel": M, "EventID": 11, "TargetFilename": "C:\\local\\a.exe"},
        {"Channel": M, "EventID": 11, "TargetFilename": "\\\\alone"},
        {"Channel": M, "EventID": 1, "User": "x", "TimeCreated": None},
    )
    outcomes = [r.outcome for r in windows_events.rejected_windows_events(events).collect()]
    assert outcomes == ["unsupported"] * 2 + ["missing_fields"] * 4
    assert windows_events.windows_edges(events).count() == 0


def test_windows_json_numbers(spark, tmp_path):
    path = tmp_path / "events.json"
    path.write_text('{"Channel":"Security","EventID":4624,"TimeCreated":7,"Computer":"C1","TargetUserName":"al","LogonType":10}\n')
    row = windows_events.windows_edges(windows_events.read_windows_events(spark, str(path))).first()
    assert (row.protocol, row.t_e) == ("RDP", 7.0)


def test_staged_files(spark, tmp_path):
    df = random_edges(spark, 120)
    path = str(tmp_path / "staged")
    tables.write_staged_edges(df, path, shard_rows=25)
    files = sorted(f for f in os.listdir(path) if f.endswith(".json"))
    assert len(files) >= 5
    for name in files:
        times = [r.t_e for r in spark.read.json(f"{path}/{name}").collect()]
        assert len(times) <= 25 and times == sorted(times)
    assert sorted(tables.read_staged_edges(spark, path).collect()) == sorted(df.collect())


def test_unc_server(spark):
    df = spark.createDataFrame([("\\\\srv\\a",), ("//srv/a/b",), ("\\\\srv",), ("\\\\srv\\",), ("C:\\a\\b",), ("\\srv\\a",), (None,)], "p string")
    assert [r[0] for r in df.select(windows_events.unc_server(F.col("p"))).collect()] == ["srv", "srv", None, None, None, None, None]


@pytest.mark.parametrize("n, shard, files", [(230, 20, 3), (40, 40, 1), (41, 40, 1), (1, 10, 2)])
def test_replay_in_event_order(spark, tmp_path, n, shard, files):
    df = random_edges(spark, n)
    order = [r.edge_id for r in df.orderBy("t_e", "edge_id").select("edge_id").collect()]
    tables.write_replay(df.repartition(7), str(tmp_path / "in"), shard)
    seen = []

    def note(batch, batch_id):
        seen.append([r.edge_id for r in batch.orderBy("t_e", "edge_id").collect()])

    stream = tables.replay_stream(spark, str(tmp_path / "in"), files).writeStream.foreachBatch(note)
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [order[i : i + shard * files] for i in range(0, len(order), shard * files)]


def test_replay_of_nothing(spark, tmp_path):
    tables.write_replay(random_edges(spark, 5).limit(0), str(tmp_path / "in"))
    assert tables.read_staged_edges(spark, str(tmp_path / "in")).count() == 0
