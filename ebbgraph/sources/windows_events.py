"""Windows security and process-monitor events as typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbgraph.operators.edges import normalize_edges
from ebbgraph.schema import WINDOWS_EVENT

# Channels, event numbers, ports and parent images that decide the mapping.
SECURITY = "Security"
MONITOR = "Microsoft-Windows-Sysmon/Operational"
LOGON = (4624, 4625, 4648)
TICKET = (4768, 4769)
SHARE = (5140, 5145)
PROCESS, CONNECT, FILE_CREATE = 1, 3, 11
PORTS = {3389: "RDP", 445: "SMB", 88: "Kerberos", 53: "DNS"}
PARENTS = {"psexesvc.exe": "SMB", "wmiprvse.exe": "Kerberos", "wsmprovhost.exe": "Kerberos"}


def _lookup(value: Column, table: dict, default: str) -> Column:
    out = F
    for key, name in table.items():
        out = out.when(value == key, name)
    return out.otherwise(default)


def _present(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(c != "", F.lit(False))
    return ok


def unc_server(path: Column) -> Column:
    r"""Server of a \\server\share... path with at least two parts, else null."""
    slashed = F.replace(path, F.lit("/"), F.lit("\\"))
    server = F.regexp_extract(slashed, r"^\\\\\\*([^\\]+)\\+[^\\]", 1)
    return F.nullif(server, F.lit(""))


def _edge(src: Column, dst: Column, kind: str, protocol: Column, w_0: Column) -> Column:
    return F.struct(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"),
        protocol.alias("protocol"), F.col("TimeCreated").alias("t_e"), w_0.alias("w_0"),
        F.lit("sysmon").alias("source_system"), F.col("EventID").cast("string").alias("raw_event_id"),
    )


def mapped_edge() -> Column:
    """The edge an event stands for; null when a required field is missing or no rule applies."""
    c = F.col
    user = lambda name: F.concat(F.lit("User:"), c(name))
    machine = lambda name: F.concat(F.lit("Machine:"), name)
    one = F.lit(1.0)
    host = machine(c("Computer"))
    timed = c("TimeCreated").isNotNull()

    logon_protocol = (
        F.when(c("LogonType") == "10", "RDP")
        .when(c("AuthenticationPackageName") == "Kerberos", "Kerberos").otherwise("SMB")
    )
    parent = F.lower(F.substring_index(c("ParentImage"), "\\", -1))
    remote = F.coalesce(F.nullif(c("DestinationHostname"), F.lit("")), c("DestinationIp"))
    port = F.trim("DestinationPort").try_cast("int")
    server = unc_server(c("TargetFilename"))

    security, monitor = c("Channel") == SECURITY, c("Channel") == MONITOR
    target_ok = _present(c("TargetUserName"), c("Computer")) & timed
    rules = [
        (security & c("EventID").isin(*LOGON), target_ok,
         _edge(user("TargetUserName"), host, "Authentication", logon_protocol,
               F.when(c("EventID") == 4624, one).otherwise(F.lit(0.7)))),
        (security & c("EventID").isin(*TICKET), target_ok,
         _edge(user("TargetUserName"), host, "Authentication", F.lit("Kerberos"), one)),
        (security & c("EventID").isin(*SHARE), _present(c("SubjectUserName"), c("Computer")) & timed,
         _edge(user("SubjectUserName"), host, "FileTransfer", F.lit("SMB"), one)),
        (monitor & (c("EventID") == PROCESS), _present(c("User"), c("Computer")) & timed,
         _edge(user("User"), host, "RemoteCodeExecution", _lookup(parent, PARENTS, "SMB"), one)),
        (monitor & (c("EventID") == CONNECT), _present(c("Computer"), remote) & timed,
         _edge(host, machine(remote), "Authentication", _lookup(port, PORTS, "Kerberos"), one)),
        (monitor & (c("EventID") == FILE_CREATE), _present(c("Computer"), server) & timed,
         _edge(host, machine(server), "FileTransfer", F.lit("SMB"), one)),
    ]
    out = F
    for applies, complete, edge in rules:
        out = out.when(applies & complete, edge)
    return out.otherwise(F.lit(None))


def supported() -> Column:
    """An event whose channel and number have a rule."""
    c = F.col
    return F.coalesce(
        ((c("Channel") == SECURITY) & c("EventID").isin(*LOGON, *TICKET, *SHARE))
        | ((c("Channel") == MONITOR) & c("EventID").isin(PROCESS, CONNECT, FILE_CREATE)),
        F.lit(False),
    )


def classify_windows_events(events: DataFrame) -> DataFrame:
    """Events with ``outcome`` (edge, missing_fields, unsupported) and struct ``edge``."""
    marked = events.withColumn("edge", mapped_edge())
    outcome = (
        F.when(~supported(), "unsupported").when(F.col("edge").isNull(), "missing_fields").otherwise("edge")
    )
    return marked.withColumn("outcome", outcome)


def windows_edges(events: DataFrame) -> DataFrame:
    """Edges of the events that map to one; each event is mapped once."""
    return normalize_edges(events.select(F.inline(F.array_compact(F.array(mapped_edge())))))


def rejected_windows_events(events: DataFrame) -> DataFrame:
    return classify_windows_events(events).filter(F.col("outcome") != "edge").drop("edge")


def read_windows_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WINDOWS_EVENT).json(path)


def stream_windows_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(WINDOWS_EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)
