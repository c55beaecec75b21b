"""A general activity-event table read as security edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbgraph.operators.edges import normalize_edges

HOSTS = 40
WEIGHT_UNIT = 50.0


def utc_seconds(ts: str = "ts") -> Column:
    """Epoch seconds of a timestamp without zone taken as UTC, whatever the session zone."""
    local = F.col(ts).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone())) / 1e6


def event_edges(events: DataFrame, hosts: int = HOSTS) -> DataFrame:
    """One edge per event; the event type decides node roles, edge type and protocol."""
    kind = F.col("event_type")
    text = lambda c: c.cast("string")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    user, user_host = text(F.col("user_id")), text(F.col("user_id") % hosts)
    host = text(F.col("event_id") % hosts)

    def pick(**by_kind):
        out = F
        for name, value in by_kind.items():
            out = out.when(kind == name, value)
        return out

    rows = events.select(
        pick(
            signup=join("Machine:C", user_host), error=join("User:C", user_host, "-admin"),
            click=join("User:u", user), purchase=join("User:svc", user_host), view=join("User:u", user),
        ).alias("src"),
        F.when(kind == "click", join("User:svc", host)).otherwise(join("Machine:C", host)).alias("dst"),
        pick(
            signup="Authentication", error="RemoteCodeExecution", click="Authentication",
            purchase="FileTransfer", view="Authentication",
        ).alias("edge_type"),
        pick(signup="Kerberos", error="RDP", click="Kerberos", purchase="SMB", view="DNS").alias("protocol"),
        utc_seconds().alias("t_e"),
        (F.col("value") / WEIGHT_UNIT).alias("w_0"),
        F.lit("events").alias("source_system"),
        text(F.col("event_id")).alias("raw_event_id"),
    )
    return normalize_edges(rows)


def read_event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_edges(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_labels(events: DataFrame, floor: float = 150.0) -> DataFrame:
    """Labels taken from the heaviest error events."""
    picked = events.filter((F.col("event_type") == "error") & (F.col("value") >= floor))
    return picked.select(
        utc_seconds().alias("t"),
        F.concat(F.lit("C"), (F.col("user_id") % HOSTS).cast("string"), F.lit("-admin")).alias("user"),
        F.concat(F.lit("C"), (F.col("user_id") % HOSTS).cast("string")).alias("source_computer"),
        F.concat(F.lit("C"), (F.col("event_id") % HOSTS).cast("string")).alias("destination_computer"),
    )
