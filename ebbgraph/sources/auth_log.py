"""Authentication logs and label files: comma-separated text without a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbgraph.operators.edges import normalize_edges

# The epoch second relative log times are anchored to, and the column layouts.
EPOCH_START = 1_451_606_400
AUTH_COLUMNS = (
    "time", "source_user", "destination_user", "source_computer", "destination_computer",
    "authentication_type", "logon_type", "authentication_orientation", "result",
)
LABEL_COLUMNS = ("time", "user", "source_computer", "destination_computer")


def field_count(line: Column) -> Column:
    """Number of comma-separated fields; commas inside quotes do not count."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "q")
    return F.when(line == "", F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1)


def _fields(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Parse text lines; a missing or empty field is null, extra fields are ignored.

    ``inline`` keeps later filters from being moved below the parse and repeating it.
    """
    schema = ", ".join(f"{name} string" for name in names)
    parsed = F.inline(F.array(F.from_csv("value", schema, {"escape": '"'})))
    return lines.select(field_count(F.col("value")).alias("n_fields"), parsed)


def relative_time(text: Column, epoch_start: int) -> Column:
    return (F.trim(text).try_cast("bigint") + F.lit(epoch_start)).cast("double")


def user_name(account: Column) -> Column:
    """Account name without its domain."""
    return F.split_part(account, F.lit("@"), F.lit(1))


def infer_protocol(authentication_type: Column, logon_type: Column) -> Column:
    return (
        F.when(logon_type == "RemoteInteractive", "RDP")
        .when(authentication_type == "Kerberos", "Kerberos")
        .when(logon_type == "Network", "SMB")
        .otherwise("Kerberos")
    )


def initial_weight(result: Column) -> Column:
    return F.when(F.lower(F.trim(result)) == "success", F.lit(1.0)).otherwise(F.lit(0.6))


def parse_auth_lines(lines: DataFrame, epoch_start: int = EPOCH_START) -> DataFrame:
    """Every line with its edge columns and ``skipped``; works on batch and streaming text."""
    rows = _fields(lines, AUTH_COLUMNS)
    user, computer, t_e = user_name(F.col("source_user")), F.col("destination_computer"), relative_time(F.col("time"), epoch_start)
    usable = (F.col("n_fields") >= len(AUTH_COLUMNS)) & t_e.isNotNull() & (user != "") & (computer != "")
    return rows.select(
        F.concat(F.lit("User:"), user).alias("src"),
        F.concat(F.lit("Machine:"), computer).alias("dst"),
        F.lit("Authentication").alias("edge_type"),
        infer_protocol(F.col("authentication_type"), F.col("logon_type")).alias("protocol"),
        t_e.alias("t_e"),
        initial_weight(F.col("result")).alias("w_0"),
        F.lit("lanl_replay").alias("source_system"),
        F.nullif("authentication_orientation", F.lit("")).alias("raw_event_id"),
        (~F.coalesce(usable, F.lit(False))).alias("skipped"),
    )


def auth_edges(lines: DataFrame, epoch_start: int = EPOCH_START) -> DataFrame:
    parsed = parse_auth_lines(lines, epoch_start)
    return normalize_edges(parsed.filter(~F.col("skipped")).drop("skipped"))


def read_auth_log(spark: SparkSession, path: str, epoch_start: int = EPOCH_START) -> DataFrame:
    """Edges of a plain or gzip-compressed log (one file or a folder of files)."""
    return auth_edges(spark.read.text(path), epoch_start)


def stream_auth_log(spark: SparkSession, path: str, epoch_start: int = EPOCH_START, files_per_batch: int = 16) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return auth_edges(lines, epoch_start)


def staging_stats(lines: DataFrame, shard_size: int = 100_000, epoch_start: int = EPOCH_START) -> DataFrame:
    """Lines read, edges written, lines skipped, and files needed at ``shard_size`` rows each.

    A new file is opened as soon as one fills up, so a full last file is followed by an empty one.
    """
    parsed = parse_auth_lines(lines, epoch_start)
    written = F.count_if(~F.col("skipped"))
    return parsed.agg(
        F.count("*").alias("lines_read"), written.alias("edges_written"),
        F.count_if("skipped").alias("lines_skipped"),
        (F.floor(written / F.lit(shard_size)) + 1).alias("shards_written"),
    )


# --- labels --------------------------------------------------------------------------


def parse_labels(lines: DataFrame, epoch_start: int = EPOCH_START) -> DataFrame:
    """Labels of known malicious activity; short rows are skipped."""
    rows = _fields(lines, LABEL_COLUMNS).filter(F.col("n_fields") >= len(LABEL_COLUMNS))
    blank = lambda name: F.coalesce(name, F.lit(""))
    return rows.select(
        (F.trim("time").cast("bigint") + F.lit(epoch_start)).cast("double").alias("t"),
        user_name(blank("user")).alias("user"),
        blank("source_computer").alias("source_computer"),
        blank("destination_computer").alias("destination_computer"),
    )


def read_labels(spark: SparkSession, path: str, epoch_start: int = EPOCH_START) -> DataFrame:
    return parse_labels(spark.read.text(path), epoch_start)


def label_lines(labels: DataFrame, epoch_start: int = EPOCH_START) -> DataFrame:
    """One text line per label, times rounded half to even."""
    seconds = F.bround(F.col("t") - F.lit(float(epoch_start)), 0).cast("bigint").cast("string")
    return labels.select(
        "t",
        F.concat_ws(",", seconds, F.concat(F.col("user"), F.lit("@CORP")), "source_computer", "destination_computer").alias("value"),
    )


def write_labels(labels: DataFrame, path: str, epoch_start: int = EPOCH_START) -> None:
    label_lines(labels, epoch_start).orderBy("t", "value").select("value").write.mode("overwrite").text(path)
