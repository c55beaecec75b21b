"""Edge, cold, audit and report tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbgraph.operators.edges import normalize_edges, to_json
from ebbgraph.operators.scale import dense_index, parallelism
from ebbgraph.schema import COLD_EDGE, EDGE

SHARD_ROWS = 100_000


def write_staged_edges(edges: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """JSON-lines files of at most ``shard_rows`` edges, time-ordered across and inside files."""
    (
        edges.repartitionByRange("t_e", "edge_id").sortWithinPartitions("t_e", "edge_id")
        .select(*sorted(EDGE.fieldNames()))
        .write.mode("overwrite").option("maxRecordsPerFile", shard_rows).option("ignoreNullFields", "false").json(path)
    )


#: Files in a folder of a replay: their names count up to it in three digits, so that they sort as they were written.
REPLAY_FOLDER = 1000


def write_replay(edges: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """JSON-lines files of exactly ``shard_rows`` edges each (the last: the rest), to be replayed in event order.

    Edges are numbered by (t_e, edge_id) in balanced ranges, and consecutive files share a folder, which one task writes:
    a stream lists folders, so they are as few as tasks run side by side, or hold ``REPLAY_FOLDER`` files each. A stream takes
    files by age, and one job writes all of them, so at the end each file is given an age by its number: the store must keep
    the times it is told (HDFS and file systems do, object stores do not). That is one metadata call a file; no file is read.
    """
    spark = edges.sparkSession
    numbered = dense_index(edges.select(*EDGE.fieldNames()), ["t_e", "edge_id"], "_n")
    last = numbered.agg(F.max("_n")).first()[0]
    files = 0 if last is None else last // shard_rows + 1
    held = max(1, min(REPLAY_FOLDER, -(-files // parallelism(spark))))  # files of a folder
    dealt = numbered.withColumn("run", F.floor(F.col("_n") / (shard_rows * held)))
    (
        dealt.repartition(max(1, -(-files // held)), "run").sortWithinPartitions("run", "_n").select(*sorted(EDGE.fieldNames()), "run")
        .write.mode("overwrite").option("ignoreNullFields", "false").option("maxRecordsPerFile", shard_rows).partitionBy("run").json(path)
    )
    file = spark._jvm.org.apache.hadoop.fs.Path  # looked up once: each look-up is five calls
    folder = file(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(file(folder, "run=*/part-*")) or []
    names = [status.getPath().toString() for status in found]
    names.sort(key=lambda name: (int(name.rsplit("/", 2)[1].removeprefix("run=")), name))
    newest = store.getFileStatus(folder).getModificationTime()
    for number, name in enumerate(names):
        store.setTimes(file(name), newest - len(names) + number, -1)


def read_staged_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of staged files; unknown fields are ignored, blank lines skipped."""
    return normalize_edges(spark.read.schema(EDGE).json(path)).filter(F.col("src").isNotNull())


def replay_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Staged files as a stream, oldest file first; run it with ``availableNow`` to end.

    After ``write_replay`` that is event order: no edge of a micro-batch is later than any of the next.
    """
    raw = spark.readStream.schema(EDGE).option("maxFilesPerTrigger", files_per_batch).json(path)
    return normalize_edges(raw)


def event_day(t: Column) -> Column:
    """UTC day of an epoch time, independent of the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86400).cast("int"))


#: Columns by which single cold records are looked up: each file says by a Bloom filter what it cannot hold.
LOOKUP_COLUMNS = ("edge_id", "src", "dst")


def write_cold_edges(cold: DataFrame, path: str, mode: str = "append") -> None:
    """Cold records by event day. Ranges of t_e keep each task to few days, so few files.

    Bloom filters of ``LOOKUP_COLUMNS``, of a size that follows the file's values, let a lookup by
    equality skip the row groups that do not hold its value.
    """
    day = event_day(F.col("t_e"))
    writer = (
        cold.select(*COLD_EDGE.fieldNames(), day.alias("day"))
        .repartitionByRange("t_e", "edge_id").sortWithinPartitions("day", "t_e")
        .write.mode(mode).partitionBy("day").option("parquet.bloom.filter.adaptive.enabled", "true")
    )
    for name in LOOKUP_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def cold_days(spark: SparkSession, path: str) -> list[str]:
    """The days of a cold table, newest first: a listing of its folders, no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [status.getPath().getName() for status in found]
    return sorted((n.removeprefix("day=") for n in names if n.startswith("day=")), reverse=True)


def read_cold_edges(spark: SparkSession, path: str, by_day: bool = False) -> DataFrame:
    """Cold records; with ``by_day`` also the folder column ``day``, by which ``forensics.activity`` opens few folders."""
    return _cold_table(spark, path).select(*COLD_EDGE.fieldNames(), *["day"] * by_day)


def _cold_table(spark: SparkSession, path: str) -> DataFrame:
    """With its layout given, so that no file is opened to find it out."""
    return spark.read.schema(T.StructType([*COLD_EDGE.fields, T.StructField("day", T.DateType())])).parquet(path)


def cold_between(spark: SparkSession, path: str, start: float, end: float) -> DataFrame:
    """Cold edges of a time range; only the day folders it covers are opened."""
    day = lambda t: event_day(F.lit(float(t)))
    rows = _cold_table(spark, path).filter(F.col("day").between(day(start), day(end)))
    return rows.filter(F.col("t_e").between(F.lit(float(start)), F.lit(float(end)))).select(*COLD_EDGE.fieldNames())


def write_audit(records: DataFrame, path: str, mode: str = "append") -> None:
    records.withColumn("logged_at", F.unix_micros(F.current_timestamp()) / 1e6).write.mode(mode).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Calibration, detection or score report as JSON lines."""
    report.write.mode("overwrite").json(path)


def edge_json_lines(edges: DataFrame) -> DataFrame:
    return to_json(edges)
