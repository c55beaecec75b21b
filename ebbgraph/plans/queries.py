"""One query per operator over the activity-event table, each beside its DuckDB SQL.

Computed doubles are rounded on both sides; values taken over unchanged are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbgraph.config import load_motifs
from ebbgraph.functions import columns as C
from ebbgraph.operators import (
    baseline, calibration, decay, edges as E, evaluation, forensics, graph, motifs as M, ops, scale,
)
from ebbgraph.plans import oracle as O
from ebbgraph.plans import runs
from ebbgraph.sources import auth_log, tables, windows_events
from ebbgraph.schema import EDGE
from ebbgraph.sources.event_table import event_edges, event_labels, read_event_edges, utc_seconds
from ebbgraph.streaming import batches, continuous, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SPLIT_ROWS = 50  # rows from which the split forms cut a key
ORACLE: dict[str, str] = {}

NOW, EPS = O.NOW, O.EPS
OFF_TIES = 1.234e-8  # added before rounding exact decimals, so both sides round alike
FIXED = decay.PrunePolicy(epsilon_min=EPS, epsilon_max=EPS)
PRESSURE = decay.PrunePolicy(epsilon_min=0.01, epsilon_max=0.99, max_edges=200_000)

# A three-step chain beside the seed motifs: host, account on it, then a share it opens.
THREE_STEP = load_motifs(
    {
        "hop_and_drop": {
            "window_seconds": 86400,
            "steps": [
                {"edge_type": "Authentication", "src_type": "Machine", "dst_type": "Machine", "key_field": "dst"},
                {"edge_type": "RemoteCodeExecution", "src_type": "User", "dst_type": "Machine",
                 "key_field": "src", "key_resolver": "host_admin"},
                {"protocol": ["SMB", "Kerberos"], "dst_type": "Machine", "key_field": "dst"},
            ],
        }
    }
)

# Partial credit: the account's hop meets one of two technique filters in most events.
PARTIAL = load_motifs(
    {
        "loose_pivot": {
            "window_seconds": 14400,
            "steps": [
                {"edge_type": "Authentication", "src_type": "Machine", "dst_type": "Machine", "key_field": "dst"},
                {"edge_type": "RemoteCodeExecution", "protocol": ["DNS", "Kerberos"], "src_type": "User",
                 "key_field": "src", "key_resolver": "host_admin"},
            ],
        }
    }
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def joined(column: str) -> Column:
    return F.concat_ws(",", column)


# --- edges and scalar expressions ----------------------------------------------------------


@query(O.with_edges(body="SELECT edge_id, src, dst, protocol, t_e, src_type, dst_type, w_0, source_system FROM edges"))
def normalized_edges(spark, sf):
    return read_event_edges(spark, sf).select(
        "edge_id", "src", "dst", "protocol", "t_e", "src_type", "dst_type", "w_0", "source_system"
    )


@query(O.with_edges(body="""
SELECT edge_id, array_to_string(list_filter([
  CASE WHEN event_id % 13 = 0 THEN 'edge_type missing' END,
  CASE WHEN event_id % 13 <> 0 AND event_id % 7 = 0 THEN 'edge_type unknown' END,
  CASE WHEN event_id % 11 = 0 THEN 'protocol unknown' END,
  CASE WHEN event_id % 5 = 0 THEN 'w_0 negative' END], lambda x: x IS NOT NULL), ',') AS failed FROM edges"""))
def validated_edges(spark, sf):
    """Contract check on edges with faults planted by event number."""
    n = F.col("raw_event_id").cast("bigint")
    faulty = read_event_edges(spark, sf).withColumns(
        {
            "edge_type": F.when(n % 13 == 0, F.lit(None)).when(n % 7 == 0, "Lateral").otherwise(F.col("edge_type")),
            "protocol": F.when(n % 11 == 0, "Telnet").otherwise(F.col("protocol")),
            "w_0": F.when(n % 5 == 0, -1.0).otherwise(F.col("w_0")),
        }
    )
    valid, rejected = E.validate_edges(faulty)
    return valid.select("edge_id", F.lit("").alias("failed")).unionByName(
        rejected.select("edge_id", joined("failed").alias("failed"))
    )


@query(O.with_edges(body="SELECT edge_id, src, dst, t_e, w_0, raw_event_id FROM edges"))
def edge_json_round_trip(spark, sf):
    lines = E.to_json(read_event_edges(spark, sf))
    return E.from_json(lines).select("edge_id", "src", "dst", "t_e", "w_0", "raw_event_id")


@query(O.with_edges(O.WEIGHTED, body="SELECT edge_id, lambda_p, round(w, 6) AS w FROM weighted"))
def decay_weights(spark, sf):
    weighted = decay.with_lambda(decay.refresh_weights(read_event_edges(spark, sf), NOW))
    return weighted.select("edge_id", "lambda_p", r6("w").alias("w"))


@query(O.with_edges(body="""
SELECT edge_id, src AS src_key, dst AS dst_key,
       CASE WHEN regexp_extract(src, '^[^:]*:([\\p{L}\\p{N}]+)', 1) <> ''
            THEN 'Machine:' || regexp_extract(src, '^[^:]*:([\\p{L}\\p{N}]+)', 1) END AS admin_key FROM edges"""))
def chain_keys(spark, sf):
    return read_event_edges(spark, sf).select(
        "edge_id", C.identity_key(F.col("src")).alias("src_key"), C.identity_key(F.col("dst")).alias("dst_key"),
        C.host_admin_key(F.col("src")).alias("admin_key"),
    )


@query(O.with_edges(body="""
SELECT CAST(CAST('0x' || substr(sha256(edge_id), 1, 16) AS UBIGINT) % 16 AS INTEGER) AS shard, count(*) AS edges
FROM edges GROUP BY 1"""))
def edges_per_shard(spark, sf):
    sharded = graph.partition_edges(read_event_edges(spark, sf), 16)
    return sharded.groupBy("shard").agg(F.count("*").alias("edges"))


@query(O.with_edges(body="""
SELECT count(*) AS scanned,
       round(0.01 + greatest(0.5, least(1.0, count(*) / CAST(200000 AS DOUBLE))) * 0.98, 6) AS epsilon FROM edges"""))
def prune_threshold(spark, sf):
    policy = decay.PrunePolicy(0.01, 0.99, max_edges=200_000, memory_percent=80.0)
    return decay.epsilon_at(read_event_edges(spark, sf), policy).select("scanned", r6("epsilon").alias("epsilon"))


# --- sources -----------------------------------------------------------------------------------


def auth_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines written from the event table, some of them malformed."""
    c, n = F.col, F.col("event_id")
    text = lambda x: x.cast("string")
    seconds = text(F.floor(utc_seconds()).cast("bigint") - 1704067200)
    kind = lambda **by: F.coalesce(*[F.when(c("event_type") == k, F.lit(v)) for k, v in by.items()])
    auth = kind(signup="Kerberos", error="Negotiate", click="NTLM", purchase="Kerberos", view="?")
    logon = kind(signup="Network", error="RemoteInteractive", click="Network", purchase="Batch", view="Service")
    line = F.concat_ws(
        ",", F.when(n % 89 == 0, "soon").otherwise(seconds),
        F.when(n % 83 == 0, "@DOM1").otherwise(F.concat(F.lit("U"), text(c("user_id")), F.lit("@DOM1"))),
        F.lit("X@DOM1"), F.concat(F.lit("C"), text(c("user_id") % 40)),
        F.when(n % 79 == 0, "").otherwise(F.concat(F.lit("C"), text(n % 40))),
        auth, logon, F.when(n % 3 == 0, "").otherwise("LogOn"),
        F.when(n % 4 == 0, "Fail").otherwise(" Success"),
    )
    return events(spark, sf).select(
        F.when(n % 97 == 0, "short,row").when(n % 101 == 0, F.concat(line, F.lit(",extra"))).otherwise(line).alias("value")
    )


AUTH_SQL = """
WITH log AS (
  SELECT *, event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0 AS bad,
         CASE event_type WHEN 'error' THEN 'RDP' WHEN 'click' THEN 'SMB' ELSE 'Kerberos' END AS protocol,
         CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) - 1704067200 + 1451606400 AS sec FROM events),
good AS (
  SELECT 'User:U' || user_id AS src, 'Machine:C' || (event_id % 40) AS dst, protocol, CAST(sec AS DOUBLE) AS t_e,
         CASE WHEN event_id % 4 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w_0,
         CASE WHEN event_id % 3 <> 0 THEN 'LogOn' END AS raw_event_id FROM log WHERE NOT bad)
"""


@query(AUTH_SQL + """
SELECT substr(sha256(src || '|' || dst || '|' || protocol || '|' || CAST(t_e AS VARCHAR)), 1, 32) AS edge_id,
       src, dst, protocol, t_e, w_0, raw_event_id, 'lanl_replay' AS source_system FROM good""")
def auth_log_edges(spark, sf):
    return auth_log.auth_edges(auth_lines(spark, sf)).select(
        "edge_id", "src", "dst", "protocol", "t_e", "w_0", "raw_event_id", "source_system"
    )


@query(AUTH_SQL + """
SELECT protocol, w_0, count(*) AS edges FROM good GROUP BY ALL""")
def auth_log_file(spark, sf):
    """The same lines through files: gzip text written, read back by the log reader."""
    path = scale.scratch_path(spark)
    auth_lines(spark, sf).write.option("compression", "gzip").text(path)
    return auth_log.read_auth_log(spark, path).groupBy("protocol", "w_0").agg(F.count("*").alias("edges"))


@query(AUTH_SQL + """
SELECT count(*) AS lines_read, count(*) FILTER (NOT bad) AS edges_written, count(*) FILTER (bad) AS lines_skipped,
       CAST(floor(count(*) FILTER (NOT bad) / 1000) + 1 AS BIGINT) AS shards_written FROM log""")
def auth_staging_stats(spark, sf):
    return auth_log.staging_stats(auth_lines(spark, sf), shard_size=1000)


@query(O.with_edges(body="SELECT edge_id, src, dst, edge_type, protocol, t_e, w_0, source_system FROM edges"))
def staged_edges(spark, sf):
    path = scale.scratch_path(spark)
    tables.write_staged_edges(read_event_edges(spark, sf), path, shard_rows=1000)
    return tables.read_staged_edges(spark, path).select(
        "edge_id", "src", "dst", "edge_type", "protocol", "t_e", "w_0", "source_system"
    )


@query("""
SELECT CAST(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) - 1704067200 + 1451606400 AS DOUBLE) AS t,
       'u' || user_id AS user, 'C' || (user_id % 40) AS source_computer, 'C' || (event_id % 40) AS destination_computer
FROM events WHERE event_id % 17 <> 0""")
def label_file(spark, sf):
    c = F.col
    seconds = (F.floor(utc_seconds()).cast("bigint") - 1704067200).cast("string")
    host = lambda x: F.concat(F.lit("C"), (x % 40).cast("string"))
    line = F.concat_ws(",", seconds, F.concat(F.lit("u"), c("user_id").cast("string"), F.lit("@CORP")), host(c("user_id")), host(c("event_id")))
    path = scale.scratch_path(spark)
    events(spark, sf).select(F.when(c("event_id") % 17 == 0, "incomplete,row").otherwise(line).alias("value")).write.text(path)
    return auth_log.read_labels(spark, path)


@query(O.with_edges(O.LABELS, body="""
SELECT CAST(CAST(round_even(t - 1451606400, 0) AS BIGINT) AS VARCHAR) || ',' || user || '@CORP,' || source_computer || ','
       || destination_computer AS value FROM labels_t"""))
def label_lines(spark, sf):
    return auth_log.label_lines(event_labels(events(spark, sf))).select("value")


def windows_log(spark: SparkSession, sf: str) -> DataFrame:
    """Windows events derived from the event table, through JSON text as a log shipper sends it."""
    c, n = F.col, F.col("event_id")
    kind = lambda **by: F.coalesce(*[F.when(c("event_type") == k, v) for k, v in by.items()])
    logon = F.element_at(F.array(*[F.lit(i) for i in (4624, 4625, 4648, 4768, 4769)]), (n % 5 + 1).cast("int"))
    monitor = F.lit(windows_events.MONITOR)
    name = F.concat(F.lit("u"), c("user_id").cast("string"))
    row = F.struct(
        kind(signup=F.lit("Security"), purchase=F.lit("Security"), error=monitor, click=monitor, view=monitor).alias("Channel"),
        kind(signup=logon, purchase=F.when(n % 2 == 0, 5140).otherwise(5145), error=F.lit(1), click=F.lit(3),
             view=F.when(n % 10 == 0, 999).otherwise(11)).alias("EventID"),
        utc_seconds().alias("TimeCreated"),
        F.when(n % 31 != 0, F.concat(F.lit("C"), (n % 40).cast("string"))).alias("Computer"),
        name.alias("TargetUserName"), name.alias("SubjectUserName"), name.alias("User"),
        F.when(n % 3 == 0, 10).otherwise(3).alias("LogonType"),
        F.when(n % 2 == 0, "Kerberos").otherwise("NTLM").alias("AuthenticationPackageName"),
        F.when(n % 2 == 0, "").otherwise("files.corp").alias("DestinationHostname"),
        F.lit("10.0.0.7").alias("DestinationIp"),
        F.element_at(F.array(*[F.lit(p) for p in ("3389", "445", "88", "53", "8080", "none")]), (n % 6 + 1).cast("int")).alias("DestinationPort"),
        F.element_at(F.array(*[F.lit(p) for p in ("C:\\Windows\\PSEXESVC.exe", "C:\\x\\WmiPrvSE.exe", "wsmprovhost.exe", "cmd.exe")]), (n % 4 + 1).cast("int")).alias("ParentImage"),
        F.element_at(F.array(*[F.lit(p) for p in ("\\\\srv1\\share\\a", "//srv2/b", "C:\\local\\c", "\\\\alone", "\\\\\\srv3\\d")]), (n % 5 + 1).cast("int")).alias("TargetFilename"),
    )
    lines = events(spark, sf).select(F.to_json(row).alias("value"))
    return lines.select(F.inline(F.array(F.from_json("value", windows_events.WINDOWS_EVENT))))


WINDOWS_SQL = """
WITH marked AS (
  SELECT *, event_id % 31 <> 0 AS hosted, 'u' || user_id AS name, 'C' || (event_id % 40) AS host,
         epoch_us(ts) / 1e6 AS t,
         CASE event_id % 5 WHEN 0 THEN 'srv1' WHEN 1 THEN 'srv2' WHEN 4 THEN 'srv3' END AS server,
         CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'unsupported'
              WHEN event_id % 31 = 0 THEN 'missing_fields'
              WHEN event_type = 'view' AND event_id % 5 IN (2, 3) THEN 'missing_fields' ELSE 'edge' END AS outcome
  FROM events),
mapped AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'Machine:' || host ELSE 'User:' || name END AS src,
         'Machine:' || CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN '10.0.0.7' ELSE 'files.corp' END
                       WHEN 'view' THEN server ELSE host END AS dst,
         CASE event_type WHEN 'error' THEN 'RemoteCodeExecution' WHEN 'purchase' THEN 'FileTransfer'
              WHEN 'view' THEN 'FileTransfer' ELSE 'Authentication' END AS edge_type,
         CASE event_type
           WHEN 'signup' THEN CASE WHEN event_id % 5 >= 3 THEN 'Kerberos' WHEN event_id % 3 = 0 THEN 'RDP'
                                   WHEN event_id % 2 = 0 THEN 'Kerberos' ELSE 'SMB' END
           WHEN 'error' THEN CASE WHEN event_id % 4 IN (1, 2) THEN 'Kerberos' ELSE 'SMB' END
           WHEN 'click' THEN CASE event_id % 6 WHEN 0 THEN 'RDP' WHEN 1 THEN 'SMB' WHEN 3 THEN 'DNS' ELSE 'Kerberos' END
           ELSE 'SMB' END AS protocol,
         t AS t_e, CASE WHEN event_type = 'signup' AND event_id % 5 IN (1, 2) THEN CAST(0.7 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w_0,
         'sysmon' AS source_system
  FROM marked WHERE outcome = 'edge')
"""


@query(WINDOWS_SQL + "SELECT * FROM mapped")
def windows_event_edges(spark, sf):
    return windows_events.windows_edges(windows_log(spark, sf)).select(
        "src", "dst", "edge_type", "protocol", "t_e", "w_0", "source_system"
    )


@query(WINDOWS_SQL + "SELECT outcome, count(*) AS events FROM marked GROUP BY 1")
def windows_event_outcomes(spark, sf):
    marked = windows_events.classify_windows_events(windows_log(spark, sf))
    return marked.groupBy("outcome").agg(F.count("*").alias("events"))


# --- pruning and the cold table -------------------------------------------------------------------


def pruned(spark: SparkSession, sf: str) -> decay.PrunePass:
    return decay.prune_pass(read_event_edges(spark, sf), NOW, FIXED)


@query(O.with_edges(O.COLD, body="""
SELECT edge_id, CASE WHEN w < 0.05 THEN 'cold' ELSE 'active' END AS side, round(w, 6) AS w FROM weighted"""))
def active_cold_split(spark, sf):
    result = pruned(spark, sf)
    kept = decay.refresh_weights(result.active, NOW).select("edge_id", F.lit("active").alias("side"), r6("w").alias("w"))
    return kept.unionByName(result.cold.select("edge_id", F.lit("cold").alias("side"), r6("w_at_prune").alias("w")))


@query(O.with_edges(O.WEIGHTED, body="""
SELECT count(*) AS scanned, count(*) FILTER (w < eps) AS pruned, round(max(eps), 6) AS epsilon, CAST(0 AS BIGINT) AS write_failures
FROM (SELECT w, 0.01 + least(1.0, count(*) OVER () / CAST(200000 AS DOUBLE)) * 0.98 AS eps FROM weighted)"""))
def prune_stats(spark, sf):
    """Threshold under size pressure, from the count before the pass."""
    stats = decay.prune_pass(read_event_edges(spark, sf), NOW, PRESSURE).stats
    return stats.select("scanned", "pruned", r6("epsilon").alias("epsilon"), "write_failures")


@query(O.with_edges(O.COLD, body="SELECT edge_id, src, dst, protocol, t_e, round(w_at_prune, 6) AS w_at_prune, pruned_at FROM cold"))
def cold_table(spark, sf):
    path = scale.scratch_path(spark)
    tables.write_cold_edges(pruned(spark, sf).cold, path)
    return tables.read_cold_edges(spark, path).select(
        "edge_id", "src", "dst", "protocol", "t_e", r6("w_at_prune").alias("w_at_prune"), "pruned_at"
    )


@query(O.with_edges(O.WEIGHTED, body="""
SELECT edge_id, round(CASE WHEN w_0 >= 0.05 THEN t_e + ln(w_0 / 0.05) / lambda_p END, 3) AS expires_at,
       w >= 0.05 AS is_live FROM weighted"""))
def edge_expiry(spark, sf):
    rows = decay.with_expiry(read_event_edges(spark, sf), EPS)
    never = F.col("expires_at") == float("-inf")
    return rows.select(
        "edge_id", F.when(~never, F.round("expires_at", 3)).alias("expires_at"),
        (F.col("expires_at") >= NOW).alias("is_live"),
    )


@query(O.with_edges(O.COLD, body="SELECT edge_id, round(w, 6) AS w FROM active"))
def live_edges(spark, sf):
    return decay.active_at(read_event_edges(spark, sf), NOW, EPS).select("edge_id", r6("w").alias("w"))


@query(O.with_edges(O.WEIGHTED, body="""
SELECT CAST(1704070800 + 3600 * k AS DOUBLE) AS pruned_at, count(*) AS edges FROM (
  SELECT greatest(0, CAST(ceil((t_e - 1704070800) / 3600) AS BIGINT),
    CASE WHEN w_0 < 0.05 THEN 0 ELSE CAST(floor((t_e + ln(w_0 / 0.05) / lambda_p - 1704070800) / 3600) AS BIGINT) + 1 END) AS k
  FROM weighted) GROUP BY k"""))
def hourly_prune_schedule(spark, sf):
    rows = decay.prune_schedule(read_event_edges(spark, sf), 1704070800.0, 3600.0, EPS)
    return rows.groupBy("pruned_at").agg(F.count("*").alias("edges"))


@query(O.with_edges(O.COLD, body="""
SELECT edge_id, src, dst, t_e FROM cold WHERE (src = 'Machine:C7' OR dst = 'Machine:C7') AND t_e BETWEEN 1704300000 AND 1705900000"""))
def entity_activity(spark, sf):
    """From a stored cold table, of which only the days asked for are opened."""
    path = scale.scratch_path(spark)
    tables.write_cold_edges(pruned(spark, sf).cold, path)
    cold = tables.read_cold_edges(spark, path, by_day=True)
    return forensics.reconstruct_activity(cold, "Machine:C7", 1704300000, 1705900000).select(
        "edge_id", "src", "dst", "t_e"
    )


@query(O.with_edges(O.COLD, body="""
SELECT entity, edge_id, t_e FROM (
  SELECT edge_id, t_e, unnest(list_distinct([src, dst])) AS entity FROM cold) JOIN (
  SELECT dst AS entity, min(t_e) + 86400 AS lo, max(t_e) - 86400 AS hi FROM cold GROUP BY dst) USING (entity)
WHERE t_e BETWEEN lo AND hi"""))
def entity_activity_many(spark, sf):
    cold = pruned(spark, sf).cold
    windows = cold.groupBy(F.col("dst").alias("entity")).agg(
        (F.min("t_e") + 86400).alias("start"), (F.max("t_e") - 86400).alias("end")
    )
    return forensics.reconstruct_many(cold, windows).select("entity", "edge_id", "t_e")


def stored_cold(spark: SparkSession, sf: str) -> str:
    """The cold table as it is kept: in day folders."""
    path = scale.scratch_path(spark)
    tables.write_cold_edges(pruned(spark, sf).cold, path)
    return path


@query(O.with_edges(O.COLD, body="""
SELECT CASE WHEN src = 'Machine:C7' THEN dst ELSE src END AS other, protocol, edge_type, t_e, pruned_at
FROM cold WHERE src = 'Machine:C7' OR dst = 'Machine:C7' ORDER BY t_e DESC, edge_id LIMIT 50"""))
def newest_entity_activity(spark, sf):
    return forensics.newest_stored(spark, stored_cold(spark, sf), "Machine:C7").drop("edge_id")


@query(O.with_edges(O.COLD, body="""
SELECT protocol, count(*) AS prunes FROM cold WHERE pruned_at BETWEEN 1706600000 AND 1706700000 GROUP BY protocol"""))
def prunes_by_protocol(spark, sf):
    return forensics.prunes_by_protocol(pruned(spark, sf).cold, 1706600000, 1706700000)


@query(O.with_edges(O.COLD, body="""
SELECT edge_id, src, dst, t_e FROM cold WHERE edge_id = (SELECT min(edge_id) FROM cold)"""))
def cold_edge_lookup(spark, sf):
    cold = tables.read_cold_edges(spark, stored_cold(spark, sf))
    wanted = cold.agg(F.min("edge_id")).first()[0]
    return forensics.get_edge(cold, wanted).select("edge_id", "src", "dst", "t_e")


# --- baseline ------------------------------------------------------------------------------------------


@query(O.with_edges(O.SIGNALS, body="""
SELECT edge_id, entity, protocol, t, value, round(baseline_mean + 1.234e-8, 6) AS baseline_mean,
       round(baseline_std, 6) AS baseline_std, sample_count, round(z_score, 5) AS z_score FROM signals"""))
def deviation_signals(spark, sf):
    return signal_columns(baseline.deviation_signals(read_event_edges(spark, sf)))


def signal_columns(s: DataFrame) -> DataFrame:
    return s.select(
        "edge_id", "entity", "protocol", "t", "value", r6(F.col("baseline_mean") + OFF_TIES).alias("baseline_mean"),
        r6("baseline_std").alias("baseline_std"), "sample_count", F.round("z_score", 5).alias("z_score"),
    )


@query(ORACLE["deviation_signals"])
def deviation_signals_split(spark, sf):
    """The same with every larger key cut into segments."""
    return signal_columns(baseline.deviation_signals(read_event_edges(spark, sf), hot_rows=SPLIT_ROWS))


@query(O.with_edges(O.SIGNALS.replace("0.3 *", "0.0001 *").replace("0.7 *", "0.9999 *"), body="SELECT edge_id, sample_count, round(baseline_mean + 1.234e-8, 6) AS baseline_mean FROM signals"))
def deviation_signals_slow(spark, sf):
    """A baseline with a very long memory."""
    s = baseline.deviation_signals(read_event_edges(spark, sf), alpha=1e-4)
    return s.select("edge_id", "sample_count", r6(F.col("baseline_mean") + OFF_TIES).alias("baseline_mean"))


@query(O.with_edges(O.SIGNALS, body="SELECT edge_id, entity, round(z_score, 5) AS z_score FROM signals WHERE abs(z_score) >= 3"))
def flagged_anomalies(spark, sf):
    s = baseline.flag_anomalies(baseline.deviation_signals(read_event_edges(spark, sf)))
    return s.select("edge_id", "entity", F.round("z_score", 5).alias("z_score"))


@query(O.with_edges(O.SIGNALS, body="""
SELECT entity, protocol, round(arg_max(baseline_mean, sample_count) + 1.234e-8, 6) AS mean,
       round(arg_max(baseline_std, sample_count) ** 2, 6) AS variance, max(sample_count) AS sample_count
FROM signals GROUP BY ALL"""))
def baseline_profiles(spark, sf):
    p = baseline.baseline_profile(baseline.deviation_signals(read_event_edges(spark, sf)))
    return p.select("entity", "protocol", r6(F.col("mean") + OFF_TIES).alias("mean"), r6("variance").alias("variance"), "sample_count")


@query(O.with_edges(O.SIGNALS, O.LATEST_Z, body="SELECT entity, round(z_score, 5) AS z_score FROM latest"))
def latest_deviation(spark, sf):
    z = baseline.latest_deviation(baseline.deviation_signals(read_event_edges(spark, sf)))
    return z.select("entity", F.round("z_score", 5).alias("z_score"))


# --- motifs ----------------------------------------------------------------------------------------------


@query(O.with_edges(O.candidates(), body="SELECT motif_name, chain_key, stage, edge_id, t_e, score FROM cands"))
def motif_candidates(spark, sf):
    return M.motif_candidates(read_event_edges(spark, sf)).select("motif_name", "chain_key", "stage", "edge_id", "t_e", "score")


@query(O.with_edges(O.candidates(PARTIAL, fuzzy=True), body="SELECT motif_name, chain_key, stage, edge_id, score FROM cands"))
def fuzzy_candidates(spark, sf):
    return M.motif_candidates(read_event_edges(spark, sf), PARTIAL, fuzzy=True).select("motif_name", "chain_key", "stage", "edge_id", "score")


def completion_columns(df: DataFrame) -> DataFrame:
    return df.select("motif_name", "chain_key", joined("matched_edges").alias("matched"), "completed_at", r6("confidence").alias("confidence"))


def reset_columns(df: DataFrame) -> DataFrame:
    return df.select("motif_name", "chain_key", "triggering_edge_id", joined("matched_edges").alias("matched"), "reset_at")


COMPLETIONS = "SELECT motif_name, chain_key, array_to_string(matched_edges, ',') AS matched, completed_at, round(confidence, 6) AS confidence FROM completions"
RESETS = "SELECT motif_name, chain_key, triggering_edge_id, array_to_string(matched_edges, ',') AS matched, reset_at FROM resets"


@query(O.with_edges(O.chains(), body=COMPLETIONS))
def match_motifs(spark, sf):
    return completion_columns(M.match_motifs(read_event_edges(spark, sf)))


@query(O.with_edges(O.chains(), body=COMPLETIONS))
def match_motifs_split(spark, sf):
    return completion_columns(M.match_motifs(read_event_edges(spark, sf), hot_rows=SPLIT_ROWS))


@query(O.with_edges(O.chains(PARTIAL, fuzzy=True, min_confidence=0.4), body=COMPLETIONS))
def match_motifs_fuzzy(spark, sf):
    return completion_columns(M.match_motifs(read_event_edges(spark, sf), PARTIAL, fuzzy=True, min_confidence=0.4))


@query(O.with_edges(O.chains(THREE_STEP), body=COMPLETIONS))
def match_motifs_three_steps(spark, sf):
    return completion_columns(M.match_motifs(read_event_edges(spark, sf), THREE_STEP))


@query(O.with_edges(O.chains(timeout=True), body=COMPLETIONS))
def match_motifs_timeout(spark, sf):
    return completion_columns(M.match_motifs(read_event_edges(spark, sf), timeout="event_time"))


PRUNES = """
prunes AS (SELECT edge_id, t_e + 1800 * (1 + event_id % 12) AS pruned_at FROM edges WHERE event_id % 3 <> 0
           UNION ALL SELECT edge_id, t_e - 600 FROM edges WHERE event_id % 4 = 0)"""


def early_prunes(spark: SparkSession, sf: str) -> DataFrame:
    """Prunes after an edge's time, and for some edges one before it, which resets nothing."""
    n, edges = F.col("raw_event_id").cast("bigint"), read_event_edges(spark, sf)
    after = edges.filter(n % 3 != 0).select("edge_id", (F.col("t_e") + 1800 * (1 + n % 12)).alias("pruned_at"))
    return after.unionByName(edges.filter(n % 4 == 0).select("edge_id", (F.col("t_e") - 600).alias("pruned_at")))


@query(O.with_edges(PRUNES, O.chains(prunes="prunes"), body=COMPLETIONS))
def match_motifs_pruned(spark, sf):
    return completion_columns(M.match_motifs(read_event_edges(spark, sf), prunes=early_prunes(spark, sf)))


@query(O.with_edges(PRUNES, O.chains(prunes="prunes"), body=RESETS))
def motif_resets(spark, sf):
    return reset_columns(M.motif_resets(read_event_edges(spark, sf), early_prunes(spark, sf)))


@query(O.with_edges(O.chains(), body="""
SELECT motif_name, chain_key, stage, started_at, array_to_string(matched_edges, ',') AS matched FROM open_chains"""))
def open_chains(spark, sf):
    return M.open_chains(read_event_edges(spark, sf)).select(
        "motif_name", "chain_key", "stage", "started_at", joined("matched_edges").alias("matched")
    )


@query(O.with_edges(O.COLD, O.chains(), body="""
SELECT motif_name, chain_key, c.edge_id FROM open_chains o JOIN cold c ON list_contains(o.matched_edges, c.edge_id)"""))
def open_chains_hit_by_prunes(spark, sf):
    chains = M.open_chains(read_event_edges(spark, sf))
    return M.chains_containing(chains, pruned(spark, sf).cold).select("motif_name", "chain_key", "edge_id")


@query(O.with_edges(O.COLD, O.chains(), body="""
SELECT motif_name, chain_key, completed_at, c.edge_id, c.src, c.dst, round(c.w_at_prune, 6) AS w_at_prune
FROM (SELECT *, unnest(matched_edges) AS edge_id FROM completions) a JOIN cold c ON c.edge_id = a.edge_id"""))
def alert_cold_edges(spark, sf):
    cold = tables.read_cold_edges(spark, stored_cold(spark, sf), by_day=True)
    found = forensics.alert_edges(M.match_motifs(read_event_edges(spark, sf)), cold)
    return found.select("motif_name", "chain_key", "completed_at", "edge_id", "src", "dst", r6("w_at_prune").alias("w_at_prune"))


# --- evaluation ------------------------------------------------------------------------------------------


ANOMALY_MATCH = O.SIGNALS + "," + O.LABELS + """,
flagged AS (SELECT * FROM signals WHERE abs(z_score) >= 3),
a_label AS (SELECT l.*, EXISTS (SELECT 1 FROM flagged s WHERE s.entity = 'User:' || l.user AND abs(s.t - l.t) <= 3600) AS hit FROM labels_t l),
a_event AS (SELECT s.*, EXISTS (SELECT 1 FROM labels_t l WHERE s.entity = 'User:' || l.user AND abs(s.t - l.t) <= 3600) AS hit FROM flagged s)"""
MOTIF_MATCH = """
m_label AS (SELECT l.*, EXISTS (SELECT 1 FROM completions c WHERE c.chain_key IN ('Machine:' || l.source_computer,
  'Machine:' || l.destination_computer, 'User:' || l.user) AND abs(c.completed_at - l.t) <= 14400) AS hit FROM labels_t l),
m_event AS (SELECT c.*, EXISTS (SELECT 1 FROM labels_t l WHERE c.chain_key IN ('Machine:' || l.source_computer,
  'Machine:' || l.destination_computer, 'User:' || l.user) AND abs(c.completed_at - l.t) <= 14400) AS hit FROM completions c)"""


@query(O.with_edges(ANOMALY_MATCH, body="SELECT t, user, destination_computer, hit FROM a_label"))
def anomaly_label_hits(spark, sf):
    edges = read_event_edges(spark, sf)
    _, labels = evaluation.match_anomalies(baseline.deviation_signals(edges), event_labels(events(spark, sf)))
    return labels.select("t", "user", "destination_computer", "hit")


@query(O.with_edges(ANOMALY_MATCH, O.chains(), MOTIF_MATCH, body="SELECT t, user, destination_computer, hit FROM m_label"))
def motif_label_hits(spark, sf):
    _, labels = evaluation.match_motif_alerts(M.match_motifs(read_event_edges(spark, sf)), event_labels(events(spark, sf)))
    return labels.select("t", "user", "destination_computer", "hit")


@query(O.with_edges(ANOMALY_MATCH, O.chains(), MOTIF_MATCH, body="""
SELECT 'anomaly' AS detector, entity AS subject, t, 'false_positive' AS kind FROM a_event WHERE NOT hit
UNION ALL SELECT 'anomaly', 'User:' || user, t, 'false_negative' FROM a_label WHERE NOT hit
UNION ALL SELECT 'motif', chain_key, completed_at, 'false_positive' FROM m_event WHERE NOT hit
UNION ALL SELECT 'motif', 'User:' || user, t, 'false_negative' FROM m_label WHERE NOT hit"""))
def detection_errors(spark, sf):
    edges, labels = read_event_edges(spark, sf), event_labels(events(spark, sf))
    parts = []
    matched = {
        "anomaly": (evaluation.match_anomalies(baseline.deviation_signals(edges), labels), "entity", "t"),
        "motif": (evaluation.match_motif_alerts(M.match_motifs(edges), labels), "chain_key", "completed_at"),
    }
    for name, ((rated, rated_labels), subject, t) in matched.items():
        wrong = evaluation.false_positives(rated).select(F.col(subject).alias("subject"), F.col(t).alias("t"), F.lit("false_positive").alias("kind"))
        missed = evaluation.false_negatives(rated_labels).select(
            F.concat(F.lit("User:"), F.col("user")).alias("subject"), "t", F.lit("false_negative").alias("kind")
        )
        parts.append(wrong.unionByName(missed).select(F.lit(name).alias("detector"), "*"))
    return parts[0].unionByName(parts[1])


@query(O.with_edges(ANOMALY_MATCH, O.chains(), MOTIF_MATCH, body="""
SELECT detector, true_positives, false_positives, false_negatives,
       round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / CAST(true_positives + false_positives AS DOUBLE) END, 6) AS precision,
       round(CASE WHEN true_positives + false_negatives > 0 THEN true_positives / CAST(true_positives + false_negatives AS DOUBLE) END, 6) AS recall
FROM (SELECT 'anomaly' AS detector, (SELECT count(*) FROM a_label WHERE hit) AS true_positives,
             (SELECT count(*) FROM a_event WHERE NOT hit) AS false_positives, (SELECT count(*) FROM a_label WHERE NOT hit) AS false_negatives
      UNION ALL SELECT 'motif', (SELECT count(*) FROM m_label WHERE hit),
             (SELECT count(*) FROM m_event WHERE NOT hit), (SELECT count(*) FROM m_label WHERE NOT hit))"""))
def detection_report(spark, sf):
    report = runs.evaluate_detectors(read_event_edges(spark, sf), event_labels(events(spark, sf)))
    return report.withColumns({"precision": r6("precision"), "recall": r6("recall")})


# --- calibration -----------------------------------------------------------------------------------------


@query(O.with_edges(O.GAPS, body="SELECT edge_id, src, protocol, round(gap, 6) AS gap FROM gaps"))
def inter_arrival_gaps(spark, sf):
    return calibration.inter_arrival_gaps(read_event_edges(spark, sf)).select("edge_id", "src", "protocol", r6("gap").alias("gap"))


CALIBRATION = O.with_edges(O.RATES, O.GAPS, body="""
SELECT r.protocol, count(gap) AS sample_count, round(CASE WHEN count(gap) >= 30 THEN median(gap) END, 5) AS median_gap_seconds,
       round(CASE WHEN count(gap) >= 30 THEN ln(2) / median(gap) END, 12) AS suggested_lambda_p,
       round(CASE WHEN count(gap) >= 30 THEN median(gap) / 3600 END, 6) AS suggested_half_life_hours,
       any_value(r.lambda_p) AS current_lambda_p, count(gap) >= 30 AS sufficient_data
FROM rates r LEFT JOIN gaps g ON g.protocol = r.protocol GROUP BY r.protocol""")


def calibration_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "median_gap_seconds": F.round("median_gap_seconds", 5),
            "suggested_lambda_p": F.round("suggested_lambda_p", 12),
            "suggested_half_life_hours": r6("suggested_half_life_hours"),
        }
    )


@query(CALIBRATION)
def calibrate_decay(spark, sf):
    return calibration_columns(calibration.calibrate_decay(read_event_edges(spark, sf)))


@query(CALIBRATION)
def calibrate_decay_split(spark, sf):
    return calibration_columns(calibration.calibrate_decay(read_event_edges(spark, sf), hot_rows=SPLIT_ROWS, split=True))


@query(CALIBRATION)
def calibration_report(spark, sf):
    """The report written as JSON and read back."""
    report = calibration.calibrate_decay(read_event_edges(spark, sf))
    path = scale.scratch_path(spark)
    tables.write_report(report, path)
    return calibration_columns(spark.read.schema(report.schema).json(path).select(*report.columns))


@query(O.with_edges(O.GAPS, O.TICKS, body="SELECT tick, t, protocol, sample_count, round(median, 5) AS median FROM medians"))
def rolling_gap_medians(spark, sf):
    m = calibration.rolling_gap_medians(read_event_edges(spark, sf))
    return m.select("tick", "t", "protocol", "sample_count", F.round("median", 5).alias("median"))


MANY_PROTOCOLS = O.GAPS.replace("FROM edges)", "FROM (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 'P' || event_id ELSE protocol END AS protocol) FROM edges))")


@query(O.with_edges(MANY_PROTOCOLS, O.TICKS, body="SELECT tick, t, protocol, sample_count, round(median, 5) AS median FROM medians"))
def rolling_gap_medians_many_protocols(spark, sf):
    """Every second edge has a protocol text of its own."""
    n = F.col("raw_event_id").cast("bigint")
    edges = read_event_edges(spark, sf).withColumn("protocol", F.when(n % 2 == 0, F.concat(F.lit("P"), n.cast("string"))).otherwise(F.col("protocol")))
    m = calibration.rolling_gap_medians(edges)
    return m.select("tick", "t", "protocol", "sample_count", F.round("median", 5).alias("median"))


RATE_FOLD = """
, steps AS (
  SELECT m.*, ln(2) / m.median AS suggested, row_number() OVER (PARTITION BY m.protocol ORDER BY tick) AS rn FROM medians m),
fold AS (
  SELECT protocol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DOUBLE) AS previous, CAST(NULL AS DOUBLE) AS suggested,
         lambda_p AS applied, 0 AS sample_count, CAST(NULL AS DOUBLE) AS t FROM rates
  UNION ALL
  SELECT s.protocol, s.rn, f.applied, s.suggested,
         least(greatest(s.suggested, f.applied * CAST(0.75 AS DOUBLE)), f.applied * CAST(1.25 AS DOUBLE)), s.sample_count, s.t
  FROM fold f JOIN steps s ON s.protocol = f.protocol AND s.rn = f.rn + 1)
""".lstrip()


@query(O.with_edges(O.RATES, O.GAPS, O.TICKS, body=RATE_FOLD + """
SELECT protocol, t, sample_count, round(previous, 12) AS previous_lambda_p, round(suggested, 12) AS suggested_lambda_p,
       round(applied, 12) AS applied_lambda_p FROM fold WHERE rn > 0 AND applied <> previous""".lstrip()))
def adaptive_recalibration(spark, sf):
    return rate_columns(calibration.adaptive_recalibration(read_event_edges(spark, sf)))


def rate_columns(changes: DataFrame) -> DataFrame:
    rates = ("previous_lambda_p", "suggested_lambda_p", "applied_lambda_p")
    return changes.select("protocol", "t", "sample_count", *[F.round(c, 12).alias(c) for c in rates])


@query(ORACLE["adaptive_recalibration"])
def adaptive_recalibration_split(spark, sf):
    medians = calibration.rolling_gap_medians(read_event_edges(spark, sf), hot_rows=SPLIT_ROWS, split=True)
    return rate_columns(calibration.recalibrate(medians, hot_rows=SPLIT_ROWS))


@query(O.with_edges(O.RATES, O.GAPS, O.TICKS, body=RATE_FOLD + """
, held AS (SELECT protocol, t, applied FROM fold WHERE rn > 0 AND applied <> previous)
SELECT e.edge_id, e.t_e, round(coalesce(h.applied, r.lambda_p), 12) AS lambda_p,
       round(e.w_0 * exp(-coalesce(h.applied, r.lambda_p) * 3600), 6) AS w_hour_later
FROM edges e ASOF LEFT JOIN held h ON e.protocol = h.protocol AND e.t_e >= h.t JOIN rates r ON r.protocol = e.protocol""".lstrip()))
def rates_in_force(spark, sf):
    """Each edge's rate by the changes made until its own time, and its weight an hour later."""
    edges = read_event_edges(spark, sf)
    rated = decay.rates_in_force(edges, calibration.adaptive_recalibration(edges))
    later = F.col("w_0") * F.exp(-F.col("lambda_p") * 3600)
    return rated.select("edge_id", "t_e", F.round("lambda_p", 12).alias("lambda_p"), r6(later).alias("w_hour_later"))


# --- graph ---------------------------------------------------------------------------------------------------


@query(O.with_edges(body="""
SELECT edge_id, any_value(w_0 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS w_0,
       any_value(CASE WHEN event_id % 4 = 0 THEN 'second' ELSE 'events' END) AS source_system FROM edges GROUP BY edge_id"""))
def upserted_edges(spark, sf):
    """Last write wins: every fourth edge is written again with another weight."""
    first = read_event_edges(spark, sf).withColumn("written", F.lit(1))
    again = first.filter(F.col("raw_event_id").cast("bigint") % 4 == 0).withColumns(
        {"w_0": F.col("w_0") + 1, "source_system": F.lit("second"), "written": F.lit(2)}
    )
    return E.upsert_edges(E.union_edges(first, again), "written").select("edge_id", "w_0", "source_system")


@query(O.with_edges(O.COLD, body="SELECT edge_id FROM active"))
def removed_edges(spark, sf):
    return E.remove_edges(read_event_edges(spark, sf), pruned(spark, sf).cold).select("edge_id")


@query(O.with_edges(body="SELECT count(*) AS active_edges FROM edges"))
def active_graph_size(spark, sf):
    return E.active_graph_size(read_event_edges(spark, sf))


@query(O.with_edges(body="""
SELECT src AS node, dst AS neighbor, edge_id FROM edges UNION ALL SELECT dst, src, edge_id FROM edges WHERE src <> dst"""))
def neighbors_both(spark, sf):
    return E.neighbors(read_event_edges(spark, sf), "both")


@query(O.with_edges(body="SELECT dst AS node, count(*) AS incoming, count(DISTINCT src) AS sources FROM edges GROUP BY dst"))
def neighbors_in(spark, sf):
    rows = E.neighbors(read_event_edges(spark, sf), "in")
    return rows.groupBy("node").agg(F.count("*").alias("incoming"), F.count_distinct("neighbor").alias("sources"))


@query(O.with_edges(body="""
, numbered AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))
SELECT edge_id, s.idx AS src_idx, d.idx AS dst_idx FROM edges e JOIN numbered s ON s.node = e.src JOIN numbered d ON d.node = e.dst""".lstrip()))
def edge_index(spark, sf):
    return graph.edge_index(read_event_edges(spark, sf))[1]


@query(O.with_edges(body="SELECT t_e, edge_id, row_number() OVER (ORDER BY t_e, edge_id) - 1 AS position FROM edges"))
def replay_positions(spark, sf):
    return scale.dense_index(read_event_edges(spark, sf).select("t_e", "edge_id"), ["t_e", "edge_id"], "position")


@query(O.with_edges(O.SIGNALS, O.LATEST_Z, body="SELECT e.dst AS node, count(*) AS edges, round(avg(coalesce(l.z_score, 0)), 5) AS near_z FROM edges e LEFT JOIN latest l ON l.entity = e.src GROUP BY e.dst"))
def neighbour_means(spark, sf):
    edges = read_event_edges(spark, sf)
    z = baseline.latest_deviation(baseline.deviation_signals(edges))
    features = graph.nodes(edges).join(z, F.col("node") == F.col("entity"), "left").select("node", F.coalesce("z_score", F.lit(0.0)).alias("z"))
    pairs = graph.edge_pairs(edges)
    means = graph.neighbour_means(pairs, features, ["z"])
    counts = pairs.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("edges"))
    return counts.join(means, "node").select("node", "edges", F.round("near_z", 5).alias("near_z"))


SCORES = (O.SIGNALS, O.LATEST_Z, O.scores())


@query(O.with_edges(*SCORES, body="SELECT entity_id, round(score, 4) AS score FROM scores"))
def entity_scores(spark, sf):
    edges = read_event_edges(spark, sf)
    z = baseline.latest_deviation(baseline.deviation_signals(edges))
    return graph.score_entities(edges, z).select("entity_id", F.round("score", 4).alias("score"))


@query(O.with_edges(*SCORES, body="SELECT entity_id, round(score, 4) AS score FROM scores ORDER BY abs(score) DESC, entity_id LIMIT 20"))
def top_entities(spark, sf):
    top = runs.score_replay(read_event_edges(spark, sf), top_n=20)
    return top.select("entity_id", F.round("score", 4).alias("score"))


@query(O.with_edges(O.COLD, O.SIGNALS, O.LATEST_Z, O.scores("active"), body=f"""
SELECT entity_id, round(score, 4) AS score, CAST({NOW} AS DOUBLE) AS t, 'scheduled' AS trigger FROM scores"""))
def scheduled_scores(spark, sf):
    z = baseline.latest_deviation(baseline.deviation_signals(read_event_edges(spark, sf)))
    scored = graph.scheduled_scores(decay.active_at(read_event_edges(spark, sf), NOW, EPS), z, NOW)
    return scored.select("entity_id", F.round("score", 4).alias("score"), "t", "trigger")


NEIGHBORHOOD = """
area AS (
  SELECT chain_key, entity_id FROM (SELECT DISTINCT chain_key FROM completions) JOIN (
    SELECT src AS chain_key, dst AS entity_id FROM active UNION SELECT dst, src FROM active) USING (chain_key)
  UNION SELECT chain_key, chain_key FROM completions)"""


@query(O.with_edges(O.COLD, O.chains(), NEIGHBORHOOD, body="SELECT chain_key, entity_id FROM area"))
def alert_neighborhoods(spark, sf):
    edges = read_event_edges(spark, sf)
    return graph.alert_neighborhood(M.match_motifs(edges), decay.active_at(edges, NOW, EPS)).select("chain_key", "entity_id")


@query(O.with_edges(O.COLD, O.chains(), NEIGHBORHOOD, O.SIGNALS, O.LATEST_Z, O.scores("active"), body="""
SELECT a.chain_key, c.motif_name, s.entity_id, round(s.score, 4) AS score, max(c.completed_at) AS t, count(*) AS alerts, 'motif_completion' AS trigger
FROM area a JOIN scores s ON s.entity_id = a.entity_id JOIN completions c ON c.chain_key = a.chain_key GROUP BY ALL"""))
def alert_scores(spark, sf):
    edges = read_event_edges(spark, sf)
    z = baseline.latest_deviation(baseline.deviation_signals(edges))
    scored = graph.score_alert_neighborhoods(M.match_motifs(edges), decay.active_at(edges, NOW, EPS), z)
    return scored.withColumn("score", F.round("score", 4))


# --- operations --------------------------------------------------------------------------------------------------


AUDIT = """
audit AS (
  SELECT 'prune' AS type, edge_id, src, dst, round(w_at_prune, 6) AS w_at_prune, pruned_at, CAST(NULL AS VARCHAR) AS motif_name,
         CAST(NULL AS VARCHAR) AS chain_key, CAST(NULL AS VARCHAR) AS triggering_edge_id, CAST(NULL AS DOUBLE) AS reset_at FROM cold
  UNION ALL SELECT 'motif_reset', NULL, NULL, NULL, NULL, NULL, motif_name, chain_key, triggering_edge_id, reset_at FROM resets)"""
AUDITED = (O.COLD, PRUNES, O.chains(prunes="prunes"), AUDIT)


def audit(spark: SparkSession, sf: str) -> DataFrame:
    resets = M.motif_resets(read_event_edges(spark, sf), early_prunes(spark, sf))
    return ops.audit_records(pruned(spark, sf).cold, resets)


@query(O.with_edges(*AUDITED, body="SELECT * FROM audit"))
def audit_records(spark, sf):
    """Records appended as JSON lines and read back."""
    records = audit(spark, sf)
    path = scale.scratch_path(spark)
    tables.write_audit(records, path)
    return spark.read.schema(records.schema).json(path).select(
        "type", "edge_id", "src", "dst", r6("w_at_prune").alias("w_at_prune"), "pruned_at",
        "motif_name", "chain_key", "triggering_edge_id", "reset_at",
    )


@query(O.with_edges(*AUDITED, body="SELECT type, count(*) AS records FROM audit GROUP BY type"))
def audit_counts(spark, sf):
    return ops.audit_counts(audit(spark, sf))


@query(O.with_edges(body="""
, ties AS (SELECT CAST(floor(t_e / 900) * 900 AS DOUBLE) AS t FROM edges)
SELECT DISTINCT t, round((SELECT count(*) FROM ties o WHERE o.t BETWEEN e.t - 3600 AND e.t) / CAST(3600 AS DOUBLE), 9) AS rate FROM ties e"""))
def rolling_event_rate(spark, sf):
    """One row for each distinct time; quarter hours, so that many events share one."""
    ties = read_event_edges(spark, sf).select((F.floor(F.col("t_e") / 900) * 900).cast("double").alias("t"))
    return ops.rolling_rate(ties, "t", 3600.0).select("t", F.round("rate", 9).alias("rate"))


@query(O.with_edges(body=f"SELECT round(count(*) / CAST(86400 AS DOUBLE), 9) AS rate FROM edges WHERE t_e >= {NOW} - 86400"))
def recent_event_rate(spark, sf):
    return ops.rate_at(read_event_edges(spark, sf), "t_e", NOW, 86400.0).select(F.round("rate", 9).alias("rate"))


@query(O.with_edges(body="SELECT t_e AS t, w_0 AS value FROM edges ORDER BY t_e DESC LIMIT 1000"))
def last_readings(spark, sf):
    return ops.last_readings(read_event_edges(spark, sf).select(F.col("t_e").alias("t"), F.col("w_0").alias("value")))


@query(O.with_edges(O.COLD, PRUNES, O.chains(prunes="prunes"), body=f"""
SELECT (SELECT count(*) FROM active) AS active_graph_size,
       round((SELECT count(*) FROM cold WHERE pruned_at >= {NOW} - 86400) / CAST(86400 AS DOUBLE), 9) AS prune_rate_per_second,
       round(CAST({EPS} AS DOUBLE), 6) AS epsilon,
       round((SELECT count(*) FROM completions WHERE completed_at >= {NOW} - 86400) / CAST(86400 AS DOUBLE), 9) AS motif_hit_rate_per_second,
       round((SELECT count(*) FROM resets WHERE reset_at >= {NOW} - 86400) / CAST(86400 AS DOUBLE), 9) AS motif_reset_rate_per_second"""))
def metrics_snapshot(spark, sf):
    edges = read_event_edges(spark, sf)
    result = decay.prune_pass(edges, NOW, FIXED)
    matched = M.run_motifs(edges, prunes=early_prunes(spark, sf))
    readings = result.stats.withColumn("t", F.lit(NOW))
    snap = ops.metrics_snapshot(NOW, result.active, result.cold, matched.completions, matched.resets, readings, window=86400.0)
    return snap.select(
        "active_graph_size", *[F.round(c, 9).alias(c) for c in ("prune_rate_per_second", "motif_hit_rate_per_second", "motif_reset_rate_per_second")],
        r6("epsilon").alias("epsilon"),
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """A disposition per event, as analysts would note them."""
    n = F.col("event_id")
    return events(spark, sf).select(
        F.concat(F.lit("motif_"), F.col("event_type")).alias("motif_name"),
        F.concat(F.lit("Machine:C"), (n % 40).cast("string")).alias("chain_key"),
        F.when(F.col("value") >= 40, "true_positive").otherwise("false_positive").alias("disposition"),
        utc_seconds().alias("noted_at"),
        F.lit(None).cast("string").alias("analyst"),
    )


PRIORITY = """
SELECT 'motif_' || event_type AS motif_name, count(*) FILTER (value >= 40) AS true_positives,
       count(*) FILTER (value < 40) AS false_positives,
       round((count(*) FILTER (value >= 40) + 1) / CAST(count(*) + 2 AS DOUBLE), 6) AS priority_score FROM events GROUP BY event_type"""


@query(PRIORITY)
def motif_priority(spark, sf):
    return ops.motif_priority(feedback(spark, sf)).withColumn("priority_score", r6("priority_score"))


@query(PRIORITY)
def ranked_motifs(spark, sf):
    return ops.ranked_motifs(feedback(spark, sf)).withColumn("priority_score", r6("priority_score"))


# --- streams over the event table ---------------------------------------------------------------------------------


STREAM_BATCHES = 4


def dealt_streams(
    spark: SparkSession, table: DataFrame, batch: Column, batches: int = STREAM_BATCHES
) -> Callable[[], DataFrame]:
    """Opens a table as a finite stream: a micro-batch for each value of ``batch``, in ascending order.

    The table is written once, however many streams are opened. Each is written in as many files as tasks run side by side, and a trigger takes as many files.
    """
    path, files = scale.scratch_path(spark), spark.sparkContext.defaultParallelism
    for k in range(batches):  # one after the other: the source takes older files first
        table.filter(batch == k).repartition(files).write.parquet(f"{path}/part-{k}")
    return lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part-*")


def dealt_stream(spark: SparkSession, table: DataFrame, batch: Column, batches: int = STREAM_BATCHES) -> DataFrame:
    return dealt_streams(spark, table, batch, batches)()


def event_streams(spark: SparkSession, sf: str) -> Callable[[], DataFrame]:
    """Opens the event table as a finite stream of edges: four micro-batches in order of time."""
    table = events(spark, sf)
    last = table.agg(F.max("event_id")).first()[0]
    opened = dealt_streams(spark, table, F.floor(F.col("event_id") * STREAM_BATCHES / (last + 1)))
    return lambda: event_edges(opened())


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return event_streams(spark, sf)()


#: Events come up to two days late, by the event's number (microseconds).
DELAY_US = 172_800_000_000
ARRIVALS = f"""
arrived AS (
  SELECT e.*, epoch_us(v.ts) + (e.event_id * 7919 % 1000) * {DELAY_US // 1000} AS due FROM events v JOIN edges e ON e.event_id = v.event_id),
dealt AS (
  SELECT *, ((due - (SELECT min(due) FROM arrived)) * {STREAM_BATCHES}) // (SELECT max(due) - min(due) + 1 FROM arrived) AS b FROM arrived),
latest_by AS (SELECT b, max(2 * floor(t_e * 1000)) AS clock FROM dealt GROUP BY b),
kept AS (
  SELECT * FROM dealt d
  WHERE 2 * floor(t_e * 1000) > coalesce((SELECT max(clock) FROM latest_by l WHERE l.b < d.b - 1), 0) - 2 * 86400 * 1000)"""


def late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream of edges out of order: four micro-batches, and one with a far later
    edge that fits no chain, which lets the stream's time pass all others."""
    delay = F.col("event_id") * 7919 % 1000 * (DELAY_US // 1000)
    table = events(spark, sf).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")) + delay)
    low, high = table.agg(F.min("_at"), F.max("_at")).first()
    dealt = table.withColumn("_b", F.floor((F.col("_at") - low) * STREAM_BATCHES / F.lit(high - low + 1))).drop("_at")
    closing = dealt.orderBy(F.desc("ts")).limit(1).withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 90 DAYS"), "user_id": F.lit(-1).cast(table.schema["user_id"].dataType),
         "event_type": F.lit("view"), "_b": F.lit(STREAM_BATCHES).cast("long")}
    )
    return event_edges(dealt_stream(spark, dealt.unionByName(closing), F.col("_b"), STREAM_BATCHES + 1))


def run_stream(frame: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Run a stream over everything available into the shared folder and read the result."""
    spark = frame.sparkSession
    path = scale.scratch_path(spark)
    writer = frame.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
    with scale.settings(spark, keyed.STATE_ON_DISK):
        run = writer.trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def run_batches(frame: DataFrame, sink: Callable[[DataFrame, int], None]) -> None:
    path = scale.scratch_path(frame.sparkSession)
    writer = frame.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


#: For a stream of many small micro-batches: all reports are kept, the log of the files read is rewritten less often,
#: and checkpoint files are written and renamed by the plain file system.
SMALL_BATCHES = {
    "spark.sql.streaming.numRecentProgressUpdates": str(2**31 - 1),
    "spark.sql.streaming.fileSource.log.compactInterval": "100",
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


def observed_batches(frame: DataFrame, *held: Column) -> list[tuple]:
    """Run a stream over everything available; (number, ``held``) of each of its micro-batches, in their order.

    Not with ``availableNow``, which looks at all files again for each micro-batch; the plain trigger keeps the list of those unread.
    """
    spark = frame.sparkSession
    writer = frame.observe("held", *held).writeStream.format("noop").option("checkpointLocation", scale.scratch_path(spark))
    with scale.settings(spark, SMALL_BATCHES):
        run = writer.start()
        try:
            run.processAllAvailable()
            reports = {report["batchId"]: report["observedMetrics"]["held"] for report in run.recentProgress if report["numInputRows"]}
        finally:
            run.stop()
    return [(number, *row) for number, row in sorted(reports.items())]


@query(ORACLE["deviation_signals"])
def stream_deviation_signals(spark, sf):
    return signal_columns(run_stream(keyed.stream_deviation(event_stream(spark, sf)), keyed.SIGNAL_LAYOUT))


@query(ORACLE["match_motifs"])
def stream_motif_completions(spark, sf):
    found = run_stream(keyed.stream_motifs(event_stream(spark, sf)), M.EVENT)
    return completion_columns(keyed.completions(found))


@query(ORACLE["match_motifs"])
def stream_motifs_reordered(spark, sf):
    """Edges up to two days out of order, none late: the chains of the batch match."""
    return completion_columns(keyed.completions(run_stream(keyed.ordered_motifs(late_stream(spark, sf), lateness=172_800), M.EVENT)))


@query(O.with_edges(ARRIVALS, O.chains(timeout=True).replace("FROM edges", "FROM kept"), body=COMPLETIONS))
def stream_motifs_late(spark, sf):
    """Lateness of one day: older edges are left out once the watermark has passed them; chains time out in event time."""
    found = run_stream(keyed.ordered_motifs(late_stream(spark, sf), lateness=86_400, timeout="event_time"), M.EVENT)
    return completion_columns(keyed.completions(found))


@query(O.with_edges(O.RATES, body="""
, dealt AS (SELECT *, floor(event_id * 4 / ((SELECT max(event_id) FROM edges) + 1)) AS b FROM edges JOIN rates USING (protocol)),
passes AS (SELECT b, max(t_e) AS now, lag(max(t_e)) OVER (ORDER BY b) AS before FROM dealt GROUP BY b),
weighed AS (
  SELECT p.b, now, w_0 * exp(-lambda_p * greatest(0.0, now - t_e)) AS w
  FROM passes p JOIN dealt d ON d.b <= p.b AND (d.b = p.b OR w_0 * exp(-lambda_p * greatest(0.0, before - t_e)) >= 0.05))
SELECT count(*) AS scanned, count(*) FILTER (w < 0.05) AS pruned, round(CAST(0.05 AS DOUBLE), 6) AS epsilon, max(now) AS t FROM weighed GROUP BY b"""))
def stream_prune_passes(spark, sf):
    """A pass after each of four micro-batches."""
    sink = batches.PruneSink(scale.scratch_path(spark), FIXED)
    run_batches(event_stream(spark, sf), sink)
    return sink.passes(spark).select("scanned", "pruned", r6("epsilon").alias("epsilon"), "t")


@query(O.with_edges(body="SELECT edge_id, w_0 * CASE WHEN event_id % 7 = 0 THEN 0.25 WHEN event_id % 5 = 0 THEN 0.5 ELSE 1 END AS w_0 FROM edges"))
def stream_upserts(spark, sf):
    """Edges sent again with a smaller weight, in the same micro-batch and in the next: the later write counts."""
    edges, n = read_event_edges(spark, sf).select(*EDGE.fieldNames()), F.col("raw_event_id").cast("bigint")
    again = lambda every, share: edges.filter(n % every == 0).withColumn("w_0", F.col("w_0") * share)
    first = again(5, 0.5).withColumn("sent", F.lit(1)).unionByName(edges.withColumn("sent", F.lit(0)))
    second = again(7, 0.25).withColumns({"sent": F.lit(0), "_b": F.lit(1)})
    stream = dealt_stream(spark, first.withColumn("_b", F.lit(0)).unionByName(second), F.col("_b"), 2)
    sink = batches.PruneSink(scale.scratch_path(spark), decay.PrunePolicy(0.0, 0.0), arrival="sent")
    run_batches(stream, sink)
    return sink.live(spark, 1).select("edge_id", "w_0")


@query(ORACLE["adaptive_recalibration"])
def stream_recalibration(spark, sf):
    sink = batches.RecalibrationSink(scale.scratch_path(spark))
    run_batches(event_stream(spark, sf), sink)
    return rate_columns(sink.events(spark))


REPLAY_SHARD, REPLAY_FILES = 500, 5


@query(O.with_edges(body=f"""
SELECT (n // {REPLAY_SHARD}) // {REPLAY_FILES} AS batch, count(*) AS edges, min(t_e) AS first_t, max(t_e) AS last_t
FROM (SELECT t_e, row_number() OVER (ORDER BY t_e, edge_id) - 1 AS n FROM edges) GROUP BY 1"""))
def replay_batches(spark, sf):
    """What each micro-batch of a replay in event order holds.

    The stream observes it in the tasks that read the micro-batch, and its report of each micro-batch tells it: one row for each.
    """
    path = scale.scratch_path(spark)
    tables.write_replay(read_event_edges(spark, sf), path, REPLAY_SHARD)
    held = (F.count("*").alias("edges"), F.min("t_e").alias("first_t"), F.max("t_e").alias("last_t"))
    reports = observed_batches(tables.replay_stream(spark, path, REPLAY_FILES).select("t_e"), *held)
    return spark.createDataFrame(reports, "batch long, edges long, first_t double, last_t double")


@query(ORACLE["normalized_edges"])
def replayed_edges(spark, sf):
    """Edges staged as JSON lines and replayed as a finite stream."""
    path = scale.scratch_path(spark)
    tables.write_staged_edges(read_event_edges(spark, sf), path)
    replayed = run_stream(tables.replay_stream(spark, path, files_per_batch=4), EDGE)
    return replayed.select("edge_id", "src", "dst", "protocol", "t_e", "src_type", "dst_type", "w_0", "source_system")


@query(O.with_edges(O.RATES, O.SIGNALS, """
dealt AS (SELECT *, floor(event_id * 4 / ((SELECT max(event_id) FROM edges) + 1)) AS b FROM edges JOIN rates USING (protocol)),
passes AS (SELECT b, max(t_e) AS now, lag(max(t_e)) OVER (ORDER BY b) AS before FROM dealt GROUP BY b),
weighed AS (
  SELECT d.*, p.b AS pass, now, w_0 * exp(-lambda_p * greatest(0.0, now - t_e)) AS w
  FROM passes p JOIN dealt d ON d.b <= p.b AND (d.b = p.b OR w_0 * exp(-lambda_p * greatest(0.0, before - t_e)) >= 0.05)),
prunes AS (SELECT edge_id, now AS pruned_at FROM weighed WHERE w < 0.05),
active AS (SELECT * FROM weighed WHERE pass = 3 AND w >= 0.05)""", O.chains(prunes="prunes"), NEIGHBORHOOD, body="""
SELECT 'anomalies' AS product, count(*) AS n FROM signals WHERE abs(z_score) >= 3
UNION ALL SELECT 'completions', count(*) FROM completions
UNION ALL SELECT 'active_graph_size', count(*) FROM active
UNION ALL SELECT 'resets', count(*) FROM resets
UNION ALL SELECT 'audit_prune', count(*) FROM prunes
UNION ALL SELECT 'audit_motif_reset', count(*) FROM resets
UNION ALL SELECT 'alert_scores', count(*) FROM (
  SELECT DISTINCT motif_name, chain_key, entity_id FROM area JOIN completions USING (chain_key)
  JOIN (SELECT src AS entity_id FROM active UNION SELECT dst FROM active) USING (entity_id))"""))
def continuous_products(spark, sf):
    """All products of a continuous run over four micro-batches, counted.

    With fixed rates: adapted ones reach a pass when they are ready, so counts would depend on timing.
    """
    run = continuous.ContinuousRun(scale.scratch_path(spark), FIXED)
    for started in run.start(spark, event_streams(spark, sf)):
        started.awaitTermination()
    size = run.snapshot(spark, NOW).select(F.lit("active_graph_size").alias("product"), F.col("active_graph_size").alias("n"))
    counted = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("product"), "n")
    found, records = run.motif_events(spark), run.audit(spark)
    parts = [
        size, counted("anomalies", run.anomalies(spark)), counted("completions", keyed.completions(found)), counted("resets", keyed.resets(found)),
        counted("audit_prune", records.filter("type = 'prune'")), counted("audit_motif_reset", records.filter("type = 'motif_reset'")),
        counted("alert_scores", run.alert_scores(spark).select("motif_name", "chain_key", "entity_id").distinct()),
    ]
    return E.union_edges(*parts)


@query(O.with_edges(O.RATES, """
dealt AS (SELECT *, floor(event_id * 4 / ((SELECT max(event_id) FROM edges) + 1)) AS b FROM edges JOIN rates USING (protocol)),
passes AS (SELECT b, max(t_e) AS now, lag(max(t_e)) OVER (ORDER BY b) AS before FROM dealt GROUP BY b),
prunes AS (
  SELECT edge_id, now AS pruned_at
  FROM passes p JOIN dealt d ON d.b <= p.b AND (d.b = p.b OR w_0 * exp(-lambda_p * greatest(0.0, before - t_e)) >= 0.05)
  WHERE w_0 * exp(-lambda_p * greatest(0.0, now - t_e)) < 0.05)""", O.chains(prunes="prunes"), body=RESETS))
def stream_motif_resets(spark, sf):
    """Chains that prune passes reset: edges and the pass sink's prunes, two streams in one order of time."""
    sink = batches.PruneSink(scale.scratch_path(spark), FIXED)
    edges = event_streams(spark, sf)
    run_batches(edges(), sink)
    found = run_stream(keyed.ordered_motifs(edges(), pruned=sink.prune_stream(spark)), M.EVENT)
    return reset_columns(keyed.resets(found))
