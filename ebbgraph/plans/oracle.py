"""The registered queries in DuckDB SQL, written independently of the Spark plans.

Sequential rules (baseline recursion, chain matching, rate changes) are recursive
queries over row numbers here, where the Spark side uses windows or parallel folds.
"""

from __future__ import annotations

from ebbgraph.config import Motif, SEED_DECAY, SEED_DEFAULT_LAMBDA, load_motifs
from ebbgraph.operators import graph

NOW = 1706659200.0
EPS = 0.05

EDGES = """
raw_edges AS (
  SELECT CASE event_type
           WHEN 'signup' THEN 'Machine:C' || (user_id % 40)
           WHEN 'error' THEN 'User:C' || (user_id % 40) || '-admin'
           WHEN 'purchase' THEN 'User:svc' || (user_id % 40)
           ELSE 'User:u' || user_id END AS src,
         CASE event_type WHEN 'click' THEN 'User:svc' ELSE 'Machine:C' END || (event_id % 40) AS dst,
         CASE event_type WHEN 'error' THEN 'RemoteCodeExecution' WHEN 'purchase' THEN 'FileTransfer'
           ELSE 'Authentication' END AS edge_type,
         CASE event_type WHEN 'error' THEN 'RDP' WHEN 'purchase' THEN 'SMB' WHEN 'view' THEN 'DNS'
           ELSE 'Kerberos' END AS protocol,
         epoch_us(ts) / 1e6 AS t_e, value / 50.0 AS w_0, CAST(event_id AS VARCHAR) AS raw_event_id,
         event_type, event_id, user_id, value
  FROM events),
edges AS (
  SELECT substr(sha256(src || '|' || dst || '|' || protocol || '|' || CAST(t_e AS VARCHAR)), 1, 32) AS edge_id,
         src, dst, edge_type, protocol, t_e, w_0, split_part(src, ':', 1) AS src_type,
         split_part(dst, ':', 1) AS dst_type, 'events' AS source_system, raw_event_id,
         event_type, event_id, user_id, value
  FROM raw_edges)"""

RATES = "rates(protocol, lambda_p) AS (VALUES " + ", ".join(
    f"('{name}', CAST({row[0]!r} AS DOUBLE))" for name, row in SEED_DECAY.items()
) + ")"

WEIGHTED = f"""
{RATES},
weighted AS (
  SELECT e.*, coalesce(r.lambda_p, CAST({SEED_DEFAULT_LAMBDA!r} AS DOUBLE)) AS lambda_p,
         w_0 * exp(-coalesce(r.lambda_p, CAST({SEED_DEFAULT_LAMBDA!r} AS DOUBLE)) * greatest(0.0, CAST({NOW} AS DOUBLE) - t_e)) AS w
  FROM edges e LEFT JOIN rates r USING (protocol))"""

COLD = f"""
{WEIGHTED},
cold AS (
  SELECT edge_id, src, dst, edge_type, protocol, t_e, w_0, w AS w_at_prune,
         CAST({NOW} AS DOUBLE) AS pruned_at, source_system, raw_event_id
  FROM weighted WHERE w < {EPS}),
active AS (SELECT * FROM weighted WHERE w >= {EPS})"""

SIGNALS = """
obs AS (
  SELECT src AS entity, protocol, t_e AS t, w_0 AS value, edge_id,
         row_number() OVER (PARTITION BY src, protocol ORDER BY t_e, edge_id) AS rn
  FROM edges),
walk AS (
  SELECT entity, protocol, t, value, edge_id, rn, value AS mean, CAST(0 AS DOUBLE) AS var, CAST(NULL AS DOUBLE) AS z
  FROM obs WHERE rn = 1
  UNION ALL
  SELECT o.entity, o.protocol, o.t, o.value, o.edge_id, o.rn, w.mean + 0.3 * (o.value - w.mean),
         0.7 * (w.var + 0.3 * (o.value - w.mean) * (o.value - w.mean)),
         CASE WHEN w.rn >= 2 AND w.var > 0 THEN (o.value - w.mean) / sqrt(w.var) END
  FROM walk w JOIN obs o ON o.entity = w.entity AND o.protocol = w.protocol AND o.rn = w.rn + 1),
signals AS (SELECT entity, protocol, t, value, mean AS baseline_mean, sqrt(var) AS baseline_std,
                   CAST(rn AS INTEGER) AS sample_count, z AS z_score, edge_id FROM walk)"""

LABELS = """
labels_t AS (
  SELECT row_number() OVER () AS label_id, t_e AS t, 'C' || (user_id % 40) || '-admin' AS user,
         'C' || (user_id % 40) AS source_computer, 'C' || (event_id % 40) AS destination_computer
  FROM edges WHERE event_type = 'error' AND value >= 150)"""


def with_edges(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join([EDGES, *parts]) + "\n" + body


# --- motifs ---------------------------------------------------------------------------


def _in(column: str, allowed: tuple[str, ...]) -> str:
    return f"{column} IN (" + ", ".join(f"'{a}'" for a in allowed) + ")"


def _step_score(step, fuzzy: bool) -> str:
    roles = [_in(c, a) for c, a in (("src_type", step.src_types), ("dst_type", step.dst_types)) if a]
    technique = [_in(c, a) for c, a in (("edge_type", step.edge_types), ("protocol", step.protocols)) if a]
    if not fuzzy or not technique:
        tests = roles + technique
        return f"CASE WHEN {' AND '.join(tests) or 'TRUE'} THEN CAST(1 AS DOUBLE) END"
    met = " + ".join(f"CAST({t} AS INTEGER)" for t in technique)
    return f"CASE WHEN {' AND '.join(roles) or 'TRUE'} AND {met} > 0 THEN ({met}) / CAST({len(technique)} AS DOUBLE) END"


def _key(step) -> str:
    if step.key_resolver == "identity":
        return step.key_field
    name = f"regexp_extract({step.key_field}, '^[^:]*:([\\p{{L}}\\p{{N}}]+)', 1)"
    return f"CASE WHEN {name} <> '' THEN 'Machine:' || {name} END"


def candidates(motifs: list[Motif] | None = None, fuzzy: bool = False) -> str:
    rows = []
    for motif in load_motifs() if motifs is None else motifs:
        for stage, step in enumerate(motif.steps):
            rows.append(
                f"SELECT '{motif.name}' AS motif_name, {_key(step)} AS chain_key, {stage} AS stage, "
                f"{len(motif.steps)} AS n_steps, CAST({motif.window_seconds} AS DOUBLE) AS window_seconds, "
                f"{_step_score(step, fuzzy)} AS score, edge_id, t_e FROM edges"
            )
    union = "\nUNION ALL ".join(rows)
    return f"cands AS (SELECT * FROM ({union}) WHERE score IS NOT NULL AND chain_key IS NOT NULL)"


def chains(
    motifs: list[Motif] | None = None, *, fuzzy: bool = False, min_confidence: float = 0.5,
    timeout: bool = False, prunes: str | None = None,
) -> str:
    """One chain slot per key, one row per iteration."""
    pruned = (
        f"(SELECT min(pruned_at) FROM {prunes} p WHERE p.edge_id = c.edge_id AND p.pruned_at >= c.t_e)"
        if prunes else "CAST(NULL AS DOUBLE)"
    )
    dies = "r.t_e + r.window_seconds" if timeout else "CAST(NULL AS DOUBLE)"
    return candidates(motifs, fuzzy) + f""",
crow AS (
  SELECT c.*, {pruned} AS pruned_at,
         row_number() OVER (PARTITION BY motif_name, chain_key ORDER BY t_e, edge_id, stage) AS rn
  FROM cands c),
machine AS (
  SELECT motif_name, chain_key, CAST(0 AS BIGINT) AS rn, 0 AS stage, CAST(NULL AS DOUBLE) AS started,
         CAST(NULL AS DOUBLE) AS last, CAST([] AS VARCHAR[]) AS ids, CAST(1 AS DOUBLE) AS conf,
         CAST(NULL AS VARCHAR) AS used, CAST(NULL AS DOUBLE) AS dies, CAST(NULL AS DOUBLE) AS kill_t,
         CAST(NULL AS VARCHAR) AS kill_id, CAST(NULL AS DOUBLE) AS completed_at,
         CAST([] AS VARCHAR[]) AS done_ids, CAST(NULL AS DOUBLE) AS done_conf,
         CAST(NULL AS DOUBLE) AS reset_at, CAST(NULL AS VARCHAR) AS reset_edge, CAST([] AS VARCHAR[]) AS reset_ids
  FROM crow WHERE rn = 1
  UNION ALL
  SELECT motif_name, chain_key, rn,
         CASE WHEN starts THEN 1 WHEN overrun OR finishes THEN 0 WHEN advances THEN r_stage + 1 WHEN live THEN stage ELSE 0 END,
         CASE WHEN starts THEN t_e ELSE started END,
         CASE WHEN starts OR advances THEN t_e ELSE last END,
         CASE WHEN starts THEN [edge_id] WHEN advances THEN list_append(ids, edge_id) ELSE ids END,
         CASE WHEN starts THEN score WHEN advances THEN conf * score ELSE conf END,
         CASE WHEN starts THEN NULL WHEN advances THEN edge_id ELSE used END,
         CASE WHEN starts OR advances THEN new_dies ELSE dies END,
         CASE WHEN starts THEN pruned_at WHEN advances THEN least(kill_t, pruned_at) ELSE kill_t END,
         CASE WHEN starts THEN CASE WHEN pruned_at IS NOT NULL THEN edge_id END
              WHEN advances AND pruned_at IS NOT NULL AND (kill_t IS NULL OR pruned_at < kill_t
                   OR (pruned_at = kill_t AND edge_id < kill_id)) THEN edge_id ELSE kill_id END,
         CASE WHEN finishes AND conf * score >= {min_confidence} THEN t_e END,
         CASE WHEN finishes THEN list_append(ids, edge_id) ELSE [] END,
         CASE WHEN finishes THEN conf * score END,
         CASE WHEN killed THEN kill_t END, CASE WHEN killed THEN kill_id END, CASE WHEN killed THEN ids ELSE [] END
  FROM (
    SELECT *, r_stage = 0 AND NOT live AS starts, may AND t_e - started > window_seconds AS overrun,
           may AND t_e - started <= window_seconds AS advances,
           may AND t_e - started <= window_seconds AND r_stage + 1 = n_steps AS finishes
    FROM (
      SELECT *, r_stage > 0 AND live AND stage = r_stage AND used IS DISTINCT FROM edge_id AS may
      FROM (
        SELECT m.motif_name, m.chain_key, r.rn, m.stage, m.started, m.last, m.ids, m.conf, m.used, m.dies,
               m.kill_t, m.kill_id, r.t_e, r.edge_id, r.stage AS r_stage, r.n_steps, r.window_seconds,
               r.score, r.pruned_at, {dies} AS new_dies,
               m.stage > 0 AND coalesce(r.t_e > m.kill_t AND (m.dies IS NULL OR m.kill_t < m.dies), FALSE) AS killed,
               m.stage > 0 AND NOT coalesce(r.t_e > m.kill_t AND (m.dies IS NULL OR m.kill_t < m.dies), FALSE)
                 AND NOT coalesce(r.t_e >= m.dies, FALSE) AS live
        FROM machine m JOIN crow r ON r.motif_name = m.motif_name AND r.chain_key = m.chain_key AND r.rn = m.rn + 1)))),
completions AS (
  SELECT motif_name, chain_key, done_ids AS matched_edges, completed_at, done_conf AS confidence
  FROM machine WHERE completed_at IS NOT NULL),
final_state AS (
  SELECT * FROM machine QUALIFY row_number() OVER (PARTITION BY motif_name, chain_key ORDER BY rn DESC) = 1),
resets AS (
  SELECT motif_name, chain_key, reset_edge AS triggering_edge_id, reset_ids AS matched_edges, reset_at
  FROM machine WHERE reset_at IS NOT NULL
  UNION ALL
  SELECT motif_name, chain_key, kill_id, ids, kill_t FROM final_state
  WHERE stage > 0 AND kill_t IS NOT NULL AND (dies IS NULL OR kill_t < dies)),
open_chains AS (
  SELECT motif_name, chain_key, stage, started AS started_at, last AS last_edge_ts, ids AS matched_edges, conf AS confidence
  FROM final_state WHERE stage > 0 AND (kill_t IS NULL OR kill_t >= dies))"""


LATEST_Z = """
latest AS (
  SELECT entity, arg_max(z_score, (t, edge_id)) AS z_score FROM signals WHERE z_score IS NOT NULL GROUP BY entity)"""

GAPS = """
all_gaps AS (
  SELECT src, protocol, t_e, edge_id,
         t_e - lag(t_e) OVER (PARTITION BY src, protocol ORDER BY t_e, edge_id) AS gap FROM edges),
gaps AS (SELECT * FROM all_gaps WHERE gap > 0)"""

# the newest 500 gaps of a protocol at each 200th edge
TICKS = """
arrivals AS (SELECT *, row_number() OVER (ORDER BY t_e, edge_id) AS n FROM all_gaps),
ticks AS (SELECT CAST(n / 200 AS BIGINT) - 1 AS tick, n, t_e AS t FROM arrivals WHERE n % 200 = 0),
numbered AS (
  SELECT protocol, gap, n, row_number() OVER (PARTITION BY protocol ORDER BY n) AS k FROM arrivals WHERE gap > 0),
reached AS (
  SELECT t.tick, t.t, t.n, g.protocol, max(g.k) AS k FROM ticks t JOIN numbered g ON g.n <= t.n GROUP BY ALL),
medians AS (
  SELECT r.tick, r.t, r.protocol, CAST(count(*) AS INTEGER) AS sample_count, median(g.gap) AS median
  FROM reached r JOIN numbered g ON g.protocol = r.protocol AND g.k <= r.k AND g.k > r.k - 500
  GROUP BY ALL HAVING count(*) >= 30)"""


# --- neighbour-averaged scores --------------------------------------------------------------


def scores(edge_table: str = "edges") -> str:
    names = [f"x{i}" for i in range(graph.FEATURES)] + ["z"]
    base = ", ".join(
        f"CAST('0x' || substr(md5(node), {4 * i + 1}, 4) AS BIGINT) / CAST(65535 AS DOUBLE) - 0.5 AS x{i}"
        for i in range(graph.FEATURES)
    )
    parts = [
        f"node_list AS (SELECT src AS node FROM {edge_table} UNION SELECT dst FROM {edge_table})",
        f"layer0 AS (SELECT node, {base}, coalesce(l.z_score, 0.0) AS z FROM node_list LEFT JOIN latest l ON l.entity = node)",
    ]
    for layer in (1, 2):
        means = ", ".join(f"avg({c}) AS m_{c}" for c in names)
        units = []
        for u in range(graph.HIDDEN):
            terms = [f"{graph.weight(layer, u, i)!r} * p.{c}" for i, c in enumerate(names)]
            terms += [f"{graph.weight(layer, u, 100 + i)!r} * coalesce(m_{c}, 0.0)" for i, c in enumerate(names)]
            units.append(f"greatest(0.0, {graph.weight(layer, u, 999)!r} + {' + '.join(terms)}) AS h{u}")
        parts.append(
            f"near{layer} AS (SELECT e.dst AS node, {means} FROM {edge_table} e JOIN layer{layer - 1} p ON p.node = e.src GROUP BY e.dst)"
        )
        parts.append(
            f"layer{layer} AS (SELECT p.node, {', '.join(units)} FROM layer{layer - 1} p LEFT JOIN near{layer} USING (node))"
        )
        names = [f"h{u}" for u in range(graph.HIDDEN)]
    head = " + ".join(f"{graph.weight(3, 0, i)!r} * {c}" for i, c in enumerate(names))
    parts.append(f"scores AS (SELECT node AS entity_id, {graph.weight(3, 0, 999)!r} + {head} AS score FROM layer2)")
    return ",\n".join(parts)
