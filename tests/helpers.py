"""Small frames and plain-Python references the Spark results are compared with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from ebbgraph.operators.edges import normalize_edges

EDGE_INPUT = "src string, dst string, edge_type string, protocol string, t_e double, w_0 double"


def edges(spark: SparkSession, rows, extra: str = "") -> DataFrame:
    return normalize_edges(spark.createDataFrame(rows, EDGE_INPUT + extra))


def random_edges(spark: SparkSession, n: int = 900, seed: int = 7, hot: float = 0.5) -> DataFrame:
    """Edges over few hosts and accounts; a share ``hot`` of them starts at one host or account."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = float(rng.randrange(0, n * 40)) + rng.choice([0.0, 0.25, 0.5])
        a = 1 if rng.random() < hot else rng.randrange(1, 6)
        b = 1 if rng.random() < hot else rng.randrange(1, 6)
        kind = rng.randrange(4)
        if kind == 0:
            row = (f"Machine:C{b}", f"Machine:C{a}", "Authentication", "Kerberos")
        elif kind == 1:
            row = (f"User:C{a}-admin", f"Machine:C{b}", rng.choice(["Authentication", "RemoteCodeExecution"]), "RDP")
        elif kind == 2:
            row = (f"User:u{b}", f"User:svc{a}", "Authentication", "Kerberos")
        else:
            row = (f"User:svc{a}", f"Machine:C{b}", "FileTransfer", rng.choice(["SMB", "SMB", "RDP"]))
        rows.append((*row, t, round(rng.uniform(0.1, 3.0), 2)))
    return edges(spark, list({(r[0], r[1], r[3], r[4]): r for r in rows}.values()))


def ewma(values, alpha=0.3):
    """(z, mean, std, n) after each value, by the plain recursion."""
    mean = var = 0.0
    out = []
    for n, x in enumerate(values):
        z = (x - mean) / var**0.5 if n >= 2 and var > 0 else None
        if n == 0:
            mean, var = x, 0.0
        else:
            step = x - mean
            mean += alpha * step
            var = (1 - alpha) * (var + alpha * step * step)
        out.append((z, mean, var**0.5, n + 1))
    return out


def walk_chains(cands, min_confidence=0.5, timeout=False, prunes=None):
    """Completions, resets and open chains by walking candidate rows of all keys in time order."""
    slots, completions, resets = {}, [], []
    timeline = [((c.t_e, 0, c.edge_id, c.stage), c) for c in cands]
    timeline += [((t, 1, e, 0), (e, t)) for e, t in (prunes or [])]
    for order, item in sorted(timeline, key=lambda x: x[0]):
        now = order[0]
        if order[1] == 1:
            for key, slot in list(slots.items()):
                alive = not timeout or now < slot["touched"] + slot["window"]
                if alive and item[0] in slot["ids"]:
                    resets.append((*key, item[0], tuple(slot["ids"]), now))
                    del slots[key]
            continue
        key = (item.motif_name, item.chain_key)
        slot = slots.get(key)
        if slot and timeout and now >= slot["touched"] + slot["window"]:
            del slots[key]
            slot = None
        if item.stage == 0:
            if slot is None:
                if item.n_steps == 1:
                    if item.score >= min_confidence:
                        completions.append((*key, (item.edge_id,), now, item.score))
                else:
                    slots[key] = {"stage": 1, "start": now, "touched": now, "ids": [item.edge_id], "conf": item.score,
                                  "window": item.window_seconds, "used": None}
            continue
        if slot is None or slot["stage"] != item.stage or slot["used"] == item.edge_id:
            continue
        if now - slot["start"] > item.window_seconds:
            del slots[key]
            continue
        slot["ids"] = [*slot["ids"], item.edge_id]
        slot["conf"] *= item.score
        slot["stage"], slot["touched"], slot["used"] = item.stage + 1, now, item.edge_id
        if slot["stage"] == item.n_steps:
            del slots[key]
            if slot["conf"] >= min_confidence:
                completions.append((*key, tuple(slot["ids"]), now, slot["conf"]))
    still = [(*key, slot["stage"], tuple(slot["ids"])) for key, slot in slots.items()]
    return sorted(completions), sorted(resets), sorted(still)
