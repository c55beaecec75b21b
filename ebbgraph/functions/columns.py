"""Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbgraph.config import MotifStep
from ebbgraph.schema import NODE_TYPES


def node_type(node_id: Column) -> Column:
    """Text before the first colon when it names a node type, else null."""
    prefix = F.substring_index(node_id, ":", 1)
    return F.when(prefix.isin(*NODE_TYPES), prefix)


def float_text(value: Column) -> Column:
    """The shortest round-trip text of a double, as Python's ``repr`` prints it."""
    raw = value.cast("string")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.abs(F.substring_index(raw, "E", -1).try_cast("int"))
    sign = F.when(F.abs(value) >= 1, "+").otherwise("-")
    scientific = F.concat(
        mantissa, F.lit("e"), sign,
        F.when(exponent < 10, F.concat(F.lit("0"), exponent.cast("string"))).otherwise(exponent.cast("string")),
    )
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(value)
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), scientific)
        .otherwise(plain)
    )


def edge_id(src: Column, dst: Column, protocol: Column, t_e: Column) -> Column:
    """First 32 hex digits of sha256 over the four identifying values."""
    return F.substring(F.sha2(F.concat_ws("|", src, dst, protocol, float_text(t_e)), 256), 1, 32)


def decay_weight(w_0: Column, lambda_p: Column, t_e: Column, t: Column) -> Column:
    """w_0 * exp(-lambda * elapsed); elapsed is never negative."""
    return w_0 * F.exp(-lambda_p * F.greatest(F.lit(0.0), t - t_e))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def priority_score(true_positives: Column, false_positives: Column) -> Column:
    return (true_positives + 1) / (true_positives + false_positives + 2)


def shard_index(key: Column, shards: int) -> Column:
    """Stable shard of a key: leading 64 bits of sha256, modulo the shard count."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(shards)).cast("int")


def epsilon(
    edge_count: Column,
    epsilon_min: float,
    epsilon_max: float,
    low_watermark: float = 70.0,
    high_watermark: float = 90.0,
    max_edges: int | None = None,
    memory_percent: float | None = None,
) -> Column:
    """Prune threshold under the larger of memory pressure and size pressure."""
    if epsilon_max < epsilon_min:
        raise ValueError("epsilon_max must not be below epsilon_min")
    if high_watermark <= low_watermark:
        raise ValueError("high_watermark must be above low_watermark")
    pressures = [F.lit(0.0)]
    if memory_percent is not None:
        share = (memory_percent - low_watermark) / (high_watermark - low_watermark)
        pressures.append(F.lit(float(min(1.0, max(0.0, share)))))
    if max_edges:
        pressures.append(F.least(F.lit(1.0), edge_count / F.lit(float(max_edges))))
    pressure = F.greatest(*pressures) if len(pressures) > 1 else pressures[0]
    return F.lit(float(epsilon_min)) + pressure * F.lit(float(epsilon_max - epsilon_min))


# --- motif steps -----------------------------------------------------------


def identity_key(node_id: Column) -> Column:
    return node_id


def host_admin_key(node_id: Column) -> Column:
    """Machine whose name is the leading letters and digits of an account name."""
    stem = F.regexp_extract(node_id, r"^[^:]*:([\p{L}\p{N}]+)", 1)
    return F.when(stem != "", F.concat(F.lit("Machine:"), stem))


KEY_RESOLVERS: dict[str, Callable[[Column], Column]] = {
    "identity": identity_key,
    "host_admin": host_admin_key,
}


def register_key_resolver(name: str, resolver: Callable[[Column], Column]) -> None:
    """Make a ``Column -> Column`` resolver available to motif definitions."""
    KEY_RESOLVERS[name] = resolver


def chain_key(step: MotifStep) -> Column:
    return KEY_RESOLVERS[step.key_resolver](F.col(step.key_field))


def _within(column: str, allowed: tuple[str, ...]) -> Column:
    """True when no set is given or the value is in it; a null value is never in a set."""
    return F.coalesce(F.col(column).isin(*allowed), F.lit(False)) if allowed else F.lit(True)


def _roles_fit(step: MotifStep) -> Column:
    return _within("src_type", step.src_types) & _within("dst_type", step.dst_types)


def matches_shape(step: MotifStep) -> Column:
    return _roles_fit(step) & _within("edge_type", step.edge_types) & _within("protocol", step.protocols)


def match_score(step: MotifStep) -> Column:
    """Share of the given technique filters an edge meets; null when it cannot match."""
    filters = [
        _within(column, allowed).cast("double")
        for column, allowed in (("edge_type", step.edge_types), ("protocol", step.protocols))
        if allowed
    ]
    if not filters:
        return F.when(_roles_fit(step), F.lit(1.0))
    met = reduce(lambda a, b: a + b, filters)
    return F.when(_roles_fit(step) & (met > 0), met / F.lit(float(len(filters))))


def step_score(step: MotifStep, fuzzy: bool) -> Column:
    return match_score(step) if fuzzy else F.when(matches_shape(step), F.lit(1.0))
