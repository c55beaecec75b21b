"""Operator-editable settings: decay rates per protocol and motif definitions.

Both are small driver-side values (a handful of protocols, a handful of motif
steps). Decay rates become a tiny DataFrame; motif steps become column
expressions, so no table of steps is ever joined to the edges.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ebbgraph.schema import DECAY_CONFIG, EDGE_TYPES, NODE_TYPES, PROTOCOLS

# Decay rate (1/s) per protocol, half-life in hours for display.
SEED_DECAY = {
    "RDP": (0.0001925, 1.0, "interactive remote sessions"),
    "Kerberos": (0.0000192, 10.0, "ticket exchanges"),
    "SMB": (0.0000040, 48.0, "file share access"),
    "DNS": (0.0000010, 192.0, "name resolution"),
}
SEED_DEFAULT_LAMBDA = 0.0000198

# The two seed motifs.
SEED_MOTIFS = {
    "admin_share_escalation": {
        "window_seconds": 3600,
        "steps": [
            {"edge_type": "Authentication", "src_type": "User", "dst_type": "User",
             "key_field": "dst", "key_resolver": "identity"},
            {"edge_type": "FileTransfer", "protocol": "SMB", "src_type": "User",
             "dst_type": "Machine", "key_field": "src", "key_resolver": "identity"},
        ],
    },
    "lateral_pivot": {
        "window_seconds": 14400,
        "steps": [
            {"edge_type": "Authentication", "src_type": "Machine", "dst_type": "Machine",
             "key_field": "dst", "key_resolver": "identity"},
            {"edge_type": ["Authentication", "RemoteCodeExecution"], "src_type": "User",
             "dst_type": "Machine", "key_field": "src", "key_resolver": "host_admin"},
        ],
    },
}

MAX_CONFIG_ROWS = 10_000


@dataclass(frozen=True)
class DecayConfig:
    """lambda_p per protocol; protocols outside the table use the default."""

    rates: Mapping[str, float] = field(
        default_factory=lambda: {name: row[0] for name, row in SEED_DECAY.items()}
    )
    default_lambda: float = SEED_DEFAULT_LAMBDA
    half_life_hours: Mapping[str, float] = field(
        default_factory=lambda: {name: row[1] for name, row in SEED_DECAY.items()}
    )
    descriptions: Mapping[str, str] = field(
        default_factory=lambda: {name: row[2] for name, row in SEED_DECAY.items()}
    )

    def with_lambda(self, protocol: str, lambda_p: float) -> "DecayConfig":
        return replace(self, rates={**self.rates, protocol: float(lambda_p)})

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, float(rate), self.half_life_hours.get(name), self.descriptions.get(name))
            for name, rate in self.rates.items()
        ]
        return spark.createDataFrame(rows, DECAY_CONFIG)

    @classmethod
    def from_dict(cls, data: Mapping) -> "DecayConfig":
        protocols = data.get("protocols") or {}
        return cls(
            rates={name: float(body["lambda_p"]) for name, body in protocols.items()},
            default_lambda=float(data["default_lambda_p"]),
            half_life_hours={
                name: float(body["half_life_hours"])
                for name, body in protocols.items()
                if body.get("half_life_hours") is not None
            },
            descriptions={
                name: body["description"] for name, body in protocols.items() if body.get("description")
            },
        )


@dataclass(frozen=True)
class MotifStep:
    key_field: str
    edge_types: tuple[str, ...] = ()
    protocols: tuple[str, ...] = ()
    src_types: tuple[str, ...] = ()
    dst_types: tuple[str, ...] = ()
    key_resolver: str = "identity"


@dataclass(frozen=True)
class Motif:
    name: str
    window_seconds: float
    steps: tuple[MotifStep, ...]
    description: str | None = None


_STEP_SETS = {
    "edge_type": ("edge_types", EDGE_TYPES),
    "protocol": ("protocols", PROTOCOLS),
    "src_type": ("src_types", NODE_TYPES),
    "dst_type": ("dst_types", NODE_TYPES),
}


def _step(motif: str, body: Mapping) -> MotifStep:
    from ebbgraph.functions.columns import KEY_RESOLVERS

    unknown = set(body) - set(_STEP_SETS) - {"key_field", "key_resolver"}
    if unknown:
        raise ValueError(f"motif {motif}: unknown step fields {sorted(unknown)}")
    if body.get("key_field") not in ("src", "dst"):
        raise ValueError(f"motif {motif}: key_field must be src or dst")
    resolver = body.get("key_resolver", "identity")
    if resolver not in KEY_RESOLVERS:
        raise ValueError(f"motif {motif}: no key resolver named {resolver!r}")
    sets = {}
    for source, (target, allowed) in _STEP_SETS.items():
        given = body.get(source)
        if given is None:
            values = ()
        else:
            values = (given,) if isinstance(given, str) else tuple(given)
            if not values or not set(values) <= set(allowed):
                raise ValueError(f"motif {motif}: {source} must be drawn from {allowed}")
        sets[target] = values
    return MotifStep(key_field=body["key_field"], key_resolver=resolver, **sets)


def load_motifs(definitions: Mapping[str, Mapping] | None = None) -> list[Motif]:
    """Validate motif definitions and turn them into step tuples (seed motifs by default)."""
    motifs = []
    for name, body in (SEED_MOTIFS if definitions is None else definitions).items():
        unknown = set(body) - {"window_seconds", "steps", "description"}
        if unknown:
            raise ValueError(f"motif {name}: unknown fields {sorted(unknown)}")
        window = body.get("window_seconds")
        if isinstance(window, bool) or not isinstance(window, (int, float)) or window <= 0:
            raise ValueError(f"motif {name}: window_seconds must be a positive number")
        if not body.get("steps"):
            raise ValueError(f"motif {name}: at least one step is needed")
        steps = tuple(_step(name, step) for step in body["steps"])
        motifs.append(Motif(name, float(window), steps, body.get("description")))
    if sum(len(m.steps) for m in motifs) > MAX_CONFIG_ROWS:
        raise ValueError(f"motif config holds more than {MAX_CONFIG_ROWS} steps")
    return motifs


def read_yaml(path: str) -> Mapping:
    """Read one YAML settings file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def decay_config_from_yaml(path: str) -> DecayConfig:
    return DecayConfig.from_dict(read_yaml(path))


def motifs_from_yaml(path: str) -> list[Motif]:
    return load_motifs(read_yaml(path).get("motifs") or {})
