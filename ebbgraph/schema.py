"""Table layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies an edge may use.
NODE_TYPES = ("User", "Machine")
EDGE_TYPES = ("Authentication", "FileTransfer", "RemoteCodeExecution")
PROTOCOLS = ("RDP", "SMB", "Kerberos", "DNS")


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_STRING, _DOUBLE, _LONG = T.StringType(), T.DoubleType(), T.LongType()
_STRINGS = T.ArrayType(_STRING)

EDGE = _table(
    edge_id=_STRING, src=_STRING, dst=_STRING, edge_type=_STRING, protocol=_STRING,
    t_e=_DOUBLE, w_0=_DOUBLE, src_type=_STRING, dst_type=_STRING,
    w=_DOUBLE, w_evaluated_at=_DOUBLE, source_system=_STRING, raw_event_id=_STRING,
)

LABEL = _table(t=_DOUBLE, user=_STRING, source_computer=_STRING, destination_computer=_STRING)

WINDOWS_EVENT = T.StructType(
    [
        T.StructField("Channel", _STRING),
        T.StructField("EventID", T.IntegerType()),
        T.StructField("TimeCreated", _DOUBLE),
        *[
            T.StructField(name, _STRING)
            for name in (
                "Computer", "TargetUserName", "SubjectUserName", "User", "LogonType",
                "AuthenticationPackageName", "DestinationHostname", "DestinationIp",
                "DestinationPort", "ParentImage", "TargetFilename",
            )
        ],
    ]
)

COLD_EDGE = _table(
    edge_id=_STRING, src=_STRING, dst=_STRING, edge_type=_STRING, protocol=_STRING,
    t_e=_DOUBLE, w_0=_DOUBLE, w_at_prune=_DOUBLE, pruned_at=_DOUBLE,
    source_system=_STRING, raw_event_id=_STRING,
)

COMPLETION = _table(
    motif_name=_STRING, chain_key=_STRING, matched_edges=_STRINGS,
    completed_at=_DOUBLE, confidence=_DOUBLE,
)

RESET = _table(
    motif_name=_STRING, chain_key=_STRING, triggering_edge_id=_STRING,
    matched_edges=_STRINGS, reset_at=_DOUBLE,
)

OPEN_CHAIN = _table(
    motif_name=_STRING, chain_key=_STRING, stage=T.IntegerType(), started_at=_DOUBLE,
    last_edge_ts=_DOUBLE, matched_edges=_STRINGS, confidence=_DOUBLE,
)

FEEDBACK = _table(
    motif_name=_STRING, chain_key=_STRING, disposition=_STRING, noted_at=_DOUBLE, analyst=_STRING
)

DECAY_CONFIG = _table(
    protocol=_STRING, lambda_p=_DOUBLE, half_life_hours=_DOUBLE, description=_STRING
)
