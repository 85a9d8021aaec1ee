"""Column roles and schemas of a labelled transaction table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Which column plays which part; every operator takes its column names from here."""

    target: str = "is_fraud"
    timestamp: str = "timestamp"
    id: str = "transaction_id"
    amount: str = "amount"
    kind: str = "transaction_type"
    numerics: tuple[str, ...] = ("amount", "time_since_last_transaction", "spending_deviation_score", "velocity_score", "geo_anomaly_score")
    categoricals: tuple[str, ...] = ("transaction_type", "merchant_category", "location", "device_used", "payment_channel")
    identifiers: tuple[str, ...] = ("transaction_id", "sender_account", "receiver_account", "ip_address", "device_hash")
    suspects: tuple[str, ...] = ("fraud_type",)
    incomplete: str = "time_since_last_transaction"
    gold: tuple[str, ...] = ("transaction_id", "event_timestamp", "transaction_type", "merchant_category", "location", "device_used",
                             "payment_channel", "amount", "time_since_last_transaction", "spending_deviation_score", "velocity_score",
                             "geo_anomaly_score", "is_fraud")


RAW = TableSpec()
GOLD = TableSpec(timestamp="event_timestamp", identifiers=("transaction_id",), suspects=())

_S, _D = T.StringType(), T.DoubleType()
RAW_SCHEMA = T.StructType([
    T.StructField("transaction_id", _S), T.StructField("timestamp", _S), T.StructField("sender_account", _S), T.StructField("receiver_account", _S),
    T.StructField("amount", _D), T.StructField("transaction_type", _S), T.StructField("merchant_category", _S), T.StructField("location", _S),
    T.StructField("device_used", _S), T.StructField("is_fraud", T.BooleanType()), T.StructField("fraud_type", _S),
    T.StructField("time_since_last_transaction", _D), T.StructField("spending_deviation_score", _D), T.StructField("velocity_score", T.ShortType()),
    T.StructField("geo_anomaly_score", _D), T.StructField("payment_channel", _S), T.StructField("ip_address", _S), T.StructField("device_hash", _S),
])
GOLD_SCHEMA = T.StructType([
    T.StructField(c, {"event_timestamp": T.TimestampNTZType(), "velocity_score": T.ShortType(), "is_fraud": T.ByteType()}.get(c) or (_D if c in RAW.numerics else _S))
    for c in RAW.gold
])
