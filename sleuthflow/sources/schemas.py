"""Explicit schemas of the inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from sleuthflow import catalog

TRANSACTIONS = T.StructType(
    [
        T.StructField("sender_id", T.StringType()),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name == "amount" else T.StringType())
        for name in catalog.EVENT_FIELDS
    ]
    + [
        T.StructField("tx_hash", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

CASE_REQUEST = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("window_hours", T.IntegerType()),
        T.StructField("tabular_features", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("counterparty_type", T.StringType()),
        T.StructField("counterparty_name", T.StringType()),
        T.StructField("counterparty_bank", T.StringType()),
    ]
)


def doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType()) for name in names]


POPULATION = T.StructType(
    doubles(catalog.FEATURES)
    + [T.StructField("label", T.IntegerType()), T.StructField("is_borderline", T.BooleanType())]
)
