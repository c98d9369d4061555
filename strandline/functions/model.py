"""The event envelope: schema, normalisation of raw records, and the ledger axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Ledgers of one storage bucket; filters on ``ledger`` also prune buckets.
BUCKET_SPAN = 10_000

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("ledger", T.LongType()),
    T.StructField("ledgerClosedAt", T.StringType()),
    T.StructField("contractId", T.StringType()),
    T.StructField("transactionIndex", T.LongType()),
    T.StructField("operationIndex", T.LongType()),
    T.StructField("txHash", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("value", T.StringType()),
    T.StructField("inSuccessfulContractCall", T.BooleanType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

LEDGER_SCHEMA = T.StructType([
    T.StructField("sequence", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("previousHash", T.StringType()),
    T.StructField("closeTime", T.StringType()),
    T.StructField("protocolVersion", T.LongType()),
])

#: Each column and the raw names it may have, first match first.
ALIASES = {
    "topics": ("topics", "topic"),
    "txHash": ("txHash", "transactionHash"),
    "transactionIndex": ("transactionIndex", "txIndex"),
    "operationIndex": ("operationIndex", "opIndex"),
    "previousHash": ("previousHash", "prevHash"),
}


def _first(raw: DataFrame, name: str) -> Column:
    found = [F.col(f"`{c}`") for c in ALIASES.get(name, (name,)) if c in raw.columns]
    if not found:
        return F.lit(None)
    return F.coalesce(*found) if len(found) > 1 else found[0]


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value's canonical text: text as is, numbers and truth values as JSON writes
    them, bytes as lower-case hex, everything else as JSON; null stays null."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")


def canonical_topic(value: Column, kind: T.DataType) -> Column:
    """As ``canonical``, with null as the text "null", so topics always compare."""
    return F.coalesce(canonical(value, kind), F.lit("null"))


def decode_events(raw: DataFrame) -> DataFrame:
    """The 11 event columns of raw records; aliases are read, other columns dropped.

    Topics become canonical text and the value JSON or text, both as projections
    that Catalyst pushes column pruning through.
    """
    out = []
    for field in EVENT_SCHEMA:
        c = _first(raw, field.name)
        kind = raw.select(c.alias("x")).schema["x"].dataType
        if field.name == "topics":
            if isinstance(kind, T.ArrayType):
                c = F.transform(c, _topic_of(kind.elementType))
            else:
                c = c.cast("array<string>")
        elif field.name == "value":
            c = canonical(c, kind)
        elif field.name == "contractId":
            c = canonical(c, kind)
        elif field.name == "inSuccessfulContractCall":
            c = F.coalesce(c.cast("boolean"), F.lit(True))
        else:
            c = c.cast(field.dataType)
        out.append(c.alias(field.name))
    return raw.select(*out)


def _topic_of(kind: T.DataType):
    return lambda x: canonical_topic(x, kind)


def decode_ledgers(raw: DataFrame) -> DataFrame:
    """Ledger metadata columns of raw records."""
    return raw.select(*[_first(raw, f.name).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA])


def bucket(ledger: Column | str) -> Column:
    return F.floor(F.col(ledger) / BUCKET_SPAN).cast("long") if isinstance(ledger, str) else F.floor(ledger / BUCKET_SPAN).cast("long")


def is_ledger_metadata(row: Column | str = "sequence", hash_: Column | str = "hash") -> Column:
    """Whether a row has a positive sequence; a hash, if any, is not empty."""
    seq, h = (F.col(c) if isinstance(c, str) else c for c in (row, hash_))
    return F.coalesce((seq >= 1) & (h.isNull() | (h != "")), F.lit(False))
