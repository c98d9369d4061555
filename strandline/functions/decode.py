"""Decoding of dynamically typed values into plain, JSON-ready ones.

Columns of native types are decoded by Catalyst expressions (``model.canonical``).
Values already on the driver, or inside a Python stage, go through ``unwrap``.
Opaque binary encodings belong to an external SDK: plug its decoder in by ``native``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from strandline.errors import ScValDepthError

MAX_DEPTH = 50
#: Types whose numbers are kept as decimal text.
WIDE = ("u64", "i64", "u128", "i128", "u256", "i256")


def unwrap(value, max_depth: int = MAX_DEPTH, native: Callable | None = None):
    """A plain value: typed integers as text where wide, bytes as hex, containers in depth.

    A tagged value is a mapping with ``type`` and ``value``. ``native`` may turn foreign objects
    into plain ones first; if it fails, the tag alone decides. Nesting beyond
    ``max_depth`` raises ScValDepthError.
    """
    if native is not None:
        try:
            value = native(value)
        except ScValDepthError:
            raise
        except Exception:  # noqa: BLE001  a foreign decoder may raise anything; the tag still tells
            pass
    return _plain(value, 0, max_depth)


def _plain(value, depth: int, most: int):
    if depth > most:
        raise ScValDepthError(most)
    if value is None or isinstance(value, (bool, str, float)):
        return value
    if isinstance(value, int):
        return value if abs(value) < 2**53 else str(value)
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).hex()
    if isinstance(value, Mapping):
        if set(value) == {"type", "value"} and isinstance(value["type"], str):
            return _tagged(value["type"], value["value"], depth, most)
        return {_key(_plain(k, depth + 1, most)): _plain(v, depth + 1, most) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v, depth + 1, most) for v in value]
    return str(value)


def _key(k) -> str:
    from strandline.functions.checks import text_of

    return text_of(k)


def _tagged(kind: str, value, depth: int, most: int):
    if kind in ("void", "null"):
        return None
    if kind in WIDE:
        return str(int(value))
    if kind in ("u32", "i32"):
        return int(value)
    if kind == "bool":
        return bool(value)
    if kind in ("symbol", "string", "address"):
        return value.decode() if isinstance(value, bytes) else str(value)
    if kind == "bytes":
        return bytes(value).hex() if not isinstance(value, str) else value
    if kind == "vec":
        return [_plain(v, depth + 1, most) for v in value or []]
    if kind == "map":
        pairs = value.items() if isinstance(value, Mapping) else value or []
        return {_key(_plain(k, depth + 1, most)): _plain(v, depth + 1, most) for k, v in pairs}
    return f"[Unresolved ScVal: {kind}]"


def unwrap_or_raw(value, max_depth: int = MAX_DEPTH, native: Callable | None = None):
    """As events are decoded: a value nested too deep stays as it is."""
    try:
        return unwrap(value, max_depth, native)
    except ScValDepthError:
        return value


def json_depth(text: Column | str) -> Column:
    """Nesting depth of a JSON text: the largest count of brackets open at once outside strings."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def step(a, x):
        at = a["at"] + F.when(x.isin("[", "{"), 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(a["top"], at).alias("top"))

    return F.aggregate(steps, zero, step, lambda a: a["top"])


def guard_depth(events: DataFrame, column: str = "value", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Raises, at run time, for rows whose JSON is nested too deep."""
    deep = json_depth(column) > max_depth
    return events.withColumn(column, F.when(deep, F.raise_error(F.lit(f"value is nested deeper than {max_depth} levels"))).otherwise(F.col(column)))


def wide_integer(text: Column | str) -> Column:
    """Decimal text as a number for arithmetic; null where 38 digits do not hold it."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("decimal(38,0)")
