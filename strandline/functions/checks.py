"""Argument checks shared by the options of all operators."""

from __future__ import annotations

from collections.abc import Iterable

#: Largest integer that all clients of the reference protocol can hold exactly.
SAFE_INTEGER = 2**53 - 1


def whole(name: str, value, least: int | None = None, optional: bool = True) -> int | None:
    """``value`` as a safe integer of at least ``least``; None passes if optional."""
    if value is None and optional:
        return None
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if abs(value) > SAFE_INTEGER or (least is not None and value < least):
        raise ValueError(f"{name} must be a safe integer" + (f" of at least {least}" if least is not None else ""))
    return value


def span(start, end, least: int = 1) -> tuple[int | None, int | None]:
    """A checked inclusive ledger range; either side may be open."""
    start, end = whole("start_ledger", start, least), whole("end_ledger", end, least)
    if start is not None and end is not None and start > end:
        raise ValueError("start_ledger must not exceed end_ledger")
    return start, end


def names(name: str, value) -> list[str] | None:
    """A scalar or list as texts; None means not given."""
    if value is None:
        return None
    items = list(value) if isinstance(value, Iterable) and not isinstance(value, (str, bytes)) else [value]
    return [text_of(x) for x in items]


def text_of(x) -> str:
    """The canonical text of a driver-side value, as columns are canonicalised."""
    if isinstance(x, str):
        return x
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple, dict)):
        import json

        return json.dumps(x, separators=(",", ":"), ensure_ascii=False, default=text_of)
    return str(x)
