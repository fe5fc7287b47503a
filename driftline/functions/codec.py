"""Wire format of topic messages, ULIDs, and plain float text: Arrow-batched, as no built-in expresses them.

A message is a sequence of tagged fields: 1 id, 2 tenant_id, 3 event_type (texts), 4 payload (bytes),
5 value (double), 6 occurred_at (varint, nanoseconds). Fields with default values are not written;
unknown fields are skipped; truncated input or an unknown wire type is an error, which comes out as a text.
"""

from __future__ import annotations

import os
import struct
import time
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType, StringType

from driftline.functions.scalar import CROCKFORD
from driftline.schemas import struct as struct_type

DECODED = "id string, tenant_id string, event_type string, payload string, value double, occurred_ns long, error string"
_TEXT = {1: "id", 2: "tenant_id", 3: "event_type", 4: "payload"}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_message(id_: str, tenant_id: str, event_type: str, payload: str, value: float, occurred_ns: int) -> bytes:
    out = bytearray()
    for number, text in enumerate((id_, tenant_id, event_type, payload), 1):
        if text:
            raw = text.encode()
            out += bytes([number << 3 | 2]) + _varint(len(raw)) + raw
    if value:
        out += bytes([5 << 3 | 1]) + struct.pack("<d", value)
    if occurred_ns:
        out += bytes([6 << 3]) + _varint(occurred_ns)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("truncated varint")
        n |= (raw[at] & 0x7F) << shift
        at += 1
        if raw[at - 1] < 0x80:
            return n & (1 << 64) - 1, at
        shift += 7


def decode_message(raw: bytes) -> dict:
    got = {"id": "", "tenant_id": "", "event_type": "", "payload": "", "value": 0.0, "occurred_ns": 0}
    at, n = 0, len(raw)
    while at < n:
        tag, at = _read_varint(raw, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            x, at = _read_varint(raw, at)
            if number == 6:
                got["occurred_ns"] = x - (1 << 64) if x >> 63 else x
            continue
        if wire == 2:
            size, at = _read_varint(raw, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
        else:
            raise ValueError(f"wire type {wire}")
        if at + size > n:
            raise ValueError("truncated field")
        body, at = raw[at:at + size], at + size
        if wire == 2 and number in _TEXT:
            got[_TEXT[number]] = body.decode("utf-8", errors="replace")
        elif wire == 1 and number == 5:
            got["value"] = struct.unpack("<d", body)[0]
    return got


@F.pandas_udf(BinaryType())
def encode_events(id_: pd.Series, tenant: pd.Series, kind: pd.Series, payload: pd.Series, value: pd.Series, micros: pd.Series) -> pd.Series:
    return pd.Series([encode_message(a or "", b or "", c or "", d or "", float(v or 0), int(t or 0) * 1000)
                      for a, b, c, d, v, t in zip(id_, tenant, kind, payload, value, micros)])


@F.pandas_udf(struct_type(DECODED))
def decode_events(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        try:
            if r is None:
                raise ValueError("no message")
            rows.append({**decode_message(bytes(r)), "error": None})
        except ValueError as e:
            rows.append({"id": None, "tenant_id": None, "event_type": None, "payload": None, "value": None, "occurred_ns": None, "error": str(e)})
    return pd.DataFrame(rows, columns=["id", "tenant_id", "event_type", "payload", "value", "occurred_ns", "error"]).astype({"occurred_ns": "Int64"})


def plain_float(x: float) -> str:
    """Shortest decimal text that reads back the same, never with an exponent."""
    text = format(Decimal(repr(float(x))), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@F.pandas_udf(StringType())
def float_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else plain_float(v))


def new_ulid(ms: int | None = None) -> str:
    n = (int(time.time() * 1000) if ms is None else ms) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(CROCKFORD[n >> s & 31] for s in range(125, -1, -5))


@F.pandas_udf(StringType())
def ulids(ms: pd.Series) -> pd.Series:
    return ms.map(lambda m: new_ulid(int(m)))
