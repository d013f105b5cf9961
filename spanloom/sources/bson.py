"""Rows of frames as binary documents (BSON) and back, in Arrow batches.

A row is {"value": v, "interval": {"start": [..], "end": [..]}}, with a boundary a dimension: "Bottom", "Top", {"point": x}
or {"open": x}; several values are a document. Types stay: doubles, strings, booleans, 32- and 64-bit integers, dates and
timestamps (UTC milliseconds, as the format has no finer ones), arrays of these and nulls.

Cases: an empty frame gives no documents; null values are the format's null; texts may hold any character, names none of
code 0; a document that is cut short is an error.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cuts import Dim
from ..operators.frame import IntervalFrame

# The format's element types.
DOUBLE, STRING, DOCUMENT, ARRAY, BOOLEAN, DATETIME, NULL, INT32, INT64 = 0x01, 0x02, 0x03, 0x04, 0x08, 0x09, 0x0A, 0x10, 0x12
_EPOCH = dt.datetime(1970, 1, 1)


def _element(name: str, v: Any) -> bytes:
    key = name.encode() + b"\0"
    if v is None:
        return bytes([NULL]) + key
    if isinstance(v, bool):
        return bytes([BOOLEAN]) + key + bytes([v])
    if isinstance(v, int):
        return bytes([INT32]) + key + struct.pack("<i", v) if -(1 << 31) <= v < 1 << 31 else bytes([INT64]) + key + struct.pack("<q", v)
    if isinstance(v, float):
        return bytes([DOUBLE]) + key + struct.pack("<d", v)
    if isinstance(v, str):
        raw = v.encode()
        return bytes([STRING]) + key + struct.pack("<i", len(raw) + 1) + raw + b"\0"
    if isinstance(v, dt.date):
        at = v.replace(tzinfo=None) if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return bytes([DATETIME]) + key + struct.pack("<q", (at - _EPOCH) // dt.timedelta(milliseconds=1))
    if isinstance(v, dict):
        return bytes([DOCUMENT]) + key + document(v)
    if isinstance(v, list | tuple):
        return bytes([ARRAY]) + key + document({str(i): x for i, x in enumerate(v)})
    raise TypeError(f"no element for {type(v).__name__}")


def document(fields: dict[str, Any]) -> bytes:
    body = b"".join(_element(k, v) for k, v in fields.items())
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def parsed(data: bytes, at: int = 0) -> dict[str, Any]:
    """The fields of a document; dates come back as datetimes."""
    end = at + struct.unpack_from("<i", data, at)[0]
    if end > len(data) or data[end - 1]:
        raise ValueError("the document is cut short")
    out: dict[str, Any] = {}
    at += 4
    while data[at]:
        kind, stop = data[at], data.index(0, at + 1)
        name, at = data[at + 1 : stop].decode(), stop + 1
        if kind in (DOCUMENT, ARRAY):
            v: Any = parsed(data, at)
            v = list(v.values()) if kind == ARRAY else v
            at += struct.unpack_from("<i", data, at)[0]
        elif kind == STRING:
            n = struct.unpack_from("<i", data, at)[0]
            v, at = data[at + 4 : at + 3 + n].decode(), at + 4 + n
        elif kind == NULL:
            v = None
        elif kind == BOOLEAN:
            v, at = bool(data[at]), at + 1
        elif kind == INT32:
            v, at = struct.unpack_from("<i", data, at)[0], at + 4
        else:
            if kind not in (DOUBLE, INT64, DATETIME):
                raise ValueError(f"no such element: {kind}")
            v, at = struct.unpack_from("<d" if kind == DOUBLE else "<q", data, at)[0], at + 8
            v = _EPOCH + dt.timedelta(milliseconds=v) if kind == DATETIME else v
        out[name] = v
    return out


def _bound(d: Dim, cut: Any, end: bool) -> Any:
    if cut == (d.last if d.discrete else {"v": d.last[0], "side": d.last[1]}):
        return "Top"
    if cut == (d.first if d.discrete else {"v": d.first[0], "side": d.first[1]}):
        return "Bottom"
    if d.discrete:
        return {"point": d.pred(cut) if end else cut}
    return {"open" if cut["side"] == (0 if end else 1) else "point": cut["v"]}


def _cut(d: Dim, bound: Any, end: bool) -> Any:
    if isinstance(bound, str):
        edge = d.last if bound == "Top" else d.first
        return edge if d.discrete else {"v": edge[0], "side": edge[1]}
    (kind, v), = bound.items()
    if d.type == "date":
        v = v.date()
    if d.discrete:
        return d.succ(v) if end else v
    v = float(v) if d.type == "double" else v
    return {"v": v, "side": int(end) if kind == "point" else 1 - int(end)}


def to_bson(frame: IntervalFrame) -> DataFrame:
    """(keys, bson): a document a row."""
    keys, dims, values = list(frame.keys), frame.dims, frame.values
    kinds = "".join(f"`{k}` {frame.df.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                value = {} if not values else {"value": r[values[0]] if len(values) == 1 else {v: r[v] for v in values}}
                made.append(document(value | {"interval": {"start": [_bound(d, r[d.lo], False) for d in dims], "end": [_bound(d, r[d.hi], True) for d in dims]}}))
            yield pa.record_batch([*[batch.column(k) for k in keys], pa.array(made, pa.binary())], [*keys, "bson"])

    return frame.df.mapInArrow(run, f"{kinds}bson binary")


def from_bson(docs: DataFrame, like: IntervalFrame, *, bson_col: str = "bson") -> IntervalFrame:
    """Rows from documents, with the keys, dimensions and types of a frame."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, dims, values = list(like.keys), like.dims, like.values
    schema = like.df.select(*like.columns).schema
    arrow = to_arrow_schema(schema)
    whole = {f.name: f.dataType.simpleString() for f in schema}

    def plain(kind: str, v: Any) -> Any:
        return v.date() if v is not None and kind == "date" else float(v) if v is not None and kind == "double" else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc = parsed(r[bson_col])
                row = {k: r[k] for k in keys}
                for i, d in enumerate(dims):
                    row[d.lo], row[d.hi] = _cut(d, doc["interval"]["start"][i], False), _cut(d, doc["interval"]["end"][i], True)
                for v in values:
                    row[v] = plain(whole[v], doc["value"] if len(values) == 1 else doc["value"][v])
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return like._with(docs.select(*[F.col(f"`{k}`") for k in keys], bson_col).mapInArrow(run, schema))
