"""CBOR (RFC 8949): values to bytes and back, and columns of them."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class CborError(ValueError):
    pass


class Single(float):
    """A number that is written with 32 bits."""


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for more, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | more]) + n.to_bytes(size, "big")
    raise CborError(f"{n} takes more than 64 bits")


def encode(value) -> bytes:
    """None, bool, int, float, Single, str, bytes, list, tuple and dict, with definite lengths; maps in the order that they have."""
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, Single):
        return b"\xfa" + struct.pack(">f", value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray, memoryview)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        data = value.encode()
        return _head(3, len(data)) + data
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(encode(k) + encode(v) for k, v in value.items())
    raise CborError(f"no CBOR for {type(value).__name__}")


def decode(data: bytes):
    """The one value that data holds; tags are dropped, indefinite lengths and all sizes of numbers are read."""
    value, at = _read(data, 0)
    if value is _BREAK:
        raise CborError("a break by itself")
    if at != len(data):
        raise CborError(f"{len(data) - at} bytes after the value")
    return value


_BREAK = object()


def _read(data: bytes, at: int):
    if at >= len(data):
        raise CborError("cut short")
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if low in (20, 21, 22, 23):
            return {20: False, 21: True, 22: None, 23: None}[low], at
        if low == 31:
            return _BREAK, at
        if low in (25, 26, 27):
            size, code = {25: (2, ">e"), 26: (4, ">f"), 27: (8, ">d")}[low]
            if at + size > len(data):
                raise CborError("cut short")
            return struct.unpack_from(code, data, at)[0], at + size
        raise CborError(f"simple value {low}")
    if low == 31 and major in (2, 3, 4, 5):
        return _until_break(data, at, major)
    if low < 24:
        n = low
    elif low < 28:
        size = 1 << low - 24
        if at + size > len(data):
            raise CborError("cut short")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise CborError(f"length {low}")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(data):
            raise CborError("cut short")
        part = data[at : at + n]
        return (bytes(part) if major == 2 else _text(part)), at + n
    if major == 6:
        return _read(data, at)
    out = []
    for _ in range(n * (2 if major == 5 else 1)):
        value, at = _read(data, at)
        if value is _BREAK:
            raise CborError("a break in a definite length")
        out.append(value)
    return (out if major == 4 else _pairs(out)), at


def _text(data: bytes) -> str:
    try:
        return bytes(data).decode()
    except UnicodeDecodeError as e:
        raise CborError(str(e)) from e


def _pairs(flat: list) -> dict:
    try:
        return dict(zip(flat[::2], flat[1::2]))
    except TypeError as e:
        raise CborError(f"a key that can't be one: {e}") from e


def _until_break(data: bytes, at: int, major: int):
    out = []
    while True:
        value, at = _read(data, at)
        if value is _BREAK:
            break
        out.append(value)
    if major in (2, 3):
        kind = bytes if major == 2 else str
        if not all(isinstance(x, kind) for x in out):
            raise CborError("chunks of another kind")
        return kind().join(out), at
    if major == 5 and len(out) % 2:
        raise CborError("a key without a value")
    return (out if major == 4 else _pairs(out)), at


def encode_rows(df: DataFrame, out: str = "data") -> DataFrame:
    """One column: every row as a map of its columns (numbers, strings, booleans, binary, lists, structs). FLOAT is written with 32 bits."""
    names = df.columns

    def plain(value, kind: pa.DataType):
        if value is None:
            return None
        if pa.types.is_float32(kind):
            return Single(value)
        if pa.types.is_list(kind):
            return [plain(x, kind.value_type) for x in value]
        if pa.types.is_struct(kind):
            return {f.name: plain(value[f.name], f.type) for f in kind}
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [encode({n: plain(r[n], b.schema.field(n).type) for n in names}) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=[out])

    return df.mapInArrow(run, f"{out} binary")


def decode_rows(df: DataFrame, schema: T.StructType | str, column: str = "data") -> DataFrame:
    """What encode_rows() wrote, or any maps: keys that the schema doesn't have are left out, missing ones are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [decode(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_fit(r.get(f.name), f.type) for r in rows], f.type) for f in kinds], schema=kinds)

    return df.select(column).mapInArrow(run, schema)


def _fit(value, kind: pa.DataType):
    """Whole numbers where floating ones are wanted."""
    if isinstance(value, int) and not isinstance(value, bool) and pa.types.is_floating(kind):
        return float(value)
    if isinstance(value, float) and pa.types.is_integer(kind) and math.isfinite(value) and value == int(value):
        return int(value)
    if isinstance(value, list) and pa.types.is_list(kind):
        return [_fit(x, kind.value_type) for x in value]
    return value
