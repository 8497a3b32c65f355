"""Avro object containers: a decoder and an encoder of the public format, and Avro files as a source.

Used for Avro data files (a file per task) and for the small manifest files of
snapshot formats, which the driver reads.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAGIC = b"Obj\x01"


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("Avro data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (value >> 1) ^ -(value & 1)

    def blocks(self) -> Iterator[int]:
        """Number of items of each block of an array or map."""
        while n := self.long():
            if n < 0:
                self.long()
                n = -n
            yield n

    def value(self, kind, names: dict):
        if isinstance(kind, list):
            return self.value(kind[self.long()], names)
        if isinstance(kind, str):
            if kind in names:
                return self.value(names[kind], names)
            match kind:
                case "null":
                    return None
                case "boolean":
                    return self.take(1) == b"\1"
                case "int" | "long":
                    return self.long()
                case "float":
                    return struct.unpack("<f", self.take(4))[0]
                case "double":
                    return struct.unpack("<d", self.take(8))[0]
                case "bytes":
                    return self.take(self.long())
                case "string":
                    return self.take(self.long()).decode()
            raise ValueError(f"no Avro type {kind}")
        match kind["type"]:
            case "record":
                return {f["name"]: self.value(f["type"], names) for f in kind["fields"]}
            case "enum":
                return kind["symbols"][self.long()]
            case "fixed":
                return self.take(kind["size"])
            case "array":
                return [self.value(kind["items"], names) for n in self.blocks() for _ in range(n)]
            case "map":
                return {self.take(self.long()).decode(): self.value(kind["values"], names) for n in self.blocks() for _ in range(n)}
        return self.value(kind["type"], names)


def _named(kind, names: dict) -> dict:
    """All named types of a schema."""
    if isinstance(kind, list):
        for k in kind:
            _named(k, names)
    elif isinstance(kind, dict):
        if kind["type"] in ("record", "enum", "fixed"):
            names[kind["name"]] = names[f"{kind.get('namespace', '')}.{kind['name']}".lstrip(".")] = kind
        for k in (kind.get("items"), kind.get("values"), *[f["type"] for f in kind.get("fields", [])], kind["type"] if isinstance(kind["type"], (dict, list)) else None):
            if k is not None:
                _named(k, names)
    return names


def _head(r: Reader) -> tuple[dict, str, bytes]:
    if r.take(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = r.value({"type": "map", "values": "bytes"}, {})
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), r.take(16)


def schema_of(data: bytes) -> dict:
    return _head(Reader(data))[0]


def records(data: bytes) -> Iterator[dict]:
    r = Reader(data)
    schema, codec, sync = _head(r)
    names = _named(schema, {})
    while r.at < len(data):
        n, body = r.long(), r.take(r.long())
        if codec == "deflate":
            body = zlib.decompress(body, -15)
        elif codec == "zstandard":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif codec != "null":
            raise ValueError(f"Avro codec {codec} is not supported")
        block = Reader(body)
        for _ in range(n):
            yield block.value(schema, names)
        if r.take(16) != sync:
            raise ValueError("Avro block without its sync mark")


# -- encoder -----------------------------------------------------------------------
def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _branch(kinds: list, v) -> int:
    if v is None:
        return kinds.index("null")
    return next(i for i, k in enumerate(kinds) if k != "null")


def encoded(kind, v, names: dict) -> bytes:
    if isinstance(kind, list):
        i = _branch(kind, v)
        return _long(i) + encoded(kind[i], v, names)
    if isinstance(kind, str):
        if kind in names:
            return encoded(names[kind], v, names)
        match kind:
            case "null":
                return b""
            case "boolean":
                return b"\1" if v else b"\0"
            case "int" | "long":
                return _long(v)
            case "float":
                return struct.pack("<f", v)
            case "double":
                return struct.pack("<d", v)
        raw = v.encode() if kind == "string" else v
        return _long(len(raw)) + raw
    match kind["type"]:
        case "record":
            return b"".join(encoded(f["type"], v[f["name"]], names) for f in kind["fields"])
        case "enum":
            return _long(kind["symbols"].index(v))
        case "fixed":
            return v
        case "array":
            return (_long(len(v)) + b"".join(encoded(kind["items"], x, names) for x in v) if v else b"") + _long(0)
        case "map":
            return (_long(len(v)) + b"".join(encoded("string", k, names) + encoded(kind["values"], x, names) for k, x in v.items()) if v else b"") + _long(0)
    return encoded(kind["type"], v, names)


def container(schema: dict, rows: list[dict], codec: str = "deflate") -> bytes:
    names, sync, out = _named(schema, {}), os.urandom(16), io.BytesIO()
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    out.write(MAGIC + encoded({"type": "map", "values": "bytes"}, meta, {}) + sync)
    body = b"".join(encoded(schema, r, names) for r in rows)
    if codec == "deflate":
        made = zlib.compressobj(wbits=-15)
        body = made.compress(body) + made.flush()
    out.write(_long(len(rows)) + _long(len(body)) + body + sync)
    return out.getvalue()


# -- as a source -----------------------------------------------------------------------
def spark_type(kind, names: dict) -> T.DataType:
    if isinstance(kind, list):
        return spark_type(next((k for k in kind if k != "null"), "null"), names)
    if isinstance(kind, str):
        simple = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
        return simple[kind] if kind in simple else spark_type(names[kind], names)
    match kind["type"]:
        case "record":
            return T.StructType([T.StructField(f["name"], spark_type(f["type"], names)) for f in kind["fields"]])
        case "enum":
            return T.StringType()
        case "fixed":
            return T.BinaryType()
        case "array":
            return T.ArrayType(spark_type(kind["items"], names))
        case "map":
            return T.MapType(T.StringType(), spark_type(kind["values"], names))
    return spark_type(kind["type"], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Avro files below a path, a file per task; the schema is the first file's."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.avro").load(path)
    first = found.select("content").first()
    if first is None:
        raise ValueError(f"no Avro file in {path}")
    schema = schema_of(bytes(first[0]))
    kind = spark_type(schema, _named(schema, {}))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = []
                for r in records(content.as_py()):
                    held.append({n: r.get(n) for n in arrow.names})
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return found.select("content").mapInArrow(run, kind)
