"""Avro object container files: a codec, and table metadata read through Spark.

Manifest lists and manifests are small files; Spark reads them as binary, so any store that it reaches
will do, and decodes them in Arrow batches on the executors.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"Obj\x01"


def _field(name: str, kind: Any, number: int) -> dict:
    field = {"name": name, "type": kind, "field-id": number}
    return field | {"default": None} if isinstance(kind, list) else field


#: Fields and field ids of a manifest list and of a manifest.
LIST_SCHEMA = {
    "type": "record",
    "name": "manifest_file",
    "fields": [
        _field("manifest_path", "string", 500), _field("manifest_length", "long", 501), _field("partition_spec_id", "int", 502), _field("content", "int", 517),
        _field("sequence_number", "long", 515), _field("min_sequence_number", "long", 516), _field("added_snapshot_id", "long", 503),
        _field("added_files_count", "int", 504), _field("existing_files_count", "int", 505), _field("deleted_files_count", "int", 506),
        _field("added_rows_count", "long", 512), _field("existing_rows_count", "long", 513), _field("deleted_rows_count", "long", 514),
    ],
}
DATA_FILE = {
    "type": "record",
    "name": "r2",
    "fields": [_field("content", "int", 134), _field("file_path", "string", 100), _field("file_format", "string", 101), _field("record_count", "long", 103), _field("file_size_in_bytes", "long", 104)],
}
ENTRY_SCHEMA = {"type": "record", "name": "manifest_entry", "fields": [_field("status", "int", 0), _field("snapshot_id", ["null", "long"], 1), _field("data_file", DATA_FILE, 2)]}

LIST_ROW = "manifest_path string, manifest_length long, partition_spec_id int, content int, sequence_number long, min_sequence_number long, added_snapshot_id long, added_files_count int, existing_files_count int, deleted_files_count int, added_rows_count long, existing_rows_count long, deleted_rows_count long"
ENTRY_ROW = "status int, snapshot_id long, data_file struct<content:int,file_path:string,file_format:string,record_count:long,file_size_in_bytes:long>"


def _put_long(out: io.BytesIO, n: int) -> None:
    z = (n << 1) ^ (n >> 63)
    while z > 0x7F:
        out.write(bytes((z & 0x7F | 0x80,)))
        z >>= 7
    out.write(bytes((z,)))


def _blank(schema: Any) -> Any:
    """What a required field holds that is unknown here."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict):
        return _blank(kind)
    if isinstance(kind, list):
        return None if "null" in kind else _blank(kind[0])
    if kind == "record":
        return {f["name"]: _blank(f["type"]) for f in schema["fields"]}
    if kind == "fixed":
        return bytes(schema["size"])
    if kind == "enum":
        return schema["symbols"][0]
    return {"string": "", "bytes": b"", "boolean": False, "float": 0.0, "double": 0.0, "array": [], "map": {}, "null": None}.get(kind, 0)


def _put(out: io.BytesIO, schema: Any, value: Any, named: dict[str, Any] | None = None) -> None:
    named = {} if named is None else named
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, dict) and "name" in schema and kind in ("record", "enum", "fixed"):
        named[schema["name"]] = schema
    if isinstance(kind, list):
        n = next(k for k, s in enumerate(kind) if (s == "null") == (value is None))
        _put_long(out, n)
        _put(out, kind[n], value, named)
    elif isinstance(kind, dict):
        _put(out, kind, value, named)
    elif kind == "record":
        for f in schema["fields"]:
            _put(out, f["type"], value[f["name"]] if f["name"] in value else f["default"] if "default" in f else _blank(f["type"]), named)
    elif kind in ("int", "long"):
        _put_long(out, int(value))
    elif kind in ("string", "bytes"):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        _put_long(out, len(raw))
        out.write(raw)
    elif kind == "boolean":
        out.write(b"\x01" if value else b"\x00")
    elif kind in ("float", "double"):
        out.write(struct.pack("<f" if kind == "float" else "<d", value))
    elif kind == "fixed":
        out.write(value)
    elif kind == "enum":
        _put_long(out, schema["symbols"].index(value))
    elif kind in ("array", "map"):
        rows = list(value.items()) if kind == "map" else list(value)
        if rows:
            _put_long(out, len(rows))
        for r in rows:
            if kind == "map":
                _put(out, "string", r[0], named)
            _put(out, schema["values"] if kind == "map" else schema["items"], r[1] if kind == "map" else r, named)
        _put_long(out, 0)
    elif kind in named:
        _put(out, named[kind], value, named)
    elif kind != "null":
        raise ValueError(f"unknown Avro type {kind!r}")


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.named = raw, 0, {}

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the Avro file ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        z = shift = 0
        while True:
            b = self.take(1)[0]
            z |= (b & 0x7F) << shift
            if b < 0x80:
                return (z >> 1) ^ -(z & 1)
            shift += 7

    def value(self, schema: Any) -> Any:
        kind = schema["type"] if isinstance(schema, dict) else schema
        if isinstance(schema, dict) and "name" in schema and kind in ("record", "enum", "fixed"):
            self.named[schema["name"]] = schema
        if isinstance(kind, list):
            return self.value(kind[self.long()])
        if isinstance(kind, dict):
            return self.value(kind)
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        if kind == "null":
            return None
        if kind in ("int", "long"):
            return self.long()
        if kind == "string":
            return self.take(self.long()).decode()
        if kind == "bytes":
            return self.take(self.long())
        if kind == "boolean":
            return self.take(1) == b"\x01"
        if kind == "float":
            return struct.unpack("<f", self.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "fixed":
            return self.take(schema["size"])
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                out += [(self.value("string"), self.value(schema["values"])) if kind == "map" else self.value(schema["items"]) for _ in range(n)]
            return dict(out) if kind == "map" else out
        if kind in self.named:
            return self.value(self.named[kind])
        raise ValueError(f"unknown Avro type {kind!r}")


def encode(schema: dict, rows: list[dict], codec: str = "deflate", meta: dict[str, str | bytes] | None = None, block_rows: int = 4096) -> bytes:
    """rows as one container file; fields that a row lacks get their default, or a blank value."""
    out, sync = io.BytesIO(), os.urandom(16)
    out.write(MAGIC)
    _put(out, {"type": "map", "values": "bytes"}, (meta or {}) | {"avro.schema": json.dumps(schema), "avro.codec": codec})
    out.write(sync)
    for at in range(0, len(rows), block_rows):
        block, named = io.BytesIO(), {}
        for r in rows[at : at + block_rows]:
            _put(block, schema, r, named)
        raw = block.getvalue()
        if codec == "deflate":
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            raw = c.compress(raw) + c.flush()
        elif codec != "null":
            raise ValueError(f"unknown codec {codec!r}")
        _put_long(out, len(rows[at : at + block_rows]))
        _put_long(out, len(raw))
        out.write(raw)
        out.write(sync)
    return out.getvalue()


@dataclass
class Container:
    """An opened file: its writer's schema, what else its header holds, and its rows."""

    schema: dict
    meta: dict[str, bytes]
    rows: Iterator[dict]


def container(raw: bytes) -> Container:
    """A container file by the schema in it; any damage is an error, that of blocks where rows are read."""
    r = _Reader(raw)
    if r.take(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = r.value({"type": "map", "values": "bytes"})
    schema, codec, sync = json.loads(meta.pop("avro.schema")), meta.pop("avro.codec", b"null").decode(), r.take(16)

    def rows() -> Iterator[dict]:
        while r.at < len(raw):
            n, data = r.long(), r.take(r.long())
            if codec == "deflate":
                data = zlib.decompress(data, -15)
            elif codec != "null":
                raise ValueError(f"unknown codec {codec!r}")
            block = _Reader(data)
            for _ in range(n):
                yield block.value(schema)
            if r.take(16) != sync:
                raise ValueError("a block of the Avro file is damaged")

    return Container(schema, meta, rows())


def decode(raw: bytes) -> Iterator[dict]:
    """The rows of a container file."""
    yield from container(raw).rows


def _read(spark: SparkSession, paths: list[str] | DataFrame, row: str) -> DataFrame:
    if isinstance(paths, DataFrame):
        # The manifests of one table, of some megabytes each: a table of ten million files has a few thousand.
        paths = [r[0] for r in paths.toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], f"source string, {row}")
    schema = spark.createDataFrame([], row).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    wanted = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{n: x.get(n) for n in wanted} for x in decode(raw)]
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *columns], ["source", *wanted])

    files = spark.read.format("binaryFile").load(paths).select(F.col("path"), "content")
    return files.mapInArrow(run, f"source string, {row}")


def manifest_lists(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """All entries of manifest lists, delete manifests too, with the list (source) that each is from."""
    return _read(spark, paths, LIST_ROW)


def manifests(spark: SparkSession, paths: list[str] | DataFrame, deleted: bool = False) -> DataFrame:
    """The live entries of manifests (also deleted ones on demand), with the manifest (source) that each is from."""
    rows = _read(spark, paths, ENTRY_ROW)
    return rows if deleted else rows.filter("status <> 2")
