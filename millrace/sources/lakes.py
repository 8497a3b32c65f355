"""Readers of public table formats: Delta logs, and Iceberg metadata with delete files.

The driver reads logs and manifests, as these formats mean it to be; rows are read
by one scan over the live files.  What a file alone does not say (partition values,
sequence numbers) is joined to its rows by its path, and Spark picks the join by
its own size check.
"""

from __future__ import annotations

import base64
import datetime
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import avro, roaring
from millrace.sources.files import empty
from millrace.sources.work import Files


def _bare(path: Column) -> Column:
    """A file's path without scheme and host, as it is written in logs."""
    return F.replace(F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), F.lit("%20"), F.lit(" "))


def _plain(path: str) -> str:
    return re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path)


# -- Delta -------------------------------------------------------------------------
CHECKPOINT = re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet")


def _checkpoint(names: list[str], last: int) -> tuple[int, list[str]]:
    """The newest complete checkpoint up to ``last``: its version and all of its parts."""
    found: dict[tuple[int, int], list[str]] = {}
    for n in names:
        m = CHECKPOINT.fullmatch(n.rsplit("/", 1)[-1])
        if m and int(m[1]) <= last:
            found.setdefault((int(m[1]), int(m[3] or 1)), []).append(n)
    whole = [(version, parts) for (version, count), parts in found.items() if len(parts) == count]
    return max(whole, default=(-1, []))


def _erased(spark: SparkSession, root: str, vectors: list[tuple[str, dict]]) -> DataFrame:
    """Rows (_path, _row) that deletion vectors take out; each file of vectors is read and decoded once, on the executors."""
    inline, filed = [], {}
    for path, v in vectors:
        kind, at = v["storageType"], v["pathOrInlineDv"]
        if kind == "i":
            inline.append((bytearray(base64.z85decode(at)[: v["sizeInBytes"]]), [(path, -1, v["sizeInBytes"])]))
            continue
        if kind == "u":  # an optional folder, then the file's UUID in 20 characters
            at = "/".join([root, *filter(None, [at[:-20]]), f"deletion_vector_{uuid.UUID(bytes=base64.z85decode(at[-20:]))}.bin"])
        filed.setdefault(at, []).append((path, v.get("offset") or 0, v["sizeInBytes"]))
    parts = "parts array<struct<path: string, at: long, size: long>>"
    frames = []
    if inline:
        frames.append(spark.createDataFrame(inline, f"content binary, {parts}"))
    if filed:
        listed = spark.createDataFrame([(_plain(at), of) for at, of in filed.items()], f"_from string, {parts}")
        read = spark.read.format("binaryFile").load(list(filed)).select(_bare(F.col("path")).alias("_from"), "content")
        frames.append(read.join(listed, "_from").select("content", "parts"))
    packed = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, of in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                for p in of.as_py():
                    rows = roaring.numbers(data if p["at"] < 0 else roaring.stored(data, p["at"], p["size"]))
                    yield pa.RecordBatch.from_arrays([pa.array([p["path"]], pa.string()).take(pa.array([0] * len(rows), pa.int32())), pa.array(rows, pa.int64())], ["_path", "_row"])

    return packed.mapInArrow(run, "_path string, _row long")


def delta(spark: SparkSession, path: str, version: int | None = None, at_ms: int | None = None) -> DataFrame:
    """A Delta Lake table: the newest complete checkpoint, then the log; partition values, name mapping, deletion vectors, time travel.

    A file is one entry of the log together with its deletion vector: a commit may take it out
    with the old vector and add it with a new one, in either order.  Only files that have a vector
    are joined with it.
    """
    files, root = Files(spark), path.rstrip("/")
    names = sorted(n for n, *_ in files.list(f"{root}/_delta_log"))
    logs = {int(m[1]): n for n in names if (m := re.fullmatch(r"(\d{20})\.json", n.rsplit("/", 1)[-1]))}
    if at_ms is not None:
        times = {v: next((a["commitInfo"]["timestamp"] for a in map(json.loads, files.read(n).splitlines()) if "timestamp" in a.get("commitInfo", {})), 0) for v, n in logs.items()}
        version = max(v for v, t in times.items() if t <= at_ms)
    last = version if version is not None else max([*logs, _checkpoint(names, 2**62)[0]])
    start, parts = _checkpoint(names, last)
    live: dict[tuple, tuple[dict, dict | None]] = {}
    meta = None

    def known_as(one: dict) -> tuple:
        erased = one.get("deletionVector") or {}
        return unquote(one["path"]), erased.get("storageType"), erased.get("pathOrInlineDv"), erased.get("offset")

    def add(one: dict) -> None:
        live[known_as(one)] = one.get("partitionValues") or {}, one.get("deletionVector")

    if parts:
        point = spark.read.parquet(*parts)
        fields = point.schema["add"].dataType.names
        columns = ["path", "partitionValues", *(["deletionVector"] if "deletionVector" in fields else [])]
        for r in point.where("add is not null").select(*[f"add.{c}" for c in columns]).toLocalIterator():
            add(r.asDict(recursive=True))
        got = point.where("metaData is not null").select(F.to_json("metaData").alias("m")).first()
        meta = json.loads(got[0])
    if missing := [v for v in range(start + 1, last + 1) if v not in logs]:
        raise ValueError(f"the log lacks version {missing[0]}: cleaned up, or kept in a kind of checkpoint that is not read")
    for v in range(start + 1, last + 1):
        for action in map(json.loads, files.read(logs[v]).splitlines()):
            if "add" in action:
                add(action["add"])
            elif "remove" in action:
                live.pop(known_as(action["remove"]), None)
            elif "metaData" in action:
                meta = action["metaData"]
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    by = list(meta.get("partitionColumns") or [])
    if not live:
        return empty(spark, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    physical = {f.name: (f.metadata or {}).get("delta.columnMapping.physicalName", f.name) for f in schema}
    stored = T.StructType([T.StructField(physical[f.name], f.dataType) for f in schema if f.name not in by])
    where = {p: p if re.match("[a-zA-Z][a-zA-Z0-9+.-]*:|/", p) else f"{root}/{p}" for p, *_ in live}
    erased = [(_plain(where[p]), vector) for (p, *_), (_, vector) in live.items() if vector]
    marked = {p for p, _ in erased}

    def scan(paths: list[str]) -> DataFrame:
        return spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*paths)

    kinds = []
    if whole := [at for at in where.values() if _plain(at) not in marked]:
        kinds.append(scan(whole).withColumn("_path", _bare(F.col("_metadata.file_path"))))
    if marked:
        rows = scan([at for at in where.values() if _plain(at) in marked])
        rows = rows.withColumns({"_path": _bare(F.col("_metadata.file_path")), "_row": F.col("_metadata.row_index")})
        kinds.append(rows.join(_erased(spark, root, erased), ["_path", "_row"], "left_anti").drop("_row"))
    rows = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    if by:
        values = [(_plain(where[p]), *[v.get(physical[c], v.get(c)) for c in by]) for (p, *_), (v, _) in live.items()]
        rows = rows.join(spark.createDataFrame(values, ", ".join(["_path string", *[f"`_by_{c}` string" for c in by]])), "_path")
    return rows.select(*[(F.col(f"`_by_{f.name}`").cast(f.dataType) if f.name in by else F.col(f"`{physical[f.name]}`")).alias(f.name) for f in schema])


# -- Iceberg -------------------------------------------------------------------------
SIMPLE = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "string": "string", "uuid": "binary", "binary": "binary"}


def _iceberg_type(kind) -> T.DataType:
    if isinstance(kind, str):
        if kind.startswith("decimal"):
            return T.StructType.fromDDL(f"c {kind.replace(' ', '')}")[0].dataType
        return T.BinaryType() if kind.startswith("fixed") else T.StructType.fromDDL(f"c {SIMPLE[kind]}")[0].dataType
    if kind["type"] == "struct":
        return T.StructType([T.StructField(f["name"], _iceberg_type(f["type"])) for f in kind["fields"]])
    if kind["type"] == "list":
        return T.ArrayType(_iceberg_type(kind["element"]))
    return T.MapType(_iceberg_type(kind["key"]), _iceberg_type(kind["value"]))


class IcebergTable:
    """An Iceberg table by its metadata file; snapshots by id, time, branch or tag."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        found = [n for n, *_ in self.files.list(f"{self.path}/metadata") if n.endswith(".metadata.json")]
        number = lambda n: int(re.search(r"v?(\d+)[^/]*\.metadata\.json$", n.rsplit("/", 1)[-1])[1])
        self.meta = json.loads(self.files.read(max(found, key=number)))

    def snapshots(self) -> DataFrame:
        rows = [(s["snapshot-id"], s.get("parent-snapshot-id"), s["timestamp-ms"], s.get("summary", {}).get("operation")) for s in self.meta.get("snapshots", [])]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, at_ms long, operation string")

    def _snapshot(self, snapshot_id: int | None, at_ms: int | None, ref: str | None) -> dict | None:
        every = {s["snapshot-id"]: s for s in self.meta.get("snapshots", [])}
        if ref is not None:
            return every[self.meta["refs"][ref]["snapshot-id"]]
        if at_ms is not None:
            return max((s for s in every.values() if s["timestamp-ms"] <= at_ms), key=lambda s: s["timestamp-ms"])
        return every.get(snapshot_id if snapshot_id is not None else self.meta.get("current-snapshot-id"))

    def _entries(self, snapshot: dict) -> list[dict]:
        """Live files with their sequence numbers."""
        out = []
        for m in avro.records(self.files.read_bytes(snapshot["manifest-list"])):
            for e in avro.records(self.files.read_bytes(m["manifest_path"])):
                if e["status"] != 2:
                    sequence = e.get("sequence_number")
                    out.append(e["data_file"] | {"sequence": m.get("sequence_number", 0) if sequence is None else sequence})
        return out

    def read(self, snapshot_id: int | None = None, at_ms: int | None = None, ref: str | None = None) -> DataFrame:
        """Rows of the live data files less position and equality deletes."""
        schemas = self.meta.get("schemas") or [self.meta["schema"]]
        snapshot = self._snapshot(snapshot_id, at_ms, ref)
        wanted = (snapshot or {}).get("schema-id", self.meta.get("current-schema-id", 0)) if snapshot_id or at_ms else self.meta.get("current-schema-id", 0)
        own = next((s for s in schemas if s.get("schema-id", 0) == wanted), schemas[-1])
        schema = _iceberg_type(own | {"type": "struct"})
        files = self._entries(snapshot) if snapshot else []
        data = [f for f in files if f.get("content", 0) == 0]
        if any(f["file_format"].upper() != "PARQUET" for f in files):
            raise NotImplementedError("Iceberg data other than Parquet")
        if not data:
            return empty(self.spark, schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f["file_path"] for f in data])
        deletes = [f for f in files if f.get("content", 0)]
        if not deletes:
            return rows
        known = self.spark.createDataFrame([(_plain(f["file_path"]), f["sequence"]) for f in data], "_path string, _sequence long")
        rows = rows.select("*", _bare(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.row_index").alias("_pos")).join(known, "_path")
        for at, d in self._by_kind(deletes).items():
            listed = self.spark.createDataFrame([(_plain(f["file_path"]), f["sequence"]) for f in d], "_from string, _until long")
            read = self.spark.read.option("recursiveFileLookup", "true")
            if not at:  # positions: (file_path, pos), for files no newer than the delete
                gone = read.schema("file_path string, pos long").parquet(*[f["file_path"] for f in d])
                gone = gone.select(_bare(F.col("file_path")).alias("_in"), "pos", _bare(F.col("_metadata.file_path")).alias("_from")).join(listed, "_from")
                rows = rows.join(gone, (F.col("_path") == F.col("_in")) & (F.col("_pos") == F.col("pos")) & (F.col("_sequence") <= F.col("_until")), "left_anti")
                continue
            names = [f["name"] for f in own["fields"] if f["id"] in at]
            gone = read.schema(T.StructType([schema[n] for n in names])).parquet(*[f["file_path"] for f in d])
            gone = gone.select(*[F.col(f"`{n}`").alias(f"_gone_{n}") for n in names], _bare(F.col("_metadata.file_path")).alias("_from")).join(listed, "_from")
            same = F.col("_sequence") < F.col("_until")  # for files older than the delete
            for n in names:
                same = same & F.col(f"`{n}`").eqNullSafe(F.col(f"`_gone_{n}`"))
            rows = rows.join(gone, same, "left_anti")
        return rows.select(*[F.col(f"`{n}`") for n in schema.names])

    @staticmethod
    def _by_kind(deletes: list[dict]) -> dict[tuple[int, ...], list[dict]]:
        """Delete files by the columns they compare; none: positions."""
        out: dict[tuple[int, ...], list[dict]] = {}
        for f in deletes:
            out.setdefault(tuple(sorted(f.get("equality_ids") or [])) if f["content"] == 2 else (), []).append(f)
        return out


# -- writing Iceberg metadata (for tables this engine hands on) ----------------------------
_FILE = {
    "type": "record", "name": "data_file", "fields": [
        {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"},
        {"name": "file_size_in_bytes", "type": "long"}, {"name": "equality_ids", "type": ["null", {"type": "array", "items": "int"}]},
    ],
}
_ENTRY = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": _FILE}]}
_MANIFEST = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "content", "type": "int"}, {"name": "sequence_number", "type": "long"}, {"name": "added_snapshot_id", "type": "long"}]}
NAMES = {"int": "int", "bigint": "long", "string": "string", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "binary"}


def write_iceberg(spark: SparkSession, path: str, schema: T.StructType, snapshots: list[list[tuple[str, int, tuple[int, ...]]]]) -> None:
    """Metadata of an unpartitioned v2 table over files that are there: per snapshot the files it adds (path, content, equality ids)."""
    fs, entries, logged = Files(spark), [], []
    now = int(datetime.datetime.now(datetime.UTC).timestamp() * 1000)
    for k, added in enumerate(snapshots, 1):
        rows = [{"status": 1, "snapshot_id": k, "sequence_number": None, "data_file": {"content": c, "file_path": p, "file_format": "PARQUET", "record_count": 0, "file_size_in_bytes": 0, "equality_ids": list(ids) or None}} for p, c, ids in added]
        body, name = avro.container(_ENTRY, rows), f"{path}/metadata/m{k}.avro"
        fs.write_bytes(name, body)
        entries = [*entries, {"manifest_path": name, "manifest_length": len(body), "content": int(any(c for _, c, _ in added)), "sequence_number": k, "added_snapshot_id": k}]
        fs.write_bytes(f"{path}/metadata/snap-{k}.avro", avro.container(_MANIFEST, entries))
        logged.append({"snapshot-id": k, "parent-snapshot-id": k - 1 or None, "sequence-number": k, "timestamp-ms": now + k, "manifest-list": f"{path}/metadata/snap-{k}.avro", "schema-id": 0, "summary": {"operation": "append"}})
    fields = [{"id": i, "name": f.name, "required": False, "type": NAMES[f.dataType.simpleString()]} for i, f in enumerate(schema, 1)]
    meta = {"format-version": 2, "location": path, "current-schema-id": 0, "schemas": [{"type": "struct", "schema-id": 0, "fields": fields}], "current-snapshot-id": len(logged) or -1, "snapshots": logged, "refs": {"main": {"snapshot-id": len(logged), "type": "branch"}, "first": {"snapshot-id": 1, "type": "tag"}}}
    fs.write(f"{path}/metadata/v1.metadata.json", json.dumps(meta))
