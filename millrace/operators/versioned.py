"""Tables with snapshots on plain Parquet: DML by rewrite, schema evolution, time travel, maintenance.

A table is a folder: ``data/`` holds immutable Parquet folders, one per write;
``log/N.json`` lists, for snapshot N, the folders that make up the table, its
schema, layout, references' targets and statistics.  A commit creates
``log/N.json`` and fails if another writer was first.

UPDATE, DELETE and MERGE rewrite only the data folders that hold a matching row;
the others are carried over by name.  Each folder keeps the schema it was written
with, and by which name the table knows its columns now, so that adding,
dropping, renaming or widening columns rewrites nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.sources.files import empty
from millrace.sources.work import Files, shared

HOUR = 3_600_000
#: Partition transforms: year(c), month(c), day(c), hour(c), bucket(n, c), truncate(n, c), identity(c).
TRANSFORM = re.compile(r"(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?(\w+)\s*\)")


#: Type changes that lose nothing.
WIDER = {("int", "bigint"), ("float", "double"), ("tinyint", "int"), ("smallint", "int"), ("tinyint", "bigint"), ("smallint", "bigint"), ("int", "double"), ("date", "timestamp")}


def _wider_decimal(old, new) -> bool:
    return old.typeName() == new.typeName() == "decimal" and new.scale == old.scale and new.precision >= old.precision


class Conflict(Exception):
    """Another commit took the snapshot's number."""


def transformed(spec: str, schema: StructType) -> tuple[str, Column | None]:
    """Partition column and its values for a column name or a transform; None: the column itself."""
    m = TRANSFORM.fullmatch(spec.strip())
    if m is None or m[1].lower() == "identity":
        return (m[3] if m else spec.strip()), None
    kind, n, name = m[1].lower(), m[2], m[3]
    c = F.col(name)
    if kind in ("year", "month", "day", "hour"):
        made = F.date_format(c, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}[kind])
    elif kind == "bucket":
        made = F.pmod(F.hash(c), F.lit(int(n)))
    elif kind == "truncate":
        made = F.substring(c, 1, int(n)) if isinstance(schema[name].dataType, StringType) else c - F.pmod(c, F.lit(int(n)))
    else:
        raise ValueError(f"no partition transform {kind}")
    return f"_by_{kind}_{name}", made


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # -- log ---------------------------------------------------------------------
    def _versions(self) -> list[int]:
        return sorted(int(n.rsplit("/", 1)[-1].split(".")[0]) for n, *_ in self.files.list(f"{self.path}/log") if n.endswith(".json"))

    def _state(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/log/{version}.json"))

    def current(self) -> int:
        return self._versions()[-1]

    def exists(self) -> bool:
        return bool(self._versions())

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._state(self.current())["schema"]))

    def _commit(self, base: int, operation: str, parts: list[dict], schema: str, extra: dict | None = None) -> int:
        before = self._state(base) if base >= 0 else {}
        kept = {k: before[k] for k in ("partition_by", "sort_by") if k in before}
        state = {"version": base + 1, "parent": base, "at_ms": int(time.time() * 1000), "operation": operation, "schema": schema, "parts": parts} | kept | (extra or {})
        try:
            self.files.write(f"{self.path}/log/{base + 1}.json", json.dumps(state))
        except Exception as e:
            raise Conflict(f"snapshot {base + 1} of {self.path} exists") from e
        return base + 1

    def _write(self, df: DataFrame, partition_by: list[str], sort_by: list[str]) -> list[dict]:
        name = f"data/w={uuid.uuid4().hex}"
        schema = df.schema
        df = df.sortWithinPartitions(*sort_by) if sort_by else df
        by = [transformed(p, schema) for p in partition_by]
        df.withColumns({n: c for n, c in by if c is not None}).write.partitionBy(*[n for n, _ in by]).parquet(f"{self.path}/{name}")
        if not any(f.endswith(".parquet") for f, *_ in self.files.walk(f"{self.path}/{name}")):
            return []
        return [{"name": name, "rows": self.spark.read.schema(schema).parquet(f"{self.path}/{name}").count(), "schema": schema.json(), "columns": {c: c for c in schema.names}}]

    # -- creation and reading -------------------------------------------------------
    @classmethod
    def create(cls, df: DataFrame, path: str, partition_by: list[str] = (), sort_by: list[str] = ()) -> VersionedTable:
        """CREATE TABLE AS, with optional partition columns or transforms and local sort."""
        t = cls(df.sparkSession, path)
        parts = t._write(df, list(partition_by), list(sort_by))
        t._commit(-1, "create", parts, df.schema.json(), {"partition_by": list(partition_by), "sort_by": list(sort_by)})
        return t

    def _frame(self, state: dict, parts: list[dict] | None = None, traced: bool = False) -> DataFrame:
        """The rows of the data folders: one scan per schema they were written with.

        ``traced`` adds each row's folder, file and place.
        """
        schema = StructType.fromJson(json.loads(state["schema"]))
        alike: dict[tuple[str, str], list[str]] = {}
        for p in state["parts"] if parts is None else parts:
            alike.setdefault((p["schema"], json.dumps(p["columns"], sort_keys=True)), []).append(p["name"])
        out = None
        for (stored, columns), names in alike.items():
            known = json.loads(columns)
            rows = self.spark.read.schema(StructType.fromJson(json.loads(stored))).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{n}" for n in names])
            chosen = [(F.col(f"`{known[f.name]}`") if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
            place = [F.concat(F.lit("data/w="), F.col("w")).alias("_folder"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")] if traced else []
            one = rows.select(*chosen, *place)
            out = one if out is None else out.unionByName(one)
        if out is not None:
            return out
        return empty(self.spark, StructType([*schema, *[StructField(n, StringType()) for n in ("_folder", "_file", "_row")]]) if traced else schema)

    def version_at(self, at_ms: int) -> int:
        found = [v for v in self._versions() if self._state(v)["at_ms"] <= at_ms]
        if not found:
            raise ValueError(f"{self.path} has no snapshot at {at_ms}")
        return found[-1]

    def read(self, version: int | None = None, at_ms: int | None = None) -> DataFrame:
        """The table now, as of a snapshot, or as of a time."""
        if at_ms is not None:
            version = self.version_at(at_ms)
        return self._frame(self._state(self.current() if version is None else version))

    def _options(self) -> tuple[list[str], list[str]]:
        now = self._state(self.current())
        return now.get("partition_by", []), now.get("sort_by", [])

    # -- writing ----------------------------------------------------------------------
    def insert(self, df: DataFrame) -> int:
        """Append; columns by name, those that ``df`` lacks are null."""
        base = self.current()
        state = self._state(base)
        columns = StructType.fromJson(json.loads(state["schema"]))
        given = {c.lower(): c for c in df.columns}
        cast = df.select(*[(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])
        return self._commit(base, "insert", state["parts"] + self._write(cast, *self._options()), state["schema"])

    def truncate(self) -> int:
        base = self.current()
        return self._commit(base, "truncate", [], self._state(base)["schema"])

    def _split(self, state: dict, folders: DataFrame) -> tuple[list[dict], list[dict]]:
        """Data folders named by the column ``_folder``, and the others."""
        hit = {r[0] for r in folders.select("_folder").distinct().collect()}  # at most the table's folders
        return [p for p in state["parts"] if p["name"] in hit], [p for p in state["parts"] if p["name"] not in hit]

    def _touched(self, state: dict, condition: Column) -> tuple[list[dict], list[dict]]:
        return self._split(state, self._frame(state, traced=True).where(condition))

    def delete(self, condition: Column) -> int:
        base = self.current()
        state = self._state(base)
        hit, rest = self._touched(state, condition)
        kept = self._frame(state, hit).where(~F.coalesce(condition, F.lit(False)))
        return self._commit(base, "delete", rest + (self._write(kept, *self._options()) if hit else []), state["schema"])

    def update(self, condition: Column, assign: dict[str, Column]) -> int:
        base = self.current()
        state = self._state(base)
        hit, rest = self._touched(state, condition)
        old = self._frame(state, hit)
        new = old.select(*[F.when(condition, assign[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in assign else F.col(f.name) for f in old.schema])
        return self._commit(base, "update", rest + (self._write(new, *self._options()) if hit else []), state["schema"])

    def merge(self, source: DataFrame, on: list[str], update: dict[str, str] | None = None, delete_when: str | None = None, insert: bool = True) -> int:
        """MERGE on equal keys: matched rows updated (or deleted), unmatched source rows inserted.

        ``update`` maps target columns to expressions over ``t.`` and ``s.``
        columns.  A target row that meets two source rows is an error.
        """
        clauses = []
        if delete_when:
            clauses.append(("matched", delete_when, "delete", None))
        if update:
            clauses.append(("matched", None, "update", update))
        if insert:
            clauses.append(("not matched", None, "insert", {c: f"s.`{c}`" for c in source.columns}))
        return self.merge_into(source, " AND ".join(f"t.`{k}` = s.`{k}`" for k in on), clauses)

    def merge_into(self, source: DataFrame, condition: str, clauses: list[tuple[str, str | None, str, dict[str, str] | None]], target: str = "t", alias: str = "s") -> int:
        """MERGE INTO: clauses (matched | not matched, condition, update | delete | insert, assignments) in order; the first that holds acts.

        Only folders with a matched row are rewritten.  A target row that meets two
        source rows is an error; source rows that meet none may repeat.
        """
        base = self.current()
        state = self._state(base)
        schema = StructType.fromJson(json.loads(state["schema"]))
        s, matching = source.withColumn("_met", F.lit(True)).alias(alias), [c for c in clauses if c[0] == "matched"]
        parts = state["parts"]
        if matching:
            met = self._frame(state, traced=True).alias(target).join(s, F.expr(condition)).select("_folder", "_file", "_row")
            counted = met.groupBy("_folder", "_file", "_row").count()
            if counted.where("count > 1").limit(1).count():
                raise ValueError("a target row would match more than one source row")
            hit, parts = self._split(state, counted)
            if hit:
                joined = self._frame(state, hit).alias(target).join(s, F.expr(condition), "left")
                does = F.lit(len(matching))
                for i, (_, when, *_) in reversed(list(enumerate(matching))):
                    does = F.when(F.col("_met") & (F.expr(when) if when else F.lit(True)), i).otherwise(does)
                joined = joined.withColumn("_does", does)
                gone = [i for i, c in enumerate(matching) if c[2] == "delete"]
                joined = joined.where(~F.col("_does").isin(*gone)) if gone else joined
                columns = []
                for f in schema:
                    value = F.col(f"{target}.`{f.name}`")
                    for i, (_, _, what, assign) in enumerate(matching):
                        if what == "update" and f.name in assign:
                            value = F.when(F.col("_does") == i, F.expr(assign[f.name]).cast(f.dataType)).otherwise(value)
                    columns.append(value.cast(f.dataType).alias(f.name))
                parts = parts + self._write(joined.select(*columns), *self._options())
        for _, when, _, assign in [c for c in clauses if c[0] == "not matched"][:1]:
            new = s.join(self._frame(state).alias(target), F.expr(condition), "left_anti")
            new = new.where(F.expr(when)) if when else new
            made = new.select(*[(F.expr(assign[f.name]) if f.name in assign else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
            parts = parts + self._write(made, *self._options())
        return self._commit(base, "merge", parts, state["schema"])

    # -- schema and layout ----------------------------------------------------------------
    def _altered(self, operation: str, fields: list[StructField], columns=lambda known: known, **layout) -> int:
        base = self.current()
        state = self._state(base)
        return self._commit(base, operation, [p | {"columns": columns(dict(p["columns"]))} for p in state["parts"]], StructType(fields).json(), layout)

    def _field(self, name: str) -> StructField:
        found = [f for f in self.schema() if f.name.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name}")
        return found[0]

    def add_columns(self, ddl: str) -> int:
        """New columns, null in all rows there are."""
        new, own = list(StructType.fromDDL(ddl)), list(self.schema())
        if {f.name.lower() for f in new} & {f.name.lower() for f in own}:
            raise ValueError("the column exists")
        return self._altered("add columns", own + new)

    def drop_column(self, name: str) -> int:
        gone = self._field(name).name
        if any(gone == transformed(p, self.schema())[0] or f"({gone})" in p or f" {gone})" in p for p in self._options()[0]):
            raise ValueError("the table is partitioned by the column")
        return self._altered("drop column", [f for f in self.schema() if f.name != gone], lambda known: {k: v for k, v in known.items() if k != gone})

    def change_column(self, name: str, new: str, kind: str | None = None) -> int:
        """Rename a column, or widen its type."""
        old = self._field(name)
        field = StructField(new, StructType.fromDDL(f"c {kind}")[0].dataType if kind else old.dataType)
        if new != old.name and any(f.name.lower() == new.lower() for f in self.schema()):
            raise ValueError("the column exists")
        if kind and (old.dataType.simpleString(), field.dataType.simpleString()) not in WIDER and old.dataType != field.dataType and not _wider_decimal(old.dataType, field.dataType):
            raise ValueError(f"{old.dataType.simpleString()} cannot become {field.dataType.simpleString()}")
        renamed = [[new if c == old.name else c for c in by] for by in self._options()]
        return self._altered("change column", [field if f.name == old.name else f for f in self.schema()], lambda known: {(new if k == old.name else k): v for k, v in known.items()}, partition_by=renamed[0], sort_by=renamed[1])

    def layout(self, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> int:
        """Partition columns or transforms, and local sort, of the writes to come."""
        own = self._options()
        return self._altered("layout", list(self.schema()), partition_by=own[0] if partition_by is None else partition_by, sort_by=own[1] if sort_by is None else sort_by)

    # -- statistics ---------------------------------------------------------------------------
    def analyze(self, columns: list[str] | None = None) -> int:
        """ANALYZE: rows, and per column distinct values (sketch), nulls, least and greatest, kept with the snapshot."""
        base = self.current()
        state, df = self._state(base), self.read()
        names = columns or df.columns
        simple = [n for n in names if not isinstance(df.schema[n].dataType, StructType) and df.schema[n].dataType.typeName() not in ("array", "map")]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, n in enumerate(simple):
            aggs += [F.approx_count_distinct(n, 0.02).alias(f"d{i}"), F.count_if(F.col(n).isNull()).alias(f"n{i}"), F.min(n).cast("string").alias(f"l{i}"), F.max(n).cast("string").alias(f"h{i}")]
        got = df.agg(*aggs).first()
        kept = {"rows": got["rows"], "columns": {n: {"distinct": got[f"d{i}"], "nulls": got[f"n{i}"], "low": got[f"l{i}"], "high": got[f"h{i}"]} for i, n in enumerate(simple)}}
        return self._commit(base, "analyze", state["parts"], state["schema"], {"statistics": kept})

    def forget_statistics(self) -> int:
        base = self.current()
        state = self._state(base)
        return self._commit(base, "delete statistics", state["parts"], state["schema"], {"statistics": {}})

    def statistics(self) -> DataFrame:
        """(column_name, rows, distinct_values, nulls, low, high) of the last ANALYZE."""
        known = next((s["statistics"] for v in reversed(self._versions()) if "statistics" in (s := self._state(v))), {})
        rows = [(n, known["rows"], c["distinct"], c["nulls"], c["low"], c["high"]) for n, c in known.get("columns", {}).items()]
        return self.spark.createDataFrame(rows, "column_name string, rows long, distinct_values long, nulls long, low string, high string")

    def copy_into(self, path: str, format: str = "csv", on_error: str = "abort", trim: bool = False, empty_as_null: bool = False, null_if: list[str] = (), date_format: str | None = None, timestamp_format: str | None = None, delimiter: str = ",", header: bool = True) -> tuple[int, DataFrame]:
        """COPY INTO: load CSV, JSON or Parquet files.

        ``on_error``: abort, continue (bad rows are left out) or skip_file (files
        with a bad row are left out whole).  Returns the new snapshot and the
        rejected rows (file, record).
        """
        base = self.current()
        state = self._state(base)
        schema = StructType.fromJson(json.loads(state["schema"]))
        none = empty(self.spark, "file string, record string")
        if format == "parquet":
            good = self.spark.read.parquet(path)
            return self._commit(base, "copy", state["parts"] + self._write(good.select(*[F.col(f.name).cast(f.dataType) for f in schema]), *self._options()), state["schema"]), none
        texts = StructType([StructField(f.name, StringType()) for f in schema])
        reader = self.spark.read.schema(texts.add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
        raw = reader.option("header", header).option("sep", delimiter).csv(path) if format == "csv" else reader.json(path)
        raw = raw.withColumn("_file", F.col("_metadata.file_path"))
        made, broken = [], F.col("_bad").isNotNull()
        for f in schema:
            value = F.trim(f.name) if trim else F.col(f.name)
            if empty_as_null:
                value = F.when(value == "", None).otherwise(value)
            for token in null_if:
                value = F.when(value == token, None).otherwise(value)
            kind = f.dataType.simpleString()
            if kind == "date" and date_format:
                typed = F.try_to_timestamp(value, F.lit(date_format)).cast("date")
            elif kind.startswith("timestamp") and timestamp_format:
                typed = F.try_to_timestamp(value, F.lit(timestamp_format)).cast(f.dataType)
            else:
                typed = value.try_cast(f.dataType)
            broken = broken | (value.isNotNull() & typed.isNull())
            made.append(typed.alias(f.name))
        record = F.coalesce("_bad", F.to_json(F.struct(*schema.names)))
        judged = raw.select(*made, F.coalesce(broken, F.lit(False)).alias("_broken"), record.alias("_record"), "_file")
        work = shared(self.spark, "copy-into")
        judged.write.parquet(work)
        judged = self.spark.read.schema(judged.schema).parquet(work)
        errors = judged.where("_broken").select(F.col("_file").alias("file"), F.col("_record").alias("record"))
        if on_error == "abort" and errors.limit(1).count():
            raise ValueError(f"COPY INTO: {errors.first()}")
        good = judged.where("not _broken")
        if on_error == "skip_file":
            good = good.join(errors.select(F.col("file").alias("_file")).distinct(), "_file", "left_anti")
        return self._commit(base, "copy", state["parts"] + self._write(good.select(*schema.names), *self._options()), state["schema"]), errors

    # -- maintenance ---------------------------------------------------------------------
    def optimize(self, files: int | None = None, target_bytes: int = 256 << 20, where: Column | None = None) -> int:
        """Compact data folders whose files are small on average into files of about ``target_bytes``.

        ``files``: compact all folders into so many; ``where``: only folders with such a row.
        """
        base = self.current()
        state = self._state(base)
        parts = self._touched(state, where)[0] if where is not None else state["parts"]
        sizes = {p["name"]: [size for f, size, _ in self.files.walk(f"{self.path}/{p['name']}") if f.endswith(".parquet")] for p in parts}
        small = [p for p in parts if files or (sizes[p["name"]] and sum(sizes[p["name"]]) / len(sizes[p["name"]]) < 0.75 * target_bytes)]
        count = files or max(1, round(sum(sum(sizes[p["name"]]) for p in small) / target_bytes))
        if not small or (not files and sum(len(sizes[p["name"]]) for p in small) <= count):
            return base
        by, sort_by = self._options()
        keys = [*[transformed(p, self.schema())[1] if transformed(p, self.schema())[1] is not None else F.col(p) for p in by], *map(F.col, sort_by)]
        rows = self._frame(state, small)
        dealt = rows.repartitionByRange(count, *keys) if keys else rows.repartition(count)
        rest = [p for p in state["parts"] if p not in small]
        return self._commit(base, "optimize", rest + self._write(dealt, by, sort_by), state["schema"])

    def rollback(self, version: int | None = None, at_ms: int | None = None) -> int:
        base = self.current()
        if at_ms is not None:
            version = self.version_at(at_ms)
        old = self._state(version)
        return self._commit(base, f"rollback to {version}", old["parts"], old["schema"], {k: old[k] for k in ("partition_by", "sort_by") if k in old})

    def vacuum(self, keep: int = 1, older_than_ms: int | None = None, grace_ms: int = 24 * HOUR) -> list[str]:
        """Expire all but the last ``keep`` snapshots (of those taken before ``older_than_ms``) and delete data no snapshot names.

        Data younger than ``grace_ms`` stays: it may belong to a writer that has not committed yet.
        """
        versions = self._versions()
        expired = [v for v in versions[:-keep] if older_than_ms is None or self._state(v)["at_ms"] < older_than_ms]
        for v in expired:
            self.files.delete(f"{self.path}/log/{v}.json")
        live = {p["name"] for v in versions if v not in expired for p in self._state(v)["parts"]}
        before = time.time() * 1000 - grace_ms
        gone = [n for n, _, modified, _ in self.files.list(f"{self.path}/data") if "data/" + n.rsplit("/", 1)[-1] not in live and modified <= before]
        for n in gone:
            self.files.delete(n)
        return gone

    # -- metadata tables -------------------------------------------------------------------
    def history(self) -> DataFrame:
        rows = [(s["version"], s["parent"], s["at_ms"], s["operation"], sum(p["rows"] for p in s["parts"])) for s in map(self._state, self._versions())]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, at_ms long, operation string, rows long")

    snapshots = history

    def manifests(self) -> DataFrame:
        s = self._state(self.current())
        return self.spark.createDataFrame([(s["version"], p["name"], p["rows"]) for p in s["parts"]], "snapshot_id long, path string, rows long")

    def data_files(self) -> DataFrame:
        s = self._state(self.current())
        found = [(f, size) for p in s["parts"] for f, size, _ in self.files.walk(f"{self.path}/{p['name']}") if f.endswith(".parquet")]
        return self.spark.createDataFrame(found, "file_path string, file_size long")

    def partitions(self) -> DataFrame:
        by = [c if c is not None else F.col(n) for n, c in (transformed(p, self.schema()) for p in self._options()[0])]
        return self.read().groupBy(*by).agg(F.count(F.lit(1)).alias("rows")) if by else self.read().agg(F.count(F.lit(1)).alias("rows"))
