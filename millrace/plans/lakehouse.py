"""Sources, sinks, DML, catalogue, materialisation and time windows."""

from __future__ import annotations

import base64
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dialect
from millrace.operators.materialize import Registry, Spec
from millrace.operators.versioned import VersionedTable
from millrace.plans.base import Query, load, sql_query
from millrace.sources import avro, derby, excel, files, lakes, roaring
from millrace.sources.catalog import Catalog
from millrace.sources.work import Files, shared
from millrace.streaming import windows

QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None):
    def add(run):
        QUERIES[name] = Query(run, oracle)
        return run

    return add


# -- scans and sinks -------------------------------------------------------------
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nation(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _round_trip(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = shared(spark, f"nation-{form}"), _nation(spark, sf_dir)
        schema = "n_nationkey int, n_name string, n_regionkey int"
        if form == "json":
            df.write.json(path)
            return files.json_lines(spark, path, schema)
        if form == "csv":
            df.write.option("header", True).csv(path)
            return files.text(spark, path, header=True, schema=schema)
        if form == "orc":
            df.write.orc(path)
            return files.orc(spark, path)
        if form == "arrow":
            table, held = df.toArrow(), pa.BufferOutputStream()  # 25 rows
            with pa.ipc.new_file(held, table.schema) as out:
                out.write_table(table)
            Files(spark).write_bytes(f"{path}/n.arrow", held.getvalue().to_pybytes())
            return files.arrow(spark, path)
        df.write.partitionBy("n_regionkey").parquet(path)
        return files.parquet(spark, path).select("n_nationkey", "n_name", F.col("n_regionkey").cast("int"))

    return Query(run, NATION)


for form in ("parquet_partitioned", "json", "csv", "orc", "arrow"):
    QUERIES[f"scan_{form}"] = _round_trip(form)


@query("scan_text_headerless", "SELECT CAST(n_nationkey AS VARCHAR) AS A, n_name AS B, CAST(n_regionkey AS VARCHAR) AS C FROM nation")
def _headerless(spark, sf_dir):
    path = shared(spark, "headerless")
    _nation(spark, sf_dir).write.option("sep", "|").csv(path)
    return files.text(spark, path, delimiter="|")


@query("scan_text_columns_array", "SELECT [CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)] AS columns FROM nation")
def _columns(spark, sf_dir):
    path = shared(spark, "columns")
    _nation(spark, sf_dir).write.option("sep", "|").csv(path)
    return files.text(spark, path, delimiter="|", array=True)


@query("scan_text_skip_lines", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _skip(spark, sf_dir):
    path = shared(spark, "skip")
    head = spark.createDataFrame([(0, "# made by a test"), (1, "n_nationkey|n_name")], "k int, value string")
    body = _nation(spark, sf_dir).select((F.col("n_nationkey") + 2).alias("k"), F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return files.text(spark, path, delimiter="|", header=True, skip=1)


@query("scan_parquet_nested", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys, count(*) AS n FROM nation GROUP BY n_regionkey")
def _nested(spark, sf_dir):
    path = shared(spark, "nested")
    n = _nation(spark, sf_dir)
    n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"), F.struct(F.count(F.lit(1)).alias("n")).alias("s")).write.parquet(path)
    return files.parquet(spark, path).select("n_regionkey", "keys", F.col("s.n").alias("n"))


@query("scan_schema_merge", "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name END AS n_name FROM nation")
def _merge_schema(spark, sf_dir):
    path, n = shared(spark, "merge"), _nation(spark, sf_dir)
    n.where("n_nationkey < 10").select("n_nationkey").write.parquet(f"{path}/part=1")
    n.where("n_nationkey >= 10").select("n_nationkey", "n_name").write.parquet(f"{path}/part=2")
    return files.parquet(spark, path, merge=True).select("n_nationkey", "n_name")


@query("scan_implicit_columns", "SELECT n_nationkey, 'r' || n_regionkey AS dir0, NULL::VARCHAR AS dir1, true AS named FROM nation")
def _implicit(spark, sf_dir):
    path, n = shared(spark, "implicit"), _nation(spark, sf_dir)
    for k in range(5):
        n.where(F.col("n_regionkey") == k).select("n_nationkey").coalesce(1).write.parquet(f"{path}/r{k}")
    df = files.implicit(spark.read.option("recursiveFileLookup", "true").parquet(path), path)
    return df.select("n_nationkey", "dir0", "dir1", (F.col("file_name").endswith(".parquet") & F.col("file_mtime").isNotNull() & (F.col("row_index") >= 0)).alias("named"))


@query("scan_directory_listing", "SELECT 'r' || n_regionkey AS folder, 1::BIGINT AS files, true AS sized FROM nation GROUP BY n_regionkey")
def _listing(spark, sf_dir):
    path = shared(spark, "listing")
    n = _nation(spark, sf_dir)
    for k in range(5):
        n.where(F.col("n_regionkey") == k).coalesce(1).write.parquet(f"{path}/r{k}")
    found = files.listing(spark, path).where("path LIKE '%.parquet'").groupBy(F.regexp_extract("path", "/(r[0-9])/", 1).alias("folder"))
    return found.agg(F.count(F.lit(1)).alias("files"), (F.min("size") > 0).alias("sized"))


def _saved(spark, df: DataFrame, path: str, name: str) -> str:
    """Write one Parquet file under a chosen name; its path below ``path``."""
    fs, at = Files(spark), f"{path}/{name}"
    df.coalesce(1).write.parquet(at)
    return f"{name}/{next(f.rsplit('/', 1)[-1] for f, *_ in fs.list(at) if f.endswith('.parquet'))}"


def _logged(spark, path: str, version: int, *actions: dict) -> None:
    Files(spark).write(f"{path}/_delta_log/{version:020d}.json", "\n".join(map(json.dumps, actions)))


@query("scan_delta_log", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def _delta(spark, sf_dir):
    path, n = shared(spark, "delta"), _nation(spark, sf_dir).select("n_nationkey", "n_name")
    parts = [_saved(spark, n.where(w), path, f"p {k}") for k, w in enumerate(("n_nationkey < 10", "n_nationkey >= 10 AND n_nationkey < 20", "n_nationkey >= 20"))]
    add = [{"add": {"path": p.replace(" ", "%20")}} for p in parts]
    _logged(spark, path, 0, {"metaData": {"schemaString": n.schema.json()}}, add[0], add[2])
    _logged(spark, path, 1, add[1], {"remove": {"path": add[2]["add"]["path"]}})
    return lakes.delta(spark, path)


@query("scan_delta_partitioned", "SELECT n_nationkey, n_name, NULLIF(n_regionkey, 3) AS n_regionkey FROM nation")
def _delta_partitioned(spark, sf_dir):
    """Partition values come from the log alone, one of them null; names are mapped."""
    path, n = shared(spark, "delta"), _nation(spark, sf_dir)
    adds = [{"add": {"path": _saved(spark, n.where(F.col("n_regionkey") == k).select("n_nationkey", F.col("n_name").alias("c7")), path, f"f{k}"), "partitionValues": {"n_regionkey": None if k == 3 else str(k)}}} for k in range(5)]
    fields = json.loads(n.schema.json())
    fields["fields"][1]["metadata"] = {"delta.columnMapping.physicalName": "c7"}
    _logged(spark, path, 0, {"metaData": {"schemaString": json.dumps(fields), "partitionColumns": ["n_regionkey"]}}, *adds)
    return lakes.delta(spark, path)


@query("scan_delta_checkpoint", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def _delta_checkpoint(spark, sf_dir):
    """A checkpoint in two parts, an incomplete later one, and a log after it."""
    path, n, fs = shared(spark, "delta"), _nation(spark, sf_dir), Files(spark)
    files = [_saved(spark, n.where(F.col("n_regionkey") == k).select("n_nationkey", "n_name"), path, f"f{k}") for k in range(5)]
    kind = "add struct<path: string, partitionValues: map<string, string>>, metaData struct<schemaString: string, partitionColumns: array<string>>"
    meta = (None, (n.select("n_nationkey", "n_name").schema.json(), []))
    for i, rows in enumerate(([meta, ((files[0], {}), None)], [((files[1], {}), None), ((files[2], {}), None), ((files[3], {}), None)]), 1):
        one = _saved(spark, spark.createDataFrame(rows, kind), path, f"_c{i}")
        fs.write_bytes(f"{path}/_delta_log/{5:020d}.checkpoint.{i:010d}.{2:010d}.parquet", fs.read_bytes(f"{path}/{one}"))
    fs.write_bytes(f"{path}/_delta_log/{6:020d}.checkpoint.{1:010d}.{2:010d}.parquet", b"half of it")
    _logged(spark, path, 6, {"add": {"path": files[4]}}, {"remove": {"path": files[2]}})
    return lakes.delta(spark, path)


@query("scan_delta_deletion_vectors", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0 AND NOT (c_custkey % 3 = 1 AND c_custkey % 5 = 0)")
def _delta_deletion_vectors(spark, sf_dir):
    """One file whole, one with a vector inside the log, one whose vector is replaced by another in a file beside it."""
    path, fs = shared(spark, "delta"), Files(spark)
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name").where("c_custkey IS NOT NULL")
    names = [_saved(spark, c.where(F.col("c_custkey") % 3 == k).where("c_custkey % 7 <> 0" if k == 0 else "true"), path, f"f{k}") for k in range(3)]

    def vector(k: int, condition: str) -> bytes:
        rows = spark.read.parquet(f"{path}/{names[k]}").select("*", "_metadata.row_index").where(condition).select("row_index")
        return roaring.packed([r[0] for r in rows.collect()])  # a fixture's rows

    old, new, inside = vector(1, "c_custkey % 7 = 0"), vector(1, "c_custkey % 7 = 0 OR c_custkey % 5 = 0"), vector(2, "c_custkey % 7 = 0")
    body, at = roaring.filed([old, new])
    name = uuid.uuid4()
    fs.write_bytes(f"{path}/dv/deletion_vector_{name}.bin", body)
    filed = [{"storageType": "u", "pathOrInlineDv": "dv" + base64.z85encode(name.bytes).decode(), "offset": o, "sizeInBytes": len(v)} for o, v in zip(at, (old, new), strict=True)]
    inline = {"storageType": "i", "pathOrInlineDv": base64.z85encode(inside + bytes(-len(inside) % 4)).decode(), "sizeInBytes": len(inside)}
    _logged(spark, path, 0, {"metaData": {"schemaString": c.schema.json()}}, {"add": {"path": names[0]}}, {"add": {"path": names[1], "deletionVector": filed[0]}}, {"add": {"path": names[2]}})
    _logged(
        spark, path, 1, {"add": {"path": names[1], "deletionVector": filed[1]}}, {"remove": {"path": names[1], "deletionVector": filed[0]}},
        {"remove": {"path": names[2]}}, {"add": {"path": names[2], "deletionVector": inline}},
    )
    return lakes.delta(spark, path)


def _iceberg(spark, sf_dir) -> lakes.IcebergTable:
    """Two data files, a position delete of the first, an equality delete, and a file newer than both."""
    path, n = shared(spark, "iceberg"), _nation(spark, sf_dir)
    old = [f"{path}/{_saved(spark, n.where(w).sortWithinPartitions('n_nationkey'), path, f'd{i}')}" for i, w in enumerate(("n_nationkey < 10", "n_nationkey >= 10"))]
    gone = f"{path}/{_saved(spark, spark.createDataFrame([(old[0], 0), (old[0], 3)], 'file_path string, pos long'), path, 'positions')}"
    same = f"{path}/{_saved(spark, spark.createDataFrame([(4,)], 'n_regionkey int'), path, 'equal')}"
    new = f"{path}/{_saved(spark, n.where('n_regionkey = 4').withColumn('n_name', F.lit('again')), path, 'd2')}"
    lakes.write_iceberg(spark, path, n.schema, [[(f, 0, ()) for f in old], [(gone, 1, ())], [(same, 2, (3,))], [(new, 0, ())]])
    return lakes.IcebergTable(spark, path)


@query("scan_iceberg_deletes", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (0, 3) AND n_regionkey <> 4 UNION ALL SELECT n_nationkey, 'again', n_regionkey FROM nation WHERE n_regionkey = 4")
def _iceberg_deletes(spark, sf_dir):
    return _iceberg(spark, sf_dir).read()


@query("scan_iceberg_snapshot", "SELECT count(*) AS first, count(*) - 2 AS second, count(*) AS tagged FROM nation")
def _iceberg_snapshot(spark, sf_dir):
    t = _iceberg(spark, sf_dir)
    count = lambda name, **at: t.read(**at).agg(F.count(F.lit(1)).alias(name))
    return count("first", snapshot_id=1).crossJoin(count("second", snapshot_id=2)).crossJoin(count("tagged", ref="first"))


@query("scan_iceberg_history", "SELECT * FROM (VALUES (1::BIGINT, NULL::BIGINT), (2, 1), (3, 2), (4, 3)) AS t(snapshot_id, parent_id)")
def _iceberg_history(spark, sf_dir):
    return _iceberg(spark, sf_dir).snapshots().select("snapshot_id", "parent_id")


@query("scan_avro", "SELECT n_nationkey::BIGINT AS k, NULLIF(n_name, 'NATION_3') AS name, [n_regionkey::BIGINT, 7] AS pair FROM nation")
def _avro(spark, sf_dir):
    path, fs = shared(spark, "avro"), Files(spark)
    schema = {"type": "record", "name": "r", "fields": [{"name": "k", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "pair", "type": {"type": "array", "items": "long"}}]}
    rows = [{"k": r[0], "name": None if r[1] == "NATION_3" else r[1], "pair": [r[2], 7]} for r in _nation(spark, sf_dir).collect()]  # 25 rows
    fs.write_bytes(f"{path}/a.avro", avro.container(schema, rows[:10]))
    fs.write_bytes(f"{path}/b.avro", avro.container(schema, rows[10:], "null"))
    return avro.read(spark, path)


@query("scan_excel", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN n_regionkey::DOUBLE END AS region, n_regionkey = 1 AS one FROM nation")
def _excel(spark, sf_dir):
    path = shared(spark, "excel")
    rows = [[r[0], r[1], float(r[2]) if r[2] else None, r[2] == 1] for r in _nation(spark, sf_dir).collect()]  # 25 rows
    Files(spark).write_bytes(f"{path}/n.xlsx", excel.workbook([["key", "name", "region", "one"], *rows]))
    return excel.read(spark, path, "n_nationkey int, n_name string, region double, one boolean")


@query("external_query", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < 100 GROUP BY o_orderstatus")
def _external(spark, sf_dir):
    """A statement passed through to another database, which runs it."""
    url = derby.database(load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "ORDERS_THERE", '"o_custkey" BIGINT, "o_orderstatus" VARCHAR(10)')
    return files.query(spark, url, 'SELECT "o_orderstatus", CAST(count(*) AS BIGINT) AS "n" FROM ORDERS_THERE WHERE "o_custkey" < 100 GROUP BY "o_orderstatus"', driver=derby.DRIVER)


@query("scan_jdbc_pushdown", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 20")
def _jdbc(spark, sf_dir):
    """A remote table as a relation: the filter and the columns are sent to it."""
    url = derby.database(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "ORDERS_THERE", '"o_orderkey" BIGINT, "o_custkey" BIGINT, "o_totalprice" DOUBLE')
    return spark.read.jdbc(url, "ORDERS_THERE", properties={"driver": derby.DRIVER}).where("o_custkey < 20").select("o_orderkey", "o_custkey")


@query("scan_json_learned", "SELECT n_nationkey::BIGINT AS k, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_regionkey::VARCHAR END AS mixed, n_regionkey > 2 AS flag, [n_regionkey::BIGINT] AS many FROM nation")
def _json_learned(spark, sf_dir):
    """No schema is given: types are learnt, and a field of numbers and texts becomes text."""
    path = shared(spark, "learned")
    n = _nation(spark, sf_dir)
    mixed = F.when(F.col("n_regionkey") == 1, F.lit('"one"')).otherwise(F.col("n_regionkey").cast("string"))
    line = F.concat(F.lit('{"k": '), "n_nationkey", F.lit(', "name": "'), "n_name", F.lit('", "mixed": '), mixed, F.lit(', "flag": '), (F.col("n_regionkey") > 2).cast("string"), F.lit(', "many": ['), "n_regionkey", F.lit("]}"))
    n.select(line.alias("value")).write.text(path)
    return files.json_lines(spark, path).select("k", "name", "mixed", "flag", "many")


@query("information_schema_views", "SELECT 'v_one' AS TABLE_NAME")
def _views_schema(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.view("v_one", "SELECT * FROM nation")
    return c.information_schema("VIEWS").select("TABLE_NAME")


@query("information_schema_catalogs_schemata", "SELECT 'MILLRACE' AS CATALOG_NAME, 'session' AS SCHEMA_NAME")
def _schemata(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return c.information_schema("CATALOGS").select("CATALOG_NAME").join(c.information_schema("SCHEMATA"), "CATALOG_NAME")


@query("sink_text", "SELECT n_nationkey, NULLIF(n_name, 'NATION_4') AS n_name, n_regionkey FROM nation")
def _sink_text(spark, sf_dir):
    path = shared(spark, "sink")
    files.write_text(_nation(spark, sf_dir).withColumn("n_name", F.expr("nullif(n_name, 'NATION_4')")), path, "|", null="\\N", codec="gzip")
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("sep", "|").option("header", True).option("nullValue", "\\N").csv(path)


@query("sink_json", "SELECT n_nationkey, NULLIF(n_name, 'NATION_4') AS n_name, n_regionkey FROM nation")
def _sink_json(spark, sf_dir):
    path = shared(spark, "sink")
    files.write_json(_nation(spark, sf_dir).withColumn("n_name", F.expr("nullif(n_name, 'NATION_4')")), path, partition_by=("n_regionkey",))
    return files.json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name", "n_regionkey")


@query("sink_parquet_row_groups", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey < 100) AS low, true AS several FROM orders")
def _sink_parquet(spark, sf_dir):
    """Small row groups are really written: one file's footer lists several."""
    path = shared(spark, "sink")
    files.write_parquet(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, row_group_bytes=2048, page_bytes=512, bloom=("o_custkey",), sort_by=("o_orderkey",))
    size, largest = max((size, f) for f, size, *_ in Files(spark).list(path) if f.endswith(".parquet"))
    groups = files.parquet_footer(spark, largest, size).num_row_groups
    return files.parquet(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") < 100).alias("low"), F.lit(groups > 1).alias("several"))


@query("scan_empty_and_rows", "SELECT 1 AS k, 'a' AS v UNION ALL SELECT 2, NULL")
def _rows(spark, sf_dir):
    return files.rows(spark, [(1, "a"), (2, None)], "k int, v string").unionByName(files.empty(spark, "k int, v string"))


# -- tables with snapshots ----------------------------------------------------------
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
LISTED = ", ".join(ORDERS)


def _table(spark, sf_dir, label) -> VersionedTable:
    o = load(spark, sf_dir, "orders").select(*ORDERS)
    t = VersionedTable.create(o.where("o_orderkey % 2 = 0"), shared(spark, label), partition_by=["o_orderstatus"], sort_by=["o_orderkey"])
    t.insert(o.where("o_orderkey % 2 = 1"))
    return t


@query("dml_create_insert", f"SELECT {LISTED} FROM orders")
def _insert(spark, sf_dir):
    return _table(spark, sf_dir, "insert").read()


@query("dml_delete", f"SELECT {LISTED} FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def _delete(spark, sf_dir):
    t = _table(spark, sf_dir, "delete")
    t.delete((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    return t.read()


@query("dml_update", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey < 50 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def _update(spark, sf_dir):
    t = _table(spark, sf_dir, "update")
    t.update(F.col("o_custkey") < 50, {"o_totalprice": F.col("o_totalprice") * 2})
    return t.read()


@query("dml_merge", """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N', 1.5 FROM orders WHERE o_orderkey % 5 = 0""")
def _merge(spark, sf_dir):
    t, o = _table(spark, sf_dir, "merge"), load(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    old = o.select("o_orderkey", "o_custkey", F.lit("M").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"))
    new = o.select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"))
    t.merge(old.unionByName(new), ["o_orderkey"], update={"o_orderstatus": "s.o_orderstatus", "o_totalprice": "s.o_totalprice"}, delete_when="t.o_orderkey % 10 = 0")
    return t.read()


@query("dml_truncate", f"SELECT {LISTED} FROM orders WHERE false")
def _truncate(spark, sf_dir):
    t = _table(spark, sf_dir, "truncate")
    t.truncate()
    return t.read()


@query("dml_copy_into", "SELECT n_nationkey, n_name FROM nation")
def _copy(spark, sf_dir):
    t = VersionedTable.create(files.empty(spark, "n_nationkey int, n_name string"), shared(spark, "copy"))
    path, n = shared(spark, "copy-source"), _nation(spark, sf_dir)
    n.select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("n_nationkey"), "n_name").unionByName(spark.createDataFrame([("x1", "bad")], "n_nationkey string, n_name string")).write.option("header", True).csv(path)
    t.copy_into(path, "csv", on_error="continue", trim=True)
    return t.read()


@query("copy_errors", "SELECT 1::BIGINT AS n")
def _copy_errors(spark, sf_dir):
    t = VersionedTable.create(files.empty(spark, "n_nationkey int, n_name string"), shared(spark, "copy"))
    path = shared(spark, "copy-source")
    spark.createDataFrame([("1", "fine"), ("x1", "bad")], "n_nationkey string, n_name string").write.option("header", True).csv(path)
    return t.copy_into(path, "csv", on_error="skip_file")[1].agg(F.count(F.lit(1)).alias("n"))


@query("time_travel_snapshot", f"SELECT {LISTED} FROM orders WHERE o_orderkey % 2 = 0")
def _travel(spark, sf_dir):
    return _table(spark, sf_dir, "travel").read(version=0)


@query("maintenance_optimize_vacuum", f"SELECT {LISTED} FROM orders")
def _optimize(spark, sf_dir):
    t = _table(spark, sf_dir, "optimize")
    t.optimize(2)
    t.vacuum(keep=1, grace_ms=0)
    return t.read()


@query("maintenance_rollback", f"SELECT {LISTED} FROM orders")
def _rollback(spark, sf_dir):
    t = _table(spark, sf_dir, "rollback")
    t.delete(F.col("o_orderkey") > 0)
    t.rollback(1)
    return t.read()


@query("metadata_history", "SELECT 0::BIGINT AS snapshot_id, 'create' AS operation, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, 'insert', count(*) FROM orders")
def _history(spark, sf_dir):
    return _table(spark, sf_dir, "history").history().select("snapshot_id", "operation", F.col("rows").alias("n"))


@query("metadata_manifests_files", "SELECT 2::BIGINT AS manifests, true AS files")
def _manifests(spark, sf_dir):
    t = _table(spark, sf_dir, "manifests")
    return t.manifests().agg(F.count(F.lit(1)).alias("manifests")).crossJoin(t.data_files().agg((F.min("file_size") > 0).alias("files")))


@query("metadata_partitions", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _partitions(spark, sf_dir):
    return _table(spark, sf_dir, "partitions").partitions().withColumnRenamed("rows", "n")


@query("analyze_table_statistics", "SELECT count(*) AS rows, count(DISTINCT n_regionkey) AS distinct_values, min(n_name) AS low FROM nation")
def _analyze(spark, sf_dir):
    """Statistics are kept with the table and read back after later commits."""
    t = VersionedTable.create(_nation(spark, sf_dir), shared(spark, "analyze"))
    t.analyze()
    t.truncate()
    s = t.statistics()
    return s.where("column_name = 'n_regionkey'").select("rows", "distinct_values").crossJoin(s.where("column_name = 'n_name'").select("low"))


# -- catalogue, functions, policies -----------------------------------------------------
def _catalog(spark, sf_dir) -> Catalog:
    c = Catalog(spark)
    for name in ("nation", "region"):
        c.table(name, load(spark, sf_dir, name))
    return c


@query("view_expansion", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def _view(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.view("v_one", 'SELECT "n_name", n_regionkey FROM nation WHERE n_regionkey = 1')
    return c.sql("SELECT n_name FROM v_one")


@query("sql_function_scalar", "SELECT n_nationkey, n_nationkey * 10 + 1 AS v FROM nation")
def _function(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.function("shifted", "x INT, by INT DEFAULT 1", "INT", "x * 10 + by")
    return c.sql("SELECT n_nationkey, shifted(n_nationkey) AS v FROM nation")


@query("sql_function_tabular", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _tabular(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.function("of_region", "r INT", "TABLE (n_nationkey INT, n_name STRING)", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r")
    return c.sql("SELECT n_nationkey, n_name FROM of_region(2)")


@query("policy_row_and_column", "SELECT n_nationkey, regexp_replace(regexp_replace(n_name, '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS m FROM nation WHERE n_regionkey <> 3")
def _policy(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.protect("nation", row_filter="n_regionkey <> 3", masks={"n_name": "MASK(n_name)"})
    return c.sql("SELECT n_nationkey, n_name AS m FROM nation")


@query("information_schema_columns", "SELECT 'nation' AS TABLE_NAME, 3::BIGINT AS n UNION ALL SELECT 'region', 2")
def _columns_schema(spark, sf_dir):
    return _catalog(spark, sf_dir).information_schema("COLUMNS").groupBy("TABLE_NAME").agg(F.count(F.lit(1)).alias("n"))


@query("information_schema_tables", "SELECT 'nation' AS TABLE_NAME, 'TABLE' AS TABLE_TYPE UNION ALL SELECT 'region', 'TABLE'")
def _tables_schema(spark, sf_dir):
    return _catalog(spark, sf_dir).information_schema("TABLES").select("TABLE_NAME", "TABLE_TYPE")


@query("sys_tables", "SELECT true AS options, true AS version, true AS timezones, true AS functions")
def _sys(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    some = lambda n, k: c.sys(n).agg((F.count(F.lit(1)) >= k).alias(n))
    return some("options", 10).crossJoin(some("version", 1)).crossJoin(some("timezones", 100)).crossJoin(some("functions", 300))


# -- materialisation ------------------------------------------------------------------------
JOINED = (("orders", "l_orderkey", "o_orderkey"),)
STORED = Spec("lineitem", JOINED, ("l_returnflag", "l_linestatus", "o_orderpriority"), (("sum", "l_quantity"), ("count", "*"), ("min", "l_tax"), ("avg", "l_discount")))


def _registry(spark, sf_dir) -> Registry:
    r = Registry(spark, lambda t: load(spark, sf_dir, t))
    r.materialize(STORED, shared(spark, "materialized"))
    return r


@query("materialize_substituted", """
    SELECT l_returnflag, round(sum(l_quantity), 2) AS q, count(*) AS n, min(l_tax) AS t, round(avg(l_discount), 8) AS d
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT' GROUP BY l_returnflag""")
def _substituted(spark, sf_dir):
    r = _registry(spark, sf_dir)
    spec = Spec("lineitem", JOINED, ("l_returnflag",), (("sum", "l_quantity"), ("count", "*"), ("min", "l_tax"), ("avg", "l_discount")), ("o_orderpriority <> '1-URGENT'",), ("o_orderpriority",))
    assert r.find(spec) is not None
    return r.answer(spec).select("l_returnflag", F.round("sum_l_quantity", 2).alias("q"), F.col("count_rows").alias("n"), F.col("min_l_tax").alias("t"), F.round("avg_l_discount", 8).alias("d"))


@query("materialize_not_covered", "SELECT l_returnflag, max(l_tax) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag")
def _uncovered(spark, sf_dir):
    r = _registry(spark, sf_dir)
    spec = Spec("lineitem", JOINED, ("l_returnflag",), (("max", "l_tax"),))
    assert r.find(spec) is None
    return r.answer(spec).withColumnRenamed("max_l_tax", "t")


# -- time windows, batch and streaming --------------------------------------------------------
def timed(name: str, expression: str, oracle: str) -> None:
    text = f"SELECT w.start AS s, w.end AS e, event_type, count(*) AS n, round(sum(value), 2) AS v FROM (SELECT *, {expression} AS w FROM @events) GROUP BY w, event_type"
    if "session" in expression.lower():
        text = f"SELECT w.start AS s, w.end AS e, user_id, count(*) AS n FROM (SELECT {expression} AS w, user_id, ts FROM @events) GROUP BY w, user_id"
        text = f"SELECT {expression}.start AS s, {expression}.end AS e, user_id, count(*) AS n FROM @events GROUP BY {expression}, user_id"
    QUERIES[name] = sql_query(["events"], dialect.translate(text), oracle)


TUMBLED = "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS e, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2, 3"
HOPPED = """SELECT s, s + INTERVAL 12 HOUR AS e, event_type, count(*) AS n, round(sum(value), 2) AS v
    FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2, 3"""
SESSIONS = """WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
    SELECT min(ts) AS s, max(ts) + INTERVAL 2 HOUR AS e, user_id, count(*) AS n FROM b GROUP BY user_id, k"""
timed("window_tumble", "TUMBLE(ts, '6 hours')", TUMBLED)
timed("window_hop", "HOP(ts, '12 hours', '6 hours')", HOPPED)
timed("window_session", "SESSION(ts, '2 hours')", SESSIONS)
QUERIES["window_tumble_bounds"] = sql_query(["events"], dialect.translate("SELECT TUMBLE_START(ts, '1 day') AS s, TUMBLE_END(ts, '1 day') AS e, count(*) AS n FROM @events GROUP BY window(ts, '1 day')").replace("(window(ts, '1 day')).", "window."), "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS s, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS e, count(*) AS n FROM events GROUP BY 1, 2")


BOUNDS = "SELECT {0}_START(ts, {1}) AS s, {0}_END(ts, {1}) AS e, count(*) AS n FROM @events GROUP BY {2}"
QUERIES["window_hop_bounds"] = sql_query(["events"], dialect.translate(BOUNDS.format("HOP", "'12 hours', '6 hours'", "window(ts, '12 hours', '6 hours')")).replace("(window(ts, '12 hours', '6 hours')).", "window."),
    "SELECT s, s + INTERVAL 12 HOUR AS e, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2")
QUERIES["window_session_bounds"] = sql_query(["events"], dialect.translate(BOUNDS.replace("count(*)", "user_id, count(*)").format("SESSION", "'2 hours'", "session_window(ts, '2 hours'), user_id")), SESSIONS)


def _events_stream(spark, sf_dir) -> DataFrame:
    path = shared(spark, "events")
    load(spark, sf_dir, "events").repartition(4).write.parquet(path)
    return windows.source(spark, path, load(spark, sf_dir, "events").schema)


@query("stream_tumble", TUMBLED)
def _stream_tumble(spark, sf_dir):
    df = windows.tumble(_events_stream(spark, sf_dir), "ts", "6 hours").groupBy("w", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return windows.drain(df, "tumble", "complete").select(F.col("w.start").alias("s"), F.col("w.end").alias("e"), "event_type", "n", "v")


@query("stream_hop", HOPPED)
def _stream_hop(spark, sf_dir):
    df = windows.hop(_events_stream(spark, sf_dir), "ts", "12 hours", "6 hours").groupBy("w", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))
    return windows.drain(df, "hop", "complete").select(F.col("w.start").alias("s"), F.col("w.end").alias("e"), "event_type", "n", "v")


@query("stream_session", SESSIONS)
def _stream_session(spark, sf_dir):
    df = windows.session(_events_stream(spark, sf_dir), "ts", "2 hours").groupBy("w", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.drain(df, "session", "complete").select(F.col("w.start").alias("s"), F.col("w.end").alias("e"), "user_id", "n")


@query("pipe_auto_ingest", NATION)
def _pipe(spark, sf_dir):
    folder, n = shared(spark, "inbox"), _nation(spark, sf_dir)
    pipe = windows.Pipe(spark, folder, shared(spark, "ingested"), n.schema)
    n.where("n_nationkey < 10").write.mode("append").json(folder)
    pipe.run()
    n.where("n_nationkey >= 10").write.mode("append").json(folder)
    return pipe.run()
