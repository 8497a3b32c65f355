"""Operators: snapshots, merge errors, joins, materialisation, plan shapes."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.materialize import Registry, Spec
from millrace.operators.versioned import Conflict, VersionedTable
from millrace.plans.base import load
from millrace.sources import files
from millrace.sources.work import Files, shared


def numbers(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")


def test_delete_keeps_rows_whose_condition_is_null(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    t.delete(F.col("v") == "a")
    assert sorted(r.k for r in t.read().collect()) == [2, 3]


def test_merge_refuses_two_sources_for_a_row(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"], {"v": "s.v"})


def test_merge_lets_unmatched_sources_repeat_and_rewrites_only_touched_folders(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    t.insert(spark.createDataFrame([(10, "z")], "k int, v string"))
    before = {p["name"] for p in t._state(1)["parts"]}
    t.merge(spark.createDataFrame([(10, "new"), (77, "a"), (77, "b")], "k int, v string"), ["k"], {"v": "s.v"})
    assert sorted((r.k, r.v or "") for r in t.read().collect()) == [(1, "a"), (2, ""), (3, "c"), (10, "new"), (77, "a"), (77, "b")]
    assert len(before & {p["name"] for p in t._state(2)["parts"]}) == 1


def test_commits_race_safely(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    state = t._state(0)
    t.insert(numbers(spark))
    with pytest.raises(Conflict):
        t._commit(0, "insert", state["parts"], state["schema"])


def test_untouched_folders_are_carried_over(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    t.insert(spark.createDataFrame([(10, "z")], "k int, v string"))
    before = {p["name"] for p in t._state(1)["parts"]}
    t.update(F.col("k") == 10, {"v": F.lit("y")})
    assert len(before & {p["name"] for p in t._state(2)["parts"]}) == 1


def test_time_travel_and_vacuum(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    t.truncate()
    assert t.read().count() == 0 and t.read(version=0).count() == 3
    assert len(t.vacuum()) == 0  # too young: a writer may be about to commit
    assert len(t.vacuum(grace_ms=0)) == 1


def test_copy_into_aborts_on_a_bad_row(spark):
    path = shared(spark, "csv")
    spark.createDataFrame([("1", "a"), ("oops", "b")], "k string, v string").write.option("header", True).csv(path)
    t = VersionedTable.create(numbers(spark).where("k < 0"), shared(spark, "t"))
    with pytest.raises(ValueError):
        t.copy_into(path)
    t.copy_into(path, on_error="continue")
    assert [r.k for r in t.read().collect()] == [1]


def test_salted_join_equals_plain_join(spark):
    large = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    for how in ("inner", "left"):
        a = joins.salted(large, small, "k", 7, how).select("k", "id", "v").collect()
        assert sorted(map(str, a)) == sorted(map(str, large.join(small, "k", how).select("k", "id", "v").collect()))
    with pytest.raises(ValueError):
        joins.salted(large, small, "k", 7, "full")


def test_range_join_has_no_nested_loop(spark):
    p, s = spark.range(100).withColumn("x", F.col("id") * 1.0), spark.createDataFrame([(1, 2.0, 5.0), (2, 90.0, 95.0)], "s int, a double, b double")
    out = joins.ranges(p, s, "x", "a", "b", 3.0)
    assert out.count() == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from millrace.plans import queries

    plan = queries()["tpch_q6"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp" in plan


def test_materialisation_needs_every_filter_it_was_built_with(spark, sf_dir):
    r = Registry(spark, lambda t: load(spark, sf_dir, t))
    r.materialize(Spec("orders", (), ("o_orderstatus",), (("count", "*"),), ("o_custkey > 5",), ("o_custkey",)), shared(spark, "m"))
    assert r.find(Spec("orders", (), ("o_orderstatus",), (("count", "*"),))) is None
    assert r.find(Spec("orders", (), (), (("count", "*"),), ("o_custkey > 5",))) is not None


def test_avro_round_trip_of_every_type():
    from millrace.sources import avro

    schema = {
        "type": "record", "name": "r", "namespace": "n", "fields": [
            {"name": "a", "type": ["null", "long"]}, {"name": "b", "type": "boolean"}, {"name": "c", "type": "float"}, {"name": "d", "type": "double"}, {"name": "e", "type": "bytes"},
            {"name": "f", "type": {"type": "enum", "name": "e", "symbols": ["x", "y"]}}, {"name": "g", "type": {"type": "fixed", "name": "q", "size": 3}}, {"name": "h", "type": {"type": "map", "values": "int"}}, {"name": "i", "type": {"type": "array", "items": "e"}},
        ],
    }
    rows = [{"a": a, "b": True, "c": 0.5, "d": -1e300, "e": b"\0\xff", "f": "y", "g": b"abc", "h": {"k": -1}, "i": ["x", "y"]} for a in (None, 0, -1, 2**62, -(2**63))]
    for codec in ("null", "deflate"):
        assert list(avro.records(avro.container(schema, rows, codec))) == rows
    with pytest.raises(ValueError, match="ends early"):
        list(avro.records(avro.container(schema, rows, "null")[:-30]))


def test_deletion_vectors_round_trip_and_refuse_damage():
    import random
    import struct

    from millrace.sources import roaring

    rnd = random.Random(1)
    for rows in ([], [0], [2**32 - 1, 2**32, 2**40 + 5], range(3, 200_000, 7), range(65_530, 140_000), [rnd.randrange(2**34) for _ in range(5_000)]):
        assert roaring.numbers(roaring.packed(rows)).tolist() == sorted(set(rows))
    # runs 5-9 and 65535 in container 0, and an array in container 2; two containers with runs list no offsets
    bitmap = struct.pack("<I", 12347 | 1 << 16) + b"\x01" + struct.pack("<4H", 0, 5, 2, 1) + struct.pack("<5H", 2, 5, 4, 65535, 0) + struct.pack("<2H", 1, 7)
    vector = struct.pack("<IQI", 1681511377, 1, 0) + bitmap
    assert roaring.numbers(vector).tolist() == [5, 6, 7, 8, 9, 65535, 131073, 131079]
    body, (first, second) = roaring.filed([vector, roaring.packed([4])])
    assert roaring.stored(body, first, len(vector)) == vector and roaring.numbers(roaring.stored(body, second, len(roaring.packed([4])))).tolist() == [4]
    spoilt = bytearray(body)
    spoilt[first + 30] ^= 1
    for damaged in (bytes(spoilt), body[: second - 6], b"\x07" + body[1:]):
        with pytest.raises((ValueError, struct.error)):
            roaring.stored(damaged, first, len(vector))
    with pytest.raises(ValueError, match="format"):
        roaring.numbers(bytes(12))


def test_delta_refuses_a_log_with_a_gap(spark):
    from millrace.sources import lakes
    from millrace.sources.work import Files

    path = shared(spark, "delta")
    for v in (0, 2):
        Files(spark).write(f"{path}/_delta_log/{v:020d}.json", '{"metaData": {"schemaString": "{\\"type\\": \\"struct\\", \\"fields\\": []}"}}')
    assert lakes.delta(spark, path, version=0).columns == []
    with pytest.raises(ValueError, match="lacks version 1"):
        lakes.delta(spark, path)


def test_schema_changes_rewrite_nothing_and_guard_types(spark):
    t = VersionedTable.create(numbers(spark), shared(spark, "t"))
    before = [p["name"] for p in t._state(0)["parts"]]
    t.add_columns("w double")
    t.change_column("k", "key", "bigint")
    assert [p["name"] for p in t._state(2)["parts"]] == before
    assert [tuple(r) for r in t.read().orderBy("key").collect()] == [(1, "a", None), (2, None, None), (3, "c", None)]
    assert t.read(version=0).columns == ["k", "v"]
    with pytest.raises(ValueError):
        t.change_column("key", "key", "string")
    with pytest.raises(ValueError):
        t.add_columns("KEY int")


def test_runtime_filter_settings_and_sort_order(spark, sf_dir):
    from millrace.plans import queries

    got = [r.s for r in queries()["sort_nulls_first"](spark, sf_dir).collect()]
    assert got == sorted(got, key=lambda v: (v is not None, v or ""))
    got = [r.s for r in queries()["sort_nulls_last_desc"](spark, sf_dir).collect()]
    assert [v for v in got if v is None] == got[len([v for v in got if v is not None]) :]
    top = [(-r.o_totalprice, r.o_orderkey) for r in queries()["sort_top_n"](spark, sf_dir).collect()]
    assert top == sorted(top)


def test_grants_and_reflections_in_statements(spark, sf_dir):
    from millrace.plans.statements import CREATE, engine

    e = engine(spark, sf_dir)
    for text in (CREATE, "CREATE ROLE readers", "CREATE ROLE all_staff", "CREATE USER ann", "GRANT ROLE readers TO ROLE all_staff", "GRANT ROLE all_staff TO USER ann", "GRANT SELECT ON TABLE kept TO ROLE readers"):
        e.execute(text)
    e.user = "ann"
    assert e.execute("SELECT IS_MEMBER('readers') AS a, LAST_QUERY_ID() IS NOT NULL AS b").first()[:] == (True, True)
    assert e.execute("SELECT count(*) AS n FROM kept").first().n
    e.user = None
    e.execute("REVOKE SELECT ON TABLE kept FROM ROLE readers")
    e.user = "ann"
    with pytest.raises(PermissionError):
        e.execute("SELECT * FROM kept")
    e.user = None
    e.execute("ALTER TABLE kept CREATE AGGREGATE REFLECTION r USING DIMENSIONS (o_orderstatus) MEASURES (* (COUNT))")
    text = "SELECT o_orderstatus, COUNT(*) AS n FROM kept GROUP BY o_orderstatus"
    assert "reflection-r" in e.execute(text).inputFiles()[0]
    e.execute("ALTER TABLE kept DISABLE ACCELERATION")
    assert "reflection-r" not in e.execute(text).inputFiles()[0]
    assert "Aggregate" in e.execute(f"EXPLAIN PLAN FOR {text}").first().plan and e.execute(f"EXPLAIN JSON FOR {text}").first().plan.startswith("[")


def test_runtime_filter_reaches_the_plan(spark, sf_dir):
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders").where("o_custkey < 9")
        assert "might_contain" in li.join(o, li.l_orderkey == o.o_orderkey)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_statements_report_faults(spark, sf_dir):
    from millrace.plans.statements import engine

    e = engine(spark, sf_dir)
    e.execute("CREATE TABLE t (k INT)")
    for wrong in ("CREATE TABLE t (k INT)", "DELETE FROM nowhere", "INSERT INTO t VALUES (1, 2)", "ALTER TABLE t DROP COLUMN q", "SELECT * FROM t AT TAG none"):
        with pytest.raises(Exception):  # noqa: B017
            e.execute(wrong).collect()
    e.execute("INSERT INTO t VALUES (1), (2)")
    assert e.execute("SELECT count(*) AS n FROM t WHERE k IN (SELECT k FROM t AT SNAPSHOT '1')").first().n == 2
    assert e.execute("DROP TABLE t").first().ok


def test_bloom_filters_stay_within_small_row_groups(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "id * 7919 % 4001 AS k").coalesce(1)
    files.write_parquet(df, f"file://{tmp_path}/p", row_group_bytes=2048, page_bytes=512, bloom=("k",))
    one, size = next((f, size) for f, size, *_ in Files(spark).list(f"file://{tmp_path}/p") if f.endswith(".parquet"))
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(one), spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    groups = list(reader.getRowGroups())
    offsets = [g.getColumns()[1].getBloomFilterOffset() for g in groups]
    reader.close()
    assert all(x > 0 for x in offsets) and len(groups) > 9
    assert size < 400_000  # a filter of 1 MB per row group made 33 MB of it
    assert files.parquet_footer(spark, one, size).num_row_groups == len(groups)
