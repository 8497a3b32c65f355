"""The function dialect: rewrites, formats, edge values."""

import duckdb
import pytest

from millrace.functions import dialect, udfs


@pytest.mark.parametrize(
    ("text", "java"),
    [("YYYY-MM-DD", "yyyy-MM-dd"), ("DD.MM.YY HH24:MI:SS", "dd.MM.yy HH:mm:ss"), ("MON DD YYYY", "MMM dd yyyy"), ("YYYY\"T\"MM", "yyyy'T'MM")],
)
def test_formats(text, java):
    assert dialect.java_format(text) == java


def test_translate_leaves_literals_and_nested_calls_alone():
    out = dialect.translate("""SELECT CONCAT(a, 'LEFT(x, 1)'), LEFT(UPPER("b c"), n - 1) FROM t -- LEFT(y, 2)""")
    assert "concat_ws('', a, 'LEFT(x, 1)')" in out and "`b c`" in out and "-- LEFT(y, 2)" in out


def test_too_many_arguments():
    with pytest.raises(ValueError):
        dialect.sql("array_position", "1")


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("LEFT('abcdef', -2)", "abcd"), ("CONCAT('a', NULL, 'b')", "ab"), ("ARRAY_POSITION(NULL, array(1, NULL))", 1), ("ARRAY_SLICE(array(0, 1, 2, 3), -3, -1)", [1, 2]),
        ("ARRAY_REMOVE_AT(array(1, 2, 3), 9)", [1, 2, 3]), ("ARRAY_INSERT(array(1, 2, 3), -1, 55)", [1, 2, 55, 3]), ("SUBLIST(array(1, 2, 3), 0, 2)", [1, 2]), ("BIN(-2)", "1" * 31 + "0"), ("CHR(128512)", "😀"),
        ("TRUNCATE(-1.987D, 2)", -1.98), ("CONVERT(12, VARCHAR)", "12"), ("CONVERT('7', INTEGER) + 1", 8), ("IS_MEMBER('nobody at all')", False), ("BYTE_SUBSTR(X'00ff10', 2, 1)", b"\xff"), ("CAST(DATE '2024-03-01' - DATE '2024-02-27' AS STRING)", "INTERVAL '3' DAY"), ("TRUNCATE(1.15, 2)", 1.15), ("TRUNCATE(1.15D, 2)", 1.15), ("TRUNCATE(-129D, -1)", -120.0), ("TRUNCATE(1e30D, 2)", 1e30), ("CRC32('123456789')", 3421780262), ("HASH('Spark')", 228093765), ("DIVIDE(1D, 0D)", float("inf")), ("HASH64(CAST(NULL AS STRING))", 0), ("TO_DATE('31/12/2020', 'DD/MM/YYYY')", __import__("datetime").date(2020, 12, 31)), ("SIMILAR_TO('a cake', '%cake')", True),
        ("ISNUMERIC('1e5')", True), ("ISNUMERIC('NaN')", False), ("MASK_SHOW_LAST_N('Ab12', 2)", "Xx12"), ("ARRAY_AVG(array(2, NULL))", 1.0), ("TYPEOF('x')", "CHARACTER VARYING"),
    ],
)
def test_values(spark, expression, value):
    assert spark.sql("SELECT " + dialect.translate(expression)).first()[0] == value


def test_geohash():
    assert udfs.geohash(45.4408, 12.3155, 6) == "u20f80"
    lat, lon = udfs.geohash_centre(udfs.geohash(-33.86, 151.2, 11))
    assert abs(lat + 33.86) < 1e-5 and abs(lon - 151.2) < 1e-5


def test_group_id_numbers_repeated_sets(spark):
    spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int").createOrReplaceTempView("g")
    text = "SELECT x, y, GROUP_ID() AS g, count(*) AS n FROM g GROUP BY GROUPING SETS ((x, y), (x), (y, x), (x), (x))"
    got = spark.sql(dialect.translate(text)).collect()
    assert sorted(r.g for r in got if r.y is None) == [0, 0, 1, 1, 2, 2] and sorted(r.g for r in got if r.y is not None) == [0, 0, 1, 1]


@pytest.mark.parametrize("call", ["NDV(id)", "NDV(id) FILTER (WHERE id >= 0)", "NDV(CAST(id AS STRING))", "NDV(id / 4D)"])
def test_ndv_stays_near_at_a_million_keys(spark, call):
    """The keys on which a sketch of 2^9 registers was more than a tenth away."""
    text = dialect.translate(f"SELECT {call} AS n FROM {{r}}")
    assert abs(spark.sql(text, r=spark.range(1_200_000)).first().n - 1_200_000) < 60_000


def test_ndv_of_blanks_and_nulls(spark):
    text = dialect.translate("SELECT NDV(x) AS n, NDV(y) AS none FROM VALUES ('', NULL), (NULL, NULL), ('a', NULL) AS t (x, y)")
    assert tuple(spark.sql(text).first()) == (2, 0)


@pytest.mark.parametrize("name", ["exchange_reused", "cte_reused"])
def test_exchanges_are_reused(spark, sf_dir, name):
    from millrace.plans import queries

    df = queries()[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.count("Exchange hashpartitioning(o_custkey") == 1, plan


@pytest.mark.parametrize(("hint", "node"), [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("shuffle_replicate_nl", "CartesianProduct")])
def test_join_hints_reach_the_plan(spark, sf_dir, hint, node):
    from millrace.plans import queries

    assert node in queries()[f"join_hint_{hint}"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_filters_pass_windows_and_sets(spark, sf_dir):
    from millrace.plans import queries

    plan = queries()["window_filter_on_partition_key"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), LessThan(o_custkey,20)]" in plan
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("o_sets")
    plan = spark.sql("SELECT * FROM (SELECT o_custkey FROM o_sets UNION ALL SELECT o_orderkey FROM o_sets) WHERE o_custkey < 7")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LessThan(") == 2


def test_range_spans_of_any_length(spark):
    from pyspark.sql import functions as F

    from millrace.operators import joins

    p = spark.range(200).select((F.col("id") * 1.0).alias("x"), F.col("id").alias("_bin0"))
    spans = [(1, 2.0, 5.0), (2, 0.0, 1e6), (3, 7.0, 7.0), (4, None, 3.0), (5, 150.5, 152.5), (6, -8.0, 0.5)]
    s = spark.createDataFrame(spans, "s int, a double, b double")
    want = sorted((i, float(x)) for i, a, b in spans if a is not None for x in range(200) if a <= x < b)
    assert sorted((r.s, r.x) for r in joins.ranges(p, s, "x", "a", "b", 3.0).collect()) == want


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2 * 2", 6), ("2 * 7 / 4", 3), ("1 + 9 / 2 - 1", 4), ("(1 + 9) / (2 + 1)", 3), ("7 / 2.0D", 3.5), ("1D / 0", float("inf")), ("-1D / 0", float("-inf")), ("'a/b'", "a/b"),
        ("CASE WHEN true THEN 9 END / CASE WHEN true THEN 2 END", 4), ("array(8, 9)[1] / 2", 4), ("abs(-9) / length('ab') / 2", 2), ("9 / -2", -4), ("CAST(NULL AS INT) / 2", None), ("/* 1 / 2 */ 5 / 2", 2), ("length('x') / 1", 1),
    ],
)
def test_division(spark, expression, value):
    from millrace.sources.catalog import Catalog

    got = Catalog(spark).sql(f"SELECT {expression} AS v").first()[0]
    assert got == value and type(got) is type(value)


def test_division_of_decimals_is_left(spark):
    from millrace.sources.catalog import Catalog

    assert str(Catalog(spark).sql("SELECT 7 / 2.5 AS v").first()[0]).startswith("2.8") and Catalog(spark).sql("SELECT 7 / 2.5 AS v").dtypes[0][1].startswith("decimal")


def test_rounding_query_equals_its_sql_on_null_and_negative_keys(spark, tmp_path):
    from millrace.plans.scalars import QUERIES
    from tests.compare import of_duckdb, of_spark

    con, q = duckdb.connect(), QUERIES["fn_math_rounding"]
    con.execute(f"""COPY (SELECT i AS l_orderkey, 1 AS l_linenumber, CASE WHEN i % 50 <> 7 THEN i END AS l_partkey, 1.0::DOUBLE AS l_quantity,
        0.1::DOUBLE AS l_discount, CASE WHEN i % 11 <> 3 THEN i * 1.37::DOUBLE END AS l_extendedprice FROM range(-300, 300) AS t (i)) TO '{tmp_path}/lineitem.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert of_spark(q.run(spark, str(tmp_path))) == of_duckdb(con, q.oracle)
