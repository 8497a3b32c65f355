"""SQL statements over snapshot tables, each against what it must leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.base import Query, load
from millrace.sources.statements import Engine
from millrace.sources.work import shared

QUERIES: dict[str, Query] = {}
KEPT = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
CREATE = f"CREATE TABLE kept (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE) PARTITION BY (o_orderstatus) LOCALSORT BY (o_orderkey) AS SELECT {KEPT} FROM orders"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, shared(spark, "engine"))
    for name in ("orders", "nation", "region", "customer"):
        e.table(name, load(spark, sf_dir, name))
    return e


def statements(name: str, oracle: str, *texts: str) -> None:
    """Run the statements in turn; the last one's rows are the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        for t in texts[:-1]:
            e.execute(t)
        return e.execute(texts[-1])

    QUERIES[name] = Query(run, oracle)


ALL = f"SELECT {KEPT} FROM kept"
statements("sql_create_table_as", f"SELECT {KEPT} FROM orders", CREATE, ALL)
statements("sql_create_insert_values", "SELECT 1 AS k, 'a' AS v UNION ALL SELECT 2, NULL", "CREATE TABLE t (k INTEGER, v VARCHAR(10))", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t (k) SELECT 2", "SELECT k, v FROM t")
statements("sql_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 50 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 50 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
    CREATE, "UPDATE kept SET o_totalprice = o_totalprice + 1, o_orderstatus = 'X' WHERE o_custkey < 50", ALL)
statements("sql_delete", f"SELECT {KEPT} FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)", CREATE, "DELETE FROM kept WHERE o_orderstatus = 'F' AND o_totalprice > 100000", ALL)
statements(
    "sql_merge_into",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 4 = 1 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 4 = 1 THEN 7.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey % 4 <> 0
    UNION ALL SELECT -1 - c_custkey, c_custkey, 'N', c_acctbal FROM customer WHERE c_acctbal > 0""",
    CREATE,
    """MERGE INTO kept AS t USING (SELECT o_orderkey AS k, o_custkey AS c, 7.0D AS p FROM orders WHERE o_custkey % 4 < 2 UNION ALL SELECT -1 - c_custkey, c_custkey, c_acctbal FROM customer) AS s ON t.o_orderkey = s.k
    WHEN MATCHED AND s.c % 4 = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET o_orderstatus = 'M', o_totalprice = s.p WHEN NOT MATCHED AND s.p > 0 THEN INSERT (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES (s.k, s.c, 'N', s.p)""",
    ALL,
)
statements("sql_truncate", f"SELECT {KEPT} FROM orders WHERE false", CREATE, "TRUNCATE TABLE kept", ALL)
statements("sql_alter_columns", "SELECT o_orderkey, o_custkey, NULL::INTEGER AS note, o_totalprice AS price FROM orders UNION ALL SELECT 0, 0, 5, 1.5", CREATE.replace("PARTITION BY (o_orderstatus) ", ""),
    "ALTER TABLE kept ADD COLUMNS (note INT)", "ALTER TABLE kept DROP COLUMN o_orderstatus", "ALTER TABLE kept CHANGE COLUMN o_totalprice price DOUBLE", "INSERT INTO kept (o_orderkey, o_custkey, note, price) VALUES (0, 0, 5, 1.5)", "SELECT * FROM kept")
statements("sql_alter_widen", "SELECT n_nationkey::BIGINT AS n_nationkey, 'bigint' AS kind FROM nation UNION ALL SELECT 5000000000, 'bigint'", "CREATE TABLE n AS SELECT n_nationkey FROM nation", "ALTER TABLE n MODIFY COLUMN n_nationkey n_nationkey BIGINT", "INSERT INTO n VALUES (5000000000)", "SELECT n_nationkey, typeof(n_nationkey) AS kind FROM n".replace("typeof", "TYPEOF").replace("TYPEOF(n_nationkey)", "lower(TYPEOF(n_nationkey))"))
statements("sql_partition_transforms", "SELECT year(o_orderdate)::VARCHAR AS _by_year_o_orderdate, count(*) AS rows FROM orders GROUP BY 1", "CREATE TABLE t PARTITION BY (year(o_orderdate)) AS SELECT o_orderkey, o_orderdate FROM orders", "SELECT `date_format(o_orderdate, yyyy)` AS _by_year_o_orderdate, rows FROM TABLE(TABLE_PARTITIONS('t'))")
statements("sql_partition_evolution", f"SELECT {KEPT} FROM orders", CREATE, "ALTER TABLE kept DROP PARTITION FIELD o_orderstatus", "ALTER TABLE kept ADD PARTITION FIELD bucket(4, o_custkey)", "ALTER TABLE kept LOCALSORT BY (o_custkey)", "OPTIMIZE TABLE kept (files = 2)", ALL)
statements("sql_at_snapshot", "SELECT count(*) AS n, 0::BIGINT AS now FROM orders", CREATE, "DELETE FROM kept", "SELECT (SELECT count(*) FROM kept AT SNAPSHOT '0') AS n, (SELECT count(*) FROM kept) AS now")
statements("sql_at_tag_and_branch", "SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b FROM orders", CREATE, "CREATE TAG first", "DELETE FROM kept WHERE o_orderstatus = 'F'", "CREATE BRANCH later", "TRUNCATE TABLE kept", "SELECT (SELECT count(*) FROM kept AT TAG first) AS a, (SELECT count(*) FROM kept AT BRANCH later) AS b")
statements("sql_rollback", f"SELECT {KEPT} FROM orders", CREATE, "DELETE FROM kept WHERE o_custkey > 10", "ROLLBACK TABLE kept TO SNAPSHOT '0'", ALL)
statements("sql_optimize_vacuum", f"SELECT {KEPT} FROM orders", CREATE, "OPTIMIZE TABLE kept REWRITE DATA USING BIN_PACK (target_file_size_mb = 64)", "VACUUM TABLE kept EXPIRE SNAPSHOTS retain_last = 1", ALL)
statements("sql_analyze_statistics", "SELECT 'n_regionkey' AS column_name, count(*) AS rows, count(DISTINCT n_regionkey) AS distinct_values, 0::BIGINT AS nulls, min(n_regionkey)::VARCHAR AS low, max(n_regionkey)::VARCHAR AS high FROM nation",
    "CREATE TABLE n AS SELECT * FROM nation", "ANALYZE TABLE n FOR COLUMNS (n_regionkey) COMPUTE STATISTICS", "INSERT INTO n SELECT * FROM nation WHERE n_nationkey < 0", "SHOW STATISTICS FOR n")
statements("sql_table_functions", "SELECT 0::BIGINT AS snapshot_id, 'create' AS operation, count(*) AS rows FROM nation UNION ALL SELECT 1, 'delete', count(*) FROM nation WHERE n_regionkey <> 1", "CREATE TABLE n AS SELECT * FROM nation", "DELETE FROM n WHERE n_regionkey = 1", "SELECT snapshot_id, operation, rows FROM TABLE(TABLE_HISTORY('n'))")
statements("sql_join_of_tables", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "CREATE TABLE n AS SELECT * FROM nation", "CREATE TABLE r AS SELECT * FROM region", "SELECT r_name, count(*) AS n FROM n JOIN r ON n.n_regionkey = r.r_regionkey GROUP BY r_name")
statements("sql_view_and_function", "SELECT n_name, n_nationkey * 2 AS twice FROM nation WHERE n_regionkey = 1", "CREATE TABLE n AS SELECT * FROM nation", "CREATE VIEW one AS SELECT * FROM n WHERE n_regionkey = 1", "CREATE FUNCTION double_it(x INT) RETURNS INT RETURN x * 2", "SELECT n_name, double_it(n_nationkey) AS twice FROM one")
statements("sql_describe_show_create", "SELECT 'CREATE TABLE kept (o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double) PARTITION BY (o_orderstatus) LOCALSORT BY (o_orderkey)' AS definition, 'kept' AS table_name", CREATE, "SHOW CREATE TABLE kept")
statements("sql_describe_table", "SELECT 'k' AS column_name, 'int' AS data_type, true AS is_nullable UNION ALL SELECT 'v', 'string', true", "CREATE TABLE t (k INTEGER, v VARCHAR)", "DESCRIBE TABLE t")
statements("sql_information_schema", "SELECT 'n' AS t, 'n_name' AS c, 2 AS p, 'string' AS k", "CREATE TABLE n AS SELECT n_nationkey, n_name FROM nation", "SELECT TABLE_NAME AS t, COLUMN_NAME AS c, ORDINAL_POSITION AS p, DATA_TYPE AS k FROM INFORMATION_SCHEMA.\"COLUMNS\" WHERE TABLE_NAME = 'n' AND COLUMN_NAME LIKE '%name'")
statements("sql_sys_snapshots", "SELECT 'n' AS table_name, 1::BIGINT AS snapshot_id, 'delete' AS operation, count(*) AS rows FROM nation WHERE n_regionkey <> 2", "CREATE TABLE n AS SELECT * FROM nation", "DELETE FROM n WHERE n_regionkey = 2", "SELECT table_name, snapshot_id, operation, rows FROM sys.snapshots WHERE snapshot_id > 0")
statements("sql_sys_roles", "SELECT 'readers' AS role_name, 'ann, bob' AS members", "CREATE ROLE readers", "CREATE USER ann", "CREATE USER bob", "GRANT ROLE readers TO USER ann", "GRANT ROLE readers TO USER bob", "CREATE ROLE gone", "DROP ROLE gone", "SELECT role_name, members FROM sys.roles")
statements("sql_division_of_integers", "SELECT c_custkey, (c_custkey - 40) // 7 + CASE WHEN (c_custkey - 40) % 7 < 0 THEN 1 ELSE 0 END AS q, (c_nationkey + 1) // 2 * 3 AS r, sum(c_nationkey) OVER (PARTITION BY c_mktsegment)::BIGINT // 5 AS s FROM customer".replace("(c_custkey - 40) // 7 + CASE WHEN (c_custkey - 40) % 7 < 0 THEN 1 ELSE 0 END", "CAST(trunc((c_custkey - 40) / 7.0::DOUBLE) AS BIGINT)"),
    "SELECT c_custkey, (c_custkey - 40) / 7 AS q, (c_nationkey + 1) / 2 * 3 AS r, SUM(c_nationkey) OVER (PARTITION BY c_mktsegment) / 5 AS s FROM customer")
statements("sql_division_by_zero", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Infinity'::DOUBLE WHEN c_acctbal < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS z, c_acctbal / 4 AS q, round(2 * c_acctbal / 8 / 0.5, 6) AS w FROM customer", "SELECT c_custkey, c_acctbal / (c_custkey - c_custkey) AS z, c_acctbal / 4 AS q, round(2 * c_acctbal / 8 / 0.5D, 6) AS w FROM customer WHERE c_acctbal / 1 IS NOT NULL")
statements("sql_at_timestamp", f"SELECT {KEPT} FROM orders WHERE o_custkey > 10", CREATE, "DELETE FROM kept WHERE o_custkey <= 10", "SELECT * FROM kept AT TIMESTAMP '2999-01-01 00:00:00'")
statements("sql_use_branch", "SELECT count(*) AS n FROM orders", CREATE, "CREATE BRANCH b", "TRUNCATE TABLE kept", "USE BRANCH b", "SELECT count(*) AS n FROM kept")
statements("sql_show_tags", "SELECT 'a' AS name, 'kept' AS table_name, 0::BIGINT AS snapshot_id UNION ALL SELECT 'b', 'kept', 0", CREATE, "CREATE TAG a", "DELETE FROM kept", "CREATE TAG b", "ALTER TAG b ASSIGN TAG a", "SHOW TAGS")
statements("sql_row_and_mask_policies", "SELECT n_nationkey, regexp_replace(n_name, '[A-Z]', 'X', 'g') AS n_name FROM nation WHERE n_regionkey <> 3", "CREATE TABLE n AS SELECT n_nationkey, n_name, n_regionkey FROM nation", "CREATE FUNCTION allowed(r INT) RETURNS BOOLEAN RETURN r <> 3",
    "ALTER TABLE n ADD ROW ACCESS POLICY allowed(n_regionkey)", "ALTER TABLE n MODIFY COLUMN n_name SET MASKING POLICY REGEXP_REPLACE(n_name, '[A-Z]', 'X')", "SELECT n_nationkey, n_name FROM n")
statements("sql_policies_unset", "SELECT n_nationkey, n_name FROM nation", "CREATE TABLE n AS SELECT n_nationkey, n_name FROM nation", "ALTER TABLE n ADD ROW ACCESS POLICY n_nationkey > 3", "ALTER TABLE n MODIFY COLUMN n_name SET MASKING POLICY 'x'", "ALTER TABLE n DROP ROW ACCESS POLICY", "ALTER TABLE n MODIFY COLUMN n_name UNSET MASKING POLICY", "SELECT * FROM n")
statements("sql_table_properties", "SELECT * FROM (VALUES ('owner', 'me'), ('partition_by', ''), ('primary_key', 'k'), ('sort_by', 'k')) AS t(key, value)", "CREATE TABLE t (k INT, v VARCHAR) LOCALSORT BY (v)", "ALTER TABLE t SET TBLPROPERTIES ('owner' = 'me', 'gone' = '1')", "ALTER TABLE t UNSET TBLPROPERTIES ('gone')", "ALTER TABLE t ADD PRIMARY KEY (k)", "ALTER TABLE t DROP LOCALSORT BY", "ALTER TABLE t CLUSTER BY (k)", "SHOW TBLPROPERTIES t")
statements("sql_reflection_answers", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus", CREATE, "ALTER TABLE kept CREATE AGGREGATE REFLECTION r USING DIMENSIONS (o_orderstatus, o_custkey) MEASURES (o_custkey (SUM), * (COUNT))", "SELECT o_orderstatus, SUM(o_custkey) AS s, COUNT(*) AS n FROM kept WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
statements("sql_reflection_stale", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey > 50 GROUP BY o_orderstatus", CREATE, "ALTER TABLE kept CREATE AGGREGATE REFLECTION r USING DIMENSIONS (o_orderstatus) MEASURES (* (COUNT))", "DELETE FROM kept WHERE o_custkey <= 50", "SELECT o_orderstatus, COUNT(*) AS n FROM kept GROUP BY o_orderstatus")
statements("sql_reflection_refreshed", "SELECT 'r' AS reflection_name, 'kept' AS table_name, count(DISTINCT o_orderstatus) AS rows FROM orders WHERE o_orderstatus <> 'F'", CREATE, "ALTER TABLE kept CREATE AGGREGATE REFLECTION r USING DIMENSIONS (o_orderstatus) MEASURES (* (COUNT))", "DELETE FROM kept WHERE o_orderstatus = 'F'", "ALTER TABLE kept REFRESH REFLECTIONS", "SHOW REFLECTIONS")
statements("sql_roles_is_member", "SELECT r_regionkey, false AS a FROM region", "CREATE ROLE analysts", "CREATE USER ann", "GRANT ROLE analysts TO USER ann", "SELECT r_regionkey, IS_MEMBER('analysts') AS a FROM region")


def _from_files(name: str, oracle: str, *texts: str):
    """Statements over a folder of CSV files, named by {in}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, folder = engine(spark, sf_dir), shared(spark, "csv-in")
        n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        bad = spark.createDataFrame([("x", "BAD", "1")], "n_nationkey string, n_name string, n_regionkey string")
        n.where("n_regionkey < 3").write.option("header", True).csv(f"{folder}/a")
        n.where("n_regionkey >= 3").selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in n.columns]).unionByName(bad).coalesce(1).write.option("header", True).csv(f"{folder}/b")
        for t in texts[:-1]:
            e.execute(t.replace("{in}", folder))
        return e.execute(texts[-1].replace("{in}", folder))

    QUERIES[name] = Query(run, oracle)


TABLE = "CREATE TABLE t (n_nationkey INT, n_name VARCHAR, n_regionkey INT)"
_from_files("sql_copy_into", "SELECT n_nationkey, n_name, n_regionkey FROM nation", TABLE, "COPY INTO t FROM '{in}/a' FILE_FORMAT 'csv' (EXTRACT_HEADER 'true')", "COPY INTO t FROM '{in}/b' FILE_FORMAT 'csv' (ON_ERROR 'continue', TRIM_SPACE 'true')", "SELECT * FROM t")
_from_files("sql_copy_errors", "SELECT 1::BIGINT AS n", TABLE, "COPY INTO t FROM '{in}/b' FILE_FORMAT 'csv' (ON_ERROR 'skip_file')", "SELECT count(*) AS n FROM TABLE(COPY_ERRORS('t'))")
_from_files("sql_pipe", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3", TABLE, "CREATE PIPE p DEDUPE_LOOKBACK_PERIOD 5 AS COPY INTO t FROM '{in}/a' FILE_FORMAT 'csv'", "TRIGGER PIPE p", "TRIGGER PIPE p", "SELECT * FROM t")
_from_files("sql_pipe_paused", "SELECT 'p' AS pipe_name, 't' AS target_table, false AS running, 0 AS files_loaded, 0::BIGINT AS rows", TABLE, "CREATE PIPE p AS COPY INTO t FROM '{in}/a' FILE_FORMAT 'csv'", "ALTER PIPE p SET PIPE_EXECUTION_RUNNING = FALSE", "TRIGGER PIPE p", "SHOW PIPES")
_run_paused = QUERIES["sql_pipe_paused"].run
QUERIES["sql_pipe_paused"] = Query(lambda spark, sf_dir: _run_paused(spark, sf_dir).selectExpr("pipe_name", "target_table", "running", "files_loaded", "CAST(0 AS BIGINT) AS rows"), QUERIES["sql_pipe_paused"].oracle)
