"""Catalogue: views, SQL functions, policies, INFORMATION_SCHEMA and sys tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import dialect, division


@dataclass
class Catalog:
    """Named relations and functions of one session."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)

    def table(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def view(self, name: str, statement: str) -> None:
        """A view keeps its SQL text and is expanded when planned."""
        self.views[name] = statement
        self.sql(statement).createOrReplaceTempView(name)

    def sql(self, statement: str) -> DataFrame:
        """Run a statement of the dialect."""
        text = dialect.translate(statement)
        return self.spark.sql(division.typed(text, self.spark.sql) if "/" in text else text)

    # -- functions ------------------------------------------------------------------
    def function(self, name: str, args: str, returns: str, body: str) -> None:
        """CREATE FUNCTION: a scalar body, or a query if it returns a table."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {dialect.translate(body)}")
        self.functions[name] = f"({args}) RETURNS {returns} RETURN {body}"

    def drop_function(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        self.functions.pop(name, None)

    def show_functions(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.functions.items()), "function_name string, definition string")

    # -- policies ---------------------------------------------------------------------
    def protect(self, name: str, row_filter: str | None = None, masks: dict[str, str] | None = None) -> None:
        """A view of the table behind a row policy and column masks, each an expression over its columns."""
        df = self.tables[name]
        if row_filter:
            df = df.where(dialect.translate(row_filter))
        columns = [f"{dialect.translate(masks[c])} AS `{c}`" if masks and c in masks else f"`{c}`" for c in df.columns]
        df.selectExpr(*columns).createOrReplaceTempView(name)

    # -- metadata ------------------------------------------------------------------------
    def information_schema(self, name: str) -> DataFrame:
        """CATALOGS, SCHEMATA, TABLES, VIEWS or COLUMNS."""
        make = self.spark.createDataFrame
        if name == "CATALOGS":
            return make([("MILLRACE", "the session's catalogue")], "CATALOG_NAME string, CATALOG_DESCRIPTION string")
        if name == "SCHEMATA":
            return make([("MILLRACE", "session")], "CATALOG_NAME string, SCHEMA_NAME string")
        if name == "TABLES":
            return make([("session", n, "TABLE") for n in sorted(self.tables)] + [("session", n, "VIEW") for n in sorted(self.views)], "TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string")
        if name == "VIEWS":
            return make(sorted(self.views.items()), "TABLE_NAME string, VIEW_DEFINITION string")
        frames = {**self.tables, **{n: self.spark.table(n) for n in self.views}}
        rows = [(t, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for t, df in sorted(frames.items()) for i, f in enumerate(df.schema, 1)]
        return make(rows, "TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, IS_NULLABLE string")

    def sys(self, name: str) -> DataFrame:
        """options, version, memory, nodes, timezones, functions, cache or reflections."""
        make, sc = self.spark.createDataFrame, self.spark.sparkContext
        if name == "options":
            return self.spark.sql("SET -v").selectExpr("key AS name", "value", "meaning AS description")
        if name == "version":
            return make([(sc.version, sc.applicationId)], "version string, application string")
        if name == "memory":
            status = sc._jsc.sc().getExecutorMemoryStatus()
            keys = status.keys().iterator()
            rows = []
            while keys.hasNext():
                k = keys.next()
                rows.append((k, int(status.apply(k)._1()), int(status.apply(k)._2())))
            return make(rows, "node string, maximum long, free long")
        if name == "nodes":
            return self.sys("memory").select("node")
        if name == "timezones":
            ids = sc._jvm.java.time.ZoneId.getAvailableZoneIds()
            return make([(z,) for z in sorted(ids)], "timezone_name string")
        if name == "functions":
            return make([(f,) for f in sorted(dialect.known())], "function_name string")
        if name == "cache":
            return make([(n, df.is_cached) for n, df in sorted(self.tables.items())], "table_name string, cached boolean")
        raise KeyError(name)
