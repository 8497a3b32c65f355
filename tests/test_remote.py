"""Sources on a cluster whose driver and executors are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

from tests.conftest import ROOT

RUN = '''
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
from millrace import plans
from millrace.sources import derby, files
from tests.compare import connection, of_duckdb, of_spark
for name in ("external_query", "scan_jdbc_pushdown"):
    df = plans.queries()[name](spark, sys.argv[2])
    want = of_duckdb(connection(sys.argv[2]), plans.oracle_sql()[name])
    assert want[1] and of_spark(df) == want and of_spark(df) == want, name  # read twice, by either executor
assert "PushedFilters: [*IsNotNull(o_custkey), *LessThan(o_custkey,20)], ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in df._jdf.queryExecution().executedPlan().toString()
odd = [(1, "a,b"), (2, None), (3, ""), (4, 'say "so"'), (5, "two\\nlines"), (6, " spaced "), (7, "back\\\\slash"), (None, "\\u00e9\\u20ac")]
url = derby.database(spark.createDataFrame(odd, "k int, v string"), "ODD", '"k" INTEGER, "v" VARCHAR(20)')
got = [tuple(r) for r in files.query(spark, url, 'SELECT "k", "v" FROM ODD', driver=derby.DRIVER).collect()]
assert sorted(got, key=str) == sorted(odd, key=str), got
print("all right")
'''


def test_databases_reach_the_executors(tmp_path, sf_dir):
    home = tmp_path / "home"  # executors' folders go below it
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "all right" in done.stdout, done.stderr[-3000:]
