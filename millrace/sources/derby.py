"""A Derby database that every JVM of a job can open.

Derby runs inside the JVM that connects to it, and a database is open in one JVM at a time.  So the driver loads it on
its own disk and leaves a backup in the shared folder; the address given out names that backup, from which another JVM
that connects makes its own copy, in its working folder, first.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.sources.work import Files, shared

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _home(jvm) -> None:
    """The driver's databases go to a temporary folder, unless a place is set."""
    if jvm.System.getProperty("derby.system.home") is None:
        home = os.path.realpath(tempfile.mkdtemp(prefix="millrace-derby-"))
        atexit.register(shutil.rmtree, home, True)
        jvm.System.setProperty("derby.system.home", home)


def database(df: DataFrame, table: str, columns: str) -> str:
    """The JDBC address of a new database with one table, which holds the rows; ``columns`` as CREATE TABLE lists them.

    The rows go through files and Derby's bulk import: neither Python nor the driver's memory holds them.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    rows, kept, name = shared(spark, "derby-rows"), shared(spark, "derby"), f"millrace{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(kept)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        raise RuntimeError(f"Derby reads mounted folders only; spark.checkpoint.dir is {store.getScheme()}:")
    # texts stand in quotes, since the import trims what does not; a null is nothing at all
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    fields = [F.concat(F.lit('"'), F.replace(df[c], F.lit('"'), F.lit('""')), F.lit('"')) if c in texts else df[c].cast("string") for c in df.columns]
    df.select(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("value")).write.text(rows)
    _home(jvm)
    with tempfile.NamedTemporaryFile(prefix="millrace-", suffix=".csv") as held:
        local = os.path.realpath(held.name)
        Files(spark).gather(rows, local)
        c = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"jdbc:derby:{name};create=true", jvm.java.util.Properties())
        try:
            run = c.createStatement()
            run.execute(f"CREATE TABLE {table} ({columns})")
            run.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{local}', ',', '\"', 'UTF-8', 1)")
            run.execute(f"CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE('{at.toUri().getPath()}')")
        finally:
            c.close()
    Files(spark).delete(rows)
    return f"jdbc:derby:{name};createFrom={at.toUri().getPath()}/{name}"
