"""Reading the stored tables and the session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that all executors share, for tables that cut lineage; it goes when the application ends.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset and the master is local
    (tests, one machine) a folder below the warehouse folder is set as checkpoint folder and used; a cluster without one
    raises ``ValueError``, since executors couldn't read each other's local folders.
    """
    context = spark.sparkContext
    known = getattr(context, "_rangeloom_shared", None)
    if known:
        return known
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = context._jsc.sc().getCheckpointDir()
        if own.isDefined():
            base = own.get()
        elif not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
            context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/rangeloom-{context.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    context._rangeloom_shared = path
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str, name: str, build) -> DataFrame:
    """The table ``name`` that ``build()`` makes of the files under ``path``: written once per application, read by every later query.

    It is made again if the files change (their names, sizes or times).
    """
    context = spark.sparkContext
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    state = []
    while files.hasNext():
        f = files.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    known = getattr(context, "_rangeloom_stored", None)
    if known is None:
        known = context._rangeloom_stored = {}
    key = (name, path)
    if known.get(key, (None,))[0] != sorted(state):
        df = written(build(), name)
        known[key] = (sorted(state), df.inputFiles(), df.schema)
    _, where, schema = known[key]
    return spark.read.schema(schema).parquet(*where)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per Spark application, wherever they run."""
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_rangeloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rangeloom-"), "rangeloom.zip")  # the driver serves it to executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("rangeloom", os.path.relpath(full, home)))
    context.addPyFile(path)
    context._rangeloom_shipped = True
