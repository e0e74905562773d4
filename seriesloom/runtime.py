"""Session helpers: lineage cuts in the folder that the cluster shares.

Nothing here writes to a machine-local folder unless the session itself runs
on one machine and names no checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 row numbers that are broadcast at most: 32 MB of numbers and masks, 134 million rows.
MARK_WORDS = 1 << 21


def session(name: str = "seriesloom", **conf: str) -> SparkSession:
    """A session with the settings that the library's results assume (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data: spark.checkpoint.dir.

    A local session without that setting gets a temporary folder of its own; a
    cluster without it is an error, as its executors share no local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="seriesloom-checkpoints-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files (and checkpoints, where it is set to) of tables that nothing refers to any more.

    Its cleaner waits for the driver's garbage collector, which a driver with
    little to do runs every half hour; until then each step's files stay.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/seriesloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like cut(), as a Parquet table: columnar and compressed, for wider or larger rows.

    The table is left in the shared folder; whoever owns that folder expires it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() gave and nothing reads any more.

    Nothing else is deleted: a table outside the folder for intermediate data stays.
    """
    spark = df.sparkSession
    ours = f"{shared_dir(spark).rstrip('/')}/seriesloom-"
    jvm, seen = spark.sparkContext._jvm, set()
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if path.toString() not in seen and path.toString().startswith(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(ours)).toString()):
            fs.delete(path, True)
        seen.add(path.toString())


def with_marked(docs: DataFrame, numbers: DataFrame, row_no: str, keep: bool, words: int = MARK_WORDS) -> DataFrame | None:
    """The rows of `docs` whose long `row_no` is (keep) or is not among the single column `numbers`; no row is shuffled.

    The numbers become 64 bits a word, so numbers of rows of a scan take at
    most a 64th of its rows. None if they are more than `words` words, which a
    broadcast should not hold.
    """
    n = F.col(numbers.columns[0])
    masks = cut(numbers.select(F.shiftright(n, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(`{numbers.columns[0]}` & 63 as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    if masks.count() > words:
        return None
    out = docs.withColumn("__at", F.shiftright(row_no, 6)).join(F.broadcast(masks), F.col("__at") == F.col("__word"), "inner" if keep else "left")
    marked = F.expr(f"shiftrightunsigned(__bits, cast(`{row_no}` & 63 as int)) & 1 = 1")
    return out.where(marked if keep else ~F.coalesce(marked, F.lit(False))).select(*docs.columns)


def written_order() -> tuple[Column, Column]:
    """(file, row in it) of each row of a Parquet table, files in the order of the partitions they were written from.

    A scan takes files by their size, so row numbers of the scan do not tell.
    """
    name = F.col("_metadata.file_name")
    return F.concat(F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 12, "0"), name), F.col("_metadata.row_index")
