"""Session plumbing shared by the corpus operators: the cluster's shared folder and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a character class body for Java and RE2 patterns.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE = f"[{SPACE_CLASS}]"
WORD = f"[^{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see (``spark.checkpoint.dir``).

    A folder of our own is used only where the setting is absent, which is the case in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder for written tables")
        found = getattr(spark, "_gridloom_dir", None) or tempfile.mkdtemp(prefix="gridloom-")
        spark._gridloom_dir = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts the lineage, survives lost executors, and freezes what a later step must see unchanged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that ``written`` has filled and ``clear`` has not removed, oldest first.
_PATHS: list[str] = []


def clear(spark: SparkSession, keep: int = 0, since: int = 0) -> None:
    """Remove the written tables from number ``since`` on, but for the last ``keep``; frames that read them cannot be used any more.

    The numbers count all tables of this driver, so two runs that clear up must not go on at the same time in one.
    """
    gone = _PATHS[since : len(_PATHS) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _PATHS.remove(path)


def tables_written() -> int:
    """How many written tables there are: a mark for ``clear``."""
    return len(_PATHS)


def keyed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a written table with a unique number in the column ``key``, the same at every later read."""
    return written(df.withColumn(key, F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession, n: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` of ``n``; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // per_task + 1)


#: Rows that may be broadcast: 16 MB of them for one or two long columns, some 60 MB with a digest.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts in these rows that may be broadcast.
BROADCAST_BYTES = 64_000_000


def few(df: DataFrame, *texts: str) -> DataFrame:
    """Marked for broadcasting if it has been counted and is below the bounds; else Spark's own choice of join.

    ``texts`` names the columns without a fixed width, whose bytes are counted too.
    """
    size = F.coalesce(F.sum(sum((F.coalesce(F.octet_length(x), F.lit(0)) for x in texts), F.lit(0))), F.lit(0))
    rows, held = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df
