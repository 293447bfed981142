"""Helpers shared by the corpus operators: reading, shared work tables, words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import ship_package

#: ASCII white space of the word and line rules, as a Java character class body and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package on its executors."""
    ship_package(df.sparkSession)
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read only through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle width of the session; explicit exchanges use the same."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``; where that is unset, local runs get a
    temporary folder, and a cluster an error, as its machines share no such folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="runlens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/runlens-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing will read it again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search("/runlens-[a-z]+-[0-9a-f]{32}$", name):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_held: dict[str, object] = {}


def holds(name: str, clear) -> None:
    """Register the cache that an operator keeps in a Python worker."""
    _held[name] = clear


def claim(name: str) -> None:
    """An operator starts in this worker: caches that other operators left in it are dropped."""
    for other, clear in _held.items():
        if other != name:
            clear()


def let(value, body):
    """Bind ``value`` once for the use of ``body`` (a function of a column).

    Written as a one-element transform so that the optimizer can't copy an
    expensive array expression into every element of a lambda that indexes it.
    """
    return F.transform(F.array(value), body)[0]


def words(text):
    """Words of a text column in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def n_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")
