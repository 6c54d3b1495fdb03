"""Helpers that every operator of the subpackage shares: shared folders, tables, columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: what separates words (space, tab, LF, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only on a local master where it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that :func:`stored` wrote."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_dir(spark)
    for f in df.inputFiles():
        folder = f.rsplit("/", 1)[0]
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return


class Scratch:
    """The stored tables of one run, deleted together once its result is stored."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def also(self, table: DataFrame) -> DataFrame:
        """Takes over a table that was stored elsewhere."""
        self.tables.append(table)
        return table

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Stores the result and deletes all tables before it."""
        out = stored(df, name)
        for t in self.tables:
            drop_stored(t)
        self.tables = []
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: str | Column = "text") -> Column:
    """Array of the words of a text (JVM side); null and blank texts give an empty array."""
    return F.filter(F.split(text_of(column), SPACE), lambda w: w != "")


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, limit: int = 50_000) -> DataFrame:
    """Broadcasts ``small`` only if its counted ``rows`` are within ``limit``; beyond, a shuffled join that AQE splits on skew."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


#: A key with more than this share of the rows is joined by a broadcast: fewer than 1 / HOT_SHARE keys can have it.
HOT_SHARE = 0.001


def join_split(big: DataFrame, keys: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left_semi join of ``big`` with ``keys`` (one row a key; ``count``: rows of ``big`` with it, ``total``: all its rows).

    Rows of frequent keys stay where they are and meet the few keys by a broadcast, the others are shuffled.
    """
    on = [key] if isinstance(key, str) else key
    often = F.col(count) > F.lit(total * HOT_SHARE)
    hot, rest = F.broadcast(keys.where(often)), keys.where(~often)
    return big.join(hot, on, how).unionByName(big.join(hot.select(*on), on, "left_anti").join(rest, on, how))
