"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Tables below this row count may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

#: Removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The array of words of a text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder serves in local mode only; on a cluster the setting is asked for.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage in the shared folder; for small tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder, a folder for each value of parts, and read again; for large tables.

    Spark removes the write's own shuffle files at its end, so that steps don't add up on disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the folders of steps that stored gave and nothing reads any more."""
    for df in steps:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until none of the columns is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class WordHash(dict):
    """64-bit hashes of byte strings, remembered for up to limit of them."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


word_hash = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))


def rows_to_text(values) -> list[str]:
    """Texts of a pandas column, nulls as empty."""
    return [v if isinstance(v, str) else "" for v in values]
