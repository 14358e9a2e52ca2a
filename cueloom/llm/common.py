"""Shared pieces: intermediate tables in the shared folder, size-checked joins, text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side up to which a join may be a broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a local one only in local tests."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-cueloom-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, bound: int | None = None) -> bool:
    """Whether the counted rows of a stored table stay within the bound of a broadcast."""
    return df.count() <= (BROADCAST_ROWS if bound is None else bound)


def small_side(df: DataFrame, bound: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows stay within the bound; else leave it to a shuffle join."""
    return F.broadcast(df) if is_small(df, bound) else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    whole = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(whole)


def split_words(text: Column, gap: str) -> Column:
    """Pieces of text between matches of the gap pattern; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def hex_number(text: Column, digits: int = 8) -> Column:
    """The first hex digits of an md5 as a long: a seeded, engine-independent draw."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores in front until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound what a Python worker is sent at once, where the session has Spark's default: texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB"):
        spark.conf.set(name, size)
