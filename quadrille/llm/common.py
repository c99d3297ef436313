"""Helpers that the operators share: tables, written intermediate results, remote files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator here.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. A session in one process may do without: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"quadrille-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/quadrille/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = path or new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys up to so many are broadcast to the rows they drop or choose (about 100 bytes each); more meet the rows by a shuffle.
MOST_BROADCAST_KEYS = 500_000


def checked(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast where its counted size allows it."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST_KEYS else keys


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_dir() named."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder's URI; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")
