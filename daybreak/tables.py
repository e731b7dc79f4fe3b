"""Tables between steps: written to the folder that every executor reaches, and read back."""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_counter = itertools.count()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir; a temporary one only where it is unset on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_daybreak_root", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="daybreak-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext._daybreak_root = root = f"file://{root}"
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{next(_counter)}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back, which cuts its lineage."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)  # what a writer or reader holds is bounded
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._daybreak_path = path
    return out


def remove(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(df._daybreak_path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
