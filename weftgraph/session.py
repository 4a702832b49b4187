"""Helpers that every operator may use."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(sc) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may do without one."""
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or tempfile.mkdtemp(prefix="weft-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder (fixpoint loops would replan it all)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc))
    return df.checkpoint(eager=True)


def ratio(a, b):
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def unit_hash(seed, *columns):
    """A uniform number in [0, 1) that depends on the seed and the columns only, not on partitioning."""
    return F.pmod(F.xxhash64(seed if not isinstance(seed, int) else F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def folder(spark, name: str) -> str:
    """A new folder, below the cluster's shared one, for files that one query writes and reads again."""
    import uuid

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
