"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import types

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Python functions travel to the executors by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["weftgraph"])

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``, with Arrow batches of about ``size`` bytes from here on: texts are long, and workers have little memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) > size:
        conf.set(key, f"{size}b")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the cluster; only a local master may do without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return df.checkpoint(eager=True)


def freed(df: DataFrame) -> DataFrame:
    """``df``, after the driver has collected its garbage: shuffle files of plans that are gone go now, not at some later time."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    module = sys.modules.setdefault("_weft_worker_cache", types.ModuleType("_weft_worker_cache"))
    return module.__dict__


def claim(owner: str) -> None:
    """Drop what other operators keep in this worker; Spark gives one worker to many operators."""
    cache = worker_cache()
    if cache.get("owner") != owner:
        for key in [k for k in cache if not (isinstance(k, str) and k.startswith("__"))]:
            del cache[key]
        cache["owner"] = owner
        gc.collect()
        give_back_memory()


def give_back_memory() -> None:
    """Return freed memory to the system now, and keep Arrow from pooling it.

    The thresholds are fixed, so that they do not grow with what is freed, and are above the
    size of a block's arrays: mapping each of those anew costs more time than the work on them.
    """
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_mod(doc_id: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def let(value, body):
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
