"""What the operators of this subpackage share: worker paths, written tables, row keys and key bitmaps."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import distinct

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows hold whole texts: so many at most go to a Python worker at once.
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed on them, and get batches that fit their memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one
    process, as in tests. A cluster has to name one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="inkwell-")
        shared_dir.own = d
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/inkwell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, and the shuffle files of finished steps."""
    delete(*tables)
    released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the JVM has found that nothing refers to them: let it look now, not in half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(*tables: DataFrame) -> None:
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator reads, whatever other columns there are."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Bits of a key bitmap at most (8 MB). A fuller bitmap lets more rows through to the exact join that follows.
MAX_BITS = 1 << 26
BLOCK = 1 << 15


def mixed(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def key_bitmap(keys: DataFrame, n: int):
    """A broadcast bitmap of bounded size of the keys (one long column): a prefilter, an exact join has to follow."""
    bits = BLOCK
    while bits < min(MAX_BITS, 16 * max(n, 1)):
        bits *= 2
    col = keys.columns[0]

    def blocks(batches):
        for b in batches:
            at = distinct(mixed(np.asarray(b.column(0).drop_null())) & np.uint64(bits - 1)).astype(np.int64)
            blk = at // BLOCK
            cut = np.flatnonzero(np.r_[True, blk[1:] != blk[:-1], True][: len(blk) + 1]) if len(blk) else np.zeros(0, int)
            out = []
            for a, z in zip(cut[:-1], cut[1:]):
                one = np.zeros(BLOCK, bool)
                one[at[a:z] % BLOCK] = True
                out.append(np.packbits(one).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blk[cut[:-1]] if len(cut) else [], pa.int32()), pa.array(out, pa.binary())], ["block", "bits"])

    def merge(pdf):
        import pandas as pd

        m = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf["bits"]]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [m.tobytes()]})

    parts = keys.select(col).mapInArrow(blocks, "block int, bits binary")
    rows = parts.groupBy("block").applyInPandas(merge, "block int, bits binary").collect()
    whole = np.zeros(bits, bool)
    for r in rows:
        whole[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return keys.sparkSession.sparkContext.broadcast(np.packbits(whole))


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mixed(keys) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
