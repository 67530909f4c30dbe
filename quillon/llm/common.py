"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handled in runs of about this many characters, so that the
#: temporary arrays of a Python worker stay small whatever the batch size.
BLOCK_CHARS = 1 << 18
#: The JVM's command that gives free native memory back to the system.
TRIM = "systemTrimNativeHeap"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a checkpoint in the shared folder.

    The folder is that of ``spark.checkpoint.dir``; only where a local session
    names none (tests, local runs) a temporary one is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Let go of what nothing refers to any more.

    Spark deletes shuffle files and checkpoints when the driver's JVM collects
    the objects they belong to, which a driver with little to do puts off until
    long after a phase is over; so it is asked to after each phase.  What the
    JVM's compiler and the many short threads of adaptive plans have freed
    stays with the C library's allocator, more with each phase and pass; where
    the JVM has a command for it (glibc, JDK 17.0.9 on) this goes back too.
    """
    gc.collect()
    context = spark.sparkContext
    jvm = context._jvm
    jvm.System.gc()
    what = context._gateway.new_array(jvm.Object, 4)  # bean, command, no arguments, no signature
    what[0], what[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), TRIM
    # the server's own class is not open to callers, its interface is
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    with suppress(Py4JJavaError):  # a JVM without the command keeps it
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), what)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(frames: Iterator[pd.DataFrame], text: str, limit: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows with about ``limit`` characters; null texts become empty."""
    for frame in frames:
        if not len(frame):
            continue
        frame = frame.copy()
        values = [x if isinstance(x, str) else "" for x in frame[text]]
        frame[text] = pd.Series(values, index=frame.index, dtype=object)
        ends = np.cumsum([len(x) for x in values]) // limit
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield frame.iloc[a:b].reset_index(drop=True)


def whole_keys(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of a sorted table recut so that no run of equal keys is split; each row is copied once."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        if held and keys[-1] == held[0][key].iat[-1]:
            held.append(frame)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        now = pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
        if len(now):
            yield now
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


#: Bits of a mask of hashes.
SLOTS = 1 << 26


def slot_mask(rows: DataFrame, column: str) -> np.ndarray:
    """Bits at the hashes of a column modulo SLOTS; what has no bit is not among them.  Of one size, whatever the number of rows."""
    slot = F.pmod(column, F.lit(SLOTS)) + 1
    rows = rows.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((SLOTS >> 15, 4096), np.uint8)
    for row in rows.collect():  # SLOTS / 32768 rows
        out[row["k"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def in_slots(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit value has its bit in the mask."""
    slot = values % SLOTS
    return (mask[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def first_rows(docs: DataFrame, own: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, all columns, whose id and text hash are in ``first``; one of those that are equal in both.

    ``own``: (id, hash) of all rows; ``first``: distinct (id, hash).  A mask of
    the rows that may go leaves most of the table as it is; only rows with its
    bit are joined.  The caller's columns stay in one struct, so that no name
    can clash.
    """
    key = F.xxhash64("id", "hash")
    counts = own.groupBy("id", "hash").agg(F.count("*").alias("n"))
    known = first.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"))
    both = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))
    doubtful = counts.join(known, both, "left").where("n > 1 or of_hash is null").select("id", "hash", "n", F.col("of_hash").isNotNull().alias("stays"))
    doubtful = reliable(doubtful)
    mask = share(docs.sparkSession, slot_mask(doubtful.select(key.alias("key")), "key"))

    @F.pandas_udf("boolean")
    def marked(keys: pd.Series) -> pd.Series:
        return pd.Series(in_slots(mask.value[1], keys.to_numpy(np.int64)))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text_hash = F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit("")))
    rows = rows.withColumn("marked", marked(F.xxhash64(F.col("row")[id_col], text_hash)))
    of = doubtful.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "n", "stays")
    joined = rows.where("marked").join(of, F.col("row")[id_col].eqNullSafe(F.col("of_id")) & (text_hash == F.col("of_hash")), "left")
    single = joined.where("of_hash is null or (stays and n = 1)").select("row")
    # equal rows are rare; only they are ranked
    again = joined.where("stays and n > 1").withColumn("rank", F.row_number().over(Window.partitionBy("of_id", "of_hash").orderBy("n"))).where("rank = 1").select("row")
    return rows.where("not marked").select("row").unionAll(single).unionAll(again).select(*[F.col("row")[c].alias(c) for c in docs.columns])


_BUILT: dict = {}


def share(spark: SparkSession, value):
    """Broadcast a value under a name of its own, for :func:`built`."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


def built(shared, make, *args):
    """What ``make(value, *args)`` gives for a shared value, made once in a Python worker.

    Workers outlive a job, so a newer value replaces what was built by the same
    maker from an older one.
    """
    name, value = shared.value
    key = (make.__qualname__, args)
    if key not in _BUILT or _BUILT[key][0] != name:
        _BUILT.pop(key, None)
        _BUILT[key] = (name, make(value, *args))
    return _BUILT[key][1]
