"""What the training-data operators share: shared scratch tables, exact ranks, joins that hold at every size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a new one, but only on a single machine (as in tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lexepoch-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


#: Arrow batches hold whole texts, so a task's memory hangs on their size: so many rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it (a path all machines share, or ``--py-files``),
    and bound the batches that they are sent."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def lean(run):
    """A task that gives what it has freed back to the system when it ends: Python workers live on between stages."""
    def task(batches):
        import ctypes
        import gc

        import pyarrow as pa
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
    return task


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexepoch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: A key met by over 1/HOT_SHARE of the rows (and by HOT_LEAST rows) is hot: there are at most HOT_SHARE such keys.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def hot_join(left: DataFrame, right: DataFrame, on: str, n: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and whose column n counts the left rows that meet each key.

    ``rows`` is the number of left rows. Hot keys, at most HOT_SHARE at any size, are sent to every task, so their left
    rows stay where they are; no key of the shuffled rest has more than 1/HOT_SHARE of the rows (or HOT_LEAST). With
    how="left" left rows without a partner stay, too. Null keys meet nothing.
    """
    if rows <= HOT_LEAST:
        return left.join(right.hint("merge"), on, how)
    bound = max(HOT_LEAST, rows // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(n) > bound))
    # The merge hint keeps the rest shuffled at every size: its right side grows with the input.
    rest = left.join(hot.select(on), on, "left_anti").join(right.where(F.col(n) <= bound).hint("merge"), on, how)
    return left.join(hot, on).unionByName(rest)


#: Words of 64 bits in a sieve: its broadcast has so many rows at most, whatever the size of the input.
SIEVE_BITS = 20


def _sieve_place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 64 - SIEVE_BITS).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """(word, bits): a bit set of the hashes of all keys, 2**SIEVE_BITS words at most."""
    word, bit = _sieve_place(F.col(column))
    return materialize(keys.select(word.alias("_lx_word"), bit.alias("_lx_bits")).groupBy("_lx_word").agg(F.bit_or("_lx_bits").alias("_lx_bits")))


def sifted(df: DataFrame, key: Column, through: DataFrame, flag: str = "_lx_maybe") -> DataFrame:
    """df with a column that is false where key is surely none of the keys of the sieve ``through``.

    Rows that a later join cannot meet are told apart where they lie, so that whole texts need not be shuffled for
    it. As the keys outgrow the sieve more rows read true without need; what is joined afterwards stays exact.
    """
    word, bit = _sieve_place(key)
    marked = df.withColumn("_lx_at", word).withColumn("_lx_bit", bit)
    joined = marked.join(F.broadcast(through), marked["_lx_at"] == F.col("_lx_word"), "left")
    return joined.withColumn(flag, F.coalesce(F.col("_lx_bits").bitwiseAND(F.col("_lx_bit")) != 0, F.lit(False))).drop("_lx_at", "_lx_bit", "_lx_word", "_lx_bits")


def rank_within(df: DataFrame, keys: list[str], order: list[str], rank: str, buckets: int) -> DataFrame:
    """Exact rank from 0 of each row within its keys, in any fixed order, without one task per hot key.

    Rows are dealt into ``buckets`` by a hash of ``order``; ranks are taken within (keys, bucket) and moved up by
    the number of rows in the lower buckets of the same keys. ``df`` must give the same rows each time it is read.
    """
    b, n, off, rn = "_lx_bucket", "_lx_n", "_lx_off", "_lx_rn"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    below = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, b, F.coalesce(F.sum(n).over(below), F.lit(0)).alias(off))
    own = dealt.withColumn(rn, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1)
    joined = own.join(offsets, [*keys, b])
    return joined.withColumn(rank, (F.col(rn) + F.col(off)).cast("long")).drop(b, n, off, rn)
