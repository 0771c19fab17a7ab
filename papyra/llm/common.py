"""What several operators share: bounded slices of Arrow batches, tables, checkpoints and stable buckets."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.sizes import spread

#: Bytes of text that a Python worker unpacks at once (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path is only ever given to Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``, spread over all cores if it is only a few files."""
    return spread(table(spark, sf_dir, "documents"))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has more than ``max_bytes`` of text, unless a single text has."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


#: What operators remember in a worker process between their tasks.
_remembered: list[dict] = []


def remembered() -> dict:
    """A store that an operator's tasks keep in a worker process; :func:`lean` tasks of others empty it."""
    _remembered.append(store := {})
    return store


def forget() -> None:
    """Empty this process's stores of what operators remember."""
    if any(_remembered):
        for store in _remembered:
            store.clear()
        gc.collect()


def give_back() -> None:
    """Free memory that allocators hold goes back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for ``mapInArrow``, so that a worker process, which Spark uses for one stage after another, doesn't add up what they held.

    What tasks of another operator remember there goes first, and freed memory is given back before and after.
    """

    @wraps(run)
    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # by name, as the function travels to the workers without this module's variables
        give_back()
        yield from run(batches)
        give_back()

    return leanly


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; remainder 1 is held out.  A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, never through executors' own disks."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage now: Spark then removes shuffles, broadcasts and checkpoints that nothing names any longer.

    Between the rounds of an iteration, whose leavings would otherwise stay on executors until the driver's heap is full.
    """
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share; where none is named, a temporary one, but only if there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="papyra-")
