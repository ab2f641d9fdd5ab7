"""Helpers shared by the operators: table access, executor setup, lineage."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import dictgraph
from dictgraph.session import ensure_checkpoint_dir

# Text that one Arrow batch takes to a Python worker, whatever the rows' sizes.
BATCH_BYTES = 2 << 20
_DEFAULT_BATCH = str(64 << 20)  # Spark's own limit; another one is left as it is

_shipped: set = set()
_held: dict = {}


def held(key, make):
    """The object of ``key`` in this worker process. Spark reuses workers for
    other operators, so only the last object asked for is kept."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop the held object, in functions that hold none, and give freed memory
    back to the system: a reused worker would keep it for the next operator."""
    _held.clear()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def at_end(batches):
    """``batches``; after the last of a task, freed memory goes back."""
    yield from batches
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that
    functions run in tasks can import it wherever the executors are; bound the
    batches that go to Python workers by bytes."""
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) in (_DEFAULT_BATCH, _DEFAULT_BATCH + "b"):
        spark.conf.set(size, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(dictgraph.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="dictgraph-"), "dictgraph_pkg.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def ship_file(spark: SparkSession, kind: str, data: bytes) -> str:
    """Name under which Spark hands ``data`` as a file to every executor. The
    name is of the content, so equal files are sent and kept once."""
    sc = spark.sparkContext
    name = f"{kind}-{sha256(data).hexdigest()[:32]}.bin"
    if (sc.applicationId, name) not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="dictgraph-"), name)
        with open(path, "wb") as f:
            f.write(data)
        sc.addFile(path)
        _shipped.add((sc.applicationId, name))
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def most_frequent(counts: DataFrame, size: int, key: str, n: str = "n") -> DataFrame:
    """The ``size`` rows of the largest ``n`` (ties: the least ``key``). A
    histogram of the counts' logarithms finds a count that only a few more rows
    than ``size`` reach; the rest is dropped before anything is ranked, so that
    what a ranking sends does not grow with the number of partitions."""
    step = F.floor(F.log2(F.col(n)) * 8)
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()
    least, seen = 0, 0
    for r in histogram:  # a few hundred rows at most
        least, seen = r.step, seen + r.rows
        if seen >= size:
            break
    return counts.where(step >= least).orderBy(F.desc(n), key).limit(size)


def place_of(df: DataFrame, name: str) -> int:
    """Place of a column, by its exact name or else whatever its capitals, as
    Spark resolves it."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def texts_of(column) -> list[str]:
    """Arrow string column to a list; a null text counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]
