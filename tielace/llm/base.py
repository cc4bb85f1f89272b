"""What the operators share: tidy inputs, tables in the shared folder, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once (a longer text is a batch by itself).
BATCH_BYTES = 1 << 19
#: Bytes of an Arrow batch that Spark hands to a Python task.
ARROW_BYTES = 4 << 20

_own_dirs: dict[str, str] = {}
_roots: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    A cluster has to name one: a folder of this machine would be lost to its executors.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that operators of this session wrote; results that weren't written elsewhere are lost."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        delete(spark, root)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete(self.spark, kept.scratch_path)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's size of Arrow batches to ARROW_BYTES: texts are long, and two copies of a batch exist at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def tidy(df: DataFrame, needed: Iterable[str], added: Iterable[str] = ()) -> DataFrame:
    """The same rows under unambiguous names.

    The first column that matches a needed name (exactly, else in any case) gets it. Any other column whose
    name equals a needed, added or earlier one, in any case, is kept as name__in2, name__in3 and so on.
    """
    small_batches(df.sparkSession)
    needed = list(needed)
    own: dict[int, str] = {}
    for name in needed:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name}; there are {df.columns}")
        own[same[0]] = name
    taken = {n.lower() for n in [*needed, *added]}
    names = []
    for i, c in enumerate(df.columns):
        name, k = own.get(i, c), 1
        if i not in own:
            while name.lower() in taken:
                k += 1
                name = f"{c}__in{k}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def pick(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns alone."""
    return tidy(df, needed).select(*needed)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_batches(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about size bytes of text each; every row is whole."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if sizes.sum() <= size:
            yield batch
            continue
        part = (np.cumsum(sizes) - 1) // size
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, end - start)
    give_back()


def give_back() -> None:
    """Return to the system what a finished task has freed: a Python worker stays for later tasks, of other kinds too, and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others have their own ways
    if trim:
        trim(0)


def hashed_unit(*parts) -> F.Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts, joined by |; the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
