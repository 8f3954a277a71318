"""What the operators share: input tables, the shared folder, files on it and hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine (tests) a temporary
    folder is made and set as the checkpoint folder; a cluster must name one.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/sedimark-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_filesystem(uri: str):
    """(pyarrow file system, path) of a folder given as a URI or as a local path."""
    from pyarrow import fs

    if re.match(r"\w+:", uri):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def partitions_for(df_rows: int, per_partition: int, spark: SparkSession) -> int:
    """As many partitions as the rows need, and no fewer than a shuffle would use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df_rows // per_partition))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... (lengths[i] of them) one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, over the borders of batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        columns = [part.column(k).to_numpy() for k in keys]
        change = np.zeros(part.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        for begin, end in zip(borders, borders[1:], strict=False):
            key = tuple(c[begin] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(begin, end - begin))
            last = key
    if held:
        yield pa.concat_tables(held)
