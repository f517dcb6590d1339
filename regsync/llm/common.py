"""Helpers that the text operators share: splits, Arrow access to raw UTF-8, hashing, shared folders."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bytes of text that one vectorised step handles at most, longer single texts apart.
STEP_BYTES = 1 << 20

U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches and sets a checkpoint folder if the cluster names none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="regsync-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


@contextmanager
def released(spark: SparkSession):
    """Spark deletes the shuffle files of what is planned and run here as soon as the action is done, not when the driver's memory happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_folder(spark: SparkSession, prefix: str) -> str:
    """A fresh folder inside the shared one, created through the file system Spark uses for it."""
    path = f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path


def local_path(folder: str) -> str:
    """The mounted path of a shared ``file:`` folder."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"the shared folder must be mounted on all machines (file:), not {folder}")
    return folder


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Writes ``name``.npy; the rename makes a repeated task harmless."""
    path = os.path.join(local_path(folder), f"{name}.npy")
    spare = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(spare, "wb") as f:
        np.save(f, array)
    os.replace(spare, path)


def open_array(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped (an empty one can't be)."""
    path = os.path.join(local_path(folder), f"{name}.npy")
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:
        return np.load(path)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes flat arrays to one file; the rename makes a repeated task harmless."""
    path, at, head = os.path.join(local_path(folder), name), 0, {}
    for k, x in arrays.items():
        head[k] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line = line.ljust(-(-(len(line) + 8) // 8) * 8 - 8)
    spare = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(spare, "wb") as f:
        f.write(len(line).to_bytes(8, "little") + line)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(bytes(-x.nbytes % 8))
    os.replace(spare, path)


def open_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of ``write_arrays``, memory-mapped."""
    whole = np.asarray(np.memmap(os.path.join(local_path(folder), name), np.uint8, "r"))
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    cut = lambda kind, n, at: whole[8 + size + at :][: n * np.dtype(kind).itemsize].view(kind)
    return {k: cut(*x) for k, x in head.items()}


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as 0."""
    code = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.coalesce(code, F.lit(0)) % modulus


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if column.type != pa.binary() else column.to_pylist()


def steps(texts: list[bytes | None], most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``most`` bytes together, with the first one's index; null is empty."""
    start, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and total + len(t) > most:
            yield start, held
            start, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield start, held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits (the finaliser of SplitMix64)."""
    x = np.array(x, dtype=U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_rng = np.random.default_rng(20240229)
#: Additive tabulation: one random number for each byte at each of 64 places of a word.
_TABLE = _rng.integers(1, 2**63, size=64 * 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts after A-Z are lower-cased, as 64-bit hashes.

    doc: index of each word's text, ascending; hash: its hash; length: its bytes; count: words by text.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        n = len(texts)
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))
        self.raw, self.ends = buf, ends
        if lower:
            buf = _LOWER[buf]
        self.low = buf
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, stop = edge[0::2], edge[1::2]
        self.length = stop - self.start
        m = len(self.start)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=n) if m else np.zeros(n, np.int64)
        if m:
            keep = np.flatnonzero(~space)
            place = np.arange(len(keep)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
            value = _TABLE[((place & 63) << 8) + buf[keep]]
            if int(self.length.max()) > 64:
                value = value * ((place >> 6).astype(U64) * U64(2) + U64(1))
            heads = np.cumsum(self.length) - self.length
            self.hash = mix(np.add.reduceat(value, heads) + self.length.astype(U64))
        else:
            self.hash = np.zeros(0, U64)


def map_arrow(df: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """``function`` over the record batches of the named columns only."""
    return df.select(*columns).mapInArrow(function, schema)


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
