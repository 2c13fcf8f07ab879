"""What the operators share: the shared folder, written intermediates, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() takes it: \x20 and \x09-\x0D.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only a local session may go without that setting; it then has a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@functools.lru_cache(None)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    ``forget`` deletes it again, once nothing reads it any more.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    store, path = _path(spark, path)
    return store.exists(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this program wrote."""
    store, path = _path(spark, path)
    store.delete(path, True)


def forget(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; no frame that reads them may be used afterwards."""
    for df in written:
        remove(df.sparkSession, df._written)


def size_estimate(df: DataFrame) -> int:
    """Spark's own estimate of the bytes of ``df``, from the files it reads; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


#: Rows of one long column that are broadcast (16 MB of values); more are joined by sort-merge, which keeps no side in memory.
BROADCAST_ROWS = 2_000_000


def narrow(keys: DataFrame) -> DataFrame:
    """A written list of keys, marked for a semi or anti join of whole rows: broadcast where its counted size allows it."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(keys) if few else keys.hint("merge")


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """np.unique(values) by one plain sort."""
    values = np.sort(values)
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if not len(a) or not len(b):
        return 0
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def byte_strings(column: pa.Array) -> list[bytes]:
    """to_pylist() of a binary column without nulls, much faster."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    whole = column.buffers()[2].to_pybytes() if column.buffers()[2] else b""
    return [whole[a:b] for a, b in zip(offsets, offsets[1:])]


_LOWER = bytes(range(256)).lower()
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


#: Bytes of a word from which on it is hashed alone.
_LONG_WORD = 512
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts as ``(t or b"").lower().split()`` gives them, by vector code.

    (64-bit hash of each word, its last byte, the words up to each text's end, the words up to each line's end).
    """
    texts = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(texts) else b""
    data, offsets = np.frombuffer(bytes(whole).translate(_LOWER), np.uint8), offsets - offsets[0]
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = ~blank[inner]
    starts = np.flatnonzero(first)
    line_ends = np.searchsorted(starts, np.sort(np.append(np.flatnonzero(data == 10), offsets[1:])))
    line_ends = line_ends[np.diff(line_ends, prepend=0) > 0]
    kept = np.append(data[~blank], np.zeros(8, np.uint8))
    bounds = np.append(starts - np.cumsum(blank, dtype=np.int32)[starts], len(kept) - 8) if len(starts) else np.zeros(1, np.int64)
    return _hashed(kept, bounds), kept[bounds[1:] - 1], np.searchsorted(starts, offsets[1:]), line_ends


def _hashed(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each word ``data[bounds[i]:bounds[i + 1]]``, eight bytes at a time (``data`` ends with eight spare ones)."""
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at, left = bounds[:-1], np.diff(bounds)
    out = mix((lanes[at] & _MASKS[np.minimum(left, 8)]) * M1 + left.astype(np.uint64) * M2)
    long = np.flatnonzero(left > _LONG_WORD)
    left = left.copy()
    left[long] = 0
    rest, step = np.flatnonzero(left > 8), 8
    while len(rest):
        more = left[rest] - step
        out[rest] = mix(out[rest] * M3 + (lanes[at[rest] + step] & _MASKS[np.minimum(more, 8)]))
        rest, step = rest[more > 8], step + 8
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[bounds[i] : bounds[i + 1]].tobytes(), digest_size=8).digest(), "little")
    return out


def released(batches):
    """The batches of a task; at its end the worker gives freed memory back, as several wait for the next task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(sizes, most: int):
    """Index ranges whose sizes add up to about ``most`` (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
