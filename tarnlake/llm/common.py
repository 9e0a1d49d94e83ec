"""What the operators share: tables in the shared folder, Arrow batch limits, vectorised words.

Row identity. ``doc_id`` may be null or repeated, so no operator regroups rows by it alone:
results are computed inside the row, or joined back on a key of everything that decides them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored  # noqa: F401  for the operators

#: Bytes and rows of one Arrow batch handed to a Python worker; a single longer text still comes whole.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of Parquet up to which a stored table is broadcast.
SMALL = 4 << 20


def small(df: DataFrame, most: int = SMALL) -> bool:
    """Whether a stored table may be broadcast, by the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: A key of more than this share of all rows is hot: there are fewer than HOT of them.
HOT = 1000


def hot_joined(rows: DataFrame, named: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``named``, which has one row a key and, in column ``n``, how many of ``rows`` hold it.

    Keys that hold over one ``HOT``-th of all rows, fewer than ``HOT`` by arithmetic, are broadcast; the others
    are joined by a shuffle in which no key is heavy. ``rows`` is read twice, so it should be a stored, thin table.
    """
    total = named.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    loud, quiet = F.broadcast(named.where(hot).drop(n)), named.where(~hot).drop(n)
    rest = rows.join(F.broadcast(named.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(loud, keys).unionByName(rest.join(quiet, keys))


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a size that a Python worker can take next to its own state."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(most))
        if not now.isdigit() or not 0 < int(now) <= most:
            now = str(most)
        spark.conf.set(key, now)


# Vectorised words over a whole Arrow batch.

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that is delimited by white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word of letters and digits: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the batch, and where each text starts (one more entry: the end). Null: empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the first word of each text (one more entry: their number)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch; equal hashes are verified by the caller."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : len(words) - n + 1 + k]
    return mixed(out)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
