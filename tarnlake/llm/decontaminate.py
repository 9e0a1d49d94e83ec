"""Operator 4: benchmark decontamination with a broadcast set of normalised test n-grams.

Texts and items are lower-cased (A-Z) and cut into words of letters and digits. An item's windows are its
runs of ``n`` words; an item of fewer words is one window. A benchmark of ``BROADCAST_BYTES`` at most is broadcast
whole: its windows' hashes, and the words on which a hash that hits is verified.

A larger one is never gathered. A bit for each window's hash goes to every task, in a filter of ``FILTER_BITS``
whatever the benchmark's size; the windows of the texts that the filter lets through meet the benchmark's in a
shuffle join on the words themselves. A fuller filter lets more through and loses nothing.

Nulls: a null text or item has no words; the windows of an item without an id hit words, but no id is
listed. Empty text: no words, no hit. Empty benchmark: nothing is hit. Repeated items are one item by id;
repeated documents are judged each. Columns of the documents are carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, flat, mixed, runs, small, small_batches, stored, table, window_hashes, word_hashes, word_spans

WINDOW = 10
#: Bytes of item texts up to which they are broadcast. The index takes some 40 times as much while it is built.
BROADCAST_BYTES = 4 << 20
#: Bits of the filter that a larger benchmark's windows are told by: 16 MB.
FILTER_BITS = 1 << 27

_RESULT = "struct<n_words: bigint, hit_words: array<int>, hit_from: array<int>, hit_to: array<int>, items: array<string>>"


class Index:
    """The windows of the items: for each length a sorted array of hashes, and the items of each window's words."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        data, offsets = flat(pa.array([x[1] for x in items], pa.string()))
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        hashes = word_hashes(data, starts, ends)
        self.found: dict[tuple, set] = {}
        by_length: dict[int, list] = {}
        for k, (ident, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            size = min(n, b - a)
            if not size:
                continue
            by_length.setdefault(size, []).append(window_hashes(hashes[a:b], size))
            for j in range(a, b - size + 1):
                self.found.setdefault(tuple(words[j : j + size]), set()).add(ident)
        self.hashes = {size: np.unique(np.concatenate(x)) for size, x in by_length.items()}
        # A bit for the first 20 bits of each hash: most windows are turned away by one look.
        self.maybe = {}
        for size, x in self.hashes.items():
            self.maybe[size] = np.zeros(1 << 20, bool)
            self.maybe[size][x >> np.uint64(44)] = True

    def scan(self, texts: pa.Array) -> list[dict]:
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        found: list[list] = [[] for _ in range(len(texts))]
        items: list[set] = [set() for _ in range(len(texts))]
        raw = data.tobytes()
        for size, known in self.hashes.items():
            h = window_hashes(hashes, size)
            at = np.flatnonzero(self.maybe[size][h >> np.uint64(44)])
            at = at[owner[at] == owner[at + size - 1]]
            place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            for j in at[known[place] == h[at]].tolist():
                ids = self.found.get(tuple(raw[a:b] for a, b in zip(starts[j : j + size].tolist(), ends[j : j + size].tolist())))
                if ids is not None:
                    found[owner[j]].append((j - int(first[owner[j]]), size))
                    items[owner[j]] |= ids
        return _placed(data, offsets, starts, ends, first, found, items)


def _placed(data, offsets, starts, ends, first, found: list, items: list) -> list[dict]:
    """For each text of a batch its hit words as runs, in words and in characters; ``found``: first word and length of each window."""
    out = []
    for k, windows in enumerate(found):
        a, b = int(first[k]), int(first[k + 1])
        row = {"n_words": b - a, "hit_words": [], "hit_from": [], "hit_to": [], "items": sorted(x for x in items[k] if x is not None)}
        if windows:
            step = np.zeros(b - a + 1, np.int32)
            at, size = np.array(windows).T
            np.add.at(step, at, 1)
            np.add.at(step, at + size, -1)
            from_, to = runs(np.cumsum(step[:-1]) > 0)
            # character positions: bytes that do not continue a character
            lead = np.concatenate(([0], np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)))
            row["hit_words"] = np.stack((from_, to - from_), 1).ravel().tolist()
            row["hit_from"] = lead[starts[a + from_] - offsets[k]].tolist()
            row["hit_to"] = lead[ends[a + to - 1] - offsets[k]].tolist()
        out.append(row)
    return out


_KIND = pa.struct(
    [("n_words", pa.int64()), *((x, pa.list_(pa.int32())) for x in ("hit_words", "hit_from", "hit_to")), ("items", pa.list_(pa.string()))]
)


def _broadcast_hits(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.text) for r in items.toLocalIterator()], n))

    @F.arrow_udf(_RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array(index.value.scan(texts), _KIND)

    return docs.select(F.struct("*").alias("row"), scan(F.col(text_col)).alias("hit"))


def _windows(n: int, sizes=None, bits=None):
    """``name, at, size, gram, place`` of each window of a batch's texts; of ``sizes`` and by the filter, if given."""

    def run(batches):
        for batch in batches:
            names, one = np.unique(
                np.array(batch.column(0).to_pylist(), object).astype(str),
                return_index=True,
            ) if bits is not None else (None, np.arange(batch.num_rows))
            batch = batch.take(pa.array(np.sort(one)))  # copies of a text count once
            data, offsets = flat(batch.column(1))
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, ALNUM)
            words, count = word_hashes(data, starts, ends), np.diff(first)
            owner = np.repeat(np.arange(batch.num_rows), count)
            raw = data.tobytes()
            for size in sizes if sizes is not None else np.unique(np.minimum(n, count[count > 0])).tolist():
                h = window_hashes(words, size)
                if not len(h):
                    continue
                keep = owner[: len(h)] == owner[size - 1 :]
                if sizes is None:  # an item's windows are all of one length
                    keep &= np.minimum(n, count[owner[: len(h)]]) == size
                place = (mixed(h + np.uint64(size)) % np.uint64(FILTER_BITS)).astype(np.int64)
                if bits is not None:
                    keep &= (bits.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(keep)
                grams = [
                    b" ".join(raw[a:b] for a, b in zip(starts[j : j + size].tolist(), ends[j : j + size].tolist())).decode() for j in at.tolist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner[at])),
                        pa.array((at - first[owner[at]]).astype(np.int32)),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(grams, pa.string()),
                        pa.array(place[at]),
                    ],
                    names=["name", "at", "size", "gram", "place"],
                )

    return run


_WINDOW_DDL = "name string, at int, size int, gram string, place long"


def _joined_hits(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    known = stored(items.mapInArrow(_windows(n), _WINDOW_DDL).select(F.col("name").alias("item"), "size", "gram", "place").distinct(), "windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # n of them at most
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bucket = known.groupBy((F.col("place") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    for r in bucket.toLocalIterator():
        bits[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    bits = spark.sparkContext.broadcast(bits)
    digest, text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.col(text_col)
    found = docs.select(digest, text).mapInArrow(_windows(n, sizes, bits), _WINDOW_DDL).select(F.col("name").alias("digest"), "at", "size", "gram")
    found = found.join(known.drop("place"), ["size", "gram"])
    found = stored(found.groupBy("digest").agg(F.collect_set(F.struct("at", "size")).alias("windows"), F.collect_set("item").alias("items")), "hits")

    @F.arrow_udf(_RESULT)
    def place(texts: pa.Array, windows: pa.Array, items: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        at = [[(x["at"], x["size"]) for x in w or ()] for w in windows.to_pylist()]
        return pa.array(_placed(data, offsets, starts, ends, first, at, [x or () for x in items.to_pylist()]), _KIND)

    rows = docs.select(F.struct("*").alias("row"), digest).join(F.broadcast(found) if small(found) else found, "digest", "left")
    return rows.select("row", place(F.col(f"row.`{text_col}`"), "windows", "items").alias("hit"))


def scanned(
    docs: DataFrame,
    items: DataFrame,
    n: int = WINDOW,
    text_col="text",
    id_col="item_id",
    item_col="text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``row`` (a document's columns) and ``hit``: its words, the hit ones (start, length), where they stand in characters, and the items."""
    small_batches(docs.sparkSession)
    items = items.select(F.col(id_col).cast("string").alias("item"), F.col(item_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return (_broadcast_hits if size <= broadcast_bytes else _joined_hits)(docs, items, n, text_col)


def decontaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, remove: str = "documents", text_col="text", **names) -> DataFrame:
    """The documents without those that hold a window (``remove='documents'``), or without the hit words (``'spans'``)."""
    found = scanned(docs, items, n, text_col, **names)
    if remove == "documents":
        return found.where(F.size("hit.hit_words") == 0).select("row.*")
    text = F.col(f"row.`{text_col}`")
    ends = F.concat(F.array(F.lit(0)), F.col("hit.hit_to"))
    starts = F.concat(F.col("hit.hit_from"), F.array(F.length(text)))
    kept = F.concat_ws("", F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substr(text, x["a"] + 1, x["b"] - x["a"])))
    kept = F.when(F.size("hit.hit_words") == 0, text).otherwise(kept)
    return found.select(*((kept if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op4_decontamination(spark, sf_dir):
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("hit.hit_words", lambda x, k: F.when(k % 2 == 1, x).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "row.doc_id",
        F.col("hit.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit.items"), 256).alias("items_sha256"),
        (F.size("hit.hit_words") > 0).alias("contaminated"),
    )


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM sized)),
grams AS (SELECT k, j, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g
          FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
found AS (SELECT k, j, g.n, item_id FROM grams g JOIN windows USING (n, g)),
words AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(j, j + n)) AS x FROM found) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM
    found WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (k) LEFT JOIN named USING (k)
"""
