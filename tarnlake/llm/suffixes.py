"""Operator 7: removal of repeated 200-byte strings, by external induced sorting of shards.

The corpus is dealt into shards such that equal strings always meet. Of each 200-byte window the 32-byte
string with the least hash is its anchor (the leftmost of equals): equal windows have equal anchors, and
the windows of one anchor are a stretch of text, the piece. Pieces go by their anchor's hash. A piece whose
anchor is nowhere else repeats nothing; pieces alike in every byte are sorted once and repeat in full (and
are not sorted where their anchor has no other piece). The
distinct pieces of each shared anchor are the shard's text: its suffixes are sorted by external induced
sorting with common prefixes (``induced``), and a window with a common prefix of 200 or more with a
neighbour is repeated. A shard holds whole anchors; its queues go to disk when they outgrow memory.

An anchor whose distinct pieces exceed ``HEAVY`` bytes (a passage that very many texts hold, each followed by
other words) can't be one task's shard. The windows of its pieces are dealt by a 128-bit hash of their bytes
instead and counted by an aggregate; so no task ever holds more than a shard and an anchor of ``HEAVY`` bytes.

Texts are known by two 64-bit hashes of their digest, so copies of a text are judged once; rows are never collected.

Nulls: a null text is empty. Texts shorter than 200 bytes lose nothing. Repeated rows are copies of each
other, and both lose all their windows. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, hot_joined, mixed, small, small_batches, stored, table
from .common import _powers as powers
from .induced import repeated

LENGTH, GRAM = 200, 32
#: Bytes of pieces that are sorted together; an anchor's pieces are never parted.
SHARD = 2 << 20
#: Bytes of one anchor's distinct pieces up to which it is sorted in a shard.
HEAVY = 8 << 20
_KEY = ["k1", "k2"]


def _rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each position."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return (total[n:] - total[:-n]) * down[: len(data) - n + 1]


def _span_hash(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * up[: len(data)], out=total[1:])
    return mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: anchor hash, piece hash, and first and last window start of each anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    hashes = mixed(_rolling(data, gram))
    wide = length - gram + 1  # anchors of a window
    # The least of each run of `wide`, with its place: by halves of a doubling, the left one first.
    place = np.arange(len(hashes), dtype=np.int64)
    least, have = hashes, 1
    while have < wide:
        step = min(have, wide - have)
        a, b = least[: len(least) - step], least[step:]
        left = a <= b
        least = np.where(left, a, b)
        place = np.where(left, place[: len(place) - step], place[step:])
        have += step
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [len(place)])) - 1
    return hashes[place[first]], _span_hash(data, first, last + length), first, last


def _occurrences(batches):
    """The occurrences of pieces. Within a batch a piece's first occurrence stands for the others.

    What repeats within a batch is known to: such windows leave as ``local`` runs that no other row has to
    judge, dealt by a mix of text and place. So a string that fills a third of the corpus comes to the task of
    its anchor about once a batch.
    """
    none = np.zeros(0, np.int64)
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        k1, k2 = (batch.column(c).to_numpy() for c in _KEY)
        names = list(zip(k1.tolist(), k2.tolist()))
        copies, parts = Counter(names), [[none.astype(np.uint64)], [none.astype(np.uint64)], [none], [none], [none], [none]]
        for k, (name, a, b) in enumerate(zip(names, offsets[:-1].tolist(), offsets[1:].tolist())):
            if n := copies.pop(name, 0):
                found = pieces(data[a:b])
                for x, y in zip(parts, (*found, np.full(len(found[0]), k), np.full(len(found[0]), n))):
                    x.append(y)
        anchor, piece, first, last, row, n = (np.concatenate(x) for x in parts)
        order = np.lexsort((piece, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(piece[order]) != 0)
        group = np.cumsum(new) - 1
        copied = n > 1
        copied[order] |= np.bincount(group, minlength=1)[group] > 1
        one = np.sort(order[new])
        starts = copied.copy()
        starts[1:] &= ~copied[:-1] | (row[1:] != row[:-1])
        ends = copied.copy()
        ends[:-1] &= ~copied[1:] | (row[1:] != row[:-1])
        deal = mixed(k1[row[starts]].view(np.uint64) + first[starts].astype(np.uint64))
        both = np.concatenate((row[one], row[starts]))
        columns = [
            np.concatenate((anchor[one], deal)).view(np.int64),
            np.concatenate((piece[one].view(np.int64), first[starts])),
            k1[both],
            k2[both],
            np.concatenate((first[one], first[starts])),
            np.concatenate((last[one], last[ends])),
        ]
        arrays = [pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.int32()] * 2)]
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.array(np.arange(len(both)) >= len(one))],
            names=["anchor", "piece", "k1", "k2", "first", "last", "local"],
        )


def _shared(batches):
    """Sorted by anchor and piece: what repeats in full, and one occurrence of each distinct piece of a shared anchor.

    ``wanted`` is false for an occurrence of a piece that stands elsewhere, true for one to be sorted.
    """
    names = ["anchor", "k1", "k2", "first", "last", "wanted"]
    held = None  # the last row so far, of which it isn't known yet whether the next is like it
    before = None  # anchor and piece of the row before that, and whether that piece is its anchor's first
    for batch in batches:
        local = batch.column("local")
        if runs := pc.sum(local).as_py():
            done = batch.filter(local)
            yield pa.RecordBatch.from_arrays([*(done.column(x) for x in names[:5]), pa.array(np.zeros(runs, bool))], names=names)
        batch = batch.filter(pc.invert(local))
        if not batch.num_rows:
            continue
        cols = {x: batch.column(x).to_numpy() for x in ("anchor", "piece", "k1", "k2", "first", "last")}
        if held is not None:
            cols = {x: np.concatenate((held[x], v)) for x, v in cols.items()}
        before = yield from _judged(cols, before, None, names)
        held = {x: v[-1:] for x, v in cols.items()}
    if held is not None:
        yield from _judged({x: np.append(v, v) for x, v in held.items()}, before, "end", names)


def _judged(cols, before, end, names):
    """All rows but the last, each by its neighbours; returns the new ``before``."""
    anchor, piece = cols["anchor"], cols["piece"]
    n = len(anchor) - 1
    if n < 1:
        return before
    next_anchor = (anchor[1:] == anchor[:-1]) & (end is None)
    next_piece = next_anchor & (piece[1:] == piece[:-1])
    last_anchor, last_piece = np.zeros(n, bool), np.zeros(n, bool)
    last_anchor[1:], last_piece[1:] = next_anchor[:-1], next_piece[:-1]
    if before is not None:
        last_anchor[0] = anchor[0] == before[0]
        last_piece[0] = last_anchor[0] and piece[0] == before[1]
    copied = next_piece | last_piece
    # Whether a row's piece is the first of its anchor, told where the piece begins.
    begin = np.maximum.accumulate(np.where(last_piece, -1, np.arange(n)))
    leads = np.where(begin >= 0, ~last_anchor[np.maximum(begin, 0)], before is not None and before[2])
    # The last of a piece stands for it, unless its anchor has no other piece.
    stands = ~next_piece & ~(leads & ~next_anchor)
    for flags, wanted in ((copied, False), (stands, True)):
        at = np.flatnonzero(flags)
        if len(at):
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[x][at]) for x in names[:5]), pa.array(np.full(len(at), wanted))], names=names)
    return anchor[n - 1], piece[n - 1], bool(leads[n - 1])


def _cut_out(batches):
    """The wanted pieces of each text, a batch of bounded bytes at a time."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows, size = [], 0
        for k1, k2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "wanted"))):
            data = text.encode()
            for x in wanted:
                rows.append((x["anchor"], k1, k2, x["first"], data[x["first"] : x["last"] + LENGTH]))
                size += len(rows[-1][-1])
                if size > SHARD:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                        names=["anchor", "k1", "k2", "first", "bytes"],
                    )
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["anchor", "k1", "k2", "first", "bytes"])


_MARK = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _sorted(batches):
    """Sorted by anchor: shards of whole anchors, each sorted; the repeated windows as runs."""

    def marks(shard):
        parts, starts, at = [], [], 0
        for *_, data in shard:
            starts.append(at)
            parts += [np.frombuffer(data, np.uint8) + np.uint8(1), np.zeros(1, np.uint8)]  # no byte of UTF-8 is over 0xF4
            at += len(data) + 1
        found = repeated(np.concatenate(parts), LENGTH)
        rows = []
        for (k1, k2, begin, data), a in zip(shard, starts):
            x, y = _edges(found[a : a + len(data) - LENGTH + 1])
            rows.append((np.full(len(x), k1), np.full(len(x), k2), x + begin, y - 1 + begin))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows), _MARK.types)], schema=_MARK)

    shard, size, now = [], 0, None
    for batch in batches:
        for anchor, *piece in zip(*(batch.column(x).to_pylist() for x in ("anchor", "k1", "k2", "first", "bytes"))):
            if anchor != now and size > SHARD:
                yield marks(shard)
                shard, size = [], 0
            now = anchor
            shard.append(piece)
            size += len(piece[-1])
    if shard:
        yield marks(shard)


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _windows(batches):
    """Of heavy anchors' pieces each window, as two hashes of its bytes; an equal one within a batch is counted with the first."""
    up = _OTHER
    for batch in batches:
        found = []
        for k, data in enumerate(batch.column("bytes").to_pylist()):
            data = np.frombuffer(data, np.uint8)
            n = len(data) - LENGTH + 1
            h = mixed(_rolling(data, LENGTH))
            g = mixed(_rolling(data ^ up, LENGTH) + np.uint64(LENGTH))
            found.append((h.view(np.int64), g.view(np.int64), np.full(n, k), np.arange(n)))
        if found:
            h, g, row, at = (np.concatenate(x) for x in zip(*found))
            pos = batch.column("first").to_numpy()[row] + at
            arrays = [h, g, batch.column("k1").to_numpy()[row], batch.column("k2").to_numpy()[row], pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["h", "g", "k1", "k2", "at"])


_OTHER = np.uint8(0x5A)


def _keys(text: Column) -> list[Column]:
    """Two hashes of the text's digest: together they name a text."""
    digest = F.md5(text.cast("binary"))
    return [F.xxhash64(F.lit(1), digest).alias("k1"), F.xxhash64(F.lit(2), digest).alias("k2")]


def removed(docs: DataFrame, text_col="text", heavy: int = HEAVY) -> DataFrame:
    """``k1, k2, text, spans`` (first and end byte of each maximal removed run) of each distinct text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*_keys(text), text.alias("text"))
    found = keyed.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _occurrences,
        "anchor long, piece long, k1 long, k2 long, first int, last int, local boolean",
    )
    found = found.repartition("anchor").sortWithinPartitions("anchor", "piece")
    shared = stored(found.mapInArrow(_shared, "anchor long, k1 long, k2 long, first int, last int, wanted boolean"), "shared")
    # anchors of more than HEAVY bytes: fewer than one for every HEAVY bytes of the corpus
    size = F.col("last") - F.col("first") + LENGTH
    bulky = stored(
        shared.where("wanted").groupBy("anchor").agg(F.sum(size.cast("long")).alias("size")).where(F.col("size") > heavy).select("anchor", F.lit(True).alias("heavy")),
        "heavy",
    )
    wanted = shared.where("wanted").join(F.broadcast(bulky) if small(bulky) else bulky, "anchor", "left")
    wanted = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "first", "last", "heavy")).alias("every"))
    parts = [F.filter("every", lambda x: x["heavy"].isNull()).alias("wanted"), F.filter("every", lambda x: x["heavy"].isNotNull()).alias("heavy")]
    texts = keyed.groupBy(*_KEY).agg(F.first("text").alias("text"))
    wanted = texts.join(wanted, _KEY).select(*_KEY, "text", *parts)
    cut = wanted.where(F.size("wanted") > 0).mapInArrow(_cut_out, _PIECE_DDL)
    marks = shared.where("not wanted").select("k1", "k2", "first", "last")
    marks = marks.unionAll(cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted, "k1 long, k2 long, first int, last int"))
    if bulky.limit(1).count():
        cut = wanted.where(F.size("heavy") > 0).select(*_KEY, "text", F.col("heavy").alias("wanted")).mapInArrow(_cut_out, _PIECE_DDL)
        windows = stored(cut.mapInArrow(_windows, "h long, g long, k1 long, k2 long, at int"), "windows")
        twice = windows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
        marks = marks.unionAll(
            hot_joined(windows, stored(twice, "repeated-windows"), ["h", "g"]).select(
                "k1",
                "k2",
                F.col("at").alias("first"),
                F.col("at").alias("last"),
            )
        )
    spans = marks.distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("marks"))
    return texts.join(spans, _KEY, "left").select(*_KEY, "text", F.arrow_udf(_runs, "array<struct<first: int, end: int>>")("marks").alias("spans"))


_PIECE_DDL = "anchor long, k1 long, k2 long, first int, bytes binary"


def _runs(marks: pa.Array) -> pa.Array:
    """Window starts to maximal runs of bytes."""
    out = []
    for row in marks.to_pylist():
        runs: list[dict] = []
        for x in row or ():
            if runs and x["first"] <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], x["last"] + LENGTH)
            else:
                runs.append({"first": x["first"], "end": x["last"] + LENGTH})
        out.append(runs)
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))


_SUMS = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _summary(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, runs in zip(texts.to_pylist(), spans.to_pylist()):
        data, at, kept = text.encode(), 0, []
        for x in runs:
            kept.append(data[at : x["first"]])
            at = x["end"]
        kept = b"".join([*kept, data[at:]])
        out.append({"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return pa.array(out, _SUMS)


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What remains, as bytes: a run can begin inside a character."""
    out = []
    for text, runs in zip(texts.to_pylist(), spans.to_pylist()):
        data, at, kept = text.encode(), 0, []
        for x in runs:
            kept.append(data[at : x["first"]])
            at = x["end"]
        out.append(b"".join([*kept, data[at:]]))
    return pa.array(out, pa.binary())


def remaining(docs: DataFrame, text_col="text") -> DataFrame:
    """``text`` and ``kept`` (the bytes that remain) of each distinct text."""
    return removed(docs, text_col).select("text", F.arrow_udf(_kept, "binary")("text", "spans").alias("kept"))


def op7_suffixes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>"
    rows = stored(docs.select("doc_id", *_keys(F.coalesce("text", F.lit("")))), "documents")
    sums = removed(docs).select(*_KEY, F.arrow_udf(_summary, kind)("text", "spans").alias("s"))
    sums = stored(sums.join(rows.groupBy(*_KEY).agg(F.count("*").alias("n")), _KEY).select(*_KEY, "n", "s.*"), "sums")
    return hot_joined(rows, sums, _KEY).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = """
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS x FROM documents),
sized AS (SELECT k, x, octet_length(x) AS n FROM docs),
starts AS (SELECT k, a, md5(array_slice(x, a + 1, a + 200)) AS w FROM (SELECT k, x, unnest(range(0, n - 199)) AS a FROM sized WHERE n >= 200)),
again AS (SELECT w FROM starts GROUP BY w HAVING count(*) > 1),
marked AS (SELECT k, a, a - lag(a) OVER (PARTITION BY k ORDER BY a) AS gap FROM starts JOIN again USING (w)),
grouped AS (SELECT k, a, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a) AS span FROM marked),
spans AS (SELECT k, span, min(a) AS first, max(a) + 200 AS stop FROM grouped GROUP BY k, span),
gaps AS (SELECT k, unhex(string_agg(CASE WHEN kept_to > kept_from THEN hex(array_slice(x, kept_from + 1, kept_to)) ELSE '' END,
    '' ORDER BY kept_from)) AS kept
         FROM (SELECT k, x, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY first), 0) AS kept_from, first AS kept_to FROM spans JOIN sized USING (k)
               UNION ALL SELECT k, x, max(stop) AS kept_from, max(n) AS kept_to FROM spans JOIN sized USING (k) GROUP BY k, x) GROUP BY k),
sums AS (SELECT k, sum(stop - first) AS n_removed, count(*) AS n_spans FROM spans GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(kept, x)) AS kept_sha256
FROM (SELECT k, doc_id FROM docs) JOIN sized USING (k) LEFT JOIN sums USING (k) LEFT JOIN gaps USING (k)
"""
