"""Operator 1: token counts from per-document pre-token frequencies, without ids.

Documents are read in blocks of ``BLOCK_BYTES`` of text. A block keeps its distinct pre-tokens once, and for
each document the block's pre-token numbers with their frequencies. Pieces are counted once for each
pre-token that is distinct in the whole corpus; the counts go back to the blocks that hold the pre-token,
and a document's tokens are the sum of frequency times pieces. What is shuffled are pre-tokens by block,
never a row for each word of a document.

A text is cut at white space first where the tokenizer drops white space between pre-tokens: what a piece
of text without white space gives does not depend on its neighbours. A piece that holds a special token's
string is counted whole by the library.

Nulls: a null text is empty: 0 bytes, 0 tokens; a null id is returned as such. Repeated rows are each
counted. A text longer than a block is a block. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table

BLOCK_BYTES, LIMIT = 24 << 20, 2048
#: Marks a pre-token that is text for the whole library, not a piece for its model.
_WHOLE = "\x00"
_SPACED = re.compile(r"[^ \t\n\r]+")
#: Counts that a task gathers before it hands them on by block.
_GATHERED = 1 << 20
#: Documents of a block whose frequencies are merged at once.
_MERGED = 256

_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("bytes", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("n", pa.int64()),
        ("numbers", pa.binary()),
        ("times", pa.binary()),
        ("pieces", pa.list_(pa.string())),
    ]
)
_BLOCK_DDL = "block long, doc_ids array<long>, bytes array<long>, sizes array<int>, n long, numbers binary, times binary, pieces array<string>"
_COUNTS = pa.schema([("block", pa.int64()), ("numbers", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def _packed(values: np.ndarray) -> bytes:
    """32-bit integers by byte plane, compressed: small ones take little."""
    return pa.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


class PreTokens:
    """The pre-tokens of a text as the tokenizer's own parts cut it."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"] for x in json.loads(spec).get("added_tokens", ())]
        self.drops_space = len(self.split("a  b\n\t1 ")) == 3 and all(len(self.split(x)) == 1 for x in ("a", "b", "1"))

    def split(self, text: str) -> list[str]:
        t = self.tokenizer
        if any(x in text for x in self.special):
            return [_WHOLE + text]
        normal = t.normalizer.normalize_str(text) if t.normalizer else text
        if any(x in normal for x in self.special):
            return [_WHOLE + text]
        return [x for x, _ in t.pre_tokenizer.pre_tokenize_str(normal)] if t.pre_tokenizer else [normal] * bool(normal)

    def split_all(self, chunks: list[str]) -> list[list[str]]:
        """:meth:`split` of each; where white space is dropped, in one go over all that hold none themselves."""
        joined = " ".join(chunks)
        if not self.drops_space or any(x in joined for x in self.special) or joined.split() != chunks:
            return [self.split(x) for x in chunks]
        normal = self.tokenizer.normalizer.normalize_str(joined) if self.tokenizer.normalizer else joined
        gaps = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
        if len(gaps) != len(chunks) - 1 or any(x in normal for x in self.special):
            return [self.split(x) for x in chunks]
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        cut = np.searchsorted([at for _, (at, _) in pieces], np.concatenate(([0], gaps, [len(normal)])))
        names = [x for x, _ in pieces]
        return [names[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def chunks(self, text: str) -> list[str]:
        return _SPACED.findall(text) if self.drops_space else [text]

    def count(self, piece: str) -> int:
        if piece.startswith(_WHOLE):
            return len(self.tokenizer.encode(piece[1:], add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(piece))


class _Block:
    def __init__(self, cut: PreTokens, number: int):
        self.cut, self.number, self.size, self.ids, self.bytes, self.docs = cut, number, 0, [], [], []
        self.chunks: defaultdict[str, int] = defaultdict()
        self.chunks.default_factory = self.chunks.__len__

    def add(self, ident, text: str | None) -> None:
        text = text or ""
        n = len(text.encode())
        self.ids.append(ident)
        self.bytes.append(n)
        self.size += n
        total = Counter(self.cut.chunks(text))
        self.docs.append((np.fromiter(map(self.chunks.__getitem__, total), np.int32, len(total)), np.fromiter(total.values(), np.int32, len(total))))

    def row(self) -> pa.RecordBatch:
        chunks, pieces = list(self.chunks), defaultdict()
        pieces.default_factory = pieces.__len__
        lists = []
        for k in range(0, len(chunks), 20_000):
            lists += self.cut.split_all(chunks[k : k + 20_000])
        count = np.array([len(x) for x in lists], np.int64)
        of_chunk = np.fromiter(map(pieces.__getitem__, chain.from_iterable(lists)), np.int64, int(count.sum()))
        begin = np.cumsum(count) - count
        numbers, times, sizes, last = [], [], [], 0
        for k in range(0, len(self.docs), _MERGED):  # each document's chunks become their pieces; those that fall together are summed
            docs = self.docs[k : k + _MERGED]
            ids, n_times = np.concatenate([x for x, _ in docs]), np.concatenate([x for _, x in docs])
            owner = np.repeat(np.arange(len(docs)), [len(x) for x, _ in docs])
            n = count[ids]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[ids], n)
            key, back = np.unique(np.repeat(owner, n) * max(len(pieces), 1) + of_chunk[at], return_inverse=True)
            owner, number = np.divmod(key, max(len(pieces), 1))
            numbers.append(np.diff(number, prepend=0).astype(np.int32))
            if len(number):  # the first is told from the last of the slice before
                numbers[-1][0] -= last
                last = int(number[-1])
            times.append(np.bincount(back, weights=np.repeat(n_times, n), minlength=len(key)).astype(np.int32))
            sizes += np.bincount(owner, minlength=len(docs)).tolist()
        deltas, times = np.concatenate(numbers), np.concatenate(times)
        row = [self.number, self.ids, self.bytes, sizes, len(deltas), _packed(deltas), _packed(times), list(pieces)]
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _BLOCK)], schema=_BLOCK)


def _blocks(spec, block_bytes: int):
    def run(batches):
        cut = PreTokens(spec.value)
        number = TaskContext.get().partitionId() << 32
        block = _Block(cut, number)
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block.docs and block.size + len(text or "") > block_bytes:
                    yield block.row()
                    number += 1
                    block = _Block(cut, number)
                block.add(ident, text)
        if block.docs:
            yield block.row()

    return run


def _counted(spec):
    """Sorted by pre-token: each is counted once, and the counts go on by block."""

    def handed(held):
        blocks, numbers, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(blocks, kind="stable")
        blocks, numbers, n = blocks[order], numbers[order], n[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)])).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (numbers, n)]
        return pa.RecordBatch.from_arrays([pa.array(blocks[cut[:-1]]), *lists], schema=_COUNTS)

    def run(batches):
        cut = PreTokens(spec.value)
        held, size, last = [], 0, (None, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pc.dictionary_encode(batch.column("piece"))
            names = coded.dictionary.to_pylist()
            n = np.array([last[1] if x == last[0] else cut.count(x) for x in names], np.int32)
            codes = coded.indices.to_numpy()
            last = names[codes[-1]], int(n[codes[-1]])
            held.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), n[codes]))
            size += batch.num_rows
            if size >= _GATHERED:
                yield handed(held)
                held, size = [], 0
        if held:
            yield handed(held)

    return run


def _summed(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            ids, sizes, total = batch.column("doc_ids")[r].values, batch.column("bytes")[r].values, batch.column("n")[r].as_py()
            each = batch.column("sizes")[r].values.to_numpy()
            numbers = np.cumsum(_unpacked(batch.column("numbers")[r].as_py(), total))
            times = _unpacked(batch.column("times")[r].as_py(), total)
            n = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
            counts = batch.column("counts")[r].values
            for part in range(len(counts) if counts is not None else 0):
                n[counts.field("numbers")[part].values.to_numpy()] = counts.field("n")[part].values.to_numpy()
            upto = np.concatenate(([0], np.cumsum(n[numbers] * times)))
            ends = np.cumsum(each)
            yield pa.RecordBatch.from_arrays(
                [ids, sizes, pa.array(upto[ends] - upto[ends - each], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )


def token_counts(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` by the tokenizers file at ``tokenizer_path`` (read here and sent along)."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(spec, block_bytes), _BLOCK_DDL), "tokens")
    held = blocks.select("block", F.posexplode("pieces").alias("number", "piece"))
    # a pre-token has a row for each block that holds it, not for each document
    held = held.repartition("piece").sortWithinPartitions("piece")
    counts = held.mapInArrow(_counted(spec), "block long, numbers array<int>, n array<int>")
    counts = counts.groupBy("block").agg(F.collect_list(F.struct("numbers", "n")).alias("counts"))
    return blocks.drop("pieces").join(counts, "block", "left").drop("block").mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")


def op1_tokens(spark, sf_dir):
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
