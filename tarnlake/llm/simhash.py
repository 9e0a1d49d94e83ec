"""Operator 10: SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of 2 bits; the vector of their bit counts is its
embedding. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. The grid range join finds every pair within Manhattan distance 3: the coordinates form six
groups, and of two such points at least three groups agree in full, so each point is put into the 20 cells
named by three groups' coordinates: at segments of 2 bits and distance 3 the grid's range is a step of 0, that is
equality on half the groups. In a cell the embeddings' distance is the lower bound that prunes, and
the fingerprints' own distance verifies. The cells only ever hold distinct fingerprints.

A cell hands on, for each of its fingerprints, one link towards its component within the cell, not all
pairs: the components are the same and the rows grow in proportion. Alternating stars join them up.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null id takes part, and a
component's id is the smallest id that is not null (null if there is none). Empty table: no rows. Repeated
rows fall into one component and each is returned. Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, dropped, flat, hot_joined, small, small_batches, stored, table, word_spans

SHINGLE, SEED, DISTANCE = 3, 42, 3
_SLICE = 1 << 16  # hashes whose bits are counted at once


def fingerprints(texts: pa.Array, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The batch's fingerprints: a bit is set if it is set in over half of the hashes of a text's shingles."""
    data, offsets = flat(texts)
    out = np.zeros(len(texts), np.uint64)
    if not len(data):
        return out
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    # Words joined by one space: of the white space after a word only its first byte is kept.
    keep = NOT_SPACE[data]
    after = ends[ends < len(data)]
    after = after[~keep[after]]
    keep[after] = True
    data[after] = 0x20
    place = np.cumsum(keep) - 1
    raw = memoryview(data[keep].tobytes())
    starts, ends = place[starts], place[ends - 1] + 1
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    at = np.cumsum(count) - count
    # shingle k of text d begins at word first[d] + k and takes min(n, words) words
    owner = np.repeat(np.arange(len(words)), count)
    begin = first[:-1][owner] + np.arange(len(owner)) - at[owner]
    end = begin + np.minimum(n, words)[owner] - 1
    digest = xxhash.xxh64_intdigest
    a, b = starts[begin].tolist(), ends[end].tolist()
    hashes = np.fromiter((digest(raw[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a)).astype(">u8")
    ones = np.zeros((len(words), 64), np.int32)
    for k in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[k : k + _SLICE].view(np.uint8)).reshape(-1, 64)
        own = owner[k : k + _SLICE]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as the signed long of the same bits."""
    return F.arrow_udf(_fingerprint, "long")(text)


# The grid.

#: The 32 segments in six groups, as nearly alike as they come.
GROUPS = [(0, 6), (6, 12), (12, 17), (17, 22), (22, 27), (27, 32)]
CELLS = list(combinations(range(len(GROUPS)), len(GROUPS) - DISTANCE))


def embedded(f: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, 2 bits each, in one integer."""
    odd = np.uint64(0x5555555555555555)
    return f - ((f >> np.uint64(1)) & odd)


def _mask(group: tuple[int, int]) -> int:
    return sum(3 << 2 * k for k in range(*group))


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of embeddings: counts 0, 1, 2 as 00, 01, 11 turn a difference into as many bits."""
    thermo = lambda v: v | ((v >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return np.bitwise_count(thermo(x) ^ thermo(y))


def _links(prints: np.ndarray, distance: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct fingerprints of a cell, a forest of its components: each linked fingerprint with one root.

    A fingerprint is compared with those outside its component as known so far, so that a dense cell, nearly
    all of one component, costs far less than its pairs. With ``own``, the blocks, only pairs of two blocks count.
    """
    n = len(prints)
    root = np.arange(n)
    points = embedded(prints)
    for k in range(n - 1):
        rest = root[k + 1 :] != root[k]
        if own is not None:
            rest &= own[k + 1 :] != own[k]
        rest = np.flatnonzero(rest) + k + 1
        if not len(rest):
            continue
        rest = rest[_manhattan(points[rest], points[k]) <= distance]
        rest = rest[np.bitwise_count(prints[rest] ^ prints[k]) <= distance]
        if len(rest):
            joined = np.unique(np.append(root[rest], root[k]))
            root[np.isin(root, joined)] = joined[0]
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _cell_links(batches, distance: int = DISTANCE):
    """Batches sorted by cell and pair of blocks: the links of each, held at once (two blocks at most)."""
    names = ["cell", "x", "y", "own", "fp"]

    def out(c):
        prints = c["fp"].view(np.uint64)
        new = np.ones(len(prints), bool)
        new[1:] = (np.diff(c["cell"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0)
        cut = np.append(np.flatnonzero(new), len(prints))
        many = np.flatnonzero(np.diff(cut) > 1)
        pairs = many[(np.diff(cut)[many] == 2) & (c["x"][cut[many]] == c["y"][cut[many]])]
        near = cut[pairs][np.bitwise_count(prints[cut[pairs]] ^ prints[cut[pairs] + 1]) <= distance]
        a, b = [prints[near + 1]], [prints[near]]
        for k in np.setdiff1d(many, pairs).tolist():
            part = slice(cut[k], cut[k + 1])
            x, y = _links(prints[part], distance, c["own"][part] if c["x"][cut[k]] != c["y"][cut[k]] else None)
            a.append(prints[part][x])
            b.append(prints[part][y])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {x: batch.column(x).to_numpy() for x in names}
        of_last = (c["cell"] == c["cell"][-1]) & (c["x"] == c["x"][-1]) & (c["y"] == c["y"][-1])
        last = int(np.flatnonzero(~of_last)[-1]) + 1 if not of_last.all() else 0  # the last group may go on in the next batch
        if held and (last or any(held[-1][x][-1] != c[x][0] for x in names[:3])) or last:
            yield out({x: np.concatenate([*(h[x] for h in held), c[x][:last]]) for x in names})
            held = []
        held.append({x: v[last:] for x, v in c.items()})
    if held:
        yield out({x: np.concatenate([h[x] for h in held]) for x in names})


#: Fingerprints of a cell that are compared in one piece; a cell of more is cut into blocks, compared pair by pair.
BLOCK = 1 << 13


def near(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a, b``: links among the distinct fingerprints of column ``fp`` that join what is within ``distance``."""
    if distance != DISTANCE:
        raise ValueError(f"the grid is laid for a distance of {DISTANCE}")
    odd = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned("fp", 1)
    both, one = F.col("fp").bitwiseAND(half).bitwiseAND(odd), F.col("fp").bitwiseXOR(half).bitwiseAND(odd)
    point = F.shiftleft(both, 1).bitwiseOR(one)  # counts of the 2-bit segments, as in embedded()
    cells = []
    for k, groups in enumerate(CELLS):
        mask = sum(_mask(GROUPS[g]) for g in groups)
        cells.append(F.xxhash64(point.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(k)))
    rows = prints.select("fp", F.explode(F.array(*cells)).alias("cell"))
    # cells of more than a block: fewer than a cell for every BLOCK rows
    dense = stored(
        rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select(
            "cell",
            F.ceil(F.col("n") / block).cast("int").alias("blocks"),
        ),
        "dense",
    )
    rows = rows.join(F.broadcast(dense) if small(dense) else dense, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(8), "fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp")
    return rows.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "fp").mapInArrow(_cell_links, "a long, b long")


#: Bytes of stored links up to which one task finishes them.
FINISH = 2 << 20


def _flat_nodes(column) -> list:
    return list(zip(*(c.to_pylist() for c in column.flatten()))) if pa.types.is_struct(column.type) else column.to_pylist()


def _finished(batches):
    """The smallest node of each component of all the links given, by union and find."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(_flat_nodes(batch.column(0)), _flat_nodes(batch.column(1))):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        pairs = [(x, find(x)) for x in parent]
        columns = list(zip(*[(x, y) for x, y in pairs if x != y]))
        if pa.types.is_struct(kind):
            columns = [[dict(zip((f.name for f in kind), x)) for x in c] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node that has a smaller one in its component: the smallest, by alternating stars.

    Large star hands a node's larger neighbours to the smallest of its neighbourhood, small star the smaller
    ones; stars are all that is left after some log(n) rounds. Each round is a table in the shared folder.
    Neighbourhoods are never collected: the smallest neighbour is an aggregate, joined back. What is left of the
    links is finished in one task as soon as it is a table of ``FINISH`` bytes at most.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, kind = None, edges.schema["a"].dataType.simpleString()
    while True:
        if small(edges, FINISH):
            return edges.coalesce(1).mapInArrow(_finished, f"node {kind}, root {kind}")
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        after = stored(star.select("e.a", "e.b").where("a <> b").distinct(), "stars")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        dropped(edges)
        if state == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, before = after, state


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, fp, digest`` (of the text), ``root`` (a fingerprint that names the component) and ``component_id`` of each document."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text).alias("fp"), _digest(text).alias("digest")), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(near(prints.select("fp")))
    # fingerprint -> root -> smallest id; everything from here on has one row a distinct fingerprint
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = hot_joined(rooted.drop("least"), stored(least, "least"), ["root"], "members")
    return hot_joined(rows, stored(named, "named"), ["fp"])


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One document of each component: that with the smallest id; among rows of that id, the first by digest, then by all columns.

    Columns without an order (maps and such) don't count in that; of rows that differ in them alone any one stays.
    The choice is made on thin rows; the texts are shuffled once, to meet it by id and digest.
    """
    marked = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = lambda ident, digest: F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), digest)
    chosen = marked.groupBy("root").agg(F.min(key(F.col("doc_id"), F.col("digest"))).alias("key")).select("key").distinct()
    ordered = [f"row.`{c}`" for c, t in docs.dtypes if not re.search("map<|variant|interval", t)]
    rows = docs.select(key(F.col(id_col), _digest(F.col(text_col))).alias("key"), F.struct("*").alias("row"))
    rows = rows.join(chosen, "key", "left_semi")
    one = F.min("row") if len(ordered) == len(docs.columns) else F.min_by("row", F.struct(*ordered))
    return rows.groupBy("key").agg(one.alias("row")).select("row.*")


def op10_simhash(spark, sf_dir):
    marked = near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
