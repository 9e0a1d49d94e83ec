"""Operator 5: approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on ``SAMPLE`` distinct vectors at most (those with the smallest hash); every vector is
put into a leaf. A query walks the tree with a priority queue that always opens the node whose centre has
the largest inner product with it. How many leaves it visits is widened until, over ``CALIBRATION`` queries
held against all vectors, the recall reaches ``RECALL``. Leaves in a row are a section, a leaf of many vectors is
several; a task holds a block of queries against a section, both of ``GROUP`` bytes at most.

Vectors alike in every component are one vector with its smallest ids, so a vector that a third of all rows
hold is compared once. Scores are inner products in double precision of the vectors as given.

Nulls: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without
an id or vectors not of the commonest length. A query's own id is no candidate; of repeated ids each row is
one. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, small_batches, stored, table

NEAREST, SAMPLE, CALIBRATION, RECALL, PARTS = 20, 20_000, 256, 0.95, 16
#: Vectors of a leaf as the sample has it, leaves at most, and children of a node.
LEAF, LEAVES, FANOUT = 1000, 4096, 8
#: Bytes of queries, and of vectors, that a task holds as doubles; sections at least, tasks at most, and products at once.
GROUP, SECTIONS, TASKS, CHUNK = 16 << 20, 32, 10_000, 1 << 20


class Tree:
    """Nodes in an array: centre, children, and the number of a leaf (-1 for others)."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 5):
        self.centres, self.children, self.leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
        rng = np.random.default_rng(seed)
        most = max(1, -(-len(x) // max(1, leaves)))
        todo, self.n_leaves = [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            label = self._parted(x[rows], rng) if len(rows) > most else np.zeros(len(rows), int)
            kinds = np.unique(label)
            if len(kinds) < 2:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for k in kinds:
                own = rows[label == k]
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own))
                self.centres.append(x[own].mean(0))
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def _parted(x: np.ndarray, rng, rounds: int = 8) -> np.ndarray:
        centres = x[rng.choice(len(x), min(FANOUT, len(x)), replace=False)]
        for _ in range(rounds):
            label = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
            centres = np.array([x[label == k].mean(0) if (label == k).any() else centres[k] for k in range(len(centres))])
        return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centre at each node."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            label = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, 1)
            todo += [(child, rows[label == k]) for k, child in enumerate(self.children[node]) if (label == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first walk."""
        out, queue, score = [], [(0.0, 0)], self.centres @ q
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-float(score[child]), child))
        return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _best(q: np.ndarray, x: np.ndarray, least_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of the k best, ties to the smaller id.

    The matrix product only tells what may be among them, with its rounding allowed for; scores are summed anew.
    """
    scores = q @ x.T
    slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1)).max(initial=0)
    out = []
    for n, row in enumerate(scores):
        at = np.arange(len(row))
        if len(row) > k:
            at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack[n])
        exact = (x[at] * q[n]).sum(1)
        order = np.lexsort((least_id[at], -exact))[:k]
        out.append((at[order], exact[order]))
    return out


def _placed(tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("leaf", pa.array(tree.value.place(_matrix(batch.column("vec")))))

    return run


def _exact(queries, own, k: int):
    """The k best of each partition for each of a bounded set of queries, but for the query's own vector."""

    def run(batches):
        q, me = queries.value, own.value
        none = np.zeros(0)
        best = [(none, none.astype(np.int64), none.astype(np.int32))] * len(q)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("vec")), batch.column("least").to_numpy()
            leaf = batch.column("leaf").to_numpy()
            for n, (at, score) in enumerate(_best(q, x, ids, k + 1)):
                at, score = at[ids[at] != me[n]], score[ids[at] != me[n]]
                rows = [np.concatenate(c) for c in zip(best[n], (score, ids[at], leaf[at]))]
                order = np.lexsort((rows[1], -rows[0]))[:k]
                best[n] = tuple(c[order] for c in rows)
        if best:
            number = np.repeat(np.arange(len(q), dtype=np.int32), [len(b[0]) for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), *(pa.array(np.concatenate(c)) for c in zip(*best))],
                names=["n", "score", "least", "leaf"],
            )

    return run


def _sections(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each leaf its section and how many, from that one on, it is dealt over. A section has ``most`` vectors or about so many."""
    out, section, held = {}, 0, 0
    for leaf in sorted(sizes):
        parts = -(-sizes[leaf] // most)
        if held and held + sizes[leaf] > most:
            section, held = section + 1, 0
        out[leaf] = (section, parts)
        section, held = (section + parts, 0) if parts > 1 else (section, held + sizes[leaf])
    return out


def _asked(tree, most: int, where, sample, k: int):
    """Each query once for each section that it visits, with the leaves that it visits there; in bounded batches.

    ``sample`` are some of the vectors and their leaves: k of these that a query visits bound what may be among its k best.
    """

    def run(batches):
        for batch in batches:
            rows, section, seen, bounds = [], [], [], []
            width = batch.nbytes // max(1, batch.num_rows) + 1

            def out():
                kept = batch.select(["block", "name", "vec"]).take(pa.array(rows, pa.int64()))
                made = pa.array(section, pa.int32()), pa.array(seen, pa.list_(pa.int32())), pa.array(bounds, pa.float64())
                return pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, "section", "leaves", "bound"])

            for r, q in enumerate(_matrix(batch.column("vec"))):
                visited: dict[int, list[int]] = {}
                walk = tree.value.visits(q, most)
                x, leaf_of = sample.value
                product = (x @ q)[np.isin(leaf_of, walk)]
                slack = 1e-12 * np.sqrt((q**2).sum()) * np.sqrt((x**2).sum(1)).max(initial=0)
                bound = np.partition(product, len(product) - k)[len(product) - k] - slack if len(product) >= k else -np.inf
                for leaf in walk:
                    first, parts = where.value.get(leaf, (0, 0))
                    for s in range(first, first + parts):
                        visited.setdefault(s, []).append(leaf)
                for s, leaves in visited.items():
                    rows.append(r)
                    section.append(s)
                    seen.append(leaves)
                    bounds.append(float(bound))
                    if len(rows) * width > BATCH_BYTES:
                        yield out()
                        rows, section, seen, bounds = [], [], [], []
            if rows:
                yield out()

    return run


class _Found:
    """Pairs of a query and a vector that may be among the query's k best; pruned to these whenever they are many."""

    def __init__(self, q: np.ndarray, x: np.ndarray, least: np.ndarray, bound: np.ndarray, k: int):
        self.q, self.x, self.least, self.k, self.n, self.pairs = q, x, least, k, 0, []
        self.bound = np.where(np.isnan(bound), -np.inf, bound)  # k vectors are at least as near
        self.slack = 1e-12 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1)).max(initial=0)  # of the product's rounding

    def search(self, some: np.ndarray, a: int, b: int) -> None:
        """Hold some queries against the vectors from a to b."""
        product = self.q[some] @ self.x[a:b].T
        among = ~(product < (self.bound[some] - self.slack[some])[:, None])
        many = np.flatnonzero(among.sum(1) > self.k)
        if len(many):
            kth = np.partition(product[many], b - a - self.k, axis=1)[:, b - a - self.k]
            self.bound[some[many]] = np.fmax(self.bound[some[many]], kth)
            among[many] = ~(product[many] < (self.bound - self.slack)[some[many], None])
        r, v = np.nonzero(among)
        self.pairs.append((some[r], a + v, product[r, v]))
        self.n += len(r)
        if self.n > 2 * max(CHUNK, self.k * len(self.q)):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, places and scores, summed anew, ties to the smaller id."""
        r, v, score = (np.concatenate(c) for c in zip(*self.pairs))
        at = np.flatnonzero(~(score < (self.bound - self.slack)[r]))
        r, v = r[at], v[at]
        step = max(1, CHUNK // max(1, self.x.shape[1]))
        score = np.concatenate([np.zeros(0), *((self.x[v[c : c + step]] * self.q[r[c : c + step]]).sum(1) for c in range(0, len(r), step))])
        order = np.lexsort((self.least[v], -score, r))
        r, v, score = r[order], v[order], score[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        last = nth == self.k - 1
        self.bound[r[last]] = np.fmax(self.bound[r[last]], score[last])
        keep = nth < self.k
        self.pairs, self.n = [(r[keep], v[keep], score[keep])], int(keep.sum())
        return self.pairs[0]


def _searched(k: int):
    schema = pa.schema([("name", pa.binary()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        """A block of queries against a section: each leaf's vectors for the queries that visit it."""
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        leaf = held.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf = leaf[order]
        x = _matrix(held.column("vec"))[order]
        found = _Found(_matrix(asked.column("vec")), x, held.column("least").to_numpy()[order], asked.column("bound").to_numpy(), k)
        visited = asked.column("leaves").combine_chunks()
        who, wanted = np.repeat(np.arange(len(visited)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()
        by_leaf = np.argsort(wanted, kind="stable")
        who, wanted = who[by_leaf], wanted[by_leaf]
        for x in np.unique(leaf).tolist():
            a, b = np.searchsorted(leaf, (x, x + 1)).tolist()
            asking = who[slice(*np.searchsorted(wanted, (x, x + 1)))]
            step = max(1, CHUNK // (b - a))
            for c in range(0, len(asking), step):
                found.search(asking[c : c + step], a, b)
        if not found.pairs:
            return schema.empty_table()
        r, v, score = found.best()
        names, ids = asked.column("name").combine_chunks(), held.column("ids").combine_chunks()
        return pa.table([names.take(pa.array(r)), pa.array(score), ids.take(pa.array(order[v]))], schema=schema)

    return run


def nearest(vectors: DataFrame, id_col="vec_id", vec_col="embedding", every: int = 20, k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its k nearest."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind = dict(vectors.dtypes)[vec_col]
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as such
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fine)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (length.n if length else 0))
    # -0.0 and 0.0 are one value: adding 0.0 makes them so
    rows = rows.withColumn("name", F.unhex(F.md5(F.concat_ws(",", F.transform("vec", lambda v: (v.cast("double") + F.lit(0.0)).cast("string"))).cast("binary"))))
    first = F.row_number().over(Window.partitionBy("name").orderBy("vec_id"))  # limited before the shuffle already
    distinct = rows.withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("name").agg(
        F.first("vec").alias("vec"),
        F.array_sort(F.collect_list("vec_id")).alias("ids"),
    )
    distinct = stored(distinct.withColumn("least", F.get("ids", F.lit(0))), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).select("name", F.col("vec_id").alias("query_id"))

    total = distinct.count()
    sample = np.array([r.vec for r in distinct.orderBy(F.xxhash64(F.lit(3), "name"), "name").select("vec").limit(SAMPLE).collect()], float)
    tree = Tree(sample.reshape(len(sample), -1) if len(sample) else np.zeros((0, 1)), min(LEAVES, max(1, total // LEAF)))
    shared = spark.sparkContext.broadcast(tree)
    placed = stored(distinct.mapInArrow(_placed(shared), f"name binary, vec {kind}, ids array<long>, least long, leaf int"), "leaves")
    asked = stored(queries.select("name").distinct().join(distinct, "name").select("name", "vec", "least"), "asked")

    visits = _calibrated(spark, tree, asked, placed, k, recall)
    # blocks of queries against sections of leaves: what a task holds doesn't grow with the input, nor is a query sent to each leaf
    sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row a leaf
    most = max(1, GROUP // (8 * (length.n if length else 1)))
    sections = _sections(sizes, min(most, max(LEAF, total // SECTIONS)))
    blocks = max(1, -(-asked.count() // most))
    some = spark.sparkContext.broadcast((sample, tree.place(sample)) if len(sample) else (np.zeros((0, 1)), np.zeros(0, np.int32)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    wide = asked.mapInArrow(
        _asked(shared, visits, spark.sparkContext.broadcast(sections), some, k + 1),
        f"block int, name binary, vec {kind}, section int, leaves array<int>, bound double",
    )
    firsts = spark.createDataFrame([(x, *s) for x, s in sections.items()], "leaf int, first int, parts int")
    held = placed.join(F.broadcast(firsts), "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64(F.lit(1), "name"), F.col("parts"))).cast("int").alias("section"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "leaf",
        "vec",
        "ids",
        "least",
    )
    # searching costs far more than its bytes tell: as many tasks as there are groups, up to a bound, and none are put together
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, blocks * sum(parts for _, parts in sections.values())))
    wide, held = (df.repartition(n_tasks, "section", "block") for df in (wide, held))
    found = wide.groupBy("section", "block").cogroup(held.groupBy("section", "block")).applyInArrow(
        _searched(k + 1),
        "name binary, score double, ids array<long>",
    )
    found = found.select("name", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1)
    best = best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    # a vector may be that of a third of all queries: its list is written for each of 16 parts
    best = best.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(PARTS)).cast("int")).join(best, ["name", "part"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _calibrated(spark, tree: Tree, asked: DataFrame, placed: DataFrame, k: int, recall: float) -> int:
    """The least number of leaves at which the calibration queries' recall is reached."""
    some = asked.orderBy(F.xxhash64(F.lit(9), "name"), "name").limit(CALIBRATION).collect()
    if not some:
        return 1
    q = np.array([r.vec for r in some], float)
    own = spark.sparkContext.broadcast(np.array([r.least for r in some]))
    exact = placed.select("vec", "least", "leaf").mapInArrow(
        _exact(spark.sparkContext.broadcast(q), own, k),
        "n int, score double, least long, leaf int",
    )
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "least"))
    exact = exact.withColumn("place", place).where(F.col("place") <= k).select("n", "leaf").collect()  # k rows a query
    reached = np.zeros(tree.n_leaves, int)
    order = [{x: i for i, x in enumerate(tree.visits(v, tree.n_leaves))} for v in q]
    for r in exact:
        reached[order[r.n][r.leaf]] += 1
    return int(np.searchsorted(np.cumsum(reached) / max(len(exact), 1), recall)) + 1


def op5_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
