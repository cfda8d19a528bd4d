"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE`` vectors), every vector is put into a leaf by descending it. A query
walks the tree through a priority queue: the bin with the largest inner product of its centre comes first, and opening
an inner node queues its children. How many leaves are visited is calibrated: for ``PROBES`` vectors the true neighbours
are found by brute force over all rows, and leaves are added until ``RECALL`` of them lie in the visited leaves. Leaves
are put together into cells of a bounded number of rows; a query goes to each cell in which it visits leaves, is scored
exactly against their rows in blocks of bounded size, and the best are kept per block and then per query.

Equal vectors score alike, so of each vector only the ``k + 1`` smallest ids can be among the ``k`` nearest of any query:
that many are kept, and equal queries are searched once. This loses nothing and keeps a common vector from filling a leaf.

Vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part. A null id
is no query and no candidate. Rows that repeat an id and vector count once; an id with several vectors has each of
them as candidate and as query. Ties go to the smaller id. Other columns are passed over. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.common import ready, saved

K = 20
#: Vectors that the tree is fitted on, children of a node, rows aimed at in a leaf, rounds of k-means.
SAMPLE, BRANCH, LEAF_ROWS, ROUNDS = 20_000, 8, 300, 8
#: Queries of the calibration and the recall aimed at there.
PROBES, RECALL = 200, 0.97
#: Rows and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 256


@dataclass
class Tree:
    """Nodes with their centres; inner nodes have children, the others are leaves numbered in order."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray  # number of a leaf, -1 for inner nodes
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each leaf

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(x), np.int64)
        for node, kids in enumerate(self.children):  # parents come before their children
            here = np.flatnonzero(at == node) if len(kids) else ()
            if len(here):
                at[here] = kids[_nearest(x[here], self.centres[kids])]
        return self.leaf[at]

    def visits(self, dots: np.ndarray, leaves: int, least_rows: int) -> list[int]:
        """Leaves in best-bin-first order for a query, from its inner products with all centres."""
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < leaves or rows < least_rows):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                rows += int(self.rows[self.leaf[node]]) if len(self.rows) else 0
            else:
                for kid in self.children[node].tolist():
                    heapq.heappush(queue, (-dots[kid], kid))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means: centres and the cluster of each vector."""
    centres = np.unique(x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        used, own = np.unique(own, return_inverse=True)
        centres = np.stack([x[own == k].mean(axis=0) for k in range(len(used))])
    return centres, _nearest(x, centres)


def fit(sample: np.ndarray, rows: int) -> Tree:
    """A tree whose leaves hold about ``LEAF_ROWS`` of ``rows`` rows, if the sample allows."""
    rng = np.random.default_rng(11)
    tree = Tree(np.zeros((0, sample.shape[1])), [], np.zeros(0, np.int64))
    centres, children, todo = [sample.mean(axis=0)], [np.zeros(0, np.int64)], [(0, np.arange(len(sample)))]
    while todo:
        node, own = todo.pop(0)
        if len(own) * rows / len(sample) <= LEAF_ROWS or len(own) < 4 * BRANCH:
            continue
        middle, cluster = _split(sample[own], rng)
        parts = [own[cluster == k] for k in range(len(middle))]
        if sum(len(p) > 0 for p in parts) < 2:
            continue  # equal vectors
        first = len(centres)
        children[node] = np.arange(first, first + len(parts))
        centres.extend(middle)
        children.extend(np.zeros(0, np.int64) for _ in parts)
        todo.extend((first + k, p) for k, p in enumerate(parts) if len(p))
    tree.centres, tree.children = np.stack(centres), children
    inner = np.array([len(c) > 0 for c in children])
    tree.leaf = np.where(inner, -1, np.cumsum(~inner) - 1)
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def cells(tree: Tree) -> np.ndarray:
    """Cell of each leaf: neighbouring subtrees of ``BLOCK_ROWS`` rows together, or single larger leaves."""
    total = np.zeros(len(tree.leaf), np.int64)
    total[tree.leaf >= 0] = tree.rows[tree.leaf[tree.leaf >= 0]]
    for node in range(len(total) - 1, -1, -1):  # children come behind their parents
        total[node] += total[tree.children[node]].sum()
    out, todo, last, filled = np.zeros(len(tree.rows), np.int64), [(0, -1)], 0, 0
    while todo:
        node, cell = todo.pop()
        if cell < 0 and (total[node] <= BLOCK_ROWS or tree.leaf[node] >= 0):
            if filled + total[node] > BLOCK_ROWS:
                last, filled = last + 1, 0
            cell, filled = last, filled + total[node]
        if tree.leaf[node] >= 0:
            out[tree.leaf[node]] = cell
        todo.extend((kid, cell) for kid in tree.children[node].tolist())
    return out


def best(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, open_to: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows (of those open to it) as (query, ids, scores).

    Scores are sums row by row, so that equal vectors tie. A first choice is made by a matrix product, which may be off by
    a share of the norms; where products leave the range of doubles, all rows are looked at. A sum that is no number
    (infinite parts of both signs) counts as the least.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        yield from _best(queries, x, ids, k, open_to)


def _best(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, open_to: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    rough = queries @ x.T
    error = 1e-12 * np.linalg.norm(queries, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0.0)
    for i in range(len(queries)):
        near = np.arange(len(x)) if open_to is None else np.flatnonzero(open_to[i])
        if len(near) > k and np.isfinite(error[i]) and np.isfinite(rough[i, near]).all():
            least = np.partition(rough[i, near], len(near) - k)[len(near) - k]
            near = near[rough[i, near] >= least - error[i]]
        exact = np.nan_to_num((x[near] * queries[i]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        order = np.lexsort((ids[near], -exact))[:k]
        yield i, ids[near][order], exact[order]


def _table(found: list[tuple], number: np.ndarray) -> pa.RecordBatch:
    count = [len(i) for _, i, _ in found]
    empty = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([number[q] for q, _, _ in found], count).astype(np.int64)), pa.array(np.concatenate([i for _, i, _ in found] or empty)), pa.array(np.concatenate([s for _, _, s in found] or empty).astype(np.float64))],
        ["query", "vec_id", "score"],
    )


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    good = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = good.where(finite & F.exists("vector", lambda v: v != 0))
    size = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vector") == (size["n"] if size else -1))


def _top(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key; the limit is applied before the exchange as well."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that meets the condition ``queries``."""
    spark = ready(vectors.sparkSession)
    rows = saved(usable(vectors).distinct(), "vectors")
    # the smallest ids of each vector; its number is the least of them
    kept = _top(rows, "vector", ["vec_id"], k + 1).select("vec_id", "vector")
    kept = saved(kept.withColumn("mod", F.pmod(F.xxhash64("vector"), F.lit(1 << 30))), "kept")
    n = kept.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)

    def drawn(size: int, salt: int) -> np.ndarray:
        """At most ``size`` vectors with the lowest hashes under a salt."""
        mark = F.pmod(F.xxhash64("mod", "vec_id", F.lit(salt)), F.lit(1 << 30))
        low = kept.where(mark < (1 << 30) * min(1.0, 2 * size / n)).orderBy(mark, "vec_id").limit(size).select("vector").toArrow()
        return _matrix(low["vector"].combine_chunks())

    tree = fit(drawn(SAMPLE, 1), n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                leaf = tree.assign(_matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(leaf)], ["vec_id", "vector", "leaf"])

    index = saved(kept.select("vec_id", "vector").mapInArrow(placed, "vec_id long, vector array<double>, leaf long"), "index")
    n_leaves = int(tree.leaf.max()) + 1
    tree.rows = np.zeros(n_leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row per leaf
        tree.rows[r["leaf"]] = r["count"]
    leaves, cell_of = _calibrated(index, tree, drawn(PROBES, 2), k), cells(tree)

    # equal queries are one
    asked = rows.where(queries)
    distinct = asked.groupBy("vector").agg(F.min("vec_id").alias("query"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                dots = _matrix(part.column("vector")) @ tree.centres.T
                rows_of, cell, opened = [], [], []
                for i, d in enumerate(dots):
                    met: dict[int, list[int]] = {}
                    for v in tree.visits(d, leaves, 4 * k):
                        met.setdefault(int(cell_of[v]), []).append(v)
                    rows_of += [i] * len(met)
                    cell += met
                    opened += met.values()
                take = pa.array(rows_of, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("query").take(take), part.column("vector").take(take), pa.array(cell, pa.int64()), pa.array(opened, pa.list_(pa.int64()))], ["query", "vector", "cell", "leaves"])

    # a query goes once to each cell, with the leaves that it visits there
    sent = saved(distinct.select("query", "vector").mapInArrow(routed, "query long, vector array<double>, cell long, leaves array<long>"), "routed")
    # blocks of bounded size: every block of queries of a cell meets every block of its rows
    held = {c: int(tree.rows[cell_of == c].sum()) for c in np.unique(cell_of).tolist()}
    asked_by = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
    parts = {c: (max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(asked_by.get(c, 0) / BLOCK_QUERIES))) for c, n in held.items()}
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    for_queries = spark.createDataFrame([(c, *p) for c, p in parts.items()], "cell long, row_blocks int, query_blocks int")
    for_rows = spark.createDataFrame([(leaf, int(c), *parts[int(c)]) for leaf, c in enumerate(cell_of)], "leaf long, cell long, row_blocks int, query_blocks int")
    left = sent.join(for_queries, "cell").withColumn("i", F.pmod(F.xxhash64("query"), "query_blocks").cast("int")).withColumn("j", all_of("row_blocks"))
    right = index.join(for_rows, "leaf").withColumn("j", F.pmod(F.xxhash64("vec_id"), "row_blocks").cast("int")).withColumn("i", all_of("query_blocks"))

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        found, number = [], a["query"].to_numpy()
        if a.num_rows and b.num_rows:
            there, leaf = np.unique(b["leaf"].to_numpy(), return_inverse=True)
            opened = np.array([np.isin(there, v) for v in a["leaves"].to_pylist()])
            found = list(best(_matrix(a["vector"].combine_chunks()), _matrix(b["vector"].combine_chunks()), b["vec_id"].to_numpy(), k + 1, opened[:, leaf]))
        return pa.Table.from_batches([_table(found, number)])

    columns = "query long, vec_id long, score double"
    blocks = left.select("query", "vector", "leaves", "cell", "i", "j").groupBy("cell", "i", "j").cogroup(right.select("vec_id", "vector", "leaf", "cell", "i", "j").groupBy("cell", "i", "j")).applyInArrow(scored, columns)
    nearest = _top(blocks, "query", [F.desc("score"), "vec_id"], k + 1).select("query", "vec_id", "score")
    # back to all queries, each without itself
    pairs = asked.select(F.col("vec_id").alias("query_id"), "vector").join(distinct, "vector").select("query_id", "query").distinct().join(nearest, "query").where("query_id != vec_id")
    ranked = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(ranked, "query_id", [F.desc("score"), "vec_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def true_neighbours(index: DataFrame, probes: np.ndarray, k: int) -> DataFrame:
    """query, vec_id, score of the k nearest of the probes, by brute force over all rows in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                yield _table(list(best(probes, _matrix(part.column("vector")), part.column("vec_id").to_numpy(), k)), np.arange(len(probes)))

    found = index.select("vec_id", "vector").mapInArrow(run, "query long, vec_id long, score double")
    return _top(found, "query", [F.desc("score"), "vec_id"], k)


def _calibrated(index: DataFrame, tree: Tree, probes: np.ndarray, k: int) -> int:
    """Leaf visits after which ``RECALL`` of the probes' true neighbours have been met."""
    n_leaves = len(tree.rows)
    true = true_neighbours(index, probes, k).join(index.select("vec_id", "leaf"), "vec_id").select("query", "leaf").collect()
    turn = np.zeros((len(probes), n_leaves), np.int64)
    for i, d in enumerate(probes @ tree.centres.T):
        order = tree.visits(d, n_leaves, 0)
        turn[i, order] = np.arange(len(order))
    needed = np.sort([turn[r["query"], r["leaf"]] for r in true])
    return int(needed[max(0, math.ceil(RECALL * len(needed)) - 1)]) + 1 if len(needed) else n_leaves
