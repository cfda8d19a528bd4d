"""Near-duplicates by BagMinHash.

A text is the multiset of its runs of five words. Every shingle has a Poisson process for each power-of-two strip of its
weight axis ((0, 1], (1, 2], (2, 4], ...), with a rate equal to the strip's width; a point carries a random slot of the
signature and a random height, and counts if the height lies under the shingle's weight. A slot keeps its earliest
point, so two texts agree in a slot with a probability equal to their weighted Jaccard similarity. Points are made in
order of time and only up to the time by which all slots are filled, so the work hardly grows with the weights.

Signatures are banded. Equal texts are one node. In a band's bucket, every node is paired with two leaders (the node that
shares the most buckets with others, and one by hash), never with all others. Pairs are verified on the exact multisets,
and verified links are joined into components. Components that still share a bucket are then compared block by block:
pairs that their signatures hold for possible are verified in place, and a block gives only the links that join
components, so that none is lost and none is told twice. Classes are the components.

Words are lower-cased; a text of fewer than five words is one shingle, a text without words links to nothing. Null and
empty texts are one text. Null ids are passed on and never name a class unless it has no other id. Repeated rows are
members like others; ``keep_first`` keeps one. An empty table gives no rows. Other columns are kept by ``keep_first``;
names beginning with ``bmh_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import hash64, mixed, ready, saved, slices, texts, word_hashes, words

SHINGLE, SIMILAR = 5, 0.8
#: Slots of a signature and slots of a band.
SLOTS, BAND = 96, 4
#: Share of equal slots under which a pair is not verified (five standard deviations below ``SIMILAR``).
MAYBE = 0.6
#: Nodes of one block in the comparison of components that share a bucket.
BLOCK = 128

_WORD = np.array([hash64(f"word {i}".encode()) | 1 for i in range(SHINGLE)], np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, its text), in order of the texts."""
    distinct, codes, first = words(values)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(first)
    per_text = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(values)), per_text)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + first[:-1][owner]
    out = np.zeros(len(owner), np.uint64)
    for i in range(SHINGLE):
        inside = at + i < first[1:][owner]
        out[inside] += h[at[inside] + i] * _WORD[i]
    return mixed(out), owner


def weighted(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle, its text, its weight)."""
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return x[at], owner[at], np.diff(np.append(at, len(x)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def signatures(x: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots hashes of the earliest points; 0 for texts without shingles."""
    first = np.full(n * slots, np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    limit = np.zeros(n)
    todo = total > 0
    limit[todo] = slots * (np.log(slots) + 5) / total[todo]
    # strips of the weight axis that a shingle's weight reaches into
    strips = [(x, owner, weight, 0, 0.0, 1.0)]
    for k in range(1, 64):
        low = float(1 << (k - 1))
        into = np.flatnonzero(weight > low)
        if not len(into):
            break
        strips.append((x[into], owner[into], weight[into], k, low, low))
    while todo.any():
        for sx, so, sw, k, low, width in strips:
            active = np.flatnonzero(todo[so])
            seed = mixed(sx[active] + _times(k + 1))
            who, high, time = so[active], sw[active], np.zeros(len(active))
            step = 0
            while len(who):
                step += 1
                draw = mixed(seed + _times(step))
                time = time - np.log(_uniform(draw)) / width
                go = time <= limit[who]
                seed, who, high, time, draw = seed[go], who[go], high[go], time[go], draw[go]
                place = mixed(draw ^ _GOLDEN)
                # a point counts if its height in the strip lies under the weight
                under = low + _uniform(mixed(place)) * width <= high
                np.minimum.at(first, who[under] * slots + (place[under] % np.uint64(slots)).astype(np.int64), time[under])
        todo &= ~np.isfinite(first).reshape(n, slots).all(axis=1)
        limit[todo] *= 2
    out = np.zeros(n * slots, np.uint64)
    seen = np.isfinite(first)
    out[seen] = mixed(first[seen].view(np.uint64)) | np.uint64(1)
    return out.reshape(n, slots)


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in the same places."""
    (xa, oa), (xb, ob) = shingles(a), shingles(b)
    x, owner = np.concatenate([xa, xb]), np.concatenate([oa, ob])
    left = np.concatenate([np.ones(len(xa), np.int64), np.zeros(len(xb), np.int64)])
    out = np.zeros(len(a))
    if not len(x):
        return out
    order = np.lexsort((x, owner))
    x, owner, left = x[order], owner[order], left[order]
    at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])))
    ca = np.add.reduceat(left, at)
    cb = np.diff(np.append(at, len(x))) - ca
    both = np.bincount(owner[at], weights=np.minimum(ca, cb), minlength=len(a))
    either = np.bincount(owner[at], weights=np.maximum(ca, cb), minlength=len(a))
    return np.divide(both, either, out=out, where=either > 0)


def _node(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, bmh_node, bmh_bands (band hashes), bmh_slots (16 bits of each slot) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands = SLOTS // BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.array([hash64(f"slot {i}".encode()) | 1 for i in range(BAND)], np.uint64)
        salt = np.array([hash64(f"band {i}".encode()) for i in range(bands)], np.uint64)
        for part in slices(batches):
            n = part.num_rows
            sig = signatures(*weighted(*shingles(texts(part))), n)
            keys = mixed((sig.reshape(n, bands, BAND) * spread).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)
            some = sig[:, 0] != 0
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32), pa.array(keys[some].ravel()))
            short = [row.tobytes() for row in (sig >> np.uint64(48)).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("bmh_node"), lists, pa.array(short, pa.binary())], ["doc_id", "bmh_node", "bmh_bands", "bmh_slots"])

    rows = docs.select("doc_id", "text", _node().alias("bmh_node"))
    return rows.mapInArrow(run, f"doc_id {kind}, bmh_node binary, bmh_bands array<bigint>, bmh_slots binary")


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """bmh_node and text of the given nodes, a row each."""
    return docs.select(_node().alias("bmh_node"), "text").join(nodes, "bmh_node", "left_semi").groupBy("bmh_node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, found: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar, with the similarity."""
    both = pairs.join(found.select(F.col("bmh_node").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("bmh_node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="text_a"):
            score = similarity(texts(part, "text_a"), texts(part, "text_b"))
            keep = pa.array(score >= similar - 1e-12)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(score)], ["a", "b", "similarity"]).filter(keep)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """bmh_node and bmh_class (least node of the component) for every node of the links (a, b)."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("bmh_node")).agg(F.least(F.first("a"), F.min("b")).alias("bmh_class")), "labels")
    while True:
        least = both.join(labels.withColumnRenamed("bmh_node", "b"), "b").groupBy(F.col("a").alias("bmh_node")).agg(F.min("bmh_class").alias("near"))
        step = labels.join(least, "bmh_node").select("bmh_node", "bmh_class", F.least("bmh_class", "near").alias("low"))
        # follow the new label to its own label, which halves long chains
        onward = labels.select(F.col("bmh_node").alias("low"), F.col("bmh_class").alias("far"))
        after = saved(step.join(onward, "low").select("bmh_node", F.least("low", "far").alias("bmh_class"), (F.least("low", "far") != F.col("bmh_class")).alias("moved")), "labels")
        moving = after.where("moved").limit(1).count()
        labels = after.select("bmh_node", "bmh_class")
        if not moving:
            return labels


def leader_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of nodes in buckets of several: bmh_key, bmh_node; pairs of each with the bucket's leaders)."""
    members = nodes.select("bmh_node", F.explode("bmh_bands").alias("bmh_key"))
    buckets = members.groupBy("bmh_key").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(members.join(buckets, "bmh_key"), "buckets")
    # the text that others were copied from shares the most buckets with them
    central = shared.groupBy("bmh_node").agg(F.sum("n").alias("meets"))
    ranked = shared.join(central, "bmh_node")
    leaders = ranked.groupBy("bmh_key").agg(F.max(F.struct("meets", "bmh_node"))["bmh_node"].alias("l0"), F.min(F.struct(F.xxhash64("bmh_node").alias("h"), "bmh_node"))["bmh_node"].alias("l1"))
    pairs = shared.join(leaders, "bmh_key").select(F.explode(F.array_distinct(F.array("l0", "l1"))).alias("a"), F.col("bmh_node").alias("b")).where("a != b")
    # a pair of leaders is met from both sides
    return shared, saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _links_between(table: pa.Table) -> pa.Table:
    """Links that join components, among the rows of two blocks: at most one less than there are components."""
    table = table.combine_chunks()
    names, classes = table["bmh_node"].to_pylist(), table["bmh_class"].to_pylist()
    number = {c: k for k, c in enumerate(dict.fromkeys(classes))}
    parent, own = list(range(len(number))), [number[c] for c in classes]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    a, b = [], []
    if len(number) > 1:
        slot = np.frombuffer(b"".join(table["bmh_slots"].to_pylist()), np.uint16).reshape(-1, SLOTS)
        x, owner, weight = weighted(*shingles(texts(table.to_batches()[0])))
        bound = np.searchsorted(owner, np.arange(len(names) + 1))
        block, i, j = table["bmh_block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        right = np.flatnonzero(block == j)
        for u in np.flatnonzero(block == i).tolist():
            share = (slot[right] == slot[u]).mean(axis=1)
            xu, wu = x[bound[u] : bound[u + 1]], weight[bound[u] : bound[u + 1]]
            for k in np.argsort(-share, kind="stable"):
                if share[k] < MAYBE:
                    break
                v = int(right[k])
                if root(own[u]) == root(own[v]):
                    continue
                xv, wv = x[bound[v] : bound[v + 1]], weight[bound[v] : bound[v + 1]]
                at = np.minimum(np.searchsorted(xv, xu), len(xv) - 1)
                both = np.minimum(wu, wv[at])[xv[at] == xu].sum()
                if both >= (SIMILAR - 1e-12) * (wu.sum() + wv.sum() - both):
                    parent[root(own[u])] = root(own[v])
                    a.append(names[u])
                    b.append(names[v])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def rest_links(shared: DataFrame, nodes: DataFrame, labels: DataFrame, found: DataFrame) -> DataFrame | None:
    """Links between components that share a bucket; None if no two do.

    Components that share buckets form a family. Its nodes are dealt into blocks, those of its largest component and
    the others apart; each block of others meets every block of the family, so all pairs of different components are
    compared, but pairs within the largest are not.
    """
    labelled = shared.select("bmh_key", "bmh_node").join(labels, "bmh_node", "left").withColumn("bmh_class", F.coalesce("bmh_class", "bmh_node"))
    labelled = saved(labelled, "labelled")
    several = labelled.groupBy("bmh_key").agg(F.min("bmh_class").alias("a"), F.max("bmh_class").alias("z")).where("a != z")
    touching = saved(labelled.join(several, "bmh_key").select("a", F.col("bmh_class").alias("b")).where("a != b").distinct(), "touching")
    if not touching.limit(1).count():
        return None
    families = components(touching).select(F.col("bmh_node").alias("bmh_class"), F.col("bmh_class").alias("bmh_family"))
    members = saved(labelled.select("bmh_node", "bmh_class").distinct().join(families, "bmh_class"), "members")
    sizes = members.groupBy("bmh_family", "bmh_class").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("bmh_family").agg(F.max(F.struct("n", "bmh_class")).alias("big"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    whole = whole.select("bmh_family", F.col("big.bmh_class").alias("bmh_big"), blocks(F.col("n") - F.col("big.n")).alias("others"), blocks(F.col("big.n")).alias("bigs"))
    dealt = members.join(whole, "bmh_family").withColumn("bmh_block", F.when(
        F.col("bmh_class") == F.col("bmh_big"), F.col("others") + F.pmod(F.xxhash64("bmh_node"), "bigs").cast("int")
    ).otherwise(F.pmod(F.xxhash64("bmh_node"), "others").cast("int")))
    last = F.when(F.col("bmh_block") < F.col("others"), F.col("others") + F.col("bigs")).otherwise(F.col("others")) - 1
    rows = dealt.join(nodes.select("bmh_node", "bmh_slots"), "bmh_node").join(found, "bmh_node").withColumn("bmh_other", F.explode(F.sequence(F.lit(0), last)))
    sent = rows.select("bmh_family", F.least("bmh_block", "bmh_other").alias("i"), F.greatest("bmh_block", "bmh_other").alias("j"), "bmh_block", "bmh_node", "bmh_class", "bmh_slots", "text")
    return sent.groupBy("bmh_family", "i", "j").applyInArrow(_links_between, "a binary, b binary")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, bmh_node, class_id (least id of the class), class_size (rows), and first: whether the row names the class."""
    ready(docs.sparkSession)
    rows = saved(signed(docs), "signed")
    nodes = saved(rows.groupBy("bmh_node").agg(F.first("bmh_bands").alias("bmh_bands"), F.first("bmh_slots").alias("bmh_slots")), "nodes")
    shared, pairs = leader_pairs(nodes)
    found = saved(node_texts(docs, shared.select("bmh_node").distinct()), "texts")
    links = saved(verified(pairs, found), "verified")
    labels = components(links)
    more = rest_links(shared, nodes, labels, found)
    if more is not None:
        labels = components(links.select("a", "b").union(saved(more, "rest")))
    members = rows.select("doc_id", "bmh_node").join(labels, "bmh_node", "left").withColumn("bmh_class", F.coalesce("bmh_class", "bmh_node"))
    # the least id, nulls last; among equal ids the least text
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "bmh_node"))
    classes = members.groupBy("bmh_class").agg(least.alias("least"), F.count("*").alias("class_size"))
    return members.join(classes, "bmh_class").select(
        "doc_id", "bmh_node", F.col("least.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("bmh_node") == F.col("least.bmh_node"))).alias("first"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns."""
    firsts = saved(classify(docs).where("first").groupBy("doc_id", "bmh_node").agg(F.count("*").alias("bmh_rows")), "firsts")
    keyed = docs.withColumn("bmh_node", _node()).withColumn("bmh_id", F.col("doc_id"))
    keys = firsts.select(F.col("doc_id").alias("bmh_id2"), F.col("bmh_node").alias("bmh_node2"), "bmh_rows")
    kept = keyed.join(keys, (F.col("bmh_node") == F.col("bmh_node2")) & F.col("bmh_id").eqNullSafe(F.col("bmh_id2")))
    # only rows that repeat both id and text need to be told apart
    once = kept.where("bmh_rows = 1").select(*docs.columns)
    again = kept.where("bmh_rows > 1").dropDuplicates(["bmh_id", "bmh_node"]).select(*docs.columns)
    return once.union(again)
