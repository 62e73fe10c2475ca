"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are grown on a bounded sample; every vector is then routed to one leaf of each. A query walks all trees
through one priority queue of nodes, ordered by the best estimate for a leaf below (its mean direction, at the length of
its longest vector), until the leaves it popped hold enough vectors. Their vectors are reranked exactly, in double precision.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm.common import cut

TREES = 4
#: most vectors that the trees are grown on, about; and how many of them a leaf keeps
SAMPLE = 60_000
LEAF = 16
#: vectors in one block of leaves, about
BLOCK = 8192
#: queries that one product is made with
CHUNK = 256
TOP = 20


def candidates_for(n: int) -> int:
    """How many vectors the leaves that a query pops hold together, one found by several trees counted for each: a share
    that falls as n grows, but all of a few."""
    return int(max(4000, 5.3 * n**0.7))


def grow(x: np.ndarray, seed: int, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree in arrays, by level: direction and threshold of each inner node, left child (right is next to it), mean of
    every node, number of a leaf. Each split is between two random means, at the median."""
    random = np.random.default_rng(seed)
    nodes: list[list] = [[None, 0.0, -1, None, -1]]
    todo, leaves = [(0, np.arange(len(x)))], 0
    for at, ids in todo:
        own = x[ids]
        nodes[at][3] = own.mean(0) if len(ids) else np.zeros(x.shape[1])
        split = None
        if len(ids) > leaf:
            near = own[random.choice(len(ids), min(len(ids), 256), replace=False)]
            a, b = near[0], near[-1]
            for _ in range(2):
                side = near @ (a - b) >= (a - b) @ (a + b) / 2
                if side.all() or not side.any():
                    break
                a, b = near[side].mean(0), near[~side].mean(0)
            w = a - b
            if (length := np.linalg.norm(w)) > 1e-12:
                v = own @ (w / length)
                t = np.median(v)
                left = v < t
                if left.any() and not left.all():
                    split = (w / length, t, left)
        if split is None:
            nodes[at][4] = leaves
            leaves += 1
            continue
        nodes[at][:3] = [split[0], split[1], len(nodes)]
        todo += [(len(nodes), ids[split[2]]), (len(nodes) + 1, ids[~split[2]])]
        nodes += [[None, 0.0, -1, None, -1], [None, 0.0, -1, None, -1]]
    zero = np.zeros(x.shape[1])
    mean = np.array([n[3] for n in nodes])
    return {
        "w": np.array([zero if n[0] is None else n[0] for n in nodes], np.float32), "t": np.array([n[1] for n in nodes], np.float32), "left": np.array([n[2] for n in nodes]),
        "mean": (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32), "leaf": np.array([n[4] for n in nodes]),
    }


def route(tree: dict, x: np.ndarray) -> np.ndarray:
    """The node number of the leaf of each vector."""
    at = np.zeros(len(x), np.int64)
    x = x.astype(np.float32)
    while True:
        inner = np.flatnonzero(tree["left"][at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = tree["left"][node] + (np.einsum("ij,ij->i", x[inner], tree["w"][node]) >= tree["t"][node])


def leaves_in_order(tree: dict) -> list[int]:
    """The leaf nodes from left to right, so that neighbours in the list are near in space."""
    out, stack = [], [0]
    while stack:
        node = stack.pop()
        left = int(tree["left"][node])
        if left < 0:
            out.append(node)
        else:
            stack += [left + 1, left]
    return out


def blocks_of(trees: list[dict], sizes: list[np.ndarray], most: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree, each node's first block and number of blocks: neighbouring leaves share a block of about `most`
    vectors, a larger leaf has several blocks, between which its vectors are dealt by hash."""
    out, free = [], 0
    for tree, size in zip(trees, sizes, strict=True):
        first, many, held = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0
        free += 1
        for node in leaves_in_order(tree):
            n = int(size[node])
            if not n:
                continue
            if held and held + n > most:
                free, held = free + 1, 0
            first[node], many[node] = free, max(1, -(-n // most))
            held += n
            if many[node] > 1:
                free, held = free + int(many[node]), 0
        free += 1
        out.append((first, many))
    return out


def bounds_of(tree: dict, query: np.ndarray) -> np.ndarray:
    """For each node the best leaf below it: inner product of the query and the leaf's mean, stretched to its longest vector."""
    near = tree["mean"] @ query.astype(np.float32)
    near[tree["empty"]] = -np.inf
    for inner in reversed(tree["levels"]):
        left = tree["left"][inner]
        near[inner] = np.maximum(near[left], near[left + 1])
    return near


def search(trees: list[dict], sizes: list[list[int]], query: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(tree, leaf node) of the leaves that one priority queue over all trees pops until they hold `most` vectors."""
    bound = [bounds_of(t, query).tolist() for t in trees]
    queue = [(-b[0], k, 0) for k, b in enumerate(bound)]
    heapq.heapify(queue)
    pop, push, out, held = heapq.heappop, heapq.heappush, [], 0
    while queue and held < most:
        _, k, node = pop(queue)
        left = trees[k]["children"][node]
        if left >= 0:
            push(queue, (-bound[k][left], k, left))
            push(queue, (-bound[k][left + 1], k, left + 1))
        elif n := sizes[k][node]:
            out.append((k, node))
            held += n
    return out


def _levels(left: np.ndarray) -> list[np.ndarray]:
    """The inner nodes, level by level from the root."""
    out, at = [], np.array([0])
    while len(at := at[left[at] >= 0]):
        out.append(at)
        at = np.concatenate([left[at], left[at] + 1])
    return out


def with_means(tree: dict, total: np.ndarray, size: np.ndarray, longest: np.ndarray) -> dict:
    """The tree with the directions and lengths of all vectors in place of the sample's; all three are given for its leaves."""
    tree = tree | {"levels": _levels(tree["left"]), "children": tree["left"].tolist(), "empty": np.flatnonzero((tree["left"] < 0) & (size == 0))}
    tree["mean"] = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12) * longest[:, None]).astype(np.float32)
    return tree


def _clean(batches, width: int):
    """Usable vectors: (id, float64 bytes); those null, zero, of another width or with null or non-finite parts go."""
    for batch in batches:
        column = batch.column(1)
        lengths = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero((lengths == width) & np.asarray(pa.compute.is_valid(batch.column(0))))
        x = pa.compute.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[ok])), pa.array([r.tobytes() for r in x[ok] + 0.0], pa.binary())], ["id", "v"])


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _totals(batches, trees: list[dict], width: int):
    """For each leaf that this partition's vectors reach: their number, sum and greatest length."""
    size = [np.zeros(len(t["left"]), np.int64) for t in trees]
    longest = [np.zeros(len(t["left"])) for t in trees]
    total = [np.zeros((len(t["left"]), width)) for t in trees]
    for batch in batches:
        x = _matrix(batch.column(0), width)
        for k, tree in enumerate(trees):
            at = route(tree, x)
            size[k] += np.bincount(at, minlength=len(size[k]))
            np.add.at(total[k], at, x)
            np.maximum.at(longest[k], at, np.linalg.norm(x, axis=1))
    for k in range(len(trees)):
        used = np.flatnonzero(size[k])
        yield pa.RecordBatch.from_pydict({"tree": pa.array([k] * len(used), pa.int32()), "leaf": pa.array(used, pa.int32()), "n": size[k][used], "longest": longest[k][used], "total": pa.array([r.tobytes() for r in total[k][used]], pa.binary())})


_ROW = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("leaves", pa.binary()), ("key", pa.binary()), ("v", pa.binary()), ("ids", pa.binary())])


def _deal_vectors(batches, trees: list[dict], blocks: list, width: int):
    for batch in batches:
        keys, vs = batch.column(0), batch.column(1)
        ids = [np.array(i, np.int64).tobytes() for i in batch.column(2).to_pylist()]
        x, n = _matrix(vs, width), batch.num_rows
        spread = np.frombuffer(b"".join(k[:8] for k in keys.to_pylist()), np.uint64)
        for k, tree in enumerate(trees):
            at = route(tree, x)
            first, many = blocks[k]
            block = first[at] + (spread % many[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.zeros(n, np.int32)), pa.array([b.tobytes() for b in at.astype(np.int32)], pa.binary()), keys, vs, pa.array(ids, pa.binary())], schema=_ROW)


def _deal_queries(batches, trees: list[dict], sizes: list[np.ndarray], blocks: list, width: int, most: int):
    places = [list(zip(first.tolist(), many.tolist(), strict=True)) for first, many in blocks]
    for batch in batches:
        vs = batch.column(1)
        out: list[tuple] = []
        held = [s.tolist() for s in sizes]
        for key, v, x in zip(batch.column(0).to_pylist(), vs.to_pylist(), _matrix(vs, width), strict=True):
            found: dict[int, list[int]] = {}
            for k, leaf in search(trees, held, x, most):
                first, many = places[k][leaf]
                for b in range(first, first + many):
                    found.setdefault(b, []).append(leaf)
            out += [(b, 1, np.array(leaves, np.int32).tobytes(), key, v, b"") for b, leaves in found.items()]
            if len(out) > 5000:
                yield _packed(out)
                out = []
        yield _packed(out)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def nearest_of(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` best (score, id), best first, ties to the smaller id; an id that comes twice counts once."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:most]
    return scores[keep], ids[keep]


def _score(batches, width: int, most: int):
    """Rows sorted by (block, role): first the vectors of a block, then, in chunks, its queries, each with its leaves.

    Out comes, for each query and block, the best `most` (score, id) as bytes.
    """
    block, leaf, vs, ids, ready, waiting = None, [], [], [], None, []

    def scored():
        nonlocal ready
        if ready is None:
            v = np.frombuffer(b"".join(vs), np.float64).reshape(-1, width)
            lists = [np.frombuffer(i, np.int64) for i in ids]
            leaves, place = np.unique(np.frombuffer(b"".join(leaf), np.int32), return_inverse=True)
            ready = (v, lists, leaves, place.ravel(), np.array([x[0] for x in lists], np.int64))
        v, lists, leaves, place, least = ready
        q = np.frombuffer(b"".join(w[1] for w in waiting), np.float64).reshape(-1, width)
        s = q @ v.T
        for (key, _, own), row, x in zip(waiting, s, q, strict=True):
            mine = np.isin(leaves, np.frombuffer(own, np.int32))[place]
            at = np.flatnonzero(mine)
            r = row[at]
            if len(r) > most:  # rounding aside, the best `most` and whatever ties with the last of them
                edge = np.partition(r, len(r) - most)[len(r) - most]
                at = at[r >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = np.add.reduce(v[at] * x, axis=1)  # the same sum in whatever block
            if len(at) > 4 * most:
                order = np.lexsort((least[at], -exact))[:most]
                at, exact = at[order], exact[order]
            best, who = nearest_of(np.repeat(exact, [len(lists[i]) for i in at]), np.concatenate([lists[i] for i in at]) if len(at) else np.zeros(0, np.int64), most)
            yield key, best.tobytes() + who.tobytes()

    def out():
        rows = list(scored())
        waiting.clear()
        return pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.binary()), "found": pa.array([r[1] for r in rows], pa.binary())})

    for batch in batches:
        for b, role, leaves, key, v, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                if waiting:
                    yield out()
                block, leaf, vs, ids, ready = b, [], [], [], None
            if role == 0:
                leaf.append(leaves)
                vs.append(v)
                ids.append(own)
            else:
                waiting.append((key, v, leaves))
                if len(waiting) == CHUNK:
                    yield out()
    if waiting:
        yield out()


def _merge(batches, most: int):
    """One row a key from rows sorted by key: the best `most` of all its blocks."""
    current, scores, ids = None, np.zeros(0), np.zeros(0, np.int64)
    done: list[tuple] = []

    def out():
        rows = [(k, [{"id": int(i), "score": float(s)} for s, i in zip(a, b, strict=True)]) for k, a, b in done]
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))], ["key", "near"]
        )

    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != current:
                if current is not None:
                    done.append((current, scores, ids))
                current, scores, ids = key, np.zeros(0), np.zeros(0, np.int64)
            n = len(data) // 16
            scores, ids = nearest_of(np.append(scores, np.frombuffer(data[: 8 * n], np.float64)), np.append(ids, np.frombuffer(data[8 * n :], np.int64)), most)
        if len(done) > 2000:
            yield out()
    if current is not None:
        done.append((current, scores, ids))
    yield out()


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, trees: int = TREES, most: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` the `top` vectors of largest inner product that
    the forest finds, nearest first, ties to the smaller vec_id; a query is no candidate of its own.

    Vectors null, zero, or with null or non-finite components take no part, nor do those without vec_id or of another
    width than most have; of repeated vec_ids the smallest vector counts. Fewer candidates give fewer rows, none give
    none; other columns are ignored. `most`: vectors a query looks at (None: candidates_for their number).

    Equal vectors are folded: of each only the top + 1 smallest ids can be among anyone's nearest, so a vector that is
    a third of all rows costs one comparison a query, and as many queries are answered by one search. Trees are grown
    on a sample of about SAMPLE vectors; all vectors are routed, and leaves know the means of all that they hold. What
    is collected (sample, sums of leaves) is bounded by the size of the trees.
    """
    source = vectors.select(F.col("vec_id").cast("bigint").alias("id"), "embedding")
    widths = source.where("embedding is not null").groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 0
    usable = source.mapInArrow(partial(_clean, width=width), "id bigint, v binary") if width else source.select("id", F.lit(b"").alias("v")).limit(0)
    held = cut(usable.groupBy("id").agg(F.min("v").alias("v")).withColumn("key", F.unhex(F.md5("v"))))  # 128 bits stand for a vector
    ranked = held.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= top + 1)
    classes = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("key").alias("key")).select("key", "v", "ids"))
    n = classes.count()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return held.sparkSession.createDataFrame([], out)
    share = min(1_000_000, int(1_000_000 * SAMPLE / n) + 1)
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < share).select("v").toArrow()
    x = _matrix(sample.column("v"), width)
    x = x[np.lexsort(x.T[:4])]
    grown = [grow(x, seed) for seed in range(trees)]
    sums = classes.select("v").mapInArrow(partial(_totals, trees=grown, width=width), "tree int, leaf int, n bigint, longest double, total binary")
    sizes, longest, totals = [np.zeros(len(t["left"]), np.int64) for t in grown], [np.zeros(len(t["left"])) for t in grown], [np.zeros((len(t["left"]), width)) for t in grown]
    parts = sums.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf").mapInArrow(partial(_sum_leaves, width=width), sums.schema)
    for k, leaf, m, far, total in zip(*(c.to_pylist() for c in parts.toArrow().columns), strict=True):  # a row a leaf
        sizes[k][leaf], longest[k][leaf], totals[k][leaf] = m, far, np.frombuffer(total, np.float64)
    grown = [with_means(*x) for x in zip(grown, totals, sizes, longest, strict=True)]
    blocks = blocks_of(grown, sizes)

    asked = held.where(F.col("id") % every == 0).select("id", "key", "v")
    queries = classes.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    row = "block bigint, role int, leaves binary, key binary, v binary, ids binary"
    dealt = classes.mapInArrow(partial(_deal_vectors, trees=grown, blocks=blocks, width=width), row)
    sent = queries.mapInArrow(partial(_deal_queries, trees=grown, sizes=sizes, blocks=blocks, width=width, most=most or candidates_for(n)), row)
    both = dealt.unionByName(sent).repartition("block").sortWithinPartitions("block", "role")
    found = both.mapInArrow(partial(_score, width=width, most=top + 1), "key binary, found binary")
    merged = found.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_merge, most=top + 1), "key binary, near array<struct<id:bigint,score:double>>")
    near = asked.select(F.col("id").alias("query_id"), "key").join(merged, "key")
    near = near.select("query_id", F.slice(F.filter("near", lambda c: c["id"] != F.col("query_id")), 1, top).alias("near"))
    return near.select("query_id", F.posexplode("near").alias("at", "c")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), F.col("c.score").alias("score"))


def _sum_leaves(batches, width: int):
    current, n, far, total, rows = None, 0, 0.0, np.zeros(width), []
    for batch in batches:
        for tree, leaf, m, longest, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (tree, leaf) != current:
                if current is not None:
                    rows.append((*current, n, far, total.tobytes()))
                current, n, far, total = (tree, leaf), 0, 0.0, np.zeros(width)
            n, far, total = n + m, max(far, longest), total + np.frombuffer(part, np.float64)
    if current is not None:
        rows.append((*current, n, far, total.tobytes()))
    columns = zip(*rows, strict=True) if rows else [[], [], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["tree", "leaf", "n", "longest", "total"])
