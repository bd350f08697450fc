"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label are compared by cosine. Equal vectors are one node. The
unit vectors are turned onto their principal axes, which keeps all distances,
and sorted by the grid cells, of side epsilon, of the leading axes. The sorted
sequence is cut into blocks; blocks whose bounds are further apart than epsilon
on the leading axes are skipped, the others are joined by halving intervals of
the two sequences until an interval is skipped or small enough to compare.

The leading coordinates go first: a pair of blocks yields the vectors that have
another one within epsilon on these axes. Only such vectors then meet whole, and
the same recursion decides by their cosines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stash
from lodestone.llm.graph import components

LEADING = 12  # axes that the bounds use; their coordinates are the first to be sent
GRID = 6  # and axes whose cells order the vectors
BLOCK = 4096  # vectors of a block
LEAF = 64  # vectors of an interval that is compared without halving
MEETING = 2000  # blocks of a label's cell that look for partners in one task
_SLACK = 1e-6  # of squared distances, against rounding of the coordinates; cosines alone decide


def _is_comparable() -> F.Column:
    """True for vectors that can link: a label, finite components only, not all of them zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    return F.coalesce(fine, F.lit(False))


def _units(batch: pa.RecordBatch, name: str = "embedding") -> list[np.ndarray]:
    vectors = (np.array(x, np.float64) for x in batch.column(name).to_pylist())
    # By the largest component first, as squares of very large or small ones are out of range.
    return [v / math.sqrt(v @ v) for v in (v / np.abs(v).max() for v in vectors)]


def principal_axes(nodes: DataFrame, joined: int = 32) -> dict[int, np.ndarray]:
    """The leading principal axes of the unit vectors of each dimension.

    Second moments are summed over all vectors, as whole matrices: a task gives
    one for each dimension, ``joined`` tasks sum these up, and that many come to
    the driver. Any axes would give the same links.
    """

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups: dict[int, list] = {}
            for v in _units(batch):
                groups.setdefault(len(v), []).append(v)
            for d, vs in groups.items():
                m = np.array(vs)
                sums[d] = sums.get(d, 0) + m.T @ m
        yield from packed(sums)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[d] = sums.get(d, 0) + np.frombuffer(m.as_py()).reshape(d, d)
        yield from packed(sums)

    def packed(sums):
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([m.tobytes()], pa.binary())], ["d", "m"])

    schema = "d long, m binary"
    found: dict[int, np.ndarray] = {}
    for r in nodes.select("embedding").mapInArrow(partial, schema).repartition(joined).mapInArrow(total, schema).collect():
        found[r["d"]] = found.get(r["d"], 0) + np.frombuffer(r["m"]).reshape(r["d"], r["d"])
    return {d: np.linalg.eigh(m)[1][:, ::-1][:, :LEADING] for d, m in found.items()}


def _leading(units: list[np.ndarray], axes: dict[int, np.ndarray]) -> np.ndarray:
    """The coordinates on the leading axes, zeros beyond the dimension."""
    return np.array([np.pad(v @ axes[len(v)], (0, max(0, LEADING - len(v)))) for v in units], np.float32).reshape(-1, LEADING)


def _blocks(nodes: DataFrame, shared, epsilon: float) -> DataFrame:
    """Blocks of the vectors in grid order: bounds and coordinates on the leading axes.

    ``shared`` is the broadcast of the axes, LEADING columns for each dimension.
    """

    def project(batches):
        for batch in batches:
            units = _units(batch)
            leading = _leading(units, shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    pa.array([len(v) for v in units], pa.int64()),
                    pa.array(np.floor(leading[:, :GRID] / epsilon).astype(int).tolist(), pa.list_(pa.int64())),
                    batch.column("node"),
                    pa.array([x.tobytes() for x in leading], pa.binary()),
                ],
                ["label", "d", "cells", "node", "leading"],
            )

    order = ["label", "d", "cells", "node"]
    ordered = nodes.mapInArrow(project, "label long, d long, cells array<long>, node long, leading binary").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        key, held = None, []

        def done():
            node, leading = zip(*held, strict=True)
            x = np.frombuffer(b"".join(leading), np.float32).reshape(len(held), LEADING)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.int64()),
                    pa.array([key[1]], pa.int64()),
                    pa.array([node[0]], pa.int64()),
                    pa.array([x.min(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([x.max(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([np.array(node, np.int64).tobytes()], pa.binary()),
                    pa.array([x.tobytes()], pa.binary()),
                ],
                ["label", "d", "block", "lo", "hi", "nodes", "leading"],
            )

        for batch in batches:
            for label, d, *row in zip(*(batch.column(c).to_pylist() for c in ("label", "d", "node", "leading")), strict=True):
                if held and ((label, d) != key or len(held) >= BLOCK):
                    yield done()
                    held.clear()
                key = label, d
                held.append(row)
        if held:
            yield done()

    return ordered.mapInArrow(cut, "label long, d long, block long, lo array<double>, hi array<double>, nodes binary, leading binary")


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b) of all blocks, a before or at b, whose bounds are within epsilon.

    The pairs meet by the label and a cell of the two first axes: each block
    stands in its own cells, and for the search in those next to them too. Of the
    cells that two blocks share only the first one counts. Blocks that look for
    partners are dealt out by a salt whose range follows the number of blocks.
    """
    bounds = blocks.select("label", "d", "block", "lo", "hi")
    salts = 1 + bounds.count() // MEETING
    cell = lambda c, axis, k: F.floor((F.get(F.col(c), F.lit(axis)) + k * _SLACK) / epsilon) + k

    def placed(side: DataFrame, reach: int) -> DataFrame:
        firsts = side.withColumns({f"first{axis}": cell("lo", axis, -reach) for axis in (0, 1)})
        spread = firsts.withColumn("c0", F.explode(F.sequence(F.col("first0"), cell("hi", 0, reach))))
        return spread.withColumn("c1", F.explode(F.sequence(F.col("first1"), cell("hi", 1, reach))))

    left = placed(bounds, 1).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    right = placed(bounds, 0).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gap = F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.lit(LEADING - 1)),
            lambda k: F.greatest(F.get("l.lo", k) - F.get("r.hi", k), F.get("r.lo", k) - F.get("l.hi", k), F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda a, x: a + x * x,
    )
    first = [F.col(f"c{axis}") == F.greatest(f"l.first{axis}", f"r.first{axis}") for axis in (0, 1)]
    return (
        left.alias("l")
        .join(right.alias("r"), ["label", "d", "c0", "c1", "salt"])
        .where((F.col("l.block") <= F.col("r.block")) & first[0] & first[1] & (gap <= epsilon * epsilon + _SLACK))
        .select(F.col("l.block").alias("a"), F.col("r.block").alias("b"))
    )


def _apart(x: np.ndarray, y: np.ndarray, epsilon: float) -> bool:
    """True if the bounds of two intervals are further apart than epsilon."""
    gap = np.maximum(np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)), 0)
    return gap @ gap > epsilon * epsilon + _SLACK


def join_intervals(x: np.ndarray, y: np.ndarray, epsilon: float, at: tuple[int, int] = (0, 0), same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of two sequences of coordinates that lie within epsilon.

    ``same`` compares a sequence with itself, each pair once. At most LEAF times
    LEAF pairs come at once.
    """
    if not same and _apart(x, y, epsilon):
        return
    if max(len(x), len(y)) <= LEAF:
        u, v = x.astype(np.float64), y.astype(np.float64)
        apart = (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (u @ v.T)
        near = apart <= epsilon * epsilon + _SLACK
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if len(i):
            yield i + at[0], j + at[1]
        return
    if same:
        h = len(x) // 2
        yield from join_intervals(x[:h], x[:h], epsilon, at, True)
        yield from join_intervals(x[h:], x[h:], epsilon, (at[0] + h, at[1] + h), True)
        yield from join_intervals(x[:h], x[h:], epsilon, (at[0], at[1] + h))
    elif len(x) >= len(y):
        h = len(x) // 2
        yield from join_intervals(x[:h], y, epsilon, at)
        yield from join_intervals(x[h:], y, epsilon, (at[0] + h, at[1]))
    else:
        h = len(y) // 2
        yield from join_intervals(x, y[:h], epsilon, at)
        yield from join_intervals(x, y[h:], epsilon, (at[0], at[1] + h))


def _candidates(blocks: DataFrame, pairs: DataFrame, epsilon: float) -> DataFrame:
    """(a, b, d, second, node): the vectors of a pair of blocks that have one of the other within epsilon.

    ``second`` tells vectors of b from those of a.
    """
    left = blocks.select(F.col("block").alias("a"), "d", F.col("nodes").alias("nodes_a"), F.col("leading").alias("leading_a"))
    right = blocks.select(F.col("block").alias("b"), F.col("nodes").alias("nodes_b"), F.col("leading").alias("leading_b"))

    def run(batches):
        for batch in batches:
            for a, b, *raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "nodes_a", "nodes_b", "leading_a", "leading_b")), strict=True):
                nodes = [np.frombuffer(r, np.int64) for r in raw[:2]]
                x, y = (np.frombuffer(r, np.float32).reshape(-1, LEADING) for r in raw[2:])
                near = [np.zeros(len(n), bool) for n in nodes]
                for i, j in join_intervals(x, y, epsilon, same=a == b):
                    near[0][i] = True
                    near[a != b][j] = True
                for second in (False, True):
                    found = nodes[second][near[second]]
                    n = len(found)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array(np.full(n, b)), pa.array(np.full(n, second)), pa.array(found)], ["a", "b", "second", "node"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, second boolean, node long")


def _linked(u: np.ndarray, v: np.ndarray, node: np.ndarray, copies: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], at: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector and the least node that links reach from it.

    ``pairs`` holds positions in ``u`` and ``v``; ``at`` is where those of ``v``
    begin among all vectors (0 if they are the same).
    """
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for i, j in pairs:
        # One dot product a pair, so that its value doesn't depend on its neighbours.
        near = np.einsum("ij,ij->i", u[i], v[j]) >= cosine
        i, j = i[near], j[near] + at
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        r, s = parent[i], parent[j]
        for k in np.flatnonzero(r != s).tolist():
            p, q = root(int(r[k])), root(int(s[k]))
            parent[max(p, q)] = min(p, q)
    while True:
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    least = node.copy()
    np.minimum.at(least, parent, node)
    return links, least[parent]


def _links(candidates: DataFrame, nodes: DataFrame, shared, epsilon: float, cosine: float) -> DataFrame:
    """(node, links, root) of every node and pair of blocks with links.

    The root is the least node that links of this pair of blocks reach, so a
    pair gives at most a row a vector, however many links it holds.
    """
    order = ["a", "b", "second", "cells", "node"]

    def project(batches):
        for batch in batches:
            leading = _leading(_units(batch), shared.value)
            cells = pa.array(np.floor(leading[:, :GRID] / epsilon).astype(int).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    both = candidates.join(nodes.select("node", "copies", "embedding"), "node")
    element = dict(both.dtypes)["embedding"]
    placed = both.mapInArrow(project, f"node long, a long, b long, second boolean, copies long, embedding {element}, cells array<long>")
    rows = placed.repartition("a", "b").sortWithinPartitions(*order)

    def run(batches):
        key, held = None, []

        def done():
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            node, copies = joined.column("node").to_numpy(), joined.column("copies").to_numpy()
            units = _units(joined)
            x, u = _leading(units, shared.value), np.array(units)
            if key[0] == key[1]:
                links, roots = _linked(u, u, node, copies, join_intervals(x, x, epsilon, same=True), 0, cosine)
            else:
                h = int(np.searchsorted(joined.column("second").to_numpy(zero_copy_only=False), True))
                links, roots = _linked(u[:h], u[h:], node, copies, join_intervals(x[:h], x[h:], epsilon), h, cosine) if 0 < h < len(u) else (np.zeros(len(u), np.int64), node)
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (node, links, roots)], ["node", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if key != (a[lo], b[lo]):
                    if held:
                        yield done()
                    key, held = (a[lo], b[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Links and component of every vector; one row per row of ``vectors``.

    Two vectors of one label link if their cosine, in double precision, is at
    least ``cosine``. Columns: vec_id, n_links (other vectors linked directly),
    component_id (least vec_id reachable by links, itself included), kept
    (vec_id = component_id).

    A vector links with nothing if it, its label or a component is null, a
    component is not finite, or it is zero or empty; it is its own component.
    Vectors of different dimensions don't link. Equal rows are vectors of their
    own that link with each other. A null vec_id has no links, is kept, and its
    component is null. Vectors that share a vec_id are vectors of their own too;
    each may reach a component by itself. An empty table gives no rows; other
    columns are ignored.
    """
    epsilon = math.sqrt(2 - 2 * cosine)
    # Floats stay floats where they are sent; all arithmetic is in double precision.
    embedding = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), embedding.alias("embedding"))
    distinct = rows.where(_is_comparable()).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")  # a vec_id may stand for several vectors
    shared = nodes.sparkSession.sparkContext.broadcast(principal_axes(nodes))
    blocks = stash(_blocks(nodes, shared, epsilon), "blocks")
    pairs = stash(_block_pairs(blocks, epsilon), "block-pairs")
    candidates = stash(_candidates(blocks, pairs.repartition("a", "b"), epsilon), "candidates")
    found = stash(_links(candidates, nodes, shared, epsilon, cosine), "vector-links")
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = stash(
        nodes.join(links, "node", "left").join(classes, "node", "left").select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")),
        "vector-roots",
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    resolved = stash(rooted.drop("least").join(least, "root").drop("root"), "vector-classes")
    usable = rows.where(_is_comparable()).join(resolved, ["label", "embedding"]).select("vec_id", F.col("n").alias("n_links"), "component_id")
    alone = rows.where(~_is_comparable())
    return usable.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
