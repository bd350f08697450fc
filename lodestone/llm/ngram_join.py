"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Every text becomes its set of word n-grams. Texts with equal sets are one
   node from here on, whatever their number.
2. Every node gets a label in each of a number of trees: a sequence of MinHash
   values. Sorted labels are the prefix tries of the forest laid out flat. Nodes
   of one full label are compared first; then the prefix is shortened value by
   value, and each time only prefixes are compared whose nodes the longer ones
   left unconnected. It ends at the prefix with which the forest reaches the
   target recall for pairs at the threshold. All nodes of a prefix are compared,
   in blocks, whatever their number; pairs whose one-bit signatures are far
   apart are dropped.
3. The pairs form clusters. Within each cluster all pairs are compared exactly,
   in blocks, so a cluster of any size is shared out over tasks and no table of
   pairs is made: a block yields the number of links of each node and the
   spanning forest of the links.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches, stash, text_parts
from lodestone.llm.graph import components
from lodestone.llm.pretokens import SHORT, SHORT_MASKS

TREES = 20
DEPTH = 6  # MinHash values in a full label
BITS = 128  # of the one-bit signature
SMALL = 8  # nodes of a prefix whose pairs are compared without a matrix
BLOCK_LABELS = 2048  # nodes of a prefix that are compared at once
STRIP = 256  # and rows of that matrix made at once
BLOCK_NODES = 256
BLOCK_GRAMS = 1_500_000

_dice = np.random.RandomState(20)
_MULTIPLY = _dice.randint(0, 1 << 62, TREES * DEPTH + BITS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _dice.randint(0, 1 << 62, TREES * DEPTH + BITS, dtype=np.int64).astype(np.uint64)
_GRAM = _dice.randint(0, 1 << 62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def recall(depth: int, similarity: float, trees: int = TREES) -> float:
    """Share of pairs of a similarity that agree on a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, target: float) -> int:
    """The longest prefix that reaches the target recall, shortened from a full label."""
    depth = DEPTH
    while depth > 1 and recall(depth, similarity) < target:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SOLID = np.ones(256, np.int8)  # bytes of words: all but the space and tab to carriage return
_SOLID[[32, *range(9, 14)]] = 0


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a whole text, by its UTF-8 bytes.

    Words of up to 15 bytes are two integers with their length, which are mixed
    for all words at once.
    """
    data = text.encode() + b" " * 20
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(_SOLID[b], prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    keys = np.lib.stride_tricks.sliding_window_view(b, 16)[starts].view(np.uint64) & SHORT_MASKS[np.minimum(size, SHORT)]
    out = _mix(keys[:, 0] * _GRAM[62] + _mix(keys[:, 1] + (size.astype(np.uint64) << np.uint64(56))))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def grams(text: str | None, n: int) -> np.ndarray:
    """The sorted set of hashes of the word n-grams of a whole text.

    A text of fewer than ``n`` words is one gram of all its words; a text
    without words has none.
    """
    hashes = word_hashes(text or "")
    if not len(hashes):
        return np.empty(0, np.uint64)
    width = min(n, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out += hashes[k : len(hashes) - width + 1 + k] * _GRAM[k]
    return np.unique(_mix(out + np.uint64(width)))


def sketch(found: np.ndarray) -> tuple[bytes, bytes]:
    """Labels of all trees (16 bits a value) and the one-bit signature of a set."""
    least = np.full(len(_MULTIPLY), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    least = _mix(least)
    labels = (least[: TREES * DEPTH] >> np.uint64(48)).astype(">u2").tobytes()
    return labels, np.packbits((least[TREES * DEPTH :] & np.uint64(1)).astype(np.uint8)).tobytes()


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set, grams, labels, bits) of each document; null set where no word is."""

    def run(batches):
        for batch in text_parts(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                found = grams(text, n)
                rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), *sketch(found)) if len(found) else (None, 0, None, None))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "set", "grams", "labels", "bits"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, set binary, grams long, labels binary, bits binary")


def _near(one: np.ndarray, two: np.ndarray, screen: int, threshold: tuple[int, int]) -> np.ndarray:
    """Which rows of two blocks may be linked by their sizes and signatures.

    Rows are node, grams and the two halves of the signature, in the order of
    grams. Sets whose sizes differ by more than the threshold are never linked.
    """
    up, down = threshold
    out = np.zeros((len(one), len(two)), bool)
    sizes = two[:, 1].astype(np.int64)
    for at in range(0, len(one), STRIP):
        part = one[at : at + STRIP]
        lo = at if one is two else np.searchsorted(sizes, -(-up * int(part[0, 1]) // down))
        hi = np.searchsorted(sizes, down * int(part[-1, 1]) // up, "right")
        far = np.bitwise_count(part[:, 2, None] ^ two[None, lo:hi, 2]) + np.bitwise_count(part[:, 3, None] ^ two[None, lo:hi, 3])
        out[at : at + STRIP, lo:hi] = far <= screen
    return out | out.T if one is two else out


def _edges(rows: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """The spanning forest of a symmetric link matrix as pairs of nodes."""
    node = rows[:, 0].view(np.int64)
    roots = spanning_roots(linked)
    at = np.flatnonzero(roots != np.arange(len(roots)))
    yield from zip(node[at].tolist(), node[roots[at]].tolist(), strict=True)


def _trie_edges(rows: np.ndarray, labels: np.ndarray, depth: int, screen: int, threshold: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Edges that connect what passes the screen among nodes that share a prefix of ``depth`` values.

    ``labels`` holds the bytes of their tree and full labels, in order. Full
    labels come first. A shorter prefix is looked at only if longer ones left its
    nodes in several parts, and only once if shortening adds no node to it.
    """
    n = len(rows)
    part, seen = np.arange(n), set()
    for values in range(DEPTH, depth - 1, -1):
        same = (labels[1:, : 2 + 2 * values] == labels[:-1, : 2 + 2 * values]).all(axis=1)
        borders = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
        for lo, hi in zip(borders, borders[1:], strict=False):
            if hi - lo < 2 or (lo, hi) in seen or (part[lo:hi] == part[lo]).all():
                continue
            seen.add((lo, hi))
            by_size = lo + np.argsort(rows[lo:hi, 1], kind="stable")
            own = rows[by_size]
            roots = by_size[spanning_roots(_near(own, own, screen, threshold))]
            for i in np.flatnonzero(part[by_size] != part[roots]).tolist():
                one, two = part[by_size[i]], part[roots[i]]
                if one != two:
                    part[part == max(one, two)] = min(one, two)
                    yield int(rows[by_size[i], 0].view(np.int64)), int(rows[roots[i], 0].view(np.int64))


def _forest(nodes: DataFrame, depth: int, screen: int, threshold: tuple[int, int]) -> DataFrame:
    """Edges (u, v) that connect all nodes which share a prefix of ``depth`` values in a tree and pass the screen.

    The order is dealt out by ranges, with the node as the last key, so a prefix
    shared by any number of nodes is shared out. Each task compares its part of
    such a group in blocks; the blocks of groups that one block doesn't hold, or
    that a range's border parts, are then compared with each other, two to a row.
    """
    width, most, small, prefix = 2 * DEPTH, BLOCK_LABELS, SMALL, 2 + 2 * depth
    tries = nodes.select(
        "node",
        "grams",
        "bits",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("labels", t * width + 1, width))).alias("tree", "label"),
    )
    ordered = tries.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def link(pairs):
            for a, b in pairs:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)

        def block(rows, labels):
            link(_trie_edges(rows, labels, depth, screen, threshold))
            return labels[0, :prefix].tobytes(), rows[np.argsort(rows[:, 1], kind="stable")]

        def shared(blocks):
            """Blocks that others of the same prefix may exist for."""
            rows = [(key, uuid.uuid4().bytes, int(x[0, 1]), int(x[-1, 1]), x.tobytes()) for key, x in blocks]
            columns = [pa.nulls(len(rows), pa.int64())] * 2 + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["u", "v", "key", "block", "least", "most", "rows"]
        # The open group: rows that aren't in a block yet, and whether it began with the task or in an earlier block.
        labels, rows, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(t.to_bytes(2, "big") + x for t, x in zip(batch.column("tree").to_pylist(), batch.column("label").to_pylist(), strict=True))
            new_labels = np.frombuffer(raw, np.uint8).reshape(-1, 2 + width)
            new = np.column_stack([
                batch.column("node").to_numpy().view(np.uint64),
                batch.column("grams").to_numpy().view(np.uint64),
                np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, 2),
            ])
            if rows is not None:
                new_labels, new = np.concatenate([labels, new_labels]), np.concatenate([rows, new])
            apart = (new_labels[1:, :prefix] != new_labels[:-1, :prefix]).any(axis=1)
            starts = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(new)]])
            sizes = np.diff(starts)
            # Groups of a few rows that no border parts: all pairs at once, by their distance in the order.
            few = sizes <= small
            few[-1] = False
            few[0] &= not first
            inside = np.flatnonzero(np.repeat(few, sizes))
            group = np.repeat(np.arange(len(sizes)), sizes)[inside]
            some = new[inside]
            for step in range(1, small):
                same = np.flatnonzero(group[step:] == group[:-step])
                if not len(same):
                    break
                near = same[np.bitwise_count(some[same, 2:] ^ some[same + step, 2:]).sum(axis=1) <= screen]
                link(zip(some[near, 0].view(np.int64).tolist(), some[near + step, 0].view(np.int64).tolist(), strict=True))
            for g in np.flatnonzero(~few).tolist():
                lo, hi, last = int(starts[g]), int(starts[g + 1]), g == len(sizes) - 1
                border = first if g == 0 else False
                while hi - lo > most:  # more follows in any case
                    yield shared([block(new[lo : lo + most], new_labels[lo : lo + most])])
                    lo, border = lo + most, True
                if last:
                    labels, rows, first = new_labels[lo:hi], new[lo:hi], border
                elif border:
                    yield shared([block(new[lo:hi], new_labels[lo:hi])])
                else:
                    block(new[lo:hi], new_labels[lo:hi])
        if rows is not None:
            yield shared([block(rows, labels)])
        edges = [(x, r) for x in list(parent) if (r := root(x)) != x]
        if edges:
            u, v = (pa.array(c, pa.int64()) for c in zip(*edges, strict=True))
            none = [pa.nulls(len(edges), t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([u, v, *none], names)

    def across(batches):
        for batch in text_parts(batches, 0):
            edges = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                one, two = (np.frombuffer(x.as_py(), np.uint64).reshape(-1, 4) for x in (one, two))
                linked = np.zeros((len(one) + len(two),) * 2, bool)
                linked[: len(one), len(one) :] = _near(one, two, screen, threshold)
                linked |= linked.T
                edges += _edges(np.concatenate([one, two]), linked)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], ["u", "v"])

    found = stash(map_batches(ordered, run, "u long, v long, key binary, block binary, least long, most long, rows binary"), "forest")
    blocks = found.where("key IS NOT NULL")
    up, down = threshold
    sides = [blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "least", "most"))) for side in "ab"]
    pairs = sides[0].join(sides[1], "key").where(f"block_a < block_b AND {up} * least_b <= {down} * most_a AND {up} * least_a <= {down} * most_b").select("block_a", "block_b")
    one, two = (blocks.select(F.col("block").alias(f"block_{side}"), F.col("rows").alias(name)) for side, name in (("a", "one"), ("b", "two")))
    met = pairs.join(one, "block_a").join(two, "block_b").repartition("block_a", "block_b").select("one", "two")
    return found.where("key IS NULL").select("u", "v").unionByName(map_batches(met, across, "u long, v long"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    sizes = [len(s) for s in sets]
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner = rank[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width, most = 4096, int(rank[-1]) + 1 if len(rank) else 0
    for at in range(0, most, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        has = np.zeros((len(sets), min(width, most - at)), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        out += has @ has.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def spanning_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row it reaches."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        front = np.zeros(len(linked), bool)
        front[start] = True
        while front.any():
            root[front] = start
            front = linked[front].any(axis=0) & (root < 0)
    return root


def _verify_block(block: list[tuple[int, int, int, np.ndarray]], crossing: bool, threshold: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """(node, linked documents, root) of the nodes of one block or pair of blocks.

    ``block`` holds (node, side, documents, set). With ``crossing`` only pairs of
    different sides count, as the others are another block's.
    """
    block = sorted(block, key=lambda x: x[0])
    node, side, weight = (np.array([x[k] for x in block], np.int64) for k in range(3))
    common = common_counts([x[3] for x in block])
    sizes = np.diag(common)
    up, down = threshold
    linked = down * common >= up * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if crossing:
        linked &= side[:, None] != side[None, :]
    links = linked @ weight
    roots = node[spanning_roots(linked)]
    yield from ((n, k, r) for n, k, r in zip(node.tolist(), links.tolist(), roots.tolist(), strict=True) if k)


def _verified(members: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(node, links, root) of every member and block that has links.

    ``members`` has node (the id of a document with its set), set, cluster,
    copies and the number of blocks of the cluster. A member of block i goes to
    the tasks of all pairs of blocks with i.
    """
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    texts = docs.selectExpr("CAST(doc_id AS LONG) AS node", "text").where("node IS NOT NULL AND text IS NOT NULL")
    rows = (
        members.hint("merge").join(texts, "node")  # one plan, whose shuffle follows the input, at every size
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "set", "side", "copies", "text")
        .withColumn("task", F.xxhash64("cluster", "i", "j"))
        .repartitionByRange("task", "cluster", "i", "j")  # by rows, so that two large blocks don't meet by chance
        .sortWithinPartitions("task", "cluster", "i", "j", "node", "set")
    )

    def run(batches):
        key, block, last = None, [], None

        def done():
            rows = list(_verify_block(block, key[1] != key[2], threshold)) if len(block) > 1 else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["node", "links", "root"])

        for batch in text_parts(batches, 7):
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "node", "set", "side", "copies", "text")]
            for cluster, i, j, node, digest, where, copies, text in zip(*columns, strict=True):
                if key != (cluster, i, j):
                    if block:
                        yield from done()
                    key, block, last = (cluster, i, j), [], None
                if last == (node, digest):  # a repeated row of one document
                    continue
                found = grams(text, n)
                if xxhash.xxh3_128_digest(found.tobytes()) == digest:  # else another text of that id
                    block.append((node, where, copies, found))
                    last = node, digest
        if block:
            yield from done()

    return map_batches(rows, run, "node long, links long, root long")


def jaccard_join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), target: float = 0.9999) -> DataFrame:
    """Class and number of links of every document; links are exact.

    Two documents are linked if the sets of their word n-grams have a Jaccard
    similarity of at least ``threshold`` (a fraction, so that no rounding
    decides). Columns: doc_id, n_grams, n_links (other documents linked
    directly, copies included), class_id (the least doc_id reachable by links)
    and kept (doc_id = class_id: one document of each class). ``target`` is the
    recall of the search for pairs at the threshold; more similar ones have a
    higher one.

    A text without words (null, empty, white space) has no n-grams, links with
    nothing and is its own class. A null doc_id is a class of its own too, with
    no links. Rows that share a doc_id and a text are copies like any others; they
    are all returned and kept or not together. Rows that share a doc_id but not
    the text are one document of several texts: all its rows have the links and
    the class of all its texts. An empty table gives no rows; other columns are ignored.
    """
    similarity = threshold[0] / threshold[1]
    depth = prefix_depth(similarity, target)
    # Signature bits agree with the probability (1 + s) / 2; five deviations are allowed.
    expected = BITS * (1 - similarity) / 2
    screen = math.ceil(expected + 5 * math.sqrt(expected * (1 + similarity) / 2))

    sketched = stash(_sketches(docs, n), "sketches")
    nodes = stash(
        sketched.where("set IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set")
        .agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.any_value("grams").alias("grams"), F.any_value("labels").alias("labels"), F.any_value("bits").alias("bits")),
        "nodes",
    )
    clusters = stash(components(_forest(nodes, depth, screen, threshold)), "clusters")
    weighed = clusters.join(nodes.select("node", "set", "copies", "grams"), "node")
    sizes = stash(
        weighed.groupBy("root").agg(F.count("*").alias("size"), F.sum("grams").alias("total")).select("root", F.greatest(F.ceil(F.col("size") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_GRAMS)).alias("blocks")),
        "cluster-sizes",
    )
    members = stash(weighed.join(sizes, "root").select("node", "set", F.col("root").alias("cluster"), "copies", "blocks"), "members")
    verified = stash(_verified(members, docs, n, threshold), "verified")
    classes = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    resolved = stash(
        nodes.select("set", "node", "copies").join(links, "node", "left").join(classes, "node", "left").select("set", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")),
        "classes",
    )
    known = F.col("root").isNotNull()
    class_id = F.when(known, F.col("root")).otherwise(F.col("doc_id"))
    found = sketched.select("doc_id", "grams", F.when(F.col("doc_id").isNotNull(), F.col("set")).alias("set")).join(resolved, "set", "left")
    return found.select(
        "doc_id",
        F.col("grams").alias("n_grams"),
        F.when(known, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        class_id.alias("class_id"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"),
    )
