"""SimHash near-duplicates, found with vantage-point trees over Hamming space.

A node of the tree holds a vantage fingerprint and a radius.  Points within the radius go inside, the others outside.
By the triangle inequality a point ``y`` outside can lie within ``r`` of a point inside only if its distance to the
vantage is at most ``radius + r``; only such points are copied inside.  So every pair within ``r`` meets in some shard.
The top of the tree is fitted on a bounded sample and routes all distinct fingerprints to shards; each shard grows its
own tree down to small blocks, where distances are computed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.llm.common import map_rows, own_columns
from reviewrank.llm.components import connected_components
from reviewrank.session import cut_lineage

RADIUS = 2
SHINGLE = 3
SHARD_POINTS = 4096  # distinct fingerprints aimed at per shard
SAMPLE_POINTS = 65_536  # most fingerprints the driver sees, to fit the top of the tree; all others are only routed
BLOCK = 192  # points below which a shard compares directly
VANTAGES = 8  # candidates tried per node


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if it is in over half of the XXH64 values (seed 42) of the word shingles.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are ``k`` words joined by spaces, repeats
    counted.  Fewer than ``k`` words are one shingle; no word gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    s, e = starts[:n].tolist(), (ends[k - 1 :] - 1).tolist()
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(s[at : at + 65_536], e[at : at + 65_536])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the fingerprint as a signed long, of every row's whole text (null: empty)."""
    hashed = own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def rows_of():
        return lambda b: [(i, h, _signed(fingerprint(t))) for i, h, t in zip(b["doc_id"], b["text_hash"], b["text"], strict=True)]

    return map_rows(hashed, "doc_id long, text_hash long, fp long", rows_of)


@dataclass
class Node:
    vantage: np.uint64
    radius: int
    inside: Node | int  # a number is a shard
    outside: Node | int


def _distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _choose(points: np.ndarray, r: int, seed: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage and radius with the smallest squared sizes of both sides, copies included.

    None unless they stay under 0.8 of the whole's: then splitting never costs more than comparing all points, and both
    sides together hold at most 1.27 times the points.
    """
    rng = np.random.default_rng(seed + len(points))
    best = None
    some = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    for vantage in points[rng.integers(0, len(points), VANTAGES)]:
        upto = np.cumsum(np.bincount(_distances(some, vantage), minlength=65 + r)) / len(some)
        cost = upto[r : 65 + r] ** 2 + (1 - upto[:65]) ** 2  # inside with copies; outside
        radius = int(np.argmin(cost))
        if best is None or cost[radius] < best[0]:
            best = (cost[radius], vantage, radius)
    if best is None or best[0] > 0.8:
        return None
    d = _distances(points, best[1])
    if max((d <= best[2] + r).sum(), (d > best[2]).sum()) > 0.95 * len(points):  # the sample misled
        return None
    return best[1], best[2], d


def top_tree(sample: np.ndarray, shards: int, r: int = RADIUS) -> tuple[Node | int, int]:
    """A tree with about ``shards`` leaves fitted on ``sample``; returns it and its number of leaves."""
    count = 0
    least = max(8, len(sample) // max(1, shards))

    def grow(points: np.ndarray, seed: int):
        nonlocal count
        split = _choose(points, r, seed) if len(points) > least and len(points) > 16 else None
        if split is None:
            count += 1
            return count - 1
        vantage, radius, d = split
        # copies count here too: a shard must hold its band
        return Node(vantage, radius, grow(points[d <= radius + r], 2 * seed + 1), grow(points[d > radius], 2 * seed + 2))

    return grow(sample, 0), count


def route(tree: Node | int, points: np.ndarray, r: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """``(shard, places in points)``: each point in its own shard and in those whose border it is near to."""
    out, todo = [], [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, Node):
            out.append((node, at))
            continue
        d = _distances(points[at], node.vantage)
        todo.append((node.inside, at[d <= node.radius + r]))
        todo.append((node.outside, at[d > node.radius]))
    return out


def close_pairs(points: np.ndarray, r: int = RADIUS):
    """Yields ``(i, j)`` index arrays that together hold every pair of different ``points`` within ``r``."""
    todo = [(np.arange(len(points)), 1)]
    while todo:
        at, seed = todo.pop()
        mine = points[at]
        split = _choose(mine, r, seed) if len(at) > BLOCK else None
        if split is not None:
            _, radius, d = split
            todo.append((at[d <= radius + r], 2 * seed % 1_000_003))
            todo.append((at[d > radius], (2 * seed + 1) % 1_000_003))
            continue
        for start in range(0, len(at), 1024):  # bounded memory where a shard cannot be split further
            rows = mine[start : start + 1024]
            for to in range(start, len(at), 4096):
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ mine[None, to : to + 4096]) <= r)
                keep = i + start < j + to
                yield at[i[keep] + start], at[j[keep] + to]


def spanning_links(points: np.ndarray, r: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(point, smallest point of its group here)``: the same groups as all close pairs, one link per point."""
    root = np.arange(len(points))
    order = np.argsort(points, kind="stable")
    points = points[order]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in close_pairs(points, r):
        differ = root[i] != root[j]
        for a, b in zip(i[differ].tolist(), j[differ].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    top = np.array([find(x) for x in range(len(points))], np.int64)
    linked = top != np.arange(len(points))
    return points[linked], points[top[linked]]


_LINKS = "a long, b long"


def near_links(distinct: DataFrame, r: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links between the distinct fingerprints ``fp`` that join exactly those connected by steps of at most ``r`` bits.

    The result holds one link per fingerprint and shard, not all pairs; a group keeps its connections.
    """
    n = distinct.count()
    shards = -(-n // shard_points)
    share = min(1.0, SAMPLE_POINTS / max(1, n))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else distinct
    sample = np.array([row[0] for row in picked.limit(SAMPLE_POINTS).collect()], np.int64).view(np.uint64)
    tree, _ = top_tree(np.sort(sample), shards, r)
    shipped = distinct.sparkSession.sparkContext.broadcast(tree)

    def routed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for shard, at in route(shipped.value, fp.view(np.uint64), r):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(fp[at])], names=["shard", "fp"])

    def linked(group: pa.Table) -> pa.Table:
        a, b = spanning_links(group.column("fp").to_numpy().view(np.uint64), r)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(routed, "shard int, fp long").groupBy("shard").applyInArrow(linked, _LINKS)


def classes(prints: DataFrame, r: int = RADIUS) -> DataFrame:
    """``(fp, least)``: for every distinct fingerprint the smallest ``(no id, doc_id, text_hash)`` of its component."""
    own = cut_lineage(
        prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    )
    member = cut_lineage(connected_components(near_links(own.select("fp"), r)))
    grouped = own.join(member, own["fp"] == member["node"], "left").select("fp", "root", "least")
    grouped = grouped.withColumn("root", F.coalesce("root", "fp"))
    best = grouped.groupBy("root").agg(F.min("least").alias("best"))
    return grouped.join(best, "root").select("fp", F.col("best").alias("least"))


def near_duplicates(docs: DataFrame, r: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at ``r`` or fewer differing bits; ``component_id`` is the smallest ``doc_id`` reachable over links.
    Null and empty texts share the zero fingerprint and link like any other.  A null ``doc_id`` stays null and never
    names a component that has an id; repeated rows each give a row; other columns are not read; no rows give no rows.
    """
    prints = cut_lineage(fingerprints(docs))
    found = classes(prints, r).select("fp", F.col("least.doc_id").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
