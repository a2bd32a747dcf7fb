"""Document fingerprints by winnowing.

Every ``K``-gram of code points is hashed; each window of ``W`` neighbouring hashes keeps its smallest, the rightmost
among equals.  Two texts that share ``W + K - 1`` code points then share a kept hash, and no two kept places are more than
``W`` apart.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewrank.llm.common import TEXT_BATCH_BYTES, bounded_batches, map_rows, own_columns

K, W = 16, 24
_BASE = 0x9E3779B97F4A7C15  # fixed odd multipliers
_MIX = 0xD6E8FEB86659FD93


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Polynomial hash of every ``k``-gram, as unsigned 32-bit numbers; a shorter text is one gram, an empty one none."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.uint32)
    k = min(k, n)
    # the hash of a gram of a + b points is hash(first a) * BASE^b + hash(last b): whole powers of two, put together
    out, done = None, 0
    power, length = points.astype(np.uint64), 1
    while True:
        if k & length:
            shift = np.uint64(pow(_BASE, length, 1 << 64))
            size = n - k + 1
            out = power[done : done + size].copy() if out is None else out * shift + power[done : done + size]
            done += length
        if 2 * length > k:
            break
        shift = np.uint64(pow(_BASE, length, 1 << 64))
        power = power[:-length] * shift + power[length:]
        length *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MIX)
    return (out >> np.uint64(32)).astype(np.uint32)


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the kept hashes: the rightmost smallest of each window of ``w`` (of all, if fewer), in order."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    # the smallest of w neighbours, by doubling; a key is the hash and how far left its place is
    best = hashes.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    length = 1
    while 2 * length <= w:
        best = np.minimum(best[:-length], best[length:])
        length *= 2
    if length < w:
        best = np.minimum(best[: n - w + 1], best[w - length : w - length + n - w + 1])
    places = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


def kept_hashes(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Kept ``(hashes, places)`` of a text."""
    hashes = gram_hashes(points, k)
    places = winnow(hashes, w)
    return hashes[places], places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of distinct sorted hashes; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def encoded(distinct: np.ndarray) -> str:
    """The set of kept hashes as text (base64 of little-endian 32-bit integers in growing order)."""
    return b64encode(distinct.astype("<u4").tobytes()).decode("ascii")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """``(doc_id, kept)``: hashes with their places in the text, in order, for every row (null or empty text: none)."""

    def rows_of():
        def each(b):
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                hashes, places = kept_hashes(code_points(t), k, w)
                out.append((i, [{"hash": h, "place": p} for h, p in zip(hashes.tolist(), places.tolist())]))
            return out

        return each

    return map_rows(own_columns(docs, "doc_id", "text"), "doc_id long, kept array<struct<hash:long,place:long>>", rows_of)


def _chunk(order: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``order``, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c).cast("long") for c in cuts])
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(F.element_at(table, middle(s) + 1) < order, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))
        )
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), state, step, lambda s: s["lo"])


def with_following(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows sorted within tasks so that each is directly followed by the one that comes after it in descending ``doc_id``.

    ``doc_id`` is cut into ranges of about equally many rows, one per task.  The highest row of a range is also copied
    (``is_copy``) to the end of the range above; that of the topmost range to the end of the lowest.  Only one bound and
    one id per task reach the driver.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))  # a row without an id is the lowest
    keyed = own_columns(docs, "doc_id", "text").withColumn("ord", order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in keyed.approxQuantile("ord", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    chunked = keyed.withColumn("chunk", _chunk(F.col("ord"), cuts))
    heads = {r["chunk"]: r["head"] for r in chunked.groupBy("chunk").agg(F.max("ord").alias("head")).collect()}
    held = sorted(heads)
    above = {c: held[(i + 1) % len(held)] for i, c in enumerate(held)}
    n = len(cuts) + 1
    if held:
        head = F.element_at(F.array(*[F.lit(heads.get(c)).cast("long") for c in range(n)]), F.col("chunk") + 1)
        target = F.element_at(F.array(*[F.lit(above.get(c, 0)) for c in range(n)]), F.col("chunk") + 1)
    else:
        head, target = F.lit(None).cast("long"), F.lit(0)
    own = F.struct(F.col("chunk").alias("to"), F.lit(False).alias("is_copy"))
    copy = F.struct(target.alias("to"), F.lit(True).alias("is_copy"))
    sent = chunked.select("doc_id", "text", "ord", F.explode(F.when(F.col("ord") == head, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    sent = sent.select("doc_id", "text", "ord", "at.*")
    return sent.repartitionById(n, "to").sortWithinPartitions("is_copy", F.desc("ord"), "text"), ["doc_id", "text", "is_copy"]


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long, widest_gap long"


def edit_likeness(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last third (rounded down) replaced by as many first code points of the next document in
    descending ``doc_id`` (after the last: the first).  Per row: ``n_chars`` in code points, the edited text's SHA-256, both
    fingerprints, the likeness of the own one to the edited text's and to the next document's, the number of kept hashes
    and the widest gap between kept places (at most ``w``).  A null text is an empty one.  Rows without an id count as the
    lowest; rows of one id follow each other in the order of their texts.  A single row is followed by itself.
    """
    rows, names = with_following(docs)
    schema = T.StructType.fromDDL(_EDITED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, last = [], 0, None

        def row(mine, following):
            doc_id, text, points, hashes, places, distinct = mine
            third = len(points) // 3
            text, other = text or "", following[1] or ""
            edited = text[: len(points) - third] + other[:third]
            edited_distinct = np.unique(kept_hashes(code_points(edited), k, w)[0])
            gap = int(np.diff(places).max()) if len(places) > 1 else 0
            return (
                doc_id, len(points), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(distinct), encoded(edited_distinct),
                likeness(distinct, edited_distinct), likeness(distinct, following[5]), len(places), gap,
            )

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        closed = False
        for b in bounded_batches(batches):
            for doc_id, text, is_copy in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if closed:  # further copies of the same row
                    break
                points = code_points(text)
                hashes, places = kept_hashes(points, k, w)
                this = (doc_id, text, points, hashes, places, np.unique(hashes))
                if last is not None:
                    out.append(row(last, this))
                    size += 4 * len(last[2]) + 200
                last, closed = this, is_copy
                if size > TEXT_BATCH_BYTES:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return rows.select(*names).mapInArrow(run, schema)
