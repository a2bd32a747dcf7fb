"""One document of each group of near-duplicates: SimHash trees first, then an exact join of rare shingles.

Texts are near if the Jaccard likeness of their word shingles is at least a bound.  Fingerprints that the vantage-point
trees join are candidates that cost little and join most copies.  They are not all: likeness says nothing certain about
bits.  So texts also meet by shingles.  With all shingles in one order, texts of that likeness share one among the first few
of each (``keys``), and it is among still fewer of the smaller text (``own``).  Under a shingle all texts are compared with
the one that has the fewest rarer shingles, and after that only texts that no links connect yet.

Candidates are rejected by their sizes and by the parities of their shingles' hash buckets, both exact bounds, before any
shingles move; what is left is verified on the sets of all shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewrank.llm.common import bounded_batches, held_by_worker, own_columns
from reviewrank.llm.components import connected_components
from reviewrank.llm.simhash_vptree import RADIUS, _signed, fingerprint, near_links
from reviewrank.session import Scratch

SHINGLE, LIKENESS = 5, 0.8
FIRST_LEADERS = 16  # of a shingle in the first round after that of the best one
ORDER_TEXTS, ORDER_SHINGLES = 16_384, 65_536  # texts read and shingles kept to put frequent shingles last
NAME = ("no_id", "id", "text_hash")
KEY_PARTS = 4  # of the keys, that are brought together one after the other
PARITY_WORDS = 16  # 64-bit words of bucket parities
PIECE_BYTES = 2 << 20  # of text worked on at a time
BROADCAST_ROWS = 1_000_000  # most rows of a broadcast list of texts (32 bytes each); longer ones are joined by a shuffle


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct word shingles (fewer words than ``k``: of all of them; none: empty), in growing order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - k + 1)].tolist()
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts, stops)), np.uint64, len(starts)))


def _mapped(df: DataFrame, ddl: str, columns_of: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Arrow batches in, columns out: hashes stay in arrays and never become Python numbers."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker()
        each = columns_of()
        for b in bounded_batches(batches, PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray | list) else c for c, f in zip(each(b), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each bucket of hashes whether it holds an odd number, as 64-bit words.

    Sets that differ in ``d`` elements differ in at most ``d`` parities.
    """
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def frequent(docs: DataFrame, k: int = SHINGLE, sample: int = ORDER_TEXTS, most: int = ORDER_SHINGLES) -> np.ndarray:
    """The shingles found most often in a bounded sample of texts, the rarest of them first.

    They only set the order of keys: any order finds the same pairs, a good one with fewer comparisons.
    """
    n = docs.count()
    share = min(1.0, sample / max(1, n))
    some = docs.where(F.pmod(F.xxhash64("text_hash"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else docs

    def columns_of():
        return lambda b: [np.concatenate([shingle_hashes(t, k) for t in b.column(0).to_pylist()]).view(np.int64)]

    counted = _mapped(some.select("text"), "key long", columns_of).groupBy("key").count().where("count > 2")
    rows = counted.orderBy(F.col("count").desc(), "key").limit(most).collect()
    return np.array([r[0] for r in reversed(rows)], np.int64).view(np.uint64)


def _cut(x: float) -> int:
    return math.ceil(x - 1e-6)


def described(docs: DataFrame, k: int, least: float) -> DataFrame:
    """``(no_id, id, text_hash, n, fp, parity, keys)`` of every row: shingles, SimHash, parities, first shingles in the order."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))

    def columns_of():
        order = np.argsort(shipped.value)
        known = shipped.value[order]

        def first_keys(mine: np.ndarray) -> np.ndarray:
            n = len(mine)
            if not n:
                return np.zeros(1, np.uint64)  # texts without words are alike; they meet under zero
            rank = np.full(n, -1, np.int64)
            if len(known):
                near = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                rank = np.where(known[near] == mine, order[near], -1)
            return mine[np.lexsort((mine, rank))][: n - _cut(least * n) + 1]

        def each(b: pa.RecordBatch) -> list:
            texts = b.column(3).to_pylist()
            sets = [shingle_hashes(t, k) for t in texts]
            prints = [_signed(fingerprint(t, k)) for t in texts]
            sizes = np.array([len(m) for m in sets], np.int32)
            return [b.column(0), b.column(1), b.column(2), sizes, prints, _lists([parities(m) for m in sets]), _lists([first_keys(m) for m in sets])]

        return each

    ddl = "no_id boolean, id long, text_hash long, n int, fp long, parity array<long>, keys array<long>"
    return _mapped(docs.select(*NAME, "text"), ddl, columns_of)


class Linker:
    """Verified links between the distinct texts of ``texts(text_hash, no_id, id, repeated, n, parity, ...)``.

    ``docs(no_id, id, text_hash, text)`` holds the texts; the row that ``texts`` names is read, once unless ``repeated``.
    """

    def __init__(self, texts: DataFrame, docs: DataFrame, k: int, least: float):
        self.k, self.least, self.scratch = k, least, Scratch(texts.sparkSession)
        self.sizes, self.names = texts.select("text_hash", "n", "parity"), texts.select(*NAME, "repeated")
        self.docs = docs
        self.links = self.tested = self.sets = self.having = None

    def verify(self, pairs: DataFrame) -> None:
        """Add those of ``pairs(a, b)`` that are near.  A pair is looked at once; ``a`` is compared with its ``b``."""
        low, high = F.least("a", "b"), F.greatest("a", "b")
        fresh = pairs.where("a <> b").groupBy(low.alias("x"), high.alias("y")).agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b"))
        if self.tested is not None:
            fresh = fresh.join(self.tested, ["x", "y"], "left_anti")
        fresh = self.scratch.cut(fresh)
        seen = fresh.select("x", "y")
        self.tested = seen if self.tested is None else self.tested.unionByName(seen)
        of = lambda c: self.sizes.select(F.col("text_hash").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
        met = fresh.select("a", "b").join(of("a"), "a").join(of("b"), "b")
        small, big, both = F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), F.col("n_a") + F.col("n_b")
        differing = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        possible = (small >= big * self.least - 1e-6) & (differing <= both * ((1 - self.least) / (1 + self.least)) + 1e-6)
        some = self.scratch.cut(met.where(possible).select("a", "b", "n_a", "n_b"))
        ids = self.scratch.cut(some.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct())
        self._fetch(ids)
        sets = self.sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "text_hash", "left_semi")  # only these are shuffled
        left = some.join(sets.select(F.col("text_hash").alias("a"), F.col("set").alias("set_a")), "a")
        both_sets = left.join(sets.select(F.col("text_hash").alias("b"), F.col("set").alias("set_b")), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        near = F.when(both == 0, F.lit(True)).otherwise(shared >= self.least * (both - shared) - 1e-6)
        found = both_sets.where(near).select("a", "b")
        self.links = self.scratch.cut(found if self.links is None else found.unionByName(self.links), some, ids, *([] if self.links is None else [self.links]))
        self.scratch.tidy()

    def _fetch(self, wanted: DataFrame) -> None:
        """Make sure that the shingle sets of ``wanted`` are there; each text is read for it once."""
        if self.having is not None:
            wanted = wanted.join(self.having, "text_hash", "left_anti")
        wanted = self.scratch.cut(wanted.join(self.names, "text_hash"))
        rows, k = named_rows(self.docs, wanted), self.k

        def columns_of():
            return lambda b: [b.column(0), b.column(1), _lists([shingle_hashes(t, k) for t in b.column(2).to_pylist()])]

        read = self.scratch.cut(_mapped(rows.select("text_hash", "repeated", "text"), "text_hash long, repeated boolean, set array<long>", columns_of))
        sets = read.where("not repeated").unionByName(read.where("repeated").dropDuplicates(["text_hash"])).drop("repeated")
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        wanted = wanted.select("text_hash")
        self.having = wanted if self.having is None else self.having.unionByName(wanted)

    def rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the smallest ``text_hash`` of their component as ``root``."""
        roots = self.scratch.cut(connected_components(self.links).withColumnRenamed("node", "text_hash"))
        return rows.join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))

    def link_rest(self, postings: DataFrame, first: int = FIRST_LEADERS) -> None:
        """Compare all texts that share a key of ``postings(key, text_hash, n, at, own)`` until links connect all near ones.

        A pair needs no comparison under a key that neither has in its ``own`` part, nor under one that cannot be the first
        they share (:func:`_may_be_near`).  Under each other key all texts first meet the one with the key at its earliest place.  After that, members outside the key's largest group are compared with all
        of other groups, a share of them a round so that links found meanwhile save the rest.  The share grows fourfold, and
        the rounds end when no key is left with two groups.
        """
        parts = []
        for part in range(KEY_PARTS):  # the shuffle files of one are freed before the next; most keys have one text and stay here
            mine = postings.where(F.pmod("key", F.lit(KEY_PARTS)) == part)
            held = mine.groupBy("key").agg(F.count("*").alias("held"), F.max("own").alias("any_own")).where("held > 1 and any_own").select("key")
            parts.append(self.scratch.cut(mine.join(held, "key")))
            self.scratch.tidy()
        alive = reduce(DataFrame.unionByName, parts)
        best = alive.groupBy("key").agg(F.min(F.struct("at", "text_hash", "n")).alias("b")).select("key", *[F.col(f"b.{c}").alias(f"{c}_b") for c in ("text_hash", "n", "at")])
        met = alive.join(best, "key").where((F.col("text_hash") != F.col("text_hash_b")) & _may_be_near(self.least))
        self.verify(met.select(F.col("text_hash").alias("a"), F.col("text_hash_b").alias("b")))
        n = first
        while True:
            rows = self.rooted(alive.select("key", "text_hash", "n", "at", "own"))
            groups = rows.groupBy("key", "root").agg(F.count("*").alias("size"), F.max("own").alias("own"))
            keys = groups.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("big"), F.max("own").alias("own"))
            keys = keys.where("all > big.size and own").select("key", F.col("big.root").alias("big"), (F.col("all") - F.col("big.size")).alias("outside"))
            dice = F.pmod(F.xxhash64("text_hash", "key", F.lit(n)), F.lit(1 << 20))
            leads = (F.col("root") != F.col("big")) & (dice * F.col("outside") < F.lit(n << 20))
            alive = self.scratch.cut(rows.join(keys, "key").select("key", "text_hash", "n", "at", "own", "root", leads.alias("leads")), *parts)
            if alive.isEmpty():
                return
            self.scratch.tidy()
            lead = alive.where("leads").select("key", *[F.col(c).alias(f"{c}_b") for c in ("text_hash", "n", "at", "own", "root")])
            differ = (F.col("root") != F.col("root_b")) & (F.col("own") | F.col("own_b"))
            met = alive.join(lead, "key").where(differ & _may_be_near(self.least))
            self.verify(met.select(F.col("text_hash").alias("a"), F.col("text_hash_b").alias("b")).distinct())
            alive = self.scratch.cut(alive.where("not leads"), alive)
            parts = [alive]
            n *= 4


def _may_be_near(least: float) -> Column:
    """Whether texts of ``n`` and ``n_b`` shingles with a key at the places ``at`` and ``at_b`` can be near if they share none before.

    Then they share at most what follows in the shorter rest.  Near texts pass under the first key they share, so none is lost.
    """
    rest = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return rest >= (F.col("n") + F.col("n_b")) * (least / (1 + least)) - 1e-6


def named_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``wanted(no_id, id, text_hash, repeated)`` names, with ``repeated``.

    A short list is broadcast, a longer one joined by a shuffle.
    """
    few = wanted.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if few else wanted, list(NAME))


def postings_of(texts: DataFrame, least: float) -> DataFrame:
    """``(key, text_hash, n, at, own)``: a row for each key of a text, with its place and whether it lies in the smaller text's part."""
    own = F.col("n") - F.ceil(F.col("n") * (2 * least / (1 + least)) - 1e-6) + 1
    rows = texts.select("text_hash", "n", own.alias("upto"), F.posexplode("keys").alias("at", "key"))
    return rows.select("key", "text_hash", "n", "at", (F.col("at") < F.greatest("upto", F.lit(1))).alias("own"))


def _with_name(docs: DataFrame, at: tuple[str, str, str]) -> DataFrame:
    """``docs`` with what names a row: whether it has no id, the id or 0, and its text's hash."""
    return docs.withColumns(dict(zip(at, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")))))


def kept_names(docs: DataFrame, r: int = RADIUS, k: int = SHINGLE, least: float = LIKENESS, first: int = FIRST_LEADERS) -> DataFrame:
    """``(no_id, id, text_hash, repeated)`` of one text of each group: that of the smallest id, any id before none.

    Groups are joined by links of :class:`Linker`; ``repeated`` tells that more than one row has that id and text.
    """
    docs = _with_name(own_columns(docs, "doc_id", "text"), NAME).drop("doc_id")
    scratch = Scratch(docs.sparkSession)
    every = scratch.cut(described(docs, k, least))
    first_of = every.groupBy("text_hash").agg(F.min(F.struct("no_id", "id")).alias("name")).select("text_hash", "name.*")
    twice = every.groupBy(*NAME).count().where("count > 1").select(*NAME, F.lit(True).alias("repeated"))
    named = scratch.cut(first_of.join(twice, list(NAME), "left").select(*NAME, F.coalesce("repeated", F.lit(False)).alias("repeated")))
    rows = named_rows(every, named)  # keys move only where names are too many to broadcast
    texts = scratch.cut(rows.where("not repeated").unionByName(rows.where("repeated").dropDuplicates(["text_hash"])), every, named)
    scratch.tidy()
    linker = Linker(texts, docs, k, least)
    leads = scratch.cut(texts.groupBy("fp").agg(F.min("text_hash").alias("lead")))
    lead_of = lambda c: leads.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    close = near_links(leads.select("fp"), r).join(lead_of("a"), "a").join(lead_of("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    equal = texts.join(leads, "fp").select(F.col("text_hash").alias("a"), F.col("lead").alias("b"))
    linker.verify(equal.unionByName(close))
    linker.link_rest(postings_of(texts, least), first)
    grouped = linker.rooted(texts.select(*NAME, "repeated"))
    best = grouped.groupBy("root").agg(F.min(F.struct(*NAME, "repeated")).alias("best"))
    return scratch.cut(best.select("best.*"), texts, leads)


def drop_near_duplicates(docs: DataFrame, r: int = RADIUS, k: int = SHINGLE, least: float = LIKENESS) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the smallest ``doc_id`` (rows without one last).

    Texts are near at a Jaccard likeness of ``least`` of their ``k``-word shingles, over the whole texts (A-Z lower-cased);
    groups are joined by steps of such pairs.  Null and empty texts, and those of blanks, are alike.  Of rows equal in id and text
    any one stays, whatever their other columns.  Columns may have any names; no rows give no rows.
    """
    taken = {c.lower() for c in docs.columns}
    fresh = lambda name: name if name not in taken else fresh(f"_{name}")
    at = tuple(fresh(c) for c in NAME)
    repeated = fresh("repeated")
    keep = kept_names(docs, r, k, least)
    few = keep.count() <= BROADCAST_ROWS
    keep = keep.toDF(*at, repeated)
    rows = _with_name(docs, at).join(F.broadcast(keep) if few else keep, list(at))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where(F.col(repeated)).dropDuplicates(list(at)).select(*own)
    return rows.where(~F.col(repeated)).select(*own).unionAll(once)
