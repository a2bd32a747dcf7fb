"""Benchmark decontamination with spaced seeds.

A mask such as ``1110111`` names the token positions that count; the others may be anything, so a substituted token
costs only the seeds whose counted positions hold it.  Hashes of the benchmark's seeds are joined with those of the
documents, and every diagonal of a joined pair that holds a seed is verified token by token.

The masks lose nothing.  A run of 24 or more tokens falls into parts of 12 to 23, one of which has at least the run's
share of equal tokens; the masks hit every part of 12 to 23 tokens with a fifth of them substituted, wherever (the
tests enumerate them).  An item of fewer than 12 tokens must lie in the document whole, so its masks follow from its
length (:func:`masks_for`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.llm.common import bound_arrow, bounded_batches, map_rows, own_columns
from reviewrank.session import Scratch

MASKS = ("1110111", "1111011", "1110001011", "110000010111")  # six counted tokens; together they hit every accepted run
MIN_RUN = 12  # tokens a verified overlap has at least (or the whole item, if shorter)
MISSES_IN = 5  # one token in so many may differ
LEAST_ITEM = 5  # decontaminate() leaves items of fewer tokens alone: texts that hold a phrase such as "yes" are clean
SLOTS_PER_SEED = 4  # slots of 64 bits in the filter of seeds
MOST_SLOTS = 1 << 22  # 32 MB; with more seeds the filter lets more through, and the join still decides
SLOT_BITS = 4  # bits a seed sets in its slot
SALTS = 8  # a seed that most documents hold is joined in so many places
HELD_WORDS = 1 << 20  # words whose hashes a task keeps at hand
BROADCAST_ROWS = 500_000  # most leaking texts whose digests are broadcast (some 100 bytes each); more are joined by a shuffle
PIECE = 1 << 20  # tokens hashed, or facing places compared, at a time

# scripts written without spaces, where every character is a token: Thai and Lao, Myanmar, Khmer, kana, ideographs
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; single characters of scripts that are written without spaces."""
    return _TOKEN.findall((text or "").lower())


class TokenHashes(dict):
    """Hashes of words as computed so far, forgotten once there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return self[word]

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` tokens.

    One that is too short for a run must face its copy whole, with equal ends and up to ``n // 5`` other tokens
    substituted: of the inner tokens, cut into one part more than that, each mask counts a single part.
    """
    if n >= MIN_RUN:
        return MASKS
    parts = min(n // MISSES_IN + 1, max(n - 2, 1))
    part = [i * parts // max(n - 2, 1) for i in range(max(n - 2, 0))]
    return tuple("".join("1" if i in (0, n - 1) or part[i - 1] == k else "0" for i in range(n)) for k in range(parts)) if n else ()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the seed of ``mask`` at each place where the mask fits."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, xxhash.xxh3_64_intdigest(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def slots_and_bits(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the filter of ``slots`` (a power of two) looks for these seeds."""
    mixed = _mixed(hashes)
    bits = np.zeros(len(mixed), np.uint64)
    for k in range(SLOT_BITS):
        bits |= np.uint64(1) << (mixed >> np.uint64(40 + 6 * k) & np.uint64(63))
    return (mixed & np.uint64(slots - 1)).astype(np.int64), bits


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """Longest stretch ``[a, b)``, equal at both ends, with at most one token in five different (the first of several).

    An equal token gains one, another costs four: a stretch fits if its end is no lower than its start.
    """
    if not equal.any():
        return 0, 0
    height = np.concatenate(([0], np.cumsum(np.where(equal, 1, 1 - MISSES_IN))))
    lowest = np.minimum.accumulate(np.where(equal, height[:-1], len(height)))
    ends = np.flatnonzero(equal) + 1
    starts = np.searchsorted(-lowest, -height[ends])  # the first start as low as the end
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


def diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Offsets at which a seed of the item lies in the document: item token ``i`` faces document token ``offset + i``."""
    seen = np.zeros(len(doc) + len(item), bool)
    for mask in masks_for(len(item)):
        known = seed_hashes(item, mask)
        place = np.argsort(known, kind="stable")
        known, h = known[place], seed_hashes(doc, mask)
        first, last = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        at = np.flatnonzero(last > first)
        total = np.cumsum(last[at] - first[at])
        while len(at):
            k = max(1, int(np.searchsorted(total, PIECE + (total[0] - (last[at[0]] - first[at[0]])))))
            some, n = at[:k], last[at[:k]] - first[at[:k]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen[np.repeat(some, n) - place[np.repeat(first[some], n) + step] + len(item)] = True
            at, total = at[k:], total[k:]
    return np.flatnonzero(seen) - len(item)


def longest_overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int] | None:
    """``(document token, item token, tokens, equal tokens)`` of the longest verified overlap, if there is one."""
    best, least = None, min(MIN_RUN, len(item))
    for offset in diagonals(doc, item).tolist():
        lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
        if hi - lo < (best[2] if best else least):
            continue
        equal = item[lo:hi] == doc[offset + lo : offset + hi]
        a, b = best_run(equal)
        same = int(equal[a:b].sum())
        if b - a >= least and (best is None or (b - a, same) > best[2:]):
            best = (offset + lo + a, lo + a, b - a, same)
            if same == len(item):
                break
    return best


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """``item_id, ids``: the token hashes of the items of at least ``least`` tokens."""

    def rows_of():
        hashes = TokenHashes()

        def each(b):
            words = ((i, tokens(t)) for i, t in zip(b["item_id"], b["text"], strict=True))
            return [(i, hashes.of(w).view(np.int64).tolist()) for i, w in words if len(w) >= least]

        return each

    return map_rows(own_columns(benchmark, "item_id", "text"), "item_id long, ids array<long>", rows_of)


def _seeds(items: DataFrame) -> DataFrame:
    """``h, item``: each seed of each item once, its mask's places together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, ids in zip(b.column("item").to_pylist(), b.column("ids"), strict=True):
                ids = ids.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for mask in masks_for(len(ids)):
                    h = np.unique(seed_hashes(ids, mask)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), item, np.int64))], names=["h", "item"])

    return items.select("item", "ids").mapInArrow(run, "h long, item long")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the seeds, one slot a seed; the driver receives each of at most :data:`MOST_SLOTS` slots once."""
    need = SLOTS_PER_SEED * max(1, seeds.count())
    slots = min(MOST_SLOTS, 1 << max(10, (need - 1).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, bits = slots_and_bits(b.column("h").to_numpy().view(np.uint64), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    united = seeds.select("h").mapInArrow(placed, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(slots, np.uint64)
    out[united.column("slot").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
    return out


def _held(texts: DataFrame, key_type: str, masks: list[str], shipped) -> DataFrame:
    """``key, ids, seeds``: the token hashes of the texts that may hold a seed, and those seeds with their first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = shipped.value, TokenHashes()
        for b in bounded_batches(batches):
            lines = [hashes.of(tokens(t)) for t in b.column("text").to_pylist()]
            ends = np.cumsum([len(x) for x in lines])
            line = np.concatenate(lines)
            at, h, span = [], [], []
            for mask in masks:
                for start in range(0, len(line), PIECE):
                    found = seed_hashes(line[start : start + PIECE + len(mask) - 1], mask)
                    slot, bits = slots_and_bits(found, len(table))
                    some = np.flatnonzero(table[slot] & bits == bits)
                    at.append(some + start)
                    h.append(found[some])
                    span.append(np.full(len(some), len(mask)))
            at, h, span = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, h, span))
            doc = np.searchsorted(ends, at, "right")
            inside = at + span <= ends[np.minimum(doc, len(ends) - 1)] if len(ends) else np.zeros(0, bool)
            at, h, doc = at[inside], h[inside], doc[inside]
            order = np.lexsort((at, h, doc))
            at, h, doc = at[order], h[order].astype(np.uint64), doc[order]
            new = np.ones(len(at), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            touched, n = np.unique(doc[first], return_counts=True)
            at = at - np.concatenate(([0], ends))[doc]
            seeds = pa.StructArray.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(at[first].astype(np.int64)), pa.array(at[last].astype(np.int64))],
                names=["h", "first", "last"])
            sizes = [len(lines[d]) for d in touched]
            ids = np.concatenate([np.empty(0, np.uint64), *[lines[d] for d in touched]]).view(np.int64)
            offsets = lambda x: pa.array(np.concatenate(([0], np.cumsum(x))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(touched.astype(np.int64))), pa.ListArray.from_arrays(offsets(sizes), pa.array(ids)),
                 pa.ListArray.from_arrays(offsets(n), seeds)], names=["key", "ids", "seeds"])

    return texts.mapInArrow(run, f"key {key_type}, ids array<long>, seeds array<struct<h: long, first: long, last: long>>")


def _verified(rows: DataFrame, key_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k in range(b.num_rows):
                doc, item = (b.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("ids", "item_ids"))
                run = longest_overlap(doc, item)
                if run is not None:
                    at.append(k)
                    found.append((run[0] + b.column("start")[k].as_py(), *run[1:]))
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(pa.array(at, pa.int64())) for c in ("key", "item_id")] + [pa.array(c, pa.int64()) for c in columns],
                names=["key", "item_id", "doc_token", "item_token", "n_tokens", "n_equal"])

    return rows.mapInArrow(run, f"key {key_type}, item_id long, doc_token long, item_token long, n_tokens long, n_equal long")


def _overlaps(texts: DataFrame, key_type: str, items: DataFrame, scratch: Scratch) -> DataFrame:
    """All verified overlaps of ``texts`` (``key, text``) and ``items``.

    Only the bounded filter is broadcast by hand.  Texts whose seeds pass it are written down as token hashes; pairs of
    them and items that share a seed are joined with the tokens around it, and verified pair by pair.
    """
    spark = texts.sparkSession
    bound_arrow(spark)
    items = scratch.cut(items.withColumn("item", F.monotonically_increasing_id()))
    seeds = scratch.cut(_seeds(items))
    short = [r.n for r in items.select(F.size("ids").alias("n")).where(F.col("n") < MIN_RUN).distinct().collect()]
    masks = sorted({m for n in [MIN_RUN, *short] for m in masks_for(n)})
    shipped = spark.sparkContext.broadcast(_filter(seeds))
    held = scratch.cut(_held(texts, key_type, masks, shipped).withColumn("place", F.monotonically_increasing_id()))
    shipped.destroy()
    hits = held.select("place", F.explode("seeds").alias("s")).select("place", "s.*", F.pmod("place", F.lit(SALTS)).alias("salt"))
    salted = seeds.select("h", "item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = hits.join(salted, ["h", "salt"]).groupBy("place", "item").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    faced = pairs.join(items.withColumnRenamed("ids", "item_ids"), "item").join(held.select("place", "key", "ids"), "place")
    n = F.size("item_ids")
    around = faced.withColumn("start", F.greatest(F.col("first") - n, F.lit(0)))
    length = (F.col("last") - F.col("start") + 2 * n + max(map(len, MASKS))).cast("int")
    return _verified(around.select("key", "item_id", "item_ids", "start", F.slice("ids", (F.col("start") + 1).cast("int"), length).alias("ids")), key_type)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_item: int = 1) -> DataFrame:
    """One row per document and benchmark item that share a run of tokens, with the longest run.

    A run begins and ends with equal tokens and has :data:`MIN_RUN` tokens (or the whole item, if shorter), of which
    four fifths are equal, place by place.  Items of fewer than ``least_item`` tokens are left out.
    Whole texts are searched; null and empty texts, and an empty benchmark, give no rows; repeated rows give repeated
    rows; a null ``doc_id`` or ``item_id`` stays null.
    """
    texts = docs.select(F.col("`doc_id`").cast("long").alias("key"), F.col("`text`").alias("text"))
    found = _overlaps(texts, "long", _items(benchmark, least_item), Scratch(docs.sparkSession))
    return found.withColumnRenamed("key", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of ``docs`` that share no run of tokens with any benchmark item of ``least_item`` tokens or more.

    All columns stay as they are, whatever their names; null and empty texts are kept, and so is everything if the
    benchmark is empty.  Texts that leak are known by their SHA-256.
    """
    digest = F.sha2(docs["`text`"].cast("binary"), 256)
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(digest.alias("key"), docs["`text`"].alias("text"))
    found = _overlaps(texts, "string", _items(benchmark, least_item).dropDuplicates(["ids"]), scratch)
    leaked = Scratch(docs.sparkSession).cut(found.select("key").distinct())
    scratch.drop_all()
    few = leaked.count() <= BROADCAST_ROWS  # then no text is shuffled
    return docs.join(F.broadcast(leaked) if few else leaked, digest == leaked["key"], "left_anti")
