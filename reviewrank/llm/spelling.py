"""Spelling variants: words one edit apart, found by probing edits against Bloom filters of the vocabulary.

Every pair of words one edit apart is generated once: the longer word with a code point deleted, or the smaller word with
one replaced by a larger.  The filters hold the vocabulary, one shard of slots per word length; a word sets a few bits of
one 64-bit slot, so that a probe reads one slot.  Edits are never spelled out for that: their polynomial hashes follow
from the word's prefix hashes.  Only edits that the filters let through become words, and meet the vocabulary in a join
that removes the false ones.

A filter is broadcast, so its size is bounded (:data:`FILTER_SLOTS`).  A vocabulary that needs more is cut into parts by
half of the word: an edit in the second half leaves the first as it is, and the reverse, so that a word is probed in two of
the parts however many there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewrank.llm.common import bounded_batches, own_columns
from reviewrank.session import cut_lineage

SHORTEST, LEAST_COUNT = 7, 2  # of a word, in code points and occurrences
TYPO_EVERY = 31  # a run whose checksum this divides loses a code point
RATIO = 10  # a form occurs at least so many times as often as its word
FILTER_SLOTS = 1 << 22  # most 64-bit slots of a broadcast filter: 32 MB
WORDS_PER_SLOT, SLOT_BITS = 3, 4  # about 21 bits a word; bits a word sets in its slot
LONGEST_SHARD = 64  # words from this length on share a shard
HELD_WORDS = 400_000  # distinct words a task counts before it passes them on
PROBES = 1 << 21  # edits hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1

#: Letters keep their place in Latin-1, A-Z are lower-cased, everything else becomes a blank.
LETTERS = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if 0x61 <= x <= 0x7A or x >= 0xC0 else 0x20 for x in range(256)
)


def runs_of(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """The words of a text, in Latin-1, with how often it holds them.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased.  Where :data:`TYPO_EVERY` divides the checksum of
    ``<doc_id>:<run>``, the code point at its remainder by the length is deleted.  Shorter ones than :data:`SHORTEST` are left out.
    """
    runs = (text or "").encode("latin-1", "replace").translate(LETTERS).split()
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, k in Counter([r for r in runs if len(r) >= SHORTEST]).items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % TYPO_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run, k


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: the words that all texts together hold at least ``least`` times.

    Words are counted inside the tasks first, a bounded number at a time.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in bounded_batches(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for word, k in runs_of(doc_id, text):
                    held[word] = held.get(word, 0) + k
                if len(held) >= HELD_WORDS:
                    yield out()
                    held = {}
        if held:
            yield out()

    found = own_columns(docs, "doc_id", "text").mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@dataclass
class Layout:
    """Where the words of a length have their slots, and how many parts the vocabulary is cut into."""

    base: np.ndarray  # first slot of each length
    slots: np.ndarray
    parts: int

    @staticmethod
    def of(counts: dict[int, int], most: int) -> Layout:
        """``counts``: words per length (that of :data:`LONGEST_SHARD`: or longer)."""
        need = sum(-(-n // WORDS_PER_SLOT) for n in counts.values())
        parts = max(1, -(-need // most))
        slots = np.zeros(LONGEST_SHARD + 1, np.int64)
        for length, n in counts.items():
            slots[length] = max(1, -(-n // (WORDS_PER_SLOT * parts)))
        return Layout(np.concatenate(([0], np.cumsum(slots)[:-1])), slots, parts)

    def place(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and bits of words of ``length`` with these hashes; slot -1 where no word is that long."""
        shard = min(length, LONGEST_SHARD)
        mixed = _mixed(hashes ^ np.uint64(length * _BASE & _WRAP))
        n = int(self.slots[shard])
        if not n:
            return np.full(hashes.shape, -1, np.int64), mixed
        slot = self.base[shard] + ((mixed >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        bits = np.uint64(1) << (mixed & np.uint64(63))
        for k in range(1, SLOT_BITS):
            bits = bits | np.uint64(1) << (mixed >> np.uint64(6 * k) & np.uint64(63))
        return slot, bits


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE & _WRAP, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: column ``i`` is that of the first ``i`` code points, the sum of ``c[j] * base ** j``."""
    terms = (words.astype(np.uint64) + np.uint64(1)) * _powers(words.shape[1])
    return np.concatenate((np.zeros((len(words), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)


def halves(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first half of each word (rounded down) and of the rest."""
    cut = words.shape[1] // 2
    return _mixed(_prefixes(words[:, :cut])[:, -1]), _mixed(_prefixes(words[:, cut:])[:, -1] + np.uint64(1))


def matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letters (a row each) of the words of one length, in bounded pieces."""
    spelled = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // length)
        for start in range(0, len(at), step):
            some = at[start : start + step]
            yield some, np.frombuffer(b"".join(spelled[i] for i in some.tolist()), np.uint8).reshape(-1, length)


def filter_bits(words: DataFrame, layout: Layout, part: int, second: bool) -> np.ndarray:
    """The filter of the words whose first half (``second``: other half) falls into ``part``: one array of slots.

    Bits of a slot are united in Spark; the driver receives each slot once, so no more than the filter's bound.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, m in matrices(b.column("word").to_pylist()):
                if layout.parts > 1:
                    m = m[halves(m)[second] % np.uint64(layout.parts) == part]
                if len(m):
                    slot, bits = layout.place(m.shape[1], _prefixes(m)[:, -1])
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    united = words.select("word").mapInArrow(placed, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(int(layout.slots.sum()), np.uint64)
    out[united.column("slot").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
    return out


def edits(m: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length: ``(new length, place of the edit, rows, new letters or 0, hashes)`` in bounded pieces.

    Deletions of the first of equal neighbours, and replacements by larger letters.
    """
    n, length = m.shape
    prefix, powers = _prefixes(m), _powers(length)
    whole = prefix[:, -1]
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    step = max(1, PROBES // (len(letters) + 1))
    codes = letters.astype(np.uint64)
    for start in range(0, n, step):
        rows = np.arange(start, min(n, start + step))
        for at in range(length):
            own = m[rows, at]
            if length > SHORTEST:
                first = rows if at == 0 else rows[own != m[rows, at - 1]]
                yield length - 1, at, first, np.zeros(len(first), np.uint8), prefix[first, at] + (whole[first] - prefix[first, at + 1]) * inverse
            r, c = np.nonzero(letters[None, :] > own[:, None])
            changed = whole[rows[r]] + (codes[c] - own[r].astype(np.uint64)) * powers[at]
            yield length, at, rows[r], letters[c], changed


def probed(words: DataFrame, layout: Layout, letters: np.ndarray, bits: np.ndarray, part: int, second: bool) -> DataFrame:
    """``(word, n, near)``: edits that the filter lets through, true ones and a few false ones."""
    shipped = words.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for b in batches:
            counts = b.column("n").to_numpy()
            names = b.column("word").to_pylist()
            for places, m in matrices(names):
                found: list[tuple[np.ndarray, list[str]]] = []
                for length, at, rows, new, hashes in edits(m, letters):
                    if layout.parts > 1:
                        # the half of the new word that the edit leaves as it is
                        if (at >= length // 2) == second or not len(rows):
                            continue
                        # the half that stays, as the new word has it
                        if second:
                            kept = _mixed(_prefixes(m[rows, m.shape[1] - (length - length // 2) :])[:, -1] + np.uint64(1))
                        else:
                            kept = _mixed(_prefixes(m[rows, : length // 2])[:, -1])
                        mine = kept % np.uint64(layout.parts) == part
                        rows, new, hashes = rows[mine], new[mine], hashes[mine]
                    slot, wanted = layout.place(length, hashes)
                    if not len(slot) or slot[0] < 0:
                        continue
                    hit = np.flatnonzero(held[slot] & wanted == wanted)
                    spelled = []
                    for row, letter in zip(rows[hit].tolist(), new[hit].tolist()):
                        word = names[places[row]]
                        spelled.append(word[:at] + (chr(letter) if letter else "") + word[at + 1 :])
                    if spelled:
                        found.append((places[rows[hit]], spelled))
                if found:
                    row = np.concatenate([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in row.tolist()]), pa.array(counts[row]), pa.array([w for f in found for w in f[1]])],
                        names=["word", "n", "near"],
                    )

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def near_pairs(words: DataFrame, most_slots: int = FILTER_SLOTS) -> DataFrame:
    """``(word, n, near, near_n)``: every pair of words of ``words(word, n)`` that differ by one edit, once."""
    sizes = words.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("length")).count().collect()
    layout = Layout.of({r["length"]: r["count"] for r in sizes}, most_slots)
    # at most 90 letters
    alphabet = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in alphabet), np.uint8)
    found = None
    for part in range(layout.parts):
        for second in (False, True) if layout.parts > 1 else (False,):
            passed = cut_lineage(probed(words, layout, letters, filter_bits(words, layout, part, second), part, second))
            found = passed if found is None else found.unionByName(passed)
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last form reached from each word.

    A form occurs several times as often as its word, so chains are short and have no rings; their length halves each round.
    """
    held = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = cut_lineage(held.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if held.where("moved").isEmpty():
            return held.select("word", "root")
        held = held.select("word", "root")


def variants(docs: DataFrame, most_slots: int = FILTER_SLOTS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of :func:`vocabulary`.

    ``n_near`` counts the words one edit apart.  ``form`` is the most frequent of them (ties: the smallest in code-point
    order) if it occurs at least :data:`RATIO` times as often, else null; ``root`` is the last form reached.  Null and empty
    texts hold no words; a null ``doc_id`` counts as an empty one in the checksum; repeated rows count each; other columns are
    not read; no words give no rows.
    """
    words = cut_lineage(vocabulary(docs))
    pairs = near_pairs(words, most_slots)
    # both ends of a pair see the other; a word is never gathered, only its best and its number move
    ends = F.array(
        F.struct("word", "n", F.col("near").alias("other"), F.col("near_n").alias("other_n")),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    seen = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("other_n").alias("form_n"), F.min_by("other", F.struct(-F.col("other_n"), F.col("other"))).alias("form"), F.max("n").alias("n")
    )
    good = F.col("form_n") >= RATIO * F.col("n")
    seen = cut_lineage(seen.select("word", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    last = roots(seen.where("form is not null"))
    out = words.join(seen, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
