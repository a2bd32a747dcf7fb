"""Two tokenizers aligned over the same bytes, and how often their tokens meet in a corpus.

All work inside a task is on Arrow columns: token lists are flattened with the indices of their documents, cumulative sums of
token lengths, started anew at each document, give the bytes where tokens end, and a hash join of both tokenizers' ends on
(document, end) gives what both share and, filled backwards, which tokens lie over each other.  ``Table.group_by`` counts
id pairs per document and documents per pair.  Documents are taken in blocks of bounded size; only the counts of a block
leave its task.  Spark merges them, and hands every block the corpus counts of its own pairs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from reviewrank.llm.common import bounded_batches, own_columns
from reviewrank.llm.forced_bpe import byte_alphabet
from reviewrank.session import cut_lineage

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
PIECE_BYTES = 2 << 20  # of text aligned at a time
BLOCK_BYTES = 32 << 20  # of text after which a block is closed; a longer text has one of its own
_COUNTS_IN_ROW = 1 << 16


class Tokens:
    """A tokenizer as a function from texts to id lists, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list], names: list[bytes]):
        self.encode, self.names = encode, pa.array(names, pa.binary())
        self.lengths = pc.binary_length(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def lists(self, texts: list[str]) -> pa.ListArray:
        ids = self.encode(texts)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def byte_level(path: str = VOCABULARY_A) -> Tokens:
    """The byte-level BPE of a vocabulary file, on a space and the text.

    Where ids follow the order of merges, as ranks do, a faster library gives the same ids; other files, and texts that its
    patterns fail on, go through the tokenizers library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = spec["model"]["vocab"]
    special = {t["content"] for t in spec["added_tokens"]}
    names = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for token, i in vocab.items():
        names[i] = token.encode() if token in special else bytes(of[c] for c in token)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    plain = lambda text: library.encode(text, add_special_tokens=False).ids
    before, merges = spec["pre_tokenizer"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ranked = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges)) and sorted(vocab[c] for c in of) == list(range(256))
    usual = before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not spec["normalizer"]
    if not (ranked and usual):
        return Tokens(lambda texts: [plain(" " + t) for t in texts], names)
    ranks = {names[i]: i for token, i in vocab.items() if token not in special}
    fast = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # a panic in its pattern matcher on an extreme text is not an Exception
            if type(e).__name__ != "PanicException":
                raise
            return plain(text)

    return Tokens(lambda texts: [encode(" " + t) for t in texts], names)


def pieces(path: str = VOCABULARY_B) -> Tokens:
    """The sentence pieces of a model file, which puts a space before the text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        names.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokens(lambda texts: model.encode(texts, num_threads=1), names)


def _joined(lists: pa.ListArray, tokens: Tokens) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens one after the other, and where each list starts in them."""
    spelled = tokens.names.take(lists.values)
    _, offsets, data = spelled.buffers()
    ends = np.frombuffer(offsets, np.int32, len(spelled) + 1)
    return memoryview(data or b"").cast("B"), ends[lists.offsets.to_numpy()]


def _spelling(lists: pa.ListArray, tokens: Tokens, wanted: list[bytes]) -> np.ndarray:
    """Whether the tokens of each list spell the bytes wanted."""
    data, at = _joined(lists, tokens)
    return np.array([bytes(data[a:z]) == w for a, z, w in zip(at.tolist(), at[1:].tolist(), wanted)], bool)


def ends(lists: pa.ListArray, tokens: Tokens, name: str) -> pa.Table:
    """``(at, name)``: document and byte where each token ends, in one key, and the token's place in the flat list."""
    parent = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pc.list_parent_indices(lists)
    upto = pc.cumulative_sum(tokens.lengths.take(pc.list_flatten(lists)).cast(pa.int64())).to_numpy()
    starts = np.concatenate(([0], upto))[lists.offsets.to_numpy()[:-1]]
    parent = parent.to_numpy().astype(np.int64)
    return pa.table({"at": (parent << 32) + upto - starts[parent], name: np.arange(len(parent), dtype=np.int32)})


class Alignment:
    """Documents with the tokens of both tokenizers over the same bytes."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, tokens_a: Tokens, tokens_b: Tokens):
        self.ids_a, self.ids_b = a.values.to_numpy(), b.values.to_numpy()
        both = ends(a, tokens_a, "a").join(ends(b, tokens_b, "b"), "at", join_type="full outer", use_threads=False).sort_by("at")
        shared = pc.and_(both["a"].is_valid(), both["b"].is_valid()).to_numpy()
        self.doc = (both["at"].to_numpy() >> 32).astype(np.int32)
        self.ends_a, self.ends_b = both["a"].is_valid().to_numpy(), both["b"].is_valid().to_numpy()
        # between two ends lies one token of each side: the one that ends next
        self.a, self.b = (pc.fill_null_backward(both[c].combine_chunks()).to_numpy() for c in "ab")
        self.shared, self.n_docs = shared, len(a)
        self.n_a, self.n_b = (np.diff(x.offsets.to_numpy()) for x in (a, b))

    def per_doc(self, what: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc if what is None else self.doc[what], minlength=self.n_docs)

    def pairs(self, wide: int) -> pa.Table:
        """``(doc, pair, count)``: the links of each document by id pair, documents in order."""
        pair = self.ids_a[self.a].astype(np.int64) * wide + self.ids_b[self.b]
        counted = pa.table({"doc": self.doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        return counted.rename_columns(["doc", "pair", "count"]).sort_by([("doc", "ascending"), ("pair", "ascending")])

    def group_digests(self, signs: pa.Array) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per document."""
        group = np.cumsum(self.shared) - self.shared  # of each row
        last = np.flatnonzero(self.shared)
        upto_a, upto_b = self.a[last].astype(np.int64) + 1, self.b[last].astype(np.int64) + 1  # tokens up to each group's end
        of_a, of_b = group[self.ends_a], group[self.ends_b]
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int32)
        before_b = np.concatenate(([0], upto_b))[of_a]
        ends_group = np.zeros(len(self.ids_a), np.int32)
        ends_group[upto_a - 1] = 1
        codes[np.arange(len(self.ids_a)) + before_b] = 4 * self.ids_a + ends_group
        sign = np.zeros(len(self.ids_b), np.int32)
        sign[upto_b - 1] = 2
        closing = np.cumsum(self.n_b)[self.n_b > 0] - 1
        sign[closing] = 3
        codes[np.arange(len(self.ids_b)) + upto_a[of_b]] = 4 * self.ids_b + sign
        spelled = signs.take(pa.array(codes))
        _, offsets, data = spelled.buffers()
        at = np.frombuffer(offsets, np.int32, len(spelled) + 1)[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        view = memoryview(data or b"").cast("B")
        return [sha256(view[s:e]).hexdigest() if e > s else "" for s, e in zip(at, at[1:])]


def signs_of(ids: int) -> pa.Array:
    """The decimal of each id with what may follow it: entry ``4 * id + (0 ',', 1 '|', 2 ';', 3 nothing)``."""
    return pa.array([f"{i}{s}" for i in range(ids) for s in (",", "|", ";", "")])


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Growing places and counts, the bytes of equal weight together so that they compress."""
    steps = np.diff(places, prepend=0).astype("<u4")
    planes = np.concatenate((steps, counts.astype("<u4"))).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return np.cumsum(both[:n], dtype=np.int64), both[n:]


_BLOCKS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_pairs int, links binary, pairs array<long>, counts array<long>"
)


def aligned_blocks(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, and rows with the pairs of a block and how many of its documents hold each.

    A document's links are the places of its pairs among those of its block, with their counts.
    """
    schema = T.StructType.fromDDL(_BLOCKS)
    arrow = to_arrow_schema(schema)

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow)

    def closed(block: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        links = pa.concat_tables([h.pop("links") for h in held])
        known = links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "documents"]).sort_by("pair")
        pairs, documents = known["pair"].to_numpy(), known["documents"].to_numpy()
        for at in range(0, len(pairs), _COUNTS_IN_ROW):
            yield rows({"block": [block], "pairs": [pairs[at : at + _COUNTS_IN_ROW]], "counts": [documents[at : at + _COUNTS_IN_ROW]]})
        places, counts, at = np.searchsorted(pairs, links["pair"].to_numpy()), links["count"].to_numpy(), 0
        for h in held:
            packs = []
            for n in h["n_pairs"]:
                packs.append(packed(places[at : at + n], counts[at : at + n]))
                at += n
            yield rows(h | {"links": packs, "block": [block] * len(packs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        signs = signs_of(max(len(a), len(b)))
        block, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in bounded_batches(batches, PIECE_BYTES):
            held.append(aligned(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), a, b, signs))
            size += batch.nbytes
            if size >= block_bytes:
                yield from closed(block, held)
                block, size, held = block + 1, 0, []
        if held:
            yield from closed(block, held)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def aligned(ids: list[int | None], texts: list[str | None], a: Tokens, b: Tokens, signs: pa.Array) -> dict:
    """Columns of the rows of some documents, with all their links as one table under ``links``."""
    some = [i for i, t in enumerate(texts) if t]
    said = [texts[i] for i in some]
    lists_a, lists_b = a.lists(said), b.lists(said)
    wanted = [b" " + t.encode() for t in said]
    good = np.flatnonzero(_spelling(lists_a, a, wanted) & _spelling(lists_b, b, wanted))
    if len(good) < len(said):
        lists_a, lists_b = lists_a.take(pa.array(good)), lists_b.take(pa.array(good))
    at = np.array(some, np.int64)[good]
    out = Alignment(lists_a, lists_b, a, b)
    links = out.pairs(len(b))

    def all_rows(values: np.ndarray) -> np.ndarray:
        full = np.zeros(len(texts), np.int64)
        full[at] = values
        return full

    digests = [""] * len(texts)
    for i, d in zip(at.tolist(), out.group_digests(signs)):
        digests[i] = d
    return {
        "doc_id": ids, "n_a": all_rows(out.n_a), "n_b": all_rows(out.n_b), "n_groups": all_rows(out.per_doc(out.shared)), "n_links": all_rows(out.per_doc()),
        "groups_sha256": digests, "n_pairs": all_rows(np.bincount(links["doc"].to_numpy(), minlength=len(at))), "links": links.select(["pair", "count"]),
    }


def pair_counts(blocks: DataFrame, ids_b: int) -> DataFrame:
    """``(pair, documents, best)``: in how many documents an id pair is linked, and whether no other pair of its A id is in more.

    ``pair`` is the A id times the number of B ids plus the B id.  The best of every A id, at most one row per id of the
    vocabulary, are broadcast.
    """
    merged = cut_lineage(_of_blocks(blocks).groupBy("pair").agg(F.sum("documents").alias("documents")))
    a = F.floor(F.col("pair") / F.lit(ids_b))
    most = merged.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))
    return merged.join(F.broadcast(most), a == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _of_blocks(blocks: DataFrame) -> DataFrame:
    zipped = blocks.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("c"))
    return zipped.select("block", F.col("c.pairs").alias("pair"), F.col("c.counts").alias("documents"))


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_documents(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    A encodes a space and the text, B the text; bytes where tokens of both end cut them into groups, and tokens whose bytes
    overlap are linked.  ``count_sum`` adds up, over a document's links, how many documents hold the pair of ids linked;
    ``n_best`` counts links whose pair is in as many documents as any of its A id.  Null and empty texts, and such as either
    tokenizer does not spell back, have no tokens: zeros and an empty digest.  Repeated rows, and rows without an id, count
    each as a document; other columns are not read; no rows give no rows.
    """
    blocks = cut_lineage(aligned_blocks(docs, path_a, path_b, block_bytes))
    known = cut_lineage(pair_counts(blocks, len(pieces(path_b))))
    own = _of_blocks(blocks).select(F.col("block").alias("of"), "pair").join(known, "pair")
    schema = T.StructType.fromDDL(_ALIGNED)
    arrow = to_arrow_schema(schema)

    def summed(mine: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("pair")
        documents, best = pairs["documents"].to_numpy(), pairs["best"].to_numpy()
        n_best, count_sum = [], []
        for data, n in zip(mine["links"], mine["n_pairs"].to_pylist(), strict=True):
            places, counts = unpacked(data.as_py(), n)
            n_best.append(int(counts[best[places]].sum(dtype=np.int64)))
            count_sum.append(int((documents[places] * counts).sum(dtype=np.int64)))
        done = mine.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return done.select(arrow.names).cast(arrow)

    each = blocks.where("pairs is null").drop("pairs", "counts")
    return each.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(summed, schema)
