"""Token files: all ids of a segment in one array, document boundaries in Elias-Fano code.

A segment file holds, little-endian: the magic and seven counts; the end of every document in the id array and the
document ids, both as Elias-Fano sequences; the ids in 2 or 4 bytes each.  An Elias-Fano sequence of ``n`` growing
numbers up to ``u`` takes about ``2 + log2(u / n)`` bits each: the low bits as they are, the high bits in unary, with
the place of every 64th one noted so that a number is read without decoding those before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewrank.llm import forced_bpe
from reviewrank.llm.common import bounded_batches, map_rows, own_columns
from reviewrank.session import cut_lineage, shared_dir

END_ID = 1
SEGMENT_IDS = 2_000_000  # ids after which a segment is closed; a longer document has one of its own
MAGIC = b"EFTOKENS"
HEADER = struct.Struct("<8sQQQQqQQ")  # magic, documents, ids, bytes per id, documents without an id, least doc_id, bytes of both sequences
SELECT_EVERY = 64
_SEQUENCE = struct.Struct("<QQQ")  # numbers, low bits each, bytes of the unary part


class EliasFano:
    """A sequence of growing numbers (repeats allowed) that is read in its packed form."""

    def __init__(self, data: memoryview | bytes):
        self.n, self.low_bits, high_bytes = _SEQUENCE.unpack_from(data)
        at = _SEQUENCE.size
        ones = -(-self.n // SELECT_EVERY)
        self.marks = np.frombuffer(data, "<u4", ones, at)
        at += 4 * ones
        self.high = np.frombuffer(data, np.uint8, high_bytes, at)
        at += high_bytes
        self.low = np.frombuffer(data, np.uint8, -(-self.n * self.low_bits // 8), at)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        high = np.packbits(unary, bitorder="little")
        head = _SEQUENCE.pack(n, low_bits, len(high))
        return head + places[::SELECT_EVERY].astype("<u4").tobytes() + high.tobytes() + np.packbits(low, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """Place of the one of rank ``i`` in the unary part."""
        at, left = int(self.marks[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        bits = int(self.high[byte]) >> at % 8 << at % 8
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = i * self.low_bits
        first, last = start // 8, -(-(start + self.low_bits) // 8)
        low = int.from_bytes(self.low[first:last].tobytes(), "little") >> start % 8 & (1 << self.low_bits) - 1
        return self.select(i) - i << self.low_bits | low

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A segment file of documents in ascending ``doc_id`` order (those without one first); ``ids``: 32-bit integers."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    ends = EliasFano.pack(np.cumsum([len(x) // 4 for x in ids]))
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    names = EliasFano.pack(np.array([d - least for d in known], np.uint64))
    head = HEADER.pack(MAGIC, len(ids), len(tokens), width, len(doc_ids) - len(known), least, len(ends), len(names))
    return head + ends + names + tokens.astype(f"<u{width}").tobytes()


class Segment:
    """A segment file opened in place: any document is read without touching the others."""

    def __init__(self, data: bytes):
        magic, self.n, n_ids, width, self.nameless, self.least, ends, names = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        view = memoryview(data)
        self.ends = EliasFano(view[HEADER.size : HEADER.size + ends])
        self.names = EliasFano(view[HEADER.size + ends : HEADER.size + ends + names])
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, HEADER.size + ends + names)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nameless else self.names[i - self.nameless] + self.least

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + [int(x) + self.least for x in self.names.all()]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def write_tokens(docs: DataFrame, folder: str, path: str = forced_bpe.VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode all texts, write them in ascending ``doc_id`` order as segments in ``folder`` and return its table of contents.

    ``folder`` must be shared by all executors.  A segment's name follows from its place, and it is put there whole, so a
    task that runs again replaces its files by equal ones.  The table of contents ``(part, segment, n_docs, n_ids)`` is
    written before it is returned.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = own_columns(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "row"]  # the ties let range partitioning split rows without an id, and repeated ones

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = forced_bpe.encoder(path), end_id.to_bytes(4, "little")
        width = 2 if max(len(bpe.names) - 1, end_id) < 1 << 16 else 4
        store, root = fs.FileSystem.from_uri(folder)
        part, segment, size, names, held = TaskContext.get().partitionId(), 0, 0, [], []
        for b in bounded_batches(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                names.append(doc_id)
                held.append(bpe.encode_bytes(text) + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield put(store, root, part, segment, names, held, width, size)
                    segment, size, names, held = segment + 1, 0, [], []
        if names:
            yield put(store, root, part, segment, names, held, width, size)

    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut_lineage(ranged.mapInArrow(encoded, "part int, segment int, n_docs long, n_ids long"))


def put(store, root: str, part: int, segment: int, names: list, held: list[bytes], width: int, size: int) -> pa.RecordBatch:
    """Write one segment under another name, move it to its own, and return its row of the table of contents."""
    hidden = f"{root}/.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(pack_segment(names, held, width))
    store.move(hidden, f"{root}/{part:06d}-{segment:06d}.eft")
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([size], pa.int64()),
    })


def read_tokens(contents: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the segments of ``folder``.

    ``start`` counts the ids of all documents before it: those of earlier segments, from the table of contents, plus the
    boundary inside the segment.
    """
    spark = contents.sparkSession
    per_part = contents.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per partition of the writing job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = contents.join(base, "part").select(
        "part", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base")
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(folder).select(
        F.regexp_extract("path", r"(\d{6})-(\d{6})\.eft$", 1).cast("int").alias("part"),
        F.regexp_extract("path", r"(\d{6})-(\d{6})\.eft$", 2).cast("int").alias("segment"),
        "content",
    )

    def rows_of():
        def each(b):
            out = []
            for part, segment, content in zip(b["part"], b["segment"], b["content"], strict=True):
                held = Segment(content)
                ends = held.ends.all().astype(np.int64).tolist()
                for doc_id, a, z in zip(held.doc_ids(), [0, *ends], ends):
                    out.append((part, segment, doc_id, a, z - a, zlib.crc32(held.ids[a:z].astype("<u4").tobytes())))
            return out

        return each

    rows = map_rows(files, "part int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long", rows_of)
    return rows.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_boundaries(docs: DataFrame, path: str = forced_bpe.VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write all documents as token segments in the shared folder and read them back, one row per row of ``docs``.

    A null text is an empty one: its only id is ``end_id``.  Rows without a ``doc_id`` come first, repeated ids next to
    each other in the order of their texts' hashes.  No documents write no segment and give no rows.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder:  # a plain path, or the short form file:/path
        folder = f"file://{folder.removeprefix('file:')}"
    make_folder(folder)
    return read_tokens(write_tokens(docs, folder, path, end_id), folder)


def make_folder(folder: str) -> None:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
