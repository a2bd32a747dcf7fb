"""BPE encoding with forced boundaries, and decoding.

A merge joins two neighbouring symbols into a vocabulary token, so it can cross the border between bytes ``a`` and
``b`` only if some token holds ``a`` directly followed by ``b``.  Where no token does, a cut is certain: the fragments
on both sides are encoded independently and their ids concatenated.  Fragments repeat, so each is merged once per task.
"""

from __future__ import annotations

import json
from hashlib import sha256

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from reviewrank.llm.common import held_by_worker, map_rows, own_columns

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CACHED_CHUNKS, CACHED_FRAGMENTS = 700_000, 400_000  # kept per worker; beyond that a cache starts anew (speed only)
CACHED_LENGTH = 48
END = "</w>"
LATIN = "\u024f"  # letters up to here have one composed form and a lower case that stays a letter ("İ" apart)
_SPACE = r"\t-\r \x85\p{Zs}\p{Zl}\p{Zp}"  # white space as the tokenizer's own patterns see it
_ODD_SPACE = regex.compile("[\x1c-\x1f]")  # white space for str.split(), but not for the tokenizer
_SPACES = regex.compile(f"[{_SPACE}]+")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file (lower-casing, word-end byte BPE)."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.vocab | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        library = Tokenizer.from_file(path)
        self._normalizer, self._pre_tokenizer = library.normalizer, library.pre_tokenizer
        self._special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.joined = set()  # neighbouring bytes that occur inside some token
        for token in self.vocab:
            body = token.removesuffix(END)
            self.joined.update(zip(body, body[1:]))
        merges = [tuple(m) for m in spec["model"]["merges"]]
        # by whether the fragment ends its word: the merges of one fragment, and the fragments seen
        self._merges = {last: models.BPE(self.vocab, merges, **({"end_of_word_suffix": END} if last else {})) for last in (False, True)}
        self._fragments: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        self._chunks: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """``word`` (in the byte alphabet) cut wherever no token spans the border."""
        cuts = [0, *(i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _fragment(self, fragment: str, last: bool) -> bytes:
        known = self._fragments[last]
        ids = known.get(fragment)
        if ids is None:
            ids = b"".join([self.packed[t.id] for t in self._merges[last].tokenize(fragment)])
            if len(fragment) <= CACHED_LENGTH:
                if len(known) >= CACHED_FRAGMENTS:
                    known.clear()
                known[fragment] = ids
        return ids

    def _word(self, word: str) -> bytes:
        return self._mapped(word.encode("utf-8").decode("latin-1").translate(self.alphabet))

    def _mapped(self, word: str) -> bytes:
        if self.joined.issuperset(zip(word, word[1:])):  # nothing forces a cut
            return self._fragment(word, True)
        *inner, last = self.fragments(word)
        return b"".join([self._fragment(part, False) for part in inner]) + self._fragment(last, True)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as little-endian unsigned 32-bit integers."""
        ids = self._chunks.get(chunk)
        if ids is None:
            if not chunk.isascii() and (max(chunk) > LATIN or "İ" in chunk):  # as the library's Unicode tables say
                words = self._pre_tokenizer.pre_tokenize_str(self._normalizer.normalize_str(chunk))
                ids = b"".join([self._mapped(w) for w, _ in words])
            elif chunk[-1] in ".," and chunk[:-1].isalpha():  # a word and one mark
                ids = self._chunk(chunk[:-1]) + self._word(chunk[-1])
            else:
                text = chunk.lower()
                ids = self._word(text) if text.isalpha() else b"".join([self._word(w) for w in _WORDS.findall(text)])
            if len(chunk) <= CACHED_LENGTH:
                if len(self._chunks) >= CACHED_CHUNKS:
                    self._chunks.clear()
                self._chunks[chunk] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """All ids of ``text`` (null: none) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for k, part in enumerate(self._special_at.split(text)):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            chunks = _SPACES.split(part) if _ODD_SPACE.search(part) else part.split()
            known = self._chunks
            out += [known[c] if c in known else self._chunk(c) for c in chunks if c]
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Token names joined by single spaces, special tokens included (the file names no decoder)."""
        names = self.names
        return " ".join([names[i] for i in ids])


def encoder(path: str = VOCABULARY) -> ForcedBoundaryBPE:
    """One encoder per Python worker and file: tables and caches outlive a task."""
    return held_by_worker(("encoder", path), lambda: ForcedBoundaryBPE(path))


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every whole text (null or empty: none)."""

    def rows_of():
        bpe = encoder(path)
        return lambda b: [(i, bpe.encode(t)) for i, t in zip(b["doc_id"], b["text"], strict=True)]

    return map_rows(own_columns(docs, "doc_id", "text"), "doc_id long, ids array<int>", rows_of)


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``.

    A null text is an empty one; a null ``doc_id`` stays null; repeated rows each give a row; other columns are not read.
    """

    def rows_of():
        bpe = encoder(path)

        def each(b):
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                raw = bpe.encode_bytes(t)
                ids = np.frombuffer(raw, "<u4").tolist()
                text = bpe.decode(ids)
                out.append((i, len(ids), sha256(raw).hexdigest(), sha256(text.encode("utf-8")).hexdigest()))
            return out

        return each

    return map_rows(own_columns(docs, "doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows_of)
