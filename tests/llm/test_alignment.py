import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewrank.llm import token_alignment as A
from reviewrank.llm.forced_bpe import byte_alphabet

DDL = "doc_id long, text string, block string, pair double, links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 0.5, 1) for i, t in rows], DDL)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A.VOCABULARY_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=A.VOCABULARY_B)


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(rows, libraries):
    a, b = libraries
    of = {c: x for x, c in enumerate(byte_alphabet())}
    done, holds = [], Counter()
    for _, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
            ids_a, ids_b, parts_a, parts_b = [], [], [], []
        sa, sb = spans(parts_a), spans(parts_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, sa) for y, (t, f) in zip(ids_b, sb) if s < f and t < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            inside = lambda ids, where: ",".join(str(i) for i, (s, e) in zip(ids, where) if low <= s and e <= high)  # noqa: B023, E731
            groups.append(f"{inside(ids_a, sa)}|{inside(ids_b, sb)}")
        done.append((ids_a, ids_b, groups, links))
        holds.update(set(links))
    best = Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return [
        (i, len(ids_a), len(ids_b), len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (i, _), (ids_a, ids_b, groups, links) in zip(rows, done)
    ]


ODD = [None, "", " ", "  two  spaces ", "▁", "a▁b", "<s> </s> <unk>", "<|endoftext|>", "<0x41>", "é", "naïve Ærø\n\tx\r\n", "日本語 テキスト", "😀👩‍🚀 ok", "a\x00b", "́", "x" * 300, "﻿bom"]


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "thnting", "reé", "Ouèon", "in", "tokenizers", "42", "3.14", "don't", "日本", "\n", "—", "ß", "X"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(n)]
    rows = list(enumerate(ODD + texts))
    return rows + [(None, "no id"), (None, None), rows[30], rows[30], (rows[30][0], "another text")]


def keyed(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("block_bytes", [A.BLOCK_BYTES, 1])
def test_equals_brute_force(spark, libraries, block_bytes):
    rows = rows_of(1)
    got = A.aligned_documents(frame(spark, rows).repartition(3), block_bytes=block_bytes).collect()
    want = plain(rows, libraries)
    assert keyed(got) == keyed(want)
    assert sum(r[1] > 0 for r in want) > 60 and any(r[4] > max(r[1], r[2]) for r in want)


def test_small_pieces_make_the_same_blocks(spark, libraries, monkeypatch):
    rows = rows_of(2, 20)
    a, b = A.byte_level(), A.pieces()
    signs = A.signs_of(max(len(a), len(b)))
    whole = A.aligned([i for i, _ in rows], [t for _, t in rows], a, b, signs)
    each = [A.aligned([i], [t], a, b, signs) for i, t in rows]
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"):
        assert list(whole[c]) == [e[c][0] for e in each]


def test_long_texts(spark, libraries):
    rng = random.Random(3)
    rows = [(1, "word " * 14_000 + "z" * 70_000), (2, "".join(rng.choice("abcé \n") for _ in range(70_000)))]
    got = keyed(A.aligned_documents(frame(spark, rows)).collect())
    a, b = libraries
    assert [r[1:3] for r in got] == [(len(a.encode(" " + t, add_special_tokens=False).ids), len(b.encode(t))) for _, t in rows]


def test_empty(spark):
    assert A.aligned_documents(frame(spark, [])).collect() == []
    zero = (0, 0, 0, 0, 0, 0, "")
    assert keyed(A.aligned_documents(frame(spark, [(1, None), (2, "")])).collect()) == [(1, *zero), (2, *zero)]


def test_fast_encoder_equals_the_library(libraries):
    rng, fast = random.Random(4), A.byte_level()
    letters = list("abc deTH'sllver  \n\t\r0123,.!?-_é€日本ñ😀‍́\xa0　<|>\x00\x1c\x85")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["\n" * 2000, "'" * 999, " " * 400_000]
    for t, ids in zip(texts, fast.encode(texts)):
        assert list(ids) == libraries[0].encode(" " + t, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_library(tmp_path, libraries):
    with open(A.VOCABULARY_A, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["the end", "x y"]
    assert A.byte_level(str(path)).encode(texts) == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_packed_places_come_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 700):
        places, counts = np.sort(rng.choice(1 << 24, n, replace=False)), rng.integers(1, 70_000, n)
        back = A.unpacked(A.packed(places, counts), n)
        assert np.array_equal(back[0], places) and np.array_equal(back[1], counts)
