import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewrank.llm import forced_bpe, near_dedup, simhash_vptree
from reviewrank.llm.components import connected_components

AWKWARD = [None, "", " \n", "a", "a b", "A b c d", "x " * 30_000, "Ünï 漢字 İ. ΣΑΣ it's <|endoftext|> 12", "a b", None]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, shard int")


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, r):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= r:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = AWKWARD + base + [t + " z" for t in base] + base[:10] + ["B " + t for t in base[:20]]
    got = {r.doc_id: r for r in simhash_vptree.near_duplicates(docs(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {i: r.component_id for i, r in got.items()} == dict(enumerate(plain_components(prints, 2)))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 4), st.integers(2, 700))
def test_spanning_links_lose_no_connection(seed, flips, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 1 + n // 40, dtype=np.uint64)
    points = centres[rng.integers(0, len(centres), n)]
    for _ in range(flips):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    points = np.unique(points)
    tree, leaves = simhash_vptree.top_tree(points[: len(points) // 2 + 1], 6)
    linked = {}
    for _, at in simhash_vptree.route(tree, points):
        for a, b in zip(*simhash_vptree.spanning_links(points[at])):
            linked.setdefault(int(a), set()).add(int(b))
            linked.setdefault(int(b), set()).add(int(a))
    place = {int(p): i for i, p in enumerate(points)}
    want = plain_components([int(p) for p in points], 2)
    seen = {}
    for p in map(int, points):
        if p in seen:
            continue
        todo, seen[p] = [p], place[p]
        while todo:
            for q in linked.get(todo.pop(), ()):
                if q not in seen:
                    seen[q] = place[p]
                    todo.append(q)
    assert [seen[int(p)] for p in points] == want


def test_a_dense_ball_stays_whole():
    points = np.array([1 << i for i in range(64)] + [0] + [1 << i | 1 << j for i in range(64) for j in range(i)], np.uint64)
    a, _ = simhash_vptree.spanning_links(points)
    assert len(set(a.tolist())) == len(points) - 1


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i + 1, i) for i in range(0, 60)]
    hub = [(100, 100 + i) for i in range(1, 80)] + [(500, 400), (500, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)} | {400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_component_stays(spark):
    texts = ["a b c d e", "a b c d e", None, "", "q r s t u v", "q r s t u v"]
    frame = docs(spark, texts, [7, 3, None, 5, None, None])
    kept = near_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [(3, "a b c d e"), (5, ""), (None, "q r s t u v")]))
    assert near_dedup.drop_near_duplicates(frame.limit(0)).count() == 0
    assert simhash_vptree.near_duplicates(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(forced_bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_round_trip_equals_library(spark, library):
    from hashlib import sha256

    got = {r.doc_id: r for r in forced_bpe.round_trip(docs(spark, AWKWARD)).collect()}
    for i, t in enumerate(AWKWARD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[i]) == (i, len(ids), sha256(raw).hexdigest(), sha256(text.encode()).hexdigest())
    assert [len(r.ids) for r in forced_bpe.encode_documents(docs(spark, ["a b", None])).orderBy("doc_id").collect()] == [2, 0]
    assert forced_bpe.round_trip(docs(spark, [])).count() == 0


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" aeéstTSΣςİ'.,\x1c\x85 ̧")), max_size=40))
def test_any_text_equals_library(library, text):
    bpe = forced_bpe.encoder()
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids
    assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_forced_boundary():
    bpe = forced_bpe.encoder()
    assert "".join(bpe.fragments("qzxjĠĠ")) == "qzxjĠĠ" and len(bpe.fragments("Ãł漢"[:2])) >= 1
    assert all(len(bpe.fragments(t.removesuffix(forced_bpe.END))) == 1 for t in bpe.vocab if len(t) > len(forced_bpe.END) or not t.endswith(forced_bpe.END))


def test_a_full_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(forced_bpe, "CACHED_CHUNKS", 2)
    monkeypatch.setattr(forced_bpe, "CACHED_FRAGMENTS", 2)
    text = "one two three one, two. Three four five one"
    assert forced_bpe.ForcedBoundaryBPE().encode(text) == library.encode(text, add_special_tokens=False).ids
