import itertools
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewrank.llm import elias_fano, forced_bpe, jump_sharding, spaced_seeds, winnowing

AWKWARD = [None, "", " ", "a", "é漢😀" * 9, "x" * 70_000, "one two three", "one two three", None]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "x", 1, True) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, tie string, shard int, is_copy boolean")


def plain_winnow(text, k=winnowing.K, w=winnowing.W):
    """Windows one by one, hashes recomputed gram by gram."""
    points = [ord(c) for c in text or ""]
    if not points:
        return []
    k = min(k, len(points))
    hashes = []
    for i in range(len(points) - k + 1):
        h = 0
        for p in points[i : i + k]:
            h = (h * winnowing._BASE + p) % 2**64
        h ^= h >> 32
        hashes.append((h * winnowing._MIX % 2**64) >> 32)
    w = min(w, len(hashes))
    kept = []
    for i in range(len(hashes) - w + 1):
        window = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if not kept or kept[-1][1] != at:
            kept.append((hashes[at], at))
    return kept


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é漢"), max_size=120), st.integers(1, 9), st.integers(1, 12))
def test_winnowing_equals_plain_windows(text, k, w):
    hashes, places = winnowing.kept_hashes(winnowing.code_points(text), k, w)
    assert list(zip(hashes.tolist(), places.tolist())) == plain_winnow(text, k, w)


def test_shared_run_keeps_a_shared_hash():
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefgh") for _ in range(winnowing.W + winnowing.K - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice("abcdefgh") for _ in range(60)) + run + "".join(rng.choice("ijkl") for _ in range(rng.randint(0, 50))) for _ in "ab")
        assert set(winnowing.kept_hashes(winnowing.code_points(a))[0]) & set(winnowing.kept_hashes(winnowing.code_points(b))[0])


@pytest.mark.parametrize("texts,ids", [
    (AWKWARD, [5, 3, 9, 1, 7, 2, 8, 4, 6]), (AWKWARD, [5, 5, None, 1, -7, 2**62, 8, 1, None]), (["only " * 30], [3]), ([], []),
    ([f"text {i} " * (i % 40) for i in range(200)], [i * i for i in range(200)]),
])
def test_edit_likeness_equals_plain_order(spark, texts, ids):
    got = winnowing.edit_likeness(docs(spark, texts, ids)).collect()
    order = sorted(zip(ids, texts), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] is not None, r[1] or ""))
    want = []
    for n, (i, text) in enumerate(order):
        text, other = text or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        own, new, nxt = ({h for h, _ in plain_winnow(t)} for t in (text, edited, other))
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        print_of = lambda s: winnowing.encoded(np.array(sorted(s), np.uint32))
        want.append((i, len(text), sha256(edited.encode()).hexdigest(), print_of(own), print_of(new), alike(own, new), alike(own, nxt)))
    assert sorted(map(repr, [tuple(r)[:7] for r in got])) == sorted(map(repr, want))
    assert all(r.widest_gap <= winnowing.W for r in got)


def plain_jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_equal_plain_jump_hash(spark):
    rng = random.Random(2)
    ids = [None, None, 0, -1, 2**63 - 1, -(2**63), *range(1, 300), *[rng.getrandbits(63) for _ in range(300)], 5, 5]
    texts = [AWKWARD[i % len(AWKWARD)] for i in range(len(ids))]
    rows = jump_sharding.shard_documents(docs(spark, texts, ids)).collect()
    want = sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), plain_jump(i or 0, 24), plain_jump(i or 0, 25)) for i, t in zip(ids, texts)
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    assert all(r.grown_shard in (r.shard, 24) and r.law == "key" for r in rows)
    for shard in {r.shard for r in rows}:
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in rows if r.shard == shard)
        assert [s for s, *_ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert jump_sharding.shard_documents(docs(spark, [])).count() == 0


def test_text_keys_are_hashed(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    assert {r.shard for r in jump_sharding.shard_documents(df).collect()} <= set(range(24))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2000), st.integers(0, 2**40)), max_size=300))
def test_elias_fano_reads_in_place(values):
    values = sorted(values)
    packed = elias_fano.EliasFano(elias_fano.EliasFano.pack(np.array(values, np.uint64)))
    assert packed.all().tolist() == values and [packed[i] for i in range(len(values))] == values


@pytest.mark.parametrize("size", [2_000_000, 40])
def test_token_segments_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(elias_fano, "SEGMENT_IDS", size)
    library = Tokenizer.from_file(forced_bpe.VOCABULARY)
    texts = AWKWARD + [f"word {i} again {i * i}" for i in range(150)]
    ids = [None, -4, 3, 3, *range(10, 10 + len(texts) - 4)]
    got = elias_fano.token_boundaries(docs(spark, texts, ids)).collect()
    want = []
    for i, t in zip(ids, texts):
        tokens = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    assert sorted(map(repr, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got])) == sorted(map(repr, want))
    rows, at = sorted(got, key=lambda r: r.start), 0
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert elias_fano.token_boundaries(docs(spark, [])).count() == 0


def test_one_document_is_read_without_the_others():
    ids = [[5, 6, 1], [1], [70_000, 2, 3, 1]]
    held = elias_fano.Segment(elias_fano.pack_segment([None, -9, 4], [np.array(x, "<u4").tobytes() for x in ids], 4))
    assert [held[i].tolist() for i in range(3)] == ids and [held.doc_id(i) for i in range(3)] == held.doc_ids() == [None, -9, 4]


def plain_overlaps(words, item, least=spaced_seeds.MIN_RUN):
    """Longest run on any diagonal, every stretch tried."""
    best = 0
    for offset in range(-len(item), len(words)):
        equal = [words[offset + i] == item[i] for i in range(len(item)) if 0 <= offset + i < len(words)]
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                if equal[a] and equal[b - 1] and sum(equal[a:b]) >= 0.8 * (b - a) - 1e-9:
                    best = max(best, b - a)
    return best if best >= min(least, len(item)) else 0


def test_masks_hit_every_accepted_pattern():
    """All places of a fifth of substitutions: anywhere in a part of 12 to 23 tokens, inside an item of fewer."""
    for n in range(1, 24):
        inner = range(n) if n >= spaced_seeds.MIN_RUN else range(1, n - 1)
        counted = [{p + i for i, c in enumerate(m) if c == "1"} for m in spaced_seeds.masks_for(n) for p in range(n - len(m) + 1)]
        for changed in itertools.combinations(inner, min(n // 5, len(inner))):
            assert any(seed.isdisjoint(changed) for seed in counted), (n, changed)


def test_best_run_equals_trying_every_stretch():
    rng = random.Random(3)
    for _ in range(400):
        equal = [rng.random() < rng.choice((0.5, 0.8, 0.95)) for _ in range(rng.randrange(0, 30))]
        fits = [(b - a, -a) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
                if equal[a] and equal[b - 1] and 5 * sum(equal[a:b]) >= 4 * (b - a)]
        n, a = max(fits, default=(0, 0))
        assert spaced_seeds.best_run(np.array(equal, bool)) == (-a, n - a)


def test_overlaps_of_a_repeated_word_and_of_long_items():
    same = np.full(3000, 7, np.uint64)
    assert spaced_seeds.longest_overlap(same, same[:500]) == (0, 0, 500, 500)
    item = np.arange(1, 20_001, dtype=np.uint64)
    doc = np.concatenate((np.full(50, 30_000, np.uint64), item))
    doc[60::6] = 40_000
    assert spaced_seeds.longest_overlap(doc, item) == (50, 0, 20_000, int((doc[50:] == item).sum()))
    assert spaced_seeds.longest_overlap(np.empty(0, np.uint64), item) is None


def bench_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)) + [(None, None), (900, "")], "item_id long, text string")


def test_spaced_seeds_find_substituted_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (40, 30, 25, 20, 16, 15, 14, 13, 12, 11, 10, 9, 7, 6, 5, 4, 3, 1)]
    texts, want = [], {}
    for n, item in enumerate(items):
        for changed in (0, 1, len(item) // 8, len(item) // 5, len(item) // 5, len(item) // 4):
            copy = list(item)
            for at in rng.sample(range(len(item)), changed):
                copy[at] = word()
            texts.append(" ".join([word() for _ in range(30)] + copy + [word() for _ in range(20)]).title())
            if run := plain_overlaps(texts[-1].lower().split(), item):
                want[len(texts) - 1, n] = run
    texts += AWKWARD + [" ".join(word() for _ in range(100)) for _ in range(20)] + [" ".join(items[0][:11] + [word()] + items[1][:11])]
    bench = bench_of(spark, [" ".join(w) for w in items])
    found = spaced_seeds.contaminated(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id): r.n_tokens for r in found} == want and len(found) == len(want) > 60
    for r in found:
        words = texts[r.doc_id].lower().split()[r.doc_token : r.doc_token + r.n_tokens]
        assert sum(a == b for a, b in zip(words, items[r.item_id][r.item_token :])) == r.n_equal >= 0.8 * r.n_tokens
    for least in (1, spaced_seeds.LEAST_ITEM):
        kept = spaced_seeds.decontaminate(docs(spark, texts), bench, least)
        assert kept.columns == docs(spark, texts).columns
        assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, n in want if len(items[n]) >= least}


def test_scripts_without_spaces_repeats_and_clashing_columns(spark):
    chinese, thai = "敏捷的棕色狐狸跳过了那只懒惰的狗然后跑进森林里", "สุนัขจิ้งจอกสีน้ำตาลกระโดดข้ามหมาขี้เกียจ"
    bench = bench_of(spark, [chinese, thai, chinese])
    rows = [(1, f"他说{chinese[:9]}快{chinese[10:]}。", "a"), (None, f"x {thai} y", "b"), (None, f"x {thai} y", "c"), (4, "狐狸和狗", None), (5, None, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string").select("*", F.lit(1).alias("item"), F.lit(2).alias("ids"))
    found = sorted((r.doc_id or 0, r.item_id) for r in spaced_seeds.contaminated(frame, bench).collect())
    assert found == [(0, 1), (0, 1), (1, 0), (1, 2)]
    kept = spaced_seeds.decontaminate(frame, bench)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == [(4, "狐狸和狗", None, 1, 2), (5, None, "e", 1, 2)]


def test_a_filter_that_lets_all_pass_gives_the_same(spark, monkeypatch):
    items = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(12)]
    bench = bench_of(spark, items)
    frame = docs(spark, [f"so {t} end" for t in items] + ["nothing here", "w0x1 " * 70_000])
    whole = sorted(map(tuple, spaced_seeds.contaminated(frame, bench).collect()))
    monkeypatch.setattr(spaced_seeds, "MOST_SLOTS", 1)
    assert sorted(map(tuple, spaced_seeds.contaminated(frame, bench).collect())) == whole and len(whole) == 12
    assert [r.doc_id for r in spaced_seeds.decontaminate(frame, bench).collect()] == [12, 13]
    for none in (bench.limit(0), bench.where("item_id = 900")):
        assert spaced_seeds.contaminated(frame, none).count() == 0 and spaced_seeds.decontaminate(frame, none).count() == 14
    assert spaced_seeds.contaminated(frame.limit(0), bench).count() == 0 and spaced_seeds.decontaminate(frame.limit(0), bench).count() == 0


def test_texts_stay_where_they_are_when_few_leak(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20]))], "item_id long, text string")
    texts = [" ".join(words[:20]), " ".join(words[20:]), None, "", "a few words"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = spaced_seeds.decontaminate(frame, bench)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(spaced_seeds, "BROADCAST_ROWS", 0)
        shuffled = spaced_seeds.decontaminate(frame, bench)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in shuffled.collect()) == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
