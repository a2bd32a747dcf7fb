import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from reviewrank.llm import source_mixing as M

DDL = "doc_id long, source string, text string, size string, drawn int, rate double, copy string, _copy int"


def level_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The excess of full sources dealt again and again, as the definition has it."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[n] for n in open_)
        for n in open_:
            target[n] += left * weight[n] / total
        left = 0.0
        for n in list(open_):
            if target[n] >= most * sizes[n]:
                left += target[n] - most * sizes[n]
                target[n] = most * sizes[n]
                open_.discard(n)
    return target


def drawn(doc_id, text, seed=M.SEED):
    parts = [str(seed)] + ([] if doc_id is None else [str(doc_id)]) + ([] if text is None else [hashlib.md5(text.encode()).hexdigest()])
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 16**13


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    per = defaultdict(int)
    for (_, s, _), n in zip(rows, size):
        per[s] += n
    target = level_targets(per)
    out = []
    for (i, s, t), n in zip(rows, size):
        rate = target[s] / per[s] if per[s] else 0.0
        out.append((i, n, per[s], target[s], n * (int(rate) + (drawn(i, t) < rate - int(rate)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 7, 0.1, "c", 1) for i, s, t in rows], DDL)


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r[:3]) + (round(r[3], 6), r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3], rel=1e-9)


def rows_of(seed, sources, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "c d", "e\x0b", " "])
    rows = [(i, rng.choice(sources), " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(None, sources[0], "p q"), (None, None, None), (5, sources[0], "same x"), (5, sources[0], "same x"), (9, "", ""), (10, None, "long " * 70_000)]


@pytest.mark.parametrize("seed,sources", [(1, ["s"]), (2, ["a", "b", "B", "é", "￿", "\U0001f600"]), (3, ["big"] * 30 + ["x", "y"]), (4, [f"s{i}" for i in range(40)])])
def test_equals_the_definition(spark, tiny_tasks, seed, sources):
    rows = rows_of(seed, sources)
    same(M.taken_words(frame(spark, rows)).collect(), plain(rows))


def test_all_bounds_below_what_is_wanted(spark):
    rows = [(i, "ab"[i % 2], "w " * (i + 1)) for i in range(10)]
    got = M.taken_words(frame(spark, rows), share=3.0).collect()
    assert all(r.taken == 2 * r.size and r.target == 2.0 * r.source_size for r in got)


def test_empty_tables_and_sources(spark):
    assert M.taken_words(frame(spark, [])).count() == 0 and M.mix(frame(spark, [])).count() == 0
    assert [tuple(r) for r in M.taken_words(frame(spark, [(1, "a", ""), (2, None, None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_the_mix_holds_each_document_as_often_as_it_is_taken(spark):
    rows = rows_of(6, ["a", "b", "c"])
    docs = frame(spark, rows)
    mixed = M.mix(docs)
    assert mixed.columns == [*docs.columns, "__copy"]
    held = [tuple(r) for r in mixed.collect()]
    assert {r[3:8] for r in held} == {("x", 7, 0.1, "c", 1)}
    got = Counter(r[:3] for r in held)
    want = Counter()
    for row, (_, size, _, _, taken) in zip(rows, plain(rows)):
        if size:
            want[row] += taken // size
    assert got == +want
    assert all(r[-1] in (0, 1) for r in held)


def test_words_taken_come_near_the_targets(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaaaaabcd"), "w " * rng.randint(1, 40)) for i in range(8000)]
    taken, target = Counter(), {}
    for r, (_, s, _) in zip(M.taken_words(frame(spark, rows)).orderBy("doc_id").collect(), rows):
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] / target[s] - 1) < 0.05 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(len(t.split()) for _, _, t in rows))
