import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewrank.llm import spelling as S

DDL = "doc_id long, text string, word string, n int, near string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "x") for i, t in rows], DDL)


def plain_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def corpus(seed, alphabet="abcé", n=70, docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 10)))
    base = [word() for _ in range(n)]
    typo = []
    for w in base:
        for _ in range(3):
            at, how = rng.randrange(len(w)), rng.randrange(3)
            typo.append(w[:at] + ("", rng.choice(alphabet), w[at] + rng.choice(alphabet))[how] + w[at + 1 :])
    weights = [200 // (i + 1) + 1 for i in range(len(base))] + [1] * len(typo)
    rows = [(i, " ".join(rng.choices(base + typo, weights, k=rng.randint(0, 80)))) for i in range(docs)]
    return rows + [(None, None), (None, base[0].upper() + "," + base[0]), (3, ""), (3, " 1 Ā "), (rows[0]), (77, "z" * 70_000 + " " + "z" * 70_000 + " " + "z" * 69_999 + " " + "z" * 69_999)]


@pytest.mark.parametrize("seed,alphabet,slots", [(1, "abcé", S.FILTER_SLOTS), (2, "ab", S.FILTER_SLOTS), (3, "abcdefghÀÿ×", S.FILTER_SLOTS), (4, "abc", 7), (5, "abcé", 30)])
def test_equals_brute_force(spark, seed, alphabet, slots):
    rows = corpus(seed, alphabet)
    if slots != S.FILTER_SLOTS:
        assert S.Layout.of(Counter(map(len, plain_words(rows[:-1]))), slots).parts > 1
        rows = rows[:-1]
    got = sorted((tuple(r) for r in S.variants(frame(spark, rows), slots).collect()), key=lambda r: r[0])
    assert got == plain(rows)
    assert any(r[1] for r in got)


def test_forms_are_followed_to_the_last(spark):
    forms = [("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("a", "r"), ("r", "s")]
    got = {r.word: r.root for r in S.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {"d": "s", "c": "s", "b": "s", "a": "s", "r": "s", "x": "y"}


def test_empty(spark):
    for rows in ([], [(1, None), (None, "")], [(1, "abcdefgh")]):
        assert S.variants(frame(spark, rows)).collect() == []
    assert S.variants(frame(spark, [])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_edits_have_the_hashes_of_their_words():
    words = np.frombuffer(b"abbacabaccabbbbb", np.uint8).reshape(2, 8)
    letters = np.frombuffer(b"abc", np.uint8)
    seen = [set(), set()]
    for length, at, rows, new, hashes in S.edits(words, letters):
        for r, c, h in zip(rows.tolist(), new.tolist(), hashes.tolist()):
            w = words[r].tobytes()
            edited = w[:at] + (bytes([c]) if c else b"") + w[at + 1 :]
            assert len(edited) == length and h == int(S._prefixes(np.frombuffer(edited, np.uint8)[None, :])[0, -1])
            assert edited not in seen[r]
            seen[r].add(edited)
    want = lambda w: {w[:i] + w[i + 1 :] for i in range(8)} | {w[:i] + bytes([c]) + w[i + 1 :] for i in range(8) for c in b"abc" if c > w[i]}
    assert seen == [want(words[0].tobytes()), want(words[1].tobytes())]


def test_filter_lets_few_false_edits_through(spark):
    rng = random.Random(9)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3000)})
    layout = S.Layout.of({9: len(words)}, S.FILTER_SLOTS)
    bits = S.filter_bits(spark.createDataFrame([(w,) for w in words], "word string"), layout, 0, False)
    other = np.frombuffer("".join("".join(rng.choice("qrstuvwxyz") for _ in range(9)) for _ in range(20_000)).encode(), np.uint8).reshape(-1, 9)
    slot, wanted = layout.place(9, S._prefixes(other)[:, -1])
    assert np.mean(bits[slot] & wanted == wanted) < 0.02
    own = np.frombuffer("".join(words).encode(), np.uint8).reshape(-1, 9)
    slot, wanted = layout.place(9, S._prefixes(own)[:, -1])
    assert np.all(bits[slot] & wanted == wanted)
