import os
import random

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from reviewrank.llm import forced_bpe, near_dedup, simhash_vptree, spaced_seeds, toxicity
from reviewrank.llm.components import connected_components
from reviewrank.session import cut_lineage

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    """Near by definition: a Jaccard likeness of 0.8 over five-word shingles."""
    x, y = shingles(a), shingles(b)
    return x == y or len(x & y) / len(x | y) >= 0.8


def plain_groups(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if find(i) != find(j) and alike(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_near_copies_leave_one_of_each_group(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " ", "one", "one", "one two three four"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([12, 60, 200, 700]))]
        texts.append(" ".join(base))
        for changes in (0, 1, len(base) // 60, len(base) // 25):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = sorted(zip(ids, texts))
    names = "doc_id long, text string, fp string, n double, _id string, id int, Text_Hash string, no_id int, repeated int, `a.b` int"
    frame = spark.createDataFrame([(i, t, "fp", 0.5, "x", 3, "h", 4, 5, 6) for i, t in rows], names)
    kept = near_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    held = kept.collect()
    assert {tuple(r)[2:] for r in held} == {("fp", 0.5, "x", 3, "h", 4, 5, 6)}
    got, groups = {r.doc_id for r in held}, plain_groups(rows)
    assert got == set(groups.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_plain_stages(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels)
    lexicon = toxicity.Lexicon(model.terms)
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    clean = [(i, t) for i, t in rows if model.score(lexicon.features(t)) < toxicity.THRESHOLD]
    groups = plain_groups(clean)
    one = [(i, t) for i, t in clean if groups[i] == i]
    items = [spaced_seeds.tokens(r.text) for r in bench.collect()]
    grams = {tuple(w[i : i + 12]) for w in items for i in range(len(w) - 11)}
    leaked = {i for i, t in one for w in [spaced_seeds.tokens(t)] if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in one} - leaked and leaked and len(one) < len(clean)
    bpe = forced_bpe.encoder()
    assert all(got[i].n_tokens == len(bpe.encode(t)) for i, t in one if i in got)


def test_stages_keep_columns_and_take_empty_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "encoding"]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "encoding" or out.columns == empty.columns)


def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in queries() and {"op10_tool_calls", "op13_source_mixing"} <= set(oracle_sql())


def test_near_copies_behind_a_shared_passage_are_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage, texts = [word() for _ in range(200)], []
    for pair in range(150):
        own = [word() for _ in range(40)]
        copy = list(own)
        copy[20:22] = [word(), word()]
        copy[5] = word()
        texts += [(pair, " ".join(passage + own)), (pair, " ".join(passage + copy))]
    rng.shuffle(texts)
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    first = {pair: i for i, (pair, _) in reversed(list(enumerate(texts)))}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(frame).collect()}
    assert kept == set(first.values())


def test_exact_links_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdef")
    texts = ["", " "] + [" ".join(word() for _ in range(rng.randint(1, 7))) for _ in range(40)]
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    for n in range(100):
        own = list(base[: rng.choice([60, 100, 120])])
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 40)}"
        texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    rows = [(False, i, i, t) for i, t in enumerate(texts)]
    held = cut_lineage(spark.createDataFrame(rows, "no_id boolean, id long, text_hash long, text string"))
    described = cut_lineage(near_dedup.described(held, 5, 0.8).selectExpr("*", "false as repeated"))
    linker = near_dedup.Linker(described, held, 5, 0.8)
    linker.link_rest(near_dedup.postings_of(described, 0.8), first=1)
    links = linker.links.collect()
    sets = [shingles(t) for t in texts]
    near = lambda x, y: x == y or (bool(x | y) and len(x & y) / len(x | y) >= 0.8)
    assert all(near(sets[a], sets[b]) for a, b in links)
    joined = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    got = {r.node: r.root for r in joined}
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_texts_with_one_repeated_line_are_not_near(spark):
    rng = random.Random(13)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    texts = [f"{prose()} " + "one " * 200 for _ in range(3)]
    assert len({simhash_vptree.fingerprint(t, 5) for t in texts}) == 1
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_dedup.drop_near_duplicates(frame).count() == 3


def test_repeated_rows_and_rows_without_an_id(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b"), (7, long), (7, long), (8, long + " x"), (None, None), (2, ""), (None, "only here"), (None, "only here")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in kept), key=str) == sorted([(4, "a b"), (7, "w0 w1"), (2, ""), (None, "only ")], key=str)


def test_parities_bound_the_difference():
    rng = random.Random(14)
    for _ in range(50):
        a = {rng.getrandbits(64) for _ in range(rng.randint(0, 400))}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(rng.randint(0, 60))}
        p, q = (near_dedup.parities(np.array(sorted(x), np.uint64)).view(np.uint64) for x in (a, b))
        assert int(np.bitwise_count(p ^ q).sum()) <= len(a ^ b)


def test_texts_under_one_key_that_cannot_be_near_are_not_paired(spark, monkeypatch):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    line = [word() for _ in range(12)]
    texts = [" ".join(line + [word() for _ in range(int(10 * 1.35**i))]) for i in range(16)]
    texts += [f"{texts[0]} {word()}", f"{texts[7]} {word()}"]
    held = cut_lineage(spark.createDataFrame([(False, i, i, t) for i, t in enumerate(texts)], "no_id boolean, id long, text_hash long, text string"))
    # the line's shingles come first in the order, as in an unlucky sample: every text has them among its keys
    described = near_dedup.described(held, 5, 0.8).collect()
    common = {int(x) for x in near_dedup.shingle_hashes(" ".join(line)).view(np.int64)}
    rows = []
    for r, t in zip(sorted(described, key=lambda r: r.text_hash), texts):
        mine = sorted((int(x) for x in near_dedup.shingle_hashes(t).view(np.int64)), key=lambda x: (x not in common, x))
        rows.append((r.text_hash, r.no_id, r.id, False, r.n, list(r.parity), mine[: len(r["keys"])]))
    ddl = "text_hash long, no_id boolean, id long, repeated boolean, n int, parity array<long>, keys array<long>"
    table = cut_lineage(spark.createDataFrame(rows, ddl))
    linker, met = near_dedup.Linker(table, held, 5, 0.8), []
    plain = linker.verify
    monkeypatch.setattr(linker, "verify", lambda pairs: (met.append(pairs.count()), plain(pairs)))
    linker.link_rest(near_dedup.postings_of(table, 0.8))
    assert {(min(r), max(r)) for r in linker.links.collect()} == {(0, 16), (7, 17)}
    assert sum(met) < 40  # one line in all texts makes 153 pairs under each of its keys
