import json
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewrank.llm import license_scan, tool_calls, toxicity, wordpiece_counts
from reviewrank.llm.license_templates import TEMPLATES

AWKWARD = [None, "", " \n\n", "a", "é漢😀 " * 9, "x" * 70_000, "one two three", "one two three", None]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, toxic string, licenses int")


def plain_dice(a, b):
    a, b = (Counter(zip(w, w[1:])) for w in (license_scan.words_of(a), license_scan.words_of(b)))
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if a and b else 0.0


def plain_scan(text):
    """Every passage against every template, nothing pruned."""
    lines = (text or "").split("\n")
    spans = {(k, k + 1) for k in range(len(lines))} | {(0, len(lines))}
    start = 0
    for k in [*(k for k, line in enumerate(lines) if not line.strip(" \t\r")), len(lines)]:
        spans.add((start, k))
        start = k + 1
    best = {}
    for a, z in sorted(s for s in spans if s[0] < s[1]):
        scores = sorted((-plain_dice("\n".join(lines[a:z]), t), name) for name, t in TEMPLATES.items())
        if -scores[0][0] >= license_scan.THRESHOLD - 1e-12:
            name, dice = scores[0][1], -scores[0][0]
            if name not in best or (-dice, a, z - a) < best[name]:
                best[name] = (-dice, a, z - a)
    return [(n, round(-d, 9), a, k) for n, (d, a, k) in sorted(best.items())]


def test_licenses_equal_comparing_everything(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts = list(AWKWARD)
    for text in TEMPLATES.values():
        words = text.split()
        noisy = [word() if rng.random() < 0.05 else w for w in words]
        wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        texts += [text, " ".join(noisy), f"{word()} {word()}\n\n{wrapped.upper()}\n \n{word()}", f"{word()} text\nreleased\n{text}\n{text}"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(x.license, round(x.dice, 9), x.line, x.lines) for x in got[i].licenses] == plain_scan(t), t
        assert got[i].n_licenses == len(got[i].licenses)
    assert got[len(AWKWARD)].licenses[0].dice == 1.0


@given(st.integers(1, 400), st.integers(1, 400))
def test_pruned_sizes_cannot_reach_the_threshold(a, b):
    index = license_scan.TemplateIndex({"t": " ".join(f"w{i}" for i in range(b + 1))})
    assert (0 in index.candidates(a)) == (2 * min(a, b) / (a + b) >= license_scan.THRESHOLD - 1e-9)


def plain_pieces(data, tokens):
    at = count = 0
    while at < len(data):
        size = max((n for n in range(1, len(data) - at + 1) if data[at : at + n] in tokens), default=0)
        if not size:
            return 1
        at, count = at + size, count + 1
    return count


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=12), st.binary(max_size=30))
def test_linear_counts_equal_greedy_matching(tokens, data):
    data = bytes(x % 3 + 97 for x in data)
    assert wordpiece_counts.LongestMatchCounter(tokens).pieces(data) == plain_pieces(data, set(tokens))


def test_token_counts_of_texts(spark, monkeypatch):
    tokens = set(wordpiece_counts.vocabulary_bytes())
    texts = AWKWARD + ["The quick brown Fox, jumps: über 漢字!", "wordword " * 40]
    texts[5] = "xy" * 400
    want = {i: (len((t or "").split()), sum(plain_pieces(b" " + w.encode(), tokens) for w in (t or "").split())) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_words, r.n_pieces) for r in wordpiece_counts.token_counts(docs(spark, texts)).collect()} == want
    assert wordpiece_counts.token_counts(docs(spark, [])).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=3, max_size=8), st.booleans()), max_size=6, unique_by=lambda x: x[0]), st.text("abc", min_size=1, max_size=9))
def test_automaton_finds_terms_one_edit_away(terms, word):
    lexicon = toxicity.Lexicon([(t, whole, 1.0 + k) for k, (t, whole) in enumerate(terms)])
    found = lexicon.find(word)
    exact = any(word == t if whole else word.startswith(t) for t, whole in terms)
    near = len(word) >= toxicity.FUZZY_LENGTH and any(
        len(t) >= toxicity.FUZZY_LENGTH and (plain_edits(word, t) <= 1 if whole else min(plain_edits(word[:n], t) for n in range(len(word) + 1)) <= 1) for t, whole in terms
    )
    assert (found is not None and found[1] == 0) == exact
    assert (found is not None) == (exact or near)


def toxic_corpus(n=900):
    rng = random.Random(9)
    clean = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    bad = ["zworthless", "xqidiot", "qscumbag"]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        label = int(i % 4 == 0)
        if label:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) if i % 8 else "vyrq" + rng.choice(clean))
        texts.append(" ".join(words))
        toxic.append(label)
    return texts, toxic


def test_toxicity_on_the_held_out_fold(spark):
    texts, toxic = toxic_corpus()
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (77_777, 0), (5, None)], "doc_id long, toxic int")
    frame = docs(spark, texts + AWKWARD)
    model = toxicity.fit(frame, labels)
    assert {t for t, _, _ in model.terms} >= {"zwo", "xqi"} or any(t.startswith(("zwo", "xqi")) for t, _, _ in model.terms)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    score_of = lambda t: model.score(toxicity.Lexicon(model.terms).features(t))
    plain, told, wrong = (score_of(t) for t in ("you are a xqidiot and a zworthless one", 'they said "xqidiot" and "zworthless"', "you are a xqidlot and a zwortless one"))
    assert plain > 0.5 and told < plain and wrong > score_of("you are a good one")
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


@pytest.mark.parametrize("toxic", [[], [(0, 0), (1, 0), (3, 0)], [(0, 1)]])
def test_toxicity_without_both_labels(spark, toxic):
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    rows = toxicity.toxicity(docs(spark, AWKWARD), labels).collect()
    assert len(rows) == len(AWKWARD) and len({r.score for r in rows}) == 1
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")


def results(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, turn long, content string")


def test_calls_follow_what_they_depend_on(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(12):
        names = [f"c{i}" for i in range(rng.randint(1, 14))]
        depth = list(names)
        rng.shuffle(depth)  # a hidden order that the dependencies respect, whatever the turns say
        for turn, c in enumerate(names):
            deps = [d for d in depth[: depth.index(c)] if rng.random() < 0.3]
            want[conv, c] = deps
            rows.append((conv, c, turn, "measure", '{"query":"q"}', deps + ["nowhere", c]))
    got = tool_calls.link_calls(calls(spark, rows), results(spark, [])).collect()
    seq = {(r.conv_id, r.call_id): r.seq for r in got}
    assert all(r.settled for r in got) and len(got) == len(rows)
    assert all(seq[conv, d] < seq[conv, c] for (conv, c), deps in want.items() for d in deps)
    for conv in range(12):
        assert sorted(s for (k, _), s in seq.items() if k == conv) == list(range(sum(k == conv for k, _ in seq)))


def test_long_chains_are_put_in_order(spark):
    rng = random.Random(9)
    rows, deps = [], []
    for conv, n in ((1, 1000), (2, 130)):  # every call depends on the one with the next number; all at one turn, or backward in turns
        for i in range(n):
            after = [f"c{i + 1:04d}"] if i + 1 < n else []
            rows.append((conv, f"c{i:04d}", 7 if conv == 1 else i, "measure", '{"query":"q"}', after))
            deps += [(conv, f"c{i:04d}", a) for a in after]
    for i in range(60):  # several dependencies each
        after = [f"m{j:03d}" for j in {i - 1, i - 2, rng.randrange(i + 1)} if 0 <= j < i]
        rows.append((3, f"m{i:03d}", 60 - i, "measure", '{"query":"q"}', after + (["ring1"] if i == 50 else [])))
        deps += [(3, f"m{i:03d}", a) for a in after]
    ring = [(3, f"ring{i}", i, "measure", '{"query":"q"}', [f"ring{(i + 1) % 3}"]) for i in range(3)]
    got = tool_calls.link_calls(calls(spark, rows + ring + [(3, "lead", 1, "measure", '{"query":"q"}', ["ring0"])]), results(spark, [])).collect()
    seq = {(r.conv_id, r.call_id): r.seq for r in got}
    assert all(seq[c, a] < seq[c, i] for c, i, a in deps)
    assert {r.call_id for r in got if not r.settled} == {"ring0", "ring1", "ring2", "lead", "m050"}


def test_a_ring_of_calls_with_several_dependencies_is_told(spark):
    rows = [(1, "a", 0, "measure", "{}", ["b", "z"]), (1, "b", 1, "measure", "{}", ["a", "z"]), (1, "z", 5, "measure", "{}", []), (1, "y", 0, "measure", "{}", ["z"])]
    got = {r.call_id: r for r in tool_calls.link_calls(calls(spark, rows), results(spark, [])).collect()}
    assert {c for c, r in got.items() if not r.settled} == {"a", "b"} and got["y"].seq > got["z"].seq


def test_cycles_are_told_and_links_are_made(spark):
    rows = [
        (1, "a", 0, "search", '{"query":"x","limit":3}', ["b"]), (1, "b", 1, "search", '{"limit":30,"query":7,"more":1}', ["a"]),
        (1, "c", 2, "summarize", '{"style":"long", "query":"é\\n\\"q\\""}', None), (1, "d", 3, "nothing", "{}", []), (1, "e", 4, "search", "no json", []),
        (1, "f", 5, "search", None, []), (1, "g", 6, "search", "[1]", []), (1, "g", 7, None, '{"a":1,"a":2}', []), (None, "h", 1, "search", "{}", []), (2, None, 1, "search", "{}", []),
        (1, "i", 9, "measure", '{"query":"q","exact":null}', []), (1, "j", 10, "measure", '{"exact":"y"}', []),
    ]
    found = [(1, "c", 5, "late"), (1, "c", 3, None), (1, "c", 3, "b"), (1, "zz", 3, "orphan"), (None, "c", 1, "x"), (1, "d", 4, 'say "hi"\n')]
    got = {(r.call_id, r.tool): r for r in tool_calls.link_calls(calls(spark, rows), results(spark, found)).collect()}
    assert len(got) == 10 and {c for (c, _), r in got.items() if not r.settled} == {"a", "b"}
    errors = {k: r.errors for k, r in got.items()}
    assert errors["a", "search"] == "" and errors["b", "search"] == "query: not string; limit: above 20; more: unexpected"
    assert errors["c", "summarize"] == "" and errors["d", "nothing"] == "unknown tool" and errors["e", "search"] == errors["f", "search"] == errors["g", "search"] == "arguments: not an object"
    assert errors["i", "measure"] == "" and errors["j", "measure"] == "query: missing; exact: not boolean"
    assert got["c", "summarize"].n_results == 3 and json.loads(got["d", "nothing"].canonical_json)["result"] == 'say "hi"\n'
    for r in got.values():
        held = json.loads(r.canonical_json)
        assert r.canonical_json == json.dumps(held, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and list(held) == ["after", "arguments", "id", "name", "result"]


def test_conversations_with_nothing(spark):
    ddl = "conv_id long, turn long, role string, text string, call_id int"
    rows = [(1, 0, "user", "q", 1), (1, 1, "assistant", None, 1), (1, 2, "user", None, 1), (None, 1, "assistant", "x", 1), (1, None, "assistant", "x", 1), (2, 0, None, "x", 1)]
    got = tool_calls.tool_conversations(spark.createDataFrame(rows, ddl)).collect()
    assert [(r.call_id, r.n_results, r.errors) for r in got][0][:2] in {("1-1", 1), ("1", 0)}
    assert tool_calls.tool_conversations(spark.createDataFrame([], ddl)).count() == 0
