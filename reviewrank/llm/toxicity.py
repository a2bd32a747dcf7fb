"""Toxicity by a learned lexicon, misspellings included.

Terms are learned from a bounded sample of labelled rows: whole words and word beginnings that occur in toxic texts far
more than chance and in clean ones hardly ever, and only where their neighbours differ.  At scoring time a
Levenshtein automaton of each word walks the lexicon's trie, so a misspelled term costs one walk and no enumeration.
Each hit is weighed by its context window (quotation marks and reporting words against it, further hits for it), and a
logistic model turns the sums into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewrank.llm.common import bounded_batches, held_by_worker, keep_rows, map_rows, own_columns
from reviewrank.session import cut_lineage

THRESHOLD = 0.3
MAX_TERMS = 5_000  # size of the learned lexicon: its strongest terms
MIN_CONTEXTS = 6  # different neighbouring words a term must have been seen with in toxic texts (of 63 counted)
MIN_SHARE = 0.9  # of a term's occurrences that lie in toxic texts
MIN_EVIDENCE = 12.0  # log likelihood ratio against the base rate
PREFIXES = range(3, 9)  # lengths of word beginnings that may be terms
FIT_ROWS = 40_000  # most labelled rows that lexicon and logistic model are fitted on, taken by hash
WINDOW = 6  # words on each side of a hit
FUZZY_LENGTH = 5  # words of at least so many letters may differ by one edit from a term
CACHED_WORDS, COUNTED_WORDS = 300_000, 400_000  # words a worker keeps at a time; more only cost speed
REPORTING = frozenset("said says quote quoted quotes called calls wrote writes word term example reported dit appelle sagte nannte dijo llama".split())
QUOTES = "\"“”„«»‘’'`"
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = ("exact", "fuzzy", "quoted", "dense", "share")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """``(text, toxic)`` of labelled rows outside the held-out fold: all, or about ``most`` taken by the hash of their ids.

    At most ``most`` ids with their labels are broadcast, so no text is shuffled to meet its label.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = cut_lineage(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < int(0.97 * most)).limit(most)
    return own_columns(docs, "doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "toxic")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def _word_counts(train: DataFrame) -> DataFrame:
    """``(word, toxic_n, clean_n, mask)``: texts with the word by label, partly added up within tasks.

    A task adds up at most :data:`COUNTED_WORDS` words before it passes them on.  ``mask`` has a bit for each of 63
    classes of following words seen in toxic texts.
    """
    schema = T.StructType.fromDDL("word string, toxic_n long, clean_n long, mask long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        toxic: Counter = Counter()
        clean: Counter = Counter()
        masks: dict[str, int] = {}

        def rows():
            words = list(clean.keys() | toxic.keys())
            columns = (words, [toxic[w] for w in words], [clean[w] for w in words], [masks.get(w, 0) for w in words])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in bounded_batches(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = _WORD.findall((text or "").lower())
                if label != 1:
                    clean.update(set(words))
                else:
                    toxic.update(set(words))
                    for w, following in set(zip(words, [*words[1:], ""])):
                        masks[w] = masks.get(w, 0) | 1 << crc32(following.encode("utf-8", "surrogatepass")) % 63
                if len(clean) + len(toxic) > COUNTED_WORDS:
                    yield rows()
                    for held in (toxic, clean, masks):
                        held.clear()
        if clean or toxic:
            yield rows()

    return train.select("text", "toxic").mapInArrow(run, schema)


def term_counts(train: DataFrame) -> DataFrame:
    """``(term, whole, toxic_n, clean_n, contexts, most)`` of every word and word beginning of ``train(text, toxic)``.

    ``most`` is the toxic count of the commonest word among those that begin so.
    """
    words = _word_counts(train).groupBy("word").agg(
        F.sum("toxic_n").alias("toxic_n"), F.sum("clean_n").alias("clean_n"), F.bit_or("mask").alias("mask")
    )
    parts = F.concat(
        F.array(F.struct(F.col("word").alias("term"), F.lit(True).alias("whole"))),
        F.transform(
            F.filter(F.array(*[F.lit(k) for k in PREFIXES]), lambda k: k < F.length("word")),
            lambda k: F.struct(F.substring(F.col("word"), F.lit(1), k).alias("term"), F.lit(False).alias("whole")),
        ),
    )
    return words.select(F.explode(parts).alias("t"), "toxic_n", "clean_n", "mask").groupBy("t.term", "t.whole").agg(
        F.sum("toxic_n").alias("toxic_n"), F.sum("clean_n").alias("clean_n"), F.bit_count(F.bit_or("mask")).alias("contexts"),
        F.max("toxic_n").alias("most"),
    )


def learn_terms(counts: DataFrame, limit: int = MAX_TERMS) -> list[tuple[str, bool, float]]:
    """The strongest ``(term, whole, weight)``; a beginning that is itself a term stands for all its longer forms."""
    total = counts.where("whole").agg(F.sum("toxic_n"), F.sum("clean_n")).first()
    if not total[0] or not total[1]:
        return []
    base = total[0] / (total[0] + total[1])
    n, k = F.col("toxic_n") + F.col("clean_n"), F.col("toxic_n")
    share = k / n
    evidence = k * F.log(share / base) + F.when(n > k, (n - k) * F.log((n - k) / n / (1 - base))).otherwise(0.0)
    weight = F.log((k + 0.5) / (F.col("clean_n") + 0.5)) - math.log(base / (1 - base))
    common = F.col("whole") | (2 * F.col("most") <= k)  # a beginning stands for several words, not for one
    strong = counts.where((k > 0) & (F.col("contexts") >= MIN_CONTEXTS) & (share >= MIN_SHARE) & common).where(evidence >= MIN_EVIDENCE)
    rows = strong.select("term", "whole", weight.alias("weight")).orderBy(evidence.desc(), "term", "whole").limit(limit).collect()
    begins = {r["term"] for r in rows if not r["whole"]}
    out = []
    for r in rows:
        if not any(r["term"][:k] in begins for k in range(1, len(r["term"]) + bool(r["whole"]))):
            out.append((r["term"], r["whole"], float(r["weight"])))
    return sorted(out)


class Lexicon:
    """Terms in a trie, searched with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.root: dict = {}
        for term, whole, weight in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node["whole" if whole else "begin"] = weight
        self._seen: dict[str, tuple[float, int] | None] = {}

    def find(self, word: str) -> tuple[float, int] | None:
        """``(weight, edits)`` of the best term that ``word`` is, begins with, or is one edit away from."""
        if word in self._seen:
            return self._seen[word]
        found = self._exact(word)
        if found is None and len(word) >= FUZZY_LENGTH:
            found = self._fuzzy(word)
        if len(self._seen) >= CACHED_WORDS:
            self._seen.clear()
        self._seen[word] = found
        return found

    def _exact(self, word: str) -> tuple[float, int] | None:
        node, best = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "begin" in node:
                best = (node["begin"], 0)
        return (node["whole"], 0) if "whole" in node else best

    def _fuzzy(self, word: str) -> tuple[float, int] | None:
        """Intersect the Levenshtein automaton of ``word`` for one edit with the trie.

        A state is a place in the word and the edits so far.  Without an edit there is one path down the trie; each of its nodes
        opens states with one edit (a letter missing, changed or added), and those only go on by equal letters.  Terms
        of at least :data:`FUZZY_LENGTH` letters count.
        """
        best, n = None, len(word)

        def after_edit(node: dict, i: int, depth: int) -> None:
            nonlocal best
            while True:
                if depth >= FUZZY_LENGTH:
                    weight = max(node.get("begin", -math.inf), node.get("whole", -math.inf) if i == n else -math.inf)
                    if weight > -math.inf and (best is None or weight > best):
                        best = weight
                if i == n or word[i] not in node:
                    return
                node, i, depth = node[word[i]], i + 1, depth + 1

        node = self.root
        for i in range(n + 1):
            letter = word[i] if i < n else ""
            for c, below in node.items():
                if len(c) == 1:
                    after_edit(below, i, i + 1)
                    if i < n and c != letter:
                        after_edit(below, i + 1, i + 1)
            if i == n:
                break
            after_edit(node, i + 1, i)
            if letter not in node:
                break
            node = node[letter]
        return None if best is None else (best, 1)

    def features(self, text: str | None) -> list[float]:
        """Sums over the hits of a text: exact, fuzzy and quoted evidence, hits near other hits, hits among words."""
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        known = self._seen
        for w in set(words):
            if (known[w] if w in known else self.find(w)) is not None:
                break
        else:
            return [0.0] * len(FEATURES)
        spans = [(m.start(), m.end()) for m in _WORD.finditer(lower)]
        hits = [(i, f) for i, w in enumerate(words) if (f := self.find(w)) is not None]
        exact = fuzzy = quoted = 0.0
        places = [i for i, _ in hits]
        near = sum(b - a <= WINDOW for a, b in zip(places, places[1:]))
        for i, (weight, edits) in hits:
            lo, hi = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            before, after = lower[spans[lo][0] : spans[i][0]], lower[spans[i][1] : spans[hi][1]]
            marks = any(q in before for q in QUOTES if q not in "'’") and any(q in after for q in QUOTES if q not in "'’")
            tight = lower[spans[i][0] - 1 : spans[i][0]] in QUOTES and lower[spans[i][1] : spans[i][1] + 1] in QUOTES and spans[i][0] > 0 and spans[i][1] < len(lower)
            told = any(w in REPORTING for w in words[lo:i])
            if (marks or tight) + told >= 1:
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                exact += weight
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(near), math.sqrt(len(hits) / len(words))]


@dataclass(frozen=True)
class Model:
    terms: list[tuple[str, bool, float]]
    weights: tuple[float, ...]  # bias first, then FEATURES

    def score(self, features: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[float, ...]:
    """Newton's method on rows that count ``n`` times; without both labels the weights are zero and the bias is the smoothed base rate."""
    rate = ((n * y).sum() + 0.5) / (n.sum() + 1.0)
    w = np.zeros(x.shape[1] + 1)
    w[0] = math.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        full = np.column_stack((np.ones(len(x)), x))
        penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            step = np.linalg.solve((full * (n * p * (1 - p))[:, None]).T @ full + penalty + 1e-9 * np.eye(len(w)), full.T @ (n * (p - y)) + penalty @ w)
            w -= np.clip(step, -5, 5)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and logistic model from at most :data:`FIT_ROWS` labelled rows outside the held-out fold.

    Copies of a text add no evidence to a term: they repeat its neighbours, and terms need several.
    """
    train = cut_lineage(training_rows(docs, labels))
    terms = learn_terms(cut_lineage(term_counts(train)))
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def rows_of():
        lexicon = Lexicon(shipped.value)
        return lambda b: [(*lexicon.features(t), y) for t, y in zip(b["text"], b["toxic"], strict=True)]

    ddl = ", ".join(f"{f} double" for f in FEATURES) + ", toxic double"
    rows = map_rows(train.select("text", F.col("toxic").cast("double").alias("toxic")), ddl, rows_of)
    # equal rows are added up first: most texts have no hit at all
    held = np.array([tuple(r) for r in rows.groupBy(*FEATURES, "toxic").count().collect()], float).reshape(-1, len(FEATURES) + 2)
    return Model(terms, fit_logistic(held[:, : len(FEATURES)], held[:, -2], held[:, -1]))


def _scorer(shipped):
    model: Model = shipped.value
    # the word cache outlives a task
    lexicon = held_by_worker(("lexicon", hash((tuple(model.terms), model.weights))), lambda: Lexicon(model.terms))
    return lambda text: model.score(lexicon.features(text))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; only the text counts (null: empty)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of():
        score_of = _scorer(shipped)

        def each(b):
            return [(i, h, s, int(s >= threshold)) for i, h, s in zip(b["doc_id"], b["held_out"], map(score_of, b["text"]), strict=True)]

        return each

    rows = own_columns(docs, "doc_id", "text").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", rows_of)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every row of ``docs``.

    Null and empty texts score by the model's bias; a null ``doc_id`` is not held out; labels of unknown documents, null
    labels and an empty ``labels`` table are fine (without both labels every score is the smoothed base rate).
    """
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def keep_of():
        score_of = _scorer(shipped)
        return lambda texts: [score_of(t) < threshold for t in texts]

    return keep_rows(docs, keep_of)
