"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

Two bags of ``a`` and ``b`` bigrams have a coefficient of at most ``2 min(a, b) / (a + b)``, so a passage is compared only
with templates whose size is within ``t / (2 - t)`` and ``(2 - t) / t`` of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from reviewrank.llm.common import map_rows, own_columns
from reviewrank.llm.license_templates import TEMPLATES

THRESHOLD = 0.8
_WORD = re.compile("[A-Za-z0-9]+")


def words_of(text: str) -> list[str]:
    """Normalised text: ASCII letters and digits, lower case; marks, white space and markup are gone."""
    return [w.lower() for w in _WORD.findall(text)]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class TemplateIndex:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        bags = sorted(((name, bigrams(words_of(text))) for name, text in templates.items()), key=lambda x: (sum(x[1].values()), x[0]))
        self.names = [name for name, _ in bags]
        self.sizes = [sum(bag.values()) for _, bag in bags]
        self.postings: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for k, (_, bag) in enumerate(bags):
            for gram, n in bag.items():
                self.postings.setdefault(gram, []).append((k, n))
        self.smallest, self.largest = (self.sizes[0], self.sizes[-1]) if bags else (1, 0)

    def candidates(self, size: int) -> range:
        """Templates that a passage of ``size`` bigrams can reach the threshold with."""
        t = self.threshold
        return range(bisect_left(self.sizes, size * t / (2 - t) - 1e-9), bisect_right(self.sizes, size * (2 - t) / t + 1e-9))

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The likest template at or above the threshold; of equals, the first name."""
        size = len(words) - 1
        fitting = self.candidates(size) if size > 0 else range(0)
        if not fitting:
            return None
        mine: Counter = Counter()
        postings = self.postings
        for gram in zip(words, words[1:]):
            if gram in postings:
                mine[gram] += 1
        shared: Counter = Counter()
        for gram, n in mine.items():
            for k, m in postings[gram]:
                if k in fitting:
                    shared[k] += min(n, m)
        found = [(2 * n / (size + self.sizes[k]), self.names[k]) for k, n in shared.items()]
        found = [x for x in found if x[0] >= self.threshold - 1e-12]
        return min(found, key=lambda x: (-x[0], x[1])) if found else None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """``(license, dice, first line, lines)`` of the best passage per template, in the order of names.

        Passages are the whole text, its paragraphs (between blank lines) and its lines.
        """
        text = text or ""
        lines = text.split("\n")
        most = 1 + int(self.largest * (2 - self.threshold) / self.threshold + 1e-9)
        per_line = [words_of(line) for line in lines]
        passages = [(k, k + 1) for k, w in enumerate(per_line) if self.smallest * self.threshold / (2 - self.threshold) < len(w) <= most]
        start = 0
        for k in [*(k for k, line in enumerate(lines) if not line.strip(" \t\r")), len(lines)]:
            if k - start > 1:
                passages.append((start, k))
            start = k + 1
        if len(lines) > 1:
            passages.append((0, len(lines)))
        out: dict[str, tuple[float, int, int]] = {}
        for a, z in dict.fromkeys(passages):
            if sum(map(len, per_line[a:z])) > most:
                continue
            found = self.best(per_line[a] if z == a + 1 else [w for line in per_line[a:z] for w in line])
            if found and (found[1] not in out or (-found[0], a, z) < (-out[found[1]][0], out[found[1]][1], sum(out[found[1]][1:]))):
                out[found[1]] = (found[0], a, z - a)
        return [(name, *out[name]) for name in sorted(out)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_licenses, licenses)`` for every row: each licence found, with its best passage.

    Whole texts are scanned; null, empty and licence-free texts have an empty list; equal likeness takes the earlier, then
    the shorter passage; repeated rows each give a row.  A set of templates is code, not data, and travels with the job.
    """

    def rows_of():
        index = TemplateIndex(templates, threshold)

        def each(b):
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                found = index.scan(t)
                out.append((i, len(found), [dict(zip(("license", "dice", "line", "lines"), f)) for f in found]))
            return out

        return each

    ddl = "doc_id long, n_licenses int, licenses array<struct<license:string,dice:double,line:int,lines:int>>"
    return map_rows(own_columns(docs, "doc_id", "text"), ddl, rows_of)
