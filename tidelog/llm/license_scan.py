"""License scan by ordered signature rules.

Each rule of ``license_rules`` is tried only where its keyword occurs (an Aho-Corasick pass finds
the keywords of a text at once). Detections that overlap are resolved in order of priority, then
length, then rule order: one that lies inside a kept detection, or overlaps a kept one of higher
priority, is suppressed. The contract's base phrases are counted apart and never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import RULES
from .text import alnum_words, map_rows, raw_texts

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    regex: re.Pattern


@dataclass(frozen=True)
class Detection:
    label: str
    priority: int
    first_word: int
    end_word: int


def parse_rules(table: str = RULES) -> list[Rule]:
    rows = (line.split("|", 3) for line in table.strip().split("\n"))
    return [Rule(label, int(priority), keyword, re.compile(rf"(?<= )(?:{regex})(?= )")) for label, priority, keyword, regex in rows]


def resolve(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """Keep of ``(start, end, rule)`` those that no kept one contains and no kept one of higher priority overlaps.

    Of equal intervals the first rule's is kept. Sorting apart, the time grows with the number of detections.
    """
    by: dict[int, list[tuple[int, int, int]]] = {}
    for x in set(found):
        by.setdefault(rules[x[2]].priority, []).append(x)
    kept: list[tuple[int, int, int]] = []
    begins, ends = [], []  # what those of higher priorities cover, as intervals apart from each other
    for priority in sorted(by, reverse=True):
        reach, own = -1, []
        for start, end, rule in sorted(by[priority], key=lambda x: (x[0], -x[1], x[2])):
            k = bisect_left(begins, end) - 1
            if k >= 0 and ends[k] > start or end <= reach:
                continue  # overlaps a higher one, or one that begins no later ends no earlier
            reach = end
            own.append((start, end, rule))
        kept += own
        begins, ends, both = [], [], sorted((a, b) for a, b, _ in kept)
        for a, b in both:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                begins.append(a)
                ends.append(b)
    return sorted(kept)


class LicenseScanner:
    """Scans texts in one process; built once for each task."""

    def __init__(self, table: str = RULES, base: dict[str, str] = BASE_PHRASES) -> None:
        import ahocorasick

        self.rules, self.base = parse_rules(table), {f" {p} ": label for p, label in base.items()}
        by: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by.setdefault(rule.keyword, []).append(i)
        for phrase in self.base:
            by.setdefault(phrase, [])
        self.by = by
        self.gate = ahocorasick.Automaton()
        for keyword in by:
            self.gate.add_word(keyword, keyword)
        self.gate.make_automaton()

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[int, str]], list[Detection]]:
        """Word count, base places as (start word, label), and the detections that stand."""
        words = alnum_words(raw)
        text = b" ".join((b"", *words, b"")).decode("utf-8", "replace")
        keywords = {k for _, k in self.gate.iter(text)}
        if not keywords:
            return len(words), [], []
        spaces = [i for i, c in enumerate(text) if c == " "]
        word = lambda at: bisect_right(spaces, at) - 1  # noqa: E731  the word that begins after the space at or before ``at``
        places = []
        for phrase, label in self.base.items():
            at = text.find(phrase) if phrase in keywords else -1
            while at >= 0:
                places.append((word(at), label))
                at = text.find(phrase, at + 1)
        found = [(m.start(), m.end(), i) for k in keywords for i in self.by[k] for m in self.rules[i].regex.finditer(text) if m.end() > m.start()]
        stand = [Detection(self.rules[i].label, self.rules[i].priority, word(a), word(b - 1) + 1) for a, b, i in resolve(found, self.rules)]
        return len(words), sorted(places), stand


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,priority:int,first_word:long,end_word:long>>"


def scan_licenses(docs: DataFrame, table: str = RULES, base: dict[str, str] | None = None) -> DataFrame:
    """License places of every row of ``docs`` (columns doc_id, text; others are ignored).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the
    detections with their word intervals. score is the highest priority that stands, over 9; a base
    phrase alone counts 6 / 9. Null and empty texts have no words: counts 0, null places, empty label
    strings, score 0. Null doc_ids and repeated rows pass through; an empty table gives an empty
    result. Texts are scanned whole, whatever their length. A narrow map: nothing is shuffled.
    """
    phrases = dict(BASE_PHRASES if base is None else base)

    def make():
        scanner = LicenseScanner(table, phrases)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            out["doc_id"] = batch.column("doc_id").to_pylist()
            for raw in raw_texts(batch):
                n, places, stand = scanner.scan(raw)
                labels = sorted({label for _, label in places})
                out["n_words"].append(n)
                out["n_base"].append(len(places))
                out["first_word"].append(places[0][0] if places else None)
                out["last_word"].append(places[-1][0] if places else None)
                out["base_labels"].append(",".join(labels))
                out["labels"].append(",".join(sorted({*labels, *(d.label for d in stand)})))
                out["score"].append(max([0, 6 * bool(places), *(d.priority for d in stand)]) / 9)
                out["detections"].append([vars(d) for d in stand])
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), SCHEMA, make)
