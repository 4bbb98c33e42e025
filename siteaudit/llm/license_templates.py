"""License scans by matching template markup with token automata.

A template is a license wording with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be absent (regions
nest), ``<<var;words=1-4;match=REGEX>>`` stands for that many words, each matching the expression (any word without
one). Everything else is mandatory and must match word for word. A template is compiled to an automaton over words;
a text is accepted where the automaton accepts a run of its words.

Only texts that hold every mandatory word of a template (found on 64-bit word hashes of the whole text) run its automaton, from
the words that can start it; the automaton and the base phrases compare the words themselves.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Nulls and others: a null text is empty, with no words,
no labels and score 0. Of overlapping matches of one template the leftmost, then longest, stands. Repeated rows give
repeated rows; an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import WordScanner, blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Base phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label: templates.
TEMPLATES = {
    "mit": [
        "<<var;words=1-1;match=released|licensed|distributed|available>> under <<beginOptional>>the terms of<<endOptional>> "
        "the <<beginOptional>>expat<<endOptional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ],
    "apache-2": [
        "<<beginOptional>>this <<var;words=1-3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> "
        "apache license version 2 <<beginOptional>>0<<endOptional>>",
    ],
    "cc-by-nc": [
        "<<beginOptional>>this <<var;words=1-3>> is<<endOptional>> licensed under <<beginOptional>>a creative commons<<endOptional>> "
        "cc by nc <<beginOptional>><<var;words=1-2;match=[0-9]+>><<endOptional>>",
    ],
    "gpl-3": [
        "<<beginOptional>>this <<var;words=1-3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> "
        "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 3 "
        "<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ],
}

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[65:91] = WORD_BYTES[128:] = True

MARKUP = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;words=(\d+)-(\d+)(?:;match=([^>]*))?>>|[^\s<]+")


@dataclass
class Automaton:
    """Word transitions between numbered states; ``skips`` cost no word. State 0 starts; the last state accepts."""

    words: dict[int, list[tuple[object, int]]] = field(default_factory=dict)   # state: (word or pattern, next state)
    skips: dict[int, list[int]] = field(default_factory=dict)
    mandatory: set[str] = field(default_factory=set)
    last: int = 0

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[str], start: int) -> int:
        """Length of the longest accepted run of words from ``start``; -1 if none."""
        states, best, at = self.closed({0}), -1, start
        while states:
            if self.last in states:
                best = at - start
            if at == len(words):
                break
            word = words[at]
            states = self.closed({to for s in states for what, to in self.words.get(s, ())
                                  if (what == word if isinstance(what, str) else what is None or what.fullmatch(word))})
            at += 1
        return best

    def first_words(self) -> list[object]:
        return [what for s in self.closed({0}) for what, _ in self.words.get(s, ())]


def compile_template(markup: str) -> Automaton:
    a, state, opened = Automaton(), 0, []
    for m in MARKUP.finditer(markup):
        if m[0] == "<<beginOptional>>":
            opened.append(state)
        elif m[0] == "<<endOptional>>":
            a.skips.setdefault(opened.pop(), []).append(state)
        elif m[1]:
            low, high, what = int(m[1]), int(m[2]), re.compile(m[3]) if m[3] else None
            ends = []
            for i in range(high):
                if i >= low:
                    ends.append(state)
                a.words.setdefault(state, []).append((what, state + 1))
                state += 1
            for s in ends:
                a.skips.setdefault(s, []).append(state)
        else:
            a.words.setdefault(state, []).append((m[0], state + 1))
            if not opened:
                a.mandatory.add(m[0])
            state += 1
    a.last = state
    return a


class Scanner:
    """Scans blocks of texts for the base phrases and the templates."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.automata = [(label, compile_template(t)) for label, ts in sorted(templates.items()) for t in ts]
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.scanner = WordScanner(WORD_BYTES)
        needed = sorted({w for _, a in self.automata for w in a.mandatory} | {w for p, _ in self.phrases for w in p})
        _, _, hashes = self.scanner.scan(np.frombuffer(" ".join(needed).encode(), np.uint8))
        order = np.argsort(hashes)
        self.hashes, self.bits = hashes[order], {w: 1 << i for i, w in enumerate(needed)}
        self.bit_of = [1 << int(i) for i in order]
        sets = [a.mandatory for _, a in self.automata] + [set(p) for p, _ in self.phrases]
        self.masks = [sum(self.bits[w] for w in s) for s in sets]

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        starts, ends, hashes = self.scanner.scan(buf)
        bounds = np.searchsorted(starts, offsets)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[place] == hashes)
        text = np.searchsorted(bounds, hits, side="right") - 1
        seen = dict.fromkeys(text.tolist(), 0)
        for t, p in set(zip(text.tolist(), place[hits].tolist(), strict=True)):
            seen[t] |= self.bit_of[p]
        for t in range(len(offsets) - 1):
            n = int(bounds[t + 1] - bounds[t])
            have = seen.get(t, 0)
            if any(have & m == m for m in self.masks):
                words = [bytes(buf[a:b]).decode("utf-8").translate(_LOWER)
                         for a, b in zip(starts[bounds[t]:bounds[t + 1]], ends[bounds[t]:bounds[t + 1]], strict=True)]
                yield n, *self.text(words, have)
            else:
                yield n, [], []

    def text(self, words: list[str], have: int) -> tuple[list, list]:
        """Base places (start, label) and template matches (start, length, label)."""
        base, found = [], []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.bits:
                at.setdefault(w, []).append(i)
        for phrase, label in self.phrases:
            base += [(i, label) for i in at.get(phrase[0], ()) if words[i:i + len(phrase)] == phrase]
        for (label, automaton), mask in zip(self.automata, self.masks, strict=False):
            if have & mask != mask:
                continue
            first = automaton.first_words()
            exact, patterns = {x for x in first if isinstance(x, str)}, [x for x in first if not isinstance(x, str)]
            end = 0
            for i, w in enumerate(words):
                if i >= end and (w in exact or any(p is None or p.fullmatch(w) for p in patterns)):
                    n = automaton.longest(words, i)
                    if n > 0:
                        found.append((i, n, label))
                        end = i + n
        return base, found


_LOWER = {i: i + 32 for i in range(65, 91)}


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, base places and template matches of each text. Map-only."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = []
            for _, buf, offsets in blocks(batch["text"].tolist()):
                for n, base, found in scanner.block(buf, offsets):
                    rows.append((n, [{"start": i, "label": x} for i, x in sorted(base)],
                                 [{"start": i, "length": k, "label": x} for i, k, x in sorted(found)]))
            yield pd.DataFrame(rows, columns=["n_words", "base", "matches"]).assign(doc_id=batch["doc_id"].tolist())

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(task, "doc_id string, n_words bigint, base array<struct<start:bigint,label:string>>, "
                                 "matches array<struct<start:bigint,length:bigint,label:string>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def license_report(docs: DataFrame) -> DataFrame:
    """op3: counts, places and labels; score 1 where an automaton accepts, 0.5 with base phrases alone, else 0."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    found = scan_licenses(docs)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"), F.array_max(F.col("base.start")).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("matches.label"))).alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
        F.size("matches").cast("bigint").alias("n_matches"))
