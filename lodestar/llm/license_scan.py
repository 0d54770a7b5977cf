"""Licence scans by template markup.

A template is a licence's wording with two kinds of markup: ``<<beginOptional>> ... <<endOptional>>`` around words that may
be left out (regions may hold regions), and ``<<var;min=A;max=B>>`` for A to B words of any kind that stand where a
name or a year is filled in. All other words are mandatory. A template is compiled to an automaton over tokens:
mandatory words are transitions on that word, an optional region can be bypassed, a replaceable region is a chain of
transitions on any word. Sets of its states that occur are numbered and their transitions remembered, so a scan takes
one step for each word. A text is accepted where every mandatory word matches exactly, in order, with nothing between
but what the markup allows.

Words are runs of digits, letters and characters beyond ASCII, after A-Z has been lower-cased; all of these are
told from separators by single bytes of UTF-8, so a text is never decoded or cut. Automata start only where the first
word of a template stands. From there the longest acceptance counts, and the next one of that template starts behind it.

Base labels come from phrases of consecutive words (``PHRASES``), each of whose places counts, overlapping ones too.
The score is the largest share of a text's words that the acceptances of one template or the places of one phrase
cover (words covered twice count once); 0 without words.

Texts that are null or empty have no words, no places and no labels (empty strings); first_word and last_word are null
without places. Every row gives one row, repeated ids and null ids too. Other columns pass through in
``scan_licenses``; where one is named like a result, the result stands in its place. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public wordings of licences and of the notices that name them, with markup.
TEMPLATES = {
    "gpl-2.0": "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> "
    "<<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>",
    "gpl-3.0": "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> "
    "<<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>affero<<endOptional>> general public license as published by "
    "the free software foundation <<var;min=0;max=3>> version <<var;min=1;max=2>> of the license or at your option any later version",
    "apache-2.0": "licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> <<beginOptional>>you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at http www apache org licenses license 2 0<<endOptional>>",
    "cc-by-4.0": "cc by 4 0 <<beginOptional>>international<<endOptional>>",
    "cc-by-sa-4.0": "cc by sa 4 0 <<beginOptional>>international<<endOptional>>",
    "cc-by-nc-4.0": "cc by nc 4 0 <<beginOptional>>international<<endOptional>>",
    "creative-commons": "creative commons attribution <<beginOptional>>noncommercial<<endOptional>> <<beginOptional>>sharealike<<endOptional>> <<beginOptional>>noderivatives<<endOptional>> <<var;min=1;max=2>> "
    "<<beginOptional>>international<<endOptional>> license",
    "mit-notice": "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of <<var;min=1;max=12>> to deal in <<var;min=1;max=4>> without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-text": "redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "copyright": "copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=8>> all rights reserved",
}

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>")
_ANY = None


class Automaton:
    """A template's token automaton; sets of states are made and remembered as they occur."""

    def __init__(self, template: str):
        self._next: list[list[tuple[bytes | None, int]]] = [[]]
        self._free: list[list[int]] = [[]]
        self.first = template.split(None, 1)[0].lower().encode()
        if not WORD_BYTES[list(self.first)].all():
            raise ValueError("a template begins with a mandatory word")
        self._end = self._compile(template)
        self._alphabet = {w for edges in self._next for w, _ in edges if w is not _ANY}
        self._sets: dict[frozenset[int], int] = {}
        self._members: list[frozenset[int]] = []
        #: Of each set of states: where each word leads, where any other word leads (-1: nowhere), whether it accepts.
        self._step: list[dict[bytes | None, int]] = []
        self.accepts: list[bool] = []
        self.start = self._number(self._closed({0}))

    def _state(self) -> int:
        self._next.append([])
        self._free.append([])
        return len(self._next) - 1

    def _compile(self, template: str) -> int:
        at, open_regions, place = 0, [], 0

        def words(text: str) -> None:
            nonlocal at
            lowered = text.encode().lower()
            for word in bytes(b if WORD_BYTES[b] else 0x20 for b in lowered).split():
                after = self._state()
                self._next[at].append((word, after))
                at = after

        for mark in _MARKUP.finditer(template):
            words(template[place : mark.start()])
            place = mark.end()
            if mark[1] == "beginOptional":
                open_regions.append(at)
            elif mark[1] == "endOptional":
                if not open_regions:
                    raise ValueError("endOptional without beginOptional")
                # a state of its own behind the region, so that bypassing it can't lead back into it
                before, after = open_regions.pop(), self._state()
                self._free[at].append(after)
                self._free[before].append(after)
                at = after
            else:
                least, most = int(mark[2]), int(mark[3])
                if least > most:
                    raise ValueError("a replaceable region's min is above its max")
                chain = [at]
                for _ in range(most):
                    after = self._state()
                    self._next[chain[-1]].append((_ANY, after))
                    chain.append(after)
                at = self._state()
                for state in chain[least:]:
                    self._free[state].append(at)
        words(template[place:])
        if open_regions:
            raise ValueError("beginOptional without endOptional")
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self._free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self._sets:
            self._sets[states] = len(self._members)
            self._members.append(states)
            self._step.append({})
            self.accepts.append(self._end in states)
        return self._sets[states]

    def step(self, state: int, word: bytes) -> int:
        """The set of states after a word; -1 if the text can't be accepted any more."""
        known = word if word in self._alphabet else _ANY
        found = self._step[state].get(known)
        if found is None:
            reached = {after for s in self._members[state] for w, after in self._next[s] if w is _ANY or w == known}
            found = self._step[state][known] = self._number(self._closed(reached)) if reached else -1
        return found


class Scanner:
    """All automata of a set of phrases and templates, by their first words."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self._found: dict[bytes, list[tuple[str, bool, Automaton]]] = {}
        for base, pairs in ((True, phrases.items()), (False, ((t, label) for label, t in templates.items()))):
            for template, label in pairs:
                automaton = Automaton(template)
                self._found.setdefault(automaton.first, []).append((label, base, automaton))

    def _starts(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, bytes]]:
        """(word's number, word) of the words that an automaton starts with, in order."""
        out = []
        for word in self._found:
            places, at = [], text.find(word)
            while at >= 0:
                places.append(at)
                at = text.find(word, at + len(word))
            if places:
                at = np.array(places)
                i = np.searchsorted(starts, at)
                i = i[(i < len(starts))]
                at = at[: len(i)]
                out += [(n, word) for n in i[(starts[i] == at) & (ends[i] - at == len(word))].tolist()]
        return sorted(out)

    def scan(self, raw: bytes) -> tuple[int, list[tuple[str, bool, int, int]]]:
        """(number of words, [(label, whether of a phrase, first word, word after the last)]), by first word."""
        text = raw.lower()  # of bytes: A-Z only
        inside = WORD_BYTES[np.frombuffer(text, np.uint8)]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        free: dict[int, int] = {}
        spans = []
        for i, word in self._starts(text, starts, ends):
            for label, base, automaton in self._found[word]:
                if not base and i < free.get(id(automaton), 0):
                    continue
                state, at, after = automaton.start, i, -1
                while at < len(starts):
                    state = automaton.step(state, text[starts[at] : ends[at]])
                    if state < 0:
                        break
                    at += 1
                    if automaton.accepts[state]:
                        after = at
                if after > 0:
                    free[id(automaton)] = after
                    spans.append((label, base, i, after))
        return len(starts), spans


@lru_cache(maxsize=8)
def _scanner(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One for each worker process and set of templates, so that what an automaton has met stays known."""
    return Scanner(dict(phrases), dict(templates))


def _covered(spans: list[tuple[str, bool, int, int]]) -> int:
    """The most words that the spans of one label and kind cover."""
    kinds: dict[tuple[str, bool], list[int]] = {}
    for label, base, first, after in spans:
        seen = kinds.setdefault((label, base), [0, 0])
        seen[1] += max(0, after - max(first, seen[0]))
        seen[0] = max(seen[0], after)
    return max((n for _, n in kinds.values()), default=0)


_SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("after", pa.int64())])
#: Columns of the result, in order.
_COLUMNS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(_SPAN),
}
_RESULT = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, spans: array<struct<label: string, base: boolean, first: bigint, after: bigint>>>"


def _row(scanner: Scanner, text: bytes | None) -> dict:
    n, spans = scanner.scan(text) if text else (0, [])
    places = [first for _, base, first, _ in spans if base]
    return {
        "n_words": n,
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted({label for label, base, _, _ in spans if base})),
        "labels": ",".join(sorted({s[0] for s in spans})),
        "score": _covered(spans) / n if n else 0.0,
        "spans": [dict(zip(("label", "base", "first", "after"), s, strict=True)) for s in spans],
    }


def _scanned(phrases: Mapping[str, str], templates: Mapping[str, str]) -> Callable:
    key = tuple(phrases.items()), tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        kind = pa.struct(list(_COLUMNS.items()))
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            found = pa.array((_row(scanner, t.as_py()) for t in texts), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], [*batch.schema.names[1:], batch.schema.names[0]])

    return run


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (from word ``first`` up to ``after``) in place of the text.

    ``phrases`` map phrases to labels, ``templates`` labels to templates.
    """
    others = [c for c in docs.columns if c != text_col and c not in _COLUMNS]
    rows = docs.select(F.col(text_col).alias("_scan"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("c")).alias("_others"))
    kept = rows.schema["_others"].dataType.simpleString()
    found = rows.mapInArrow(_scanned(phrases, templates), f"_others {kept}, _scan {_RESULT}")
    return found.select(*(F.col(f"_others.c{i}").alias(c) for i, c in enumerate(others)), *(F.col(f"_scan.{c}").alias(c) for c in _COLUMNS))


# The same in SQL: words with a space on either side, templates as patterns over them


def _pattern(template: str) -> str:
    out, place = "", 0
    words = lambda text: "".join(f" {w} " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
    for mark in _MARKUP.finditer(template):
        out += words(template[place : mark.start()])
        out += "(?:" if mark[1] == "beginOptional" else ")?" if mark[1] == "endOptional" else f"(?: [^ ]+ ){{{mark[2]},{mark[3]}}}"
        place = mark.end()
    return out + words(template[place:])


def _matches(label: str, base: bool, pattern: str) -> str:
    return f"SELECT doc_id, n_words, '{label}' AS label, {base} AS base, unnest(regexp_extract_all(t, '{pattern}')) AS m FROM w"


_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + {len(p.split())}] = {p.split()})) AS i FROM w WHERE contains(t, '{_pattern(p)}')" for p in PHRASES
)
ORACLE_SQL = rf"""
WITH r AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), w AS (SELECT doc_id, ws, len(ws)::BIGINT AS n_words, array_to_string(list_transform(ws, lambda x: ' ' || x || ' '), '') AS t FROM r),
b AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word FROM ({_PLACES}) GROUP BY doc_id),
m AS ({" UNION ALL ".join([_matches(label, True, _pattern(p)) for p, label in PHRASES.items()] + [_matches(label, False, _pattern(t)) for label, t in TEMPLATES.items()])}),
c AS (SELECT doc_id, label, base, sum(len(regexp_extract_all(m, '[^ ]+'))) / any_value(n_words)::DOUBLE AS share FROM m GROUP BY doc_id, label, base),
l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(share) AS score FROM c GROUP BY doc_id
)
SELECT w.doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""
