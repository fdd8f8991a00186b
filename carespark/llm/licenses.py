"""License scan: exact phrases, and notices within a few edits.

A notice that occurs with at most k edits holds one of its k + 1 parts
unchanged (pigeonhole). All parts are searched at once with one automaton;
only windows around a found part go to bounded-error matching.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import map_texts

# Phrases with their labels, and well-known notices of licenses.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc"),
    ("licensed under a creative commons attribution", "cc"),
)
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 15

# Word bytes keep, A-Z lower-cased, every other ASCII byte is a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normalise(text: str) -> tuple[str, int]:
    """Words joined by single spaces, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    return b" ".join(words).decode("utf-8", "surrogatepass"), len(words)


def edits_for(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def split_parts(notice: str, edits: int) -> list[tuple[str, int]]:
    """`edits` + 1 parts of nearly equal length with their offsets."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


@cache
def _phrases():
    return [(p, label, regex.compile(rf"(?<![^ ]){p}(?![^ ])")) for p, label in PHRASES]


@cache
def _machine(notices: tuple[tuple[str, str], ...]):
    """Automaton over all parts, and the fuzzy pattern of each notice."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (notice, _) in enumerate(notices):
        k = edits_for(notice)
        for part, at in split_parts(notice, k):
            seeds.setdefault(part, []).append((i, at))
        body = rf"(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={k}}}"
        patterns.append((regex.compile(body), regex.compile(f"(?b){body}")))
    machine = ahocorasick.Automaton()
    for part, places in seeds.items():
        machine.add_word(part, (len(part), places))
    machine.make_automaton()
    return machine, patterns


def base_places(text: str) -> list[tuple[int, str]]:
    """(word index, label) of every exact phrase in a normalised text."""
    if "license" not in text:
        return []
    found, word, at = [], 0, 0
    for start, label in sorted((m.start(), label) for _, label, pattern in _phrases() for m in pattern.finditer(text)):
        word, at = word + text.count(" ", at, start), start
        found.append((word, label))
    return found


def notice_spans(text: str, notices=NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of best matches within the bound, in a normalised text.

    Windows around found parts that overlap are merged, so a notice repeated in
    a row is searched once over the whole run. Matches of a notice do not overlap;
    the slower search for the fewest edits runs only around a match.
    """
    machine, patterns = _machine(notices)
    windows: dict[int, list[list[int]]] = {}
    for last, (size, places) in machine.iter(text):
        first = last - size + 1
        for i, at in places:
            notice = notices[i][0]
            k = edits_for(notice)
            lo, hi = max(0, first - at - k), min(len(text), first - at + len(notice) + k)
            runs = windows.setdefault(i, [])
            if runs and lo <= runs[-1][1]:
                runs[-1][0] = min(lo, runs[-1][0])
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
    spans = []
    for i, runs in windows.items():
        for lo, hi in runs:
            some, best = patterns[i]
            while found := some.search(text, lo, hi):
                k = edits_for(notices[i][0])
                m = best.search(text, max(lo, found.start() - k), min(hi, found.end() + k)) or found
                spans.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                lo = max(m.end(), found.start() + 1)
    return sorted(spans, key=lambda s: (s[1], s[0]))


def scan(text: str, notices=NOTICES) -> dict:
    """All findings of one text."""
    plain, n_words = normalise(text)
    base = base_places(plain)
    spans = notice_spans(plain, notices)
    starts = [i + 1 for i, c in enumerate(plain) if c == " "] if spans else []
    passages = [
        {
            "label": notices[i][1],
            "start_word": bisect_right(starts, a),
            "end_word": bisect_right(starts, max(a, b - 1)),
            "edits": e,
            "matched": plain[a:b],
        }
        for i, a, b, e in spans
    ]
    likeness = [1.0 - e / len(notices[i][0]) for i, _, _, e in spans]
    return {
        "n_words": n_words,
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted({label for _, label in base})),
        "labels": ",".join(sorted({label for _, label in base} | {p["label"] for p in passages})),
        "score": 1.0 if base else max(likeness, default=0.0),
        "passages": passages,
    }


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " passages array<struct<label:string,start_word:long,end_word:long,edits:int,matched:string>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Phrase places, labels, score and notice passages of each row.

    `first_word` and `last_word` are the smallest and largest word index where
    an exact phrase starts. `score` is 1 with an exact phrase, else one minus
    the share of edited characters of the closest notice, else 0. Null texts
    count as empty: no words, empty labels, 0. Repeated rows give repeated
    results; other columns are not read.
    """

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            found = [scan(t) for t in texts]
            return {name: [f[name] for f in found] for name in (found[0] if found else {})}

        return work

    return map_texts(docs, ["doc_id"], FIELDS, make)
