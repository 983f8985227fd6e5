"""License notices: exact phrases, and fuzzy short notices by pigeonhole seeds and bounded-error matching.

A notice with up to k errors keeps at least one of any k + 1 pieces intact. The pieces of all notices are in
one Aho-Corasick automaton; where a piece is found, the regex library matches the whole notice around that
place with at most k insertions, deletions and substitutions, and reports span and errors. Short names, such as
"mit" or "gpl", are told by few letters: they have parts with bounds of their own (none for the name itself), and
count after a lead such as "licensed under the".
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .decontamination import normal_words

#: Exact phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    errors: int
    #: Errors in each word, for names whose words have bounds of their own; and whether a lead must come before.
    each: tuple[int, ...] = ()
    led: bool = False


#: What leads up to a license's name, as alternatives of regular expressions, and the errors allowed in it.
LEAD, LEAD_ERRORS, LEAD_LENGTH = "(?:licensed|released|distributed|available|published|provided) under(?: the terms of)?(?: the| a| an)?", 2, 36

#: Short notices as they begin or name their license, in normalised words, with the errors allowed.
NOTICES = (
    Notice("mit", "mit license copyright", 0),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("apache-2", "licensed under the apache license version 2 0", 3),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 3),
    Notice("cc-by", "licensed under a creative commons attribution", 3),
    Notice("cc0", "creative commons zero", 1),
    Notice("cc0", "to the extent possible under law the author has waived all copyright", 5),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "released under the gnu general public license", 4),
    Notice("lgpl", "under the terms of the gnu lesser general public license", 4),
    Notice("lgpl", "under the gnu lesser general public license", 4),
    Notice("agpl", "under the terms of the gnu affero general public license", 4),
    Notice("agpl", "under the gnu affero general public license", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("mpl-2", "subject to the terms of the mozilla public license", 4),
    Notice("mpl-2", "licensed under the mozilla public license", 4),
    Notice("epl-2", "under the terms of the eclipse public license", 4),
    Notice("epl-2", "licensed under the eclipse public license", 4),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 6),
    Notice("apache-2", "apache license version 2 0", 2),
    Notice("apache-2", "apache license 2 0", 1),
    Notice("mpl-2", "mozilla public license 2 0", 2),
    Notice("mpl-2", "mozilla public license version 2 0", 2),
    Notice("gpl", "gnu general public license version", 3),
    Notice("gpl", "gnu general public license v", 3),
    Notice("gpl", "distributed under the gnu general public license", 4),
    Notice("cc-by", "creative commons attribution 4 0 international", 3),
    Notice("proprietary", "all rights reserved", 1),
)
#: Names after a lead: label, words, and the errors allowed in each word.
NAMED = tuple(
    Notice(label, words, 0, each, True)
    for label, words, each in (
        ("mit", "mit license", (0, 1)), ("bsd", "bsd license", (0, 1)), ("bsd", "bsd 2 clause", (0, 0, 1)), ("bsd", "bsd 3 clause", (0, 0, 1)), ("bsd", "new bsd license", (0, 0, 1)), ("isc", "isc license", (0, 1)),
        ("zlib", "zlib license", (0, 1)), ("gpl", "gpl", (0,)), ("gpl", "gnu gpl", (0, 0)), ("gpl", "gplv2", (0,)), ("gpl", "gplv3", (0,)), ("lgpl", "lgpl", (0,)), ("lgpl", "gnu lgpl", (0, 0)), ("agpl", "agpl", (0,)), ("agpl", "gnu agpl", (0, 0)),
        ("apache-2", "apache 2 0", (1, 0, 0)), ("apache-2", "apache license", (1, 1)), ("mpl-2", "mpl 2 0", (0, 0, 0)), ("epl-2", "epl 2 0", (0, 0, 0)), ("unlicense", "unlicense", (1,)), ("cc0", "cc0", (0,)),
        ("cc-by-sa", "cc by sa", (0, 0, 0)), ("cc-by-nc", "cc by nc", (0, 0, 0)), ("cc-by-nd", "cc by nd", (0, 0, 0)), ("cc-by", "cc by", (0, 0)),
    )
)
#: Identifiers that may follow "SPDX-License-Identifier:", in normalised words, and their labels; no errors allowed.
IDENTIFIERS = (
    ("mit", "mit"), ("apache 2 0", "apache-2"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("agpl 3 0", "agpl"),
    ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc", "isc"), ("mpl 2 0", "mpl-2"), ("epl 2 0", "epl-2"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("cc0 1 0", "cc0"),
    ("cc by 4 0", "cc-by"), ("cc by sa 4 0", "cc-by-sa"), ("cc by nc 4 0", "cc-by-nc"), ("cc by nd 4 0", "cc-by-nd"),
)
TAGS = tuple(Notice(label, f"{before} {words}", 0) for words, label in IDENTIFIERS for before in ("spdx license identifier", "license"))
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"


def pattern_of(notice: Notice) -> str:
    """A notice as a regular expression of the regex library, between blanks."""
    import regex

    if not notice.each:
        name = rf"(?:{regex.escape(notice.words)}){{e<={notice.errors}}}"
    else:
        name = " ".join(f"(?:{w}){{e<={e}}}" if e else w for w, e in zip(notice.words.split(), notice.each, strict=True))
    lead = rf"(?:{LEAD}){{e<={LEAD_ERRORS}}} " if notice.led else ""
    return rf"(?b)(?<![^ ]){lead}{name}(?![^ ])"


def seeds_of(notice: Notice) -> list[tuple[int, str]]:
    """Pieces of a notice of which an occurrence has at least one: by its errors, or the longest word that must be as it is or its pieces."""
    if not notice.each:
        return pieces(notice.words, notice.errors)
    at, best = 0, None
    for word, errors in zip(notice.words.split(), notice.each, strict=True):
        if best is None or len(word) // (errors + 1) > len(best[1]) // (best[2] + 1):
            best = (at, word, errors)
        at += len(word) + 1
    return [(best[0] + k, piece) for k, piece in pieces(best[1], best[2])]


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``text`` cut into errors + 1 pieces of nearly equal length."""
    cuts = [len(text) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


Found = tuple[str, int, int, int, float]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES + NAMED + TAGS, phrases: tuple[tuple[str, str], ...] = PHRASES) -> None:
        import ahocorasick
        import regex

        self.notices, self.phrases = notices, phrases
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            for at, piece in seeds_of(notice):
                by_seed.setdefault(piece, []).append((n, at))
        for piece, of in by_seed.items():
            self.seeds.add_word(piece, (len(piece), of))
        if notices:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(pattern_of(n)) for n in notices]

    def fuzzy(self, text: str) -> Iterator[Found]:
        """(label, start, end, errors, score) of each notice found in normalised text; spans are code points of it."""
        if not self.notices:
            return
        tried: dict[int, list[int]] = {}
        for end, (length, of) in self.seeds.iter(text):
            for n, at in of:
                tried.setdefault(n, []).append(end + 1 - length - at)
        for n, begins in tried.items():
            notice, done = self.notices[n], -1
            for begin in sorted(begins):
                if begin + len(notice.words) <= done:  # inside the span that was matched last
                    continue
                slack = 2 * (notice.errors + sum(notice.each)) + (LEAD_LENGTH + 2 * LEAD_ERRORS) * notice.led
                low, high = max(0, begin - slack), begin + len(notice.words) + 2 * (notice.errors + sum(notice.each))
                m = self.patterns[n].search(text, max(low, done), high + 1) if high > done else None
                if m and m.end() > done:
                    done = m.end()
                    wrong = sum(m.fuzzy_counts)
                    yield notice.label, m.start(), m.end(), wrong, 1 - wrong / (m.end() - m.start() if notice.led else len(notice.words))

    def exact(self, text: str, starts: list[int]) -> list[tuple[int, str]]:
        """(word number, label) of every place where a phrase's words stand consecutively."""
        found, padded = [], f" {text} "
        for phrase, label in self.phrases:
            at = padded.find(f" {phrase} ")
            while at >= 0:
                found.append((bisect_left(starts, at), label))
                at = padded.find(f" {phrase} ", at + 1)
        return found

    def row(self, raw: bytes | None) -> tuple:
        ws = [w.decode("utf-8", "replace") for w in normal_words(raw)]
        text = " ".join(ws)
        starts = [0, *accumulate(len(w) + 1 for w in ws)]
        base = self.exact(text, starts)
        fuzzy = told_apart(list(self.fuzzy(text)))
        own = sorted({label for _, label in base})
        every = sorted({*own, *(f[0] for f in fuzzy)})
        places = sorted(p for p, _ in base)
        # A span's words: from the one that it begins in, to the one that it ends before.
        number = lambda at: bisect_right(starts, at) - 1
        spans = ",".join(f"{label}:{number(a)}:{number(b - 1)}:{wrong}" for label, a, b, wrong, _ in sorted(widest(fuzzy), key=lambda f: (f[1], f[0])))
        score = 1.0 if base else max((f[4] for f in fuzzy), default=0.0)
        return len(ws), len(base), places[0] if places else None, places[-1] if places else None, ",".join(own), ",".join(every), score, spans


def widest(found: list[Found]) -> list[Found]:
    """Finds that no other find of their label contains: a license may be named by a part of what names it."""
    out: list[Found] = []
    reach: dict[str, int] = {}
    for f in sorted(found, key=lambda f: (f[1], -f[2])):
        if f[2] > reach.get(f[0], -1):
            reach[f[0]] = f[2]
            out.append(f)
    return out


def told_apart(found: list[Found]) -> list[Found]:
    """Finds without those that a better or narrower one overlaps: fewer errors, or as many and a label that goes on ("cc-by-nc" over "cc-by")."""
    found = sorted(found, key=lambda f: (f[1], f[2]))
    longest, out = max((f[2] - f[1] for f in found), default=0), []
    begins = [f[1] for f in found]
    for f in found:
        low, high = bisect_left(begins, f[1] - longest), bisect_left(begins, f[2])
        others = [o for o in found[low:high] if o[0] != f[0] and o[2] > f[1]]
        if not any(o[3] < f[3] or (o[3] == f[3] or not f[3]) and o[0].startswith(f"{f[0]}-") for o in others):
            out.append(f)
    return out


@cache
def _scanner(notices: tuple[Notice, ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(notices, phrases)


def scan(docs: DataFrame, text: str = "text", notices: tuple[Notice, ...] = NOTICES + NAMED + TAGS, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """``docs`` with the result columns; ``notices`` lists fuzzy finds as label:first word:last word:errors.

    One pass, no shuffle. A null or blank text counts as empty (no words, no labels, score 0); a long one is scanned
    whole by one task, in time that its length and its finds add up to. Repeated rows and ids are rows like any other,
    and an empty table gives an empty result. Columns of ``docs`` that have a result's name are replaced; all others
    may have any names.
    """
    pairs = [x.split() for x in RESULT.split(", ")]
    base = docs.drop(*(n for n, _ in pairs))
    place = base.columns.index(text)
    schema = base.limit(0).withColumns({n: F.lit(None).cast(t) for n, t in pairs}).schema
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices, phrases)
        for b in batches:
            rows = [scanner.row(t) for t in b.column(place).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(pairs)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, pairs, strict=True))], names=schema.names)

    return numbered(base).mapInArrow(run, schema)


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
