import re

import pytest

from tallyworks.llm import licenses as L

from .fixtures import documents, frame

CASES = {
    1: "Released under the MIT License. under the MIT license",
    2: "Licenced under the Apache Licence, Version 2.0",
    3: "cc-by-nc CC BY NC cc.by.nc; Apache License Version 2",
    4: "Permission is hereby granted, free of chrage, to any person obtaining a copy",
    5: "we permit nothing here", 6: None, 7: "", 8: "under the mit license" * 3, 9: "all right reserved",
}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(k, label) for p, label in L.PHRASES for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
    places = [k for k, _ in found]
    return len(ws), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_and_fuzzy(spark):
    df = spark.createDataFrame(list(CASES.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    for k, t in CASES.items():
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[2].labels == "apache-2" and got[2].n_base == 0 and 0.8 < got[2].score < 1
    assert got[4].labels == "mit" and got[9].labels == "proprietary" and got[5].labels == "" and got[6].score == 0
    assert got[4].notices.startswith("mit:0:")


@pytest.mark.parametrize("notice", L.NOTICES, ids=lambda n: n.words[:40])
def test_any_allowed_errors_are_found(notice):
    import random

    rng, scanner = random.Random(7), L.Scanner()
    for _ in range(40):
        t = list(notice.words)
        for _ in range(notice.errors):
            k = rng.randrange(1, len(t) - 1)
            rng.choice([lambda: t.__setitem__(k, "q"), lambda: t.insert(k, "z"), lambda: t.pop(k)])()
        found = [f[0] for f in scanner.fuzzy("some words before " + "".join(t) + " and some words after")]
        assert notice.label in found, "".join(t)


def test_documents_and_empty(spark, sf_dir):
    from tallyworks.llm.common import read_table

    texts = {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}
    for r in L.op6_licenses(spark, sf_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
    got = L.scan(frame(spark, documents()))
    assert got.count() == len(documents()) and L.scan(frame(spark, [])).count() == 0


LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Released under the GNU General Public License.": "gpl",
    "This file is licenced under the GNU General Public Licence": "gpl",
    "Licensed under the Mozilla Public License, version 2.0": "mpl-2",
    "Licenced under the MIT Licence": "mit",
    "Licensed under the BSD license": "bsd",
    "The general public was not licensed under the rules": "",
    "MIT License\n\nCopyright (c) 2020 Somebody": "mit",
    "License: Apache-2.0": "apache-2",
    "This text is licensed under CC BY-SA 4.0": "cc-by-sa",
    "released under the BSD 3-Clause License": "bsd",
    "It is licensed under the GPL v3": "gpl",
    "distributed under the GNU General Public License v3": "gpl",
    "Mozilla Public License 2.0": "mpl-2",
    "Available under the terms of the LGPL": "lgpl",
    "it was released under the exit license": "",
    "Licensed under the MIT-0 License": "",
    "the gpl is a license, and cc by the way of mit": "",
}


def test_lines_that_name_a_license():
    scanner = L.Scanner()
    assert {t: scanner.row(t.encode())[5] for t in LINES} == LINES


def test_license_lines_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = r"(?i)licensed under the gnu general public license"
    rows = L.scan(docs.select("doc_id", "text").where(docs.text.rlike(line))).collect()
    assert rows and all("gpl" in r.labels.split(",") and r.score == 1 for r in rows)


def least_errors(words, notice):
    """Fewest edits that make a stretch of whole words of a text the notice: edit distances to all its stretches."""
    text, best = " ".join(words), None
    starts = [0] + [k + 1 for k, c in enumerate(text) if c == " "]
    for a in starts:
        row = list(range(len(notice) + 1))
        for k in range(a, min(len(text), a + 2 * len(notice))):
            new = [k - a + 1]
            for j, c in enumerate(notice):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (text[k] != c)))
            row = new
            if k + 1 == len(text) or text[k + 1] == " ":
                best = row[-1] if best is None else min(best, row[-1])
    return len(notice) if best is None else best


LEADS = [f"{verb} under{of}{a}" for verb in "licensed released distributed available published provided".split() for of in ("", " the terms of") for a in ("", " the", " a", " an")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def least_led(words, notice):
    """Fewest errors of a lead and a name with bounds of their own, over all stretches of whole words; None if a bound is broken."""
    name, found = notice.words.split(), []
    for b in range(1, len(words) - len(name) + 1):
        each = [distance(w, x) for w, x in zip(words[b : b + len(name)], name, strict=True)]
        if all(e <= most for e, most in zip(each, notice.each, strict=True)):
            leads = [distance(" ".join(words[a:b]), lead) for a in range(max(0, b - 8), b) for lead in LEADS]
            if min(leads) <= L.LEAD_ERRORS:
                found.append(min(leads) + sum(each))
    return min(found, default=None)


@pytest.mark.parametrize("seed", range(3))
def test_names_after_leads_against_brute_force(seed):
    import random

    rng, scanner = random.Random(seed), L.Scanner(L.NAMED, ())
    for _ in range(60):
        notice = rng.choice(L.NAMED)
        lead, words = list(rng.choice(LEADS)), notice.words.split()
        for _ in range(rng.randrange(4)):
            rng.choice([lambda: lead.__setitem__(rng.randrange(len(lead)), "q"), lambda: lead.insert(rng.randrange(len(lead)), "z"), lambda: lead.pop(rng.randrange(len(lead)))])()
        if rng.random() < 0.4:
            k = rng.randrange(len(words))
            words[k] = words[k].replace(rng.choice(words[k]), "v", 1)
        text = ("and it is " + "".join(lead) + " " + " ".join(words) + " for all").split()
        assert {f[0] for f in scanner.fuzzy(" ".join(text))} == {n.label for n in L.NAMED if least_led(text, n) is not None}, text


def test_labels_and_scores_against_brute_force():
    import random

    rng, scanner = random.Random(12), L.Scanner()
    short = [n for n in L.NOTICES + L.TAGS if len(n.words) < 50]
    for _ in range(25):
        notice = rng.choice(short)
        t = list(notice.words)
        for _ in range(rng.randrange(notice.errors + 3)):
            rng.choice([lambda: t.__setitem__(rng.randrange(len(t)), "q"), lambda: t.insert(rng.randrange(len(t)), "z"), lambda: t.pop(rng.randrange(len(t)))])()
        words = ("so it goes " + "".join(t) + " and on").split()
        found = list(scanner.fuzzy(" ".join(words)))
        want = {n: least_errors(words, n.words) for n in L.NOTICES + L.TAGS}
        led = {n.label: w for n in L.NAMED if (w := least_led(words, n)) is not None}
        assert {f[0] for f in found} == {n.label for n, wrong in want.items() if wrong <= n.errors} | set(led), words
        row = scanner.row(" ".join(words).encode())
        assert set(row[5].split(",")) - {""} <= {f[0] for f in found} | {label for p, label in L.PHRASES if p in " ".join(words)}
        if row[1] == 0 and not led:
            assert row[6] == max((1 - wrong / len(n.words) for n, wrong in want.items() if wrong <= n.errors), default=0.0)


APART = {
    "licensed under a Creative Commons Attribution-NonCommercial 4.0 license": "cc-by-nc",
    "licensed under a Creative Commons Attribution-ShareAlike license": "cc-by-sa",
    "Licensed under a Creative Commons Attribution 4.0 license": "cc-by",
    "Licensed under the ISC license": "isc",
    "Licensed under the BSD license": "bsd",
    "Licensed under the zlib license": "zlib",
    "// SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "# SPDX-License-Identifier: CC-BY-NC-4.0": "cc-by-nc",
    "under the terms of the GNU Lesser General Public License, version 3": "lgpl",
    "GNU Affero General Public Licence: under the GNU Affero General Public License": "agpl",
    "licensed under the GNU General Public License; all rights reserved": "gpl,proprietary",
    "Licensed under the Eclipse Public License v2": "epl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
}


def test_notices_are_told_apart():
    scanner = L.Scanner()
    assert {t: scanner.row(t.encode())[5] for t in APART} == APART


def test_many_notices_in_one_text():
    import time

    scanner, took = L.Scanner(), []
    for n in (5000, 20000):
        text = "under the mit license and Licenced under the Apache Licence, Version 2.0 or " * n
        begun = time.perf_counter()
        row = scanner.row(text.encode())
        took.append(time.perf_counter() - begun)
        assert row[1] == n and row[7].count("apache-2:") == n and row[3] == 14 * (n - 1)
    assert took[1] < 8 * took[0] + 1
