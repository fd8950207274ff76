import random

from synthscope.llm import licenses

from .conftest import SCHEMA

LINES = ["Licensed under the Apache License, Version 2.0.", "  ** licensed UNDER the apache license version 2.0 !!", "Released under the MIT License.", "Released under the License", "under the", "MIT", "", "words that match nothing at all",
         "This work is licensed under the GNU General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under CC BY-NC 4.0. " * 3, "Licensed under CC BY-NC 4.0."]
WRAPPED = "# Redistribution and use in source and binary forms,\n# with or without modification, are permitted provided\n# that the following conditions are met:\n\n/* Licensed under the Apache\n * License, Version 2.0. */"
BODIES = {text: name for name, texts in licenses.TEMPLATES.items() for text in texts}


def grams(words):
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def slow(rows):
    """Every stretch that any required bigram may stand in, and the best of those that overlap."""
    out = []
    for d, text in set(rows):
        words, found = licenses.normal_words(text or ""), set()
        for t in licenses.prepared(licenses.TEMPLATES, licenses.THRESHOLD):
            for i, (a, b) in enumerate(zip(words, words[1:])):
                for s in {i - o for g, o in t.anchors if g == f"{a} {b}"}:
                    own = grams(words[max(s, 0) : max(s + t.words, 0)])
                    dice = 2 * len(own & set(t.grams)) / (len(own) + len(t.grams))
                    if dice >= 0.8:
                        found.add((max(s, 0), min(s + t.words, len(words)) - max(s, 0), len(own & set(t.grams)), dice, t.license))
        finds, mid, end = [], 0, 0
        for f in sorted(found, key=lambda f: (f[0], -f[1])):
            if not finds or (f[0] >= mid and f[0] + f[1] > end):
                finds.append([])
            finds[-1].append(f)
            mid, end = max(mid, f[0] + (f[1] + 1) // 2), max(end, f[0] + f[1])
        best = [min(f, key=lambda f: (-f[2], -f[3], f[0], f[4], f[1])) for f in finds]
        out += [(d, start, n, name, round(dice, 9)) for start, n, _, dice, name in best]
    return sorted(out, key=repr)


def scan(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, "MIT", 0, "x") for r in rows], "doc_id long, text string, license string, start_word int, print string")
    return sorted([(r["doc_id"], r["start_word"], r["n_words"], r["license"], round(r["dice"], 9)) for r in licenses.scan_licenses(frame, **settings).collect()], key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = list(enumerate([*LINES, *BODIES]))
    rows += [(50, "\n".join(LINES)), (51, None), (None, LINES[0]), (None, LINES[2]), (52, "é\n" * 5000 + LINES[2]), (53, "\r\n".join(LINES)), (53, "\r\n".join(LINES)), (53, LINES[0]), (54, WRAPPED), (55, "\n".join([WRAPPED, "", "Thanks.", *LINES]))]
    for d in range(100, 160):  # notices cut, with words lost, added and changed, one after the other
        words = " ".join(rng.choices(list(BODIES), k=3)).split()
        for _ in range(len(words) // 12):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([["other"], [], ["two", "words"]])
        rows.append((d, " ".join(words[rng.randrange(3) :])))
    got = scan(spark, rows)
    assert got == slow(rows) and len(got) > 100


def test_each_notice_is_found_amid_other_words(spark):
    rows = [(2 * k + wrapped, "/*\n * " + "\n * ".join(text.split()) + "\n */" if wrapped else f"See docs. {text} All rights are kept.") for k, text in enumerate(BODIES) for wrapped in (0, 1)]
    want = [(2 * k + wrapped, 0 if wrapped else 2, len(licenses.normal_words(text)), name, 1.0) for k, (text, name) in enumerate(BODIES.items()) for wrapped in (0, 1)]
    assert sorted(scan(spark, rows)) == want


def test_settings_and_empty_tables(spark):
    assert {x[3] for x in scan(spark, list(enumerate(LINES)), templates={"MIT": "Released under the MIT License."})} == {"MIT"}
    assert scan(spark, list(enumerate(LINES)), templates={"X": "word", "Y": []}) == []
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wrapped_notices_are_found_once(spark):
    assert [x[1:4] for x in scan(spark, [(1, "Thanks.\n" + WRAPPED + "\nDone.")])] == [(1, 21, "BSD"), (22, 8, "Apache-2.0")]


def test_licences_of_one_family_are_told_apart(spark):
    texts = ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: LGPL-3.0-only", "under the terms of the lease, as published", LINES[8], LINES[9]]
    assert [(x[0], x[3]) for x in scan(spark, list(enumerate(texts)))] == [(1, "LGPL-3.0"), (3, "GPL-3.0"), (4, "LGPL-3.0")]
