"""op2: planted notices, suppression and awkward rows."""

import re

from drawgraph.llm import license_scan
from drawgraph.llm.license_rules import BASE, GATES, build

TEXTS = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "x CC BY-NC 4.0, and cc by cc BY; General Public License! all-rights reserved All Rights\nReserved",
    3: "Released under the MIT License. (c) nothing",
    4: None,
    5: "",
    6: "SPDX-License-Identifier: GPL-2.0-or-later",
    7: "publicly general public licenses",
    8: "words " * 3000 + "cc by " + "words " * 2000,
    9: "This work is licensed under the GNU General Public License, version 3.",
    10: "İlicense K ccK by",
}


def test_rules_are_sound():
    rules = build()
    assert len(rules) > 250
    for label, level, key, rx in rules:
        assert level in (1, 2, 3) and label
        re.compile(rx)
        assert any(g in f" {key} " for g in GATES), key


def test_scan(spark):
    rows = [(i, t, "s", 5) for i, t in TEXTS.items()] + [(1, TEXTS[1], "s", 6)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in TEXTS.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))), i
    assert by[1].labels == "apache-2.0" and by[1].n_found == 1 and by[1].score == 1.0
    assert by[2].labels.split(",") == ["cc-by", "cc-by-nc-4.0", "gpl", "reserved"]
    assert by[3].labels == "mit" and by[4].labels == "" and by[4].score == 0.0
    assert by[6].labels == "gpl-2.0" and by[9].labels.split(",") == ["gpl", "gpl-3.0"]
    assert by[7].labels == "" and by[10].n_base == 0
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def kinds(parsed):
    """A text for every choice of alternatives, options and least repeats of a parsed pattern."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            step = [chr(arg)]
        elif name == "IN":
            step = ["x" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "NOT_LITERAL":
            step = ["x"]
        elif name == "BRANCH":
            step = [t for branch in arg[1] for t in kinds(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            step = [t * n for n in {arg[0], arg[0] + (arg[1] > arg[0])} for t in kinds(arg[2])]
        else:
            assert name == "SUBPATTERN", name
            step = kinds(arg[-1])
        out = [a + b for a in out for b in dict.fromkeys(step)]
    return out


def test_keywords_stand_in_every_match():
    for _, _, key, rx in build():
        for text in kinds(re._parser.parse(rx)):
            assert re.fullmatch(rx, text) and key in f" {text} " and any(g in f" {text} " for g in GATES), (key, text)


def test_alternatives_are_found(spark):
    texts = ["may not be copied or reproduced without the prior written permission", "may not be published without consent", "the apache software license", "end user licence agreement", "an open rail m model"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in sorted(got)] == [("proprietary", 1.0), ("proprietary", 1.0), ("apache", 0.5), ("eula", 0.5), ("openrail-m", 0.8)]


def test_many_matches_in_one_text(spark):
    """Intervals from piece to piece, and a text of 40,000 notices in one row."""
    texts = ["cc by x " * n for n in (1, 255, 256, 257, 40_000)]
    got = sorted(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [(r.n_found, r.n_base, r.last_word, r.labels) for r in got] == [(n, n, 3 * (n - 1), "cc-by") for n in (1, 255, 256, 257, 40_000)]
