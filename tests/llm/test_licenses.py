"""License scans: base phrases by brute force, rules against SQL, suppression against a comparison of all pairs."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import licenses

LINES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.0",
    "Licensed under CC BY-NC 4.0",
    "CC BY-NC-SA 3.0 and cc-by 4.0; Creative Commons Attribution-ShareAlike 4.0 International License",
    "SPDX-License-Identifier: LGPL-2.1-or-later",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License",
    "https://www.mozilla.org/en-US/MPL/2.0/ Mozilla Public License v2.0",
    "tous droits réservés, sous licence MIT. Alle Rechte vorbehalten. All rights reserved.",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "under the mit license under the mit license",
    "émit license mitlicense under the mité license",
    "under\u00a0the mit license; cc\u2009by nc",
    "apache license version 2 apache license version 2",
    "dual licensed: MIT License or Apache-2.0, not GPL v2",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = "the of license gnu mit apache version 2 3 public by nc cc under general river stone commercial".split()
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, line) for i, line in enumerate(LINES)]
    for i in range(len(LINES), 220):
        parts = [fill(rng.randint(0, 30)) if rng.random() < 0.6 else rng.choice(LINES) for _ in range(rng.randint(1, 6))]
        out.append((i, rng.choice([" ", "\n", ", ", "--", ""]).join(parts).upper() if i % 9 == 0 else " ".join(parts)))
    return [*out, (300, None), (301, ""), (302, "-- \n"), (303, "x" * 5000 + " under the MIT license"), (304, fill(30000))]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for label, phrase in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), out


def test_licenses_equal_brute_force_and_sql(spark, texts):
    rows = [*texts, texts[0], texts[0], (None, texts[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("did", "labels", "score", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    got = [tuple(r) for r in licenses.op13(df).collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    for i, text in rows:
        n, places = base_places(text)
        r = by_id[i]
        assert r[1:3] == (n, len(places)), i
        assert r[3:5] == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r[5] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r[5].split(","))) <= set(filter(None, r[6].split(","))) and 0 <= r[7] <= 1
    documents = pd.DataFrame(texts, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(licenses.OP13_SQL).fetchall()
    plain = lambda row: tuple(None if v != v else v for v in row)
    assert sorted(plain(r) for r in want) == sorted({r for r in got if r[0] is not None})


def test_labels_of_known_lines(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id int, text string")
    labels = {r["did"]: r["labels"].split(",") for r in licenses.scan_licenses(df).collect()}
    assert labels[0] == ["apache-2"] and labels[1] == ["mit"] and labels[2] == ["gpl-3"] and labels[3] == ["cc-by-nc"]
    assert labels[4] == ["cc-by", "cc-by-nc", "cc-by-nc-sa", "cc-by-sa"] and labels[5] == ["lgpl-2-1"] and labels[6] == ["lgpl-2-1"]
    assert labels[7] == ["bsd", "bsd-3"] and labels[8] == ["mpl-2"] and labels[9] == ["mit", "proprietary"] and labels[10] == ["bsd-3"]
    assert labels[12] == [""] and labels[13] == ["mit"]
    assert labels[15] == ["apache-2", "gpl-2", "mit"]


def test_every_rule_can_match_and_is_gated_by_its_own_words():
    """A text made of a rule's expression matches it; keywords are words of everything that it matches."""
    rules = licenses.signature_rules()
    assert len(rules) > 300
    for r in rules:
        text = r.pattern
        for _ in range(9):  # optional parts go, of choices the first stays, a gap has one word
            text = re.sub(r" \?", " ", text)
            text = re.sub(r"\(\?:\\S\+ \)\{1,\d+\}", "xyz ", text)
            text = re.sub(r"\(\?:\\S\+ \)\{\d+,\d+\}|\(\?: \\S\+\)\{\d+,\d+\}|\(\?:[^()]*\)\?|[a-z]\?", "", text)
            text = re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)", r"\1", text)
            text = re.sub(r"\[(.)[^]]*\]\??", r"\1", text).replace("\\S+", "xyz").replace(r"\w\w", "en").replace("\\+", "+")
        n, found = licenses.Scanner((r,)).scan(text.encode())
        assert found, (r.label, r.pattern, text)


def test_suppression_by_comparing_all_pairs():
    rng = random.Random(7)
    kinds = list(licenses.CONFIDENCE)
    for _ in range(200):
        rules = [licenses.Rule(i, f"l{i}", rng.choice(kinds), frozenset(), "") for i in range(6)]
        found = list({(a, n, r.order): (a, n, r) for a, n, r in ((rng.randint(0, 8), rng.randint(1, 6), rng.choice(rules)) for _ in range(rng.randint(0, 14)))}.values())
        rank = lambda r: (licenses.PRIORITY[r.kind], r.order)
        want = [
            d for d in found
            if not any(o[0] <= d[0] and o[0] + o[1] >= d[0] + d[1] and (licenses.PRIORITY[o[2].kind] <= licenses.PRIORITY[d[2].kind] if o[1] > d[1] else rank(o[2]) < rank(d[2])) for o in found)
        ]
        key = lambda d: (d[0], d[1], d[2].order)
        assert sorted(licenses.suppress(found), key=key) == sorted(want, key=key)


def test_a_long_text_is_cleaned_in_slices(monkeypatch):
    text = ("Stone, river. " * 50 + "Released under the MIT License. ") * 40
    whole = licenses._scanner().scan(text.encode())
    monkeypatch.setattr(licenses, "SLICE_BYTES", 100)
    assert licenses._scanner().scan(text.encode()) == whole and len(whole[1]) >= 40


def test_empty(spark, empty):
    assert licenses.op13(empty).collect() == []
