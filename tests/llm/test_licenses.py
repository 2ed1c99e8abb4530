"""Licence scans against planted paragraphs."""

import random

import pytest

from runsight.llm import licenses

LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
}


def prose(draw, n):
    return [" ".join(draw.choices(["the", "of", "thentin", "license", "under", "erand", "ation", "general", "nd", "public", "work", "is", "hely"], k=draw.randrange(3, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    draw, rows = random.Random(1), []
    for i in range(150):
        lines, want = prose(draw, draw.randrange(1, 12)), []
        for line, family in draw.sample(sorted(LINES.items()), draw.choice([0, 0, 1, 2])):
            lines.insert(draw.randrange(len(lines) + 1), line)
            want.append(family)
        rows.append((i, draw.choice(["\n", "\r\n", "\n\n"]).join(lines), sorted(want), len(lines)))
    return rows


def test_planted_paragraphs_are_found(spark, make_docs, planted, sf_dir):
    rows = [r[:2] for r in planted]
    odd = [(500, None), (501, ""), (502, " \n -- \n"), (None, "Released under the MIT License."), rows[0], rows[0], (503, "Released under the MIT License.\n" * 3), (504, "word " * 50_000)]
    out = licenses.op8_license_scan(spark, sf_dir.write(make_docs(rows + odd)))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all((by[i].n_paragraphs, by[i].n_license, by[i].licenses, by[i].license_score) == (0, 0, "", 0.0) for i in (500, 501, 502))
    assert by[None].licenses == "mit" and (by[503].n_license, by[503].licenses) == (3, "mit") and by[504].n_license == 0
    for d, _, want, n in planted:
        assert by[d].n_paragraphs == n
        assert by[d].licenses == ",".join(sorted(set(want))) and by[d].n_license == len(want)


def test_empty_table_and_clashing_names(spark, make_docs):
    docs = make_docs([(1, "Released under the MIT License."), (2, "plain text")], extra=True).withColumnRenamed("ids", "words").withColumnRenamed("n_words", "features").withColumnRenamed("component_id", "probability")
    out = licenses.scan(docs, *licenses.fit(docs))
    assert out.columns == [*docs.columns, "n_paragraphs", "n_license", "n_unconfirmed", "licenses", "license_score"]
    assert {r.doc_id: list(r.licenses) for r in out.collect()} == {1: ["mit"], 2: []}
    none = docs.limit(0)
    assert licenses.scan(none, *licenses.fit(none)).count() == 0
