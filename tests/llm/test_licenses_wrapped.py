"""Licence texts wrapped over several lines, and licence sentences inside long lines."""

import random
import textwrap

import pytest

from runsight.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(3)
    return lambda n: " ".join(draw.choices(["the", "of", "thentin", "license", "under", "erand", "ation", "general", "nd", "public", "work", "is", "hely"], k=n))


def test_wrapped_texts_and_long_lines(spark, make_docs, prose):
    texts = {
        1: (MIT, "mit", 2),
        2: (BSD.replace("\n", "\r\n"), "bsd", 2),
        3: (APACHE, "apache", 4),
        4: ("\n".join([prose(20), *textwrap.wrap(AGPL, 40), prose(20)]), "agpl", 1),
        5: (f"{prose(300)}. Released under the MIT License. {prose(300)}", "mit", 1),
        6: (f"{prose(200)}. {AGPL}. {prose(400)}", "agpl", 1),
        7: (f"{prose(30)} released under the\nMIT License.\n" * 3, "mit", 3),
        8: (f"{prose(100)} {' '.join(BSD.split())} {prose(100)} Licensed under CC BY-NC 4.0. {prose(50)}", "bsd,cc-by-nc", 1),
        9: ("Permission is hereby granted to the\n" + prose(60) + "\nany person obtaining a copy", "", 0),
    }
    rows = [(i, t) for i, (t, _, _) in texts.items()] + [(100 + i, f"{prose(30)}\n{prose(40)}") for i in range(100)]
    docs = make_docs(rows + rows[:3])
    got = [r for r in licenses.scan(docs, *licenses.fit(docs)).collect()]
    assert len(got) == len(rows) + 3
    for r in got:
        _, families, n = texts.get(r.doc_id, ("", "", 0))
        assert (r.doc_id, ",".join(r.licenses), r.n_license) == (r.doc_id, families, n)
    assert {r.doc_id: r.n_unconfirmed for r in got}[1] == 0


def test_prefilter_and_places(spark, make_docs):
    docs = make_docs([(i, t.replace(" ", "\n")) for i, t in enumerate(t for _, texts in sorted(licenses.TEMPLATES.items()) for t in texts)])
    assert docs.where(licenses.may_hold(docs["text"])).count() == docs.count()
    assert docs.join(licenses.statements(docs, "text").select(licenses.F.col("key")).distinct(), licenses.text_key(docs["text"]) == licenses.F.col("key")).count() == docs.count()
    one = licenses.statements(make_docs([(1, "-\nReleased under\n\nthe MIT\nLicense. More\n")]), "text").collect()
    assert [(r["first"], r["last"], " ".join(r["words"])) for r in one] == [(1, 4, "released under the mit license")]
