"""Licence texts as they stand in files, and benchmark items at every place of a document."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontam, licences

MIT = """Copyright (c) 2020 Somebody. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
BSD2 = """Copyright (c) 2019, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """This {0} is free software: you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation, either version {2} of the License, or
(at your option) any later version.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
FREE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n"

TEXTS = {
    "MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0": GPL.format("program", "", 3),
    "GPL-2.0": GPL.format("program", "", 2).replace(":", ";"), "LGPL-3.0": GPL.format("library", "Lesser ", 3), "MPL-2.0": MPL, "Unlicense": FREE,
    "Proprietary": "Copyright 2020.\nAll rights\nreserved.\n",
}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", ";; "])
def test_licence_texts_of_files(spark, mark):
    """Every rule finds its original text, wrapped and behind comment marks, and no rule another's."""
    rows = [(n, "".join(mark + x + "\n" for x in t.split("\n")) + "\n\nint main() { return 0; }") for n, t in enumerate(TEXTS.values())]
    rows += [(100, "w " * 200_000 + "\n" + rows[0][1]), (101, None), (102, ""), (103, "the following\nconditions"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, licence string, n_sentences long")
    got = sorted((r.doc_id, r.licence) for r in licences.licences(docs).collect())
    assert got == sorted([*enumerate(TEXTS), (0, "MIT"), (100, "MIT")])


def test_a_blank_line_and_an_unknown_word_part_sentences(spark):
    grant = MIT.split("\n\n")[1]
    rows = [(1, grant.replace("copy\nof", "copy\n\nof") + MIT.split("\n\n")[2]), (2, MIT.replace("hereby", "hardly")), (3, MIT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.licence) for r in licences.licences(docs).collect() if r.licence == "MIT"] == [(3, "MIT")]


def test_identifier_tags(spark):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: Apache-2.0\n\nint x;"), (2, "SPDX-License-Identifier: MIT"), (3, "SPDX: MIT")], "doc_id long, text string")
    got = licences.licences(docs, licences.Rules.standard(tags=True)).collect()
    assert sorted((r.doc_id, r.licence) for r in got) == [(1, "Apache-2.0"), (2, "MIT")]
    assert licences.licences(docs).count() == 0


HEAVY = [
    "Please compute quickly the sum 4 9 16 25 36 49 64 81 now",
    "what comes next behind 1 2 3 4 5 6 7 8 9 10 in this row of numbers",
    "add 3 km 4 km 5 km 6 km 7 km and then tell us how far you are from home",
    "the bus left at 7 15 and came back at 9 45 while the train left at 8 20",
]


def plain_leaks(docs, items, least=13):
    """(doc, item) of the texts that hold a whole item of up to `least` words, or `least` words of one, verbatim."""
    out = set()
    for d, t in docs:
        w = t.lower().split()
        for i, x in items:
            y = x.lower().split()
            n = min(len(y), least)
            parts = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)}
            if any(tuple(w[k : k + n]) in parts for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_items_with_many_slots_at_every_offset(spark):
    r = random.Random(1)
    fill = [f"word{i}" for i in range(50)]
    docs = []
    for i, item in enumerate(HEAVY):
        for before in range(26):
            docs.append((100 * i + before, " ".join([*r.choices(fill, k=before), item.lower(), *r.choices(fill, k=9)])))
    docs += [(900, " ".join(r.choices(fill, k=300)) + " " + HEAVY[0].lower() + " " + "9 8 7 " * 40_000), (901, "4 9 16 25 36 49 64 81 now"), (902, "7 15 " * 50)]
    items = list(enumerate(HEAVY))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)), frame)
    got = {(x.doc_id, x.item_id) for x in got.collect()}
    assert got >= plain_leaks(docs, items) >= {(100 * i + b, i) for i in range(4) for b in range(26)}
    assert not {901, 902} & {d for d, _ in got}


def test_items_of_slots_match_verbatim(spark):
    items = [(1, "12 of 30 of 7"), (2, "1 2 3 4 5 6 7 8 9 10 11"), (3, "4 of 7")]
    docs = [(1, "he said 12 of 30 of 7 then"), (2, "he said 12 of 31 of 7 then"), (3, "count: 1 2 3 4 5 6 7 8 9 10 11 12"), (4, "1 2 3 4 5 6 7 8 9 10 12"), (5, "it was 4 of 7 then")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), frame).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 1), (3, 2)]
