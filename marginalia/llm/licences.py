"""License scans by sentence rules.

A text's normalised sentences are mapped to identifiers of known licence sentences; the identifiers of a document, in
order, are matched against ordered rules. Unknown sentences between do not matter, their order does.

Licence texts are wrapped and stand behind comment marks, and their sentences hold colons and points. So a text is
cut into fragments at line ends and behind points, and a sentence is the longest known one that consecutive fragments
make up; a blank line ends it.

Plan: one scan without a shuffle. Fragments that begin like a known sentence are joined with those behind them and looked
up by value in a fixed set within the row; only documents that hold a known sentence go on.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.decontam import let

#: Sentences of well-known licence texts.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "rights": "all rights reserved",
}

#: Licence identifiers and the names that notices give them.
NAMES = {
    "MIT": ("mit license", "mit licence", "mit"),
    "ISC": ("isc license", "isc"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "bsd 3 clause"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl 2 0", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl 3 0", "gplv3"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl 3 0", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC0-1.0": ("cc0 1 0", "creative commons zero v1 0 universal"),
    "Unlicense": ("unlicense",),
}

#: How notices begin, before the name with or without an article.
NOTICES = (
    "licensed under", "released under", "distributed under", "available under", "published under",
    "this work is licensed under", "this file is licensed under", "this software is licensed under",
    "this project is licensed under", "this program is licensed under", "this document is licensed under",
    "content is licensed under", "code is licensed under", "made available under",
)

#: Ordered rules over sentence identifiers; `notice:X` is any notice that names X.
RULES = {
    "MIT": [("mit-grant", "mit-notice"), ("mit-grant", "mit-as-is"), ("notice:MIT",)],
    "ISC": [("isc-grant", "isc-as-is"), ("notice:ISC",)],
    "Apache-2.0": [("apache-may-not", "apache-copy"), ("apache-may-not", "apache-as-is"), ("notice:Apache-2.0",)],
    "BSD-3-Clause": [("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ("notice:BSD-3-Clause",)],
    "BSD-2-Clause": [("bsd-grant", "bsd-source", "bsd-binary"), ("notice:BSD-2-Clause",)],
    "GPL-3.0": [("gpl-free",), ("notice:GPL-3.0",)],
    "GPL-2.0": [("gpl2-free",), ("notice:GPL-2.0",)],
    "LGPL-3.0": [("lgpl-free",), ("notice:LGPL-3.0",)],
    "MPL-2.0": [("mpl-form",), ("notice:MPL-2.0",)],
    "Unlicense": [("unlicense-free",), ("unlicense-anyone",), ("notice:Unlicense",)],
    "Proprietary": [("rights",)],
}


#: Fixed value: comment marks at the begin of a line.
COMMENT = r"(^|\n)[ \t]*[#/*;!%<>-]+"
#: What counts only where no licence matches.
RESERVED = "Proprietary"


@dataclass
class Rules:
    """Known sentences by number, and for each licence its patterns over ' 3 17 5 ' strings of numbers."""

    sentences: dict[str, int] = field(default_factory=dict)
    patterns: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def standard(cls, tags: bool = False) -> Rules:
        """Rules of the fixed values; with `tags` the lines that name a licence by its identifier count as notices."""
        number: dict[str, int] = {}
        sentences: dict[str, int] = {}
        for name, text in SENTENCES.items():
            sentences[text] = number.setdefault(name, len(number))
        for lic, names in NAMES.items():
            nth = number.setdefault(f"notice:{lic}", len(number))
            for n in names:
                for start in NOTICES:
                    # a sentence may go on with its short name: ... (the "License")
                    for sentence in (f"{start} {n}", f"{start} the {n}"):
                        sentences[sentence] = sentences[f"{sentence} the license"] = nth
            if tags:
                sentences["spdx license identifier " + lic.lower().replace("-", " ").replace(".", " ")] = nth
        rules = RULES | {lic: [(f"notice:{lic}",)] for lic in NAMES if lic not in RULES}
        patterns = {
            lic: [" " + " (?:[0-9]+ )*".join(str(number[s]) for s in rule) + " " for rule in all_]
            for lic, all_ in rules.items()
        }
        return cls(sentences, patterns)


def fragments(text: Column) -> Column:
    """Normalised fragments: comment marks at the begin of lines left out, cut at line ends and behind . ! ? ; : before white space; lower case, words of a-z and
    0-9 only; empty ones stay, they part sentences."""
    plain = F.regexp_replace(text, COMMENT, "$1")
    cut = F.split(F.regexp_replace(plain, r"[.!?;:]+([ \t\r\n]|$)", "\n"), "\n")
    return F.transform(cut, lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def heads(known: Iterable[str]) -> list[str]:
    """The first word and the first two words of the known sentences."""
    return sorted({" ".join(k.split(" ")[:n]) for k in known for n in (1, 2)})


def known_sentences(cut: Column, known: dict[str, int]) -> Column:
    """Numbers of the known sentences that fragments make up, in the order of their first fragments."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    most = max(len(k.split(" ")) for k in known)  # a fragment has a word at least
    first = heads(known)
    starts = F.filter(F.transform(cut, lambda x, i: F.when(F.substring_index(x, " ", 2).isin(first), i)), lambda i: i.isNotNull())

    def longest(i: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(cut) - i)), lambda n: F.array_join(F.slice(cut, i + 1, n), " "))
        return F.try_element_at(F.filter(joined, lambda x: x.isin(list(known))), F.lit(-1))

    return F.transform(F.filter(F.transform(starts, longest), lambda x: x.isNotNull()), lambda x: table[x])


def licences(docs: DataFrame, rules: Rules | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, n_sentences (known ones in the document) of each rule that a document matches; one row each.

    A document may match several licences. BSD-2 is not reported where BSD-3 matches by the same text, and rights that are
    reserved only where no licence matches. Null and empty texts match nothing; very long texts are read whole; repeated
    rows are reported each, ties do not arise. No rows: no rows. Other columns are not read.
    """
    rules = rules or Rules.standard()
    first = heads(rules.sentences)

    def numbers(f: Column) -> Column:
        # a cheap test first: nearly all documents hold no fragment that begins like a known sentence
        begins = F.exists(f, lambda x: F.substring_index(x, " ", 2).isin(first))
        return F.when(begins, known_sentences(f, rules.sentences))

    # bound as a value, and no filter on it: a filter would move below and cut the text anew for each use
    rows = docs.select(F.col(id_col).alias("doc_id"), let(fragments(F.col(text_col)), numbers).alias("n"))
    rows = rows.select(
        "doc_id",
        F.size("n").cast("long").alias("n_sentences"),
        F.concat(F.lit(" "), F.array_join(F.transform("n", lambda x: x.cast("string")), "  "), F.lit(" ")).alias("ids"),
    )
    # numbers are parted by two spaces, so that each has one on either side
    spaced = {lic: [p.replace(" (?:[0-9]+ )*", " (?: [0-9]+ )* ") for p in ps] for lic, ps in rules.patterns.items()}
    found = F.array(
        *[F.when(F.greatest(*[F.col("ids").rlike(p) for p in [*ps, ps[0]]]), F.lit(lic)) for lic, ps in spaced.items()]
    )
    found = F.array_compact(found)
    if "BSD-2-Clause" in spaced and "BSD-3-Clause" in spaced:
        named = F.col("ids").rlike(spaced["BSD-2-Clause"][-1])
        found = F.when(F.array_contains(found, "BSD-3-Clause") & ~named, F.array_remove(found, "BSD-2-Clause")).otherwise(found)
    found = F.when(F.size(found) > 1, F.array_remove(found, RESERVED)).otherwise(found)
    return rows.select("doc_id", F.explode_outer(found).alias("licence"), "n_sentences").where("licence is not null")
