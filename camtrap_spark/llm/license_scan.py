"""License scans with a positional index of rare tokens.

The index holds, for each word of the licence templates, the templates and positions where it stands. A first
pass over all documents counts in how many each such word occurs. A second pass looks up every document's licence
words of high inverse document frequency, all of them, and turns each occurrence into votes for (template, start).
A start on which the postings of several words meet, within a slack of a twentieth of the template, is verified: its
mandatory phrases must stand there, and `least` of the template's words at about their places. In short notices a
phrase with a negation among the `NEGATED` words before it does not count. Phrases given as `base` are found at every
place besides, negated or not.

Defined results: a null text counts as empty; empty texts give zero counts, null positions, empty labels and
score 0.0. Repeated rows are scanned row by row. Several starts of one template count as one; of several the highest
share is the score. Only the key and text columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_SCHEMA, LOWER, WORD, bound_batches, gather_table, pieces, running, span_hashes, table_blocks, utf8, words

# Phrases and labels of the base scan.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions"
)
MIT_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
GNU_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
ZLIB_TERMS = (
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
    "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
BOOST_GRANT = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
    "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
    "compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)
EPL_NOTICE = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"

# Label, template text (public licence texts and notices), phrases that must stand in a match.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", MIT_GRANT, ["permission is hereby granted free of charge to any person obtaining", "without restriction"]),
    ("mit", MIT_CONDITION, ["all copies or substantial portions"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("apache-2", APACHE_NOTICE, ["apache license version 2", "except in compliance with the license"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", GNU_TERMS.format("General Public License", 3), ["gnu general public license", "version 3"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-2", GNU_TERMS.format("General Public License", 2), ["gnu general public license", "version 2"]),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3", ["gnu lesser general public license", "version 3"]),
    ("lgpl-3", GNU_TERMS.format("Lesser General Public License", 3), ["gnu lesser general public license", "version 3"]),
    ("lgpl-2.1", GNU_TERMS.format("Lesser General Public License", "2.1"), ["gnu lesser general public license", "version 2 1"]),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license"]),
    ("agpl-3", GNU_TERMS.format("Affero General Public License", 3), ["gnu affero general public license", "version 3"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("bsd-2-clause", f"{BSD_OPENING}: {BSD_SOURCE} {BSD_BINARY}", ["redistribution and use in source and binary forms", "must reproduce the above copyright notice"]),
    ("bsd-3-clause", f"{BSD_OPENING}: {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES}", ["redistribution and use in source and binary forms", "may be used to endorse or promote products"]),
    ("bsd", BSD_OPENING, ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("mpl-2", MPL_NOTICE, ["mozilla public license"]),
    ("epl-2", EPL_NOTICE, ["eclipse public license"]),
    ("isc", ISC_GRANT, ["with or without fee is hereby granted provided that"]),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"", ["with or without fee is hereby granted the software is provided"]),
    ("zlib", ZLIB_TERMS, ["must not be misrepresented"]),
    ("bsl-1", BOOST_GRANT, ["any person or organization obtaining a copy"]),
    ("unlicense", UNLICENSE, ["free and unencumbered software"]),
    ("mit", "The MIT License (MIT)", ["the mit license mit"]),
    ("apache-2", "Apache License Version 2.0, January 2004", ["apache license version 2 0 january 2004"]),
    ("gpl-3", "GNU General Public License Version 3, 29 June 2007", ["gnu general public license version 3 29 june 2007"]),
    ("gpl-2", "GNU General Public License Version 2, June 1991", ["gnu general public license version 2 june 1991"]),
    ("lgpl-3", "GNU Lesser General Public License Version 3, 29 June 2007", ["gnu lesser general public license version 3 29 june 2007"]),
    ("lgpl-2.1", "GNU Lesser General Public License Version 2.1, February 1999", ["gnu lesser general public license version 2 1 february 1999"]),
    ("agpl-3", "GNU Affero General Public License Version 3, 19 November 2007", ["gnu affero general public license version 3 19 november 2007"]),
    ("mpl-2", "Mozilla Public License Version 2.0", ["mozilla public license version 2"]),
    ("epl-2", "Eclipse Public License - v 2.0", ["eclipse public license v 2"]),
]

# Public licence identifiers, without "-only" and "-or-later", and their labels.
IDENTIFIERS = {
    "MIT": "mit",
    "Apache-2.0": "apache-2",
    "GPL-3.0": "gpl-3",
    "GPL-2.0": "gpl-2",
    "LGPL-3.0": "lgpl-3",
    "LGPL-2.1": "lgpl-2.1",
    "AGPL-3.0": "agpl-3",
    "CC-BY-NC-4.0": "cc-by-nc",
    "CC-BY-SA-4.0": "cc-by-sa",
    "CC-BY-4.0": "cc-by",
    "CC0-1.0": "cc0",
    "BSD-2-Clause": "bsd-2-clause",
    "BSD-3-Clause": "bsd-3-clause",
    "MPL-2.0": "mpl-2",
    "EPL-2.0": "epl-2",
    "ISC": "isc",
    "0BSD": "0bsd",
    "Zlib": "zlib",
    "BSL-1.0": "bsl-1",
    "Unlicense": "unlicense",
}
TEMPLATES += [(label, f"SPDX-License-Identifier: {name}", [f"spdx license identifier {name}"]) for name, label in IDENTIFIERS.items()]

# Words that negate what follows (of "isn't" and its like the part behind the apostrophe).
NEGATIONS = ["not", "never", "neither", "nor", "t"]
#: How many words before a phrase are looked at for a negation, and the longest template, in words, in which they are.
NEGATED, NOTICE_WORDS = 4, 16


def word_hashes(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    starts, ends, _ = words(LOWER[data], offsets, WORD)
    return span_hashes(running(LOWER[data]), starts, ends)


@dataclass(frozen=True)
class LicenseIndex:
    vocabulary: np.ndarray  # sorted hashes of the templates' and phrases' words
    base: tuple[tuple[tuple[int, ...], str], ...]
    templates: tuple[tuple[str, np.ndarray, tuple[np.ndarray, ...]], ...]
    negations: np.ndarray
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    @staticmethod
    def build(templates=TEMPLATES, base=BASE_PHRASES) -> LicenseIndex:
        texts = [t for _, t, _ in templates] + [k for _, _, ks in templates for k in ks] + list(base) + NEGATIONS
        vocabulary = np.unique(np.concatenate([word_hashes(t) for t in texts]))
        ids = lambda t: np.searchsorted(vocabulary, word_hashes(t))
        made = tuple((label, ids(t), tuple(ids(k) for k in ks)) for label, t, ks in templates)
        postings = defaultdict(list)
        for at, (_, body, _) in enumerate(made):
            for pos, word in enumerate(body.tolist()):
                postings[word].append((at, pos))
        return LicenseIndex(vocabulary, tuple((tuple(ids(p).tolist()), label) for p, label in base.items()), made, ids(" ".join(NEGATIONS)), dict(postings))


def licence_words(part: pa.RecordBatch, vocabulary: np.ndarray):
    """The id of every word of the slice in the vocabulary (-1: none), the row of each, the first word of each row."""
    data, offsets = utf8(part.column("text"))
    data = LOWER[data]
    starts, ends, row = words(data, offsets, WORD)
    hashes = span_hashes(running(data), starts, ends)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    ids = np.full(len(hashes), -1, dtype=np.int32)
    if len(at) and len(vocabulary):
        found = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
        ids[at] = np.where(vocabulary[found] == hashes[at], found, -1)
    n_words = np.bincount(row, minlength=part.num_rows)
    return ids, row, n_words, np.concatenate([[0], np.cumsum(n_words)[:-1]])


def phrase_places(ids: np.ndarray, row: np.ndarray, phrase) -> np.ndarray:
    if len(ids) < len(phrase) or not len(phrase):
        return np.zeros(0, np.int64)
    last = len(ids) - len(phrase) + 1
    at = np.flatnonzero(ids[:last] == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        at = at[ids[at + k] == word]
    return at[row[at] == row[at + len(phrase) - 1]]


def document_frequency(docs: DataFrame, index: LicenseIndex, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary occurs; and the number of documents."""
    size = len(index.vocabulary) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, row, _, _ = licence_words(part, index.vocabulary)
                at = np.flatnonzero(ids >= 0)
                table += np.bincount(np.unique(row[at] * size + ids[at]) % size, minlength=size)
                table[-1] += part.num_rows
        yield from table_blocks(table)

    total = gather_table(docs.select(F.col(text).alias("text")).mapInArrow(count, BLOCK_SCHEMA), size)
    return total[:-1], int(total[-1])


def slack_of(length: int) -> int:
    """How far a template's words may stand from their places."""
    return max(2, length // 20)


def negated(ids: np.ndarray, row: np.ndarray, place: int, index: LicenseIndex) -> bool:
    """Whether a negation is among the words before this one."""
    before = slice(max(0, place - NEGATED), place)
    return bool(np.isin(ids[before][row[before] == row[place]], index.negations).any())


def matches(ids: np.ndarray, row: np.ndarray, index: LicenseIndex, rare: np.ndarray, least: float):
    """(row, label, share of the template's words that stand about where they should) of each verified start."""
    at = np.flatnonzero(ids >= 0)
    at = at[rare[ids[at]]]
    votes: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for pos, word, r in zip(at.tolist(), ids[at].tolist(), row[at].tolist()):
        for template, where in index.postings.get(word, ()):
            votes[r, template][pos - where].add(word)
    out = []
    for (r, template), starts in votes.items():
        label, body, keys = index.templates[template]
        slack, needed = slack_of(len(body)), min(2, len({w for w in body.tolist() if rare[w]}))
        done = -slack
        for start in sorted(starts):
            if start < done:  # within the slack of a start that was verified: the same place
                continue
            near = set().union(*(starts[start + d] for d in range(-slack, slack + 1) if start + d in starts))
            if len(near) < needed:
                continue
            low, high = max(0, start - slack), max(0, min(len(ids), start + len(body) + slack))
            inside = np.where(row[low:high] == r, ids[low:high], -1)
            places = [phrase_places(inside, np.zeros(len(inside), np.int8), k) + low for k in keys]
            if len(body) <= NOTICE_WORDS:
                places = [[p for p in ps.tolist() if not negated(ids, row, p, index)] for ps in places]
            if not all(len(ps) for ps in places):
                continue
            padded = np.full(len(body) + 2 * slack, -1)
            padded[low - start + slack : low - start + slack + len(inside)] = inside
            share = float(np.mean(np.any([padded[d : d + len(body)] == body for d in range(2 * slack + 1)], axis=0)))
            if share >= least:
                out.append((r, label, share))
                done = start + slack
    return out


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", index: LicenseIndex | None = None, rare_share: float = 0.1, least: float = 0.6) -> DataFrame:
    """For each row: key, words, base places with the first and last start, base labels, all labels, score.

    A word is rare if at most `rare_share` of all documents hold it, or if it is the rarest of a mandatory phrase.
    score: 1.0 with a base place, else the highest share of a verified template, else 0.0.
    """
    bound_batches(docs.sparkSession)
    index = index or LicenseIndex.build()
    frequency, n = document_frequency(docs, index, text)
    rare = frequency <= rare_share * n
    for _, _, phrases in index.templates:
        for phrase in phrases:
            rare[phrase[np.argmin(frequency[phrase])]] = True
    shared = docs.sparkSession.sparkContext.broadcast((index, rare))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rare = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, row, n_words, first = licence_words(part, index.vocabulary)
                places, base = [], [set() for _ in range(part.num_rows)]
                for phrase, label in index.base:
                    found = phrase_places(ids, row, phrase)
                    places.append(found)
                    for r in np.unique(row[found]).tolist():
                        base[r].add(label)
                places = np.sort(np.concatenate(places))
                n_base = np.bincount(row[places], minlength=part.num_rows)
                low = np.full(part.num_rows, np.iinfo(np.int64).max)
                high = np.full(part.num_rows, -1)
                np.minimum.at(low, row[places], places - first[row[places]])
                np.maximum.at(high, row[places], places - first[row[places]])
                every, score = [set(b) for b in base], [1.0 if b else 0.0 for b in base]
                for r, label, share in matches(ids, row, index, rare, least):
                    every[r].add(label)
                    score[r] = max(score[r], share)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(n_base.astype(np.int64)),
                        pa.array(low, mask=none),
                        pa.array(high, mask=none),
                        pa.array([",".join(sorted(b)) for b in base], pa.string()),
                        pa.array([",".join(sorted(b)) for b in every], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = docs.select(F.col(key)).schema
    for part in RESULT.split(", "):
        schema = schema.add(*part.split(" "))
    return rows.mapInArrow(run, schema)
