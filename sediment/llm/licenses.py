"""Licence scans with a positional rare-token index.

The index is made from the notices below: for every word its inverse document frequency among them
and its postings (notice, position). A file is looked up by the highest-IDF notice words it holds;
each occurrence votes, with the word's IDF, for (notice, file position - notice position), and a notice
is a candidate where one relative position gathers enough of the IDF of its rare words, each word
counted once. A candidate counts only if all its mandatory key phrases stand in the file. Its score is
the share of the notice's words found in place: each within ``slack`` words of its position.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from sediment.llm.common import arrow_map
from sediment.llm.decontam import words_of

#: Base phrases and their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices: label, text, mandatory key phrases. Fixed values (the standard notices' own words).
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge",)),
    ("mit", "This file is released under the MIT License", ("mit license",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license",)),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("without warranties or conditions of any kind",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, CC0 1.0 Universal", ("waived all copyright and related or neighboring rights",)),
)


class LicenceIndex:
    """Postings by relative position over notices' rare words."""

    def __init__(self, notices=NOTICES, phrases=PHRASES, rare: int = 8, slack: int = 3, least: float = 0.6):
        """``rare`` words of highest IDF a notice, offsets that differ by up to ``slack`` vote together."""
        self.slack, self.least = slack, least
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.notices = [(label, words_of(text.encode()), [tuple(words_of(k.encode())) for k in keys]) for label, text, keys in notices]
        df = Counter(w for _, words, _ in self.notices for w in set(words))
        self.idf = {w: math.log((1 + len(self.notices)) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for k, (_, words, _) in enumerate(self.notices):
            best = sorted(set(words), key=lambda w: (-self.idf[w], w))[:rare]
            self.need.append(sum(self.idf[w] for w in best))
            for i, w in enumerate(words):
                if w in best:
                    self.postings[w].append((k, i))
        #: A file without any of these has neither phrase nor candidate notice.
        self.gates = {p[-1] for p, _ in self.phrases} | {max(keys[0], key=lambda w: (self.idf.get(w, 0), w)) for _, _, keys in self.notices}

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of every place where a base phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            last, n = phrase[-1], len(phrase)
            i = -1
            try:
                while True:
                    i = words.index(last, i + 1)
                    if i + 1 >= n and tuple(words[i + 1 - n : i + 1]) == phrase:
                        out.append((i + 1 - n, label))
            except ValueError:
                pass
        return sorted(out)

    def matches(self, words: list[bytes]) -> list[tuple[str, float, int]]:
        """(label, score, start) of each notice that passes votes and key phrases; best place each."""
        votes: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        exact: dict[int, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for i, w in enumerate(words):
            for k, j in self.postings.get(w, ()):
                votes[k][(i - j) // (self.slack + 1)].add(w)
                exact[k][(i - j) // (self.slack + 1)][i - j] += 1
        out = []
        for k, bins in votes.items():
            label, notice, keys = self.notices[k]
            good = [o for o in bins if sum(self.idf[w] for w in bins[o] | bins.get(o + 1, set())) >= self.least * self.need[k]]
            if good and all(self._has(words, key) for key in keys):
                starts = [min(exact[k][o], key=lambda s: (-exact[k][o][s], s)) for o in good]
                best = max((self._in_place(words, notice, s), -s) for s in starts)
                if best[0] >= self.least:
                    out.append((label, best[0], max(0, -best[1])))
        return out

    @staticmethod
    def _has(words: list[bytes], key: tuple[bytes, ...]) -> bool:
        i = -1
        try:
            while True:
                i = words.index(key[0], i + 1)
                if tuple(words[i : i + len(key)]) == key:
                    return True
        except ValueError:
            return False

    def _in_place(self, words: list[bytes], notice: list[bytes], start: int) -> float:
        """Share of the notice's words that the file has within ``slack`` words of their place."""
        near = (words[max(0, start + j - self.slack) : max(0, start + j + self.slack + 1)] for j in range(len(notice)))
        return sum(w in part for w, part in zip(notice, near, strict=True)) / len(notice)


def licence_scan(docs: DataFrame, index: LicenceIndex | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices).

    ``labels`` joins the labels of base phrases and of matched notices; ``score`` is the best notice's
    score, or 0.5 where only a base phrase stands, else 0. A null or empty text has no words, null
    places and empty labels; repeated rows are reported each; long texts are read whole; of equal places
    the first counts; extra columns are not read; an empty table gives an empty one.
    """
    made = index or LicenceIndex()

    def run(cols: dict, n: int) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")}
        gates = made.gates
        for text in cols["text"]:
            words = words_of(text or b"")
            if gates.isdisjoint(words):
                row = (len(words), 0, None, None, "", "", 0.0, "")
            else:
                places, found = made.places(words), made.matches(words)
                base = {label for _, label in places}
                score = max([m[1] for m in found], default=0.5 if places else 0.0)
                row = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {m[0] for m in found})), score, ",".join(f"{m[0]}:{m[2]}:{m[1]:.3f}" for m in sorted(found)))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": cols["doc_id"]} | out

    schema = "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double,notices string"
    return arrow_map(docs.select("doc_id", "text"), run, schema, binary=("text",))
