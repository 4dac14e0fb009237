"""License scans: matching statistics against a generalised suffix automaton of licence tokens, long matches chained to spans."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontamination import words_of

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Opening passages of well-known licence texts and notices, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


class SuffixAutomaton:
    """Of several token sequences: each state stands for the substrings that end at the same places of the sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: of each state, one (sequence, end) where its substrings end
        self.place: list[tuple[int, int]] = [(-1, 0)]
        #: the state of each whole sequence
        self.whole: list[int] = []
        for k, tokens in enumerate(sequences):
            last = 0
            for end, token in enumerate(tokens, 1):
                last = self._extend(last, token, (k, end))
            self.whole.append(last)

    def _state(self, length: int, place: tuple[int, int], moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.place.append(place)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.place[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, place: tuple[int, int]) -> int:
        if (q := self.next[last].get(token)) is not None:  # an earlier sequence has this substring
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, place, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new


class LicenseIndex:
    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        sequences = [words_of(p.encode()) for p, _ in phrases] + [words_of(t.encode()) for _, t in templates]
        self.labels = [x for _, x in phrases] + [x for x, _ in templates]
        self.n_phrases = len(phrases)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.tokens = [[self.vocabulary[w] for w in s] for s in sequences]
        self.automaton = a = SuffixAutomaton(self.tokens)
        #: by state: (length, phrase) of the phrases that end wherever its substrings do
        own = defaultdict(list)
        for p in range(self.n_phrases):
            own[a.whole[p]].append((len(self.tokens[p]), p))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for v in sorted(range(len(a.next)), key=a.length.__getitem__):
            self.ends[v] = own[v] + (self.ends[a.link[v]] if a.link[v] >= 0 else [])

    def scan(self, words: list[bytes], min_match: int, max_gap: int, coverage: float) -> tuple[list, list]:
        """(phrases as (start, phrase), spans as (start, end, template, share of the template covered))."""
        a, vocabulary = self.automaton, self.vocabulary
        found, matches = [], []
        state = length = 0
        previous = -2
        moves, links, lengths, ends = a.next, a.link, a.length, self.ends
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != previous + 1:
                if length >= min_match:
                    matches.append((previous, length, state))
                state = length = 0
            token = vocabulary[words[i]]
            if token not in moves[state] and length >= min_match:
                matches.append((previous, length, state))
            while token not in moves[state]:
                state = links[state]
                length = lengths[state]
            state = moves[state][token]
            length += 1
            previous = i
            if ends[state]:
                found += [(i - n + 1, p) for n, p in ends[state] if n <= length]
        if length >= min_match:
            matches.append((previous, length, state))
        return found, self._chain(words, matches, max_gap, coverage)

    def _chain(self, words: list[bytes], matches: list[tuple[int, int, int]], max_gap: int, coverage: float) -> list[tuple[int, int, int, float]]:
        """Spans where matches follow each other in one template's order with gaps of at most max_gap words."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for last, n, _ in matches:
            run = [self.vocabulary[w] for w in words[last - n + 1 : last + 1]]
            for k in range(self.n_phrases, len(self.tokens)):
                t = self.tokens[k]
                by_template[k] += [(last - n + 1, at, n) for at in range(len(t) - n + 1) if t[at] == run[0] and t[at : at + n] == run]
        spans = []
        for k, parts in by_template.items():
            chain: list[tuple[int, int, int]] = []
            for part in [*sorted(parts), None]:
                if part and chain and 0 < (over := chain[-1][0] + chain[-1][2] - part[0]) < part[2]:
                    part = (part[0] + over, part[1] + over, part[2] - over)
                if part and chain and 0 <= part[1] - (chain[-1][1] + chain[-1][2]) <= max_gap and 0 <= part[0] - (chain[-1][0] + chain[-1][2]) <= max_gap:
                    chain.append(part)
                    continue
                if chain and (share := sum(n for *_, n in chain) / len(self.tokens[k])) >= coverage:
                    spans.append((chain[0][0], chain[-1][0] + chain[-1][2], k, share))
                chain = [part] if part else []
        return sorted(spans)


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])))]
)


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None, min_match: int = 5, max_gap: int = 8,
                  coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every document.

    The automaton holds the phrases and the templates. One walk over a text gives each word's longest match with any of
    them; a phrase is found wherever it is a suffix of that match, and matches of min_match words or more are chained, in a
    template's order and over gaps of at most max_gap words, to spans. A span that covers at least `coverage` of its template
    adds the template's label. score: 1 with a phrase, else the largest covered share of a span, else 0.

    Words are A-Z lower-cased runs of 0-9, a-z and all characters above 0x7F. Null or empty texts have no words, null places,
    empty labels and score 0. Repeated rows and ids each get a row, texts are scanned whole, an empty table gives an empty
    table; phrases that overlap are all counted. Other columns are not read.
    """
    index = LicenseIndex(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    rows = common.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def one(text: bytes) -> tuple:
        words = words_of(text)
        found, spans = index.scan(words, min_match, max_gap, coverage)
        base = {index.labels[p] for _, p in found}
        more = base | {index.labels[k] for _, _, k, _ in spans}
        starts = [i for i, _ in found]
        score = 1.0 if found else min(1.0, max((x[3] for x in spans), default=0.0))
        listed = [{"start": s, "end": e, "label": index.labels[k], "covered": c} for s, e, k, c in spans]
        return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), score, listed

    def run(batches):
        for batch in batches:
            for start, texts in common.byte_column(batch, "text"):
                columns = zip(*map(one, texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *(pa.array(c, OUT.field(k + 1).type) for k, c in enumerate(columns))], schema=OUT)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,covered:double>>")
