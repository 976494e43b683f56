"""License scans: phrases by their words, and an exact containment join of text blocks with license templates.

Words are digits, letters a-z (A-Z in lower case) and all characters beyond ASCII, in runs. A base phrase is found
wherever its words stand one after the other. A block is as many consecutive words of a text as the template has, across
lines; it matches a template if it holds ``share`` or more of the template's distinct words, and with them all words
that tell the template from its like (``2``, ``mit``, ``nc``).

The join is a set-similarity join with the templates as its small side (they are parameters, so their size is
bounded): the templates' words are put in one global order by their frequency over all texts, rarest first. A block
that reaches ``need = ceil(share * m)`` of a template's m words holds one of the first ``m - need + 1`` of them (prefix
filter), so only blocks around such words are looked at; where the rarest one that a text has stands at place i of the
order, no more than ``m - i`` words can be common (positional filter); and a text has ``need`` words at least (length
filter). A block may begin at one of the template's words: any other block holds no more than the one that begins at
its first such word. Blocks that are left are compared by the number of common words.

Words are 64-bit fingerprints.

Cases: a null, empty or wordless text has no words and no labels; rows, repeated or not, are scanned row by row; a
text without base phrases has null first and last words; labels are distinct, sorted and joined by commas, empty if
there are none; other columns are kept (one with a result's name is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.words import LETTERED, fingerprints, split_words, text_pieces

#: Phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Templates: a label, the wording it is known by, and the words that a block must have to be told from its like.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2.0", "You may not use this file except in compliance with the License", "compliance license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution permitted"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution 4"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc 4"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc sa 4"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived copyright"),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2", "gnu general 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee"),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "gnu lesser"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission charge"),
    ("mit", "Released under the MIT License", "mit"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    ("reserved", "Copyright, all rights reserved", "rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
]
SHARE = (4, 5)
FILTER_BITS = 1 << 18
RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

_U = np.uint64


def prints_of(phrase: str) -> list[int]:
    words = split_words([phrase.encode()], LETTERED)
    return fingerprints(words.data, words.start, words.end).tolist()


def need_of(size: int, share: tuple[int, int]) -> int:
    return -(-size * share[0] // share[1])


def word_counts(docs: DataFrame, text: str, wanted: np.ndarray) -> np.ndarray:
    """How often each of the given words (a bounded, sorted list) stands in all texts."""
    def count(batches):
        total = np.zeros(len(wanted), np.int64)
        for _, raw in text_pieces(batches, text):
            words = split_words(raw, LETTERED)
            at, number = _hits(wanted, fingerprints(words.data, words.start, words.end))
            total += np.bincount(number, minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(wanted))), pa.array(total)], names=["word", "n"])

    out = np.zeros(len(wanted), np.int64)
    for row in docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row.word] = row.n
    return out


def _hits(wanted: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are in the sorted list, and their numbers there."""
    bits = np.zeros(FILTER_BITS, bool)
    bits[(wanted & _U(FILTER_BITS - 1)).astype(np.int64)] = True
    near = np.flatnonzero(bits[(h & _U(FILTER_BITS - 1)).astype(np.int64)])
    if not len(near) or not len(wanted):
        return near[:0], near[:0]
    at = np.minimum(np.searchsorted(wanted, h[near]), len(wanted) - 1)
    same = wanted[at] == h[near]
    return near[same], at[same]


class Template(NamedTuple):
    """A template by the numbers of its words."""
    place: np.ndarray  # per wanted word, its place in the template's order of rarity, -1 if it has no such word
    must: np.ndarray  # words that a block has to have
    width: int  # words of a block
    size: int  # distinct words
    need: int

    @classmethod
    def of(cls, wording: list[int], must: list[int], counts: np.ndarray, share: tuple[int, int]) -> Template:
        place = np.full(len(counts), -1, np.int64)
        order = sorted(set(wording), key=lambda i: (counts[i], i))
        place[order] = np.arange(len(order))
        return cls(place, np.array(must, np.int64), len(wording), len(order), need_of(len(order), share))

    def matches(self, at: np.ndarray, word: np.ndarray, doc: np.ndarray, n_words: np.ndarray) -> list[tuple[int, float]]:
        """(text, greatest share) of the texts with a matching block; ``at``, ``word``: places of wanted words, rising."""
        own = self.place[word] >= 0
        at, word = at[own], word[own]
        rare = at[self.place[word] <= self.size - self.need]
        if not len(rare):
            return []
        # Blocks that begin at a word of the template and hold one of its prefix.
        near = np.searchsorted(rare, at)
        after = rare[np.minimum(near, len(rare) - 1)]
        start = np.flatnonzero((after >= at) & (after < at + self.width) & (doc[after] == doc[at]) & (n_words[doc[at]] >= self.need))
        if not len(start):
            return []
        slot = start[:, None] + np.arange(self.width)
        inside = slot < len(at)
        slot = np.minimum(slot, len(at) - 1)
        inside &= (at[slot] < at[start][:, None] + self.width) & (doc[at[slot]] == doc[at[start]][:, None])
        # The rarest word's place bounds what can be common.
        least = np.where(inside, self.place[word[slot]], self.size).min(1)
        start, slot, inside = (x[self.size - least >= self.need] for x in (start, slot, inside))
        held = np.zeros((len(start), self.size), bool)
        row, column = np.nonzero(inside)
        held[row, self.place[word[slot[row, column]]]] = True
        overlap = held.sum(1)
        must = self.place[self.must] if (self.must >= 0).all() else None
        hit = (overlap >= self.need) & (held[:, must].all(1) if must is not None else False)
        best: dict[int, float] = {}
        for d, n in zip(doc[at[start[hit]]].tolist(), overlap[hit].tolist()):
            best[d] = max(best.get(d, 0.0), n / self.size)
        return list(best.items())


def scan(docs: DataFrame, text: str = "text", base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score (the greatest share found)."""
    wordings = [prints_of(wording) for _, wording, _ in templates]
    wanted = np.unique(np.array([w for t in wordings for w in t], _U))
    number = {w: i for i, w in enumerate(wanted.tolist())}
    counts = word_counts(docs, text, wanted)
    known = [Template.of([number[w] for w in t], [number.get(w, -1) for w in prints_of(must)], counts, share) for t, (_, _, must) in zip(wordings, templates)]
    phrases = [prints_of(p) for p, _ in base]
    kept = docs.drop(*RESULT)
    names = kept.columns

    def run(batches):
        for part, raw in text_pieces(batches, text):
            texts = len(raw)
            words = split_words(raw, LETTERED)
            h = fingerprints(words.data, words.start, words.end)
            # Base phrases: every place.
            place, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, phrase in enumerate(phrases):
                at = np.flatnonzero(h[:len(h) - len(phrase) + 1] == _U(phrase[0])) if len(h) >= len(phrase) else place[0]
                for i, w in enumerate(phrase):
                    at = at[(h[at + i] == _U(w)) & (words.doc[at + i] == words.doc[at])]
                place.append(at), label.append(np.full(len(at), k))
            place, label = np.concatenate(place), np.concatenate(label)
            owner = words.doc[place]
            start = place - words.first[owner]
            n_base = np.bincount(owner, minlength=texts)
            first, last = np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
            np.minimum.at(first, owner, start)
            np.maximum.at(last, owner, start)
            found = [set() for _ in range(texts)]
            for d, k in set(zip(owner.tolist(), label.tolist())):
                found[d].add(base[k][1])
            own = [",".join(sorted(f)) for f in found]
            # Templates: blocks around words of their prefixes.
            score = np.zeros(texts)
            at, word = _hits(wanted, h)
            for k, t in enumerate(known):
                for d, best in t.matches(at, word, words.doc, np.diff(words.first)):
                    found[d].add(templates[k][0])
                    score[d] = max(score[d], best)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.diff(words.first)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(own, pa.string()),
                 pa.array([",".join(sorted(f)) for f in found], pa.string()), pa.array(score)], names=[*names, *RESULT])

    return kept.mapInArrow(run, kept.selectExpr("*", "0L AS n_words", "0L AS n_base", "0L AS first_word", "0L AS last_word", "'' AS base_labels", "'' AS labels", "0D AS score")
                           .selectExpr(*(f"`{n}`" for n in names), *(f"nullif({c}, NULL) AS {c}" for c in RESULT)).schema)


def scan_sql(base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES, share: tuple[int, int] = SHARE) -> str:
    """The same scan of ``documents`` as DuckDB SQL: every block of every text that has a template's telling words."""
    import re

    upper = "".join(map(chr, range(65, 91)))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def listed(phrase: str) -> list[str]:
        return re.findall("[0-9a-z]+", phrase.lower())

    def array(words) -> str:
        return "[" + ", ".join(repr(x) for x in words) + "]"

    places = " || ".join(
        f"[{{'at': i - 1, 'label': '{label}'}} FOR i IN range(1, len(w) - {len(listed(p)) - 2}) IF " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(listed(p))) + "]" for p, label in base)
    rows = ", ".join(f"('{label}', {array(sorted(set(listed(p))))}, {array(listed(m))}, {len(listed(p))}, {need_of(len(set(listed(p))), share)})" for label, p, m in templates)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
     p AS (SELECT doc_id, r, w, {places} AS places FROM (SELECT doc_id, r, regexp_extract_all(t, '{word}') AS w FROM d)),
     k(label, words, must, width, need) AS (VALUES {rows}),
     b AS (SELECT r, label, words, must, need, unnest([w[i:i + width - 1] FOR i IN range(1, len(w) + 1)]) AS block FROM p JOIN k ON list_has_all(p.w, k.must)),
     m AS (SELECT r, label, len(list_intersect(words, block)) / len(words) AS score FROM b WHERE list_has_all(block, must) AND len(list_intersect(words, block)) >= need),
     s AS (SELECT r, list(label) AS labels, max(score) AS score FROM m GROUP BY r)
SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
       CAST(list_min([x['at'] FOR x IN places]) AS BIGINT) AS first_word, CAST(list_max([x['at'] FOR x IN places]) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct([x['label'] FOR x IN places])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct([x['label'] FOR x IN places] || coalesce(s.labels, []))), ',') AS labels,
       CAST(coalesce(s.score, 0) AS DOUBLE) AS score
FROM p LEFT JOIN s ON p.r = s.r
"""
