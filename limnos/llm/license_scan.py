"""License scan: named licenses, and notices found by a set-similarity join.

Two parts read each text's words.  Phrases that name a license are matched word
by word.  Blocks of words (half-overlapping, twice as long as the notice they
are compared with) are joined with the notices: a block meets a notice when it
holds at least ``containment`` of the notice's distinct words.

The join is exact and filtered.  The notices' words are ordered by their
frequency in the whole corpus, rarest first, which one pass counts.  A block
that meets a notice of t words in at least o of them shares one of the notice's
first t - o + 1 words (prefix filter); it has at least o of the notices' words
(length filter); and the first shared word stands far enough from the end of
both ordered lists (positional filter).  What is left is counted.

The notices are a parameter of bounded size; only counts of their words are
gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm import ragged as R
from limnos.llm.common import by_batch, by_partition, id_text

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening passages of public license texts.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the Software), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
              "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
           "option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
           "list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
           "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of "
             "this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
}
CONTAINMENT = 0.8

_WORD = np.zeros(256, bool)
_WORD[48:58] = True
_WORD[97:123] = True
_WORD[128:] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each row's first."""
    data, off = R.buffers(texts)
    data = R.LOWER[data]
    starts, ends, first = R.spans(_WORD[data], off)
    return R.span_hash(R.prefix(data), starts, ends), first


def word_list(text: str) -> np.ndarray:
    return words(pa.array([text]))[0]


class Notices:
    """The notices' words in frequency order, and where their prefixes lie."""

    def __init__(self, notices: dict[str, str], frequency: dict[int, int], containment: float):
        vocabulary = np.unique(np.concatenate([word_list(t) for t in notices.values()]))
        count = np.asarray([frequency.get(int(h), 0) for h in vocabulary.view(np.int64)])
        self.hashes = vocabulary
        self.rank = np.empty(len(vocabulary), np.int64)
        self.rank[np.lexsort((vocabulary, count))] = np.arange(len(vocabulary))
        self.items = []
        for label, text in notices.items():
            own = word_list(text)
            order = np.sort(self.ranks(np.unique(own)))
            need = max(1, math.ceil(containment * len(order) - 1e-9))
            self.items.append((label, order, need, len(own), np.isin(np.arange(len(vocabulary)), order[: len(order) - need + 1])))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word; -1 for words that no notice has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1)

    def blocks(self, ranks: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, str, float]]:
        """(row, first word, end, label, containment) of the blocks that meet a
        notice."""
        out = []
        known = np.flatnonzero(ranks >= 0)
        for label, order, need, size, prefix in self.items:
            hit = known[prefix[ranks[known]]]
            row = np.searchsorted(first, hit, "right") - 1
            place = (hit - first[row]) // size
            both = np.unique(np.stack([np.tile(row, 2), np.concatenate([place, place - 1])], 1), axis=0)
            for r, k in both[both[:, 1] >= 0]:
                a = first[r] + k * size
                z = min(a + 2 * size, first[r + 1])
                block = np.unique(ranks[a:z])
                block = block[block >= 0]
                if len(block) < need:
                    continue
                shared = np.flatnonzero(np.isin(order, block, assume_unique=True))
                if not len(shared) or shared[0] > len(order) - need or np.searchsorted(block, order[shared[0]]) > len(block) - need:
                    continue
                if len(shared) >= need:
                    out.append((int(r), int(a - first[r]), int(z - first[r]), label, len(shared) / len(order)))
        return out


def word_frequency(texts: DataFrame, notices: dict[str, str]) -> dict[int, int]:
    """Occurrences in all texts of each word that a notice has."""
    vocabulary = np.unique(np.concatenate([word_list(t) for t in notices.values()]))

    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for x, y in R.slices(b.column(0)):
                h, _ = words(b.column(0).slice(x, y - x))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])
    counted = by_partition(texts, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
         notices: dict[str, str] = NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, blocks for each row of ``docs``.

    n_base counts the places where a phrase stands, first_word and last_word are
    the smallest and largest of their word numbers (null without one).  blocks
    holds the blocks that meet a notice: start, stop (word numbers), label,
    containment.  score is 1 where a phrase stands, else the highest
    containment found, else 0.  A null or empty text has no words; repeated
    rows and null ids are scanned like any other; an empty table gives no rows."""
    rows = id_text(docs, id_col, text_col)
    held = Notices(notices, word_frequency(rows.select("text"), notices), containment)
    wanted = [(word_list(p), label) for p, label in phrases.items()]
    block = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(b):
        for x, y in R.slices(b.column(1)):
            h, first = words(b.column(1).slice(x, y - x))
            n = y - x
            n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base = [set() for _ in range(n)]
            for parts, label in wanted:
                ok = np.ones(max(len(h) - len(parts) + 1, 0), bool)
                for k, p in enumerate(parts):
                    ok &= h[k: k + len(ok)] == p
                at = np.flatnonzero(ok)
                row = np.searchsorted(first, at, "right") - 1
                inside = at + len(parts) <= first[row + 1]
                at, row = at[inside], row[inside]
                np.add.at(n_base, row, 1)
                np.minimum.at(low, row, at - first[row])
                np.maximum.at(high, row, at - first[row])
                for r in set(row.tolist()):
                    base[r].add(label)
            found: list[list] = [[] for _ in range(n)]
            for r, start, stop, label, share in held.blocks(held.ranks(h), first):
                found[r].append({"start": start, "stop": stop, "label": label, "containment": share})
            score = [1.0 if base[r] else max((f["containment"] for f in found[r]), default=0.0) for r in range(n)]
            labels = [",".join(sorted(base[r] | {f["label"] for f in found[r]})) for r in range(n)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(x, n), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=n_base == 0),
                 pa.array(high, mask=n_base == 0), pa.array([",".join(sorted(s)) for s in base], pa.string()),
                 pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(found, block)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
    return by_batch(rows, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                               "labels string, score double, blocks array<struct<start: int, stop: int, label: string, containment: double>>")
