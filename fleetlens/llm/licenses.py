"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text_hash import WORDS, mix, shingles, stride

WORDS_PER_SHINGLE = 5
BANDS = 64  # of one minimum each
NUM, DEN = 80, 100  # share of a template's shingles that a match holds
TEMPLATES = 10_000  # more templates than this are refused, for every task holds them all
CHUNK = 400_000  # words looked at together
WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-'][\p{L}\p{N}]+)*")

# The wording of public licence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _shingles(text: str | None) -> np.ndarray:
    return shingles(WORDS.of(_words(text)), WORDS_PER_SHINGLE)


def _order(x: np.ndarray, band: int) -> np.ndarray:
    """The band's random order of shingles."""
    return mix(x + stride(band + 1))


@dataclass(frozen=True)
class Templates:
    """Shingle sets by name, grouped by stride: the power of two that is at least the set's size.

    ``minima[stride]`` holds, for each band, the sorted minima of the group's
    templates and the template of each.
    """

    names: list[str]
    sets: list[np.ndarray]
    minima: dict[int, list[tuple[np.ndarray, np.ndarray]]]

    @staticmethod
    def of(texts: dict[str, str]) -> Templates:
        if len(texts) > TEMPLATES:
            raise ValueError(f"more than {TEMPLATES} templates")
        names = [n for n in sorted(texts) if _words(texts[n])]
        sets = [np.unique(_shingles(texts[n])) for n in names]
        groups: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            groups.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        minima = {}
        for stride, members in groups.items():
            minima[stride] = []
            for band in range(BANDS):
                low = np.array([_order(sets[k], band).min() for k in members])
                order = np.argsort(low, kind="stable")
                minima[stride].append((low[order], np.array(members)[order]))
        return Templates(names, sets, minima)


def _retrieve(flat: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(stride, window, template) for which some band of the window has the template's minimum.

    Windows take two strides and start at every stride, so whatever is as long as
    a template lies in one. A match holds at least 0.8 of a template of more than
    half a stride, so its similarity to the window is at least 0.2 and all 64 bands
    miss it with a probability below 1e-6; for the longest of the group, 1e-14.
    """
    found: set[tuple[int, int, int]] = set()
    for band in range(BANDS):
        low, size = _order(flat, band), 1
        for stride in sorted(templates.minima):
            while size < stride:
                low = np.minimum(low[0::2], low[1::2])
                size *= 2
            window = np.minimum(low, np.append(low[1:], np.uint64(0xFFFFFFFFFFFFFFFF)))
            known, which = templates.minima[stride][band]
            low_bits = np.zeros(1 << 16, bool)
            low_bits[known & np.uint64(0xFFFF)] = True
            for w in np.flatnonzero(low_bits[window & np.uint64(0xFFFF)]):
                first, last = np.searchsorted(known, window[w], "left"), np.searchsorted(known, window[w], "right")
                found.update((stride, int(w), int(t)) for t in which[first:last])
    return found


def _scan(templates: Templates):
    longest = max(templates.minima, default=1)

    def matches(doc_ids: list, sets: list[np.ndarray]) -> list[tuple]:
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sets)
        padded = np.full(-(-len(flat) // longest) * longest, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(flat)] = flat
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for stride, w, t in sorted(_retrieve(padded, templates)):
            left, right = w * stride, min((w + 2) * stride, len(flat))
            # the window may reach over several documents; each is verified by itself
            first = int(np.searchsorted(starts, left, "right")) - 1
            for d in range(first, int(np.searchsorted(starts, right, "left"))):
                here = flat[max(left, starts[d]) : min(right, starts[d + 1])]
                inside = np.isin(here, templates.sets[t])
                common = len(np.unique(here[inside]))
                if common and DEN * common >= NUM * len(templates.sets[t]):
                    at = int(max(left, starts[d]) - starts[d] + inside.argmax())
                    old = best.get((d, t))
                    if old is None or (-common, at) < (-old[0], old[1]):
                        best[(d, t)] = (common, at)
        return [(doc_ids[d], templates.names[t], common / len(templates.sets[t]), at) for (d, t), (common, at) in sorted(best.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held, out = [], [], 0, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = _shingles(text.as_py())
                if len(s):
                    ids.append(doc_id)
                    sets.append(s)
                    held += len(s)
                if held >= CHUNK:
                    out += matches(ids, sets)
                    ids, sets, held = [], [], 0
            if held:
                out += matches(ids, sets)
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()))], ["doc_id", "license", "containment", "word"])

    return run


def scan_licenses(docs: DataFrame, texts: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word) for every document and template it holds.

    Words are runs of letters and digits (joined by single full stops, hyphens or
    apostrophes) in lower case. A template is held if one window has at least 0.8
    of the set of its 5-word shingles; ``containment`` is the largest share and ``word`` the
    first word number it was found at. A shorter template, or document, is one shingle.
    Null and empty texts hold nothing; a null id is carried; rows that
    share an id each give their rows. Templates without a word are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(Templates.of(texts)), "doc_id long, license string, containment double, word long")
