"""Lines of one shingle set have a sampling level in common, wherever they repeat themselves."""

import random

from fleetlens.llm.line_dedup import BANDS, _lines, _signatures, dedup_lines


def ruled():
    """Two lines without a repeated shingle but for a ruler of 88 or of 8 equal characters."""
    letters = [chr(0x4E00 + k) for k in range(190)]
    random.Random(5).shuffle(letters)
    head, tail = "".join(letters[:170]), "".join(letters[170:])
    return head + "-" * 88 + tail, head + "-" * 8 + tail


def test_ruler_beside_the_tested_spots(llm):
    long, short = ruled()
    docs = llm.createDataFrame([(1, long), (2, short)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in dedup_lines(docs).collect()} == {1: 0, 2: 1}
    bands = {d: set() for d in (1, 2)}
    for r in _signatures(_lines(docs)).collect():
        bands[r["doc_id"]] |= set(r["bands"])
    assert BANDS >= 12 and len(bands[1] & bands[2]) >= BANDS
