import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kmerloom.llm.packing import pack
from kmerloom.llm.tokens import default_tokenizer


@pytest.mark.parametrize("length", [16, 2048])
def test_round_trip(frame, odd_rows, length):
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 6] * 1 + [(50 + k, "some words here " * k) for k in range(40)]
    got = pack(frame(rows, clash=True).repartition(3), length=length, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, _ in rows}
    for i, text in rows:
        want = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) == want.tobytes()
        at = 0
        for p in pieces:
            assert p["start"] == at and p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(want[at : at + p["length"]].tobytes())
            at += p["length"]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    full = {}
    for s, o, n in places:
        assert o == full.get(s, 0)
        full[s] = o + n
    assert sorted(full) == list(range(len(full))) and all(n == length for s, n in full.items() if s < len(full) - 1)


def test_nulls_repeats_and_no_rows(frame):
    got = pack(frame([(None, None), (1, "a"), (1, "a"), (2, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 1)]
    assert pack(frame([])).count() == 0
