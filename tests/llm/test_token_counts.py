import base64

import numpy as np
import pytest
import tiktoken

from kmerloom.llm.token_counts import attribute, default_ranks, token_counts


@pytest.fixture(scope="module")
def encoding():
    path, pattern = default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def naive(encoding, text, rule):
    """Byte by byte: (start, end, tokens, crossing) of each line."""
    lines = text.splitlines(keepends=True) if not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]] * bool(text.split("\n")[-1])
    lines = lines or [""]
    owner = [k for k, line in enumerate(lines) for _ in line.encode()]
    counts, crossing, at = [0] * len(lines), [0] * len(lines), 0
    for t in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(t))
        own = owner[at : at + n]
        k = own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)
        counts[k] += 1
        crossing[k] += own[0] != own[-1]
        at += n
    out, start = [], 0
    for k, line in enumerate(lines):
        out.append((start, start + len(line), counts[k], crossing[k]))
        start += len(line)
    return out


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_against_byte_by_byte(frame, odd_rows, encoding, rule):
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows)] + [(100, "a\n\n\n\n  b\n"), (101, "\n\n\n"), (102, "é\n🙂\n\n \n\nx")]
    got = {}
    for r in token_counts(frame(rows, clash=True), rule=rule).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        parts = sorted(got[i], key=lambda r: r["section"])
        assert [(r["start"], r["end"], r["n_tokens"], r["n_crossing"]) for r in parts] == naive(encoding, t or "", rule)
        assert {r["doc_tokens"] for r in parts} == {len(encoding.encode_ordinary(t or ""))} and {r["doc_sections"] for r in parts} == {len(parts)}


def test_rule_of_most():
    bounds = np.array([0, 3, 4, 10])
    section, crosses = attribute(np.array([0, 2, 2]), np.array([2, 4, 9]), bounds, "most")
    assert section.tolist() == [0, 0, 2] and crosses.tolist() == [False, True, True]


def test_bad_rule_and_no_rows(frame):
    with pytest.raises(ValueError):
        token_counts(frame([]), rule="half")
    assert token_counts(frame([])).count() == 0
