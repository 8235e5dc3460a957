import pyarrow as pa
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm.common import kept, lean_memory
from kmerloom.llm.tally import packed, packed_keys, ranges_of, tallied, unpacked, unpacked_keys
from kmerloom.llm.tokens import WordEncoder, default_tokenizer
from kmerloom.llm.words import hashed_words, parts_of

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbB \n\t é🙂.'<|"), max_size=40), st.text(max_size=30)), max_size=8)


def clean(rows):
    return [None if t is None else t.encode("utf-8", "ignore").decode() for t in rows]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_tokenizer(), most=200)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(0, 2**63))
def test_words_and_hashes(rows, seed):
    rows = clean(rows) + ["x" * 300 + " " + "X" * 300 + " " + "x" * 301, "abcdefgh abcdefghi ABCDEFGH"]
    hashes, starts, ends, first, data = hashed_words(pa.array(rows, pa.string()), seed=seed)
    want = [(t or "").encode().lower().split() for t in rows]
    assert [[bytes(data[a:b]).lower() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])] == want
    seen = {}
    for w, h in zip((w for ws in want for w in ws), hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert (hashes == hashed_words(pa.array(rows, pa.string()), seed=seed)[0]).all()


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [64, 250, 1024, 2048])
def test_words_that_share_polynomials_do_not_share_hashes(encoder, n):
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    hashes = hashed_words(pa.array([f"{one} {other}"]))[0]
    assert hashes[0] != hashes[1]
    ids, bounds = encoder.encode(pa.array([one, other]))
    for k, t in enumerate((one, other)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_do_not_rest_on_hashes(monkeypatch):
    def few(*args, **options):
        hashes, *rest = hashed_words(*args, **options)
        return hashes & np.uint64(7), *rest

    monkeypatch.setattr("kmerloom.llm.tokens.hashed_words", few)
    encoder = WordEncoder(default_tokenizer())
    for rows in (["cat dog horse"], ["cow cat", "sheep, goat's dog", None, ""], ["ox ox", "longer-words-than-eight cat hen"]):
        ids, bounds = encoder.encode(pa.array(rows, pa.string()))
        for k, t in enumerate(rows):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


@given(texts, st.integers(1, 60))
def test_parts_of_a_batch(rows, most):
    rows = clean(rows)
    table = pa.table([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["k", "t"])
    parts = list(parts_of(table, 1, most))
    assert [x for p in parts for x in p.column(1).to_pylist()] == rows
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= most for p in parts)


@settings(max_examples=150, deadline=None)
@given(rows=texts)
def test_ids_are_the_tokenizers(encoder, rows):
    rows = clean(rows) + ["<|endoftext|> x", "It's WE'LL 12.5,x ÀÉ é ﬁ"]
    ids, bounds = encoder.encode(pa.array(rows, pa.string()), 1)
    for k, t in enumerate(rows):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


@given(st.lists(st.integers(0, 2**64 - 1)), st.integers(1, 9))
def test_packing_of_keys(values, n):
    keys = np.unique(np.array(values, np.uint64))
    assert (unpacked_keys(packed_keys(keys)) == keys).all()
    counts = np.arange(len(keys), dtype=np.uint32)
    assert (unpacked(packed(counts), np.uint32) == counts).all()
    at = ranges_of(keys, n)
    assert at[0] == 0 and at[-1] == len(keys) and (np.diff(at) >= 0).all()


@pytest.mark.parametrize("chunks", [1, 5, 17])
def test_tally_counts_everything(frame, chunks):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 9))) for i in range(120)] + [(None, None), (3, "w1")]

    def keys_of(table):
        words = [w for t in table.column("_text").to_pylist() for w in t.split()]
        return np.unique(np.array([hash(("k", int(w[1:]))) % (1 << 64) for w in words], np.uint64), return_counts=True)

    def use(table, answers, everything):
        keys, _ = keys_of(table)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(answers.astype(np.int64)), *(pa.array([x] * len(keys)) for x in everything)], ["k", "c", "d", "o", "t"])

    got = {tuple(r) for r in tallied(frame(rows), "doc_id", "text", chunks, keys_of, use, "k long, c long, d long, o long, t long").collect()}
    from collections import Counter

    want = Counter(w for _, t in rows for w in (t or "").split())
    assert sorted(x[1] for x in got) == sorted(want.values())
    assert {x[2:] for x in got} == {(len(want), list(want.values()).count(1), sum(want.values()))}


def test_tally_counts_beyond_32_bits(frame):
    most = (1 << 32) - 1

    def use(table, answers, everything):
        return pa.table([pa.array(answers.astype(np.int64)), pa.array([everything[2]])], ["c", "t"])

    rows = [(i, f"text {i}") for i in range(40)]
    got = tallied(frame(rows), "doc_id", "text", 5, lambda table: (np.array([7], np.uint64), np.array([most])), use, "c long, t long").collect()
    assert len(got) > 1 and {(r["c"], r["t"]) for r in got} == {(most * len(got),) * 2}


def test_workers_keep_only_what_the_present_operator_uses():
    own, other = kept("own"), kept("other")
    own["a"], other["b"] = 1, 2
    lean_memory()
    assert own and other
    lean_memory("own")
    assert own == {"a": 1} and other == {}
    lean_memory("")
    assert own == {} and kept("own") is own
