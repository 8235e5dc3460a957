import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.llm.bpe import _Words, bpe, separator, whole_tokenizer
from kmerloom.llm.queries import op12_bpe
from kmerloom.llm.tokens import default_tokenizer
from kmerloom.llm.words import hashed_words


@pytest.fixture(scope="module")
def tokenizer():
    return whole_tokenizer(default_tokenizer())


def library(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=st.sampled_from("aAİßΣς é́  \n\t'sSt9٣<|endofx>🙂日"), max_size=60)))
def test_a_text_is_its_words_in_a_row(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    ids, decoded = library(tokenizer, text)
    words = [w for w in (library(tokenizer, w.decode()) for w in text.encode().split()) if w[0]]
    assert ids == [i for w in words for i in w[0]] and decoded == " ".join(w[1] for w in words)


@pytest.mark.parametrize("chunk_bytes", [1, 500, 16 << 20])
def test_against_the_library(spark, frame, odd_rows, tokenizer, chunk_bytes):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(["<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", " ", "x   y", "Don't 12,345 it's", "é ́", "İstanbul ΣΑΣ", "<| end"])]
    rows += [(200 + k, "the same copy of a text " * 9) for k in range(60)]
    got = sorted(((r["doc_id"], r["ids"], r["text"]) for r in bpe(frame(rows, clash=True).repartition(3), chunk_bytes=chunk_bytes).collect()), key=str)
    assert got == sorted(((i, *library(tokenizer, t)) for i, t in rows), key=str)


def test_no_rows(frame):
    assert bpe(frame([])).count() == 0


def test_digests(spark, tmp_path, frame, tokenizer):
    import hashlib

    rows = [(1, "Hello, wörld"), (2, None), (3, "a a a")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op12_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    want = [(i, library(tokenizer, t)) for i, t in rows]
    assert got == [(i, len(a), hashlib.sha256(" ".join(map(str, a)).encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()) for i, (a, b) in want]


def test_words_do_not_rest_on_hashes(monkeypatch):
    monkeypatch.setattr("kmerloom.llm.bpe.hashed_words", lambda *a, **o: (hashed_words(*a, **o)[0] & np.uint64(1), *hashed_words(*a, **o)[1:]))
    words = _Words()
    for rows in (["b a b", None, "c longer-than-eight a"], ["c d"]):
        places, first = words.of(pa.array(rows, pa.string()))
        known = list(words.places)
        assert [[known[k].decode() for k in places[a:b]] for a, b in zip(first[:-1], first[1:])] == [(t or "").split() for t in rows]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        separator(whole_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
