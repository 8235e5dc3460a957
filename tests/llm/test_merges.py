import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from kmerloom.llm import tokens as T


def _texts():
    r = random.Random(3)
    letters, likely = "abcdefghijklmnopqrstuvwxyz", range(26, 0, -1)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkqjxz", likely, k=r.randint(1, 26))) + r.choice(["", "", ".", ",", "?", ":"]) for _ in range(20_000)]
    words += [r.choice(letters) * r.randint(1, 30) for _ in range(200)] + ["the", "thththth", "banana!", "a.b", "..", ".", "don't", "x1", "straße", "naïve.", "Ünter", "a" * 24 + ".", "a" * 25, "!a", "b" * 33, "x's", "'re", "***", "a.!!", "12ab3--4", "ÉÈÀÞ", "éÉß", "ÿ÷", "×a", "x²", "ĳα", "日", "e\u0301", "ª", "ǅ", "à" * 16, "Ã¤", "à***", "#$%&()*+,-./:;=>?@[]^_`{|}~"]
    words += ["".join(r.choices("aeiouéèäöüßÉÄñ1.!*", k=r.randint(1, 14))) for _ in range(5_000)]
    words += ["ab<|endoftext|>", "a<|"]
    return [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]


def test_words_get_the_tokenizers_ids(monkeypatch):
    """Ids of words merged side by side are those of the tokenizer, and few words are left to it."""
    encoder, left = T.WordEncoder(T.default_tokenizer()), []
    own = encoder._ids_of
    monkeypatch.setattr(encoder, "_ids_of", lambda words: left.extend(words) or own(words))
    texts = _texts()
    ids, bounds = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert left and all(len(w.encode()) > 32 or set(w) & set("'<²×÷ĳα日¤\u0301ªǅ") for w in left)


@pytest.mark.parametrize("name", ["sf0.001"])
def test_words_of_the_tables(name):
    import pyarrow.parquet as pq

    texts = pc.fill_null(pq.read_table(f"/root/testdata/{name}/documents.parquet", columns=["text"]).column("text"), "").combine_chunks()
    encoder = T.WordEncoder(T.default_tokenizer())
    ids, bounds = encoder.encode(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    assert np.array_equal(ids, [x for e in want for x in e]) and bounds.tolist() == np.cumsum([0, *map(len, want)]).tolist()
