"""Token counts by offset-mapped attribution.

Each document is encoded once, whole; the byte spans of its tokens are joined as sorted intervals to the spans of
its sections (its lines, each with its line feed), and a token that crosses a boundary goes to one section by
an explicit rule. So the counts of a document's sections add up to the document's, which they would not if each
were encoded by itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept

RULES = ("first", "last", "most")
_encodings: dict[str, tuple] = kept("encodings")


def default_ranks() -> tuple[str, str]:
    """The file of ranks and the pattern that cuts a text before merging."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoding(path: str, pattern: str) -> tuple:
    """The encoding, and each token's length in bytes."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            width[rank] = len(token)
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width
    return _encodings[path]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses) of tokens that cover bytes starts to ends, with sections from bounds[k] to bounds[k + 1].

    A crossing token goes to the section of its first byte ("first"), of its last byte ("last"), or to the one that
    holds most of its bytes, the earliest of several ("most").
    """
    a = np.searchsorted(bounds, starts, "right") - 1
    b = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "first":
        return a, a != b
    if rule == "last":
        return b, a != b
    best = a.copy()
    for k in np.flatnonzero(a != b):
        held = [min(ends[k], bounds[j + 1]) - max(starts[k], bounds[j]) for j in range(a[k], b[k] + 1)]
        best[k] = a[k] + int(np.argmax(held))
    return best, a != b


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row per section: id, section, start, end, n_tokens, n_crossing, doc_tokens, doc_sections.

    Sections are the lines, counted from 0, each with its line feed; start and end are in code points, end
    exclusive. n_crossing counts the section's tokens that reach beyond it. A null or empty text has one empty section
    without tokens; a text that ends in a line feed has no further section after it. Null ids stay null, repeated rows have rows each,
    an empty table gives an empty result; other columns are not read. Whole texts, one pass, no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, cut = (ranks, pattern) if ranks and pattern else default_ranks()
    names = ["section", "start", "end", "n_tokens", "n_crossing", "doc_tokens", "doc_sections"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, width = _encoding(path, cut)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                source, columns = [], []
                for k, value in enumerate(some.column(1)):
                    text = value.as_py() or ""
                    data = np.frombuffer(text.encode(), np.uint8)
                    ends = np.cumsum(width[np.array(encoding.encode_ordinary(text), np.int64)])
                    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
                    inner = np.flatnonzero(data == 10) + 1
                    bounds = np.concatenate([[0], inner[inner < len(data)], [len(data)]]).astype(np.int64)
                    n = len(bounds) - 1
                    section, crosses = attribute(starts, ends, bounds, rule)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                    source.append(np.full(n, k))
                    columns.append([np.arange(n), chars[:-1], chars[1:], np.bincount(section, minlength=n), np.bincount(section[crosses], minlength=n), np.full(n, len(ends)), np.full(n, n)])
                if columns:
                    ids = some.column(0).take(pa.array(np.concatenate(source)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*columns, strict=True))], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{c}` long" for c in names))
