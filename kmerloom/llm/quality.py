"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes for keeping it (+1), against (-1), or abstains (0).
Expectation-maximisation over all documents' vote patterns estimates how often each rule gives each vote on
good texts and on several kinds of bad ones, and the posterior probability of being good replaces an all-must-pass filter. The
driver sees only the counts of vote patterns, of which there are at most 3 to the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch

SYMBOLS = b"#*$%&|<>"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters", "n_symbol_words", "n_marks", "n_stutters")
RULES = ("length", "word_length", "symbols", "symbol_words", "dup_lines", "repeats", "case", "letters", "line_ends", "marks", "stutters")
_AS_ONE = bytes(35 if b in SYMBOLS else b for b in range(256))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of size words that occurs at least twice in the text, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            window = (window ^ (window >> np.uint64(29))) * np.uint64(_ODD[0]) + h[k : k + n] * np.uint64(_ODD[k % 5])
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The COUNTS of a text; words are runs without the six ASCII white-space characters, as they stand."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[str] = set()
    dup = lines = ended = 0
    for line in text.split("\n"):
        if bare := line.strip(WHITESPACE):
            lines += 1
            ended += bare[-1] in ".!?:;\"'”。"
            dup += line in seen
            seen.add(line)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (
        len(words),
        len(text) - sum(map(text.count, WHITESPACE)),
        symbols,
        dup,
        repeated_words(words),
        lines,
        ended,
        upper,
        letters,
        sum(b"#" in w for w in data.translate(_AS_ONE).split()) if symbols else 0,
        text.count("!") + text.count("?"),
        sum(map(eq, words, words[1:])),
    )


def votes(c: tuple[int, ...]) -> tuple[int, ...]:
    """The RULES' votes on a text with these COUNTS."""
    n, chars, symbols, dup, repeat, lines, ended, upper, letters, symbol_words, marks, stutters = c

    def vote(good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0

    mean = chars / n if n else 0
    return (
        vote(n >= 30, n < 10),
        vote(3 <= mean <= 9, mean < 2 or mean > 14),
        vote(symbols * 100 <= n, symbols * 10 > n),
        vote(symbol_words * 100 <= n, symbol_words * 10 > n),
        vote(dup == 0, dup >= 3 and dup * 10 > lines * 3),
        vote(n >= 10 and repeat * 100 <= n * 10, repeat * 100 > n * 20),
        vote(upper * 10 <= letters * 2 and letters > 0, upper * 10 > letters * 4),
        vote(letters * 10 >= chars * 9 and n > 0, letters * 10 < chars * 8),
        vote(ended * 2 >= lines and lines > 0, ended * 10 < lines),
        vote(marks * 20 <= n, marks * 5 > n),
        vote(stutters * 50 <= n, stutters * 5 > n),
    )


def pattern_of(v: tuple[int, ...]) -> int:
    """Votes as one number in base 3."""
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


#: Kinds of bad texts that the label model tells apart, by the rules that mark them; a text is good if it is of none.
BAD_KINDS = (("symbols", "symbol_words", "letters"), ("case", "marks"), ("repeats", "stutters", "dup_lines"), ("length", "word_length", "line_ends"))


def fit(patterns: dict[int, int], rules: Sequence[str] = RULES, kinds: Sequence[Sequence[str]] = BAD_KINDS, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: the shares of the classes (bad kinds, then good), and p[class, rule, vote + 1].

    It starts from rules that are mostly right about their own kind, and that start stays as a prior worth a fiftieth of the texts, so
    that a rule that seldom or never speaks keeps its sense, and each class its meaning.
    """
    codes = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[int(c)] for c in codes], float)
    v = unpacked_votes(codes, len(rules))
    p = np.array([[[0.75, 0.15, 0.1] if r in kind else [0.2, 0.2, 0.6] for r in rules] for kind in kinds] + [[[0.05, 0.15, 0.8]] * len(rules)])
    share = np.array([0.2 / len(kinds)] * len(kinds) + [0.8])
    prior, hot = p * (weight.sum() / 50 + 1), np.eye(3)[v]
    for _ in range(rounds):
        of = responsibilities(v, share, p)
        new = np.einsum("i,ic,irv->crv", weight, of, hot) + prior
        new /= new.sum(2, keepdims=True)
        share_new = np.clip((weight @ of) / max(weight.sum(), 1), 0.002, None)
        share_new /= share_new.sum()
        moved = max(float(np.abs(share_new - share).max()), float(np.abs(new - p).max()))
        share, p = share_new, new
        if moved < 1e-9:
            break
    return share, p


def unpacked_votes(codes: np.ndarray, n_rules: int) -> np.ndarray:
    """Votes (0, 1, 2 for against, abstain, for) of pattern codes."""
    return np.stack([(codes // 3 ** (n_rules - 1 - k)) % 3 for k in range(n_rules)], 1)


def responsibilities(v: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(class) of vote rows v."""
    logs = np.log(p)[:, np.arange(v.shape[1]), v].sum(2).T + np.log(share)
    logs -= logs.max(1, keepdims=True)
    out = np.exp(logs)
    return out / out.sum(1, keepdims=True)


def posterior(v: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(good) of vote rows v."""
    return responsibilities(v, share, p)[:, -1]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per input row: id, the COUNTS, base_failed, kept, quality (the posterior).

    base_failed: under 10 words, or over 20 % of words in repeated 5-word windows; such rows are not kept. A
    null text is the empty text (no words: base_failed). A null id stays null, repeated rows count each, an
    empty table gives an empty result; other columns are not read. The texts are read once, whole, without a
    shuffle; the counts are then written, and the posterior is looked up by vote pattern.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(text.as_py() or "") for text in batch.column(1)]
            arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            pattern = pa.array([pattern_of(votes(r)) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pattern], names=[id_col, *COUNTS, "_pattern"])

    scratch = Scratch(docs.sparkSession, "quality")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", _pattern int"
    counted = scratch.save(docs.select(id_col, text_col).mapInArrow(run, schema), "counts")
    patterns = {r["_pattern"]: r["count"] for r in counted.groupBy("_pattern").count().collect()}  # at most 3^11
    share, p = fit(patterns)
    codes = np.array(sorted(patterns), np.int64)
    v = unpacked_votes(codes, len(RULES))
    table = docs.sparkSession.createDataFrame([(int(c), float(q)) for c, q in zip(codes, posterior(v, share, p), strict=True)], "_pattern int, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        counted.join(F.broadcast(table), "_pattern")  # at most 3^11 rows
        .select(id_col, *COUNTS, failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")
    )
