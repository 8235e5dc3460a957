"""K-mers of sequences: a vectorised Arrow kernel, and the same as plain columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.params import BASE_CODES, MIX_1, ONE_LIMB_K, SketchParams

_CODE = np.zeros(256, np.uint64)
_COMPLEMENT = np.zeros(256, np.uint64)
for _letter, _pair in zip("ACGT", "TGCA", strict=True):
    for _b in (ord(_letter), ord(_letter.lower())):
        _CODE[_b] = BASE_CODES[_letter]
        _COMPLEMENT[_b] = BASE_CODES[_pair]


def _joined(codes: np.ndarray, width: int, first_high: bool) -> np.ndarray:
    """Codes of all windows of width (at most 21) in 63 bits, put together from windows of powers of two."""
    powers = {1: codes}
    size = 1
    while size * 2 <= width:
        one = powers[size]
        a, b = one[: len(one) - size], one[size:]
        powers[size * 2] = a << np.uint64(3 * size) | b if first_high else a | b << np.uint64(3 * size)
        size *= 2
    out, have = powers[size], size
    for part in sorted((p for p in powers if (width - size) & p), reverse=True):
        n = len(codes) - have - part + 1
        a, b = out[:n], powers[part][have : have + n]
        out = a << np.uint64(3 * part) | b if first_high else a | b << np.uint64(3 * have)
        have += part
    return out


def _high_product(a: np.ndarray, m: int) -> np.ndarray:
    """The high 64 bits of a * m."""
    low, s = np.uint64(0xFFFFFFFF), np.uint64(32)
    a1, a0, m1, m0 = a >> s, a & low, np.uint64(m >> 32), np.uint64(m & 0xFFFFFFFF)
    mid = a1 * m0 + (a0 * m0 >> s)
    return a1 * m1 + (mid >> s) + ((mid & low) + a0 * m1 >> s)


def _codes_of(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code, complement): windows of k valid bases, and each base's code and that of its complement."""
    code = _CODE[data]
    bad = np.concatenate([[0], np.cumsum(code == 0)])
    return np.flatnonzero(bad[k:] == bad[:-k]) if len(data) >= k else np.zeros(0, np.int64), code, _COMPLEMENT[data]


def _squares(code: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The sum of squared base counts of each window."""
    squares = np.zeros(len(place), np.int32)
    for value in BASE_CODES.values():
        count = np.concatenate([[0], np.cumsum(code == value, dtype=np.int32)])
        n = count[place + k] - count[place]
        squares += n * n
    return squares


def hash_windows(data: np.ndarray, k: int, multiplier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, high, low, hash, simplicity) of every window of k valid bases in data (bytes), codes canonical in two limbs."""
    none = np.zeros(0, np.uint64)
    if len(data) < k:
        return np.zeros(0, np.int64), none, none, none, np.zeros(0, np.int32)
    place, code, other = _codes_of(data, k)
    if not len(place):
        return place, none, none, none, np.zeros(0, np.int32)
    one = np.uint64(1)
    if k <= ONE_LIMB_K:
        low = np.minimum(_joined(code, k, True)[place], _joined(other, k, False)[place])
        high = np.zeros_like(low)
    else:
        rest = k - ONE_LIMB_K  # the code is that of the first `rest` bases above the 63 bits of the last 21; reversed, the other way round

        def limbs(above: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return above >> one, above << np.uint64(63) | below

        fh, fl = limbs(_joined(code, rest, True)[place], _joined(code, ONE_LIMB_K, True)[place + rest])
        rh, rl = limbs(_joined(other, rest, False)[place + ONE_LIMB_K], _joined(other, ONE_LIMB_K, False)[place])
        forward = (fh < rh) | ((fh == rh) & (fl < rl))
        high, low = np.where(forward, fh, rh), np.where(forward, fl, rl)
    with np.errstate(over="ignore"):
        mixed = low ^ np.uint64(MIX_1)
        m = np.uint64(multiplier)
        hashed = mixed * m ^ (_high_product(mixed, multiplier) + high * m)
    return place, high, low, hashed, _squares(code, place, k)


#: Window starts of a piece.
CHUNK = 1 << 20


def chunked(seqs: DataFrame, name_col: str, seq_col: str, k: int, chunk: int = CHUNK) -> DataFrame:
    """(name, start, seq): sequences as bytes in pieces of chunk window starts, each k - 1 bytes longer, so that every window
    lies in exactly one piece. Records shorter than k go. Long records spread over tasks."""
    data = seqs.select(F.col(name_col).alias("name"), F.col(seq_col).cast("binary").alias("seq")).where(F.octet_length("seq") >= k)
    starts = F.sequence(F.lit(0).cast("long"), (F.octet_length("seq") - k).cast("long"), F.lit(chunk).cast("long"))
    cut = data.withColumn("start", F.explode(starts))
    return cut.select("name", "start", F.substring("seq", (F.col("start") + 1).cast("int"), F.lit(chunk + k - 1)).alias("seq"))


#: Bases that the kernel takes at once: its arrays of 8 bytes a base stay near the caches, and its memory does not grow with the rows of a batch.
BATCH_BASES = 1 << 18


def _slices(batch: pa.RecordBatch, bases: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, their bytes with a byte between rows, where each row begins) of a batch of (name, start, seq) in slices of so many bases, or of one row."""
    texts = batch.column(2)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + bases, "right")))
        sizes = np.diff(np.concatenate([[before], ends[at:upto]]))
        yield at, upto, np.frombuffer(b"\0".join(texts[i].as_buffer() for i in range(at, upto)), np.uint8), np.cumsum(sizes + 1) - sizes - 1
        at = upto


def kmers(
    seqs: DataFrame, params: SketchParams, name_col: str = "name", seq_col: str = "seq", codes: bool = False, batch_bases: int = BATCH_BASES
) -> DataFrame:
    """(name, hash, s) of every kept window: valid bases only, canonical, hash below the threshold (two's-complement long).

    codes adds (pos, code_high, code_low). The threshold is applied in the kernel, so of all windows only about
    one in scale leaves Python. No window spans two rows.
    """
    threshold, multiplier, k = np.uint64(params.threshold), params.multiplier, params.k
    limit = params.max_simplicity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, starts = batch.column(0), batch.column(1).to_numpy()
            for at, _, data, begins in _slices(batch, batch_bases):
                place, high, low, h, s = hash_windows(data, k, multiplier)
                keep = h < threshold
                if limit is not None:
                    keep &= s <= limit
                place, h, s = place[keep], h[keep], s[keep]
                row = np.searchsorted(begins, place, "right") - 1
                out = [names.take(pa.array(at + row)), pa.array(h.view(np.int64)), pa.array(s)]
                if codes:
                    out += [pa.array(starts[at + row] + place - begins[row]), pa.array(high[keep].view(np.int64)), pa.array(low[keep].view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=fields)

    fields = ["name", "hash", "s"] + ["pos", "code_high", "code_low"] * codes
    kind = seqs.schema[name_col].dataType.simpleString()
    schema = f"name {kind}, hash long, s int" + ", pos long, code_high long, code_low long" * codes
    return chunked(seqs, name_col, seq_col, k, batch_bases).mapInArrow(run, schema)


def row_sketches(rows: DataFrame, params: SketchParams, batch_bases: int = BATCH_BASES) -> DataFrame:
    """(idx, name, n, sum_s, sum_s2, hashes, simplicities): the sketch of each row of (idx, name, seq) by itself, also of rows without a hash, in signed order; nothing is shuffled.

    Rows stay whole here, so long ones are for kmers().
    """
    threshold, multiplier, k, limit = np.uint64(params.threshold), params.multiplier, params.k, params.max_simplicity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, upto, data, begins in _slices(batch, batch_bases):
                place, _, _, h, s = hash_windows(data, k, multiplier)
                keep = h < threshold
                if limit is not None:
                    keep &= s <= limit
                h, s, row = h[keep].view(np.int64), s[keep], np.searchsorted(begins, place[keep], "right") - 1
                order = np.lexsort((s, h, row))
                h, s, row = h[order], s[order], row[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[: len(h)]  # of equal hashes the one with the least s
                h, s, row = h[new], s[new], row[new]
                n, sums, squares = (np.bincount(row, w, upto - at).astype(np.int64) for w in (None, s, s.astype(np.float64) ** 2))
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h, s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at), *map(pa.array, (n, sums, squares)), *lists], names=names)

    names = ["idx", "name", "n", "sum_s", "sum_s2", "hashes", "simplicities"]
    kinds = (rows.schema[c].dataType.simpleString() for c in names[:2])
    schema = "idx {}, name {}, n long, sum_s long, sum_s2 long, hashes array<bigint>, simplicities array<int>".format(*kinds)
    return rows.select("idx", "name", F.coalesce(F.col("seq").cast("binary"), F.lit(b"")).alias("seq")).mapInArrow(run, schema)


_UPPER = np.frombuffer(bytes(range(256)).upper(), np.uint8)
_OPPOSITE = np.frombuffer(bytes(range(256)).upper().translate(bytes.maketrans(b"ACGT", b"TGCA")), np.uint8)
#: What each_window() can add to a window, with its type.
WINDOW_COLUMNS = {"code": "long", "rc": "string", "canonical": "long", "s": "int"}


def each_window(seqs: DataFrame, k: int, column: str, name_col: str = "name", seq_col: str = "seq", batch_bases: int = BATCH_BASES) -> DataFrame:
    """(name, kmer, column) of every window of k valid bases, up to 21, in upper case: the same as windows() with one of WINDOW_COLUMNS, from the kernel."""
    if not 1 <= k <= ONE_LIMB_K:
        raise ValueError(f"k must be from 1 to {ONE_LIMB_K}, not {k}")

    def strings(letters: np.ndarray, place: np.ndarray, back: bool) -> pa.Array:
        found = np.lib.stride_tricks.sliding_window_view(letters, k)[place]
        found = np.ascontiguousarray(found[:, ::-1] if back else found)
        return pa.StringArray.from_buffers(len(place), pa.py_buffer(np.arange(0, k * len(place) + 1, k, dtype=np.int32)), pa.py_buffer(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, begins in _slices(batch, batch_bases):
                place, code, other = _codes_of(data, k)
                if not len(place):
                    continue
                if column == "rc":
                    made = strings(_OPPOSITE[data], place, True)
                elif column == "s":
                    made = pa.array(_squares(code, place, k))
                else:
                    found = _joined(code, k, True)[place]
                    made = pa.array((np.minimum(found, _joined(other, k, False)[place]) if column == "canonical" else found).view(np.int64))
                row = np.searchsorted(begins, place, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), strings(_UPPER[data], place, False), made], names=["name", "kmer", column])

    kind = seqs.schema[name_col].dataType.simpleString()
    return chunked(seqs, name_col, seq_col, k, batch_bases).mapInArrow(run, f"name {kind}, kmer string, {column} {WINDOW_COLUMNS[column]}")


def distinct_windows(seqs: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq", batch_bases: int = BATCH_BASES) -> DataFrame:
    """(name, n, n_distinct): windows of each name with any, and how many different hashes they have.

    A name of one piece, as nearly all are, is counted where it is read; only the hashes of names in several pieces are shuffled.
    """
    params = SketchParams(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, upto, data, begins in _slices(batch, batch_bases):
                place, _, _, h, _ = hash_windows(data, k, params.multiplier)
                h, row = h[h < np.uint64(params.threshold)], (np.searchsorted(begins, place, "right") - 1)[h < np.uint64(params.threshold)]
                order = np.argsort(h)
                order = order[np.argsort(row[order], kind="stable")]
                h, row = h[order], row[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[: len(h)]
                n, different = np.bincount(row, minlength=upto - at), np.bincount(row[new], minlength=upto - at)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + some)), pa.array(n[some]), pa.array(different[some])], names=["name", "n", "n_distinct"])

    pieces = F.floor((F.octet_length(F.col(seq_col).cast("binary")) - k) / CHUNK) + 1
    sized = seqs.where(F.octet_length(F.col(seq_col).cast("binary")) >= k)
    many = sized.groupBy(F.col(name_col).alias("_name")).agg(F.sum(pieces).alias("_c")).where("_c > 1").select("_name")
    met = F.col(name_col).eqNullSafe(F.col("_name"))
    kind = seqs.schema[name_col].dataType.simpleString()
    once = chunked(sized.join(many, met, "left_anti"), name_col, seq_col, k).mapInArrow(run, f"name {kind}, n long, n_distinct long")
    found = kmers(sized.join(many, met, "left_semi"), params, name_col, seq_col).groupBy("name", "hash").agg(F.count(F.lit(1)).alias("c"))
    return once.unionByName(found.groupBy("name").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_distinct")))


def windows(seqs: DataFrame, k: int, name_col: str = "name", seq_col: str = "seq", chunk: int = 1 << 14) -> DataFrame:
    """(name, kmer) of every window of valid bases, in upper case, as plain columns: pieces of so many windows first, then runs of bases in each, then their windows."""
    text = F.upper(F.translate(seq_col, "ıſ", ""))
    data = seqs.select(F.col(name_col).alias("name"), text.alias("_text")).where(F.length("_text") >= k)
    cut = data.select("name", "_text", F.explode(F.sequence(F.lit(1), F.length("_text") - k + 1, F.lit(chunk))).alias("_at"))
    runs = cut.select("name", F.explode(F.regexp_extract_all(F.substring("_text", F.col("_at"), F.lit(chunk + k - 1)), F.lit("[ACGT]+"), F.lit(0))).alias("run")).where(F.length("run") >= k)
    return runs.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring(F.col("run"), i, F.lit(k)))).alias("kmer"))


def kmers_by_columns(seqs: DataFrame, params: SketchParams, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """The same as kmers() without Python, for any k."""
    found = windows(seqs, params.k, name_col, seq_col).select("name", C.canonical_digits(F.col("kmer")).alias("_digits"), C.simplicity(F.col("kmer")).alias("s"))
    high, low = C.code_limbs(F.col("_digits"), params.k)
    hashed = found.select("name", high.alias("_high"), low.alias("_low"), "s")
    hashed = hashed.select("name", C.mix_hash(F.col("_low"), params.multiplier, F.col("_high") if params.k > ONE_LIMB_K else None).alias("hash"), "s")
    if params.signed:
        low = params.threshold - (1 << 64) if params.threshold >> 63 else params.threshold
        kept = hashed.where(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))) < F.lit(low).bitwiseXOR(F.lit(-(1 << 63))))
    else:
        kept = hashed.where((F.col("hash") >= 0) & (F.col("hash") < params.threshold))
    return kept if params.max_simplicity is None else kept.where(F.col("s") <= params.max_simplicity)
