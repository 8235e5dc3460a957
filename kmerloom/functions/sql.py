"""The k-mer functions under names that SQL can call: temporary SQL functions, which Catalyst inlines, and one table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from .params import MIX_1, MIX_2

_CODE = "CAST(conv(translate(upper({0}), 'ACGT', '1634'), 8, 10) AS BIGINT)"
_REVERSE = "reverse(translate(upper({0}), 'ACGT', 'TGCA'))"


def _mix(code: str) -> str:
    """The mixed hash of a code, from 16-bit digits of the 128-bit product, as in functions.columns."""
    m = [(MIX_1 ^ MIX_2) >> (16 * k) & 0xFFFF for k in range(4)]
    rows = "h0", "h1", "h2", "h3"
    inner = f"{code} ^ ({MIX_1 - (1 << 64) if MIX_1 >> 63 else MIX_1}L)"
    digits = [f"shiftrightunsigned(x, {16 * k}) & 65535L" for k in range(4)]
    sums = ["+".join(f"{rows[i]} * {m[p - i]}L" for i in range(4) if 0 <= p - i < 4) for p in range(7)]
    # each sum of at most four products of 16 by 16 bits and a carry fits in 35 bits
    fields, at = [], "0L"
    for total in sums:
        at = f"(({total}) + shiftrightunsigned({at}, 16))"
        fields.append(at)
    word = lambda d: " | ".join(f"shiftleft(({x}) & 65535L, {16 * k})" for k, x in enumerate(d))
    last = f"shiftrightunsigned({fields[6]}, 16)"
    body = f"({word(fields[:4])}) ^ ({word([*fields[4:], last])})"
    split = f"struct({', '.join(f'{d} AS {r}' for d, r in zip(digits, rows, strict=True))})"
    for r in rows:
        body = body.replace(r, f"d.{r}")
    return f"element_at(transform(transform(array({inner}), x -> {split}), d -> {body}), 1)"


_K2, _MEANS = "(k * k * 1D)", "transform(array(struct(su / {k2} / uni AS mu, si / {k2} / inter AS mi, su2 / ({k2} * {k2}) / uni AS qu, si2 / ({k2} * {k2}) / inter AS qi)), m -> "
_MOMENTS = "inter BIGINT, uni BIGINT, su BIGINT, su2 BIGINT, si BIGINT, si2 BIGINT, k INT"


def _homoplasy() -> str:
    """The share of chance matches, as in functions.formula."""
    spread = "struct(m.mu AS mu, m.mi AS mi, greatest(m.qu - m.mu * m.mu, 0D) AS vu, greatest(m.qi - m.mi * m.mi, 0D) AS vi, (m.mi - m.mu) * (m.mi - m.mu) AS gap)"
    b = "struct(v.vu AS vu, v.gap AS gap, v.vi - v.vu + v.gap AS b)"
    root = "sqrt(greatest(w.b * w.b + 4 * w.vu * w.gap, 0D))"
    x = f"CASE WHEN w.b > 0 THEN 2 * w.gap / (w.b + {root}) ELSE ({root} - w.b) / (2 * w.vu) END"
    simpler = "CAST(si AS DECIMAL(38, 0)) * CAST(uni AS DECIMAL(38, 0)) > CAST(su AS DECIMAL(38, 0)) * CAST(inter AS DECIMAL(38, 0))"
    value = f"CASE WHEN {simpler} AND w.vu > 1e-12 THEN least(greatest({x}, 0D), 0.999999D) ELSE 0D END"
    return f"CASE WHEN inter > 0 AND uni > 0 THEN element_at(transform(transform({_MEANS.format(k2=_K2)}{spread}), v -> {b}), w -> {value}), 1) ELSE 0D END"


_NAIVE = "(1 - pow(2D * inter / (inter + uni), 1D / k))"
_CORRECTED = f"{_NAIVE} - ln(1 - ({_homoplasy()})) / k"
_JUKES_CANTOR = "CASE WHEN {0} >= 0.75 THEN 1D ELSE least(greatest(-0.75 * ln(1 - 4 * {0} / 3), 0D), 1D) END"
FUNCTIONS = {
    "revcomp(k STRING) RETURNS STRING": _REVERSE.format("k"),
    "kmer_code(k STRING) RETURNS BIGINT": _CODE.format("k"),
    "kmer_canonical(k STRING) RETURNS BIGINT": f"least({_CODE.format('k')}, {_CODE.format(_REVERSE.format('k'))})",
    "kmer_simplicity(k STRING) RETURNS INT": "CAST(" + " + ".join(f"pow(length(k) - length(replace(upper(k), '{b}', '')), 2)" for b in "ACGT") + " AS INT)",
    "sketch_jaccard(shared BIGINT, total BIGINT) RETURNS DOUBLE": "CASE WHEN shared > 0 AND total > 0 THEN shared / total ELSE 0D END",
    "sketch_naive_distance(shared BIGINT, total BIGINT, k INT) RETURNS DOUBLE": "CASE WHEN shared > 0 AND total > 0 THEN 1 - pow(2D * shared / (total + shared), 1D / k) ELSE 1D END",
    "jukes_cantor(d DOUBLE) RETURNS DOUBLE": _JUKES_CANTOR.format("d"),
    "kmer_mix_hash(code BIGINT) RETURNS BIGINT": _mix("code"),
    f"sketch_homoplasy({_MOMENTS}) RETURNS DOUBLE": _homoplasy(),
    f"sketch_distance({_MOMENTS}) RETURNS DOUBLE": f"CASE WHEN inter > 0 AND uni > 0 THEN least(greatest({_CORRECTED}, 0D), 1D) ELSE 1D END",
    f"sketch_distance_jc({_MOMENTS}) RETURNS DOUBLE": f"CASE WHEN inter > 0 AND uni > 0 THEN element_at(transform(array({_CORRECTED}), d -> {_JUKES_CANTOR.format('d')}), 1) ELSE 1D END",
}


def _kept(seq: bytes | memoryview, k: int, scale: int) -> pa.Table:
    import numpy as np

    from kmerloom.functions.params import SketchParams
    from kmerloom.operators.kmers import hash_windows

    p = SketchParams(k, scale)
    _, _, _, h, s = hash_windows(np.frombuffer(seq, np.uint8), k, p.multiplier)
    keep = h < np.uint64(p.threshold)
    return pa.table({"hash": pa.array(h[keep].view(np.int64)), "s": pa.array(s[keep].astype(np.int32))})


@udtf(returnType="hash bigint, s int", useArrow=True)
class KmerSketch:
    """(hash, s) of the kept windows of a sequence, for lateral joins, which take no other kind; not yet distinct."""

    def eval(self, seq: str, k: int, scale: int) -> Iterator[tuple[int, int]]:
        got = _kept((seq or "").encode(), k, scale)
        yield from zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)


@arrow_udtf(returnType="name string, hash bigint, s int")
class KmerSketches:
    """(name, hash, s) of the kept windows of a table (name, seq), a batch at a time; not yet distinct."""

    def eval(self, rows: pa.RecordBatch, k: pa.Array, scale: pa.Array) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        width, of = k[0].as_py(), scale[0].as_py()
        for name, seq in zip(rows.column(0), rows.column(1), strict=True):
            if seq.is_valid:
                got = _kept(seq.as_buffer(), width, of)
                yield got.add_column(0, "name", pa.array([name.as_py()] * got.num_rows, pa.string()))


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session's SQL, and the table functions kmer_sketch(seq, k, scale) and, for whole tables, kmer_sketches(TABLE(name, seq), k, scale)."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("kmer_sketch", KmerSketch)
    spark.udtf.register("kmer_sketches", KmerSketches)
