"""An incremental sketch over a stream of sequence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import SketchParams
from ..operators.kmers import kmers


def stream_sketch(reads: DataFrame, params: SketchParams = SketchParams(), name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """(name, hash, s, n) of a streaming DataFrame of sequences, for output mode update or complete.

    State is a row per kept hash: only about one in scale of all windows reaches it. min_count is for the reader to apply
    to n, since a hash may pass it later.
    """
    return kmers(reads, params, name_col, seq_col).groupBy("name", "hash").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
