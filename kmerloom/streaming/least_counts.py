"""Sketches of a stream of reads under a least count: a hash leaves once, when it has been seen often enough."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.params import SketchParams
from ..operators.kmers import kmers

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeastCount(StatefulProcessor):
    """Per (name, hash): how often it was seen, up to least, and its least simplicity so far."""

    def __init__(self, least: int, expire_ms: int | None):
        self.least, self.expire_ms = least, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int, s int", self.expire_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, s = self.seen.get() or (0, None)
        if n >= self.least:  # it has left
            for _ in rows:
                pass
            return
        for row in rows:
            n, s = n + 1, row["s"] if s is None else min(s, row["s"])
        self.seen.update((min(n, self.least), s))
        if n >= self.least:
            yield Row(name=key[0], hash=key[1], s=s)

    def close(self) -> None:
        pass


def stream_min_count(reads: DataFrame, params: SketchParams, name_col: str = "name", seq_col: str = "seq", expire_ms: int | None = None) -> DataFrame:
    """(name, hash, s) of a streaming DataFrame of sequences, for output mode append: each hash once, in the batch in which its count reaches params.min_count.

    All that has left after any batches is what sketch() gives for all their rows (s as far as it was seen; windows of one hash are
    one k-mer, and so have one s, but for collisions of 64-bit hashes). The state is a row of two small integers per kept hash, about one in scale of
    all distinct windows, in RocksDB, which this sets for the session. expire_ms drops a hash that was not seen for so long, with its count and with the
    memory that it has left, and needs a trigger that goes on, as expiry takes batches without data (availableNow would not end); without it all are kept. Rows without a name are a name of their own, those without a sequence have no windows.
    """
    reads.sparkSession.conf.set(_PROVIDER, _ROCKS)
    found = kmers(reads, params, name_col, seq_col)
    kind = dict(found.dtypes)["name"]
    mode = "none" if expire_ms is None else "processingTime"
    return found.groupBy("name", "hash").transformWithState(LeastCount(max(params.min_count, 1), expire_ms), f"name {kind}, hash bigint, s int", "append", mode)
