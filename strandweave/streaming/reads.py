"""Evidence from a stream of alignments in genome order: state by read name, flushed at the end of a contig."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strandweave.operators.reads import paired, split_evidence
from strandweave.options import CallOptions
from strandweave.session import ship

#: Seconds of a contig on the clock that runs along the genome.
SPAN = 1 << 29

#: Columns of a row: those of split segments, of discordant ends, and of both.
FIELDS = "read_id string, kind string, template_id int, ref_begin long, ref_end long, is_reverse boolean, q_begin long, q_end long, map_q int, seg_no long, tlen long, last_rid int"

_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def genome_time(rid: Column | str, pos: Column | str) -> Column:
    """Event time of a place: genome order as time."""
    return F.timestamp_seconds(F.col(rid).cast("long") * SPAN + F.col(pos) if isinstance(rid, str) else rid.cast("long") * SPAN + pos)


def _plain(x: object) -> object:
    """A value as the state takes it; whole numbers beside nulls come as floats."""
    if x is None or (isinstance(x, float) and x != x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) else x


class Gathered(StatefulProcessor):
    """Rows of a read until all are there: a pair with its second end, segments when the last contig that one of them names has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(map(_plain, r)) for pdf in rows for r in pdf[_NAMES].itertuples(index=False)]
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        if key[1] == "pair" and len(held) + len(new) >= 2:
            self.held.clear()  # its timer will find nothing
            yield pd.DataFrame(held + new, columns=_NAMES)
            return
        self.held.appendList(new)
        if not held:
            # a row that comes after its contig goes at the next turn of the clock
            due = (max(r[-1] for r in new) + 1) * SPAN * 1000
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self.held.clear()
        if held:
            yield pd.DataFrame(held, columns=_NAMES)

    def close(self) -> None:
        pass


def gathered(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The rows of each read together, in the batch in which the read is complete.

    ``rows`` is a stream of FIELDS and ``at``, the event time of
    :func:`genome_time`. ``last_rid`` is the last contig on which the read has
    a row; its state goes when the clock has passed that contig. A row that
    comes later than that stands alone. A row with a contig beyond all others
    closes the stream. Needs the RocksDB state store.
    """
    ship(rows.sparkSession)
    timed = rows.withWatermark("at", late).where("read_id is not null")
    return timed.groupBy("read_id", "kind").transformWithStateInPandas(Gathered(), outputStructType=FIELDS, outputMode="Append", timeMode="EventTime")


def evidence_stream(rows: DataFrame, out: str, checkpoint: str, o: CallOptions = CallOptions(), max_insert: float = float("inf")) -> StreamingQuery:
    """Writes complete reads, split and pair evidence as Parquet under ``out``/reads, split and pair, batch by batch.

    Reads come complete, so each batch is what the batch operators make of it.
    A batch that runs again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        # written once: a stateful batch must not be computed again
        place = f"{out}/reads/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        held = batch.sparkSession.read.schema(batch.schema).parquet(place)
        ends = held.where("kind = 'pair'").select(F.col("read_id").alias("qname"), "template_id", F.col("ref_begin").alias("begin_pos"), F.col("ref_end").alias("end_pos"), "is_reverse", "tlen", "map_q")
        split_evidence(held.where("kind = 'split'"), o).write.mode("overwrite").parquet(f"{out}/split/batch={number}")
        paired(ends, max_insert).write.mode("overwrite").parquet(f"{out}/pair/batch={number}")

    stream = gathered(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
