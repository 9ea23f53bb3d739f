"""Layers that recompute the slices that new rows touch, and leave the others as they are.

A source is a ``LogStore`` that grows by batches. A layer computes something from it whose value at (key, day) depends on
the source's rows of that key in the ``frame_days`` days before and on that day (RANGE frames, daily aggregates). A
row that arrives on day d therefore touches the slices (key, d) to (key, d + frame_days), however late it comes. One
refresh

* takes the source's batches after the layer's high-water mark, and from their rows the touched slices;
* reads of the source only the days that those slices' frames cover (partition filter) and the keys they name;
* computes, keeps the rows of the touched slices and appends them as one batch.

The layer is a ``LogStore`` itself: its newest batch is its high-water mark, written by the same commit as the rows, so
a refresh that dies leaves neither. Reading takes the newest version of each row. What a refresh appends is what
changed for the layer above, so layers stack: each one's batches are the next one's new rows.

Defined results: a NULL slice key is a key like any other. Rows without a time lie in no slice and are in no layer.
``keys`` tell rows apart (NULL is a value like any other); more rows in a slice may change its results but not remove one. Batches of the
source are final once a layer has read them. If a compaction of the source beyond the mark has replaced the batches
that lie before it, what is new can't be told and the refresh computes everything.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewatch.operators.logstore import LogStore
from tradewatch.operators.windows import latest_by
from tradewatch.session import cut_lineage


class SliceLayer:
    """``compute`` maps rows of the source to the layer's rows, which carry the columns ``slice_key`` and ``day`` (a
    time) and are identified by ``keys``. It is given whole frames of the touched slices only. The source
    has a ``day`` column; its slices are (``slice_key``, that day)."""

    def __init__(self, source: LogStore, path: str, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str],
                 slice_key: str, day: str, frame_days: int = 0):
        if not source.day:
            raise ValueError("the source must be partitioned by day")
        self.source, self.compute, self.slice_key, self.day, self.frame_days = source, compute, slice_key, day, frame_days
        made = compute(source.spark.createDataFrame([], source.schema)).schema
        self.columns = made.fieldNames()
        schema = T.StructType([*made.fields, T.StructField("_version", T.LongType())])
        self.store = LogStore(source.spark, path, schema, keys, day=day, fold=lambda df: latest_by(df, list(keys), ["_version"], keep_null_keys=True))

    def mark(self) -> int | None:
        """Newest batch of the source that the layer holds."""
        return max(self.store.batches(), default=None)

    def _near(self, slices: DataFrame, first: int, last: int) -> DataFrame:
        """The slices ``first`` to ``last`` days after the given ones."""
        days = F.explode(F.sequence(F.date_add("_slice_day", first), F.date_add("_slice_day", last)))
        return slices.select("_slice_key", days.alias("_slice_day")).distinct()

    def _inside(self, rows: DataFrame, day: str, slices: DataFrame) -> DataFrame:
        same = F.col(self.slice_key).eqNullSafe(F.col("_slice_key")) & (F.to_date(day) == F.col("_slice_day"))
        return rows.join(slices, same, "left_semi")

    def touched(self, upto: int) -> DataFrame:
        """Slices (_slice_key, _slice_day) whose rows change with the source's batches after the mark."""
        new = self.source.added(self.mark(), upto).filter(F.col(self.source.day).isNotNull())
        new = new.select(F.col(self.slice_key).alias("_slice_key"), F.to_date(self.source.day).alias("_slice_day")).distinct()
        return self._near(new, 0, self.frame_days)

    def refresh(self, upto: int | None = None) -> bool:
        """Bring the layer to batch ``upto`` of the source (default: its newest). False if it is there already."""
        upto, mark = max(self.source.batches(), default=None) if upto is None else upto, self.mark()
        if upto is None or (mark is not None and mark >= upto):
            return False
        slices = cut_lineage(self.touched(upto))  # these and the rows are read several times
        needed = cut_lineage(self._near(slices, -self.frame_days, 0))
        days = [r[0] for r in needed.select("_slice_day").distinct().collect()]  # as many as the calendar has
        rows = cut_lineage(self._inside(self.source.read(upto, days=days), self.source.day, needed))
        made = self._inside(self.compute(rows), self.day, slices)
        self.store.append(made.withColumn("_version", F.lit(upto).cast("long")), upto)
        return True

    def read(self, upto: int | None = None) -> DataFrame:
        return self.store.read(upto).select(*self.columns)
