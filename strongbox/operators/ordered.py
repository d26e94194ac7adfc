"""Work that needs the rows of a key in order, split so that no key has to fit in one task.

A window or a grouped function puts all rows of a key into one task. Here the keys with more
than ``max_rows`` rows are found first (a count with map-side combine), and their rows are partitioned
by ranges of key and order, which Spark balances by sampling. A range of a key is a slice: slices are
computed on their own, and what one slice hands to the next is a window over the slices' totals. There
are at most as many carried totals as ranges. Without such a key the plan is the plain window.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongbox.operators.joins import SMALL_TABLE_ROWS, join_on
from strongbox.workspace import new_folder

MAX_ROWS = 5_000_000
MAX_GROUP_ROWS = 1_000_000  # for groups that become a pandas frame
SLICES_PER_LIMIT = 4  # ranges are balanced by a sample: this leaves room for those that come out larger


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch; the session time zone is expected to be UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


@dataclass(frozen=True)
class Sliced:
    rows: DataFrame
    keys: list[str]
    slices: list[str]
    slice_count: int

    @property
    def group(self) -> list[str]:
        return self.keys + self.slices

    def attach(self, side: DataFrame) -> DataFrame:
        """Left join of the rows with at most one row of ``side`` per slice."""
        return join_on(self.rows, side, self.group, "left", small=self.slice_count <= SMALL_TABLE_ROWS)


def slice_hot_keys(rows: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> Sliced:
    """Cut every key with more than ``max_rows`` rows along its order columns, which leave no ties.

    The driver sees how many such keys there are and how many rows they have. Those rows are written down
    in their ranges, so that every pass over them sees the same ones; rows of other keys stay where they
    are. ``_hot`` tells them apart, ``_range`` numbers the ranges.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    n_rows = counts.agg(F.sum("_n")).first()[0]
    if n_rows is None:
        return Sliced(rows, keys, [], 0)
    found = _written(counts, "hot-keys")
    ranges = SLICES_PER_LIMIT * -(-n_rows // max_rows)
    hot = join_on(rows, found.select(*keys), keys, "left_semi").repartitionByRange(ranges, *keys, *order)
    hot = _written(hot.withColumns({"_hot": F.lit(1), "_range": F.spark_partition_id()}), "ranges")
    cold = join_on(rows, found.select(*keys), keys, "left_anti").withColumns({"_hot": F.lit(0), "_range": F.lit(0)})
    return Sliced(hot.unionByName(cold), keys, ["_hot", "_range"], ranges)


def _written(rows: DataFrame, name: str) -> DataFrame:
    place = new_folder(rows.sparkSession, name)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


COMBINE = {
    "sum": (F.sum, lambda carry, own: F.coalesce(carry + own, carry, own)),
    "max": (F.max, lambda carry, own: F.greatest(carry, own)),
    "min": (F.min, lambda carry, own: F.least(carry, own)),
}


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    *,
    include_current: bool = True,
    descending: bool = False,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Running sum, min or max per key. ``order`` are whole-number columns that leave no ties."""
    sliced = slice_hot_keys(rows, keys, order, max_rows)
    done = running_in(sliced, order, measures, include_current=include_current, descending=descending)
    return done.rows.drop(*sliced.slices)


def running_in(
    sliced: Sliced,
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    *,
    include_current: bool = True,
    descending: bool = False,
) -> Sliced:
    """``running`` for rows that are sliced along ``order`` already."""
    sliced = replace(sliced, rows=sliced.rows.withColumns({f"_in_{n}": value for n, (_, value) in measures.items()}))
    direction = F.desc if descending else F.asc
    last = Window.currentRow if include_current else -1
    inside = (
        Window.partitionBy(*sliced.group).orderBy(*[direction(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, last)
    )
    own = {n: COMBINE[kind][0](f"_in_{n}").over(inside) for n, (kind, _) in measures.items()}
    inputs = [f"_in_{n}" for n in measures]
    local = replace(sliced, rows=sliced.rows.withColumns(own).drop(*inputs))
    if not sliced.slices:
        return local

    before = (
        Window.partitionBy(*sliced.keys).orderBy(*[direction(s) for s in sliced.slices])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = sliced.rows.groupBy(*sliced.group).agg(
        *[COMBINE[kind][0](f"_in_{n}").alias(f"_total_{n}") for n, (kind, _) in measures.items()]
    )
    carried = totals.select(
        *sliced.group,
        *[COMBINE[kind][0](f"_total_{n}").over(before).alias(f"_carry_{n}") for n, (kind, _) in measures.items()],
    ).where(reduce(lambda a, b: a | b, [F.col(f"_carry_{n}").isNotNull() for n in measures]))
    combined = {n: COMBINE[kind][1](F.col(f"_carry_{n}"), F.col(n)) for n, (kind, _) in measures.items()}
    whole = local.attach(carried).withColumns(combined).drop(*[f"_carry_{n}" for n in measures])
    return replace(sliced, rows=whole)


def admit(
    rows: DataFrame,
    keys: Sequence[str],
    start: str,
    hold: str,
    tie: str,
    *,
    after: bool = False,
    busy: str | None = None,
    exempt: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds ``admitted``: taken in order, a row is admitted if its key is free, and then holds it.

    A key is free for a row when ``start`` is at least (``after``: above) the ``hold`` of the last
    admitted row, or the column ``busy`` before the first one. Rows marked ``exempt`` are admitted
    without holding the key. ``start``, ``hold``, ``tie`` and ``busy`` are whole numbers.
    """
    sliced = slice_hot_keys(rows, keys, [start, tie], max_rows)
    return admit_in(sliced, start, hold, tie, after=after, busy=busy, exempt=exempt).drop(*sliced.slices)


def admit_in(
    sliced: Sliced, start: str, hold: str, tie: str, *, after: bool = False, busy: str | None = None, exempt: str | None = None
) -> DataFrame:
    """``admit`` for rows that are sliced along ``start`` and ``tie`` already."""
    side = "right" if after else "left"
    rows = sliced.rows.withColumn("_busy", (F.col(busy) if busy else F.lit(None)).cast("long"))
    sliced = replace(sliced, rows=rows)
    columns, group = rows.columns, sliced.group
    schema = T.StructType(rows.schema.fields + [T.StructField("admitted", T.BooleanType())])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = held = None
        for batch in batches:
            begin, end, until = (batch[c].to_numpy() for c in (start, hold, "_busy"))
            taking = ~batch[exempt].to_numpy(bool) if exempt else np.ones(len(batch), bool)
            admitted = ~taking
            for low, high in _runs(batch, group):
                now = [None if pd.isna(v) else v for v in batch[group].iloc[low]]
                if now != key:
                    key, held = now, None if pd.isna(until[low]) else int(until[low])
                at = low + np.flatnonzero(taking[low:high])
                took = at[_walk(begin[at], end[at], held, side)]
                if len(took):
                    admitted[took], held = True, int(end[took[-1]])
            yield batch[columns].assign(admitted=admitted)

    if sliced.slices:
        known = sliced.attach(_busy_per_slice(sliced, start, hold, tie, exempt, side))
        known = known.withColumn("_busy", F.coalesce("_entry", "_busy")).drop("_entry")
    else:
        known = sliced.rows
    in_order = known.repartition(*group).sortWithinPartitions(*group, start, tie)
    return in_order.select(*columns).mapInPandas(mark, schema).drop("_busy")


def _runs(batch: pd.DataFrame, group: list[str]) -> Iterator[tuple[int, int]]:
    """The stretches of rows with the same group in a sorted batch."""
    codes = [pd.factorize(batch[g], use_na_sentinel=False)[0] for g in group]
    changes = reduce(np.logical_or, [c[1:] != c[:-1] for c in codes])
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
    return zip(edges, edges[1:]) if len(batch) else iter(())


def _walk(start: np.ndarray, hold: np.ndarray, busy: int | None, side: str) -> list[int]:
    """The positions that are admitted, one after the other."""
    following = _following(start, hold, side)
    at = 0 if busy is None else int(np.searchsorted(start, busy, side))
    admitted = []
    while at < len(start):
        admitted.append(at)
        at = following[at]
    return admitted


def _following(start: np.ndarray, hold: np.ndarray, side: str) -> list[int]:
    """For each row, the next row admitted if this one is."""
    return np.maximum(np.searchsorted(start, hold, side), np.arange(1, len(start) + 1)).tolist()


def _busy_per_slice(sliced: Sliced, start: str, hold: str, tie: str, exempt: str | None, side: str) -> DataFrame:
    """Until when each slice finds its key held, from what every slice does to any such time.

    A slice maps the time it is entered with to the time it leaves; entries that lead to the same
    end are kept as one step, and the steps are followed slice by slice.
    """
    types = {f.name: f for f in sliced.rows.schema.fields}
    names, n_keys = sliced.group, len(sliced.keys)
    group = [types[g] for g in names]
    steps_schema = T.StructType(group + [T.StructField(n, T.LongType()) for n in ("_busy", "_upto", "_leaves")])
    entry_schema = T.StructType(group + [T.StructField("_entry", T.LongType())])

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, tie], ignore_index=True)
        begin, end = pdf[start].to_numpy(), pdf[hold].to_numpy()
        leaves = end.copy()
        for at, then in reversed(list(enumerate(_following(begin, end, side)))):
            if then < len(leaves):
                leaves[at] = leaves[then]
        last = np.append(leaves[1:] != leaves[:-1], True)
        out = pdf.loc[last, names + ["_busy"]]
        return out.assign(_upto=begin[last], _leaves=leaves[last])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = place = busy = None
        passed = False
        for batch in batches:
            entries = []
            for row in batch.itertuples(index=False, name=None):
                *where, first, upto, leaves = row
                where = [None if pd.isna(w) else w for w in where]
                if where[:n_keys] != key:
                    key, place, busy = where[:n_keys], None, None if pd.isna(first) else int(first)
                if where != place:
                    place, passed = where, False
                    entries.append((*where, busy))
                if not passed and (busy is None or busy < upto or (busy == upto and side == "left")):
                    busy, passed = int(leaves), True
            yield pd.DataFrame(entries, columns=[*names, "_entry"]).astype({"_entry": "Int64"})

    taking = sliced.rows.where(~F.col(exempt)) if exempt else sliced.rows
    hot = taking.where(reduce(lambda a, b: a | b, [F.col(s) > 0 for s in sliced.slices])).select(*sliced.keys).distinct()
    needed = taking.select(*dict.fromkeys([*sliced.group, start, hold, tie, "_busy"]))
    needed = join_on(needed, hot, sliced.keys, "left_semi", small=sliced.slice_count <= SMALL_TABLE_ROWS)
    order = [*sliced.group, "_upto"]
    return (
        needed.groupBy(*sliced.group).applyInPandas(steps, steps_schema)
        .repartition(*sliced.keys).sortWithinPartitions(*order)
        .mapInPandas(follow, entry_schema)
    )
