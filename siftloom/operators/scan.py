"""Prefix scans and row numbers over tables of any size: nothing orders a whole key, or a whole table, in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.sources.shared import written

#: Rows that a task orders together, about.
CHUNK_ROWS = 1 << 20


@dataclass(frozen=True)
class Running:
    """What a scan keeps: sum, max, min or last (the last value that isn't null) of a column, of the rows before each row or up to it."""

    kind: str
    value: Column
    before: bool = False

    def of(self, part: Window) -> Column:
        w = part.rowsBetween(Window.unboundedPreceding, -1 if self.before else Window.currentRow)
        return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True)}[self.kind](self.value).over(w)

    def whole(self, order: Column) -> Column:
        """Of all rows of a chunk, as an aggregate that is made up of partial ones."""
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), order))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def joined(self, carried: Column, own: Column) -> Column:
        """Associative: what came before a chunk, and what the chunk has."""
        if self.kind == "sum":
            return F.coalesce(carried + own, carried, own)
        return {"max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}[self.kind](carried, own)


def chunk_bounds(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS) -> list:
    """Values of the order that cut a table into parts of about so many rows, from a sketch that tasks make and merge; 10 000 at most."""
    n = df.count()
    parts = min(10_000, -(-n // chunk_rows))
    if parts < 2:
        return []
    got = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()[0]
    return sorted(set(got or []))


def scan(df: DataFrame, keys: list[str], order: str, running: dict[str, Running], chunk_rows: int = CHUNK_ROWS, bounds: list | None = None) -> DataFrame:
    """df with a column for each name of running, within each key by the order.

    Rows are dealt out by key and chunk, a range of the order's values; a chunk of a key has no more rows than a chunk of the table, so a key
    with half of all rows is no single task's burden. Each chunk is scanned by itself; chunks' totals, a row for each, are scanned within
    their keys; then what was carried is added to every row. Rows move once.

    The order must be a number, date or time. Rows of equal order in one key come in any order, but those are in one chunk. Rows with a
    null order come first.
    """
    if bounds is None:
        bounds = chunk_bounds(df, order, chunk_rows)
    chunk = F.lit(0)
    if bounds:
        cut = F.array(*[F.lit(b).cast(dict(df.dtypes)[order]) for b in bounds])
        # how many bounds are not above a value: a binary search in place
        chunk = F.when(F.col(order).isNull(), 0).otherwise(_not_above(cut, F.col(order), len(bounds)))
    part = [*keys, "_chunk"]
    own = Window.partitionBy(*part).orderBy(F.col(order).asc_nulls_first())
    rows = df.withColumn("_chunk", chunk.cast("int"))
    inside = rows.withColumns({f"_own_{c}": r.of(own) for c, r in running.items()})
    totals = rows.groupBy(*part).agg(*[r.whole(F.struct(order)).alias(f"_all_{c}") for c, r in running.items()])
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk of a key
    carry = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, True)}
    carried = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_chunk").alias("_of"), *[carry[r.kind](F.col(f"_all_{c}")).over(over).alias(f"_before_{c}") for c, r in running.items()])
    same = F.col("_chunk") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    both = inside.join(carried, same, "left")
    return both.select(*df.columns, *[r.joined(F.col(f"_before_{c}"), F.col(f"_own_{c}")).alias(c) for c, r in running.items()])


def _not_above(cut: Column, value: Column, n: int) -> Column:
    """How many of n sorted values aren't above a value, by halving."""
    def step(at: Column, width: int) -> Column:
        further = lambda _, a: F.when((a + width <= n) & (F.get(cut, a + (width - 1)) <= value), a + width).otherwise(a)
        return F.aggregate(F.array(at), F.lit(0), further)

    at = F.lit(0)
    for s in reversed(range(n.bit_length())):
        at = step(at, 1 << s)
    return at


def numbered(df: DataFrame, *order: Column | str, name: str = "n", start: int = 0) -> DataFrame:
    """df with dense numbers from start on, in an order that tells all rows apart.

    The table is dealt out by ranges of the order and sorted in place; a row's place in its task is known there, and a number a task says
    where it begins. The sorted rows are written once, since ranges come from a sample.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows)
    task = F.shiftright("_id", 33)
    counts = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))  # a row for each task
    begins = counts.withColumn("_begin", F.coalesce(F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    both = rows.withColumn("_task", task).join(F.broadcast(begins), "_task")
    return both.withColumn(name, F.col("_begin") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("_id", "_task", "_begin")
