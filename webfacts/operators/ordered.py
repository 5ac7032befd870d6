"""Ordered folds whose groups may be larger than one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task. Here the rows are
range-partitioned on ``keys + order`` first, so a large key is spread over several *blocks*. Windows run
inside a block; what crosses a block border is carried by a summary with one row per (key, block).
Two neighbouring range partitions share at most one key, so the keys that need a carry have at most
``2 * partitions`` summary rows: that is the proven bound behind the broadcast below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.session import cut

BLOCK = "_block"


class OrderedRows:
    """Rows sorted by ``keys + order``; ``order`` must be a total order inside each key."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None):
        self.keys, self.order = list(keys), list(order)
        # Without a number, adaptive execution merges small partitions.
        by = [partitions] if partitions else []
        # The block number is only stable once written: a second run of the sampling could move the borders.
        self.df = cut(df.repartitionByRange(*by, *self.keys, *self.order).withColumn(BLOCK, F.spark_partition_id()))

    def _local(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)

    def _carry(self, aggs: list[Column], folds: list[Column]) -> DataFrame:
        """One row per (key, block) for keys that cross a border, with the folded state before the block."""
        per_block = self.df.groupBy(*self.keys, BLOCK).agg(*aggs)
        every = Window.partitionBy(*self.keys)
        crossing = per_block.withColumn("_n", F.count(F.lit(1)).over(every)).filter("_n > 1")
        return crossing.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], F.col(BLOCK).alias("_k_block"), *folds)

    def _attach(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        cond = df[BLOCK] == carry["_k_block"]
        for k in self.keys:
            cond = cond & df[k].eqNullSafe(carry[f"_k_{k}"])
        return df.join(F.broadcast(carry), cond, "left").drop("_k_block", *[f"_k_{k}" for k in self.keys])

    def _blocks_before(self):
        return Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    def running_sum(self, **sums: Column) -> OrderedRows:
        """Inclusive running sums ``name=value`` in row order."""
        return self._running(sums, inclusive=True)

    def sum_before(self, **sums: Column) -> OrderedRows:
        """Running sums of the rows strictly before the current one."""
        return self._running(sums, inclusive=False)

    def _running(self, sums: dict[str, Column], inclusive: bool) -> OrderedRows:
        names = list(sums)
        carry = self._carry(
            [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
            [F.sum(f"_s_{n}").over(self._blocks_before()).alias(f"_c_{n}") for n in names],
        )
        frame = self._local().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = self.df.select("*", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()])
        joined = self._attach(local, carry)
        out = joined.select(
            *[c for c in self.df.columns if c not in names],
            *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in names],
        )
        return self._with(out)

    def row_number(self, name: str) -> OrderedRows:
        """1-based position inside the key."""
        return self.running_sum(**{name: F.lit(1).cast("long")})

    def previous(self, **cols: str) -> OrderedRows:
        """Value of the row just before, ``new_name=column``; null for the first row of a key."""
        return self._neighbour(cols, back=True)

    def following(self, **cols: str) -> OrderedRows:
        """Value of the row just after, ``new_name=column``; null for the last row of a key."""
        return self._neighbour(cols, back=False)

    def _neighbour(self, cols: dict[str, str], back: bool) -> OrderedRows:
        names = list(cols)
        edge = F.max_by if back else F.min_by
        payload = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
        across = Window.partitionBy(*self.keys).orderBy(BLOCK)
        step = F.lag if back else F.lead
        carry = self._carry(
            [edge(payload, F.struct(*self.order)).alias("_edge")],
            [step("_edge").over(across).alias("_c_edge")],
        )
        local = self.df.select("*", step(payload).over(self._local()).alias("_near"))
        joined = self._attach(local, carry)
        pick = F.coalesce(F.col("_near"), F.col("_c_edge"))
        out = joined.select(*[c for c in self.df.columns if c not in names], *[pick[n].alias(n) for n in names])
        return self._with(out)

    def last_known_before(self, **cols: str) -> OrderedRows:
        """Last non-null value among the rows strictly before, ``new_name=column``."""
        names = list(cols)
        before = self._local().rowsBetween(Window.unboundedPreceding, -1)
        carry = self._carry(
            [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*self.order))).alias(f"_e_{n}") for n, c in cols.items()],
            [F.last(f"_e_{n}", ignorenulls=True).over(self._blocks_before()).alias(f"_c_{n}") for n in names],
        )
        local = self.df.select("*", *[F.last(c, ignorenulls=True).over(before).alias(f"_l_{n}") for n, c in cols.items()])
        joined = self._attach(local, carry)
        out = joined.select(
            *[c for c in self.df.columns if c not in names], *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in names]
        )
        return self._with(out)

    def with_columns(self, **cols: Column) -> OrderedRows:
        return self._with(self.df.withColumns(cols))

    def _with(self, df: DataFrame) -> OrderedRows:
        new = object.__new__(OrderedRows)
        new.keys, new.order, new.df = self.keys, self.order, df
        return new

    def rows(self) -> DataFrame:
        return self.df.drop(BLOCK)


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with ``n_equal``, ``n_upto`` (rows <= value) and ``n_total``.

    Counting equal values first keeps a heavily repeated value to one row before anything is sorted.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ranked = OrderedRows(distinct, keys, [value]).running_sum(n_upto=F.col("n_equal")).rows()
    totals = ranked.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("n_equal").alias("n_total"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & ranked[k].eqNullSafe(totals[f"_t_{k}"])
    return ranked.join(totals, cond).drop(*[f"_t_{k}" for k in keys])


def value_at(position: Column, value: str = "value") -> Column:
    """Aggregate over :func:`value_ranks`: the value at a 0-based sorted position."""
    return F.min(F.when(F.col("n_upto") > position, F.col(value)))


def interpolated(p: float, value: str) -> Column:
    """Aggregate over :func:`value_ranks`: percentile with linear interpolation between ranks."""
    at = (F.col("n_total") - 1) * F.lit(round(p * 100, 6)) / F.lit(100)
    low, high = value_at(F.floor(at), value), value_at(F.ceil(at), value)
    frac = F.max(at - F.floor(at))
    return low + (high - low) * frac


def floor_index(p: float, value: str) -> Column:
    """Aggregate over :func:`value_ranks`: ``sorted[min(floor(n * p), n - 1)]``."""
    at = F.least(F.floor(F.col("n_total") * F.lit(round(p * 100, 6)) / F.lit(100)), F.col("n_total") - 1)
    return value_at(at, value)
