"""Running state over the rows of a key, also where one key holds a large part of all rows.

A running last value, sum or maximum is a scan of *transitions* that combine associatively, so a key's
rows need not lie in one task: rows of heavy keys are dealt by ranges of (key, order) and written once;
each range is scanned by itself, reduced to one transition, the transitions of a key are scanned in the
order of its ranges, and every range starts from what the earlier ones left. All other keys take plain
window functions. Both give the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.sources import written

#: A key is heavy above so many rows, and above this share of all of them: so there are few heavy keys.
RANGE_ROWS, SHARES = 2_000_000, 1_000


@dataclass(frozen=True)
class State:
    """A running value: ``last`` (not null), ``sum`` or ``max`` of ``value`` up to a row, or ``before`` it.

    ``lag`` is the value of the row before, null or not. ``by`` names columns that divide a key further.
    """

    kind: str
    value: Column
    before: bool = False
    default: Column | None = None
    by: tuple[str, ...] = ()


class Scan:
    """Rows of ``df`` by ``keys`` in the order of ``order``, to which running states are added.

    ``order`` must tell the rows of a key apart where their order matters. Heavy keys are found by one
    count a key; their rows are cut into ranges of about ``range_rows``. A null key is a key.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS):
        self.keys, self.order, self.columns = keys, order, df.columns
        self.light, self.heavy = df, None
        counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
        if not most or most <= range_rows:
            return
        bound = max(range_rows, total // SHARES)
        heavy = written(counts.where(F.col("_n") > bound).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n"))  # SHARES rows at most
        rows = heavy.agg(F.sum("_n")).first()[0]
        if not rows:
            return
        on = F.lit(True)
        for i, k in enumerate(keys):
            on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        few = F.broadcast(heavy)
        self.light = df.join(few, on, "left_anti")
        dealt = df.join(few, on, "left_semi").repartitionByRange(-(-rows // range_rows) + 1, *keys, *order)
        self.heavy = written(dealt.withColumn("_range", F.spark_partition_id()))  # the ranges stay as they are

    def _with(self, light: DataFrame, heavy: DataFrame | None) -> Scan:
        out = object.__new__(Scan)
        out.keys, out.order, out.light, out.heavy = self.keys, self.order, light, heavy
        return out

    def where(self, condition: str | Column) -> Scan:
        return self._with(self.light.where(condition), self.heavy.where(condition) if self.heavy is not None else None)

    def with_columns(self, columns: dict[str, Column]) -> Scan:
        return self._with(self.light.withColumns(columns), self.heavy.withColumns(columns) if self.heavy is not None else None)

    def rows(self) -> DataFrame:
        return self.light if self.heavy is None else self.light.unionByName(self.heavy.drop("_range"))

    def with_states(self, **states: State) -> Scan:
        """The rows with a column for each state; several states share one sort."""

        def local(*first: str) -> dict[str, Column]:
            out = {}
            for name, s in states.items():
                w = Window.partitionBy(*first, *self.keys, *s.by).orderBy(*self.order)
                upto = w.rowsBetween(Window.unboundedPreceding, -1 if s.before or s.kind == "lag" else Window.currentRow)
                value = F.struct(s.value.alias("v")) if s.kind == "lag" else s.value
                out[name] = {"last": F.last, "lag": F.last, "sum": F.sum, "max": F.max}[s.kind](value, **({"ignorenulls": True} if s.kind in ("last", "lag") else {})).over(upto)
            return out

        def finish(name: str, value: Column) -> Column:
            value = value["v"] if states[name].kind == "lag" else value
            default = states[name].default
            return value if default is None else F.coalesce(value, default)

        add = lambda df, first, made: df.withColumns(local(*first)).withColumns({n: finish(n, made(n)) for n in states})
        light = add(self.light, (), F.col)
        if self.heavy is None:
            return self._with(light, None)
        heavy = self.heavy
        for group in dict.fromkeys(s.by for s in states.values()):
            own = {n: s for n, s in states.items() if s.by == group}
            heavy = self._ranged(heavy, group, own, {n: c for n, c in local("_range").items() if n in own}, finish)
        return self._with(light, heavy)

    def _ranged(self, heavy: DataFrame, by: tuple[str, ...], states: dict[str, State], local: dict[str, Column], finish) -> DataFrame:
        keys, place = [*self.keys, *by], F.struct(*self.order)
        reduced, scanned = [], []
        before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        for n, s in states.items():
            if s.kind in ("last", "lag"):
                value = F.struct(s.value.alias("v"))
                kept = value if s.kind == "lag" else F.when(s.value.isNotNull(), value)
                reduced.append(F.max_by(kept, F.when(kept.isNotNull(), place)).alias(f"_t_{n}"))
                scanned.append(F.last(f"_t_{n}", ignorenulls=True).over(before))
            else:
                reduced.append({"sum": F.sum, "max": F.max}[s.kind](s.value).alias(f"_t_{n}"))
                scanned.append({"sum": F.sum, "max": F.max}[s.kind](f"_t_{n}").over(before))
        # a row for each range and key in it; written, so that no later scan makes the rows below twice
        totals = written(heavy.groupBy("_range", *keys).agg(*reduced))
        starts = totals.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c.alias(f"_s_{n}") for n, c in zip(states, scanned, strict=True)])
        on = F.col("_range") == F.col("_at")
        for i, k in enumerate(keys):
            on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        columns = [c for c in heavy.columns if c not in states]
        out = heavy.withColumns({f"_l_{n}": c for n, c in local.items()}).join(starts, on)
        made = {}
        for n, s in states.items():
            mine, start = F.col(f"_l_{n}"), F.col(f"_s_{n}")
            if s.kind == "last":
                start = start["v"]
            both = {"sum": F.when(mine.isNull(), start).when(start.isNull(), mine).otherwise(mine + start), "max": F.greatest(mine, start)}
            made[n] = finish(n, both.get(s.kind, F.coalesce(mine, start)))
        return out.select(*columns, *[c.alias(n) for n, c in made.items()])
