"""Numbers and lookups along an order, without bringing a whole log partition into one task.

A log partition may hold a third of all rows. Rows are dealt by (keys, order div width), ordered inside such a run, and
the runs, one small row each, are added up along the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources.shared import cut

WIDTH = 1 << 17


def _run(order: str | list[str], width: int):
    return F.floor(F.col(_first(order)) / width)


def _first(order: str | list[str]) -> str:
    return order if isinstance(order, str) else order[0]


def _all(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else order


def _joined(rows: DataFrame, runs: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    names = [*keys, "_run"]
    renamed = runs.withColumnsRenamed({n: f"_{n}_" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_{n}_")) for n in names]
    return rows.join(renamed, on, how).drop(*[f"_{n}_" for n in names])


def sequence_numbers(rows: DataFrame, keys: list[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds name: 0, 1, ... within keys along `order`, a whole number that is distinct within keys."""
    rows = rows.withColumn("_run", _run(order, width))
    runs = rows.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_run").orderBy(order)
    return _joined(rows.withColumn("_k", F.row_number().over(own)), runs, keys).withColumn(name, (F.col("_base") + F.col("_k") - 1).cast("long")).drop("_run", "_k", "_base")


def running_max(rows: DataFrame, keys: list[str], order: str | list[str], value: str, name: str, width: int = WIDTH, include: bool = True) -> DataFrame:
    """Adds name: the largest value so far along `order` (a column, or several: the first makes the runs) within keys
    (include: the row's own counts)."""
    rows = rows.withColumn("_run", _run(order, width))
    runs = rows.groupBy(*keys, "_run").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_prior", F.max("_top").over(before)).drop("_top")
    own = Window.partitionBy(*keys, "_run").orderBy(*_all(order)).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    return _joined(rows.withColumn("_own", F.max(value).over(own)), runs, keys).withColumn(name, F.greatest("_own", "_prior")).drop("_run", "_own", "_prior")


def running_sum(rows: DataFrame, keys: list[str], order: str | list[str], value: str, name: str, width: int = WIDTH, backwards: bool = False, kind: str = "long") -> DataFrame:
    """Adds name: the sum of value up to and with the row along `order` within keys (backwards: from the row on)."""
    rows = rows.withColumn("_run", _run(order, width))
    runs = rows.groupBy(*keys, "_run").agg(F.sum(value).alias("_all"))
    along = lambda c: F.desc(c) if backwards else F.asc(c)
    before = Window.partitionBy(*keys).orderBy(along("_run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_prior", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    own = Window.partitionBy(*keys, "_run").orderBy(*[along(c) for c in _all(order)]).rowsBetween(Window.unboundedPreceding, 0)
    return _joined(rows.withColumn("_own", F.sum(value).over(own)), runs, keys).withColumn(name, (F.col("_own") + F.col("_prior")).cast(kind)).drop("_run", "_own", "_prior")


def floor_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str], width: int = WIDTH) -> DataFrame:
    """As-of join: each left row with the payload of the right row of its keys with the largest right_on <= left_on.

    No such row: null payload. Both sides meet in runs of the order; what came before a run is one row of it.
    """
    found = F.struct(F.col(right_on), *[F.col(c) for c in payload if c != right_on])
    r = right.select(*keys, F.col(right_on).alias("_at"), found.alias("_found")).withColumn("_run", _run("_at", width)).withColumn("_left", F.lit(None))
    spans = r.groupBy(*keys, "_run").agg(F.max("_found").alias("_top"))
    l = left.withColumn("_at", F.col(left_on)).withColumn("_run", _run("_at", width))  # noqa: E741
    runs = spans.select(*keys, "_run", "_top").unionByName(l.select(*keys, "_run").distinct(), allowMissingColumns=True).groupBy(*keys, "_run").agg(F.max("_top").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_prior", F.last("_top", ignorenulls=True).over(before)).drop("_top")
    packed = l.select(*keys, "_at", "_run", F.struct(*left.columns).alias("_left"))
    both = r.drop("_left").withColumn("_side", F.lit(0)).unionByName(packed.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy(*keys, "_run").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last("_found", ignorenulls=True).over(own)).filter("_side = 1")
    out = _joined(both, runs, keys).withColumn("_best", F.coalesce("_own", "_prior"))
    return out.select("_left.*", *[F.col(f"_best.{c}").alias(c) for c in payload])


def ceiling_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str], width: int = WIDTH) -> DataFrame:
    """As floor_join, with the right row of the smallest right_on >= left_on; right_on is distinct within keys."""
    l = left.withColumn("_want", -F.col(left_on))  # noqa: E741
    r = right.select(*keys, *payload, (-F.col(right_on)).alias("_have"))
    return floor_join(l, r, keys, "_want", "_have", payload, width).drop("_want")


def _within(links):
    """A run's rows sorted, their _at, and the place of each one's next row (its own where that lies in no row of the run)."""
    import numpy as np

    links = links.sort_by("_at")
    at, there, to = links["_at"].to_numpy(), links["_to"].is_valid().to_numpy(), links["_to"].fill_null(0).to_numpy()
    place = np.minimum(np.searchsorted(at, to), len(at) - 1)
    return links, at, np.where(there & (at[place] == to), place, np.arange(len(at)))


def _exits(keys: list[str]):
    def run(links, entries):
        import numpy as np

        if not entries.num_rows:  # a side without rows has no columns either
            return links.select([*keys, "_at", "_to"]).slice(0, 0)
        links, at, nxt = _within(links)
        while not np.array_equal(nxt, far := nxt[nxt]):
            nxt = far
        own = np.searchsorted(at, entries["_at"].to_numpy())
        return links.select([*keys, "_at"]).take(own).append_column("_to", links["_to"].take(nxt[own]))

    return run


def _walked(keys: list[str]):
    def run(links, entries):
        import numpy as np

        if not entries.num_rows:
            return links.select([*keys, "_at"]).slice(0, 0)
        links, at, nxt = _within(links)
        on = np.zeros(len(at), bool)
        for k in np.searchsorted(at, entries["_at"].to_numpy()).tolist():
            while not on[k]:
                on[k], k = True, nxt[k]
        return links.select([*keys, "_at"]).take(np.flatnonzero(on))

    return run


def reached(links: DataFrame, keys: list[str], at: str, to: str, start: str, width: int = WIDTH) -> DataFrame:
    """(keys, at) of the rows on the paths that lead from rows with `start` along to -> at; `at` is distinct within keys,
    `to` is that of a later row, null at an end.

    Where each step depends on the one before, as in rolling a log, every row's next one is found first, by as-of joins
    over all rows. Rows are dealt by runs of `at`. In each, the rows that a path may enter it by learn where it leaves the
    run; these steps of a run are followed by doubling: in round k all entries within 2 to the k steps are known. Then
    each run is walked from its entries. Entries are few where steps are much shorter than a run; where steps are longer,
    they may be as many as the rows, but then paths are short and rounds as few as the logarithm of the runs.
    """
    kind = links.schema[at].dataType
    whole = lambda c: F.col(c).cast("long")
    x = links.select(*keys, whole(at).alias("_at"), F.when(F.col(to) > F.col(at), whole(to)).alias("_to"), F.expr(start).alias("_start"))
    x = cut(x.withColumn("_run", _run("_at", width)))
    first = x.filter("_start").select(*keys, "_at")
    entries = cut(x.filter(F.col("_run") != _run("_to", width)).select(*keys, F.col("_to").alias("_at")).union(first).distinct())

    by, rows = [*keys, "_run"], x.drop("_start")

    def each(f, some, *more):
        some = some.select(*[F.col(c).alias(c) for c in (*keys, "_at")], _run("_at", width).alias("_run"))  # not the columns of rows
        met = rows.groupBy(*by).cogroup(some.groupBy(*by))
        return met.applyInArrow(f(keys), x.select(*keys, "_at", *more).schema)

    jump = cut(each(_exits, entries, "_to").filter("_to is not null"))
    found = cut(first)
    n = found.count()
    while True:
        found = cut(found.unionByName(found.join(jump, [*keys, "_at"]).select(*keys, F.col("_to").alias("_at"))).distinct())
        seen, n = n, found.count()
        if seen == n:
            return each(_walked, found).select(*keys, F.col("_at").cast(kind).alias(at))
        onward = jump.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        jump = cut(jump.join(onward, [*keys, "_to"]).select(*keys, "_at", F.col("_far").alias("_to")))
