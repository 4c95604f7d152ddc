"""Running ("everything before now") aggregates that survive a hot key.

A plain `Window.partitionBy(session).orderBy(seq)` sends a whole session to one
task; if one session holds a third of all events, that task holds a third of the
data. Here every partition is split into fixed seq ranges (chunks):

1. each (key, chunk) is summarised with a partial aggregate (map-side combined);
2. a window over the small chunk table turns the summaries into an exclusive
   prefix per chunk;
3. the prefix is joined back and combined with a window *within* the chunk.

All windows then partition by (key, chunk), whose size is bounded by the chunk
span regardless of skew. Supported: sum, max, bool_or, last / first non-null.

Three shuffles a pass are the price. `by_heat` pays it only for the keys that need
it: keys with more than `HOT_ROWS` rows go the chunked way, all others through
plain windows, which share one shuffle however many passes follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_SPAN = 1 << 24  # seq units per chunk
SPAN_CONF = "shroud.running.span"
HOT_ROWS = 1_000_000  # rows of one key that a single task sorts without trouble
HOT_CONF = "shroud.running.hot_rows"


def plain(df: DataFrame, key: list[str], order: str, specs: list[tuple[str, str, Column, bool]], materialize: bool = False) -> DataFrame:
    """`running` as windows over the whole key, for keys of bounded size."""
    w = Window.partitionBy(*key).orderBy(order)
    frame = {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}
    out = []
    for name, fn, v, inclusive in specs:
        c = {"sum": lambda v: F.coalesce(F.sum(v).over(over), F.lit(0)), "max": lambda v: F.max(v).over(over),
             "bool_or": lambda v: F.coalesce(F.bool_or(v).over(over), F.lit(False)), "last": lambda v: F.last(v, ignorenulls=True).over(over),
             "first": lambda v: F.first(v, ignorenulls=True).over(over)}[fn]
        over = frame[inclusive]
        out.append(c(v).alias(name))
    return df.select("*", *out)


def by_heat(df: DataFrame, key: str, work: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """`work(rows, run)` over all rows of `df`, `run` being `plain` for the rows of keys with at most
    `HOT_ROWS` rows and `running` for the others. `df` is read once to count and once by `work`."""
    limit = int(df.sparkSession.conf.get(HOT_CONF, str(HOT_ROWS)))
    hot = df.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") > limit).select("_hot")
    if hot.isEmpty():
        return work(df, plain)
    hot = cut_lineage(hot)
    is_hot = F.col(key).eqNullSafe(F.col("_hot"))
    return work(df.join(hot, is_hot, "left_anti"), plain).unionByName(work(df.join(hot, is_hot, "left_semi"), running))


def running(df: DataFrame, key: list[str], order: str, specs: list[tuple[str, str, Column, bool]],
            span: int | None = None, materialize: bool = True) -> DataFrame:
    """Adds one column per spec (out, fn, value, inclusive).

    fn in {"sum", "max", "bool_or", "last", "first"}; `inclusive` includes the
    current row, else only strictly earlier rows count. `last`/`first` ignore NULLs.
    """
    if span is None:
        span = int(df.sparkSession.conf.get(SPAN_CONF, str(DEFAULT_SPAN)))
    d = df.withColumn("_ch", F.floor(F.col(order) / F.lit(span)).cast("bigint"))
    vals = []
    for i, (out, fn, col, inc) in enumerate(specs):
        d = d.withColumn(f"_v{i}", col)
        vals.append((i, out, fn, inc))

    def part(i, fn):
        v = F.col(f"_v{i}")
        return {"sum": F.sum(v), "max": F.max(v), "bool_or": F.bool_or(v),
                "last": F.max_by(v, F.when(v.isNotNull(), F.col(order))),
                "first": F.min_by(v, F.when(v.isNotNull(), F.col(order)))}[fn].alias(f"_s{i}")

    summ = d.groupBy(*key, "_ch").agg(*[part(i, fn) for i, _, fn, _ in vals])
    wc = Window.partitionBy(*key).orderBy("_ch").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(i, fn):
        s = F.col(f"_s{i}")
        return {"sum": F.sum(s).over(wc), "max": F.max(s).over(wc), "bool_or": F.bool_or(s).over(wc),
                "last": F.last(s, ignorenulls=True).over(wc), "first": F.first(s, ignorenulls=True).over(wc)}[fn].alias(f"_p{i}")

    pre = summ.select(*key, "_ch", *[prefix(i, fn) for i, _, fn, _ in vals])
    j = d.join(pre, key + ["_ch"], "left")
    w = Window.partitionBy(*key, "_ch").orderBy(order)
    win = {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}

    out_cols = []
    for i, out, fn, inc in vals:
        v, p = F.col(f"_v{i}"), F.col(f"_p{i}")
        ww = win[inc]
        if fn == "sum":
            c = F.coalesce(p, F.lit(0)) + F.coalesce(F.sum(v).over(ww), F.lit(0))
        elif fn == "max":
            c = F.greatest(p, F.max(v).over(ww))
        elif fn == "bool_or":
            c = F.coalesce(F.bool_or(v).over(ww), F.lit(False)) | F.coalesce(p, F.lit(False))
        elif fn == "last":
            c = F.coalesce(F.last(v, ignorenulls=True).over(ww), p)
        else:
            c = F.coalesce(p, F.first(v, ignorenulls=True).over(ww))
        out_cols.append(c.alias(out))
    drop = ["_ch"] + [f"_v{i}" for i, *_ in vals] + [f"_p{i}" for i, *_ in vals]
    out = j.select("*", *out_cols).drop(*drop)
    return cut_lineage(out) if materialize else out
