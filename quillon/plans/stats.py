"""Shared plans: finite filters, moments, group frames, Gram matrices, ranks by value tables, and the finishing step.

Every operator reduces its rows with ordinary aggregates (partial on the map side) and hands the few sufficient
statistics of each `by` group to a closed form, one row per group, so `by=` runs thousands of analyses in a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 65_536  # positions that running sums and lags take together
EDGES = 127  # value ranges that a global order is dealt into


def num(c: str) -> Column:
    return F.col(c).cast("double")


def finite(c: str) -> Column:
    x = num(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clean(df: DataFrame, values: Sequence[str], keep: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The columns used, values as finite doubles; rows that are not complete go."""
    keep = [c for c in dict.fromkeys([*by, *keep]) if c not in values]
    out = df.select(*keep, *(num(c).alias(c) for c in values))
    for c in values:
        out = out.filter(finite(c))
    return out


_PANDAS = {"bigint": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean"}


def finish(stats: DataFrame, by: Sequence[str], fn: Callable[[dict], dict | list[dict]], schema: str) -> DataFrame:
    """Apply the closed form `fn` to each row of statistics; gives the by columns and what fn returns."""
    fields = T.StructType([stats.schema[b] for b in by] + T.StructType.fromDDL(schema).fields)
    names = [f.name for f in fields]
    types = [f.dataType.simpleString() for f in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                made = fn(record)
                head = {b: record[b] for b in by}
                rows += [head | r for r in (made if isinstance(made, list) else [made])]
            out = {}
            for name, kind in zip(names, types, strict=True):
                column = [r.get(name) for r in rows]
                if kind == "double":
                    out[name] = pd.Series([np.nan if v is None else float(v) for v in column], dtype="float64")
                elif kind in _PANDAS:
                    out[name] = pd.array([None if v is None or v is pd.NA else (bool(v) if kind == "boolean" else int(v)) for v in column], dtype=_PANDAS[kind])
                else:
                    out[name] = pd.Series(column, dtype=object)
            yield pd.DataFrame(out)

    return stats.mapInPandas(run, fields)


def one_row(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def frame(df: DataFrame, rows: list[dict] | dict, schema: str) -> DataFrame:
    """A small result made on the driver."""
    rows = rows if isinstance(rows, list) else [rows]
    fields = T.StructType.fromDDL(schema)
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    cast = {"double": float, "bigint": int, "boolean": bool}
    made = [tuple(None if (v := plain(r.get(f.name))) is None else cast.get(f.dataType.simpleString(), lambda x: x)(v) for f in fields) for r in rows]
    return df.sparkSession.createDataFrame(made, fields)


def moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return clean(df, [value], keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"))


def group_stats(df: DataFrame, value: str, group: str, by: Sequence[str] = (), *extra: Column) -> DataFrame:
    """One row per `by`: g, an array of (label, n, mean, var, ...) sorted by label."""
    per = clean(df, [value], [group], by).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), *extra)
    names = [c for c in per.columns if c not in (*by, group)]
    return per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(group).cast("string").alias("label"), *names))).alias("g"))


def dicts(rows) -> list[dict]:
    """Structs of an array column as dicts, whatever pandas made of them."""
    return [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]


def var0(g: dict) -> float:
    return 0.0 if g["var"] is None or g["var"] != g["var"] else float(g["var"])


def gram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, means m0.. and population co-moments c0_0.. of the columns, one stable pass."""
    rows = clean(df, columns, by=by)
    out = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    out += [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    return rows.groupBy(*by).agg(*out)


def unpack_gram(r: dict, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) of a gram row."""
    n = int(r["n"])
    mean = np.array([r[f"m{i}"] if n else 0.0 for i in range(p)], float)
    s = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            s[i, j] = s[j, i] = (r[f"c{i}_{j}"] or 0.0) * n if n else 0.0
    return n, mean, s


def edges_under(value: Column, edges: Sequence[float], equal: bool = False) -> Column:
    """How many of the sorted edges are under value (or equal to it), by halving.

    Plain CASE expressions: a lambda over an array would not be compiled, and hides its columns from the optimizer, which then
    infers a filter on the wrong side of a join on the result.
    """

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        e = F.lit(float(edges[mid]))
        return F.when(value < e if equal else value <= e, pick(low, mid)).otherwise(pick(mid + 1, high))

    return pick(0, len(edges))


def range_of(rows: DataFrame, value: str) -> Column:
    """A column that deals finite values into ordered ranges of about equal counts; the edges are a fixed number of doubles."""
    found = rows.agg(F.percentile_approx(value, [i / (EDGES + 1) for i in range(1, EDGES + 1)], 2000).alias("e")).first()["e"]
    return edges_under(F.col(value), sorted(set(found or [])))


def value_table(df: DataFrame, value: str, group: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, value (and group), cnt, tie (rows with that value), before (rows with a smaller one).

    Rows are first counted by value; without `by` the running count is two-level, within ranges of the value and
    over the ranges' totals, so no task orders everything.
    """
    rows = clean(df, [value], [group] if group else [], by)
    keys = [*by, value] + ([group] if group else [])
    counted = rows.groupBy(*keys).agg(F.count("*").alias("cnt"))
    if by:
        run = F.sum("cnt").over(Window.partitionBy(*by).orderBy(value))
        tie = F.sum("cnt").over(Window.partitionBy(*by, value))
        return counted.withColumn("tie", tie).withColumn("before", run - F.col("tie"))
    dealt = counted.withColumn("_range", range_of(rows, value))
    totals = dealt.groupBy("_range").agg(F.sum("cnt").alias("_n"))
    offsets = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_off"))  # EDGES + 1 rows
    run = F.sum("cnt").over(Window.partitionBy("_range").orderBy(value))
    tie = F.sum("cnt").over(Window.partitionBy("_range", value))
    out = dealt.withColumn("tie", tie).withColumn("_run", run).join(F.broadcast(offsets), "_range")
    return out.withColumn("before", F.col("_run") + F.col("_off") - F.col("tie")).drop("_range", "_run", "_off")


def mid_rank() -> Column:
    return F.col("before") + (F.col("tie") + F.lit(1.0)) / F.lit(2.0)


def ordered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """A gapless position from 0 in the given order. Without `by` it is counted two-level over ranges of the first order column."""
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    key = F.unix_micros(F.col(order[0]).cast("timestamp")) if "timestamp" in df.schema[order[0]].dataType.simpleString() else F.col(order[0])
    rows = df.withColumn("_key", key.cast("double"))
    dealt = rows.withColumn("_range", range_of(rows, "_key"))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(name, inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_off")).drop("_range", "_off", "_key")


def running(rows: DataFrame, sums: dict) -> DataFrame:
    """rows (with pos) plus running sums from the start, two-level over blocks."""
    r = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    for name, c in sums.items():
        r = r.withColumn(f"_x{name}", c)
    totals = r.groupBy("block").agg(*(F.sum(f"_x{n}").alias(f"_t{n}") for n in sums))
    o = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offs = totals.select("block", *(F.coalesce(F.sum(f"_t{n}").over(o), F.lit(0.0)).alias(f"_o{n}") for n in sums))
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(offs, "block")
    for n in sums:
        out = out.withColumn(n, F.sum(f"_x{n}").over(w) + F.col(f"_o{n}"))
    return out.drop("block", *(f"_x{n}" for n in sums), *(f"_o{n}" for n in sums))


def cumulate(rows: DataFrame, by: Sequence[str], order: str, sums: dict) -> DataFrame:
    """rows plus running sums in the given order: windows within `by`, else two-level over pos (see ordered())."""
    if not by:
        return running(rows, sums)
    w = Window.partitionBy(*by).orderBy(order)
    return rows.select("*", *(F.sum(c).over(w).alias(n) for n, c in sums.items()))
