"""Counters, histograms, windowed rates and alerts."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed histogram bounds in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def result_counts(results: DataFrame, result: str = "result") -> DataFrame:
    """(entity_type, level, n) over analysis results in JSON; text that is none, or has no entities, counts nothing."""
    shape = "struct<entities:array<struct<entity_type:string,metadata:map<string,string>>>>"
    rows = results.select(F.explode(F.from_json(result, shape)["entities"]).alias("e"))
    return rows.groupBy("e.entity_type", F.coalesce(F.col("e.metadata")["level"], F.lit("unknown")).alias("level")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: Column, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(le, n): values at or below each bound, cumulative, with infinity as the last; rows are counted once, by bucket."""
    le = F.lit(float("inf"))
    for b in reversed(bounds):
        le = F.when(value <= b, F.lit(b)).otherwise(le)
    own = rows.where(value.isNotNull()).groupBy(le.alias("le")).agg(F.count("*").alias("own"))
    all_bounds = rows.sparkSession.createDataFrame([(float(b),) for b in (*bounds, float("inf"))], "le double")
    spread = F.broadcast(all_bounds).join(own, "le", "left").select("le", F.coalesce("own", F.lit(0)).alias("own"))
    return spread.select("le", F.sum("own").over(Window.orderBy("le")).cast("long").alias("n"))


def window_rates(rows: DataFrame, ts: str, failed: Column, width: str = "5 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows and share of failures by window."""
    out = rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(failed.cast("double")).alias("failure_ratio"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "failure_ratio")


def alerts(rates: DataFrame, ratio: float = 0.05) -> DataFrame:
    return rates.where(F.col("failure_ratio") > ratio)


def percentile_alerts(rows: DataFrame, ts: str, value: Column, share: float = 0.99, above: float = 0.5, width: str = "5 minutes") -> DataFrame:
    """(window_start, p) of windows whose percentile is above a bound; the percentile is exact, with linear interpolation."""
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(F.percentile(value, F.lit(share)).alias("p"))
    return out.where(F.col("p") > above).select(F.col("w.start").alias("window_start"), "p")


def bucket_counts(rows: DataFrame, ts: str, value: Column, bounds: tuple[float, ...] = BUCKETS, width: str = "5 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, keys, own): how many values of a window fall to each bucket, the last without a bound.

    An array of fixed length for each window, added up on the map side; histograms of parts of the rows, or of windows, are
    merged by ``merged_buckets``. Null values are not counted.
    """
    place = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        place = F.when(value <= bounds[k], F.lit(k)).otherwise(place)
    each = [F.sum(F.when(F.col("__place") == k, 1).otherwise(0)) for k in range(len(bounds) + 1)]
    own = rows.where(value.isNotNull()).withColumn("__place", place).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.array(*each).alias("own"))
    return own.select(F.col("w.start").alias("window_start"), *keys, "own")


def merged_buckets(counts: DataFrame, *keys: str | Column) -> DataFrame:
    """Histograms of the same bounds added up by key."""
    sized = counts.select(*keys, F.posexplode("own").alias("__place", "n")).groupBy(*[k if isinstance(k, str) else k for k in keys], "__place").agg(F.sum("n").alias("n"))
    return sized.groupBy(*keys).agg(F.expr("transform(array_sort(collect_list(struct(__place, n))), x -> x.n)").alias("own"))


def bucket_quantile(own: str, share: float, bounds: tuple[float, ...] = BUCKETS) -> Column:
    """The quantile of a histogram, interpolated inside its bucket.

    The first bucket begins at 0, or at its bound if that is not above 0; a quantile in the last bucket, which has no end, is
    the highest bound. Null for a histogram without values.
    """
    total = f"aggregate({own}, 0L, (a, x) -> a + x)"
    edges = "array(" + ", ".join(f"double({b!r})" for b in bounds) + ")"
    start = f"if({bounds[0]!r} > 0, 0D, {edges}[0])"
    step = f"(a, x) -> if(a.done, a, named_struct('done', a.below + x >= {share!r} * a.all and x > 0, 'k', a.k + 1, 'below', if(a.below + x >= {share!r} * a.all and x > 0, a.below, a.below + x), 'own', x, 'all', a.all))"
    zero = f"named_struct('done', false, 'k', -1, 'below', 0L, 'own', 0L, 'all', {total})"
    lo = f"if(a.k = 0, {start}, {edges}[a.k - 1])"
    found = f"case when a.all = 0 then null when a.k >= {len(bounds)} then {edges}[{len(bounds) - 1}] else {lo} + ({edges}[a.k] - {lo}) * ({share!r} * a.all - a.below) / a.own end"
    return F.expr(f"aggregate({own}, {zero}, {step}, a -> {found})")


def quantile_alerts(counts: DataFrame, share: float = 0.99, above: float = 0.5, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Windows of ``bucket_counts`` whose interpolated quantile is above a bound, with the quantile as ``p``."""
    return counts.withColumn("p", bucket_quantile("own", share, bounds)).where(F.col("p") > above)


def counter_increases(samples: DataFrame, ts: str, value: str, series: tuple[str, ...], width: str = "5 minutes") -> DataFrame:
    """(window_start, series, increase) of counters that are read now and then.

    A reading adds what it is above the one before it in its series; one that is below it comes from a counter that began
    anew at 0, and adds all it shows. The first reading of a series adds nothing.
    """
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts, value))
    more = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    out = samples.where(F.col(value).isNotNull()).withColumn("__more", more).groupBy(F.window(ts, width).alias("w"), *series).agg(F.sum("__more").alias("increase"))
    return out.select(F.col("w.start").alias("window_start"), *series, "increase")


def lasting(alerts_: DataFrame, windows: int, seconds: int, *keys: str) -> DataFrame:
    """Alerts that the ``windows - 1`` windows before them raised too, each of so many seconds."""
    at = F.col("window_start").cast("long")
    island = at - F.row_number().over(Window.partitionBy(*keys).orderBy("window_start")) * seconds if keys else at - F.row_number().over(Window.orderBy("window_start")) * seconds
    marked = alerts_.withColumn("__island", island)
    place = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy("window_start"))
    return marked.withColumn("__nth", place).where(F.col("__nth") >= windows).drop("__island", "__nth")


def increase_alerts(rows: DataFrame, ts: str, counted: Column, above: int = 0, width: str = "5 minutes") -> DataFrame:
    """(window_start, increase) of windows with more counted rows than a bound."""
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(F.sum(counted.cast("long")).alias("increase"))
    return out.where(F.col("increase") > above).select(F.col("w.start").alias("window_start"), "increase")


def linear_buckets(start: float, width: float, count: int) -> tuple[float, ...]:
    return tuple(start + width * k for k in range(count))


def pair_key(a: str, b: str) -> Column:
    """One key for two approvers, whichever is named first."""
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def breaker(rows: DataFrame, guard: str, at: str, order: str, most: int = 5, seconds: int = 900) -> DataFrame:
    """Rows with ``state``: a request is allowed, or the one that finds ``most`` allowed in the ``seconds`` before it trips the guard, which is open for as long.

    ``at`` is a time in whole seconds. A guard's requests are one sequence; they pass through a task as a stream, in
    order, and the state is the few times within the span.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("state", T.StringType())])
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, times, until = None, [], -(1 << 62)
        for part in parts:
            out = []
            for g, t in zip(part[guard], part[at], strict=True):
                if g != now:
                    now, times, until = g, [], -(1 << 62)
                if t < until:
                    out.append("open")
                    continue
                times = [x for x in times if x >= t - seconds]
                if len(times) >= most:
                    until = t + seconds
                    out.append("tripped")
                    continue
                times.append(t)
                out.append("allowed")
            yield part.assign(state=out)

    return rows.repartition(guard).sortWithinPartitions(guard, at, order).select(*names).mapInPandas(run, schema)


def top(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def deltas(rows: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """Each value less the one before it."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("delta", F.col(value) - before)


def guarded(rows: DataFrame, ts: str, *keys: str, seconds: int = 3600, most: int = 10) -> DataFrame:
    """Rows with how many of their key came in the span before them, and whether that is within the limit."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return rows.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= most)


def page_after(rows: DataFrame, order: list[str], token: str | None = None, size: int = 20) -> DataFrame:
    """The ``size`` rows (1 to 100) behind the one that a token names, in order, each with the token of the page behind it.

    ``order`` must tell rows apart. The token holds a row's order values; the page is found by a filter on them and a top-k, so
    a late page costs what the first does. Nulls come first.
    """
    size = max(1, min(size, 100))
    out = rows
    if token:
        try:
            at = json.loads(base64.urlsafe_b64decode(token.encode()))
        except ValueError as e:
            raise ValueError("no token of a page") from e
        if not isinstance(at, list) or len(at) != len(order):
            raise ValueError("the token is of another order")
        behind, same = F.lit(False), F.lit(True)
        for name, x in zip(order, at, strict=True):
            own = F.lit(x).cast(rows.schema[name].dataType)
            above = F.col(name).isNotNull() if x is None else F.coalesce(F.col(name) > own, F.lit(False))
            behind = behind | (same & above)
            same = same & F.col(name).eqNullSafe(own)
        out = rows.where(behind)
    parts = [F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r'^\{"x":(.*)\}$', "$1")) for c in order]
    text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    sign = F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")
    return out.withColumn("token", F.regexp_replace(sign, r"\s", "")).orderBy(*order).limit(size)


def csv_line(columns: list[str]) -> Column:
    """A row as a line of CSV that a spreadsheet reads as text alone: a cell that would begin a formula gets an apostrophe first, and quotes are doubled."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    safe = lambda c: F.when(cell(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell(c))).otherwise(cell(c))
    quoted = lambda c: F.when(safe(c).rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe(c))
    return F.concat_ws(",", *[quoted(c) for c in columns])


def page(rows: DataFrame, order: list[str], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` of ``size`` rows (1 to 100) in order."""
    size = max(1, min(size, 100))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)
