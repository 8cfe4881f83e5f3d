"""Rolling, elapsed-time and exponential windows over one series at a time."""

from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quartzline.functions.exprs import micros
from quartzline.session import written


def by_time():
    return Window.partitionBy("series").orderBy("ts")


HOUR_US = 3_600_000_000


def rows(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def rolling(function, x: str, n: int) -> Column:
    """Null until n values are there."""
    return F.when(F.count(x).over(rows(n)) >= n, function(x).over(rows(n)))


def elapsed(hours: int):
    """The last so many hours, without their left end."""
    return Window.partitionBy("series").orderBy(micros(F.col("ts"))).rangeBetween(-(hours * HOUR_US - 1), 0)


def elapsed_zscore(x: str, hours: int) -> Column:
    return zscore_over(elapsed(hours), x, hours)


def zscore_over(w, x: str, hours: int) -> Column:
    """The z-score of x in a window of so many hours, null until enough values are there, 0 where they are all one."""
    least = max(4, min(24, hours // 2))
    sd = F.stddev_samp(x).over(w)
    return F.when(F.count(x).over(w) < least, None).when(sd == 0, 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / sd)


#: Rows of a chunk of a series.
CHUNK = 4096
IN_CHUNK = "OVER (PARTITION BY series, __chunk ORDER BY __rn)"
ALL_OF_CHUNK = "OVER (PARTITION BY series, __chunk ORDER BY __rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def chunked(df: DataFrame, halo: int, chunk: int = CHUNK) -> DataFrame:
    """Adds __rn, the 0-based position in time within the series, __chunk, and __halo. The last halo rows of a chunk are in the next one too, marked so.

    Positions come from the rows of each day and a running sum over the days, one row each, so that no task holds a series. Windows of
    up to halo rows may then be computed by chunk; rows with __halo are to be dropped at the end. Rows of a null series are a series, and rows
    of a null ts come first in theirs.
    """
    d = df.withColumn("__day", F.date_trunc("day", "ts"))
    earlier = Window.partitionBy("series").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = d.groupBy("series", "__day").agg(F.count("*").alias("__n"))
    days = days.select(F.col("series").alias("__of"), F.col("__day").alias("__on"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.row_number().over(Window.partitionBy("series", "__day").orderBy("ts")) - 1
    d = d.join(days, F.col("series").eqNullSafe(F.col("__of")) & F.col("__day").eqNullSafe(F.col("__on"))).withColumn("__rn", at)
    own = F.floor(F.col("__rn") / chunk)
    both = F.when(F.col("__rn") % chunk >= chunk - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return d.select(*df.columns, "__rn", F.explode(both).alias("__chunk"), own.alias("__own")).withColumn("__halo", F.col("__chunk") != F.col("__own")).drop("__own")


def sound(x: str) -> str:
    """x as a double, null where it is NaN or infinite."""
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) <> double('infinity') THEN double({x}) END"


def blocks(n: int) -> list[tuple[int, int]]:
    """(size, rows back) of blocks of 1, 2, 4, ... rows that make up the last n rows, greatest first."""
    out, back = [], 0
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            out.append((1 << k, back))
            back += 1 << k
    return out


def rolling_moments(d: DataFrame, specs: dict[str, tuple[str, tuple[int, ...]]]) -> DataFrame:
    """Adds {name}_mean_{n} and {name}_sd_{n} of the last n rows for each name -> (column, lengths), for a chunked table.

    Sum and squared deviations of 2, 4, 8, ... rows come each from two of the half length, and those of any length from the few blocks that
    make it up, all merged by Chan's formula: nothing is subtracted from running totals, so a value touches only the windows that hold it. NaN,
    infinity and null are missing; a window that holds one, or has fewer than n rows, is null. Equal values have a deviation of exactly 0.
    """
    kept = d.columns
    d = d.selectExpr("*", *[f"{sound(x)} AS {k}__s1" for k, (x, _) in specs.items()], *[f"0D AS {k}__q1" for k in specs])
    size = 1
    while any(2 * size <= max(lengths) for _, lengths in specs.values()):
        names = [k for k, (_, lengths) in specs.items() if 2 * size <= max(lengths)]
        d = d.selectExpr("*", *[f"lag({k}__{v}{size}, {size}) {IN_CHUNK} AS {k}__{v}" for k in names for v in "sq"])
        both = [f"{k}__s{size} + {k}__s AS {k}__s{2 * size}" for k in names]
        both += [f"{k}__q{size} + {k}__q + pow({k}__s - {k}__s{size}, 2) / {2 * size} AS {k}__q{2 * size}" for k in names]
        d = d.selectExpr("*", *both).drop(*[f"{k}__{v}" for k in names for v in "sq"])
        size *= 2
    windows = [(k, n, blocks(n)) for k, (_, lengths) in specs.items() for n in lengths]
    d = d.selectExpr("*", *sorted({f"lag({k}__{v}{s}, {back}) {IN_CHUNK} AS {k}__{v}{s}_{back}" for k, _, parts in windows for s, back in parts if back for v in "sq"}))
    of = lambda k, v, s, back: f"{k}__{v}{s}_{back}" if back else f"{k}__{v}{s}"

    def centre(k, n, parts):
        """The mean, from the first block's: of equal values it is that value to the last digit, which the sum of blocks over n needn't be."""
        first, *others = [f"{of(k, 's', *p)} / {p[0]}" for p in parts]
        return " + ".join([first, *[f"({x} - {first}) * {p[0] / n!r}D" for x, p in zip(others, parts[1:], strict=True)]])

    def squares(k, n, parts):
        out = [of(k, "q", *p) for p in parts]
        if len(parts) > 1:
            out += [f"{p[0]} * pow({of(k, 's', *p)} / {p[0]} - {k}__c{n}, 2)" for p in parts]
        return " + ".join(out)

    total = lambda k, parts: " + ".join(of(k, "s", *p) for p in parts)
    d = d.selectExpr("*", *[f"{centre(k, n, parts)} AS {k}__c{n}" for k, n, parts in windows if len(parts) > 1])
    return d.selectExpr(*kept, *[f"({total(k, parts)}) / {n} AS {k}_mean_{n}" for k, n, parts in windows], *[f"sqrt(({squares(k, n, parts)}) / {n - 1}) AS {k}_sd_{n}" for k, n, parts in windows])


def rolling_sums(d: DataFrame, x: str, name: str, lengths) -> DataFrame:
    """The moments of one column, see rolling_moments."""
    return rolling_moments(d, {name: (x, tuple(lengths))})


def rolling_extremes(d: DataFrame, high: str, low: str, lengths) -> DataFrame:
    """Adds __top_{n} and __bottom_{n}, the greatest high and least low of the last n rows, null until n of them are there, for a chunked table.

    NaN and infinity are missing. The extremes of 2, 4, 8, ... rows come each from two of the half length; a window of any length is covered by two of those.
    """
    kept = d.columns
    d = d.selectExpr("*", f"{sound(high)} AS __h1", f"{sound(low)} AS __l1")
    d = d.selectExpr("*", f"count(__h1 + __l1) {IN_CHUNK} AS __n")
    size = 1
    while 2 * size <= max(lengths):
        d = d.selectExpr("*", f"greatest(__h{size}, lag(__h{size}, {size}) {IN_CHUNK}) AS __h{2 * size}", f"least(__l{size}, lag(__l{size}, {size}) {IN_CHUNK}) AS __l{2 * size}")
        size *= 2
    out = []
    for n in lengths:
        half = 1 << (n.bit_length() - 1)
        full = f"CASE WHEN __n - coalesce(lag(__n, {n}) {IN_CHUNK}, 0) = {n} THEN"
        other = lambda k: f"lag(__{k}{half}, {n - half}) {IN_CHUNK}" if n > half else f"__{k}{half}"  # noqa: B023, E731
        out += [f"{full} greatest(__h{half}, {other('h')}) END AS __top_{n}", f"{full} least(__l{half}, {other('l')}) END AS __bottom_{n}"]
    return d.selectExpr(*kept, *out)


def streamed(df: DataFrame, keys: list[str], order: list[str], start, step, added: T.StructType) -> DataFrame:
    """Adds columns by a recursion over the rows of each key in order; only one key's state is held, and the sort may spill.

    start() gives a key's state; step(state, row as dict) gives the added values and changes the state.
    """
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches):
        at, state = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            inputs = {c: batch.column(c).to_pylist() for c in step.reads}
            out = []
            for i in range(batch.num_rows):
                key = tuple(c[i] for c in columns)
                if state is None or key != at:
                    at, state = key, start()
                out.append(step(state, {c: v[i] for c, v in inputs.items()}))
            more = [pa.array([r[k] for r in out], type=to_arrow_type(f.dataType)) for k, f in enumerate(added.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *added.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Rows of a block of an exponential mean, at most.
BLOCK = 256


def block_rows(alphas) -> int:
    """Rows of a block: so few that the weight that is left of its first value at its end is no less than 1e-250."""
    fade = max(-math.log1p(-a) if a < 1 else math.inf for a in alphas)
    return max(min(BLOCK, int(575 / fade)), 1)


def exponential(df: DataFrame, specs: dict[str, tuple[str, float, int]], carried: DataFrame | None = None) -> DataFrame:
    """Adds exponential means: name -> (column, alpha, least number of values), see exponential_ends."""
    return exponential_ends(df, specs, carried)[0]


def exponential_ends(df: DataFrame, specs: dict[str, tuple[str, float, int]], carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exponential means, and where they stand after the last row: series, rows, then {column}_last (the position of its last value), {column}_n and the means.

    The recursion y = (1 - a) y + a x runs in time order within a series and lets old weight decay over missing values. Inside a block it is a
    running sum: with r the product of what each value leaves of the mean before it, y = v + r (y0 - v + sum of (1 - k) (x - v) / r), where v is
    the block's first value, y0 the mean with it, and k = w / (w + a) for a weight w that decayed over a gap. What a block does to the mean before it
    is a straight line; these lines, one row a block, are put together by doubling. df may be chunked() by block_rows() already; then it keeps __rn and __chunk.

    carried are ends of earlier rows, one row a series, with {column}_last as a position before df's rows or among them: they stand as one more block before
    the first. Of a series without rows in df nothing is returned.
    """
    chunks = "__chunk" in df.columns
    d = df if chunks else chunked(df, 0, block_rows(a for _, a, _ in specs.values())).drop("__halo")
    place = {x: k for k, x in enumerate(sorted({x for x, _, _ in specs.values()}))}
    each = [(j, place[x], a) for j, (x, a, _) in enumerate(specs.values())]
    before = IN_CHUNK.replace(")", " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    kept = d.columns
    d = d.selectExpr("*", *[f"nanvl(double(`{x}`), CAST(NULL AS DOUBLE)) AS __x{k}" for x, k in place.items()])
    here = "CASE WHEN __x{k} IS NOT NULL THEN __rn END"
    found = {"at": f"last_value({here}) IGNORE NULLS {before}", "first": f"min({here}) {ALL_OF_CHUNK}", "v": f"first_value(__x{{k}}) IGNORE NULLS {ALL_OF_CHUNK}", "n": f"count(__x{{k}}) {IN_CHUNK}"}
    d = d.selectExpr("*", f"lead(__rn) {IN_CHUNK} IS NULL AS __ends", *[f"{x.format(k=k)} AS __{name}{k}" for k in place.values() for name, x in found.items()])
    later = "CASE WHEN __x{k} IS NOT NULL AND __at{k} IS NOT NULL THEN {y} ELSE {none}D END"
    faded = lambda a, rows: f"pow({1 - a!r}D, {rows})"
    left = lambda a, rows: f"({faded(a, rows)} / ({faded(a, rows)} + {a!r}D))"
    in_chunk = Window.partitionBy("series", "__chunk").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__r{j}": F.product(F.expr(later.format(k=k, y=left(a, f"__rn - __at{k}"), none=1))).over(in_chunk) for j, k, a in each})
    term = lambda j, k, a: f"{a!r}D / ({faded(a, f'__rn - __at{k}')} + {a!r}D) * (__x{k} - __v{k}) / __r{j}"
    d = d.selectExpr("*", *[f"sum({later.format(k=k, y=term(j, k, a), none=0)}) {IN_CHUNK} AS __s{j}" for j, k, a in each])
    d = written(d, "ewm-blocks")

    ends = [f"CASE WHEN __x{k} IS NOT NULL THEN __rn ELSE __at{k} END AS __last{k}" for k in place.values()]
    lines = d.where("__ends").selectExpr("series", "__chunk", *ends, *[f"__{c}{k}" for k in place.values() for c in ("first", "v", "n")], *[f"__{c}{j}" for j, _, _ in each for c in "rs"])
    if carried is not None:
        lines = lines.unionByName(lines_of(carried, specs, place))
    lines = written(lines, "ewm-lines")
    so_far = "OVER (PARTITION BY series ORDER BY __chunk ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    earlier, by_chunk = so_far.format("1 PRECEDING"), "OVER (PARTITION BY series ORDER BY __chunk)"
    state = {"b": f"last_value(__last{{k}}) IGNORE NULLS {earlier}", "m": f"coalesce(sum(__n{{k}}) {earlier}, 0)", "c": f"first_value(__v{{k}}) IGNORE NULLS {so_far.format('CURRENT ROW')}"}
    c = lines.selectExpr("*", *[f"{x.format(k=k)} AS __{name}{k}" for k in place.values() for name, x in state.items()])
    c = c.selectExpr("*", *[f"CASE WHEN __b{k} IS NULL THEN 0D ELSE {left(a, f'__first{k} - __b{k}')} END AS __k{j}" for j, k, a in each])
    c = c.selectExpr("*", *[f"CASE WHEN __n{k} = 0 THEN 1D ELSE __r{j} * __k{j} END AS __slope{j}" for j, k, _ in each])
    c = c.selectExpr("*", *[f"CASE WHEN __n{k} = 0 THEN 0D ELSE (__v{k} - __c{k}) * (1 - __slope{j}) + __r{j} * __s{j} END AS __offset{j}" for j, k, _ in each])
    size, most = 1, (lines.agg(F.max("__chunk")).first()[0] or 0) + (carried is not None)
    while size <= most:
        c = c.selectExpr("*", *[f"lag(__{y}{j}, {size}) {by_chunk} AS __{y}_{j}" for j, _, _ in each for y in ("slope", "offset")])
        rest = [x for x in c.columns if not x.startswith(("__slope", "__offset"))]
        c = c.selectExpr(*rest, *[f"__slope{j} * coalesce(__slope_{j}, 1D) AS __slope{j}" for j, _, _ in each], *[f"__offset{j} + __slope{j} * coalesce(__offset_{j}, 0D) AS __offset{j}" for j, _, _ in each])
        size *= 2
    begun = [f"CASE WHEN __m{k} > 0 THEN __c{k} + lag(__offset{j}) {by_chunk} END AS __y{j}" for j, k, _ in each]
    c = c.selectExpr("series AS __of", "__chunk AS __in", *[f"__{v}{k}" for k in place.values() for v in "mb"], *[f"__k{j}" for j, _, _ in each], *begun)

    d = d.join(c, F.col("series").eqNullSafe(F.col("__of")) & (F.col("__chunk") == F.col("__in")))
    mean = lambda j, k: f"CASE WHEN __n{k} = 0 THEN __y{j} ELSE __v{k} + __r{j} * (coalesce(__k{j} * (__y{j} - __v{k}), 0D) + __s{j}) END"
    out = [f"CASE WHEN __m{k} + __n{k} >= {max(least, 1)} THEN {mean(j, k)} END AS `{name}`" for (j, k, _), (name, (_, _, least)) in zip(each, specs.items(), strict=True)]
    ends = ["__rn + 1 AS rows", *[f"coalesce({here.format(k=k)}, __at{k}, __b{k}) AS `{x}_last`" for x, k in place.items()], *[f"__m{k} + __n{k} AS `{x}_n`" for x, k in place.items()]]
    ends += [f"CASE WHEN __m{k} + __n{k} > 0 THEN {mean(j, k)} END AS `{name}`" for (j, k, _), name in zip(each, specs, strict=True)]
    last = d.where("__ends").select("series", "__rn", F.struct(*[F.expr(x) for x in ends]).alias("__e"))
    last = last.groupBy("series").agg(F.max_by("__e", "__rn").alias("__e")).select("series", "__e.*")
    return d.selectExpr(*[f"`{x}`" for x in (kept if chunks else df.columns)], *out), last


def lines_of(ends: DataFrame, specs: dict[str, tuple[str, float, int]], place: dict[str, int]) -> DataFrame:
    """Ends of earlier rows as the line of a block of number -1: it has one value, the first mean of each column, and the others stand off from that."""
    first = {}
    for name, (x, _, _) in specs.items():
        first.setdefault(x, name)
    out = [f"`{x}_last` AS __last{k}" for x, k in place.items()]
    out += [f"{e} AS __{c}{k}" for x, k in place.items() for c, e in (("first", f"`{x}_last`"), ("v", f"`{first[x]}`"), ("n", f"`{x}_n`"))]
    for j, (name, (x, _, _)) in enumerate(specs.items()):
        out += [f"1D AS __r{j}", f"coalesce(`{name}` - `{first[x]}`, 0D) AS __s{j}"]
    return ends.selectExpr("series", "-1L AS __chunk", *out)


def rate_limited(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Adds allowed: a request passes while fewer than limit accepted ones lie in the last seconds; rejected ones don't count.

    events: client, us (microseconds), id. A client's events are split at gaps of a window or more, which no accepted time outlives;
    of each stretch only the last limit accepted times are held.
    """
    window = seconds * 1_000_000
    w = Window.partitionBy("client").orderBy("us", "id")
    d = events.select("client", F.col("us").cast("long").alias("us"), "id")
    d = d.withColumn("__cut", F.coalesce((F.col("us") - F.lag("us").over(w) >= window).cast("long"), F.lit(0)))
    d = d.withColumn("__stretch", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def step(held: deque, row: dict) -> list:
        while held and held[0] <= row["us"] - window:
            held.popleft()
        allowed = len(held) < limit
        if allowed:
            held.append(row["us"])
        return [allowed]

    step.reads = ["us"]
    out = streamed(d, ["client", "__stretch"], ["us", "id"], deque, step, T.StructType([T.StructField("allowed", T.BooleanType())]))
    return out.select(F.col("client").cast("string").alias("client"), "us", F.col("id").cast("long").alias("id"), "allowed")
