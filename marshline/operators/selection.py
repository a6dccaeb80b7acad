"""Exact order statistics, running totals and hash sampling without one big task.

A plain ``percentile``, an unpartitioned window or ``orderBy().limit(n)`` with a
large ``n`` pulls a whole column or group into one task. The operators here
first bracket the wanted ranks with mergeable, fixed-size summaries, then look
only at the few rows inside the bracket, so results stay exact while no task
ever holds more than a small share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline.functions.casting import nan_to_null
from marshline.session import stage

_ALL = "_all"
#: So many different values of one bracket are ranked in one task at most.
BRACKET_ROWS = 1_000_000


def percentile_name(col: str, p: float) -> str:
    return f"{col}_p{round(p * 100):d}"


def exact_percentiles(df: DataFrame, cols: list[str], probs: list[float],
                      keys: list[str] = (), accuracy: int = 4096, few_groups: bool = True, budget: int = BRACKET_ROWS) -> DataFrame:
    """Linear-interpolated percentiles of ``cols``, per group when ``keys`` are given.

    Returns one row per group with columns ``<col>_p<percent>``. Missing values
    are ignored. Meant for possibly huge groups (labels, clusters, the whole
    table). The bracket table has one row per group, column and percentile; it is broadcast
    when ``few_groups`` says the keys come from a small closed set, else joined
    by key, where adaptive execution splits hot keys. Brackets that may hold more than
    ``budget`` different values are narrowed, a pass over the table each time, so that is the most
    that one task ranks.
    """
    groups = list(keys) or [_ALL]
    src = df if keys else df.withColumn(_ALL, F.lit(0))
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    values = (src.select(*groups, F.explode(F.array(*pairs)).alias("e"))
              .select(*groups, "e.feature", "e.value")
              .where(F.col("value").isNotNull() & ~F.isnan("value")))
    inside = ranked_rows(values, brackets(values, groups, probs, accuracy, few_groups, budget), groups, few_groups)
    order = (Window.partitionBy(*groups, "feature", "i").orderBy(F.col("v").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("upper", F.sum("c").over(order)).withColumn("lower", F.col("upper") - F.col("c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lower") <= rank) & (rank < F.col("upper")), F.col("v")))

    frac = F.col("pos") - F.floor("pos")
    found = (
        ranked.groupBy(*groups, "feature", "i", "pos")
        .agg(at(F.floor("pos")).alias("v0"), at(F.ceil("pos")).alias("v1"))
        .withColumn("q", F.when(frac == 0, F.col("v0"))
                    .otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * frac))
    )
    out = found.groupBy(*groups).agg(*[
        F.max(F.when((F.col("feature") == c) & (F.col("i") == i), F.col("q"))).alias(percentile_name(c, p))
        for c in cols for i, p in enumerate(probs)
    ])
    return out if keys else out.drop(_ALL)


def brackets(values: DataFrame, groups: list[str], probs: list[float], accuracy: int, few_groups: bool, budget: int) -> DataFrame:
    """For each group, feature and percentile the wanted rank ``pos`` and bounds ``lo`` and ``hi`` around its value; null bounds: none needed."""
    # Rank error of the summary is at most n / accuracy, so a bracket of twice
    # that on each side always contains the wanted ranks. Small groups skip it.
    margin = 2.0 / accuracy
    grid = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    wide_enough = F.col("n") > accuracy
    out = stage(
        values.groupBy(*groups, "feature")
        .agg(F.count("*").alias("n"), F.percentile_approx("value", grid, accuracy).alias("b"))
        .select(*groups, "feature", "n", F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("i"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("pos"),
                F.when(wide_enough, F.col("b")[i]).alias("lo"),
                F.when(wide_enough, F.col("b")[i + len(probs)]).alias("hi"),
            ) for i, p in enumerate(probs)
        ]))), "brackets")
    most = out.agg(F.max("n")).first()[0] or 0
    if most * 3 * margin <= budget:
        return out.drop("n")
    return narrowed(values, out.drop("n"), groups, few_groups, budget)


def narrowed(values: DataFrame, bounds: DataFrame, groups: list[str], few_groups: bool, budget: int, steps: int = 256) -> DataFrame:
    """``bounds`` with each bracket narrowed until it holds at most ``budget`` different values, or a single one."""
    keys = [*groups, "feature"]
    key = [*keys, "i", "pos", "lo", "hi"]
    settled, open_ = None, bounds
    while True:
        own = F.broadcast(open_) if few_groups else open_
        held = F.when(F.col("value").between(F.col("lo"), F.col("hi")), F.col("value"))
        seen = stage(values.join(own, keys).where(F.col("lo").isNull() | (F.col("value") <= F.col("hi"))).groupBy(*key).agg(
            F.count(F.when(F.col("value") < F.col("lo"), 1)).alias("_below"), F.count(held).alias("_in"), F.approx_count_distinct(held, 0.02).alias("_d"),
            F.percentile_approx(held, [k / steps for k in range(steps + 1)], 16 * steps).alias("_b")), "narrowed")
        wide = F.coalesce((F.col("_d") > budget * 0.9) & (F.col("lo") < F.col("hi")), F.lit(False))  # the count of values is off by a few percent
        done = seen.where(~wide).select(*key)
        settled = done if settled is None else settled.unionByName(done)
        more = seen.where(wide)
        if more.isEmpty():
            return settled
        place = F.floor((F.col("pos") - F.col("_below")) / F.col("_in") * steps).cast("int")
        # One step on each side is more than the summary's error.
        open_ = more.select(*keys, "i", "pos", F.col("_b")[F.greatest(place - 1, F.lit(0))].alias("lo"), F.col("_b")[F.least(place + 2, F.lit(steps))].alias("hi"))


def ranked_rows(values: DataFrame, bounds: DataFrame, groups: list[str], few_groups: bool) -> DataFrame:
    """Per bracket its different values ``v`` with counts ``c``; all values below it are one null."""
    # Rows under the bracket collapse to one counted NULL before any shuffle;
    # rows above it are not needed.
    return (
        values.join(F.broadcast(bounds) if few_groups else bounds, [*groups, "feature"])
        .where(F.col("hi").isNull() | (F.col("value") <= F.col("hi")))
        .groupBy(*groups, "feature", "i", "pos",
                 F.when(F.col("lo").isNull() | (F.col("value") >= F.col("lo")), F.col("value")).alias("v"))
        .agg(F.count("*").alias("c"))
    )


def grouped_medians(df: DataFrame, keys: list[str], cols: list[str], hot_rows: int | None = 1_000_000) -> DataFrame:
    """Exact medians per key for many keys, some of which may be huge.

    The built-in median keeps a key's distinct values in one task. Keys with
    more than ``hot_rows`` rows (one eager count over the key columns) take the
    bracketed route instead, with the same results: NULL and NaN are left out,
    a key without values keeps its row, and NULL is a key like any other.
    ``hot_rows=None`` skips the check where the caller knows a bound.
    """
    # One struct as the key: a missing part equals a missing part in joins too.
    keyed = df.select(F.struct(*keys).alias("_key"), *[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])

    def plain(part: DataFrame) -> DataFrame:
        return part.groupBy("_key").agg(*[F.median(c).alias(c) for c in cols])

    if hot_rows is None:
        return plain(keyed).select("_key.*", *cols)
    hot = stage(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n"), "hot")
    if hot.isEmpty():
        return plain(keyed).select("_key.*", *cols)
    big = exact_percentiles(keyed.join(hot, "_key", "left_semi"), cols, [0.5], ["_key"], few_groups=False)
    named = big.select("_key", *[F.col(percentile_name(c, 0.5)).alias(c) for c in cols])
    # A hot key without any value has no percentile and stays with missing medians.
    return plain(keyed.join(hot, "_key", "left_anti")).unionByName(hot.join(named, "_key", "left")).select("_key.*", *cols)


def percentile_struct(df: DataFrame, cols: list[str], probs: list[float]) -> Column:
    """The whole-table percentiles as one scalar struct, for use in a projection."""
    q = exact_percentiles(df, cols, probs)
    return q.select(F.struct(*q.columns).alias("q")).scalar()


def running_totals(df: DataFrame, order: str, values: list[str], buckets: int = 256) -> DataFrame:
    """Inclusive running sums of ``values`` over ascending distinct ``order``.

    Rows with the same ``order`` are summed first. Rank-balanced cut points
    split the distinct values into buckets that are scanned in parallel; only
    the bucket totals (at most ``buckets`` rows) are accumulated in one place.
    Adds ``<value>_cum`` columns.
    """
    per = stage(df.groupBy(order).agg(*[F.sum(v).alias(v) for v in values]), "totals")  # read three times
    cuts = per.agg(F.percentile_approx(
        order, [i / buckets for i in range(1, buckets)], 10 * buckets)).scalar()
    steps = []
    step = buckets // 2
    while step:
        steps.append(step)
        step //= 2
    with_cuts = per.withColumn("_cuts", cuts)
    bucket = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda acc, s: F.when(F.element_at(F.col("_cuts"), acc + s) <= F.col(order), acc + s).otherwise(acc),
    )
    placed = with_cuts.withColumn("_bucket", bucket).drop("_cuts")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_bucket").agg(*[F.sum(v).alias(v) for v in values])
        .select("_bucket", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}_before") for v in values])
    )
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(offsets), "_bucket")
        .select(order, *values,
                *[(F.col(f"_{v}_before") + F.sum(v).over(inside)).alias(f"{v}_cum") for v in values])
    )


def hash_text(ids: list[str], seed: int) -> Column:
    """Reproducible pseudo-random hex key of a row identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def hash_bucket(ids: list[str], seed: int, buckets: int) -> Column:
    """Pseudo-random bucket number of a row identity."""
    return (F.conv(F.substring(hash_text(ids, seed), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hash_take(df: DataFrame, ids: list[str], want: Column, strata: list[str] = (),
              seed: int = 42, name: str = "taken") -> DataFrame:
    """Flag exactly ``want`` rows (per stratum), lowest hash of ``ids`` first.

    ``ids`` must identify rows; ``want`` may refer to ``total``, the number of
    rows in the stratum. A histogram of hash prefixes finds the prefix where the
    quota is met; only rows with that prefix are ranked. The table is staged
    once with its hash and never sorted or shuffled; the histogram and the cut
    read the hash column alone. Strata are few (labels): their quota table is
    broadcast.
    """
    keys = list(strata)
    hashed = stage(df.withColumn("_h", hash_text(ids, seed)), "hashed")
    prefixed = hashed.select(*keys, "_h").withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (
        prefixed.groupBy(*keys, "_b").agg(F.count("*").alias("c"))
        .withColumns({"cum": F.sum("c").over(upto), "total": F.sum("c").over(whole)})
        .withColumn("want", want.cast("long"))
    )
    cuts = hist.where((F.col("cum") >= F.col("want")) & (F.col("cum") - F.col("c") < F.col("want"))).select(
        *keys, "_b", (F.col("want") - F.col("cum") + F.col("c")).alias("need"))
    near = prefixed.join(F.broadcast(cuts), [*keys, "_b"])  # at most one row per stratum
    edge = (
        near.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h")))
        .where(F.col("rn") == F.col("need")).select(*keys, F.col("_h").alias("_limit"))
    )
    # Hex keys sort below "g", so that limit takes every row.
    last = F.when(F.col("_want") >= F.col("_total"), "g").otherwise(F.coalesce(F.col("_limit"), F.lit("")))
    sizes = hist.groupBy(*keys).agg(F.max("want").alias("_want"), F.max("total").alias("_total"))
    if keys:
        limits = sizes.join(edge, keys, "left").select(*keys, last.alias("_last"))
        marked = hashed.join(F.broadcast(limits), keys)
    else:
        limits = sizes.withColumn("_limit", edge.agg(F.max("_limit")).scalar()).select(last.alias("_last"))
        marked = hashed.withColumn("_last", limits.scalar())
    return marked.withColumn(name, F.col("_h") <= F.col("_last")).drop("_h", "_last")
