"""Running values inside ordered groups of any size.

A plain window puts a whole group into one task, which fails when one episode holds a third of
the data. So the groups are counted first, on their keys alone. Where none is too large, the windows are
plain ones. Otherwise the rows are cut along their order into blocks and written down once; a window runs
per (group, block) and a small table with one row per block carries counts, sums and edge rows across the
cuts. Cuts are order statistics of the full sort key, so a block never decreases along the order,
whatever nulls, ties or outliers there are, and the result is the plain window's.

Each scan over cut groups reads rows that are written down, so a chain of scans does not replay its input.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

BLOCK = "_block"
ROWS_PER_BLOCK = 2_000_000
# A cut lies after every so many sampled rows; a sample of this many rows stands for ROWS_PER_BLOCK.
SAMPLES_PER_BLOCK = 64
# Cuts are looked up in runs of this many.
CUT_RUN = 64


@dataclass(frozen=True)
class Ordered:
    """Rows with a total order inside each group; where groups are cut, ``df`` carries the block column."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cut: bool = False
    #: whether ``df`` is cheap to read twice
    written: bool = False

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df, written=False)

    def rows(self, *drop: str) -> DataFrame:
        return self.df.drop(BLOCK, *drop)

    def scan(
        self,
        *,
        index: str | None = None,
        previous: dict[str, Column] | None = None,
        following: dict[str, Column] | None = None,
        sums: dict[str, Column] | None = None,
        sums_before: dict[str, Column] | None = None,
        last: dict[str, Column] | None = None,
        maxima: dict[str, Column] | None = None,
    ) -> Ordered:
        """Add running columns.

        index      0-based position in the group
        previous   value of an expression in the row before (null at the start)
        following  value in the row after (null at the end)
        sums       running sum up to and with the row
        sums_before  running sum up to the row before (null at the start); the same numbers, bit for bit
        last       latest non-null value up to and with the row
        maxima     running maximum up to and with the row
        """
        previous, following = previous or {}, following or {}
        sums, sums_before, last, maxima = sums or {}, sums_before or {}, last or {}, maxima or {}
        keys, order = list(self.keys), list(self.order)
        rows = Window.partitionBy(*keys, *([BLOCK] if self.cut else [])).orderBy(*order)
        run = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = rows.rowsBetween(Window.unboundedPreceding, -1)

        local: dict[str, Column] = {index: (F.row_number().over(rows) - 1).cast("bigint")} if index else {}
        local |= {n: F.sum(c).over(run) for n, c in sums.items()}
        local |= {n: F.sum(c).over(earlier) for n, c in sums_before.items()}
        local |= {n: F.last(c, ignorenulls=True).over(run) for n, c in last.items()}
        local |= {n: F.max(c).over(run) for n, c in maxima.items()}
        if not self.cut:
            edges = {"_o_prev": (F.lag, previous), "_o_next": (F.lead, following)}
            for name, (step, wanted) in edges.items():
                if wanted:
                    local[name] = step(F.struct(*[c.alias(n) for n, c in wanted.items()])).over(rows)
            out = self.df.withColumns(local)
            out = out.withColumns({n: F.col(name)[n] for name, (_, wanted) in edges.items() for n in wanted})
            return self.with_df(out.drop(*edges))

        base = self.df if self.written else cut_lineage(self.df)
        edge = F.struct(F.lit(1).alias("_there"), *[c.alias(n) for n, c in {**previous, **following}.items()])
        within = {"_o_prev": F.lag(edge).over(rows), "_o_next": F.lead(edge).over(rows)} if previous or following else {}
        ends = {"_o_edge": edge} if within else {}
        # totals of a block are the running values of its last row, so sums across a cut are those of one run
        whole = {f"_o_w_{n}": F.sum(c).over(run) for n, c in sums_before.items()}
        inner = base.withColumns({**local, **within, **ends, **whole, "_o_at": F.row_number().over(rows)})
        at = F.col("_o_at")
        blocks = Window.partitionBy(*keys).orderBy(BLOCK)
        before = blocks.rowsBetween(Window.unboundedPreceding, -1)

        per_block: list[Column] = [F.count(F.lit(1)).alias("_n")]
        carried: list[Column] = [F.sum("_n").over(before).alias("_o_c_n")]
        joined: dict[str, Column] = {}
        if index:
            joined[index] = F.col(index) + F.coalesce(F.col("_o_c_n"), F.lit(0))
        if within:
            per_block += [F.max_by("_o_edge", at).alias("_tail"), F.min_by("_o_edge", at).alias("_head")]
            carried += [F.lag("_tail").over(blocks).alias("_o_c_prev"), F.lead("_head").over(blocks).alias("_o_c_next")]
            joined |= {n: F.coalesce(F.col("_o_prev"), F.col("_o_c_prev"))[n] for n in previous}
            joined |= {n: F.coalesce(F.col("_o_next"), F.col("_o_c_next"))[n] for n in following}
        for n, c in {**sums, **sums_before}.items():
            per_block.append(F.max_by(f"_o_w_{n}" if n in sums_before else n, at).alias(f"_s_{n}"))
            carried.append(F.sum(f"_s_{n}").over(before).alias(f"_o_c_{n}"))
            joined[n] = F.coalesce(F.col(n) + F.col(f"_o_c_{n}"), F.col(n), F.col(f"_o_c_{n}"))
        for n in last:
            per_block.append(F.max_by(n, at).alias(f"_l_{n}"))
            carried.append(F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_o_c_{n}"))
            joined[n] = F.coalesce(F.col(n), F.col(f"_o_c_{n}"))
        for n in maxima:
            per_block.append(F.max(n).alias(f"_m_{n}"))
            carried.append(F.max(f"_m_{n}").over(before).alias(f"_o_c_{n}"))
            joined[n] = F.greatest(F.col(n), F.col(f"_o_c_{n}"))

        carry = inner.filter(F.col(BLOCK) >= 0).groupBy(*keys, BLOCK).agg(*per_block).select(*keys, BLOCK, *carried)
        out = inner.join(carry, [*keys, BLOCK], "left").withColumns(joined)
        helpers = [c for c in out.columns if c.startswith("_o_")]
        return self.with_df(out.drop(*helpers))


def cuts(df: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """(by, _cuts): for each group with more than ``limit`` rows, ascending sort keys to cut it at.

    The cuts are every so many-th of a sample that the rows' hashes choose, so a recomputed task cuts at
    the same places. About half of ``limit`` rows lie between two cuts, however the keys are spread.
    """
    every = max(1, limit // SAMPLES_PER_BLOCK)
    step = max(1, limit // (2 * every))
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).select(*by)
    taken = df.select(*by, *[c for c in order if c not in by])
    if every > 1:
        taken = taken.filter(F.pmod(F.xxhash64(*by, *order), F.lit(every)) == 0)
    sample = taken.join(large, by, "left_semi").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_s"))
    chosen = F.filter("_s", lambda x, i: (i % step == 0) & (i > 0))
    return sample.select(*by, F.array_distinct(chosen).alias("_cuts"))


def _cuts_passed(found: Column, key: Column) -> Column:
    """How many of the ascending cuts are not above the key: first by runs, then inside one run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CUT_RUN).cast("int"))
    run = F.size(F.filter(runs, lambda i: F.get(found, i * CUT_RUN) <= key)) - 1
    inside = F.size(F.filter(F.slice(found, run * CUT_RUN + 1, CUT_RUN), lambda c: c <= key))
    return F.when((F.size(found) == 0) | (run < 0), F.lit(0)).otherwise(run * CUT_RUN + inside)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    split: str,
    rows_per_block: int | None = None,
    sized_by: DataFrame | None = None,
    size_keys: list[str] | None = None,
) -> Ordered:
    """Cut groups with more than ``rows_per_block`` rows along ``order``.

    Where the groups are many and fine, ``sized_by`` (a table with ``split``) and ``size_keys`` (some
    of the keys) count and cut coarser groups instead, along ``split``, which never decreases along
    ``order``: a fine group is never larger than the one it lies in.

    Rows whose sort keys are wholly equal stay together, as no order is defined among them. Rows with a
    null key are no group of the domain; they stay together too.
    """
    limit = rows_per_block or ROWS_PER_BLOCK
    by, along = (size_keys or keys, order) if sized_by is None else (size_keys or keys, [split])
    counted = df if sized_by is None else sized_by
    if large_groups(counted, by, limit).isEmpty():
        return Ordered(df.withColumn(BLOCK, F.lit(-1).cast("bigint")), tuple(keys), tuple(order))
    found = cut_lineage(cuts(counted, by, along, limit))
    block = F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(_cuts_passed(F.col("_cuts"), F.struct(*along)))
    cut = df.join(found, by, "left").withColumn(BLOCK, block.cast("bigint"))
    return Ordered(cut_lineage(cut.drop("_cuts")), tuple(keys), tuple(order), cut=True, written=True)


def ordered_by_blocks(df: DataFrame, keys: list[str], order: list[str], block: Column) -> Ordered:
    """The same with blocks the caller knows: a number from 0 that never decreases along ``order``.

    For long sequences with few or no groups, such as one running sum over all episodes.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    return Ordered(df.withColumn(BLOCK, block.cast("bigint")), tuple(keys), tuple(order), cut=True, written=True)


def streak(o: Ordered, flag: Column, name: str) -> Ordered:
    """Length of the run of rows, up to this one, for which ``flag`` holds; 0 where it does not."""
    o = o.scan(index="_at")
    o = o.scan(last={"_broken": F.when(~F.coalesce(flag, F.lit(False)), F.col("_at"))})
    length = F.col("_at") - F.coalesce(F.col("_broken"), F.lit(-1))
    return o.with_df(o.df.withColumn(name, length).drop("_at", "_broken"))


def islands(o: Ordered, *values: str, name: str = "island") -> Ordered:
    """Number the runs of consecutive rows with equal values, from 1 in each group."""
    before = {f"_was_{v}": F.col(v) for v in values}
    o = o.scan(previous={**before, "_seen": F.lit(1)})
    changed = F.col("_seen").isNull()
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"_was_{v}"))
    o = o.with_df(o.df.withColumn("_changed", changed.cast("bigint")).drop(*before, "_seen"))
    o = o.scan(sums={name: F.col("_changed")})
    return o.with_df(o.df.drop("_changed"))


def large_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys of the groups with more than ``limit`` rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    return counted.select(*keys, F.lit(True).alias("_large"))


def _value_cuts(values: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, _cuts): values that part each group into ranges of about ``limit`` / 2 distinct values at most."""
    every = max(1, limit // SAMPLES_PER_BLOCK)
    step = max(1, limit // (2 * every))
    chosen = values.filter(F.pmod(F.xxhash64(*keys, "_value"), F.lit(every)) == 0).distinct() if every > 1 else values.distinct()
    sample = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_value"))).alias("_s"))
    cut = sample.select(*keys, F.filter("_s", lambda x, i: (i % step == 0) & (i > 0)).alias("_cuts"))
    none = F.array().cast(cut.schema["_cuts"].dataType)
    return values.select(*keys).distinct().join(cut, keys, "left").select(*keys, F.coalesce("_cuts", none).alias("_cuts"))


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: dict[str, float],
    rows_per_block: int | None = None,
    sized_by: DataFrame | None = None,
    also: list[Column] | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, with further aggregates of the same pass.

    A group of ordinary size is aggregated directly. A large one never enters a single buffer: its rows are
    counted per value before the shuffle, the distinct values fall into ranges, cut at a sample of them, and
    only the ranges that hold a wanted position are ranked. A value that many rows have is one row by then.
    ``sized_by`` is a table with the same groups that is cheaper to count than ``df``.

    The large groups and their cuts are broadcast: each stands for more rows than the limit.
    """
    limit = rows_per_block or ROWS_PER_BLOCK
    if not keys:
        df, keys, sized_by = df.withColumn("_all", F.lit(0)), ["_all"], None
    large = large_groups(df if sized_by is None else sized_by, keys, limit)
    if large.isEmpty():
        found = [F.percentile(F.col(value), F.lit(float(p))).alias(name) for name, p in points.items()]
        return df.groupBy(*keys).agg(*(also or []), *found).drop("_all")
    large = F.broadcast(cut_lineage(large))
    marked = df.join(large, keys, "left")
    direct = F.when(F.col("_large").isNull(), F.col(value))
    small = marked.groupBy(*keys).agg(
        *(also or []), *[F.percentile(direct, F.lit(float(p))).alias(name) for name, p in points.items()]
    )

    rows = marked.filter(F.col("_large") & F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"))
    own = cut_lineage(rows.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_times")))
    found = F.broadcast(cut_lineage(_value_cuts(own, keys, limit)))
    ranged = own.join(found, keys).withColumn("_range", _cuts_passed(F.col("_cuts"), F.struct("_value"))).drop("_cuts")
    counts = cut_lineage(ranged.groupBy(*keys, "_range").agg(F.sum("_times").alias("_n")))  # a row per range
    along = Window.partitionBy(*keys).orderBy("_range")
    totals = Window.partitionBy(*keys)
    starts = counts.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        "_n", F.sum("_n").over(totals).alias("_total"),
    )
    holds = F.lit(False)
    for p in points.values():
        low = F.floor((F.col("_total") - 1) * F.lit(float(p)))
        for at in (low, F.least(low + 1, F.col("_total") - 1)):
            holds = holds | ((F.col("_start") <= at) & (at < F.col("_start") + F.col("_n")))
    wanted = starts.filter(holds).select(*keys, "_range", "_start", "_total")
    values = ranged.join(F.broadcast(wanted), [*keys, "_range"])
    inside = Window.partitionBy(*keys, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("_upto", F.col("_start") + F.sum("_times").over(inside)).withColumnRenamed("_value", "_v")
    out = []
    for name, p in points.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, first = F.floor(at), F.col("_upto") - F.col("_times")
        high = F.least(low + 1, F.col("_total") - 1)
        lo = F.max(F.when((first <= low) & (low < F.col("_upto")), F.col("_v")))
        hi = F.max(F.when((first <= high) & (high < F.col("_upto")), F.col("_v")))
        out.append((lo + (hi - lo) * F.max(at - low)).alias(f"_r_{name}"))
    both = small.join(placed.groupBy(*keys).agg(*out), keys, "left")
    both = both.withColumns({n: F.coalesce(n, f"_r_{n}") for n in points})
    return both.drop("_all", *[f"_r_{n}" for n in points])
