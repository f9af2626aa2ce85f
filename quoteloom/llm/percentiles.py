"""Exact percentiles per group by distributed multi-select over sorted runs.

Every task sorts what it reads into runs: per group (and load) the distinct values with their counts. Runs are
the mergeable state: those of single loads or days are stored and put together by union. To select, every run
proposes the median of its values still in question; the median of the proposals, weighted by how many values
stand behind each, becomes the pivot; values are counted three ways against it and the ruled-out range is dropped.
When few values are left they are ranked. The error bound is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.session import checkpointed

#: Rows that a task sorts together into runs.
RUN_ROWS = 500_000
#: Values still in question at which a group's are ranked instead of split again.
FEW = 512
#: Parts of the runs whose proposals are put to a median first.
PARTS = 32


def value_runs(rows: DataFrame, groups: list[str], value: str, *, run_rows: int = RUN_ROWS) -> DataFrame:
    """(groups, values array<double>, counts array<long>): each task's values in runs of at most ``run_rows`` rows.

    Nulls and NaN are left out; null group keys form a group. No shuffle.
    """
    schema = rows.schema

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(parts)
            counted = pdf.groupby([*groups, "_v"], dropna=False, sort=True).size()
            keys = counted.index.to_frame(index=False)
            keys["_n"] = counted.to_numpy()
            out = [(*(k if isinstance(k, tuple) else (k,)), g["_v"].to_numpy(), g["_n"].to_numpy()) for k, g in keys.groupby(groups if len(groups) > 1 else groups[0], dropna=False, sort=False)]
            got = pd.DataFrame(out, columns=[*groups, "run_values", "run_counts"])
            for g in groups:
                got[g] = got[g].astype(object).where(got[g].notna(), None)
            return got

        parts, n = [], 0
        for pdf in batches:
            parts.append(pdf)
            n += len(pdf)
            if n >= run_rows:
                yield flush(parts)
                parts, n = [], 0
        if n:
            yield flush(parts)

    kinds = ", ".join(f"`{g}` {schema[g].dataType.simpleString()}" for g in groups)
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("_v"))
    return kept.mapInPandas(runs, f"{kinds}, run_values array<double>, run_counts array<long>")


def merged_runs(runs: DataFrame, groups: list[str]) -> DataFrame:
    """Stored runs of finer groups put together by ``groups``, as far as they lie in one batch: fewer and longer runs of the same values."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(groups if len(groups) > 1 else groups[0], dropna=False, sort=False):
                v, n = np.concatenate(part["run_values"].to_list()), np.concatenate(part["run_counts"].to_list())
                values, place = np.unique(v, return_inverse=True)
                key = key if isinstance(key, tuple) else (key,)
                out.append((*[None if pd.isna(k) else k for k in key], values, np.bincount(place, weights=n).astype(np.int64)))
            if out:
                yield pd.DataFrame(out, columns=[*groups, "run_values", "run_counts"])

    kinds = ", ".join(f"`{g}` {runs.schema[g].dataType.simpleString()}" for g in groups)
    return runs.select(*groups, "run_values", "run_counts").mapInPandas(merge, f"{kinds}, run_values array<double>, run_counts array<long>")


def _same(a: str, b: str, groups: list[str]) -> list[Column]:
    return [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]


def _each_run(groups: list[str], work, columns: list[str]):
    """A mapInPandas function that gives every run and its group's targets to ``work`` and stacks what it returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, cols = [], []
            for k, (values, counts, targets) in enumerate(zip(pdf["run_values"], pdf["run_counts"], pdf["targets"])):
                t = {f: np.array([x[f] for x in targets]) for f in targets[0].asDict()} if hasattr(targets[0], "asDict") else {f: np.array([x[f] for x in targets]) for f in targets[0]}
                got = work(np.asarray(values, dtype=float), np.asarray(counts, dtype=np.int64), t)
                at.append(np.full(len(got[0]), k))
                cols.append(got)
            if not at:
                continue
            place = np.concatenate(at)
            out = {g: pdf[g].to_numpy()[place] for g in groups}
            out |= {c: np.concatenate([x[i] for x in cols]) for i, c in enumerate(columns)}
            yield pd.DataFrame(out)

    return run


def _at_rank(values: np.ndarray, cum: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The values at ranks from 0, of a run with cumulative counts."""
    return values[np.minimum(np.searchsorted(cum, rank, side="right"), len(values) - 1)]


def _inside(values: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """The places of a run's values between two exclusive bounds; a bound of NaN is none, so that infinities are values like others."""
    lo = np.where(np.isnan(t["lo"]), 0, np.searchsorted(values, t["lo"], "right"))
    return lo, np.where(np.isnan(t["hi"]), len(values), np.searchsorted(values, t["hi"], "left"))


def _split(values, counts, t):
    cum = np.cumsum(counts)
    upto = lambda i: np.where(i > 0, cum[np.maximum(i, 1) - 1], 0)
    lo, hi = (upto(i) for i in _inside(values, t))
    left, right = upto(np.searchsorted(values, t["pivot"], "left")), upto(np.searchsorted(values, t["pivot"], "right"))
    less, equal, more = np.maximum(left - lo, 0), right - left, np.maximum(hi - right, 0)
    return t["t"], less, equal, more, _at_rank(values, cum, lo + less // 2), _at_rank(values, cum, right + more // 2)


def _first(p):
    def work(values, counts, t):
        cum = np.cumsum(counts)
        n = cum[-1]
        return np.arange(len(p)), np.full(len(p), n), _at_rank(values, cum, (p * (n - 1)).astype(np.int64))

    return work


def _left(values, counts, t):
    parts = list(zip(*_inside(values, t)))
    return (np.concatenate([np.full(max(b - a, 0), x) for (a, b), x in zip(parts, t["t"])]), np.concatenate([values[a:b] for a, b in parts]), np.concatenate([counts[a:b] for a, b in parts]))


def _next(values, counts, t):
    i = np.searchsorted(values, t["found"], "right")
    ok = i < len(values)
    return t["t"][ok], values[i[ok]]


def multi_select(runs: DataFrame, groups: list[str], percentiles: list[float], *, few: int = FEW) -> DataFrame:
    """(groups, percentile, value, n_values): the percentiles by linear interpolation, exact, of all runs together.

    ``runs`` may be the union of any stored runs; further columns are ignored. Groups without values give no row.
    The rounds' state is a row a group and percentile, kept as a written table; nothing is collected.
    """
    asked, groups = groups, [f"group{k}_" for k in range(len(groups))]  # no group clashes with the state's own columns
    runs = runs.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(asked, groups)], "run_values", "run_counts")
    kinds = ", ".join(f"{x} {runs.schema[x].dataType.simpleString()}" for x in groups)
    runs = checkpointed(runs.select(*groups, "run_values", "run_counts"))
    p = np.array(percentiles, dtype=float)
    one = F.array(F.struct(F.lit(0).alias("t")))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in p]), F.col("t") + 1)
    none = F.lit(float("nan"))
    first = runs.withColumn("targets", one).mapInPandas(_each_run(groups, _first(p), ["t", "n", "proposal"]), f"{kinds}, t int, n long, proposal double")
    # a weighted median of the weighted medians of parts of the runs: no task holds the proposals of all runs
    pivot = lambda c, n: F.percentile(c, 0.5, F.col(n)).alias(c)
    part = F.pmod(F.xxhash64("proposal", "n"), F.lit(PARTS)).alias("part_")
    state = first.groupBy(*groups, "t", part).agg(F.sum("n").alias("n"), pivot("proposal", "n")).groupBy(*groups, "t").agg(F.sum("n").alias("total"), F.percentile("proposal", 0.5, F.col("n")).alias("pivot"))
    state = state.select(
        *groups, "t", "total", F.floor((F.col("total") - 1) * share).cast("long").alias("k"), none.alias("lo"), none.alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("total").alias("live"), "pivot", F.lit(None).cast("double").alias("found"), F.lit(None).cast("long").alias("upto"),
    )
    state = checkpointed(state)
    names = state.columns
    busy = F.col("found").isNull() & (F.col("live") > few)
    while state.where(busy).limit(1).count():
        targets = state.where(busy).groupBy(*groups).agg(F.collect_list(F.struct("t", "lo", "hi", "pivot")).alias("targets"))
        joined = runs.alias("r").join(targets.alias("s"), _same("r", "s", groups)).select("r.*", "s.targets")
        split = joined.mapInPandas(_each_run(groups, _split, ["t", "less", "equal", "more", "left", "right"]), f"{kinds}, t int, less long, equal long, more long, left double, right double")
        sums = [F.sum("less").alias("less"), F.sum("equal").alias("equal"), F.sum("more").alias("more"), pivot("left", "less"), pivot("right", "more")]
        part = F.pmod(F.xxhash64("left", "right", "less", "more"), F.lit(PARTS)).alias("part_")
        counted = split.groupBy(*groups, "t", part).agg(*sums).groupBy(*groups, "t").agg(*sums)
        both = state.alias("a").join(counted.alias("b"), [*_same("a", "b", groups), F.col("a.t") == F.col("b.t")], "left").select("a.*", "less", "equal", "more", "left", "right")
        split_here = F.col("less").isNotNull()
        below = F.col("k") < F.col("below") + F.col("less")
        hit = ~below & (F.col("k") < F.col("below") + F.col("less") + F.col("equal"))
        pick = lambda was, low, same, high: F.when(~split_here, F.col(was)).when(below, low).when(hit, same).otherwise(high).alias(was)
        state = checkpointed(both.select(
            *groups, "t", "total", "k",
            pick("lo", F.col("lo"), F.col("lo"), F.col("pivot")),
            pick("hi", F.col("pivot"), F.col("hi"), F.col("hi")),
            pick("below", F.col("below"), F.col("below"), F.col("below") + F.col("less") + F.col("equal")),
            pick("live", F.col("less"), F.lit(0), F.col("more")),
            pick("pivot", F.col("left"), F.col("pivot"), F.col("right")),
            pick("found", F.lit(None), F.col("pivot"), F.lit(None)),
            pick("upto", F.lit(None), F.col("below") + F.col("less") + F.col("equal"), F.lit(None)),
        ).select(*names))
    # the few left are ranked: at most ``few`` values a group and percentile
    open_ = state.where("found is null").groupBy(*groups).agg(F.collect_list(F.struct("t", "lo", "hi")).alias("targets"))
    joined = runs.alias("r").join(open_.alias("s"), _same("r", "s", groups)).select("r.*", "s.targets")
    rest = joined.mapInPandas(_each_run(groups, _left, ["t", "v", "n"]), f"{kinds}, t int, v double, n long").groupBy(*groups, "t", "v").agg(F.sum("n").alias("n"))
    ranked = rest.withColumn("through", F.sum("n").over(Window.partitionBy(*groups, "t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    last = state.alias("a").join(ranked.alias("b"), [*_same("a", "b", groups), F.col("a.t") == F.col("b.t"), F.col("a.found").isNull(), F.col("k") < F.col("below") + F.col("through"), F.col("k") >= F.col("below") + F.col("through") - F.col("n")], "left")
    state = checkpointed(last.select(*[F.col(f"a.{x}") for x in [*groups, "t", "total", "k"]], F.coalesce("found", "v").alias("found"), F.coalesce("upto", F.col("below") + F.col("through")).alias("upto")))
    # where the rank falls between two values, the next one up
    need = state.where(F.col("k") + 1 >= F.col("upto")).where(F.col("k") + 1 < F.col("total")).groupBy(*groups).agg(F.collect_list(F.struct("t", "found")).alias("targets"))
    joined = runs.alias("r").join(need.alias("s"), _same("r", "s", groups)).select("r.*", "s.targets")
    above = joined.mapInPandas(_each_run(groups, _next, ["t", "v"]), f"{kinds}, t int, v double").groupBy(*groups, "t").agg(F.min("v").alias("above"))
    both = state.alias("a").join(above.alias("b"), [*_same("a", "b", groups), F.col("a.t") == F.col("b.t")], "left")
    at = F.element_at(F.array(*[F.lit(float(x)) for x in p]), F.col("a.t") + 1)
    part = (F.col("total") - 1) * at - F.col("k")
    return both.select(*[F.col(f"a.{x}").alias(y) for x, y in zip(groups, asked)], at.alias("percentile"), F.when((part > 0) & (F.col("above") != F.col("found")) & (F.col("found") > float("-inf")), F.col("found") + part * (F.col("above") - F.col("found"))).otherwise(F.col("found")).alias("value"), F.col("total").alias("n_values"))
