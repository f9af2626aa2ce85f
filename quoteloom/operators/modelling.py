"""Model matrices, splits, level models, exact ridge, metrics and level drift, as aggregates and joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.scalars import hash_uniform, nan_to_null
from quoteloom.operators.quantiles import exact_quantiles, median, with_quantiles
from quoteloom.operators.tables import top_per
from quoteloom.session import checkpointed


def model_matrix(quotes: DataFrame, risks: DataFrame, *, quoted_only: bool = True, reference_year: int = 2026) -> DataFrame:
    """Quotes joined to risks (one row a risk) with derived features and whole weeks since the earliest date of all quotes.

    Rows without a date or risk are left out; a risk that is missing leaves its features null.
    """
    q = quotes.withColumn("premium", nan_to_null(F.col("premium"))).where("collected_on is not null and risk_id is not null")
    origin = q.agg(F.min("collected_on").alias("origin_"))
    q = q.crossJoin(F.broadcast(origin)).withColumn("week", F.floor(F.datediff("collected_on", "origin_") / 7).cast("int")).drop("origin_")  # one row
    if quoted_only:
        q = q.where("quoted and premium > 0").withColumn("log_premium", F.ln("premium"))
    sums = F.greatest(F.coalesce("buildings_sum_insured", F.lit(0.0)) + 1.4 * F.coalesce("contents_sum_insured", F.lit(0.0)), F.lit(10_000.0))
    return q.join(risks, "risk_id", "left").withColumns({
        "log_sum_insured": F.ln(sums / 250_000.0),
        "log_excess": F.log1p(F.when(F.col("voluntary_excess") >= 0, F.col("voluntary_excess")) / 250.0),
        "property_age": F.greatest(F.lit(reference_year) - F.col("year_built"), F.lit(0)),
    })


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column per level of a closed domain; unseen levels and nulls are zero everywhere."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


def temporal_split(df: DataFrame, *, holdout_weeks: int) -> DataFrame:
    """``df`` with ``split``: the last weeks that occur are held out. Fewer weeks than that plus one is an error on use."""
    weeks = df.select("week").distinct()
    few = F.raise_error(F.lit("too few weeks to hold any out")).cast("int")
    cut = weeks.withColumn("r", F.row_number().over(Window.orderBy(F.col("week").desc()))).agg(F.max("r").alias("n_"), F.max(F.when(F.col("r") == holdout_weeks, F.col("week"))).alias("cut_")).select(F.when((F.col("n_") > 0) & (F.col("n_") <= holdout_weeks), few).otherwise(F.col("cut_")).alias("cut_"))  # a row a week
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col("week") >= F.col("cut_"), "holdout").otherwise("train")).drop("cut_")


def spatial_split(df: DataFrame, *, holdout_frac: float, area: str = "outcode", seed: int = 0) -> DataFrame:
    """``df`` with ``split``: max(1, round(n * fraction)) areas, chosen by hash, are held out."""
    areas = df.where(F.col(area).isNotNull()).select(area).distinct()
    w = Window.orderBy(hash_uniform(F.lit(seed), F.col(area)), area)  # a row an outcode: three thousand at most
    held = areas.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(areas.agg(F.greatest(F.lit(1), F.round(F.count("*") * holdout_frac)).alias("n_")))).where(F.col("r") <= F.col("n_")).select(F.col(area).alias("area_"))
    return df.join(F.broadcast(held), F.col(area) == F.col("area_"), "left").withColumn("split", F.when(F.col("area_").isNotNull(), "holdout").otherwise("train")).drop("area_")


def rolling_windows(weeks: list[int], *, window: int, step: int = 1):
    """(train weeks, next week) of a rolling origin."""
    weeks = sorted(weeks)
    for k in range(window, len(weeks), step):
        yield weeks[k - window : k], weeks[k]


def level_model(train: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with y_pred: the mean log premium of their group in ``train``, else of all of it."""
    overall = train.agg(F.avg("log_premium").alias("all_"))
    if not by:
        return rows.crossJoin(F.broadcast(overall)).withColumn("y_pred", F.col("all_")).drop("all_")  # one row
    means = train.groupBy(*by).agg(F.avg("log_premium").alias("own_"))
    return rows.join(means, by, "left").crossJoin(F.broadcast(overall)).withColumn("y_pred", F.coalesce("own_", "all_")).drop("own_", "all_")


def last_week(rows: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.agg(F.max("week").alias("last_")))).where("week = last_").drop("last_")  # one row


def last_level_model(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with y_pred: the last week's median by brand and channel, else by brand, else of the market."""
    last = checkpointed(last_week(train).select("brand", "channel", "log_premium"))
    level = lambda keys, name: exact_quantiles(last, keys, {name: median(F.col("log_premium"))}, written=False)
    both, brand, market = level(["brand", "channel"], "a_"), level(["brand"], "b_"), level([], "c_")
    return rows.join(both, ["brand", "channel"], "left").join(brand, "brand", "left").crossJoin(F.broadcast(market)).withColumn("y_pred", F.coalesce("a_", "b_", "c_")).drop("a_", "b_", "c_")


def recalibrated_levels(levels: DataFrame, fresh: DataFrame) -> DataFrame:
    """The level table (brand, channel, level) with the latest week's medians upserted."""
    new = exact_quantiles(last_week(fresh), ["brand", "channel"], {"level": median(F.col("log_premium"))})
    return levels.join(new.select("brand", "channel"), ["brand", "channel"], "left_anti").unionByName(new)


def category_levels(train: DataFrame, categories: list[str]) -> dict[str, list[str]]:
    """The values of closed domains that ``train`` holds, by name."""
    if not categories:
        return {}
    row = train.agg(*[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in categories]).first()
    return {c: row[c] for c in categories}


def encoded(features: list[str], levels: dict[str, list[str]]) -> list[Column]:
    """The design, alike for fitting and predicting: numbers (0 where missing), whether each is missing, a 0/1 column a level."""
    x = [nan_to_null(F.col(f"`{f}`").cast("double")) for f in features]
    hot = [F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("double"), F.lit(0.0)) for c, vs in levels.items() for v in vs]
    return [*[F.coalesce(c, F.lit(0.0)) for c in x], *[c.isNull().cast("double") for c in x], *hot]


def moments(rows: DataFrame, columns: list[Column], target: str, key: Column) -> dict[str, np.ndarray]:
    """By key: sums of products of (1, columns, target) over all rows with a target. Keys and columns are few, so the sums go to the driver."""
    y = nan_to_null(F.col(f"`{target}`").cast("double"))
    sent = rows.where(y.isNotNull()).select(key.alias("key"), F.array(F.lit(1.0), *columns, y).alias("x"))

    def products(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[order]
            ends = np.searchsorted(at[order], np.arange(len(coded.dictionary) + 1))
            for k, name in enumerate(coded.dictionary.to_pylist()):
                part = x[ends[k] : ends[k + 1]]
                sums[name] = sums.get(name, 0.0) + part.T @ part
        yield pa.RecordBatch.from_pydict({"key": pa.array(sums.keys(), pa.string()), "m": pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))})

    def added(pdf):
        return pdf.iloc[:1].assign(m=[np.sum(np.stack(pdf["m"].to_list()), axis=0)])

    schema = "key string, m array<double>"
    size = len(columns) + 2
    return {r.key: np.array(r.m).reshape(size, size) for r in sent.mapInArrow(products, schema).groupBy("key").applyInPandas(added, schema).collect()}


class Ridge:
    """Closed-form ridge on z-scores, intercept unpenalised: one pass for sums of products, one small solve on the driver.

    ``categories`` are one-hot, and so is ``group``, by whose values the sums are kept. A missing number is 0 with an
    indicator; one that was never missing in training stands at its mean. Unseen levels and nulls are zero everywhere.
    """

    def __init__(self, features: list[str], alpha: float = 1.0, categories: list[str] | None = None, group: str | None = None):
        self.features, self.alpha, self.categories, self.group = features, alpha, categories or [], group

    def fit(self, train: DataFrame, target: str = "log_premium") -> Ridge:
        self.levels = category_levels(train, self.categories)
        key = F.coalesce(F.col(self.group).cast("string"), F.lit("")) if self.group else F.lit("")
        return self.solve(moments(train, encoded(self.features, self.levels), target, key))

    def solve(self, by_group: dict[str, np.ndarray]) -> Ridge:
        if not by_group:
            raise ValueError("no rows to fit on")
        self.by_group = by_group
        names = sorted(g for g in by_group if g) if self.group else []
        total = sum(by_group.values())
        size, k = len(total), len(names)
        at = [*range(size - 1), size + k - 1]
        m = np.zeros((size + k, size + k))
        m[np.ix_(at, at)] = total
        for j, g in enumerate(names, size - 1):
            m[j, at] = m[at, j] = by_group[g][0]
            m[j, j] = by_group[g][0, 0]
        self.intercept, b = self.weights(m)
        f = len(self.features)
        self.coefficients, self.all_coefficients, self.of_group = b[:f], b[: size - 2], dict(zip(names, b[size - 2 :].tolist()))
        return self

    def weights(self, m: np.ndarray) -> tuple[float, np.ndarray]:
        """(intercept, coefficient of each column) from sums of products of (1, columns, target)."""
        n, p, f = m[0, 0], len(m) - 2, len(self.features)
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
        sd = np.where(sd < 1e-12, 1.0, sd)
        b = np.linalg.solve(n * cov[:p, :p] / np.outer(sd, sd) + self.alpha * np.eye(p), n * cov[:p, p] / sd) / sd
        intercept = float(mean[p] - b @ mean[:p])
        b[f : 2 * f] = np.where(mean[f : 2 * f] > 0, b[f : 2 * f], b[:f] * mean[:f])
        return intercept, b

    def prediction(self) -> Column:
        y = F.lit(float(self.intercept))
        for c, b in zip(encoded(self.features, self.levels), self.all_coefficients):
            y = y + c * F.lit(float(b))
        if self.of_group:
            y = y + F.coalesce(F.create_map(*[F.lit(x) for g in self.of_group.items() for x in g])[F.col(self.group).cast("string")], F.lit(0.0))
        return y

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("y_pred", self.prediction())


def rolling_last_level(train: DataFrame, hold: DataFrame) -> DataFrame:
    """``hold`` with y_pred of the last-level model refreshed weekly: each week is predicted by the latest week before it of its brand and channel.

    What a level is after a week has come in does not depend on the model, so the refresh is an as-of lookup over the table of
    weekly medians: those of the last training week and of the held-out weeks. A brand and channel without one takes the last
    training week's level of its brand, else of the market, as the blind model does.
    """
    columns = ["brand", "channel", "week", "log_premium"]
    seen = last_week(train).select(*columns).unionByName(hold.select(*columns))
    medians = exact_quantiles(seen, ["brand", "channel", "week"], {"level_": median(F.col("log_premium"))})
    before = Window.partitionBy("brand", "channel").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)  # a row a week
    weeks = hold.select("brand", "channel", "week").distinct()
    known = medians.join(weeks.withColumn("asked_", F.lit(True)), ["brand", "channel", "week"], "left").withColumn("latest_", F.last("level_", ignorenulls=True).over(before))
    latest = known.where("asked_").select("brand", "channel", "week", "latest_")
    blind = last_level_model(train, hold)
    return blind.join(latest, ["brand", "channel", "week"], "left").withColumn("y_pred", F.coalesce("latest_", "y_pred")).drop("latest_")


def rolling_comparison(matrix: DataFrame, *, holdout_weeks: int) -> DataFrame:
    """Scored rows of the held-out weeks under two regimes from one fit: ``blind``, and ``rolling``, refreshed by each week once it is over.

    Models that have nothing to refresh score the same in both.
    """
    split = temporal_split(matrix, holdout_weeks=holdout_weeks)
    train, hold = split.where("split = 'train'"), split.where("split = 'holdout'").drop("split")
    keep = lambda df, approach, regime: df.select("risk_id", "brand", "channel", "week", F.col("log_premium").alias("y_true"), "y_pred", F.lit(approach).alias("approach"), F.lit(regime).alias("regime"))
    means = level_model(train, hold, ["brand"])
    parts = [keep(means, "brand_geomean", "blind"), keep(means, "brand_geomean", "rolling"), keep(last_level_model(train, hold), "brand_last_level", "blind"), keep(rolling_last_level(train, hold), "brand_last_level", "rolling")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_week_identical(per_week: DataFrame, *, tolerance: float = 1e-9) -> DataFrame:
    """(approach, week, spread, identical): whether the regimes agree on the first held-out week, as they must. ``per_week``: approach, regime, week, mape."""
    first = per_week.join(F.broadcast(per_week.agg(F.min("week").alias("first_"))), F.col("week") == F.col("first_"))  # one row
    both = first.groupBy("approach", "week").agg(F.count_distinct("regime").alias("n_"), (F.max("mape") - F.min("mape")).alias("spread"))
    return both.where("n_ > 1").select("approach", "week", "spread", (F.col("spread") <= tolerance).alias("identical"))


def leaderboard(scored: DataFrame, by: list[str]) -> DataFrame:
    """Metrics rounded to two places, the best median error first within each split."""
    m = premium_metrics(scored, by)
    return m.select(*by, *[F.round(c, 2).alias(c) for c in ("mdape", "rmsle", "bias", "within_10pct")]).orderBy(*[c for c in by if c != "approach"], "mdape", "approach")


def additivity_gap(board: DataFrame, additive: str, flexible: str) -> DataFrame:
    """(split, both median errors, gap_pct_points) of splits that have both approaches: what the additive form costs, or gains."""
    at = lambda name: F.max(F.when(F.col("approach") == name, F.col("mdape")))
    both = board.groupBy("split").agg(at(additive).alias(f"{additive}_mdape"), at(flexible).alias(f"{flexible}_mdape"))
    return both.where(F.col(f"{additive}_mdape").isNotNull() & F.col(f"{flexible}_mdape").isNotNull()).withColumn("gap_pct_points", F.round(F.col(f"{additive}_mdape") - F.col(f"{flexible}_mdape"), 2))


class TrendAdjusted:
    """An inner model, fitted with its week, with the level change past the last trained week added to it.

    ``inner``: (train, rows) -> rows with y_pred. The level series are those of residuals of inner models without week, each
    fold of risks predicted by a fit on the others. Rows past the last week are given to the inner model as of that week;
    then the brand's offset and forward change are added. ``recalibrate`` moves the offsets by what newly observed weeks leave.
    """

    def __init__(self, inner, *, folds: int = 3, anchor_rows: float = 50.0, anchor_weeks: int = 4, max_horizon: int = 13, weight: float | None = None, seed: int = 0):
        self.inner, self.folds, self.anchor_rows, self.anchor_weeks, self.max_horizon, self.weight, self.seed = inner, folds, anchor_rows, anchor_weeks, max_horizon, weight, seed

    def fit(self, train: DataFrame) -> TrendAdjusted:
        if "week" not in train.columns:
            raise ValueError("a trend needs the week")
        self.train = train
        self.last = self.as_of = train.agg(F.max("week")).first()[0]
        flat = train.withColumn("week", F.lit(0))
        fold = F.floor(hash_uniform(F.lit(self.seed), F.col("risk_id")) * self.folds).cast("int")
        parts = []
        for k in range(self.folds if self.folds > 1 else 1):
            held, others = (train.where(fold == k), flat.where(fold != k)) if self.folds > 1 else (train, flat)
            shape = self.inner(others, held.withColumn("week_", F.col("week")).withColumn("week", F.lit(0)))
            parts.append(shape.select("brand", F.col("week_").alias("week"), (F.col("log_premium") - F.col("y_pred")).alias("resid"), F.lit(1.0).alias("weight")))
        resid = parts[0]
        for p in parts[1:]:
            resid = resid.unionByName(p)
        self.levels = checkpointed(brand_levels(resid))  # a row a brand and week
        used = trend_weight(self.levels) if self.weight is None else self.weight
        self.trends = checkpointed(trend(self.levels, trend_weight=used, anchor_weeks=self.anchor_weeks))
        self.offsets: dict[str, float] = {}
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        base = self.inner(self.train, rows.withColumn("week_", F.col("week")).withColumn("week", F.least("week", F.lit(self.last)))).withColumn("week", F.col("week_")).drop("week_")
        offset = F.coalesce(F.create_map(*[F.lit(x) for kv in self.offsets.items() for x in kv])[F.col("brand")], F.lit(0.0)) if self.offsets else F.lit(0.0)
        return forward_delta(self.trends, base, self.as_of, cap=self.max_horizon).withColumn("y_pred", F.col("y_pred") + offset + F.col("delta")).drop("delta")

    def recalibrate(self, seen: DataFrame) -> TrendAdjusted:
        """Offsets moved by the median residuals of the latest weeks of ``seen``, shrunk to the market's by the number of rows; a row a brand comes to the driver."""
        resid = checkpointed(self.predict(seen).select("brand", "week", (F.col("log_premium") - F.col("y_pred")).alias("r")).where("r is not null"))
        latest = resid.agg(F.max("week")).first()[0]
        if latest is None:
            return self
        window = resid.where(F.col("week") > latest - self.anchor_weeks)
        market = exact_quantiles(window, [], {"m": median(F.col("r"))}, written=False).first().m
        for x in with_quantiles(window.groupBy("brand").agg(F.count("*").alias("n")), window, ["brand"], {"m": median(F.col("r"))}, written=False).collect():
            cred = x.n / (x.n + self.anchor_rows) if self.anchor_rows > 0 else 1.0
            self.offsets[x.brand] = self.offsets.get(x.brand, 0.0) + cred * x.m + (1 - cred) * market
        self.as_of = max(self.as_of, latest)
        return self

    def report(self) -> DataFrame:
        """(brand, offset_pct), the cumulative offsets in percent of the premium, least first; the market stands first in ``drift_report``."""
        rows = sorted(((b, float((np.exp(v) - 1) * 100)) for b, v in self.offsets.items()), key=lambda r: r[1])
        return self.train.sparkSession.createDataFrame(rows, "brand string, offset_pct double")


def drift_report(trends: DataFrame) -> DataFrame:
    """(brand, weekly_pct, annual_pct): used slopes in percent a week and over 52, the market first, then by brand."""
    pct = lambda weeks: (F.exp(F.col("used_slope") * weeks) - 1) * 100
    return trends.select("brand", "n_weeks", pct(1).alias("weekly_pct"), pct(52).alias("annual_pct")).orderBy(F.col("brand") != "MARKET", "brand")


def level_at(levels: DataFrame, trends: DataFrame, asked: DataFrame, *, max_horizon: int = 13) -> DataFrame:
    """``asked`` (brand, week) with level: what was observed; past the end the anchor and the used slope, before the start mirrored, in a gap the fitted line.

    Unknown brands have the market's.
    """
    known = levels.select("brand", "week", "level")
    brands = known.select("brand").distinct().withColumn("own_", F.lit(True))
    a = asked.join(brands, "brand", "left").withColumn("of_", F.when(F.col("own_"), F.col("brand")).otherwise("MARKET")).drop("own_")
    ends = known.groupBy(F.col("brand").alias("of_")).agg(F.min("week").alias("first_"), F.max("week").alias("last_"), F.min_by("level", "week").alias("start_"))
    t = trends.select(F.col("brand").alias("of_"), "anchor", "used_slope", "slope")
    near = a.join(ends, "of_").join(t, "of_")
    w = F.col("weight")
    centre = levels.groupBy(F.col("brand").alias("of_")).agg((F.sum(w * F.col("week")) / F.sum(w)).alias("x_"), (F.sum(w * F.col("level")) / F.sum(w)).alias("y_"))
    near = near.join(centre, "of_").join(known.select(F.col("brand").alias("of_"), "week", F.col("level").alias("seen_")), ["of_", "week"], "left")
    inside = F.coalesce("seen_", F.col("y_") + F.col("slope") * (F.col("week") - F.col("x_")))
    past = F.least(F.abs(F.col("week") - F.when(F.col("week") > F.col("last_"), F.col("last_")).otherwise(F.col("first_"))), F.lit(max_horizon))
    level = F.when(F.col("week") > F.col("last_"), F.col("anchor") + F.col("used_slope") * past).when(F.col("week") < F.col("first_"), F.col("start_") - F.col("used_slope") * past).otherwise(inside)
    return near.select(*asked.columns, level.alias("level"))


def quote_rates(quotes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with p_quote: the brand's rate of quoting, else everyone's."""
    known = quotes.where("quoted is not null")
    rate = known.groupBy("brand").agg(F.avg(F.col("quoted").cast("int")).alias("own_"))
    return rows.join(rate, "brand", "left").crossJoin(F.broadcast(known.agg(F.avg(F.col("quoted").cast("int")).alias("all_")))).withColumn("p_quote", F.coalesce("own_", "all_")).drop("own_", "all_")


def percentage_error() -> Column:
    return F.exp(F.col("y_pred") - F.col("y_true")) - 1


def premium_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """n, mdape, mape, rmsle, bias, within_10pct of log-scale y_true and y_pred, per group (all rows if none)."""
    e = percentage_error()
    sq = (F.col("y_true") - F.col("y_pred")) ** 2
    rows = checkpointed(scored.where("y_true is not null and y_pred is not null").select(*by, e.alias("e"), sq.alias("sq")))  # read twice
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(F.abs("e")) * 100).alias("mape"), F.sqrt(F.avg("sq")).alias("rmsle"), (F.avg((F.abs("e") <= 0.1).cast("int")) * 100).alias("within_10pct"))
    both = with_quantiles(means, rows, by, {"mdape": median(F.abs("e") * 100), "bias": median(F.col("e") * 100)}, written=False)
    return both.select(*by, "n", "mdape", "mape", "rmsle", "bias", "within_10pct")


def rolling_metrics(scored: DataFrame) -> DataFrame:
    """Errors by (approach, week), (approach, brand), (approach) and overall; each row is expanded to the four once."""
    e = percentage_error() * 100
    no = lambda c: F.lit(None).cast(scored.schema[c].dataType)
    at = lambda level, *held: F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in held else no(c)).alias(c) for c in ("approach", "week", "brand")])
    sets = F.array(at(1, "approach", "week"), at(2, "approach", "brand"), at(3, "approach"), at(7))
    s = checkpointed(scored.select(F.explode(sets).alias("g"), e.alias("e"), F.abs(F.exp("y_pred") - F.exp("y_true")).alias("pounds")).select("g.*", "e", "pounds"))
    share = lambda t: (F.avg((F.abs("e") <= t).cast("int")) * 100).alias(f"within_{t}")
    keys = ["level", "approach", "week", "brand"]
    means = s.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mape"), F.avg("e").alias("mean_pe"), F.stddev_samp("e").alias("sd_pe"), F.var_samp("e").alias("var_pe"), share(5), share(10), share(20), F.avg("pounds").alias("mae_gbp"),
    )
    return with_quantiles(means, s, keys, {"mdape": median(F.abs("e")), "bias": median(F.col("e"))}, written=False)


def top_k_metrics(scored: DataFrame, k: int = 5, *, group: tuple[str, ...] = ("risk_id", "week")) -> DataFrame:
    """One row: how often the cheapest is hit, the shared part of the k cheapest, and what the predicted k cost.

    Brands are not collapsed: one that stands on several channels can fill several places, and a predicted place
    is priced at all the brand's true prices in the group. Groups of one row are left out. Ties go by brand and channel.
    The k cheapest of a group come from hashed subgroups, and prices are summed by brand before they meet them.
    """
    g = [*group]
    r = checkpointed(scored.select(*g, "brand", "channel", "y_true", "y_pred"))  # read four times
    sizes = r.groupBy(*g).agg(F.count("*").alias("n")).where("n > 1")
    true = top_per(r, g, ["y_true", "brand", "channel", "y_pred"], k, "t").groupBy(*g).agg(F.max(F.when(F.col("t") == 1, F.col("brand"))).alias("t1"), F.collect_set("brand").alias("tb"), F.avg(F.exp("y_true")).alias("tm"))  # k rows a group
    chosen = top_per(r, g, ["y_pred", "brand", "channel", "y_true"], k, "p")
    pred = chosen.groupBy(*g).agg(F.max(F.when(F.col("p") == 1, F.col("brand"))).alias("p1"), F.collect_set("brand").alias("pb"))
    prices = r.groupBy(*g, "brand").agg(F.sum(F.exp("y_true")).alias("s"), F.count("*").alias("c"))
    paid = chosen.select(*g, "brand").join(prices, [*g, "brand"]).groupBy(*g).agg((F.sum("s") / F.sum("c")).alias("pm"))
    one = sizes.join(true, g).join(pred, g).join(paid, g)
    one = checkpointed(one.select((F.col("t1") == F.col("p1")).cast("int").alias("hit"), (F.size(F.array_intersect("tb", "pb")) / F.least(F.lit(k), F.col("n"))).alias("shared"), (F.abs(F.col("pm") - F.col("tm")) / F.col("tm")).alias("error")))
    means = one.agg((F.avg("hit") * 100).alias("cheapest_hit"), (F.avg("shared") * 100).alias(f"top{k}_overlap"), F.count("*").alias("n_groups"))
    return with_quantiles(means, one, [], {f"top{k}_price_err": median(F.col("error") * 100)}, written=False)


def residual_profile(scored: DataFrame, *, holdout_weeks: int) -> DataFrame:
    """Per brand and week: exp(mean residual) - 1 in percent, with the weeks held out marked."""
    per = scored.groupBy("brand", "week").agg(F.count("*").alias("n"), ((F.exp(F.avg(F.col("y_true") - F.col("y_pred"))) - 1) * 100).alias("resid_pct"))
    return temporal_split(per, holdout_weeks=holdout_weeks)


def brand_levels(residuals: DataFrame) -> DataFrame:
    """(brand, week, level, weight): weighted mean residuals centred by brand, and the market's as brand MARKET. ``residuals``: brand, week, resid, weight."""
    # centring commutes with the sums, so everything past the first aggregate is a row a brand and week
    w, r = F.col("weight"), F.col("resid")
    cell = residuals.groupBy("brand", "week").agg(F.sum(w * r).alias("wr"), F.sum(w).alias("weight"), F.sum(r).alias("r"), F.count(r).alias("n"))
    own = Window.partitionBy("brand")
    cell = cell.withColumn("wr", F.col("wr") - F.col("weight") * F.sum("r").over(own) / F.sum("n").over(own))
    market = cell.groupBy("week").agg(F.sum("wr").alias("wr"), F.sum("weight").alias("weight")).select(F.lit("MARKET").alias("brand"), "week", "wr", "weight")
    return cell.select("brand", "week", "wr", "weight").unionByName(market).select("brand", "week", (F.col("wr") / F.col("weight")).alias("level"), "weight")


def trend(levels: DataFrame, *, trend_weight: float = 0.25, credibility: float = 4.0, anchor_weeks: int = 4) -> DataFrame:
    """(brand, n_weeks, slope, credibility, used_slope, anchor): weighted slopes, shrunk to the market's, and the level carried forward.

    The slope of fewer than two weeks, or of weeks all alike, is zero.
    """
    w, x, y = F.col("weight"), F.col("week").cast("double"), F.col("level")
    last = Window.partitionBy("brand")
    s = levels.withColumn("recent", F.col("week") > F.max("week").over(last) - anchor_weeks).groupBy("brand").agg(
        F.count("*").alias("n_weeks"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"),
        F.sum(F.when(F.col("recent"), w * y)).alias("ay"), F.sum(F.when(F.col("recent"), w)).alias("aw"),
    )
    var = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    slope = F.when((F.col("n_weeks") >= 2) & (var > 1e-12), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")) / var).otherwise(0.0)
    s = s.withColumn("slope", slope).withColumn("credibility", F.col("n_weeks") / (F.col("n_weeks") + credibility)).withColumn("anchor", F.col("ay") / F.col("aw"))
    market = s.where("brand = 'MARKET'").select(F.col("slope").alias("market_"))
    used = F.when(F.col("brand") == "MARKET", F.col("slope")).otherwise(F.col("credibility") * F.col("slope") + (1 - F.col("credibility")) * F.col("market_")) * trend_weight
    return s.crossJoin(F.broadcast(market)).select("brand", "n_weeks", "slope", "credibility", used.alias("used_slope"), "anchor")  # one row


def trend_weight(levels: DataFrame, candidates: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), *, credibility: float = 4.0) -> float:
    """The weight whose projected slopes best meet the last third of the weeks (three at most), the smaller of equals.

    Fewer than three weeks to train on give zero. The level table is a row a brand and week.
    """
    weeks = sorted(r.week for r in levels.select("week").distinct().collect())
    held = min(3, max(1, len(weeks) // 3))
    if len(weeks) - held < 3:
        return 0.0
    cut = weeks[-held]
    train = trend(levels.where(F.col("week") < cut), trend_weight=1.0, credibility=credibility).select("brand", "used_slope", "anchor")
    last = levels.where(F.col("week") < cut).groupBy("brand").agg(F.max("week").alias("last_"))
    cells = levels.where((F.col("week") >= cut) & (F.col("brand") != "MARKET")).join(train, "brand").join(last, "brand")
    tried = cells.withColumn("w", F.explode(F.array(*[F.lit(float(c)) for c in candidates])))
    miss = (F.col("level") - F.col("anchor") - F.col("used_slope") * F.col("w") * (F.col("week") - F.col("last_"))) ** 2
    return tried.groupBy("w").agg(F.sum(F.col("weight") * miss).alias("m")).orderBy("m", "w").first().w


def forward_delta(trends: DataFrame, rows: DataFrame, as_of: int, *, cap: int = 13) -> DataFrame:
    """``rows`` with delta: the used slope times the weeks past ``as_of``, up to ``cap``; zero within the window, the market's slope for unknown brands."""
    own = trends.select("brand", F.col("used_slope").alias("own_"))
    market = trends.where("brand = 'MARKET'").select(F.col("used_slope").alias("market_"))
    ahead = F.greatest(F.lit(0), F.least(F.col("week") - as_of, F.lit(cap)))
    return rows.join(own, "brand", "left").crossJoin(F.broadcast(market)).withColumn("delta", F.coalesce("own_", "market_") * ahead).drop("own_", "market_")


def out_of_fold(matrix: DataFrame, features: list[str], *, categories: list[str] | None = None, group: str | None = None, folds: int = 3, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """``matrix`` with resid: each fold of risks predicted by a ridge, without week, that was fitted on the others.

    The sums of products are kept by fold, so all the fits take one pass.
    """
    m = matrix.withColumn("fold_", F.floor(hash_uniform(F.lit(seed), F.col("risk_id")) * folds).cast("int"))
    model = lambda: Ridge([f for f in features if f != "week"], alpha, categories, group)
    levels = category_levels(m, categories or [])
    own = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    parts = moments(m, encoded(model().features, levels), "log_premium", F.concat_ws("|", F.col("fold_").cast("string"), own))
    y = F.lit(None).cast("double")
    for k in range(folds):
        others: dict[str, np.ndarray] = {}
        for key, x in parts.items():
            fold, g = key.split("|", 1)
            if int(fold) != k:
                others[g] = others.get(g, 0.0) + x
        if any(key.startswith(f"{k}|") for key in parts):
            one = model()
            one.levels = levels
            y = F.when(F.col("fold_") == k, one.solve(others).prediction()).otherwise(y)
    out = m.withColumn("y_pred", y)
    return out.withColumn("resid", F.col("log_premium") - F.col("y_pred")).drop("fold_")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation with ties at their mean rank; null where a side does not vary."""
    from quoteloom.operators.tables import percentile_rank

    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = percentile_rank(percentile_rank(both, a, "ra"), b, "rb")
    return ranked.agg(F.when((F.stddev_samp("ra") > 0) & (F.stddev_samp("rb") > 0), F.corr("ra", "rb")).alias("spearman"), F.count("*").alias("n"))


APPROACHES: dict[str, tuple[str, object]] = {}


def register(name: str, needs: str = ""):
    """Adds a model to the registry; ``needs`` names a library that must be there."""

    def add(f):
        APPROACHES[name] = (needs, f)
        return f

    return add


def approaches() -> tuple[dict[str, object], dict[str, str]]:
    """(usable models, skipped ones with the reason): a missing library is reported, never stood in for."""
    from importlib.util import find_spec

    missing = {n: f"{lib} is not installed" for n, (lib, _) in APPROACHES.items() if lib and find_spec(lib) is None}
    return {n: f for n, (_, f) in APPROACHES.items() if n not in missing}, missing | NOT_BUILT


@register("global_geomean")
def _global(train, rows):
    return level_model(train, rows, [])


@register("brand_geomean")
def _brand(train, rows):
    return level_model(train, rows, ["brand"])


@register("brand_last_level")
def _last(train, rows):
    return last_level_model(train, rows)


#: The reference's features but for those of places (flood, crime, subsidence, area value), which need data of their own.
RIDGE_FEATURES = ["log_sum_insured", "voluntary_excess", "log_excess", "property_age", "bedrooms", "claims_last_5y", "flood_history", "subsidence_history", "week"]
RIDGE_CATEGORIES = ["policy_type", "building_type", "construction", "occupancy", "channel"]


@register("ridge_log")
def _ridge(train, rows):
    return Ridge(RIDGE_FEATURES, categories=RIDGE_CATEGORIES, group="brand").fit(train).predict(rows)


def _trees(train, rows, regressor):
    """On the ridge's design, brand one-hot too: a missing number has an indicator, and every row is fitted and scored."""
    from pyspark.ml.functions import array_to_vector

    levels = category_levels(train, [*RIDGE_CATEGORIES, "brand"])
    assembled = lambda df: df.withColumn("features_", array_to_vector(F.array(*encoded(RIDGE_FEATURES, levels))))
    model = regressor.setFeaturesCol("features_").setLabelCol("log_premium").setPredictionCol("y_pred").fit(assembled(train))
    return model.transform(assembled(rows)).drop("features_")


@register("gbt_pooled")
def _gbt(train, rows):
    from pyspark.ml.regression import GBTRegressor

    return _trees(train, rows, GBTRegressor(maxIter=50, stepSize=0.1, maxDepth=5, seed=7))


@register("random_forest")
def _forest(train, rows):
    from pyspark.ml.regression import RandomForestRegressor

    return _trees(train, rows, RandomForestRegressor(numTrees=150, minInstancesPerNode=3, seed=7))


@register("ridge_per_brand")
def _per_brand(train, rows, *, min_rows: int = 300, alpha: float = 1.0):
    """A ridge a brand where it has ``min_rows``, else the pooled one. All are solved from the pooled fit's sums by brand."""
    pooled = Ridge(RIDGE_FEATURES, alpha, RIDGE_CATEGORIES, "brand").fit(train)
    own = [(g, *pooled.weights(m)) for g, m in pooled.by_group.items() if g and m[0, 0] >= min_rows]
    fits = rows.sparkSession.createDataFrame([(g, b0, b.tolist()) for g, b0, b in own], "brand string, b0_ double, b_ array<double>")
    y = F.col("b0_")
    for k, x in enumerate(encoded(pooled.features, pooled.levels)):
        y = y + x * F.col("b_")[k]
    return pooled.predict(rows).join(F.broadcast(fits), "brand", "left").withColumn("y_pred", F.coalesce(y, F.col("y_pred"))).drop("b0_", "b_")  # a row a brand


def per_brand(inner, *, min_rows: int = 300):
    """Any model fitted a brand where the brand has ``min_rows`` rows, else pooled: the wrapper runs the fits one after another, a brand a fit."""

    def model(train, rows):
        counts = [r.brand for r in train.groupBy("brand").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).orderBy("brand").collect()]  # a row a brand
        rest = rows.where(F.coalesce(~F.col("brand").isin(counts), F.lit(True)) if counts else F.lit(True))
        out = inner(train, rest)
        for b in counts:
            out = out.unionByName(inner(train.where(F.col("brand") == b), rows.where(F.col("brand") == b)))
        return out

    return model


register("gbt_per_brand")(per_brand(_gbt))
register("brand_geomean_trend")(lambda train, rows: TrendAdjusted(_brand).fit(train).predict(rows))
register("ridge_log_trend")(lambda train, rows: TrendAdjusted(_ridge).fit(train).predict(rows))

#: Models of libraries that no operator here is built on: asked for, they are skipped with this reason. Spark's trees stand under their own names.
NOT_BUILT = {n: f"no operator is built on {lib}" for n, lib in (("ebm_pooled", "interpret"), ("ebm_per_brand", "interpret"), ("gbm_pooled", "lightgbm"), ("gbm_per_brand", "lightgbm"), ("catboost_pooled", "catboost"))}


def compare(matrix: DataFrame, names: list[str], *, holdout_weeks: int, on_done=None) -> tuple[DataFrame | None, dict[str, str]]:
    """(scored holdout rows of every approach, reasons of those without): a failing approach becomes a reason, not a stop."""
    split = temporal_split(matrix, holdout_weeks=holdout_weeks)
    train, hold = split.where("split = 'train'"), split.where("split = 'holdout'")
    usable, reasons = approaches()
    scored = None
    for name in names:
        if name not in usable:
            reasons.setdefault(name, "unknown")
            continue
        try:
            rows = usable[name](train, hold).select("risk_id", "brand", "channel", "week", F.col("log_premium").alias("y_true"), "y_pred", F.lit(name).alias("approach"))
        except Exception as e:  # noqa: BLE001
            reasons[name] = str(e)[:200]
            continue
        scored = rows if scored is None else scored.unionByName(rows)
        if on_done:
            on_done(name)
    return scored, {n: r for n, r in reasons.items() if n in names}
