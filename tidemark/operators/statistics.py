"""Research statistics (STS operators), grouped: many series or signals in one job."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.ranks import running_sums, staged


def usual_lags(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def lag_products(rows: DataFrame, keys: list[str], order: list[str], value: str, lags: Column | int | None, most: int | None = None) -> DataFrame:
    """Per key n, and the long-run sum of squares of ``value`` with Bartlett weights: lags None is floor(4 (n / 100)^(2/9)).

    ``most`` is the greatest number of lags of any key; without it, it follows from the longest key.
    """
    if most is None:
        most = lags if isinstance(lags, int) else usual_lags(rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) + 1
    by = W.partitionBy(*keys).orderBy(*order)
    shifted = rows.withColumns({f"_g{k}": F.col(value) * F.lag(value, k).over(by) for k in range(1, most + 1)})
    out = shifted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.col(value)).alias("_g0"), *(F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(1, most + 1)))
    used = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))) if lags is None else (F.lit(lags) if isinstance(lags, int) else lags)
    out = out.withColumn("_L", F.least(used, F.lit(most)).cast("double"))
    total = F.col("_g0")
    for k in range(1, most + 1):
        total = total + F.when(F.col("_L") >= k, 2 * (1 - k / (F.col("_L") + 1)) * F.col(f"_g{k}")).otherwise(0.0)
    return out.select(*keys, "n", F.greatest(total, F.lit(0.0)).alias("long_run"))


def newey_west(series: DataFrame, lags: int | None = None) -> DataFrame:
    """STS-01: mean, error with autocovariances (Bartlett weights) and 95% interval per key; null under 3 values. Lags follow n unless given."""
    rows = series.where("value IS NOT NULL")
    centred = rows.withColumn("e", F.col("value") - F.avg("value").over(W.partitionBy("key")))
    sums = lag_products(centred, ["key"], ["date"], "e", lags)
    out = rows.groupBy("key").agg(F.avg("value").alias("mean")).join(sums, "key")
    error = F.when(F.col("n") >= 3, F.sqrt("long_run") / F.col("n"))
    return out.select("key", "n", "mean", error.alias("error"), (F.col("mean") - 1.96 * error).alias("low"), (F.col("mean") + 1.96 * error).alias("high"))


def cross_correlation(pairs: DataFrame, lags: range, least: int = 10) -> DataFrame:
    """STS-06: correlation of x at t with y at t + lag per key and lag, where more than ``least`` pairs exist. pairs: key, i, x, y."""
    lag = F.explode(F.array(*map(F.lit, lags))).alias("lag")
    left = pairs.select("key", "i", "x", lag).withColumn("_j", F.col("i") + F.col("lag"))
    right = pairs.select("key", F.col("i").alias("_j"), "y")
    return left.join(right, ["key", "_j"]).where("x IS NOT NULL AND y IS NOT NULL").groupBy("key", "lag").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("corr")).where(F.col("n") > least)


def lift(rows: DataFrame, signals: list[str], outcome: str) -> DataFrame:
    """STS-05: per signal the flagged rows, hits, precision, recall and lift over the base rate."""
    stacked = rows.select(F.col(outcome).cast("double").alias("o"), F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("on")) for s in signals))).alias("s")).select("o", "s.signal", "s.on")
    out = stacked.groupBy("signal").agg(F.sum(F.col("on").cast("long")).alias("flagged"), F.sum(F.when(F.col("on"), F.col("o"))).alias("hits"), F.sum("o").alias("_all"), F.avg("o").alias("_base"))
    precision = F.try_divide("hits", F.col("flagged").cast("double"))
    return out.select("signal", "flagged", F.col("hits").cast("long").alias("hits"), precision.alias("precision"), F.try_divide("hits", "_all").alias("recall"), F.try_divide(precision, F.col("_base")).alias("lift"))


def auc(rows: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """STS-08: rank statistic per group, ties counting half; null if one label is missing."""
    order = W.partitionBy(by).orderBy(score)
    same = F.count(F.lit(1)).over(W.partitionBy(by, score))
    ranked = rows.withColumn("_r", F.rank().over(order) + (same - 1) / 2)
    p, n = F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))
    out = ranked.groupBy(by).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"), p.alias("_p"), n.alias("_n"))
    return out.select(by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_n"))).alias("auc"))


def logistic(terms: dict[str, float], constant: float) -> Column:
    """STS-14: 1 / (1 + exp(-eta)) of weighted signals; a missing signal counts as 0."""
    eta = F.lit(constant)
    for name, weight in terms.items():
        eta = eta + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-eta))


def top_share(rows: DataFrame, by: str, score: str, share: float) -> DataFrame:
    """STS-14: flag scores at or above the linear (1 - share) quantile of their group."""
    cut = rows.groupBy(by).agg(F.percentile(score, F.lit(1 - share)).alias("_cut"))
    return rows.join(cut, by).withColumn("flagged", F.col(score) >= F.col("_cut")).drop("_cut")


def hac_slope(pairs: DataFrame, lags: int = 1) -> DataFrame:
    """STS-02: least-squares slope and intercept per key with ten pairs or more, with the slope's HAC error. pairs: key, date, x, y."""
    rows = pairs.where("x IS NOT NULL AND y IS NOT NULL")
    fit = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("x").alias("_m"), F.regr_sxx("y", "x").alias("_sxx")).where("n >= 10")
    scores = rows.join(fit.select("key", "slope", "intercept", "_m"), "key").withColumn("s", (F.col("x") - F.col("_m")) * (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")))
    sums = lag_products(scores, ["key"], ["date"], "s", lags, lags).select("key", "long_run")
    error = F.when(F.col("_sxx") > 0, F.sqrt("long_run") / F.col("_sxx"))
    return fit.join(sums, "key").select("key", "n", "slope", "intercept", error.alias("error"))


def bootstrap_means(series: DataFrame, replicates: int = 2000, block: int = 10, seed: int = 7) -> DataFrame:
    """STS-03: moving-block bootstrap interval of the mean per key; block starts are seeded hashes.

    A key's block means, one a day, are one array, from which a replicate draws
    where it lies: draws (days x replicates / block a key) are neither shuffled nor stored.
    """
    rows = series.where("value IS NOT NULL").withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("date")) - 1)
    means = rows.select("key", "i", (F.sum("value").over(W.partitionBy("key").orderBy("i").rowsBetween(0, block - 1)) / block).alias("m"))
    whole = means.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= block)
    reps = whole.select("key", "n", F.col("_s.m").alias("_m"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    blocks = F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))
    start = lambda b: F.pmod(F.xxhash64(F.lit(seed), "key", "rep", b), F.col("n") - block + 1).cast("int")
    drawn = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + F.get("_m", start(b)))
    return reps.select("key", (drawn / F.ceil(F.col("n") / block)).alias("m")).groupBy("key").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))


def normal_tail(z: Column) -> Column:
    """One-sided p of a normal score (rational approximation of erfc, error below 1.2e-7)."""
    t = 1 / (1 + 0.5 * F.abs(z) / math.sqrt(2))
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(0.0)
    for k in reversed(c):
        poly = poly * t + k
    erfc = t * F.exp(-z * z / 2 + poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def expanding_gap(rows: DataFrame, least: int = 20) -> DataFrame:
    """STS-25: at each row y less its fit on x over all rows so far, and the change of y over the next four. rows: key, date, x, y."""
    by = W.partitionBy("key").orderBy("date")
    sofar = by.rowsBetween(W.unboundedPreceding, 0)
    slope, intercept = F.regr_slope("y", "x").over(sofar), F.regr_intercept("y", "x").over(sofar)
    gap = F.when(F.count("x").over(sofar) >= least, F.col("y") - (intercept + slope * F.col("x")))
    return rows.withColumns({"gap": gap, "ahead": F.lead("y", 4).over(by) - F.col("y")})


def calendar_time(rows: DataFrame) -> DataFrame:
    """STS-21: mean, median and share above zero of the per-period means of excess returns. rows: group, period, excess."""
    means = rows.groupBy("group", "period").agg(F.avg("excess").alias("m"))
    return means.groupBy("group").agg(F.count(F.lit(1)).alias("periods"), F.avg("m").alias("mean"), F.percentile("m", F.lit(0.5)).alias("median"), F.avg((F.col("m") > 0).cast("double")).alias("hit_rate"))


def calendar_time_error(rows: DataFrame, lags: int | None = None, least: int = 8) -> DataFrame:
    """STS-21: the calendar-time mean with its autocovariance error, t and one-sided p; groups of fewer than ``least`` periods go. rows: group, period, excess."""
    means = rows.where("excess IS NOT NULL").groupBy(F.col("group").alias("key"), F.col("period").alias("date")).agg(F.avg("excess").alias("value"), F.count(F.lit(1)).alias("names"))
    sizes = means.groupBy("key").agg(F.avg("names").alias("names_per_period"))
    return _tested(newey_west(means, lags).where(F.col("n") >= least)).join(sizes, "key").withColumnRenamed("key", "group")


def calendar_time_difference(rows: DataFrame, pairs: DataFrame, lags: int | None = None) -> DataFrame:
    """STS-21: mean difference of two groups' calendar-time series over the periods that both have. rows: group, period, excess; pairs: first, second."""
    means = rows.where("excess IS NOT NULL").groupBy("group", "period").agg(F.avg("excess").alias("m"))
    a = pairs.join(means.select(F.col("group").alias("first"), "period", F.col("m").alias("a")), "first")
    both = a.join(means.select(F.col("group").alias("second"), "period", F.col("m").alias("b")), ["second", "period"])
    series = both.select(F.struct("first", "second").alias("key"), F.col("period").alias("date"), (F.col("a") - F.col("b")).alias("value"))
    return _tested(newey_west(series, lags)).select("key.first", "key.second", "n", "mean", "error", "low", "high", "t", "p")


def _tested(estimates: DataFrame) -> DataFrame:
    """t of a mean with its error, and the one-sided p of a mean above zero; null without an error."""
    t = F.when(F.col("error") > 0, F.col("mean") / F.col("error"))
    return estimates.withColumn("t", t).withColumn("p", normal_tail(F.col("t")))


def cluster_bootstrap(rows: DataFrame, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """STS-04: interval of a mean per key, whole clusters drawn again. rows: key, cluster, value.

    Clusters are summed first, so a replicate draws sums and counts; draws are seeded hashes.
    """
    sums = rows.where("value IS NOT NULL").groupBy("key", "cluster").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    numbered = sums.withColumns({"i": F.row_number().over(W.partitionBy("key").orderBy("cluster")) - 1, "g": F.count(F.lit(1)).over(W.partitionBy("key"))})
    reps = numbered.select("key", "g", F.col("i").alias("draw")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = reps.select("key", "rep", F.pmod(F.xxhash64(F.lit(seed), "key", "rep", "draw"), F.col("g")).alias("i"))
    means = drawn.join(numbered.select("key", F.col("i").cast("long").alias("i"), "s", "c"), ["key", "i"]).groupBy("key", "rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    return means.groupBy("key").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.stddev_samp("m").alias("error"), F.count(F.lit(1)).alias("replicates"))


def bootstrap(rows: DataFrame, draws: DataFrame, statistic: Callable[..., Column], keys: list[str]) -> DataFrame:
    """EXT-04: any grouped aggregate over drawn rows, with its 95% interval. draws: keys, rep, i; rows: keys, i and what the statistic reads."""
    # shuffle_hash: exploded draws look small to the planner, which must not broadcast them
    values = draws.join(rows.hint("shuffle_hash"), [*keys, "i"]).groupBy(*keys, "rep").agg(statistic().alias("m"))
    return values.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def block_bootstrap(rows: DataFrame, statistic: Callable[..., Column], keys: list[str], replicates: int = 2000, block: int = 10, seed: int = 7) -> DataFrame:
    """STS-03: ``bootstrap`` over ``block_draws``, drawn where a key's rows (its periods) lie: no drawn row is shuffled. rows: keys, i from 0 and what the statistic reads."""
    rest = [c for c in rows.columns if c not in (*keys, "i")]
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *rest))).alias("_r"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= block)
    drawn = _drawn(whole, keys, replicates, block, seed, "_r").withColumn("_x", F.get("_r", F.col("i").cast("int")))
    values = drawn.select(*keys, "rep", *(F.col(f"_x.{c}").alias(c) for c in rest)).groupBy(*keys, "rep").agg(statistic().alias("m"))
    return values.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def block_draws(rows: DataFrame, keys: list[str], replicates: int = 2000, block: int = 10, seed: int = 7) -> DataFrame:
    """STS-03: keys, rep, i: the rows of moving-block samples as long as the data, for ``bootstrap`` with any statistic. rows: keys, i from 0.

    Keys with fewer rows than a block have no samples. Block starts are seeded hashes.
    """
    sized = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= block)
    return _drawn(sized, keys, replicates, block, seed)


def _drawn(sized: DataFrame, keys: list[str], replicates: int, block: int, seed: int, *more: str) -> DataFrame:
    """keys, rep, i and ``more`` columns of each drawn row. sized: keys, _n rows."""
    reps = sized.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_b", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / block) - 1).cast("int"))))
    starts = reps.withColumn("_s", F.pmod(F.xxhash64(F.lit(seed), *keys, "rep", "_b"), F.col("_n") - block + 1))
    inside = starts.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("_b") * block + F.col("_o") < F.col("_n"))
    return inside.select(*keys, "rep", (F.col("_s") + F.col("_o")).alias("i"), *more)


def cluster_draws(rows: DataFrame, keys: list[str], cluster: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """STS-04: keys, rep, i: the rows of samples of whole clusters, as many as there are, for ``bootstrap`` with any statistic. rows: keys, cluster, i."""
    order = W.partitionBy(*keys)
    clusters = rows.select(*keys, F.col(cluster).alias("_c")).distinct().withColumns({"_j": F.row_number().over(order.orderBy("_c")) - 1, "_g": F.count(F.lit(1)).over(order)})
    reps = clusters.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = reps.select(*keys, "rep", F.pmod(F.xxhash64(F.lit(seed), *keys, "rep", "_j"), F.col("_g")).cast("int").alias("_j"))
    members = rows.select(*keys, F.col(cluster).alias("_c"), "i").join(clusters.select(*keys, "_c", "_j"), [*keys, "_c"])
    return drawn.join(members, [*keys, "_j"]).select(*keys, "rep", "i")


def clark_west(rows: DataFrame, lags: int = 0) -> DataFrame:
    """STS-07: t and one-sided p that the model beats the nested base, and 1 - MSE(model) / MSE(base). rows: key, date, actual, base, model."""
    y, f1, f2 = F.col("actual"), F.col("base"), F.col("model")
    adjusted = F.pow(y - f1, F.lit(2)) - (F.pow(y - f2, F.lit(2)) - F.pow(f1 - f2, F.lit(2)))
    mean = newey_west(rows.select("key", "date", adjusted.alias("value")), lags)
    fit = rows.groupBy("key").agg((1 - F.sum(F.pow(y - f2, F.lit(2))) / F.sum(F.pow(y - f1, F.lit(2)))).alias("r2"))
    t = F.coalesce(F.when(F.col("error") > 0, F.col("mean") / F.col("error")), F.lit(0.0))
    return mean.join(fit, "key").select("key", "n", t.alias("t"), normal_tail(t).alias("p"), "r2")


def normal_quantile(p: float) -> float:
    """STS-09: the normal quantile; with p = 1 - alpha / trials the t that many trials ask for."""
    return NormalDist().inv_cdf(p)


#: Coefficients of the rational approximation of the normal quantile (fixed values).
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_LOW = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_LOW = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def upper_quantile(p: Column) -> Column:
    """STS-09: the normal score that is exceeded with probability p (above 0 and up to one half); relative error below 1.2e-9, at any p."""
    fold = lambda c, x: reduce(lambda a, b: a * x + b, c[1:], F.lit(c[0]))
    q = 0.5 - p
    tail = F.sqrt(-2 * F.log(p))
    return F.when(p < 0.02425, -fold(TAIL_TOP, tail) / fold(TAIL_LOW, tail)).otherwise(q * fold(CENTRE_TOP, q * q) / fold(CENTRE_LOW, q * q))


def bonferroni_t(trials: Column, alpha: float = 0.05) -> Column:
    """STS-09: the two-sided t that a number of trials asks for; null without a trial."""
    return F.when(trials >= 1, upper_quantile(F.lit(alpha) / trials / 2))


def trial_guard(log: DataFrame) -> DataFrame:
    """STS-10: per hypothesis its distinct variants, the frozen one (the first freeze counts) and whether the holdout may be used: frozen and not used yet. log: hypothesis, variant, kind, at."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("at", "variant")))
    out = log.groupBy("hypothesis").agg(F.count_distinct(F.when(F.col("kind") == "run", F.col("variant"))).alias("variants"), at("freeze").alias("f"), at("holdout").alias("h"))
    return out.select("hypothesis", "variants", F.col("f.variant").alias("frozen"), (F.col("f").isNotNull() & F.col("h").isNull()).alias("holdout_allowed"))


def past_holdout(log: DataFrame, start: Column) -> DataFrame:
    """STS-10: runs on design or validation data that reach the holdout, with the days they reach into it. log: hypothesis, variant, kind, data_end."""
    return log.where((F.col("kind") != "holdout") & (F.col("data_end") >= start)).withColumn("days_past", F.datediff("data_end", start) + 1)


def expanding_forecasts(origins: DataFrame, least: int = 20, ahead: int = 1) -> DataFrame:
    """STS-11: at each origin the mean of the targets known by then (base) and the fit on x (model); a target is known ``ahead`` rows later. origins: key, date, x, y."""
    known = W.partitionBy("key").orderBy("date").rowsBetween(W.unboundedPreceding, -ahead)
    slope, intercept = F.regr_slope("y", "x").over(known), F.regr_intercept("y", "x").over(known)
    enough = F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")).over(known) >= least
    pair = F.when(F.col("x").isNotNull(), F.col("y"))
    return origins.withColumns({"base": F.when(enough, F.avg(pair).over(known)), "model": F.when(enough, intercept + slope * F.col("x"))})


def logit_fit(rows: DataFrame, names: list[str], outcome: str, events: int = 10, rounds: int = 25) -> list[float] | None:
    """STS-13: intercept and weights of a logistic regression on standardised features by Newton steps; None with too few events.

    Each step is one aggregation of a few sums; only those reach the driver.
    """
    stats = rows.agg(F.sum(outcome).alias("e"), *(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    if (stats["e"] or 0) < events:
        return None
    z = rows.select(F.col(outcome).cast("double").alias("o"), *(((F.col(n) - stats[f"m_{n}"]) / (stats[f"s_{n}"] or 1.0)).alias(f"z{i + 1}") for i, n in enumerate(names))).withColumn("z0", F.lit(1.0))
    k, beta = len(names) + 1, np.zeros(len(names) + 1)
    for _ in range(rounds):
        eta = sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        sums = z.withColumns({"p": p}).agg(*(F.sum(F.col(f"z{i}") * (F.col("o") - F.col("p"))).alias(f"g{i}") for i in range(k)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}") * F.col("p") * (1 - F.col("p"))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
        g = np.array([sums[f"g{i}"] for i in range(k)])
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + 1e-9 * np.eye(k)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    slopes = [float(b) / (stats[f"s_{n}"] or 1.0) for b, n in zip(beta[1:], names, strict=True)]
    return [float(beta[0]) - sum(w * stats[f"m_{n}"] for w, n in zip(slopes, names, strict=True)), *slopes]


def _standard(rows: DataFrame, names: list[str], outcome: str, kept: list[str]) -> tuple[DataFrame, dict]:
    """``kept``, o and z0 (one), z1, ... (features in standard units) of rows with every input, and the count of rows and events."""
    usable = rows.dropna(subset=[outcome, *names])
    stats = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(outcome).cast("double")), F.lit(0.0)).alias("events"), *(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first().asDict()
    z = [((F.col(n) - F.lit(stats[f"m_{n}"])) / F.lit(stats[f"s_{n}"] or 1.0)).alias(f"z{i + 1}") for i, n in enumerate(names)]
    return usable.select(*kept, F.col(outcome).cast("double").alias("o"), F.lit(1.0).alias("z0"), *z), stats


def _newton(z: DataFrame, folds: list, k: int, group: str | None, rounds: int = 50) -> dict:
    """The weights of a logit for each fold, which leaves its own group out (None: nothing); all folds take a step in one job.

    A step sums scores and curvature by fold: (k + k (k + 1) / 2) numbers a fold reach the driver.
    """
    spark, betas, open_ = z.sparkSession, {f: np.zeros(k) for f in folds}, set(folds)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        kind = z.schema[group].dataType.simpleString() if group else "int"
        table = spark.createDataFrame([(f, betas[f].tolist()) for f in open_], f"_fold {kind}, _beta array<double>")
        both = z.crossJoin(F.broadcast(table))  # a row a fold, and every other group's rows belong to it
        if group:
            both = both.where(~F.col(group).eqNullSafe(F.col("_fold")))
        eta = sum((F.col(f"z{i}") * F.col("_beta")[i] for i in range(k)), F.lit(0.0))
        both = both.withColumn("_p", 1 / (1 + F.exp(-eta)))
        sums = both.groupBy("_fold").agg(*(F.sum(F.col(f"z{i}") * (F.col("o") - F.col("_p"))).alias(f"g{i}") for i in range(k)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}") * F.col("_p") * (1 - F.col("_p"))).alias(f"h{i}_{j}") for i, j in pairs)).collect()
        for r in sums:
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + 1e-9 * np.eye(k)
            step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]))
            betas[r["_fold"]] = betas[r["_fold"]] + step
            if np.abs(step).max() < 1e-10:
                open_.discard(r["_fold"])
        if not open_ or not sums:
            break
    return betas


def logit(rows: DataFrame, names: list[str], outcome: str, cluster: str, events: int = 5, least: int = 50) -> DataFrame:
    """STS-13: term, coef, error, z, n, events, clusters of a pooled logit on standardised features; errors are clustered. Empty with too few rows or events.

    The sandwich's middle sums the squares of the clusters' scores, with the
    small-sample factor G / (G - 1) (n - 1) / (n - k).
    """
    z, stats = _standard(rows, names, outcome, [cluster])
    kind = "term string, coef double, error double, z double, n long, events long, clusters long"
    if stats["n"] < least or stats["events"] < events:
        return rows.sparkSession.createDataFrame([], kind)
    k = len(names) + 1
    beta = _newton(z, [0], k, None)[0]
    p = 1 / (1 + F.exp(-sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))))
    scored = z.withColumn("_p", p)
    by = scored.groupBy(cluster).agg(*(F.sum(F.col(f"z{i}") * (F.col("o") - F.col("_p"))).alias(f"u{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    u = by.agg(F.count(F.lit(1)).alias("g"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs)).first()
    h = scored.agg(*(F.sum(F.col(f"z{i}") * F.col(f"z{j}") * F.col("_p") * (1 - F.col("_p"))).alias(f"m{i}_{j}") for i, j in pairs)).first()
    square = lambda r: np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse, g, n = np.linalg.inv(square(h)), u["g"], stats["n"]
    factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 else float("nan")
    error = np.sqrt(np.diag(inverse @ square(u) @ inverse) * factor)
    out = [(t, float(b), float(e), float(b / e), n, int(stats["events"]), g) for t, b, e in zip(["constant", *names], beta, error, strict=True)]
    return rows.sparkSession.createDataFrame(out, kind)


def out_of_group(rows: DataFrame, group: str, names: list[str], outcome: str, events: int = 5) -> DataFrame:
    """STS-12: group, score, label: each row scored by a logit fitted without its group; a group is left out if the others have too few events.

    All fits take their steps together; a fold is a row of weights. The groups are few (countries, sectors).
    """
    z, stats = _standard(rows, names, outcome, [group])
    each = {r[group]: r["e"] for r in z.groupBy(group).agg(F.sum("o").alias("e")).collect()}
    folds = [g for g, e in each.items() if stats["events"] - e >= events]
    kind = z.schema[group].dataType.simpleString()
    betas = _newton(z, folds, len(names) + 1, group) if folds else {}
    table = rows.sparkSession.createDataFrame([(g, b.tolist()) for g, b in betas.items()], f"_fold {kind}, _beta array<double>")
    fit = z.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_fold")))
    eta = sum((F.col(f"z{i}") * F.col("_beta")[i] for i in range(len(names) + 1)), F.lit(0.0))
    return fit.select(group, F.round(eta, 9).alias("score"), F.col("o").cast("int").alias("label"))


def leave_one_out(rows: DataFrame, group: str, names: list[str], outcome: str) -> DataFrame:
    """STS-12: for each group the AUC on it of a logit fitted without it."""
    return auc(out_of_group(rows, group, names, outcome), group, "score", "label")


def out_of_group_report(rows: DataFrame, group: str, models: dict[str, list[str]], outcome: str, share: float = 0.1) -> DataFrame:
    """STS-12: model, n, events, auc, precision and base_rate of all groups' left-out scores together; precision is that of the top ``share`` (linear quantile).

    Every model is judged on the rows that have all models' features.
    """
    usable = staged(rows.dropna(subset=[outcome, *{n for names in models.values() for n in names}]).select(group, outcome, *sorted({n for names in models.values() for n in names})), "usable")  # every Newton step reads it
    parts = [out_of_group(usable, group, names, outcome).select(F.lit(m).alias("model"), "score", "label") for m, names in models.items()]
    # equal scores together, in order: ranks and the quantile follow from running sums, no model's scores are sorted in one task
    each = reduce(DataFrame.unionByName, parts).groupBy("model", "score").agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("p"))
    ranked = running_sums(each.where("score IS NOT NULL"), ["model"], "score", ["c", "p"], "scores")
    place = (F.col("all_c") - 1) * F.lit(1 - share)
    at = lambda k: F.max(F.when((F.col("before_c") <= k) & (k < F.col("before_c") + F.col("c")), F.col("score")))
    cut = ranked.groupBy("model").agg(at(F.floor(place)).alias("_low"), at(F.ceil(place)).alias("_high"), F.max(place - F.floor(place)).alias("_w"))
    cut = cut.select("model", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - F.col("_w")) * F.col("_low") + F.col("_w") * F.col("_high")).alias("_cut"))
    flagged = F.col("score") >= F.col("_cut")
    less = F.col("before_c") - F.col("before_p")  # rows without the label below
    pairs = F.sum(F.col("p") * (less + (F.col("c") - F.col("p")) / 2))
    n, events = F.sum("c"), F.sum("p")
    top = F.try_divide(F.sum(F.when(flagged, F.col("p"))).cast("double"), F.sum(F.when(flagged, F.col("c"))))
    return ranked.join(F.broadcast(cut), "model").groupBy("model").agg(n.alias("n"), events.alias("events"), F.when((events > 0) & (events < n), pairs / (events.cast("double") * (n - events))).alias("auc"), top.alias("precision"), (events / n).alias("base_rate"))  # cut: a row a model


def warning_days(flags: DataFrame, failures: DataFrame) -> DataFrame:
    """STS-17: median days from the first flag in the year before a failure to the failure. flags: cik, date; failures: cik, failed."""
    first = flags.join(failures, "cik").where(F.datediff("failed", "date").between(1, 365)).groupBy("cik", "failed").agg(F.min("date").alias("first"))
    return first.agg(F.count(F.lit(1)).alias("failures"), F.percentile(F.datediff("failed", "first"), F.lit(0.5)).alias("days"))


def daily_alerts(scores: DataFrame) -> DataFrame:
    """STS-18: flags of each day, and whether an entity is new: not flagged at the scoring day before. scores: day, cik, score, cutoff."""
    days = scores.select("day").distinct().withColumn("before", F.lag("day").over(W.orderBy("day")))  # scoring days: one row a day
    flagged = scores.where(F.col("score") >= F.col("cutoff")).select("day", "cik", "score")
    past = flagged.select(F.col("day").alias("before"), "cik", F.lit(True).alias("_p"))
    return flagged.join(days, "day").join(past, ["before", "cik"], "left").select("day", "cik", "score", F.col("_p").isNull().alias("new"))


def failure_dates(events: DataFrame, reports: DataFrame) -> DataFrame:
    """STS-15: bankruptcy items, and exit forms with no report later than 120 days on and no takeover evidence in the year before. events: cik, form, item, filed; reports: cik, filed."""
    last = reports.groupBy("cik").agg(F.max("filed").alias("last"))
    takeover = events.where(F.col("form").isin(TAKEOVER_FORMS) | (F.col("form").startswith("8-K") & F.col("item").isin(TAKEOVER_ITEMS))).select("cik", F.col("filed").alias("t")).distinct()
    exits = events.where(F.col("form").isin(EXIT_FORMS)).join(last, "cik", "left").where(F.col("last").isNull() | (F.datediff("last", "filed") <= 120)).select("cik", "filed")
    taken = exits.join(takeover, (exits["cik"] == takeover["cik"]) & F.datediff("filed", "t").between(0, 365), "left_anti")
    broke = events.where(F.col("form").startswith("8-K") & (F.col("item") == "1.03")).select("cik", "filed")
    return broke.unionByName(taken).distinct()


def quarter_sections(rows: DataFrame, least: int = 20) -> DataFrame:
    """STS-20: per quarter the size and momentum deciles of each name and its return over the mean of its size peers (``least`` names). rows: period, key, ret, size, momentum."""
    decile = lambda c: F.floor((F.row_number().over(W.partitionBy("period").orderBy(c, "key")) - 1) * 10 / F.count(F.lit(1)).over(W.partitionBy("period"))).cast("int")
    ranked = rows.withColumns({"size_decile": decile("size"), "momentum_decile": decile("momentum")})
    peers = W.partitionBy("period", "size_decile")
    return ranked.withColumn("excess", F.when(F.count("ret").over(peers) >= least, F.col("ret") - F.avg("ret").over(peers)))


def after_controls(rows: DataFrame, controls: list[str]) -> DataFrame:
    """STS-22: mean excess of flagged names and their number, with controls demeaned: the constant of the regression is that mean. rows: group, period, excess."""
    known = rows.where("excess IS NOT NULL")
    for c in controls:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("excess").alias("mean"), F.count_distinct("period").alias("periods"))


def after_controls_interval(rows: DataFrame, controls: list[str], replicates: int = 1000, seed: int = 7, least: int = 50) -> DataFrame:
    """STS-22: the control-adjusted mean with an interval that draws whole periods again; groups of fewer than ``least`` rows go."""
    known = rows.dropna(subset=["excess", *controls])
    drawn = cluster_bootstrap(known.select(F.col("group").alias("key"), F.col("period").alias("cluster"), F.col("excess").alias("value")), replicates, seed)
    return after_controls(rows, controls).where(F.col("n") >= least).join(drawn.withColumnRenamed("key", "group"), "group")


def exit_counts(flags: DataFrame, prices: DataFrame, exits: DataFrame, ahead: int = 3) -> DataFrame:
    """STS-23: per period flagged names priced now, priced no more ``ahead`` months later, and those of them with an exit filing since. flags: period, key; prices: period, key; exits: key, filed."""
    now = flags.join(prices.select("period", "key"), ["period", "key"]).withColumn("until", F.last_day(F.add_months("period", ahead)))
    later = prices.select(F.col("period").alias("until"), "key", F.lit(True).alias("_l"))
    gone = now.join(later, ["until", "key"], "left").withColumn("gone", F.col("_l").isNull())
    filed = gone.where("gone").join(exits, "key").where("filed > period AND filed <= until").select("period", "key", F.lit(True).alias("_f")).distinct()
    return gone.join(filed, ["period", "key"], "left").groupBy("period").agg(F.count(F.lit(1)).alias("priced"), F.sum(F.col("gone").cast("long")).alias("gone"), F.sum(F.col("_f").cast("long")).alias("with_filing"))


def manager_flags(books: DataFrame, ideas: DataFrame, positions: tuple[int, int] = (10, 40), value: float = 0.0, turnover: float = 0.25, past: int = 4) -> DataFrame:
    """STS-24: companies flagged at the quarter end after the signal: by any manager, by eligible ones, by two or more of these. books: filer_cik, period, positions, value, turnover; ideas: filer_cik, period, company."""
    by = W.partitionBy("filer_cik").orderBy("period")
    steady = F.datediff("period", F.lag("period", past).over(by)) < 380
    good = F.col("positions").between(*positions) & (F.col("value") >= value) & (F.col("turnover") <= turnover) & steady
    able = books.withColumn("eligible", F.coalesce(good, F.lit(False))).select("filer_cik", "period", "eligible")
    rows = ideas.join(able, ["filer_cik", "period"], "left").withColumn("entry", F.last_day(F.add_months("period", 3)))
    out = rows.groupBy("company", "entry").agg(F.count_distinct("filer_cik").alias("any_manager"), F.count_distinct(F.when(F.col("eligible"), F.col("filer_cik"))).alias("best_idea"))
    return out.withColumn("consensus", F.col("best_idea") >= 2)


def lead_correlation(rows: DataFrame, start: str, end: str, leads: range = range(0, 7)) -> DataFrame:
    """STS-26: correlation of x with y ``lead`` rows later inside a window, and whether the lead is the peak. rows: key, date, x, y."""
    inside = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    numbered = inside.select("key", F.row_number().over(W.partitionBy("key").orderBy("date")).alias("i"), "x", "y")
    out = cross_correlation(numbered, leads, least=10)
    return out.withColumn("peak", F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.round(F.col("corr"), 9)), "lag")) == 1)


def latest_scores(watched: DataFrame, scores: DataFrame, reasons: DataFrame) -> DataFrame:
    """STS-27: each watched entity's newest score, and a reason where there is none."""
    newest = scores.groupBy("cik").agg(F.max(F.struct("day", "score")).alias("s"))
    out = watched.join(newest, "cik", "left").join(reasons, "cik", "left")
    return out.select("cik", "s.day", "s.score", F.when(F.col("s").isNull(), F.coalesce("reason", F.lit("not in the population"))).alias("reason"))


#: Fixed values of STS-15 and STS-16.
EXIT_FORMS = ["15-12B", "15-12G", "15-15D", "25-NSE"]
TAKEOVER_FORMS = ["SC 13E3", "DEFM14A", "PREM14A", "SC TO-T"]
TAKEOVER_ITEMS = ["2.01", "5.01"]


def company_quarters(members: DataFrame, quarters: DataFrame, snapshots: DataFrame, events: DataFrame, failures: DataFrame) -> DataFrame:
    """STS-16: members by quarter ends with their latest snapshot, the year's event signals and whether they fail within a year.

    members: cik, first, last; quarters: date; snapshots: cik, known_on, value;
    events: cik, filed, signal; failures: cik, failed. Events and failures are
    spread to the quarter ends they reach, so the joins are on equal keys.
    """
    grid = members.crossJoin(quarters.select(F.col("date").alias("quarter"))).where("quarter >= first AND quarter <= last").select("cik", "quarter")  # the panel itself
    reach = lambda start, end: F.explode(F.sequence(F.trunc(start, "quarter"), F.trunc(end, "quarter"), F.expr("interval 3 months")))
    near = events.select("cik", "signal", "filed", reach(F.col("filed"), F.date_add("filed", 365)).alias("_q")).withColumn("quarter", F.last_day(F.add_months("_q", 2))).where("filed <= quarter AND filed > date_sub(quarter, 365)")
    told = near.groupBy("cik", "quarter").agg(F.count_distinct("signal").alias("signals"))
    fails = failures.select("cik", "failed", reach(F.date_sub("failed", 365), F.col("failed")).alias("_q")).withColumn("quarter", F.last_day(F.add_months("_q", 2))).where("failed > quarter AND failed <= date_add(quarter, 365)").select("cik", "quarter", F.lit(True).alias("fails")).distinct()
    done = failures.groupBy("cik").agg(F.min("failed").alias("_done"))
    asked = grid.select("cik", F.col("quarter").alias("date"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("k"))
    both = asked.unionByName(snapshots.select("cik", F.col("known_on").alias("date"), "value", F.lit(0).alias("k")))
    latest = F.last("value", ignorenulls=True).over(W.partitionBy("cik").orderBy("date", "k").rowsBetween(W.unboundedPreceding, 0))
    panel = both.withColumn("snapshot", latest).where("k = 1").select("cik", F.col("date").alias("quarter"), "snapshot")
    panel = panel.join(done, "cik", "left").where("_done IS NULL OR _done > quarter").drop("_done")
    return panel.join(told, ["cik", "quarter"], "left").join(fails, ["cik", "quarter"], "left").select("cik", "quarter", "snapshot", F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("fails", F.lit(False)).alias("fails"))
