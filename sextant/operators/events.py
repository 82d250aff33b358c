"""Event studies: anchors on trading days, windows around them, features per event, and cross-sections of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import pearson, ratio
from sextant.operators.asof import asof_join, calendar_window, position_window
from sextant.operators.kernels import case_bootstrap


def returns(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """Prices (key, date, close) with row number and return."""
    w = Window.partitionBy(key).orderBy("date")
    return prices.withColumn("rn", F.row_number().over(w)).withColumn("ret", ratio("close", F.lag("close").over(w)) - 1)


def anchored(events: DataFrame, priced: DataFrame, key: str = "ticker", event_date: str = "catalyst_date", forward: bool = False) -> DataFrame:
    """Events with ``anchor_rn``, the last trading row at or before the date; ``forward``: the first at or after it."""
    if not forward:
        return asof_join(events, priced.select(key, "date", F.col("rn").alias("anchor_rn")), keys=[key], left_on=event_date, right_on="date", values=["anchor_rn"])
    turned = events.withColumn("_day", -F.unix_date(F.col(event_date)))
    got = asof_join(turned, priced.select(key, (-F.unix_date("date")).alias("_d"), F.col("rn").alias("anchor_rn")), keys=[key], left_on="_day", right_on="_d", values=["anchor_rn"])
    return got.drop("_day")


#: Windows of event features, in trading rows around the anchor, both ends included.
WINDOWS = {"pre_runup": (-60, -2), "event_reaction": (-1, 1), "post_drift": (2, 21)}
NEWS_DAYS = (-30, -2)


def less_market(prices: DataFrame, market: DataFrame, key: str = "ticker") -> DataFrame:
    """Prices with row numbers and returns less the market's of the day, over days that both have a return for."""
    bench = returns(market.select(F.lit("market").alias(key), "date", "close"), key).select("date", F.col("ret").alias("_market"))
    rows = returns(prices, key).join(bench, "date").withColumn("ret", F.col("ret") - F.col("_market")).where("ret is not null").drop("_market")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("date")))


def event_features(events: DataFrame, prices: DataFrame, news: DataFrame | None = None, key: str = "ticker", event_id: str = "event_id", event_date: str = "catalyst_date", market: DataFrame | None = None) -> DataFrame:
    """A row for each event: sums of returns over WINDOWS (null where a window leaves the series), news count and mean tone before it.

    With ``market`` (date, close), returns are those less the market's.
    """
    priced = returns(prices, key) if market is None else less_market(prices, market, key)
    at = anchored(events.select(event_id, key, event_date), priced, key, event_date)
    low, high = min(a for a, _ in WINDOWS.values()), max(b for _, b in WINDOWS.values())
    rows = position_window(at.where("anchor_rn is not null"), priced.select(key, "rn", "ret"), key=key, low=low, high=high)
    inside = lambda w: F.col("offset").between(*w)
    sums = rows.groupBy(event_id).agg(*(F.when(F.count(F.when(inside(w), F.col("ret"))) == w[1] - w[0] + 1, F.sum(F.when(inside(w), F.col("ret")))).alias(n) for n, w in WINDOWS.items()))
    out = at.join(sums, event_id, "left")
    if news is None:
        return out
    told = calendar_window(at.select(event_id, key, event_date), news, key=key, event_date=event_date, date="date", low=NEWS_DAYS[0], high=NEWS_DAYS[1])
    return out.join(told.groupBy(event_id).agg(F.sum("article_count").alias("pre_news_intensity"), F.avg("avg_tone").alias("pre_news_tone")), event_id, "left")


def abnormal_returns(events: DataFrame, prices: DataFrame, market: DataFrame, low: int, high: int, key: str = "ticker", event_id: str = "event_id", event_date: str = "catalyst_date") -> DataFrame:
    """Mean abnormal return by day around the event, its running sum, and the t value of the events' cumulated returns; whole windows only."""
    bench = returns(market.withColumn(key, F.lit("market")), key).select("date", F.col("ret").alias("market_ret"))
    priced = returns(prices, key).join(bench, "date").withColumn("ar", F.col("ret") - F.col("market_ret")).withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("date")))
    at = anchored(events, priced, key, event_date, forward=True)
    rows = position_window(at.where("anchor_rn is not null"), priced.select(key, "rn", "ar"), key=key, low=low, high=high)
    whole = rows.withColumn("_n", F.count("ar").over(Window.partitionBy(event_id))).where(F.col("_n") == high - low + 1)
    car = whole.groupBy(event_id).agg(F.sum("ar").alias("car")).agg(ratio(F.avg("car"), F.stddev_samp("car") / F.sqrt(F.count("car"))).alias("t"), F.count("car").alias("n"))
    days = whole.groupBy("offset").agg(F.avg("ar").alias("mean_ar"))
    return days.withColumn("caar", F.sum("mean_ar").over(Window.orderBy("offset"))).crossJoin(F.broadcast(car))  # one row for each day of the window; car is one row


def cross_section(features: DataFrame, by: list[str], x: str = "pre_runup", y: str = "event_reaction", buckets: int = 5) -> DataFrame:
    """Mean reaction in equal-count buckets by run-up, top less bottom, and the share of falls in the top third; by groups."""
    rows = features.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*by).orderBy(x, y)
    cut = rows.groupBy(*by).agg(F.percentile(x, 2 / 3).alias("_cut"))
    rows = rows.join(cut, by).withColumn("bucket", F.ntile(buckets).over(w))
    mean = lambda k: F.avg(F.when(F.col("bucket") == k, F.col(y)))
    return rows.groupBy(*by).agg(*(mean(k).alias(f"q{k}") for k in range(1, buckets + 1)), (mean(buckets) - mean(1)).alias("spread"), F.avg(F.when(F.col(x) >= F.col("_cut"), (F.col(y) < 0).cast("double"))).alias("top_tercile_share_negative"), pearson(x, y).alias("corr"), F.count(F.lit(1)).alias("n"))


def zscore(features: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``z_<column>``, with the sample deviation; 0 for a constant."""
    w = Window.partitionBy(*by)
    return features.withColumn(f"z_{column}", F.coalesce(ratio(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w)), F.when(F.col(column).isNotNull(), F.lit(0.0))))


#: Events of a cross-section at least, and the share of them that must have news for news to be in the regression.
LEAST_EVENTS, NEWS_COVERAGE = 12, 0.5


#: Of event_features: what is tested, what by, the news before, what is controlled for.
NAMED = ("pre_runup", "post_drift", "pre_news_intensity", "event_reaction")


def _design(features: DataFrame, by: list[str], x: str, y: str, news: str, control: str, extra: tuple = ()) -> DataFrame:
    """Events with x and y, and their regressors: standardised x, standardised news with gaps at the mean (0 where too few have it), the control (0 where unknown)."""
    w = Window.partitionBy(*by)
    rows = features.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(w), "_some": F.count(news).over(w), "_mean": F.avg(news).over(w)}).where(F.col("n") >= LEAST_EVENTS)
    rows = rows.withColumn("uses_news", F.col("_some") >= NEWS_COVERAGE * F.col("n")).withColumn("_news", F.coalesce(news, "_mean"))
    standard = lambda c: F.coalesce(ratio(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)), F.lit(0.0))
    z_news = F.when(F.col("uses_news"), standard("_news")).otherwise(F.lit(0.0))
    return rows.select(*by, *extra, "n", "uses_news", standard(x).alias("z_runup"), z_news.alias("z_news"), F.coalesce(control, F.lit(0.0)).alias("control"), F.col(y).alias("y"))


def event_regression(features: DataFrame, by: list[str], x: str = NAMED[0], y: str = NAMED[1], news: str = NAMED[2], control: str = NAMED[3]) -> DataFrame:
    """(by, n, uses_news, runup_coef, news_coef, reaction_coef): y on standardised x, on news if at least NEWS_COVERAGE of a group's events have it, and on the control.

    Normal equations from one aggregation's covariances. Groups of fewer than LEAST_EVENTS events have no row; dependent regressors have null coefficients.
    """
    columns = {"a": "z_runup", "b": "z_news", "c": "control", "y": "y"}
    names = [p + q for i, p in enumerate("abcy") for q in "abcy"[i:] if p + q != "yy"]
    sums = _design(features, by, x, y, news, control).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("uses_news").alias("uses_news"), *(F.covar_pop(columns[p], columns[q]).alias(p + q) for p, q in names))
    m = {n: F.col(n) for n in names} | {n[::-1]: F.col(n) for n in names}

    def determinant(rows: str, with_y: str) -> Column:
        """Of the regressors' matrix, with one column, if any, by the right side."""
        e = lambda r, c: m[r + ("y" if c == with_y else c)]
        if len(rows) == 2:
            r, s = rows
            return e(r, r) * e(s, s) - e(r, s) * e(s, r)
        r, s, t = rows
        return e(r, r) * (e(s, s) * e(t, t) - e(s, t) * e(t, s)) - e(r, s) * (e(s, r) * e(t, t) - e(s, t) * e(t, r)) + e(r, t) * (e(s, r) * e(t, s) - e(s, s) * e(t, r))

    solved = lambda c: F.when(F.col("uses_news"), ratio(determinant("abc", c), determinant("abc", ""))).otherwise(ratio(determinant("ac", c), determinant("ac", "")) if c != "b" else F.lit(None))
    return sums.select(*by, "n", "uses_news", solved("a").alias("runup_coef"), solved("b").alias("news_coef"), solved("c").alias("reaction_coef"))


def sell_the_news(features: DataFrame, by: list[str], *, reps: int = 2000, seed: int = 20260621) -> DataFrame:
    """The cross-section of each group: event_regression with 95 % intervals for run-up and news, mean drift in fifths by run-up, top less bottom, the share of falls in the top third, the correlation, and ``confirmed``.

    Confirmed is a group whose run-up coefficient and the upper end of its interval are below zero. Intervals resample events, in order
    of their dates and ids, by numpy's generator; a group's events fit a task. Groups of fewer than LEAST_EVENTS events have no row.
    """

    def intervals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["catalyst_date", "event_id"])
        uses = bool(rows["uses_news"].iloc[0])
        columns = ["z_runup", *(["z_news"] if uses else []), "control"]
        x, y = np.column_stack([np.ones(len(rows)), *(rows[c] for c in columns)]), rows["y"].to_numpy(float)
        low, high = case_bootstrap(x, y, 1, reps, seed)
        news = case_bootstrap(x, y, 2, reps, seed) if uses else (None, None)
        return pd.DataFrame([(*key, low, high, *news)], columns=[*by, "runup_ci_low", "runup_ci_high", "news_ci_low", "news_ci_high"])

    fields = ", ".join(f"`{k}` {features.schema[k].dataType.simpleString()}" for k in by)
    limits = _design(features, by, *NAMED, extra=("catalyst_date", "event_id")).groupBy(*by).applyInPandas(intervals, f"{fields}, runup_ci_low double, runup_ci_high double, news_ci_low double, news_ci_high double")
    parts = cross_section(features, by, y="post_drift").drop("n")
    out = event_regression(features, by).join(limits, by).join(parts, by)
    return out.withColumn("confirmed", F.coalesce((F.col("runup_coef") < 0) & (F.col("runup_ci_high") < 0), F.lit(False)))
