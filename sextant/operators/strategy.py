"""Strategies: returns of a scaled signal with costs, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import ratio


def strategy_returns(rows: DataFrame, by: list[str], *, cost: float = 0.001, expanding: bool = False, date: str = "date", signal: str = "signal", price: str = "close") -> DataFrame:
    """``rows`` with ret, position (yesterday's signal over three deviations, within one), turnover and net.

    The deviation is of the whole sample, which looks ahead; ``expanding`` takes it up to each day.
    """
    w = Window.partitionBy(*by).orderBy(date)
    sd = F.stddev_samp(signal).over(w.rowsBetween(Window.unboundedPreceding, 0) if expanding else Window.partitionBy(*by))
    out = rows.withColumn("ret", ratio(price, F.lag(price).over(w)) - 1).withColumn("_s", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(signal, sd) / 3)))
    out = out.withColumn("position", F.lag("_s").over(w)).withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    return out.withColumn("net", F.col("position") * F.col("ret") - F.col("turnover") * cost).drop("_s")


def metrics(rows: DataFrame, by: list[str], *, date: str = "date", ret: str = "net", year: int = 252, riskless: float = 0.03) -> DataFrame:
    """cagr, vol, sharpe, sortino, max_drawdown, drawdown_days (the longest run under water), calmar, var_95, cvar_95, n."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(F.col(ret).isNotNull()).withColumn("_w", F.exp(F.sum(F.log1p(ret)).over(w)))
    rows = rows.withColumn("_dd", F.col("_w") / F.max("_w").over(w) - 1)
    order = Window.partitionBy(*by).orderBy(date)
    rows = rows.withColumn("_under", F.col("_dd") < 0).withColumn("_island", F.row_number().over(order) - F.row_number().over(Window.partitionBy(*by, "_under").orderBy(date)))
    runs = rows.where("_under").groupBy(*by, "_island").count().groupBy(*by).agg(F.max("count").alias("drawdown_days"))
    cut = rows.groupBy(*by).agg(F.percentile(ret, 0.05).alias("var_95"))
    n, mean, sd = F.count(F.lit(1)), F.avg(ret), F.stddev_samp(ret)
    got = rows.join(cut, by).groupBy(*by).agg(
        n.alias("n"), (F.exp(F.sum(F.log1p(ret)) * year / n) - 1).alias("cagr"), (sd * year**0.5).alias("vol"), ratio(mean * year - riskless, sd * year**0.5).alias("sharpe"),
        ratio(mean * year - riskless, F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret))) * year**0.5).alias("sortino"), F.min("_dd").alias("max_drawdown"), F.first("var_95").alias("var_95"), F.avg(F.when(F.col(ret) <= F.col("var_95"), F.col(ret))).alias("cvar_95"),
    )
    return got.join(runs, by, "left").withColumn("drawdown_days", F.coalesce("drawdown_days", F.lit(0).cast("long"))).withColumn("calmar", ratio("cagr", F.abs("max_drawdown")))


def benchmark(rows: DataFrame, by: list[str], ret: str = "net", bench: str = "bench_ret", year: int = 252) -> DataFrame:
    """beta, and alpha: the growth rate less beta times the benchmark's."""
    whole = rows.where(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    growth = lambda c: F.exp(F.sum(F.log1p(c)) * year / F.count(F.lit(1))) - 1
    got = whole.groupBy(*by).agg(ratio(F.covar_samp(ret, bench), F.var_samp(bench)).alias("beta"), growth(ret).alias("_a"), growth(bench).alias("_b"))
    return got.select(*by, "beta", (F.col("_a") - F.col("beta") * F.col("_b")).alias("alpha"))


def cost_sensitivity(rows: DataFrame, by: list[str], *, cost: float = 0.001, factors=(1, 2, 5), year: int = 252) -> DataFrame:
    """Mean yearly net return at multiples of the cost."""
    gross = F.col("position") * F.col("ret")
    got = rows.where("position is not null and ret is not null").groupBy(*by).agg(*((F.avg(gross - F.col("turnover") * cost * k) * year).alias(f"x{k}") for k in factors))
    return got.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("factor"), F.col(f"x{k}").alias("net_return")) for k in factors))).alias("x")).select(*by, "x.*")


def red_flags(m: dict, n: int) -> list[str]:
    """What looks too good, or too thin, in a row of metrics."""
    return [said for said, on in (("sharpe over 3", (m.get("sharpe") or 0) > 3), ("fewer than 60 rows", n < 60), ("no drawdown", (m.get("max_drawdown") or 0) > -0.01)) if on]
