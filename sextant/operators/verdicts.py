"""Verdicts on many signals at once: a signal is a key, its checks are rows, and its gate is an aggregate of those rows.

What windows and aggregates say (panels, profiles, survival, the gate) is said by them; what has no relational form (unit roots, serial
correlation, Granger) comes from one grouped pass over the test pairs, which gives all checks of a signal. A signal is a rolled-up series,
so a group fits a task, and nothing of any signal comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sextant.functions.special import correlation_p
from sextant.operators import validation as V
from sextant.operators.backtest import kpi_metrics, lead_lag_profile, oos_degradation, survives

#: What a signal may declare, and what holds where it doesn't.
DECLARED = {
    "features_tested": ("int", None), "pre_specified": ("boolean", False), "direction": ("string", None), "feature": ("string", None), "confidence_cap": ("string", "high"),
    "revised": ("boolean", False), "vintage_handled": ("boolean", None), "vintage_source": ("string", None), "regime_split": ("boolean", False), "walk_forward": ("boolean", True),
}

#: Rows of checks. The kind of relationship is one of them, without a tier, and the last.
CHECKS = "ordinal int, check string, verdict string, value double, threshold double, explanation string"
RELATIONSHIP = "relationship"


def declared(signals: DataFrame, by: list[str]) -> DataFrame:
    """``signals``, one row for each key, with every column of DECLARED; what is absent or null takes its default."""
    have = {n: F.col(n) if n in signals.columns else F.lit(None) for n in DECLARED}
    rest = [c for c in signals.columns if c not in by and c not in DECLARED]
    return signals.select(*by, *rest, *(F.coalesce(have[n].cast(kind), F.lit(default).cast(kind)).alias(n) for n, (kind, default) in DECLARED.items()))


@pandas_udf(DoubleType())
def p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-values of correlations ``r`` over ``n`` pairs."""
    return pd.Series([correlation_p(None if np.isnan(a) else a, b) for a, b in zip(r, n, strict=True)], dtype=float)


def holds(base: Column, p: Column, r: Column, n: Column, alpha: float = 0.05) -> Column:
    """Whether a signal that survives by its correlations does so by its p-value too: one-sided as expected where pre-specified, else corrected for the features tested."""
    up, down = (F.col("direction") == "positive") & (r > 0), (F.col("direction") == "negative") & ~(r > 0)
    own = F.when(up | down, p / 2).when(F.col("direction").isin("positive", "negative"), 1 - p / 2).otherwise(p)
    corrected = F.when(F.col("pre_specified"), own).otherwise(F.least(F.lit(1.0), p * F.coalesce("features_tested", F.lit(1))))
    return base & F.coalesce((n <= 3) | (corrected < alpha), F.lit(False))


def check_rows(pairs: DataFrame, signals: DataFrame, by: list[str], date: str = "obs_date") -> DataFrame:
    """(by, CHECKS): the checks of every signal's test pairs (by, date, p, t), in order, and the kind of its relationship.

    ``signals`` are as declared() gives them, with ``survives``. A signal without pairs gets its checks of nothing; pairs of no
    signal are left out. Null in p or t is a missing value.
    """
    names = ["ordinal", "check", "verdict", "value", "threshold", "explanation"]
    wanted = ["features_tested", "pre_specified", "feature", "revised", "vintage_handled", "vintage_source", "survives"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(rows: pa.Table, said: pa.Table) -> pa.Table:
        out: list[list] = []
        for own in said.to_pylist():
            p, t = (np.array([np.nan if x is None else x for x in rows[c].to_pylist()], float) for c in ("p", "t"))
            order = np.argsort(rows[date].to_numpy(zero_copy_only=False), kind="stable") if len(p) else np.zeros(0, int)
            found, kind = V.checks_of(p[order], t[order], split=own["regime_split"], **{n: own[n] for n in wanted})
            listed = [(k, c.name, c.verdict, None if c.value is None else float(c.value), None if c.threshold is None else float(c.threshold), c.explanation) for k, c in enumerate(found)]
            listed.append((len(found), RELATIONSHIP, kind[0], None, None, kind[1]))
            out += [[*(own[k] for k in by), *x] for x in listed]
        columns = list(zip(*out, strict=True)) or [()] * (len(by) + 6)
        types = [said.schema.field(k).type for k in by] + kinds
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types, strict=True)], names=[*by, *names])

    fields = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in by)
    # keys of new identity, since signals are often made from the pairs themselves
    rows = pairs.select(*(F.col(k).alias(k) for k in by), date, F.col("p").cast("double").alias("p"), F.col("t").cast("double").alias("t"))
    signals = signals.select(*(F.col(k).alias(k) for k in by), *wanted, "regime_split")
    return rows.groupBy(*by).cogroup(signals.groupBy(*by)).applyInArrow(run, f"{fields}, {CHECKS}")


def _tier(of: Column, names: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), of)


def gate(checks: DataFrame, signals: DataFrame, by: list[str]) -> DataFrame:
    """(by, confidence_cap, binding_constraint): the lowest tier of a signal's checks, its search, its survival out of sample (medium at best)
    and of walk-forward tests left out (medium); the first of the lowest binds."""
    verdicts = {v: V.TIER[t] for v, t in V.OF_VERDICT.items()}
    limits = checks.where(F.col("check") != RELATIONSHIP).select(*by, "ordinal", F.col("check").alias("name"), _tier(F.col("verdict"), verdicts).alias("tier"))
    limit = lambda ordinal, name, tier: F.struct(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("name"), tier.cast("int").alias("tier"))
    also = F.array(
        limit(1000, "feature_search", _tier(F.col("confidence_cap"), V.TIER)),
        limit(1001, "out_of_sample", F.when(F.col("survives"), V.TIER["medium"]).otherwise(V.TIER["low"])),
        limit(1002, "walk_forward", F.when(~F.col("walk_forward"), V.TIER["medium"])),
    )
    limits = limits.union(signals.select(*by, F.explode(also).alias("x")).select(*by, "x.*").where("tier is not null"))
    least = limits.groupBy(*by).agg(F.min(F.struct("tier", "ordinal", "name")).alias("x"))
    return least.select(*by, _cap("x.tier").alias("confidence_cap"), F.col("x.name").alias("binding_constraint"))


def _cap(tier: str) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n, _ in sorted(V.TIER.items(), key=lambda x: x[1]))), F.col(tier))


def panels(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, train, test): the metrics of both parts of the pairs (by, obs_date, part, p, t), as structs."""
    rows = kpi_metrics(pairs, [*by, "part"])
    metrics = F.struct(*(c for c in rows.columns if c not in (*by, "part")))
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col("part") == part, metrics)).alias(part) for part in ("train", "test")))


def judge(pairs: DataFrame, signals: DataFrame, by: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Verdicts on all ``signals`` (by, and of DECLARED what is known) from their pairs (by, obs_date, part, p, t) of the parts train and test.

    The first table has a row for each signal: train and test metrics, lead_lag (a map of lag to correlation), oos_degradation_pct, survives_oos,
    relationship, justification, confidence_cap, binding_constraint, recommendations. The second has its checks as rows, in order.
    A signal without pairs in a part has no metrics there and doesn't survive. ``keep`` is done to the checks, on which both tables
    rest, when more than one is wanted: a cache or a written table.
    """
    by = by or ["signal_id"]
    test = pairs.where("part = 'test'")
    known = declared(signals, by).join(panels(pairs, by), by, "left")
    r, n = F.col("test.corr"), F.coalesce("test.n", F.lit(0))
    # the panel's corr and that of the pairs that p-values are of are one: both are over complete pairs
    known = known.withColumn("oos_degradation_pct", oos_degradation(F.col("train.corr"), r)).withColumn("_p", p_values(r, n.cast("double")))
    known = known.withColumn("survives", holds(survives(F.col("train.corr"), r), F.col("_p"), r, n)).drop("_p")
    checks = keep(check_rows(test, known, by))
    profile = lead_lag_profile(test, by).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lag", "corr")))).alias("lead_lag"))
    said = F.when((F.col("check") != RELATIONSHIP) & (F.col("verdict") != V.PASS), F.struct("ordinal", F.concat_ws(": ", "check", "explanation").alias("text")))
    kind = lambda c: F.max(F.when(F.col("check") == RELATIONSHIP, F.col(c)))
    told = checks.groupBy(*by).agg(kind("verdict").alias("relationship"), kind("explanation").alias("justification"), F.transform(F.sort_array(F.collect_list(said)), lambda x: x["text"]).alias("_advice"))
    out = known.drop(*DECLARED).join(profile, by, "left").join(told, by, "left").join(gate(checks, known, by), by, "left")
    advice = F.concat(F.coalesce("_advice", F.array().cast("array<string>")), F.when(F.col("survives"), F.array().cast("array<string>")).otherwise(F.array(F.lit("do not use: the relationship is not there out of sample"))))
    columns = ["train", "test", "lead_lag", "oos_degradation_pct", F.col("survives").alias("survives_oos"), "relationship", "justification", "confidence_cap", "binding_constraint", advice.alias("recommendations")]
    return out.select(*by, *columns), checks


def as_checks(rows: Iterable) -> list[V.Check]:
    """The checks of one signal from its rows, for those who render them."""
    whole = {"sample_size", "outliers", "revisions", "point_in_time_safety"}
    value = lambda r: None if r.value is None else bool(r.value) if r.check in ("revisions", "point_in_time_safety") else int(r.value) if r.check in whole else r.value
    return [V.Check(r.check, r.verdict, value(r), r.threshold, r.explanation) for r in sorted(rows, key=lambda r: r.ordinal) if r.check != RELATIONSHIP]
