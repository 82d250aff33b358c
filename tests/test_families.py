"""Resampled intervals, distance correlations, wide tables and pairs of series against plain numpy."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import cointegration, kernels, resampling, statistics, wide


def day(k):
    return dt.date(2001, 1, 1) + dt.timedelta(days=int(k))


def slow_bootstrap(x, y, block, reps, seed, stat):
    n = len(x)
    if n < 2 * block:
        return None, None
    count, out = -(-n // block), []
    for r in range(reps):
        starts = [int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:8], 16) % (n - block + 1) for j in range(count)]
        at = np.concatenate([np.arange(s, s + block) for s in starts])[:n]
        v = stat(x[at], y[at])
        out += [v] if np.isfinite(v) else []
    return tuple(np.percentile(out, [2.5, 97.5])) if out else (None, None)


@pytest.mark.parametrize(("statistic", "block"), [("correlation", 5), ("mean", 5), ("slope", 1)])
def test_bootstrap_of_rows(spark, statistic, block):
    """Large values around 1e6, whose squares lose digits; a constant, which has no correlation; too few pairs; nulls."""
    r = np.random.default_rng(1)
    groups = {"a": (r.normal(1e6, 1, 43), None), "b": (r.normal(size=50), None), "c": (np.full(20, 0.1), None), "short": (np.arange(float(2 * block - 1)), None)}
    groups = {k: (x, 2 * x + r.normal(size=len(x))) for k, (x, _) in groups.items()}
    rows = [(k, day(i), float(a), float(b)) for k, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("a", day(999), None, 1.0), ("b", day(-1), 1.0, None)]
    df = spark.createDataFrame(rows[::-1], "k string, obs_date date, x double, y double").repartition(3)
    got = {g.k: (g.ci_low, g.ci_high) for g in resampling.bootstrap(df, ["k"], statistic, block=block, reps=60, seed=9).collect()}
    plain = {"correlation": lambda x, y: np.nan if np.ptp(x) == 0 else np.corrcoef(x, y)[0, 1], "mean": lambda x, y: x.mean(), "slope": lambda x, y: np.nan if np.ptp(x) == 0 else np.polyfit(x - x.mean(), y, 1)[0]}[statistic]
    for k, (x, y) in groups.items():
        want = slow_bootstrap(x, y, block, 60, 9, plain)
        assert got[k] == want if want[0] is None else np.allclose(got[k], want, rtol=1e-6), k
    assert got["short"] == (None, None) and len(got) == 4


def slow_dcov(a, b):
    centred = [d - d.mean(0) - d.mean(1)[:, None] + d.mean() for d in (np.abs(v[:, None] - v) for v in (a, b))]
    return [(x * y).mean() for x, y in ((centred[0], centred[1]), (centred[0], centred[0]), (centred[1], centred[1]))]


def test_distance_moments_equal_those_of_all_distances():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 201):
        a = r.normal(size=n) * 1000 + 5e4
        for x, y in ((a, r.normal(size=n)), (a, (a - 5e4) ** 2), (np.round(a / 500), np.round(r.normal(size=n))), (a, np.ones(n)), (a, -a)):
            assert np.allclose(statistics.distance_moments(x, y), slow_dcov(x, y), rtol=1e-7, atol=1e-7 * max(1, np.abs(y).max()))


def test_distance_correlation_of_long_series(spark):
    """A hundred thousand pairs: all distances would be ten thousand million."""
    n = 100_000
    df = spark.range(n).select((F.col("id") % 2).alias("k"), (F.xxhash64("id") % 1000 / 100).alias("p")).withColumn("t", F.when(F.col("k") == 0, F.col("p") * 3 - 1).otherwise(F.xxhash64("p", F.rand(4)) % 977 / 100))
    got = {r.k: (r.n, r.dcor) for r in statistics.distance_correlation(df, ["k"]).collect()}
    assert got[0][0] == n // 2 and np.isclose(got[0][1], 1) and got[1][1] < 0.2
    assert [r.dcor for r in statistics.distance_correlation(df.withColumn("t", F.lit(0.1)), ["k"]).collect()] == [0.0, 0.0]


def test_wide_tables(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 6)) @ r.normal(size=(6, 6)) + np.array([0, 1e7, 3, 0, 0, 0])
    x = np.column_stack([x, np.full(400, 2.5)])
    rows = [tuple(float(v) for v in row) for row in x] + [(None, *[1.0] * 6)]
    columns = [f"v{k}" for k in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = {(g.a, g.b): (g.n, g.r) for g in wide.correlation_matrix(df, columns).collect()}
    want = np.corrcoef(x[:, :6], rowvar=False)
    assert len(got) == 49 and all(n == 400 for n, _ in got.values()) and got["v0", "v6"][1] is None
    assert all(np.isclose(got[f"v{i}", f"v{j}"][1], want[i, j], atol=1e-9) for i in range(6) for j in range(6))
    found = wide.principal_components(df, columns[:6], components=3).collect()
    z = (x[:, :6] - x[:, :6].mean(0)) / x[:, :6].std(0)
    value = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    assert np.allclose(sorted({g.eigenvalue for g in found}, reverse=True), value[:3]) and np.isclose(sum({g.ratio for g in found}), value[:3].sum() / value.sum())
    loads = np.array([[g.loading for g in sorted(found, key=lambda g: g.column) if g.component == k] for k in (1, 2, 3)])
    assert np.allclose(loads @ loads.T, np.eye(3), atol=1e-9) and (loads[np.arange(3), np.abs(loads).argmax(1)] > 0).all()
    assert np.allclose(np.cov(z, rowvar=False) @ loads[0], value[0] * loads[0])
    assert wide.principal_components(df.limit(0), columns).collect() == [] and wide.correlation_matrix(df.limit(0), columns).collect() == []
    with pytest.raises(ValueError):
        wide.products(df, [])


@pytest.mark.parametrize("tile", [2, 100])
def test_every_pair_of_series_is_tested_once(spark, tile):
    r = np.random.default_rng(8)
    walk = r.normal(size=120).cumsum()
    series = {"a": walk, "b": 2 * walk + r.normal(0, 0.3, 120), "c": r.normal(size=120).cumsum(), "d": r.normal(size=120).cumsum()[:90], "few": walk[:12], "flat": np.ones(120), "e": -walk + r.normal(0, 0.5, 120)}
    rows = [(k, day(i), float(v)) for k, s in series.items() for i, v in enumerate(s)] + [("a", day(500), None)]
    df = spark.createDataFrame(rows, "series_id string, obs_date date, value double").repartition(4)
    got = {(g.a, g.b): g for g in cointegration.all_pairs(df, tile_series=tile).collect()}
    names = sorted(set(series) - {"few", "flat"})
    assert set(got) == {(x, y) for x in names for y in names if x < y}
    for (x, y), g in got.items():
        n = min(len(series[x]), len(series[y]))
        a, b = series[x][:n], series[y][:n]
        assert g.n == n and np.allclose((g.stat, g.p), kernels.engle_granger(a, b)) and np.allclose(g.trace, [t["trace"] for t in kernels.johansen(np.column_stack([a, b]))])
    assert got["a", "b"].rank >= 1 and got["a", "b"].p < 0.01 and got["a", "c"].rank == 0


def test_traces_are_those_of_canonical_correlations():
    """Johansen's eigenvalues are the squared canonical correlations of differences and levels."""
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(size=200).cumsum() for _ in range(3)])
    d, level = np.diff(x, axis=0), x[:-1]
    q = [np.linalg.qr(m - m.mean(0))[0] for m in (d, level)]
    eig = np.linalg.svd(q[0].T @ q[1], compute_uv=False) ** 2
    assert np.allclose([t["trace"] for t in kernels.johansen(x, 0)], [-199 * np.log(1 - eig[k:]).sum() for k in range(3)])


# The published events with their features, in order of their dates.
EVENTS = """event_id,ticker,catalyst_date,pre_runup,event_reaction,post_drift,pre_news_intensity,pre_news_tone
SRPT-EXONDYS-2016,SRPT,2016-09-19,0.4060695061547105,0.775083467580894,0.0197809808640681,,
AMRN-REDUCEIT-2018,AMRN,2018-09-24,0.06439618611813736,3.217754287552819,0.6908808409518135,,
BMRN-ROCTAVIAN-2020,BMRN,2020-08-18,0.17216460866465866,-0.3740663629582873,0.0023937728187439777,,
ACAD-HARMONY-2021,ACAD,2021-04-05,-0.5024016910424641,-0.2016331735929242,-0.01587037646215428,,
BIIB-ADUHELM-2021,BIIB,2021-06-07,0.13800570360068154,0.37950343757095106,-0.08677599530090341,,
AXSM-AUVELITY-2022,AXSM,2022-08-19,0.31836588505097707,0.5108831200670548,-0.053707564911064876,,
ESPR-CLEAR-2022,ESPR,2022-12-07,0.1428574838419293,-0.1641823209445652,0.1603551785641839,,
MDGL-MAESTRONASH-2022,MDGL,2022-12-19,0.022779030743439344,2.7581238410449815,0.14891448261849805,,
SRPT-ELEVIDYS-2023,SRPT,2023-06-22,-0.10869281696250588,-0.10805917273995891,-0.06568106144771801,,
CYTK-SEQUOIA-2023,CYTK,2023-12-27,0.2863797044959858,0.8112680013642362,-0.006587768634263802,,
VKTX-VENTURE-2024,VKTX,2024-02-27,0.9804411173475311,1.278543570086992,0.023276102204027538,,
INSM-ASPEN-2024,INSM,2024-05-28,-0.05754966963403618,1.2516019342223874,0.16791554285763455,,
"""


def test_selling_the_news_gives_the_published_values(spark, tmp_path, capsys):
    from sextant.cli import main

    path = tmp_path / "features.csv"
    path.write_text(EVENTS)
    assert main(["run-sell-the-news", "--features", str(path), "--out", str(tmp_path / "out")]) == 0
    import json

    found = json.loads(capsys.readouterr().out)["cross-section"][0]
    assert [round(float(found[c]), 4) for c in ("runup_coef", "runup_ci_low", "runup_ci_high")] == [-0.0442, -0.1043, 0.0355]
    assert [round(float(found[f"q{k}"]), 4) for k in range(1, 6)] == [0.0288, 0.251, 0.0814, -0.0301, 0.0215] and round(float(found["spread"]), 4) == -0.0073
    assert (found["n"], found["uses_news"], found["confirmed"], found["top_tercile_share_negative"]) == ("12", "false", "false", "0.5") and round(float(found["corr"]), 3) == -0.094
    path.write_text("\n".join(EVENTS.split("\n")[:9]))
    assert main(["run-sell-the-news", "--features", str(path), "--out", str(tmp_path / "out")]) == 2
    assert main(["run-sell-the-news", "--events", str(path), "--out", str(tmp_path / "out")]) == 2


def test_event_regression_equals_least_squares(spark):
    """With news where half of the events have it, and without."""
    from sextant.operators import events

    r = np.random.default_rng(6)
    rows, want = [], {}
    for group, share in (("often", 0.5), ("seldom", 0.4), ("few", 1.0)):
        n = 40 if group != "few" else 11
        x, c, v, y = (r.normal(size=n) for _ in range(4))
        news = np.where(np.arange(n) < share * n, v, np.nan)
        rows += [(group, f"{group}{k}", day(k), float(x[k]), float(y[k]), None if np.isnan(news[k]) else float(news[k]), float(c[k]) if k else None) for k in range(n)]
        z = lambda a: (a - a.mean()) / a.std(ddof=1)
        columns = [np.ones(n), z(x), *([z(np.where(np.isnan(news), np.nanmean(news), news))] if share >= 0.5 else []), np.where(np.arange(n) > 0, c, 0)]
        want[group] = np.linalg.lstsq(np.column_stack(columns), y, rcond=None)[0]
    df = spark.createDataFrame(rows, "family string, event_id string, catalyst_date date, pre_runup double, post_drift double, pre_news_intensity double, event_reaction double")
    got = {g.family: g for g in events.event_regression(df, ["family"]).collect()}
    assert set(got) == {"often", "seldom"} and got["often"].uses_news and not got["seldom"].uses_news and got["seldom"].news_coef is None
    assert np.allclose([got["often"].runup_coef, got["often"].news_coef, got["often"].reaction_coef], want["often"][1:]) and np.allclose([got["seldom"].runup_coef, got["seldom"].reaction_coef], want["seldom"][1:])
    whole = {g.family: g for g in events.sell_the_news(df, ["family"], reps=50).collect()}
    assert whole["often"].runup_ci_low < whole["often"].runup_coef < whole["often"].runup_ci_high and whole["often"].news_ci_low is not None and whole["seldom"].news_ci_low is None
    assert events.sell_the_news(df.limit(0), ["family"]).collect() == []


def test_returns_less_the_market(spark):
    from sextant.operators import events

    prices = spark.createDataFrame([("a", day(k), float(100 + k * k)) for k in (0, 1, 2, 4, 5)], "ticker string, date date, close double")
    market = spark.createDataFrame([(day(k), float(50 + k)) for k in range(5)], "date date, close double")
    got = {(g.date, g.rn): g.ret for g in events.less_market(prices, market).collect()}
    assert set(got) == {(day(1), 1), (day(2), 2), (day(4), 3)} and np.isclose(got[day(4), 3], 116 / 104 - 54 / 53)


def test_analogues_are_counted_as_they_are_retrieved(spark):
    """Without a pair of events: the same numbers and worth, with unknown fields, many tags, none, and other weights."""
    from sextant.operators import analogues

    r = np.random.default_rng(3)
    pick = lambda *of: of[r.integers(len(of))]
    rows = [(str(k), pick("d", "e", ""), pick("i", "j", "k", None), pick("M", "m", "n", ""), pick("t", "u", "v"), pick("x", "y"), pick("1", "2", "3"), None if k % 17 == 0 else sorted(r.choice(list("abcde"), r.integers(0, 5)).tolist(), key=lambda _: r.random()), pick("success", "failure", "mixed", None)) for k in range(150)]
    c = spark.createDataFrame(rows, "event_id string, disease_area string, indication string, moa string, target string, modality string, phase string, tags array<string>, outcome string").repartition(3)
    for options in ({}, {"least": 6}, {"weights": analogues.WEIGHTS | {"tag": 2, "target": 4}, "least": 5}):
        want = {x.query_id: (x.n, x.weighted_success_rate) for x in analogues.base_rates(analogues.retrieve(c, c, **options), ["query_id"]).collect()}
        got = {x.query_id: (x.n, x.p) for x in analogues.counted_rates(c, c, **options).collect()}
        assert len(want) > 50 and set(got) == set(want) and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want), options
    with pytest.raises(ValueError):
        analogues.counted_rates(c, c.withColumn("tags", F.array(*(F.lit(str(k)) for k in range(7)))))


def test_analogues_are_retrieved_without_shuffling_pairs(spark, monkeypatch):
    """Pairs come from joins alone, also where groups are dealt: as a brute force finds them, with unknown fields, few tags, many, and none."""
    from sextant.operators import analogues, asof

    r = np.random.default_rng(4)
    pick = lambda *of: of[r.integers(len(of))]
    ddl = "event_id string, disease_area string, indication string, moa string, target string, modality string, phase string, tags array<string>, outcome string"
    for most in (3, 8):
        rows = [(str(k), pick("d", "e", "", None), pick("i", "j", None), pick("M", "m", "n", ""), pick("t", "u", "v"), pick("x", "y"), pick("1", "2"), None if k % 17 == 0 else [*r.choice(list("abcdefgh"), r.integers(0, most + 1), replace=False).tolist(), "a", None], "success") for k in range(120)]
        said = [[x or None if n != 3 else x.lower() or None for n, x in enumerate(row[:7])] + [{t for t in row[7] or () if t}] for row in rows]

        def score(a, b):
            same = [x is not None and x == y for x, y in zip(a[:7], b[:7], strict=True)]
            return 0 if same[0] or not any(same[2:5]) else 2 * same[1] + 3 * same[2] + (3 if same[3] else 2 * same[4]) + same[5] + same[6] + len(a[7] & b[7])

        want = sorted((a[0], b[0], n) for a in said for b in said if (n := score(a, b)) >= 4)
        c = spark.createDataFrame(rows, ddl).repartition(3)
        for pairs in (asof.PAIRS, 90):
            monkeypatch.setattr(asof, "PAIRS", pairs)
            got = analogues.retrieve(c, c)
            assert "Aggregate" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and plan.count("SortMergeJoin") == 3
            assert len(want) > 2000 and sorted((x.query_id, x.event_id, x.score) for x in got.collect()) == want
            one = analogues.retrieve(c.where("event_id = '5'"), c)
            assert sorted((x.query_id, x.event_id, x.score) for x in one.collect()) == [x for x in want if x[0] == "5"]
        monkeypatch.undo()


def test_analogues_of_a_small_file_are_counted_without_broadcasts(spark, tmp_path):
    """Keys outgrow the size that is guessed from a file, so they are no broadcast; events that say the same are counted as one, each by its own outcome."""
    from sextant.operators import analogues

    rows = [(f"{copy}-{k}", "d", f"i{k % 3}", f"m{k % 5}", f"t{k % 4}", f"{k % 2}", f"{k % 7}", ["b", f"a{k % 2}"] if copy else [f"a{k % 2}", "b", None], ("success", "failure", "mixed", None)[(k + copy) % 4]) for k in range(60) for copy in range(3)]
    spark.createDataFrame(rows, "event_id string, disease_area string, indication string, moa string, target string, modality string, phase string, tags array<string>, outcome string").write.parquet(where := str(tmp_path / "c"))
    c = spark.read.parquet(where)
    assert "Broadcast" not in analogues.leave_one_out(c)._jdf.queryExecution().executedPlan().toString()
    want = {x.query_id: (x.n, x.weighted_success_rate) for x in analogues.base_rates(analogues.retrieve(c, c), ["query_id"]).collect()}
    got = {x.query_id: (x.n, x.p, x.outcome) for x in analogues.counted_rates(c, c, keep=("outcome",)).collect()}
    assert len(got) == 180 and set(got) == set(want) and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)
    assert all(got[r[0]][2] == r[-1] for r in rows)
