"""The signal engine: published values, small vectors, and every query with SQL against DuckDB."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import special
from sextant.functions.periods import CadenceError
from sextant.functions.transforms import apply_transform
from sextant.operators import analogues, events, kernels, registry, rollup, statistics, validation, vintage
from sextant.operators.asof import asof_join
from sextant.operators.grid import Predictor, assess_search, plan_features
from sextant.plans import catalogue, render
from sextant.plans.signal import run_signal, run_signal_from_paths
from sextant.sources import connectors, files, nested, specs
from tests import made
from sextant.streaming import stream_rollup

SF = "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows, name="a"):
    return spark.createDataFrame([(name, day(d), v) for d, v in rows], "series_id string, obs_date date, value double")


SPEC = {
    "signal_id": "count-lead", "signal_name": "Counts lead returns", "hypothesis": {"statement": "counts lead returns", "expected_direction": "positive"}, "target": {"dataset_id": "returns", "cadence": "quarterly"},
    "predictors": [{"dataset_id": "counts", "cadence": "monthly", "variable_type": "count", "default_aggregation": "sum", "transforms": ["raw"], "lags": [0, 1, 2]}], "feature_grid": {"max_features": 10, "max_lags": 2},
    "validation": {"train_period": "2008-03-31/2017-12-31", "test_period": "2018-03-31/2025-09-30", "walk_forward": True},
}


def run(spark, planted, seed, **more):
    counts, returns = made.counts_and_returns(seed, planted=planted)
    d = {**SPEC, "feature_grid": SPEC["feature_grid"] | more.pop("grid", {})}
    return run_signal(spark, specs.parse_signal(d), made.to_series(spark, returns, "returns"), made.to_series(spark, counts, "counts"), **more)


def test_planted_signal_gives_the_published_values(spark, tmp_path):
    s = run(spark, True, 2026, grid={"pre_specified_feature": "counts::raw::lag_1"}, run_dir=str(tmp_path / "run"))
    assert s.best_feature == "counts::raw::lag_1" and s.survives_oos
    assert math.isclose(s.train["corr"], 0.571234755855349, rel_tol=1e-12) and math.isclose(s.test["corr"], 0.3267227362449376, rel_tol=1e-12)
    assert math.isclose(s.test["rank_corr"], 0.31325880322153127, rel_tol=1e-12) and s.oos_degradation_pct == 42.8
    assert math.isclose(s.test["mae"], 32.79859752235775, rel_tol=1e-9) and math.isclose(s.test["rmse"], 33.80723657342141, rel_tol=1e-9)
    assert [s.lead_lag[k] for k in range(7)] == [0.3267, -0.137, 0.2832, 0.2622, 0.1351, 0.2988, 0.0612]
    got = {c.name: c.value for c in s.checks}
    assert (got["stationarity_adf"], got["stationarity_kpss"], got["autocorrelation"], got["multiple_testing"], got["outlier_sensitivity"]) == (0.0694, 0.1, 0.4811, 0.0728, 24.17)
    assert s.gate == {"confidence_cap": "medium", "binding_constraint": "sample_size"} and s.relationship[0] == "proxy"
    assert not render.missing_files(tmp_path / "run") and "Counts lead returns" in (tmp_path / "run/signal-card.md").read_text()
    assert "medium" in render.family_page([tmp_path / "run", tmp_path / "run"])
    with pytest.raises(FileNotFoundError):
        render.family_page([tmp_path])


def test_null_control_is_refused(spark):
    s = run(spark, False, 4242)
    assert math.isclose(s.train["corr"], 0.09447901616206945, rel_tol=1e-9) and math.isclose(s.test["corr"], 0.16744514332190008, rel_tol=1e-9)
    assert s.oos_degradation_pct == -77.23 and not s.survives_oos and s.gate == {"confidence_cap": "low", "binding_constraint": "multiple_testing"} and s.relationship[0] == "spurious"


def test_run_from_files_and_vintages(spark, tmp_path):
    counts, returns = made.counts_and_returns()
    counts.rename(columns={"obs_date": "date"}).to_csv(tmp_path / "c.csv", index=False)
    returns.assign(vintage_date=returns["obs_date"]).rename(columns={"obs_date": "observation_date"}).to_csv(tmp_path / "v.csv", index=False)
    s = run_signal_from_paths(spark, specs.parse_signal(SPEC), {"counts": str(tmp_path / "c.csv")}, target_vintages=str(tmp_path / "v.csv"))
    assert s.best_feature == "counts::raw::lag_1" and {c.name for c in s.checks} >= {"revisions", "point_in_time_safety"}
    with pytest.raises(ValueError):
        run_signal_from_paths(spark, specs.parse_signal(SPEC), {})
    with pytest.raises(KeyError):
        files.read_series(spark, str(tmp_path / "c.csv"), "x", value="nope")


def test_specs_are_checked():
    for path, value in (("signal_id", "Bad Id"), ("validation", {"train_period": "2020", "test_period": "a/b"}), ("target", {"dataset_id": "x", "cadence": "hourly"}), ("predictors", [])):
        with pytest.raises(specs.SpecError):
            specs.parse_signal(SPEC | {path: value})


def test_rollup_rules(spark):
    daily = series(spark, [("2024-01-01", 1.0), ("2024-01-31", None), ("2024-03-05", 2.0), ("2024-03-20", 3.0)])
    got = rollup.rollup(daily, source="daily", target="monthly", variable_type="flow").orderBy("obs_date").collect()
    assert [(r.obs_date, r.value, r.n) for r in got] == [(day("2024-01-31"), 1.0, 2)] or [(r.obs_date, r.value) for r in got] == [(day("2024-01-31"), 1.0)]
    whole = rollup.rollup(daily, source="daily", target="monthly", variable_type="price", drop_partial=False).orderBy("obs_date").collect()
    assert [(r.obs_date, r.value, r.n) for r in whole] == [(day("2024-01-31"), 1.0, 2), (day("2024-02-29"), None, 0), (day("2024-03-31"), 3.0, 2)]
    assert rollup.rollup(daily, source="daily", target="daily", variable_type="flow").count() == 4
    for bad in ({"source": "monthly", "target": "daily", "variable_type": "flow"}, {"source": "daily", "target": "monthly", "variable_type": "price", "how": "sum"}, {"source": "daily", "target": "monthly", "variable_type": "none"}, {"source": "x", "target": "monthly", "variable_type": "flow"}):
        with pytest.raises(CadenceError):
            rollup.rollup(daily, **bad)
    with pytest.raises(ValueError):
        rollup.apply_release_lag(daily, -1)


def test_transforms_and_nulls(spark):
    s = series(spark, [("2024-01-31", 1.0), ("2024-02-29", 2.0), ("2024-03-31", None), ("2024-04-30", 4.0)])
    value = lambda name: [r.x for r in apply_transform(s, name, out="x").orderBy("obs_date").collect()]
    assert value("pct_change") == [None, 1.0, 0.0, 1.0] and value("diff") == [None, 1.0, None, None] and value("rolling_mean_3") == [None] * 4
    same = series(spark, [(f"2024-{m:02}-01", 5.0) for m in range(1, 13)])
    assert apply_transform(same, "zscore_12", out="x").where("x is not null").count() == 0
    with pytest.raises(KeyError):
        apply_transform(s, "nope")


VINTAGES = [("2024-01-31", "2024-02-15", 10.0), ("2024-01-31", "2024-05-15", 11.0), ("2024-02-29", "2024-03-15", 12.0), ("2024-03-31", "2024-04-15", 13.0), ("2024-03-31", "2024-08-15", 14.0)]


def test_vintages(spark):
    v = spark.createDataFrame([("a", day(o), day(k), x) for o, k, x in VINTAGES], "series_id string, obs_date date, vintage_date date, value double")
    values = lambda df: [r.value for r in df.orderBy("obs_date").collect()]
    assert values(vintage.first_vintage(v)) == [10, 12, 13] and values(vintage.final_vintage(v)) == [11, 12, 14] and values(vintage.first_revision(v)) == [1, 1]
    dates = spark.createDataFrame([("a", day(d)) for d in ("2024-01-01", "2024-03-01", "2024-04-01", "2024-06-01")], "series_id string, as_of date")
    assert [r.value for r in vintage.as_of_series(v, dates).orderBy("as_of").collect()] == [None, 10, 12, 13]
    assert vintage.timely(v).count() == 5


def test_safe_pairs_take_the_latest_knowable(spark):
    r = np.random.default_rng(4)
    rows = [(day("2020-01-31") + dt.timedelta(days=30 * i), int(r.integers(10, 90)), int(r.integers(20, 200))) for i in range(60)]
    table = [("a", o, o + dt.timedelta(days=a), o + dt.timedelta(days=a + b), float(i)) for i, (o, a, b) in enumerate(rows)]
    got = {x.obs_date: x.x for x in vintage.safe_pairs(spark.createDataFrame(table, "series_id string, obs_date date, first_release_date date, knowable_date date, level_rev double"), "level_rev").collect()}
    want = {}
    for i, t in enumerate(table):
        if ok := [j for j in range(i) if table[j][3] <= t[2]]:
            want[t[1]] = float(max(ok))
    assert got == want


def test_asof_join_is_strict_when_asked(spark):
    left = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("z", 9, "w")], "k string, at int, name string")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 3, 2.0)], "k string, at int, v double")
    read = lambda strict: {r.name: r.v for r in asof_join(left, right, keys=["k"], left_on="at", right_on="at", values=["v"], strict=strict).collect()}
    assert read(False) == {"x": 1.0, "y": None, "w": None} and read(True) == {"x": 2.0, "y": None, "w": None}


def test_distributions():
    assert math.isclose(special.student_two_sided(1.8616, 29), 0.07282, rel_tol=1e-4) and math.isclose(special.chi2_tail(3.841459, 1), 0.05, rel_tol=1e-5) and math.isclose(special.f_tail(4.964603, 1, 10), 0.05, rel_tol=1e-5)
    assert special.correlation_p(1, 30) == 0 and special.correlation_p(0, 30) == 1 and special.correlation_p(0.5, 2) is None and special.deflated_correlation(0.5, 100, 1) == 0.5
    assert math.isclose(special.deflated_correlation(0.16744514332190008, 31, 3), 0.0862, abs_tol=5e-5) and math.isclose(special.unit_root_p(-2.86), 0.05, abs_tol=1e-3)


def test_checks_and_gate():
    verdicts = lambda f, *xs: [f(*x).verdict for x in xs]
    assert verdicts(validation.sample_size, (200,), (80,), (5,)) == ["pass", "warn", "fail"] and verdicts(validation.missingness, (100, 0), (100, 10), (100, 50)) == ["pass", "warn", "fail"]
    assert validation.outliers(np.ones(100)).verdict == "pass"
    v = np.random.default_rng(0).normal(size=200)
    v[[3, 9]] = 100, -100
    assert validation.outliers(v).value >= 2
    assert validation.lag_sensitivity({-1: 0.45, 0: 0.5, 1: 0.42}).verdict == "pass" and validation.lag_sensitivity({-1: 0.05, 0: 0.6, 1: 0.1}).verdict == "warn"
    ok = [validation.Check("a", "pass")]
    assert validation.gate(ok, {"confidence_cap": "medium"}, survives_oos=True, walk_forward=True) == {"confidence_cap": "medium", "binding_constraint": "feature_search"}
    assert validation.gate(ok, {"confidence_cap": "high"}, survives_oos=False, walk_forward=True)["binding_constraint"] == "out_of_sample"
    assert validation.multiple_testing(0.5, 100, None).verdict == "fail" and validation.multiple_testing(0.1, 30, 40).verdict == "fail"
    x = np.random.default_rng(1).normal(size=80)
    assert validation.regime_split(x, np.where(np.arange(80) < 40, x, -x)).value == 100
    assert assess_search(10, 3, pre_specified=False, out_of_sample=False)["confidence_cap"] == "low"
    features, cut = plan_features([Predictor("a", ("raw", "diff"), (0, 5)), Predictor("b", ("raw",), (1,))], 5, 3)
    assert [f.name for f in features] == ["a::raw::lag_0", "a::raw::lag_1", "a::diff::lag_0", "a::diff::lag_1", "b::raw::lag_0"] and cut


def test_multiple_tests(spark):
    p = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, p double")
    kept = lambda xs: [r.i for r in statistics.benjamini_hochberg(p(xs)).where("rejected").orderBy("i").collect()]
    assert kept([0.001, 0.002, 0.003, 0.004]) == [0, 1, 2, 3] and kept([0.9, 0.8, 0.7]) == [] and kept([0.5, 0.001, 0.6, 0.002, None]) == [1, 3]


def test_kernels():
    r = np.random.default_rng(0)
    w = r.normal(size=200)
    walk = w.cumsum()
    assert kernels.adf(w)[1] < 0.01 < 0.1 < kernels.adf(walk)[1] and kernels.kpss(w)[1] == 0.1 and kernels.kpss(walk)[1] == 0.01
    assert kernels.stationarity(w)["verdict"] == "stationary" and kernels.stationarity(walk)["verdict"] == "non-stationary"
    lead = np.concatenate([[0], w[:-1]]) + 0.1 * r.normal(size=200)
    assert kernels.granger(w, lead) < 1e-6 and kernels.granger(w[:5], w[:5]) is None
    assert kernels.engle_granger(walk, walk + r.normal(size=200))[1] < 0.01 and kernels.johansen(np.column_stack([walk, walk + r.normal(size=200)]))[0]["trace"] > 15.5
    season = np.sin(np.arange(144) * 2 * np.pi / 12)
    parts = kernels.stl(season + 0.05 * np.arange(144) + r.normal(0, 0.05, 144), 12)
    assert np.corrcoef(parts["seasonal"], season)[0, 1] > 0.97 and kernels.strength(parts)["trend_strength"] > 0.9
    x = r.normal(size=(300, 2))
    assert np.allclose(kernels.ols_hac(x, 1 + x @ [2, -1] + 0.1 * r.normal(size=300))["coef"], [1, 2, -1], atol=0.05)
    z = kernels.pca(300, x.sum(0), x.T @ x)
    assert math.isclose(sum(z["ratios"]), 1) and math.isclose(z["ratios"][0], np.linalg.eigvalsh(np.corrcoef(x.T))[1] / 2, rel_tol=1e-9)
    low, high = kernels.block_bootstrap(w, lead, kernels.correlation, reps=200)
    assert low < kernels.correlation(w, lead) < high and math.isnan(kernels.block_bootstrap(w[:10], w[:10], kernels.correlation)[0])
    a, b = kernels.case_bootstrap(np.column_stack([np.ones(200), w]), 2 * w + r.normal(size=200), 1, reps=300)
    assert a < 2 < b


def test_distance_correlation_and_effective_n(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=60)
    df = spark.createDataFrame([("a", float(a), float(a * a)) for a in x], "g string, p double, t double")
    centred = lambda v: (m := np.abs(v[:, None] - v)) - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = centred(x), centred(x * x)
    want = math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))
    assert math.isclose(statistics.distance_correlation(df, ["g"]).first().dcor, want, rel_tol=1e-9)
    ar = np.zeros(300)
    for k in range(1, 300):
        ar[k] = 0.9 * ar[k - 1] + r.normal()
    assert validation.effective_n(ar, ar) < 150 and validation.effective_n(x[:5], x[:5]) == 5


def test_reference_classes(spark):
    rows = [(str(k), "d", "i" if k < 12 else "j", "M" if k % 2 else "m", "", "x", "3", ["t"], "success" if k % 12 < 9 and k < 12 or k >= 12 and k % 4 == 0 else "failure") for k in range(24)]
    c = spark.createDataFrame(rows, "event_id string, disease_area string, indication string, moa string, target string, modality string, phase string, tags array<string>, outcome string")
    got = analogues.retrieve(c, c)
    assert got.where("query_id = event_id").count() == 0 and got.count() == 24 * 23 and got.where("query_id = '0' and event_id = '1'").first().score == 2 + 3 + 3 + 1 + 1 + 1
    rates = {r.indication: r.p_success for r in analogues.class_base_rates(c, ["indication"]).collect()}
    assert rates == {"i": 0.75, "j": 0.25} and analogues.leave_one_out(c).first().n == 24


def test_event_features(spark):
    days = [day("2024-01-01") + dt.timedelta(days=k) for k in range(120)]
    prices = spark.createDataFrame([("t", d, 100.0 * 1.01**k) for k, d in enumerate(days)], "ticker string, date date, close double")
    e = spark.createDataFrame([("a", "t", days[80]), ("b", "t", days[10]), ("c", "t", day("2023-01-01"))], "event_id string, ticker string, catalyst_date date")
    news = spark.createDataFrame([("t", days[60], 5, 1.0), ("t", days[79], 7, 3.0)], "ticker string, date date, article_count long, avg_tone double")
    got = {r.event_id: r for r in events.event_features(e, prices, news).collect()}
    assert math.isclose(got["a"].pre_runup, 0.59, rel_tol=1e-9) and math.isclose(got["a"].event_reaction, 0.03, rel_tol=1e-9) and got["a"].pre_news_intensity == 5
    assert got["b"].pre_runup is None and math.isclose(got["b"].post_drift, 0.2, rel_tol=1e-9) and got["c"].event_reaction is None
    flat = spark.createDataFrame([(d, 1.0) for d in days], "date date, close double")
    ar = events.abnormal_returns(e.where("event_id != 'c'"), prices, flat, -2, 2).orderBy("offset").collect()
    assert len(ar) == 5 and math.isclose(ar[-1].caar, 0.05, rel_tol=1e-9) and ar[0].n == 2


def test_catalog_from_files(spark, tmp_path):
    (tmp_path / "index.json").write_text('[{"id":"s","name":"Prices","domain":"finance-markets","entry_kind":"time-series","description":"daily prices","join_keys":["DATE","TICKER"],"primary_keys":["id"],"geography":["us"],"type":["rest-api"],"cost":"free","auth_required":"none","agent_use_cases":["momentum"]},{"id":"r","name":"Trials","domain":"health","entry_kind":"registry","description":"trial registry","join_keys":["DATE"],"primary_keys":["id"]},{"id":"p","name":"Panel","domain":"x","entry_kind":"panel","description":"","join_keys":["ISO_3"],"primary_keys":[]}]')
    (tmp_path / "datasets.csv").write_text("id,source_id,name,entry_kind,time_index,time_grain,primary_keys,join_keys\nd1,s,Close,time-series,date,daily; monthly,id,DATE;TICKER\n")
    (tmp_path / "fields.csv").write_text("source_id,dataset_id,field_name,type,role,join_key,unit,required,description\ns,d1,date,date,time_index,DATE,,yes,\ns,d1,close,double,measure,,usd,1,\ns,d1,ticker,string,dimension,TICKER,,no,\n")
    c = files.read_catalog(spark, str(tmp_path))
    assert {r.id for r in c.datasets.collect()} == {"d1", "r"} and c.join_keys.count() == 0
    assert [r.id for r in registry.search_sources(c, "prices momentum").collect()] == ["s"] and registry.search_sources(c, "").count() == 3
    assert [r.id for r in registry.query_catalog(c, "close", cadence="daily").collect()] == ["d1"] and [r.id for r in registry.query_catalog(c, "panel").collect()] == ["p"]
    k = registry.contracts(c).where("dataset_id = 'd1'").first()
    assert (k.native_cadence, k.target_cadence, k.variable_type, k.aggregation, k.date_field, k.value_field, k.entity_fields, k.known_limitations) == ("daily", "monthly", "price", "last", "date", "close", ["ticker"], [])
    f = registry.fitness(c, {"statement": "daily prices", "target_cadence": "monthly"}).where("id = 'd1'").first()
    assert (f.economic_proximity, f.coverage, f.cadence_fit, f.survivorship_bias_risk, f.api_scriptability) == (10, 6, 10, 4, 9)
    assert {r.view: r.n for r in registry.healthcheck(c).collect()}["sources"] == 3 and [r.id for r in registry.compatible_sources(c, "d1").collect()] == ["r"]


def test_other_sources(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("date,a,b\n2024-01-01,1,x\n2024-01-02,,4\n")
    assert {(r.series_id, r.value) for r in files.read_wide(spark, str(tmp_path / "wide.csv")).collect()} == {("a", 1.0), ("a", None), ("b", None), ("b", 4.0)}
    wide = spark.createDataFrame([("2024-01-01", "1.5", "."), ("2024-02-01", "2", "")], "observation_date string, GDP_20240115 string, GDP_20240215 string")
    assert {(r.series_id, str(r.vintage_date), r.value) for r in files.melt_vintages(wide).collect()} == {("GDP", "2024-01-15", 1.5), ("GDP", "2024-01-15", 2.0)}
    for t in "AB":
        (tmp_path / f"{t}.csv").write_text("date,close\n2024-01-01,1\n")
    assert {r.ticker for r in files.read_folder(spark, str(tmp_path / "[AB].csv"), {"date": "date", "close": "double"}).collect()} == {"A", "B"}
    a, b = series(spark, [("2024-01-01", 1.0)]), series(spark, [("2024-01-01", 9.0), ("2024-01-02", 2.0)])
    assert sorted(r.value for r in files.stitched([a, b]).collect()) == [1.0, 2.0]
    doc = '{"resultsSection":{"outcomeMeasuresModule":{"outcomeMeasures":[{"type":"SECONDARY","analyses":[{"pValue":"0.9"}]},{"type":"Primary","analyses":[{"pValue":"n/a"},{"pValue":"<= 0.01"}]}]}}}'
    got = spark.createDataFrame([(doc,)], "d string").select(nested.primary_p_value("d").alias("p"), nested.outcome_of(F.lit("COMPLETED"), nested.primary_p_value("d")).alias("o")).first()
    assert (got.p, got.o) == (0.01, "success")
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise connectors.urllib.error.HTTPError(url, 503, "", None, None)
        return open(tmp_path / "A.csv", "rb")

    assert connectors.fetch("http://x", opener=opener, wait=lambda s: None).startswith(b"date") and len(calls) == 3
    cache, loads = connectors.BodyCache(str(tmp_path / "kept")), []
    load = lambda u: loads.append(u) or u.encode()
    assert [cache.get(u, load) for u in ("http://a", "http://b", "http://a")] == [b"http://a", b"http://b", b"http://a"] and loads == ["http://a", "http://b"]
    assert connectors.BodyCache(str(tmp_path / "kept"), 0).get("http://a", load) == b"http://a" and len(loads) == 3
    connectors.register(spark)
    web = spark.read.format("web_series").option("url", f"file://{tmp_path}/{{series}}.csv").option("series", "A,B").option("value", "close").load()
    assert {(r.series_id, str(r.obs_date), r.value) for r in web.collect()} == {("A", "2024-01-01", 1.0), ("B", "2024-01-01", 1.0)}


def test_streamed_rollup(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h, m), 1.0) for h in range(4) for m in (0, 30)], "series_id string, ts timestamp, value double")
    rows.write.parquet(str(tmp_path / "in"))
    out = stream_rollup(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), window="1 hour", late="10 minutes", variable_type="flow")
    q = out.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.value for r in spark.table("rolled").orderBy("start").collect()] == [2.0] * 4
    assert stream_rollup(rows, window="1 hour", late="10 minutes", variable_type="flow").count() == 4


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v.date() if isinstance(v, dt.datetime) and v.time() == dt.time() else v


#: At the smallest scale some periods have no rows; these queries' SQL has no spine. They are held at sf0.01 instead.
GAPPY = {n for n in catalogue.QUERIES if n.startswith("rollup_")} - {"rollup_spine_gaps"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    where = SF if name not in GAPPY else SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in "nation customer part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    got = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    df = catalogue.QUERIES[name](spark, where)
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    key = lambda r: tuple((x is None, str(round(x, 1) if isinstance(x, float) else x)) for x in map(norm, r) if not isinstance(x, float)) + tuple(x or 0 for x in map(norm, r) if isinstance(x, float))
    assert sorted(df.columns) == sorted(names) and len(rows) == len(want)
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(map(norm, a), map(norm, b), strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4), (name, a, b)


def test_whole_tables(spark):
    """All parts are in the classes of the whole table, also those that the queries with a condition leave out."""
    where = SF.replace("0.001", "0.01")
    assert "p_partkey <=" not in "".join(catalogue.ORACLE_SQL[f"refclass_{n}"] for n in ("retrieve", "base_rates", "loo"))
    got = {r.query_id for r in catalogue.QUERIES["refclass_retrieve"](spark, where).select("query_id").distinct().collect()}
    assert any(int(x) > 400 for x in got)
    assert catalogue.QUERIES["refclass_base_rates"](spark, where).agg({"n": "sum"}).first()[0] > 400
    assert catalogue.QUERIES["pvalue_parse"](spark, where).count() == spark.read.parquet(f"{where}/orders.parquet").count()


def test_studies(spark, tmp_path):
    """Planted momentum is found and survives, noise doesn't; the bootstrap, the corrections and the runners' files."""
    from sextant.operators import studies

    r = np.random.default_rng(3)
    rows = []
    days = [dt.date(1990 + k // 12, k % 12 + 1, 28) for k in range(240)]
    for name, phi in (("kept", 0.8), ("noise", 0.0)):
        x = np.zeros(240)
        for k in range(1, 240):
            x[k] = phi * x[k - 1] + r.normal()
        rows += [(name, d, 90, "growth_rev", float(a), float(b)) for d, a, b in zip(days[1:], x[:-1], x[1:], strict=True)]
    pairs = spark.createDataFrame(rows, "series_id string, obs_date date, horizon int, unit string, x double, y double")
    got = {t.series_id: t for t in studies.momentum_trials(pairs, split="2005-01-01", reps=200).collect()}
    assert got["kept"].primary_survives and not got["noise"].primary_survives and got["kept"].ci_low > 0.5
    assert got["noise"].full_p_bonferroni == min(1, 2 * got["noise"].full_p) and got["kept"].oos_n == 60
    table = pairs.select("series_id", "obs_date", F.col("y").alias("growth_rev"))
    kept = {t.series_id: t for t in studies.sign_persistence(table, reps=200).collect()}
    assert kept["kept"].share_ci_low > 0.5 and kept["kept"].runs_p < 0.001 < kept["noise"].runs_p and kept["noise"].n_pairs == 238
    family = {t.term: t for t in studies.family_test(pairs.select(F.col("series_id").alias("term"), "obs_date", F.col("x").alias("p"), F.col("y").alias("t")), [0], "2003-12-31").collect()}
    assert family["kept"].survives_train and family["kept"].survives_test and not family["noise"].survives_test


def test_study_commands(spark, tmp_path, capsys):
    from sextant import cli

    days = [f"{2000 + k // 12}-{k % 12 + 1:02}-28" for k in range(120)]
    (tmp_path / "t.csv").write_text("date,a,b\n" + "".join(f"{d},{k % 7},{k % 5 + k % 7}\n" for k, d in enumerate(days)))
    run = lambda *a: cli.main([str(x) for x in a])
    for mode in ("correlation", "regression", "lags", "distance", "granger", "cointegration"):
        assert run("analyse", mode, "--input", tmp_path / "t.csv", "--x", "a", "--y", "b") == 0
    for mode in ("stationarity", "decomposition", "quality"):
        assert run("analyse", mode, "--input", tmp_path / "t.csv", "--x", "a") == 0
    assert run("analyse", "lags", "--input", tmp_path / "t.csv", "--x", "a") == 2 and "--y" in capsys.readouterr().err
    assert run("analyse", "lags", "--input", tmp_path / "t.csv", "--x", "a", "--y", "zz") == 2 and "zz" in capsys.readouterr().err
    assert run("analyse", "nothing", "--input", tmp_path / "t.csv") == 2
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("date,value\n" + "".join(f"{d},{(k * 7 + ord(name)) % 11}\n" for k, d in enumerate(days)))
    assert run("run-family", "--predictor", f"a={tmp_path / 'a.csv'}", "--target", tmp_path / "b.csv", "--train-end", "2005-12-31", "--out", tmp_path / "family") == 0
    assert (tmp_path / "family" / "summary.md").read_text().startswith("# A family") and any((tmp_path / "family" / "family.csv").glob("part-*"))
    assert run("run-family", "--predictor", "a", "--target", tmp_path / "b.csv", "--train-end", "2005-12-31", "--out", tmp_path / "family") == 2
    (tmp_path / "v.csv").write_text("observation_date,vintage_date,value\n" + "".join(f"{d},{days[min(119, k + j + 1)]},{(k * 13 + j * 5) % 17}\n" for k, d in enumerate(days[:100]) for j in range(3)))
    assert run("run-revision-momentum", "--vintages", f"v={tmp_path / 'v.csv'}", "--split", "2005-01-01", "--reps", 20, "--out", tmp_path / "revisions") == 0
    (tmp_path / "c.csv").write_text("event_id,disease_area,indication,moa,target,modality,phase,outcome,tags\n" + "".join(f"e{k},d,i{k % 2},m,t,x,3,{'success' if k % 3 else 'failure'},a;b\n" for k in range(9)))
    assert run("run-reference-class", "--corpus", tmp_path / "c.csv", "--like", "e1", "--moa", "M", "--out", tmp_path / "classes") == 0
    assert run("run-reference-class", "--corpus", tmp_path / "c.csv", "--like", "zz", "--out", tmp_path / "classes") == 2


def test_weights_from_a_file(tmp_path):
    (tmp_path / "w.yaml").write_text("coverage: 3\n")
    assert specs.load_weights(tmp_path / "w.yaml") == {"coverage": 3.0}
    for text in ("nothing: 1\n", "coverage: high\n", "[1]\n"):
        (tmp_path / "w.yaml").write_text(text)
        with pytest.raises(specs.SpecError):
            specs.load_weights(tmp_path / "w.yaml")


def test_kernels_do_not_depend_on_units():
    r = np.random.default_rng(5)
    x = r.normal(size=90).cumsum()
    y = 0.3 * x + r.normal(size=90)
    a, b = kernels.ols_hac(x[:, None], y), kernels.ols_hac(1e9 + 1e7 * x[:, None], 1e7 * y)
    assert math.isclose(a["t"][1], b["t"][1], rel_tol=1e-5) and math.isclose(a["f"], b["f"], rel_tol=1e-5)
    assert math.isclose(kernels.adf(x)[0], kernels.adf(1e8 * x)[0], rel_tol=1e-6)
