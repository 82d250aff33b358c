"""Command line: query the catalog, assess joins, score and describe datasets, run a signal or a study, analyse a table, render a family.

Arguments that don't fit end with status 2, like those that argparse refuses; a query that finds nothing ends with 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sextant")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("query-datasources", "build-dataset-contract", "score-dataset", "assess-join"):
        p = commands.add_parser(name)
        p.add_argument("--registry", required=True, help="folder of the catalog")
        if name == "query-datasources":
            p.add_argument("--query", default="")
            for option in ("--domain", "--entry-kind", "--cadence", "--join-key"):
                p.add_argument(option)
            p.add_argument("--limit", type=int, default=20)
            p.add_argument("--healthcheck", action="store_true")
        elif name == "assess-join":
            p.add_argument("source")
            p.add_argument("target")
        else:
            p.add_argument("dataset")
            p.add_argument("--hypothesis")
            p.add_argument("--weights", help="YAML file of the axes' weights")
            p.add_argument("--target-cadence")
    p = commands.add_parser("run-signal")
    p.add_argument("spec")
    p.add_argument("--target")
    p.add_argument("--target-vintages")
    p.add_argument("--predictor", action="append", default=[], metavar="ID=PATH")
    p.add_argument("--out", required=True)
    p.add_argument("--date-col", default="date")
    p.add_argument("--value-col", default="value")
    p = commands.add_parser("render-family-dashboard")
    p.add_argument("runs", nargs="+")
    p.add_argument("--out", required=True)
    p = commands.add_parser("run-revision-momentum")
    p.add_argument("--vintages", action="append", required=True, metavar="ID=PATH")
    p.add_argument("--split", required=True, help="first day of the test period")
    p.add_argument("--reps", type=int, default=2000)
    p = commands.add_parser("run-reference-class")
    p.add_argument("--corpus", required=True)
    p.add_argument("--like", help="event whose analogues are wanted")
    for option in ("--disease-area", "--moa", "--target", "--indication", "--phase"):
        p.add_argument(option)
    p = commands.add_parser("run-family")
    p.add_argument("--predictor", action="append", required=True, metavar="TERM=PATH")
    p.add_argument("--target", required=True)
    p.add_argument("--lags", default="0,1,2")
    p.add_argument("--train-end", required=True)
    p = commands.add_parser("run-sell-the-news")
    p.add_argument("--features", help="CSV of events with their features; else they are made of:")
    p.add_argument("--events", help="CSV of event_id, ticker, catalyst_date")
    p.add_argument("--prices", help="CSV of ticker, date, close")
    p.add_argument("--market", help="ticker of the market among the prices")
    p.add_argument("--news", help="CSV of ticker, date, article_count, avg_tone")
    p.add_argument("--reps", type=int, default=2000)
    for p in (commands.choices[n] for n in ("run-revision-momentum", "run-reference-class", "run-family", "run-sell-the-news")):
        p.add_argument("--out", required=True)
    p = commands.add_parser("analyse")
    p.add_argument("mode")
    p.add_argument("--input", required=True)
    p.add_argument("--x")
    p.add_argument("--y")
    p.add_argument("--date-col", default="date")
    a = parser.parse_args(argv)
    if a.command == "render-family-dashboard":
        from sextant.plans.render import family_page

        Path(a.out).write_text(family_page([Path(x) for x in a.runs]))
        return 0
    from sextant.session import build_session

    spark = build_session()
    if a.command == "run-signal":
        from sextant.plans.signal import run_signal_from_paths
        from sextant.sources.specs import load_signal

        s = run_signal_from_paths(spark, load_signal(a.spec), dict(x.split("=", 1) for x in a.predictor), target_path=a.target, target_vintages=a.target_vintages, date=a.date_col, value=a.value_col, run_dir=a.out)
        print(json.dumps({"best_feature": s.best_feature, **s.gate, "relationship": s.relationship[0]}))
        return 0
    if a.command.startswith("run-") or a.command == "analyse":
        from sextant.plans.study import ArgumentsError

        try:
            print(json.dumps(study(spark, a), indent=2, default=str))
        except (ArgumentsError, FileNotFoundError) as e:
            print(f"sextant {a.command}: {e}", file=sys.stderr)
            return 2
        return 0
    from pyspark.sql import functions as F

    from sextant.operators import registry as R
    from sextant.sources.files import read_catalog
    from sextant.sources.specs import load_hypothesis, load_weights

    c = read_catalog(spark, a.registry)
    if a.command == "query-datasources":
        found = R.healthcheck(c) if a.healthcheck else R.query_catalog(c, a.query, domain=a.domain, entry_kind=a.entry_kind, cadence=a.cadence, join_key=a.join_key, limit=a.limit)
    elif a.command == "assess-join":
        keys = lambda i, n: c.datasets.where(F.col("id") == i).select(F.col("id").alias(f"{n}_id"), F.col("join_keys").alias(f"{n}_keys"), F.lit(1).alias("_one"))
        found = R.assess_joins(keys(a.source, "source").join(keys(a.target, "target"), "_one").drop("_one"))
    elif a.command == "score-dataset":
        found = R.fitness(c, load_hypothesis(a.hypothesis) if a.hypothesis else {}, load_weights(a.weights) if a.weights else None).where(F.col("id") == a.dataset)
    else:
        found = R.contracts(c, a.target_cadence).where(F.col("dataset_id") == a.dataset)
    rows = [json.loads(x) for x in found.toJSON().collect()]
    print(json.dumps(rows, indent=2))
    return 0 if rows else 1


def named(pairs: list[str]) -> list[tuple[str, str]]:
    """ID=PATH arguments."""
    from sextant.plans.study import ArgumentsError

    if bad := [x for x in pairs if "=" not in x]:
        raise ArgumentsError(f"{bad[0]!r} is not ID=PATH")
    return [tuple(x.split("=", 1)) for x in pairs]


def study(spark, a):
    """What a study or an analysis gives."""
    from functools import reduce

    from pyspark.sql import functions as F

    from sextant.plans import study as S
    from sextant.sources import files

    if a.command == "analyse":
        return S.analyse(S.read_table(spark, a.input, a.date_col), a.mode, x=a.x, y=a.y)
    if a.command == "run-revision-momentum":
        frames = [files.read_vintages(spark, path, name) for name, path in named(a.vintages)]
        return S.revision_study(reduce(lambda x, y: x.unionByName(y), frames), a.out, split=a.split, reps=a.reps)
    if a.command == "run-reference-class":
        chosen = {k: v for k in ("disease_area", "moa", "target", "indication", "phase") if (v := getattr(a, k))}
        return S.reference_class_study(files.read_corpus(spark, a.corpus), a.out, like=a.like, filters=chosen)
    if a.command == "run-sell-the-news":
        return S.sell_the_news_study(sell_the_news_features(spark, a), a.out, reps=a.reps)
    frames = [files.read_series(spark, path, name) for name, path in named(a.predictor)]
    target = files.read_series(spark, a.target, "target").select("obs_date", F.col("value").alias("t"))
    pairs = reduce(lambda x, y: x.unionByName(y), frames).select(F.col("series_id").alias("term"), "obs_date", F.col("value").alias("p")).join(target, "obs_date")
    return S.family_study(pairs, a.out, lags=[int(x) for x in a.lags.split(",")], train_end=a.train_end)


def sell_the_news_features(spark, a):
    """The events' features, from a file of them or from events, prices and news."""
    from pyspark.sql import functions as F

    from sextant.operators.events import NAMED, event_features
    from sextant.plans.study import ArgumentsError

    kinds = {"event_id": "string", "ticker": "string", "catalyst_date": "date", "date": "date"}

    def table(path: str, *needed: str):
        rows = spark.read.option("header", True).csv(path)
        if lacking := [c for c in needed if c not in rows.columns]:
            raise ArgumentsError(f"{path} has no column {', '.join(lacking)}")
        return rows.select(*needed, *(c for c in rows.columns if c not in needed)).select(*(F.expr(f"try_cast(`{c}` as {kinds.get(c, 'double' if c in needed else 'string')})").alias(c) for c in [*needed, *(c for c in rows.columns if c not in needed)]))

    if a.features:
        return table(a.features, "event_id", "catalyst_date", *NAMED)
    if not (a.events and a.prices):
        raise ArgumentsError("give --features, or --events and --prices")
    prices = table(a.prices, "ticker", "date", "close")
    market = prices.where(F.col("ticker") == a.market).select("date", "close") if a.market else None
    if market is not None and market.isEmpty():
        raise ArgumentsError(f"there are no prices of {a.market}")
    news = table(a.news, "ticker", "date", "article_count", "avg_tone") if a.news else None
    found = event_features(table(a.events, "event_id", "ticker", "catalyst_date"), prices, news, market=market)
    return found if a.news else found.withColumn("pre_news_intensity", F.lit(None).cast("double"))


if __name__ == "__main__":
    sys.exit(main())
