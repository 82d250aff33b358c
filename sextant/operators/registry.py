"""A catalog of sources, datasets, fields and join keys: search, join assessment, contracts and fitness, as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.periods import AGGREGATION, CADENCES

# Keys that are times and places, and the weights of a dataset's fitness.
TIME_KEYS = ("DATE", "PERIOD", "MONTH", "QUARTER", "YEAR")
PLACE_KEYS = ("ISO_3", "ISO_3166_1", "ISO_3166_2", "US_STATE_CODE", "NUTS")
WEIGHTS = {"economic_proximity": 1.5, "coverage": 1.0, "cadence_fit": 1.2, "release_lag_clarity": 1.0, "point_in_time_safety": 1.3, "survivorship_bias_risk": 1.1, "api_scriptability": 0.8, "cost_access_practicality": 0.6}


@dataclass
class Catalog:
    """sources (id, name, domain, entry_kind, description, join_keys[], primary_keys[], geography[], use_cases[], lag, type[], cost,
    auth_required, license, frequency, homepage_url), datasets (id, source_id, name, entry_kind, time_index, time_grain[],
    primary_keys[], join_keys[], is_catalog), fields (source_id, dataset_id, name, type, role, join_key, ordinal), join_keys."""

    sources: DataFrame
    datasets: DataFrame
    fields: DataFrame
    join_keys: DataFrame


def all_datasets(sources: DataFrame, listed: DataFrame) -> DataFrame:
    """Datasets of the catalog, and each source without one that is no panel as a dataset of itself."""
    own = sources.where(F.coalesce(F.col("entry_kind"), F.lit("")) != "panel").join(listed.select(F.col("source_id").alias("id")), "id", "left_anti").join(listed.select("id"), "id", "left_anti")
    none = F.array().cast("array<string>")
    return listed.unionByName(own.select("id", F.col("id").alias("source_id"), "name", "entry_kind", F.lit(None).cast("string").alias("time_index"), none.alias("time_grain"), "primary_keys", "join_keys", F.lit(False).alias("is_catalog")))


def _hay(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def _scored(rows: DataFrame, query: str, hay: Column, limit: int) -> DataFrame:
    """The rows with most of the query's words somewhere in ``hay``; all, at a score of 1, for an empty query."""
    tokens = query.lower().split()
    if tokens:
        rows = rows.withColumn("matched_on", F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(hay, t))).withColumn("score", F.size("matched_on")).where("score > 0")
    else:
        rows = rows.withColumn("matched_on", F.array().cast("array<string>")).withColumn("score", F.lit(1))
    return rows.select("id", "name", "domain", "entry_kind", "score", "matched_on").orderBy(F.desc("score"), F.lower("name"), "id").limit(limit)


def search_sources(c: Catalog, query: str = "", *, domain: str | None = None, entry_kind: str | None = None, join_key: str | None = None, limit: int = 20) -> DataFrame:
    rows = c.sources
    for column, value in (("domain", domain), ("entry_kind", entry_kind)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.array_contains("join_keys", join_key)) if join_key else rows
    return _scored(rows, query, _hay(F.col("id"), F.col("name"), F.col("description"), F.concat_ws(" ", "use_cases"), F.concat_ws(" ", "join_keys")), limit)


def search_datasets(c: Catalog, query: str = "", *, domain: str | None = None, entry_kind: str | None = None, cadence: str | None = None, join_key: str | None = None, limit: int = 20) -> DataFrame:
    rows = c.datasets.join(c.sources.select(F.col("id").alias("source_id"), "domain", "description"), "source_id", "left")
    for column, value in (("domain", domain), ("entry_kind", entry_kind)):
        rows = rows.where(F.col(column) == value) if value else rows
    for column, value in (("time_grain", cadence), ("join_keys", join_key)):
        rows = rows.where(F.array_contains(column, value)) if value else rows
    return _scored(rows, query, _hay(F.col("id"), F.col("name"), F.col("description"), F.concat_ws(" ", "join_keys"), F.concat_ws(" ", "time_grain"), F.col("entry_kind")), limit)


def query_catalog(c: Catalog, query: str = "", **filters) -> DataFrame:
    """Datasets, or sources where no dataset is found."""
    found = search_datasets(c, query, **filters)
    return found if found.take(1) else search_sources(c, query, **{k: v for k, v in filters.items() if k != "cadence"})


def compatible_sources(c: Catalog, dataset_id: str, limit: int = 20) -> DataFrame:
    """Other sources with join keys in common, most first."""
    own = c.datasets.where(F.col("id") == dataset_id).select(F.col("join_keys").alias("_keys"), F.col("source_id").alias("_own"))
    rows = c.sources.join(F.broadcast(own), F.arrays_overlap("join_keys", "_keys") & (F.col("id") != F.col("_own")))  # own: one row
    return rows.select("id", "name", F.array_intersect("join_keys", "_keys").alias("shared"), F.size(F.array_intersect("join_keys", "_keys")).alias("overlap")).orderBy(F.desc("overlap"), F.lower("name"), "id").limit(limit)


def assess_joins(pairs: DataFrame, a: str = "source_keys", b: str = "target_keys") -> DataFrame:
    """Pairs with ``direct`` keys (in the target's order), ``join_quality`` and ``warnings``."""
    direct = F.filter(F.col(b), lambda k: F.array_contains(a, k))
    has = lambda keys, of: F.arrays_overlap(of, F.array(*map(F.lit, keys)))
    pairs = pairs.withColumn("direct", direct)
    time, place = has(TIME_KEYS, F.col("direct")), has(PLACE_KEYS, F.col("direct"))
    n = F.size("direct")
    some_place = has(PLACE_KEYS, F.concat(a, b))
    quality = F.when(n == 0, "incompatible").when((n == 1) & ~time, "weak").when(time & ~place & some_place, "medium").when(time & place, "strong").otherwise("medium")
    warning = F.when(n == 0, "no shared keys").when((n == 1) & ~time, "one key, and no time").when(time & ~place & some_place, "times meet, places differ")
    return pairs.withColumn("join_quality", quality).withColumn("warnings", F.array_compact(F.array(warning)))


def _rank(grain: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, CADENCES)), grain), F.lit(0)) - 1


def fitness(c: Catalog, hypothesis: dict[str, str], weights: dict[str, float] | None = None) -> DataFrame:
    """Each dataset's eight axes from 1 to 10, and their weighted mean ``fit``, rounded to two digits."""
    w = WEIGHTS | (weights or {})
    s = c.sources.select(F.col("id").alias("source_id"), F.col("name").alias("s_name"), "domain", F.col("entry_kind").alias("s_kind"), "description", "use_cases", "geography", "lag", "type", "cost", "auth_required")
    rows = c.datasets.select("id", "source_id", "entry_kind", "time_grain").join(s, "source_id")
    tokens = [t for t in " ".join(hypothesis.get(k) or "" for k in ("statement", "target_variable", "mechanism")).lower().split() if len(t) > 3]
    hay = _hay(F.col("description"), F.col("s_name"), F.concat_ws(" ", "use_cases"))
    hits = F.size(F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(hay, t))) if tokens else F.lit(0)
    expected = (hypothesis.get("target_cadence") or "").lower()
    grains = F.transform("time_grain", F.lower)
    ranks = F.filter(F.transform(grains, _rank), lambda r: (r >= 0) & (r < 5))
    finest = F.array_min(ranks)
    cadence = F.when(F.size(grains) > 0, 7).otherwise(4) if not expected else F.when(F.array_contains(grains, expected), 10).when((F.size(grains) == 0) | F.lit(expected not in CADENCES[:5]), 5).when(finest < (CADENCES.index(expected) if expected in CADENCES else 0), 8).otherwise(3)
    told = _hay(F.col("description"), F.col("lag"))
    cost, auth = F.lower(F.coalesce("cost", F.lit(""))), F.lower(F.coalesce("auth_required", F.lit("")))
    axes = {
        "economic_proximity": F.least(F.lit(10), 2 + F.bround(hits * 8 / F.lit(max(1, len(tokens)))).cast("int")) if tokens else F.lit(5),
        "coverage": F.when(F.size(F.coalesce("geography", F.array().cast("array<string>"))) == 0, 4).when(F.array_contains("geography", "global"), 9).when(F.size("geography") > 1, 7).otherwise(6),
        "cadence_fit": cadence,
        "release_lag_clarity": F.when(F.coalesce("lag", F.lit("")) != "", 8).otherwise(4),
        "point_in_time_safety": F.when(F.contains(told, F.lit("restated")) | F.contains(told, F.lit("revisions")), 3).when(F.col("s_kind").isin("registry", "corpus"), 8).when(F.col("s_kind") == "time-series", 6).otherwise(5),
        "survivorship_bias_risk": F.when((F.col("domain") == "finance-markets") & (F.col("entry_kind") == "time-series"), 4).otherwise(8),
        "api_scriptability": F.when(F.arrays_overlap("type", F.array(F.lit("rest-api"), F.lit("bulk-download"))), 9).when(F.array_contains("type", "scrape"), 4).otherwise(6),
        "cost_access_practicality": F.greatest(F.lit(1), F.when(cost.isin("free", ""), 10).when(F.contains(cost, F.lit("freemium")), 5).otherwise(3) - F.when(F.contains(auth, F.lit("account")) | F.contains(auth, F.lit("api-key")), 1).otherwise(0)),
    }
    rows = rows.select("id", *(v.cast("int").alias(k) for k, v in axes.items()))
    total = sum(w.values())
    return rows.withColumn("fit", F.bround(sum((F.col(k) * v for k, v in w.items() if k in axes), F.lit(0.0)) / total, 2))


def contracts(c: Catalog, target_cadence: str | None = None) -> DataFrame:
    """A row for each dataset: native and target cadence, variable type and aggregation, date, value and entity fields, keys, limitations."""
    s = c.sources.select(F.col("id").alias("source_id"), "domain", F.col("entry_kind").alias("s_kind"), "description", "auth_required", "cost", "license", "lag", "frequency", "homepage_url")
    of = lambda role: F.when(F.col("role") == role, F.struct("ordinal", "name"))
    f = c.fields.groupBy(F.col("dataset_id").alias("id")).agg(F.min(of("time_index")).alias("_t"), F.min(of("measure")).alias("_v"), F.array_sort(F.collect_list(of("dimension"))).alias("_e"), F.array_sort(F.collect_set("join_key")).alias("_k"))
    rows = c.datasets.join(s, "source_id").join(f, "id", "left")
    best = F.array_min(F.transform("time_grain", lambda g: F.struct(F.when(_rank(g) >= 0, _rank(g)).otherwise(99).alias("r"), g.alias("g"))))
    rows = rows.withColumn("native_cadence", F.coalesce(best["g"], F.lit("irregular")))
    kind, domain = F.lower(F.coalesce("s_kind", F.lit(""))), F.lower(F.coalesce("domain", F.lit("")))
    rows = rows.withColumn("variable_type", F.when((kind == "time-series") & F.contains(domain, F.lit("finance")), "price").when(kind == "registry", "event").when(F.contains(domain, F.lit("consumer-signal")) | F.contains(F.lower("description"), F.lit("sentiment")), "sentiment").otherwise("flow"))
    how = F.create_map(*(F.lit(x) for kv in AGGREGATION.items() for x in kv))
    asked = F.lit(target_cadence) if target_cadence else F.when(F.col("native_cadence").isin("monthly", "quarterly"), F.col("native_cadence")).otherwise("monthly")
    limits = F.array_compact(F.array(F.when(F.col("_k").isNull(), "no field schema"), F.when(F.coalesce("auth_required", F.lit("none")) != "none", F.concat(F.lit("auth_required: "), "auth_required")), F.when(F.coalesce("cost", F.lit("free")) != "free", F.concat(F.lit("cost: "), "cost"))))
    return rows.select(
        F.col("id").alias("dataset_id"), "source_id", "native_cadence", asked.alias("target_cadence"), "variable_type", F.coalesce(F.try_element_at(how, F.col("variable_type")), F.lit("mean")).alias("aggregation"), F.coalesce(F.col("_t.name"), F.col("time_index")).alias("date_field"), F.col("_v.name").alias("value_field"),
        F.transform("_e", lambda x: x["name"]).alias("entity_fields"), F.when(F.size("join_keys") > 0, F.col("join_keys")).otherwise(F.coalesce("_k", F.array().cast("array<string>"))).alias("available_keys"), limits.alias("known_limitations"), "license", "lag", "frequency", "homepage_url",
    )


def healthcheck(c: Catalog) -> DataFrame:
    """Rows (view, n, warning): counts, and what is missing or points nowhere."""
    count = lambda name, df: df.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n"))
    got = count("sources", c.sources).union(count("datasets", c.datasets)).union(count("fields", c.fields)).union(count("join_keys", c.join_keys)).withColumn("warning", F.when(F.col("n") == 0, "empty"))
    lost = c.datasets.join(c.sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").agg(F.lit("datasets without a source").alias("view"), F.count(F.lit(1)).alias("n"))
    return got.union(lost.withColumn("warning", F.when(F.col("n") > 0, "unknown source_id")))


def with_position(fields: DataFrame) -> DataFrame:
    """Fields with their order in the file, where it is not given: by name."""
    return fields.withColumn("ordinal", F.row_number().over(Window.partitionBy("dataset_id").orderBy("name")))


