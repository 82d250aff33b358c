"""Fields of nested JSON documents: trial results, drug records, approvals; and the small rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIAL = "struct<protocolSection:struct<statusModule:struct<overallStatus:string,primaryCompletionDateStruct:struct<date:string>>>,hasResults:boolean,resultsSection:struct<outcomeMeasuresModule:struct<outcomeMeasures:array<struct<type:string,analyses:array<struct<pValue:string>>>>>>>"
DRUG = "struct<drugType:string,mechanismsOfAction:struct<rows:array<struct<mechanismOfAction:string,targets:array<struct<approvedSymbol:string>>>>>,indications:struct<rows:array<struct<disease:struct<name:string>>>>>"
APPROVALS = "struct<submissions:array<struct<submission_type:string,submission_status:string,submission_status_date:string>>>"

# What kinds of drugs are called.
MODALITY = {"Small molecule": "small-molecule", "Antibody": "antibody", "Protein": "protein", "Oligonucleotide": "oligonucleotide", "Gene": "gene-therapy", "Cell": "cell-therapy", "Enzyme": "enzyme"}


def p_value(c: Column) -> Column:
    """The number after any of <, > and =; null for what is none."""
    return F.regexp_replace(F.trim(c), r"^[<>=\s]+", "").try_cast("double")


def primary_p_value(doc: str) -> Column:
    """Of a trial: the first number among the p-values of its primary outcomes."""
    measures = F.from_json(doc, TRIAL)["resultsSection"]["outcomeMeasuresModule"]["outcomeMeasures"]
    values = F.flatten(F.transform(F.filter(measures, lambda m: F.upper(m["type"]) == "PRIMARY"), lambda m: F.transform(F.coalesce(m["analyses"], F.array().cast("array<struct<pValue:string>>")), lambda a: p_value(a["pValue"]))))
    return F.get(F.filter(values, lambda v: v.isNotNull()), 0)


def outcome_of(status: Column, p: Column, alpha: float = 0.05) -> Column:
    """success or failure by the p-value; failure for trials that were stopped; else unknown."""
    return F.when(p.isNotNull(), F.when(p < alpha, "success").otherwise("failure")).when(F.upper(status).isin("TERMINATED", "WITHDRAWN", "SUSPENDED"), "failure").otherwise("unknown")


def first_approval(doc: str) -> Column:
    """The earliest date of an approved original submission, as a date."""
    rows = F.filter(F.from_json(doc, APPROVALS)["submissions"], lambda s: (s["submission_type"] == "ORIG") & (s["submission_status"] == "AP"))
    return F.to_date(F.array_min(F.transform(rows, lambda s: s["submission_status_date"])), "yyyyMMdd")


def first_symbol(doc: str) -> Column:
    rows = F.from_json(doc, DRUG)["mechanismsOfAction"]["rows"]
    symbols = F.flatten(F.transform(rows, lambda r: F.transform(F.coalesce(r["targets"], F.array().cast("array<struct<approvedSymbol:string>>")), lambda t: t["approvedSymbol"])))
    return F.get(F.filter(symbols, lambda s: s.isNotNull() & (s != "")), 0)


def modality(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MODALITY.items() for x in kv)), c), F.lower(c))


def resolved(rows: DataFrame, known: DataFrame, aliases: DataFrame, name: str = "drug") -> DataFrame:
    """``rows`` with ``resolved`` and ``path``: a name known directly, by its alias, or set by hand; else unresolved. Small tables of names."""
    key = F.lower(F.trim(F.col(name)))
    a = aliases.select(F.col("corpus_name").alias("_k"), F.lower("resolve_as").alias("_as"), "manual_moa", "manual_target", "manual_modality").dropDuplicates(["_k"])
    k = known.select(F.lower("name").alias("_n"), F.col("id").alias("_id")).dropDuplicates(["_n"])
    got = rows.withColumn("_k", key).join(a, "_k", "left").join(k.select(F.col("_n").alias("_k"), F.col("_id").alias("_direct")), "_k", "left").join(k.select(F.col("_n").alias("_as"), F.col("_id").alias("_alias")), "_as", "left")
    path = F.when(F.col("_direct").isNotNull(), "direct").when(F.col("_alias").isNotNull(), "alias").when(F.coalesce("manual_moa", "manual_target", "manual_modality").isNotNull(), "manual").otherwise("unresolved")
    return got.withColumn("path", path).withColumn("resolved", F.coalesce("_direct", "_alias")).select(*rows.columns, "resolved", "path", "manual_moa", "manual_target", "manual_modality")


def candidate_score(phase: Column, wanted_phase: Column, enrollment: Column, year: Column, wanted_year: Column, sponsor: Column, company: Column, has_results: Column) -> Column:
    """How well a trial fits an event; below zero without results."""
    near = F.greatest(F.lit(0), 3 - F.abs(year - wanted_year))
    token = F.contains(F.lower(sponsor), F.lower(F.split(company, r"\s+")[0]))
    score = F.when(phase == wanted_phase, 3).otherwise(0) + F.least(F.lit(4.0), F.coalesce(enrollment, F.lit(0)) / 500) + F.coalesce(near, F.lit(0)) + F.when(token, 1).otherwise(0)
    return F.when(F.coalesce(has_results, F.lit(False)), score).otherwise(F.lit(-1.0))
