"""Programme eligibility, warning flags, outreach and enrolment rules.

Inputs use these columns:
elig (person_id, start_date, stop_date, plan_name), claims (person_id,
service_date, billing_tax_id, place, specialty_id), enroll (person_id,
facility_id, active_date, program, status, state, …), org (org_id, tax_id,
name, parent_name, five_star), registry (person_id, last_visit, next_appt),
specialties (specialty_id, attribution_level).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scalars import age_between, boundary_diff
from tabloom.operators.aggregates import flag_pivot, month_boundaries
from tabloom.operators.joins import (
    active_on, anti, exclude_all, latest_attr, match_any, not_in_history, semi,
)
from tabloom.operators.ranks import exists_since, group_transform, head_per_key
from tabloom.operators.relational import conform, fallback, flag, none_in, union_rows
from tabloom.session import stable

# Programme, status and reason codes of the enrolment system.
PROGRAM_WELLNESS = 268300000
STATUS_PARTICIPATING = 268300305
STATUS_RESOLVED = 268300303
STATUS_SELF_DISENROLLED = 268300313
OUTCOME_NOT_INTERESTED = 268300001
REASON_NO_USAGE = 268300002
STATE_ACTIVE = 0
OFFICE_PLACES = ["11", "22"]

# Drug classes counted per condition.
ASTHMA_CLASSES = ["12121200", "12120812", "12080800", "48489200", "52020000", "86160000"]
HYPERTENSION_CLASSES = [
    "24081600", "24082400", "24084400", "24200000", "24240000", "24280800", "24289200", "24320400",
]

# Flag -> (condition, visits needed); adults only where noted.
CONDITION_RULES = {
    "diabetes": ("diabetes", 1), "diabetes2": ("diabetes", 3), "stroke": ("stroke", 1),
    "htn": ("htn", 2), "htn_renal": ("htn_renal", 2), "cad": ("cad", 3), "chf": ("chf", 3),
    "copd": ("copd", 2), "asthma": ("asthma", 1), "pad": ("pad", 2),
}

# Spine surgery procedure and grouper codes by body region.
SPINE_PROCEDURES = {
    "lumbar": ["22533", "22558", "22586", "22612", "22630", "22633", "22857"],
    "cervical": ["22551", "22554", "22600", "22856"],
    "decompression": [
        "63001", "63005", "63011", "63012", "63020", "63030", "63040", "63042", "63045", "63047",
    ],
}
SPINE_GROUPERS = {
    "lumbar": ["459", "460"], "cervical": ["473", "472"], "decompression": ["518", "519", "520"],
}
SPINE_EXCLUDED_DIAGNOSES = [
    "I120", "I1311", "I132", "N184", "N186",
    "B20", "B9735", "D806", "D808", "D809", "D831", "R75", "Z21",
]
SPINE_EXCLUDED_DISCHARGES = ["20", "41", "42", "7"]


def five_star_orgs(org: DataFrame) -> DataFrame:
    """Tax id and location (parent name, else own name) of listed centres."""
    name = fallback("parent_name", "name").alias("center_name")
    return org.where("five_star").select(F.col("org_id").alias("facility_id"), "tax_id", name).distinct()


def wellness_universe(
    elig: DataFrame, claims: DataFrame, enroll: DataFrame, org: DataFrame, registry: DataFrame,
    specialties: DataFrame, as_of: Column, months: int = 9, min_days: int = 180, keep_no_claims: bool = False,
) -> DataFrame:
    """Long-standing participants with eligibility, plan, centre, visits and recent primary-care claims.

    ``keep_no_claims`` keeps participants without any such claim, so that the
    no-appointment rule can fire for them.
    """
    active = active_on(elig, "start_date", "stop_date", as_of)
    plan = latest_attr(active.where("plan_name is not null"), ["person_id"], ["stop_date", "plan_name"], ["plan_name"])
    spans = elig.where(F.col("stop_date") > as_of).select("person_id", "start_date", "stop_date").distinct()
    primary = specialties.where("attribution_level = 1").select("specialty_id").distinct()
    recent = claims.where((F.col("service_date") >= F.add_months(as_of, -months)) & F.col("place").isin(OFFICE_PLACES))
    recent = semi(recent, primary, ["specialty_id"]).select("person_id", "service_date", "billing_tax_id").distinct()
    participating = enroll.where(
        (F.col("program") == PROGRAM_WELLNESS) & (F.col("status") == STATUS_PARTICIPATING)
        & (F.col("state") == STATE_ACTIVE) & (F.datediff(as_of, "active_date") > min_days)
    ).select("person_id", "facility_id", "active_date").distinct()
    return (
        participating.join(spans, "person_id").join(plan, "person_id", "left")
        .join(recent, "person_id", "left" if keep_no_claims else "inner")
        .join(registry.select("person_id", "last_visit", "next_appt"), "person_id", "left")
        .join(five_star_orgs(org), "facility_id", "left").distinct()
    )


def center_usage(universe: DataFrame, org: DataFrame) -> DataFrame:
    """1 where the claim was billed by any listed centre."""
    listed = org.where("five_star").select(F.col("tax_id").alias("billing_tax_id")).distinct()
    marked = universe.join(listed.withColumn("__hit", F.lit(1)), "billing_tax_id", "left")
    return marked.withColumn("center_usage", F.coalesce("__hit", F.lit(0))).drop("__hit")


def _switch() -> Column:
    return F.col("tax_id").isNotNull() & (F.col("billing_tax_id") != F.col("tax_id")) & (F.col("center_usage") == 1)


def _in_network() -> Column:
    return F.col("billing_tax_id") == F.col("tax_id")


def wellness_flags_v1(universe: DataFrame, org: DataFrame, days: int = 270) -> DataFrame:
    """All rows with their warnings; the in-network lookback is relative to each claim."""
    rows = exists_since(stable(center_usage(universe, org)), ["person_id"], "service_date", _in_network(), days, "__near")
    rows = flag(rows, "warn_switch", _switch())
    rows = flag(rows, "warn_no_appointment", F.col("service_date").isNull() & F.col("next_appt").isNull())
    rows = flag(rows, "warn_no_usage", F.col("next_appt").isNull() & (F.col("__near") == 0))
    return rows.drop("__near").distinct()


def wellness_flags_v2(universe: DataFrame, org: DataFrame, as_of: Column, days: int = 270) -> DataFrame:
    """Flagged rows only; no usage means no in-network claim at all and none lately."""
    rows = stable(center_usage(universe, org))
    rows = group_transform(rows, ["person_id"], {"__ever": F.max(_in_network().cast("int"))})
    rows = flag(rows, "warn_switch", _switch())
    rows = flag(rows, "warn_no_appointment", F.col("service_date").isNull() & F.col("next_appt").isNull())
    no_visit = F.col("next_appt").isNull() | (F.datediff(as_of, "next_appt") >= 1)
    stale = F.datediff(as_of, "service_date") >= days
    rows = flag(rows, "warn_no_usage", no_visit & stale & (F.coalesce("__ever", F.lit(0)) == 0))
    hit = (F.col("warn_switch") == 1) | (F.col("warn_no_appointment") == 1) | (F.col("warn_no_usage") == 1)
    return rows.where(hit).drop("__ever").distinct()


def wellness_actions(
    universe: DataFrame, org: DataFrame, as_of: Column, days: int = 270, switch_days: int | None = 30
) -> DataFrame:
    """One action per row by priority, then latest switch per person and no-usage without any usage."""
    rows = center_usage(universe, org).where("tax_id is not null")
    since = F.coalesce(F.datediff(as_of, "service_date"), F.lit(0))
    same = F.coalesce(_in_network(), F.lit(False))
    no_usage = (F.col("next_appt").isNull() | (F.col("next_appt") <= as_of)) & (since >= days) & ~same
    usage = (since <= days) & same
    switch = F.coalesce(_switch(), F.lit(False))
    action = (
        F.when(switch & no_usage, "Switch Five Star").when(no_usage, "No Usage")
        .when(usage, "Usage").when(switch, "Switch Five Star")
    )
    rows = stable(rows.withColumn("action", action).where("action is not null"))  # read three times below
    used = rows.where("action = 'Usage'").select("person_id")
    quiet = anti(rows.where("action = 'No Usage'"), used, ["person_id"])
    moved = rows.where("action = 'Switch Five Star'")
    if switch_days is not None:
        moved = moved.where(F.col("service_date") >= F.date_sub(as_of, switch_days))
    moved = head_per_key(moved, ["person_id"], [F.desc("service_date"), F.asc("billing_tax_id"), F.asc("stop_date")])
    return union_rows(moved, quiet)


def wellness_episode_rows(
    actions: DataFrame, history: DataFrame, layout: T.StructType, constants: Mapping[str, object],
    keys: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(rows in the target layout not sent before, rows to add to the history)."""
    fresh = stable(not_in_history(conform(actions, layout, constants).distinct(), history, keys))
    return fresh, conform(fresh, history.schema)


def wellness_reinstate(
    enroll: DataFrame, claims: DataFrame, elig: DataFrame, org: DataFrame, flagged: DataFrame, as_of: Column,
    days: int = 270, warning_days: int = 90,
) -> DataFrame:
    """Resolved for no usage, flagged before, and back in network lately."""
    resolved = enroll.where(
        (F.col("program") == PROGRAM_WELLNESS) & (F.col("status") == STATUS_RESOLVED)
        & (F.col("state") == STATE_ACTIVE) & (F.col("warning_reason") == REASON_NO_USAGE)
        & (F.col("warning_date").isNull() | (F.col("warning_date") >= F.date_sub(as_of, warning_days)))
    ).select("person_id", "facility_id", "active_date", "warning_date").distinct()
    resolved = semi(resolved, flagged.where("action = 'No Usage'"), ["person_id"])
    covered = active_on(elig, "start_date", "stop_date", as_of).select("person_id")
    visits = semi(claims.where(F.col("service_date") >= F.date_sub(as_of, days)), covered, ["person_id"])
    visits = visits.select("person_id", "service_date", "billing_tax_id").distinct()
    out = resolved.join(five_star_orgs(org), "facility_id").join(visits, "person_id")
    return out.where(_in_network()).distinct()


def chronic_conditions(
    claims: DataFrame, dx_dim: DataFrame, codes: Sequence[str], as_of: Column, days: int = 400,
    rules: Mapping[str, tuple[str, int]] = CONDITION_RULES, adult: int = 18,
) -> DataFrame:
    """0/1 condition flags per adult from matching diagnoses per service date.

    claims needs line_id, person_id, dob, service_date and the code columns.
    """
    recent = claims.where((F.col("service_date") > F.date_sub(as_of, days)) & F.col("person_id").isNotNull())
    recent = recent.where(boundary_diff("year", F.col("dob"), as_of) >= adult)
    ids = ["line_id", "person_id", "service_date"]
    hits = match_any(recent, ids, codes, dx_dim, "dx", keep_code=True)
    visits = hits.groupBy("person_id", "condition", "service_date").agg(F.count(F.lit(1)).alias("visits"))
    return flag_pivot(visits, ["person_id"], "condition", "visits", rules)


def rx_utilization(
    rx: DataFrame, drugs: DataFrame, as_of: Column, days: int = 400,
    classes: Mapping[str, Sequence[str]] = {"asthma_fills": ASTHMA_CLASSES, "htn_fills": HYPERTENSION_CLASSES},
) -> DataFrame:
    """Distinct fills, a three-month span and fills per drug class."""
    recent = rx.where(F.col("process_date") >= F.date_sub(as_of, days))
    listed = drugs.select("gpi").distinct().withColumn("__listed", F.lit(1))
    span = month_boundaries(F.min("fill_date"), F.max("fill_date")) >= 2
    return recent.join(listed, "gpi", "left").groupBy("person_id").agg(
        F.count_distinct("claim_nr").alias("n_claims"),
        F.when(span, 1).otherwise(0).alias("has_three_months"),
        F.count("__listed").alias("diabetes_fills"),
        *[F.count_if(F.col("ahfs").isin(list(v))).alias(k) for k, v in classes.items()],
    )


def enroll_candidates(
    elig: DataFrame, enroll: DataFrame, conditions: DataFrame, rx: DataFrame, as_of: Column
) -> DataFrame:
    """Known, eligible people without a blocking engagement who meet any condition rule."""
    people = active_on(elig, "start_date", "stop_date", as_of).select("person_id").distinct()
    people = semi(people, enroll, ["person_id"])
    wellness = F.col("program") == PROGRAM_WELLNESS
    free = exclude_all(people, enroll, ["person_id"], [
        wellness & (F.col("state") == STATE_ACTIVE),
        wellness & (F.col("status") == STATUS_SELF_DISENROLLED),
        wellness & (F.col("outcome") == OUTCOME_NOT_INTERESTED),
    ])
    rows = free.join(conditions, "person_id", "left").join(rx, "person_id", "left").na.fill(0)
    c = F.col
    rules = [
        (c("diabetes") == 1) & (c("diabetes_fills") >= 1), c("diabetes2") == 1, c("has_three_months") == 1,
        (c("asthma") == 1) & (c("asthma_fills") >= 1), (c("htn") == 1) & (c("htn_fills") >= 2),
        *[c(k) == 1 for k in ("stroke", "htn_renal", "cad", "chf", "copd", "pad")],
    ]
    return rows.where(reduce(lambda a, b: a | b, rules)).select("person_id").distinct()


def spine_region(hcpcs: Column, drg: Column) -> Column:
    """Body region by procedure code, else by grouper code (blanks trimmed)."""
    out = F.lit(None).cast("string")
    for region in reversed(SPINE_PROCEDURES):
        out = F.when(F.trim(drg).isin(SPINE_GROUPERS[region]), region).otherwise(out)
    for region in reversed(SPINE_PROCEDURES):
        out = F.when(hcpcs.isin(SPINE_PROCEDURES[region]), region).otherwise(out)
    return out


def spine_care_group(claims: DataFrame) -> DataFrame:
    out = claims.withColumn("care_group", spine_region(F.col("hcpcs"), F.col("drg_code")))
    return out.where("care_group is not null")


def spine_outreach(
    claims: DataFrame, people: DataFrame, zips: DataFrame, diagnoses: Sequence[str], as_of: Column, years: int = 1
) -> DataFrame:
    """Recent spine surgery claims of living adults in the catchment without excluded conditions."""
    adults = people.where(age_between(F.col("dob"), 18, 75, as_of)).select("person_id", "dob").distinct()
    area = zips.where("in_catchment = 1 and is_valid = 1").select("zip")
    kept = claims.where(
        (F.col("paid") > 0) & (F.col("is_maternity") == 0) & F.col("deceased").isNull()
        & ~F.col("discharge").isin(SPINE_EXCLUDED_DISCHARGES)
        & none_in(diagnoses, SPINE_EXCLUDED_DIAGNOSES)
        & (F.col("service_date") > F.add_months(as_of, -12 * years))
    )
    kept = semi(spine_care_group(kept), area, ["zip"]).join(adults, "person_id")
    return kept.distinct()
