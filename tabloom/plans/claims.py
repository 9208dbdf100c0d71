"""Consolidation of versioned transaction lines (claim, line, adjustment)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.aggregates import collapse_max, netted_flags, sum_or_max
from tabloom.operators.joins import anti, keep_group_max, recent_batches, semi
from tabloom.operators.ordered import join_back, position, running
from tabloom.operators.relational import any_in, code_between
from tabloom.session import stable


def claims_scope(
    claims: DataFrame, jobs: DataFrame, n: int, claim_key: str, batch_key: str
) -> DataFrame:
    """All rows of every claim touched by the last ``n`` batches, with batch attributes."""
    touched = semi(claims, recent_batches(claims, batch_key, n), [batch_key])
    scoped = semi(claims, touched.select(claim_key), [claim_key])
    return scoped.join(jobs, batch_key, "left").distinct()


def claims_collapse(
    scoped: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    use_max: Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per key (and ``by`` attributes): max of attributes, sum or max of measures."""
    flagged = scoped.withColumn("__max", use_max)
    group = [*keys, *by]
    attrs = [c for c in scoped.columns if c not in group and c not in measures]
    return flagged.groupBy(*group).agg(
        *[F.max(c).alias(c) for c in attrs],
        *[sum_or_max(m, F.max("__max")).alias(f"total_{m}") for m in measures],
    )


def claims_collapse_simple(
    claims: DataFrame, keys: Sequence[str], order: Sequence, measures: Sequence[str], fill_cols: Sequence[str]
) -> DataFrame:
    """Summed measures next to the last filled attributes of each key."""
    sums = claims.groupBy(*keys).agg(*[F.sum(m).alias(f"total_{m}") for m in measures])
    filled = claims_ffill(claims, keys, order, fill_cols)
    last = filled.groupBy(*keys).agg(
        *[F.max_by(c, F.struct(*order)).alias(c) for c in fill_cols]
    )
    return join_back(sums, last, keys)


def claims_cancel_flags(collapsed: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mark every row of a key whose measure nets to zero."""
    return join_back(collapsed, netted_flags(collapsed, keys, measures, "cancel_"), keys)


def claims_ffill(scoped: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str]) -> DataFrame:
    """Last non-NULL value so far of late-filled attributes, per key."""
    filled = running(scoped, keys, order, {f"__f_{c}": ("last", F.col(c)) for c in cols})
    return filled.select(
        *[F.col(f"__f_{c}").alias(c) if c in cols else F.col(c) for c in scoped.columns]
    )


def claims_set(
    collapsed: DataFrame, filled: DataFrame, keys: Sequence[str], fill_cols: Sequence[str]
) -> DataFrame:
    """Collapsed rows with their flags and the filled attributes, one row per key."""
    late = filled.groupBy(*keys).agg(*[F.max(c).alias(c) for c in fill_cols])
    base = collapse_max(collapsed.drop(*fill_cols), keys)
    return join_back(base, late, keys)


def claims_consolidate(
    scoped: DataFrame, keys: Sequence[str], order: Sequence, measures: Sequence[str], fill_cols: Sequence[str],
    use_max: Column, by: Sequence[str], cancel_keys: Sequence[str],
) -> DataFrame:
    """Collapse, cancel flags and fill off one scoped read, joined to one row per key."""
    scoped = stable(scoped)  # collapse and fill both read it
    base = claims_collapse(scoped, keys, measures, use_max, by)
    base = claims_cancel_flags(base, cancel_keys, [f"total_{m}" for m in measures])
    return claims_set(base, claims_ffill(scoped, keys, order, fill_cols), keys, fill_cols)


def claims_prune(df: DataFrame, key: str, adj: str) -> DataFrame:
    """Drop rows below the key's highest adjustment."""
    return keep_group_max(df, [key], adj)


def claims_flat_insert(
    set_df: DataFrame, target: DataFrame, claim: str, adj: str, keys: Sequence[str]
) -> DataFrame:
    """Rows of each claim's highest adjustment that the target does not hold yet."""
    return anti(claims_prune(set_df, claim, adj), target, keys)


def claims_bridge_missing(
    clean: DataFrame, target: DataFrame, claim: str, line: str, adj: str
) -> DataFrame:
    """Newest lines whose adjustment is above anything the target holds."""
    held = target.groupBy(claim, line).agg(F.max(adj).alias("__held"))
    newer = join_back(clean, held, [claim, line])
    newer = newer.where(F.col("__held").isNull() | (F.col(adj) > F.col("__held"))).drop("__held")
    top = keep_group_max(newer, [claim, line], adj)
    return collapse_max(top, [claim, line, adj])


def claims_backfill_column(
    target: DataFrame, clean: DataFrame, keys: Sequence[str], col: str, where: Column
) -> DataFrame:
    """Fill NULLs of one column from the clean source for the selected rows."""
    source = clean.groupBy(*keys).agg(F.max(col).alias("__src"))
    joined = join_back(target, source, keys)
    value = F.when(F.col(col).isNull() & where, F.col("__src")).otherwise(F.col(col))
    return joined.withColumn(col, value).drop("__src")


def claims_inherit_ids(target: DataFrame, source: DataFrame, key: str, id_col: str) -> DataFrame:
    """Take an existing surrogate id where the target has none."""
    known = source.groupBy(key).agg(F.min(id_col).alias("__id"))
    joined = target.join(known, key, "left")
    return joined.withColumn(id_col, F.coalesce(id_col, "__id")).drop("__id").select(*target.columns)


def claims_mint_ids(target: DataFrame, key: str, id_col: str) -> DataFrame:
    """New consecutive ids above the current maximum, one per key without id."""
    top = target.agg(F.max(id_col)).first()[0] or 0
    missing = target.where(F.col(id_col).isNull()).select(key).distinct()
    minted = position(missing, [], [key], "__rn").select(key, (F.col("__rn") + top).alias("__id"))
    joined = target.join(minted, key, "left")
    return joined.withColumn(id_col, F.coalesce(id_col, "__id")).drop("__id").select(*target.columns)


# Billing codes that decide each care setting.
URGENT_HCPCS = ["S9083", "S9088"]
URGENT_PLACE, URGENT_NOT_SPECIALTY = "20", 66
URGENT_OFFICE_PLACE, URGENT_OFFICE_SPECIALTIES = "11", [28, 38, 186]
SURGICAL_REVENUE, SURGICAL_SPECIALTY = ["0490", "0499"], 8
FACILITY_TYPES = ["FANCL", "HOSP"]
ER_REVENUE, ER_RANGE = "0450", ("0451", "0459")
INPATIENT_RANGES = [("0100", "0179"), ("0200", "0219"), ("0800", "0809")]
ALL_PATIENT_GROUPER = "AP"
OUTPATIENT_PLACE = "22"
EMERGENCY_RANGE, EMERGENCY_VISITS = ("0450", "0459"), ("99281", "99285")


def care_rules(c: Mapping[str, str], procedures: Sequence[str], cpt: Sequence[str], icd: Sequence[str]) -> dict[str, Column]:
    """Line-level rules; ``c`` maps roles (hcpcs, place, …) to column names."""
    col = {role: F.col(name) for role, name in c.items()}
    facility = col["service"].isin(FACILITY_TYPES)
    return {
        "is_urgent_care": col["hcpcs"].isin(URGENT_HCPCS)
        | ((col["place"] == URGENT_PLACE) & (col["specialty"] != URGENT_NOT_SPECIALTY))
        | ((col["place"] == URGENT_OFFICE_PLACE) & col["specialty"].isin(URGENT_OFFICE_SPECIALTIES)),
        "is_surgical_center": col["revenue"].isin(SURGICAL_REVENUE) | (col["specialty"] == SURGICAL_SPECIALTY),
        "is_maternity": col["hcpcs"].isin(list(cpt)) | any_in(procedures, icd),
        "is_er": (col["revenue"] == ER_REVENUE) | (facility & col["revenue"].between(*ER_RANGE)),
        "is_inpatient": facility
        & (
            code_between(col["revenue"], INPATIENT_RANGES)
            | (col["drg"].isNotNull() & (col["drg_type"] != ALL_PATIENT_GROUPER))
        ),
        "is_outpatient": facility
        & (col["place"] == OUTPATIENT_PLACE)
        & ~col["revenue"].between(*EMERGENCY_RANGE)
        & ~col["hcpcs"].between(*EMERGENCY_VISITS),
    }


def claims_care_flags(lines: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Claim-level flags: 1 when any line of the claim satisfies the rule."""
    return lines.groupBy(key).agg(
        *[F.max(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in rules.items()]
    )


def claims_load_counts(target: DataFrame, staged: DataFrame) -> DataFrame:
    a = target.agg(F.count(F.lit(1)).alias("n_target"), F.lit(0).cast("long").alias("n_staged"))
    b = staged.agg(F.lit(0).cast("long").alias("n_target"), F.count(F.lit(1)).alias("n_staged"))
    both = a.unionByName(b).agg(F.sum("n_target").alias("n_target"), F.sum("n_staged").alias("n_staged"))
    return both.withColumn("difference", F.col("n_target") - F.col("n_staged"))


def surprise_bill(raw: DataFrame, keys: Sequence[str], line: str, adj: str, units: str, amount: str) -> DataFrame:
    """Highest line and adjustment, net units and amount; keep where either is positive."""
    out = raw.groupBy(*keys).agg(
        F.max(line).alias(line), F.max(adj).alias(adj),
        F.sum(units).alias(units), F.sum(amount).alias(amount),
    )
    return out.where((F.col(units) > 0) | (F.col(amount) > 0))
