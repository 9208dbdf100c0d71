"""Provider lists: cleaning, slowly changing state, affiliation, crosswalks, rate files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import drop_suffix, split_last, token_match, unnest
from tabloom.operators.joins import crosswalk, natural_join
from tabloom.operators.relational import make_key

# Score contribution per membership list.
AFFILIATION_WEIGHTS = {"mshs": -5, "nyp": 5, "northwell": 3, "nyu": 3, "presby": 3, "wmc": 3}


def provider_clean(raw: DataFrame, specialty_map: DataFrame, file_type: str = "SPS") -> DataFrame:
    """Split the location off the id, repair numeric ids, build the key, translate four specialties."""
    base, location = split_last(F.col("prov_id"))
    specs = [f"spec{i}" for i in range(1, 5)]
    rows = raw.select(
        base.alias("provider"), location.alias("location"),
        *[drop_suffix(F.col(c)).try_cast("bigint").alias(c) for c in ("npi", "tax_id")],
        *specs, "name", "address",
    )
    rows = rows.withColumn("flag_id", make_key(["provider", "location", "npi", "tax_id", "address"], "", ",."))
    codes = specialty_map.where(F.col("file_type") == file_type).select("specialty_code", "specialty_id").distinct()
    return crosswalk(rows, specs, codes, "specialty_code", "specialty_id").distinct()


def provider_scd(current: DataFrame, incoming: DataFrame, key: str, as_of: Column) -> DataFrame:
    """New full list: added rows dated, missing rows closed, returning rows reopened, history kept."""
    attrs = [c for c in incoming.columns if c != key]
    old = current.select(
        F.col(key), *[F.col(c).alias(f"__o_{c}") for c in attrs], "date_added", "date_removed"
    ).withColumn("__old", F.lit(1))
    new = incoming.distinct().withColumn("__new", F.lit(1))
    both = old.join(new, key, "full")
    listed = F.col("__new").isNotNull()
    known = F.col("__old").isNotNull()
    return both.select(
        key,
        *[F.when(known, F.col(f"__o_{c}")).otherwise(F.col(c)).alias(c) for c in attrs],
        F.coalesce("date_added", as_of).alias("date_added"),
        F.when(~listed, F.coalesce("date_removed", as_of)).alias("date_removed"),
    )


def provider_affiliation(
    providers: DataFrame, text_cols: Sequence[str], tokens: Mapping[str, Sequence[str]], npi_lists: DataFrame,
    referrals: DataFrame, systems: Mapping[str, str], weights: Mapping[str, int] = AFFILIATION_WEIGHTS,
) -> DataFrame:
    """Token labels, list memberships, referral counts and a weighted score, best first.

    npi_lists has (list, npi); referrals has (npi, system, ssn).
    """
    member = npi_lists.groupBy("npi").agg(
        *[F.max((F.col("list") == n).cast("int")).alias(n) for n in weights]
    )
    kept = referrals.where(F.col("system").isin(list(systems.values())) & F.col("npi").isNotNull())
    counts = kept.groupBy("npi").agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_distinct("ssn").alias("n_people"),
        *[F.count_if(F.col("system") == v).alias(f"{k}_refs") for k, v in systems.items()],
        *[F.count_distinct(F.when(F.col("system") == v, F.col("ssn"))).alias(f"{k}_people") for k, v in systems.items()],
    )
    rows = providers.withColumn("affiliations", F.array_join(token_match(text_cols, tokens), ";"))
    rows = rows.join(member, "npi", "left").join(counts, "npi", "left").na.fill(0)
    score = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in weights.items()]) + F.col("n_refs")
    return rows.withColumn("score", score).distinct().orderBy(F.desc("score"), "npi")


def hospital_crosswalk(linkage: DataFrame, tin_ccn: DataFrame, systems: DataFrame) -> DataFrame:
    """Hospital → tax id (shared columns) → system (left)."""
    return natural_join(linkage, tin_ccn).join(systems, "tin", "left").distinct()


def rate_file_flatten(doc: DataFrame) -> DataFrame:
    """Price-transparency documents to one row per provider and payment; empty arrays keep their row."""
    rows = unnest(doc, "out_of_network")
    rows = unnest(rows, "allowed_amounts")
    rows = rows.select("*", F.col("tin.type").alias("tin_type"), F.col("tin.value").alias("tin_value")).drop("tin")
    rows = unnest(rows, "payments")
    return unnest(rows, "providers", "provider_")
