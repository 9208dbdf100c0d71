"""Line dedup by the number of distinct sites a line is seen on, in DataFrame operations only.

A HyperLogLog sketch of the sites per line hash is merged by aggregation. Lines
whose estimate is clearly above the threshold are boilerplate; those near it get
an exact distinct count first. Of a boilerplate line the first occurrence in the
corpus stays, so no text is lost altogether.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import staged, without

# A line counts if it has three words or more.
THREE_WORDS = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Settings:
    min_sites: int = 5  # a line on so many sites is boilerplate
    margin: float = 0.5  # estimates within this share of the threshold are counted exactly
    lg_k: int = 10  # size of a sketch, as a power of two


def occurrences(docs: DataFrame, site: str) -> DataFrame:
    """(doc_id, text_hash, place, h1, h2, site) of every line of three words or more.

    Lines are told apart by 128 bits. A null site counts as a site of its own.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
                        F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.where(F.col("line").rlike(THREE_WORDS))
    return lines.select("doc_id", "text_hash", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "site")


def boilerplate(lines: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(h1, h2, first) of the lines on ``min_sites`` sites or more; ``first`` is their first occurrence."""
    place = F.struct("doc_id", "text_hash", "place")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(s.lg_k)).alias("sketch"), F.min(place).alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = staged(spread.where(F.col("sites") >= s.min_sites * (1 - s.margin)), "spread")
    near = spread.where(F.col("sites") <= s.min_sites * (1 + s.margin)).select("h1", "h2")
    exact = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    found = spread.join(exact, ["h1", "h2"], "left")
    return found.where(F.coalesce("exact", "sites") >= s.min_sites).select("h1", "h2", "first")


def dedup(docs: DataFrame, site: str = "source", s: Settings = Settings()) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, plus ``n_lines`` and ``n_removed``.

    Lines are parted by a line feed. Of each boilerplate line all occurrences go
    but the first (smallest doc_id, null before all, then the place in the
    text); rows with the same id and text are treated alike. A null text stays
    null with no line; an emptied text is empty. Other columns stay as they are.
    """
    docs = without(docs, ("n_lines", "n_removed"))
    lines = staged(occurrences(docs, site), "lines")
    known = boilerplate(lines, s)
    # Distinct first: repeated rows give the same places.
    hits = lines.join(known, ["h1", "h2"]).where(~F.struct("doc_id", "text_hash", "place").eqNullSafe(F.col("first")))
    drops = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("place").alias("__drop"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    joined = docs.join(drops, same, "left")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_removed"))


SQL = rf"""with line as (select doc_id, source, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) as place from documents where text is not null),
  common as (select line, min((doc_id, place)) as first from line where regexp_matches(line, '{THREE_WORDS}')
    group by line having count(distinct coalesce(source, '')) >= 5),
  marked as (select l.doc_id, l.line, l.place, c.line is not null and (l.doc_id, l.place) <> c.first as gone
    from line l left join common c on l.line = c.line)
select doc_id, coalesce(string_agg(line, chr(10) order by place) filter (not gone), '') as text,
  count(*) as n_lines, count(*) filter (gone) as n_removed from marked group by doc_id
union all select doc_id, text, 0, 0 from documents where text is null"""
