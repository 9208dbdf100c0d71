"""A content-addressed manifest of a dataset, and a proof for every row from one descent through it.

Every row is hashed to a leaf; per group the leaves, in key order, are hashed
two by two until one node remains, and so are the groups' nodes. The store
holds digest → children for pages of up to ``2 ** bits`` nodes with the levels
between. Requests for all leaves go down from the root together: one row per
page and round, and each child chosen by its rank's digits takes along the
children not chosen. At the leaf the path is reversed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import staged
from tabloom.operators.ordered import position

BITS = 8  # levels per page: 256 nodes and what lies above them in one row


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _above(below: Column) -> Column:
    """The level above a level of nodes; a single last node is hashed alone."""
    pairs = F.sequence(F.lit(0), ((F.size(below) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))))


def _pages(nodes: DataFrame, bits: int) -> DataFrame:
    """Pages of consecutive nodes with their levels (lowest first) and their top.

    The only page of a group ends at its single node; any other has ``bits`` levels, so that a short last page
    sends single nodes up, each hashed alone.
    """
    entries = F.sort_array(F.collect_list(F.struct("pos", "digest", "row")))
    pages = nodes.groupBy("group", F.shiftright("pos", bits).alias("page"), "n").agg(entries.alias("nodes"))
    alone = F.ceil(F.log2(F.size("nodes").cast("double"))).cast("int")
    pages = pages.select("group", "page", "n", F.when(F.col("page") == 0, alone).otherwise(bits).alias("height"), F.col("nodes.row").alias("rows"),
                         F.col("nodes.digest").alias("__0"))
    for k in range(1, bits + 1):
        pages = pages.withColumn(f"__{k}", F.when(F.col("height") >= k, _above(F.col(f"__{k - 1}"))))
    pages = pages.select("group", "page", "n", "height", "rows", F.array(*[f"__{k}" for k in range(bits + 1)]).alias("levels"))
    return pages.withColumn("digest", F.get(F.get("levels", F.col("height")), F.lit(0)))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def build(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Records over the leaves, records of each layer above them, and (group, digest) of the groups' roots.

    ``nodes``: group, pos (from 0 in each group), digest, row (not null). A layer takes ``bits`` levels; 10 ** 11 rows
    have five.
    """
    sizes = nodes.groupBy(F.col("group").alias("__group")).agg(F.count(F.lit(1)).alias("n"))
    sizes = staged(sizes, "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes = nodes.join(sizes, F.col("group").eqNullSafe(F.col("__group"))).drop("__group")
    records, roots, full = [], [], 1 << bits
    while True:
        pages = staged(_pages(nodes, bits), "pages")
        records.append(pages.select("digest", "height", "levels", *([] if records else ["rows"])).dropDuplicates(["digest"]))
        roots.append(pages.where(F.col("n") <= full).select("group", "digest"))
        if most <= full:
            return records[0], records[1:], _union(roots)
        most = -(-most // full)
        nodes = pages.where(F.col("n") > full).select(
            "group", F.col("page").alias("pos"), "digest", F.lit(True).alias("row"), F.ceil(F.col("n") / full).alias("n"))


def _children(requests: DataFrame, records: DataFrame, bits: int) -> DataFrame:
    """The requests answered: every child of their pages with the path to it, from the root downwards."""
    hit = requests.withColumnRenamed("digest", "__of").join(records, F.col("__of") == F.col("digest")).drop("digest")
    hit = hit.select("*", F.posexplode(F.get("levels", F.lit(0))).alias("slot", "digest"))

    def step(j: Column) -> Column:
        k = F.call_function("shiftright", F.col("slot"), j)
        other = F.get(F.get("levels", j), k.bitwiseXOR(F.lit(1)))
        right = k.bitwiseAND(F.lit(1)) == 0
        return F.struct(F.when(~right, other).alias("left"), F.when(right, other).alias("right"))

    down = F.reverse(F.slice(F.array(*[F.lit(b) for b in range(bits)]), F.lit(1), F.col("height")))
    return hit.withColumn("path", F.concat("path", F.transform(down, step)))


def descend(requests: DataFrame, leaves: DataFrame, above: list[DataFrame], bits: int = BITS) -> DataFrame:
    """All leaves below the requested digests: ``row``, ``digest`` and ``path``, from the requested node downwards.

    ``requests``: digest, path (so far), and columns that are passed on. A request goes through as many layers above the
    leaves as its digest has below it.
    """
    names = requests.columns
    for layer in reversed(above):
        found = _children(requests, layer, bits).select(*names)
        requests = staged(found.unionAll(requests.join(layer, "digest", "left_anti").select(*names)), "requests")
    out = _children(requests, leaves, bits)
    return out.select(F.get("rows", F.col("slot")).alias("row"), *names)


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and a path from the leaf upwards give."""
    side = lambda c: F.coalesce(c, F.lit(""))
    return F.aggregate(path, start, lambda h, s: digest(side(s["left"]), h, side(s["right"])))


def siblings(path: Column) -> Column:
    """Digest of the path's nodes from the leaf upwards, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.coalesce(s["left"], s["right"], F.lit(""))), ""))


def manifest(rows: DataFrame, group: str, order: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` (with a column ``leaf``) with ``subroot``, ``root`` and ``path``: array<struct<left, right>>, leaf first.

    Groups are ordered by ``group`` (null first), leaves in a group by ``order`` (nulls first), then by digest; rows that
    are the same in all of it are interchangeable. A level without a sibling has an empty step. No rows give no rows.
    """
    rows = staged(rows, "leaves")
    placed = position(rows, [group], [*order, "leaf"], "__rn")
    nodes = placed.select(F.col(group).alias("group"), (F.col("__rn") - 1).alias("pos"), F.col("leaf").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    leaves, above, roots = build(nodes, bits)
    tops = position(roots, [], ["group"], "__rn")
    tops = tops.select(F.lit(0).alias("group"), (F.col("__rn") - 1).alias("pos"), "digest", F.lit(True).alias("row"))
    top_leaves, top_above, top = build(tops, bits)
    root = top.select("digest").first()
    spark = rows.sparkSession
    start = spark.createDataFrame([(root["digest"], [])] if root else [], "digest string, path array<struct<left:string,right:string>>")
    groups = descend(start, top_leaves, top_above, bits).select("digest", "path", F.col("digest").alias("subroot"))
    found = descend(groups, leaves, above, bits)
    return found.select("row.*", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.reverse("path").alias("path"))


def document_leaf(n_chars: Column) -> Column:
    """The leaf of a ``documents`` row, with the given length."""
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))])


def verify(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Proofs of all documents against the manifest of the untampered table, and what a tampered copy gives.

    In the tampered copy ``n_chars`` grows by one where 7 divides CRC-32 of the decimal doc_id; null ids and null
    lengths stay. Nulls are hashed as ``-``, so empty and null texts differ; repeated rows are leaves of their own.
    """
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(hit, document_leaf(F.col("n_chars") + 1))
    rows = docs.select("doc_id", "lang", document_leaf(F.col("n_chars")).alias("leaf"), changed.alias("changed"))
    found = manifest(rows, "lang", ["doc_id"], bits)
    found = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


# The same in SQL: levels of all groups by recursion, proofs as joins on (level, place), CRC-32 bit by bit.
SQL = """
with recursive
d as (select doc_id, source, lang, n_chars, text,
        list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) as crc
      from documents),
f as (select *, case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
             || case when source is null then '-' else strlen(source) || ':' || source end
             || case when lang is null then '-' else strlen(lang) || ':' || lang end as head,
           case when text is null then '-' else strlen(text) || ':' || text end as tail from d),
l as (select doc_id, lang,
        sha256(head || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || tail) as leaf,
        case when xor(crc, 4294967295) % 7 = 0 and n_chars is not null
             then sha256(head || strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) || tail) end as changed from f),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from l),
t as (
  select lang, 0 as lvl, pos, leaf as h, count(*) over (partition by lang) as n from p
  union all
  select lang, lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
  from (select *, lead(h) over (partition by lang order by pos) as nxt from t where n > 1) where pos % 2 = 0),
s as (select lang, h as subroot, lvl as height, row_number() over (order by lang nulls first) - 1 as gpos from t where n = 1),
u as (
  select 0 as lvl, gpos as pos, subroot as h, count(*) over () as n from s
  union all
  select lvl + 1, pos // 2, sha256(h || coalesce(nxt, '')), (n + 1) // 2
  from (select *, lead(h) over (order by pos) as nxt from u where n > 1) where pos % 2 = 0),
top as (select h as root, lvl as gheight from u where n = 1),
q as (select row_number() over () as id, p.*, s.subroot, s.height, s.gpos, top.root, top.gheight from p join s on s.lang is not distinct from p.lang cross join top),
steps as (
  select q.id, r.k, (q.pos >> r.k) & 1 as side, t.h from q, (select unnest(range(64)) as k) r
    left join t on t.lang is not distinct from q.lang and t.lvl = r.k and t.pos = xor(q.pos >> r.k, 1) where r.k < q.height
  union all
  select q.id, q.height + r.k, (q.gpos >> r.k) & 1, u.h from q, (select unnest(range(64)) as k) r
    left join u on u.lvl = r.k and u.pos = xor(q.gpos >> r.k, 1) where r.k < q.gheight),
path as (select id, list(struct_pack(side := side, h := coalesce(h, '')) order by k) as steps, string_agg(coalesce(h, ''), '' order by k) as proof from steps group by id),
walk as (
  select q.id, 1 as k, coalesce(changed, leaf) as h, coalesce(len(steps), 0) as n, steps, coalesce(proof, '') as proof from q left join path using (id)
  union all
  select id, k + 1, case when steps[k].side = 1 then sha256(steps[k].h || h) else sha256(h || steps[k].h) end, n, steps, proof from walk where k <= n)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from q join (select * from walk where k = n + 1) using (id)
"""
