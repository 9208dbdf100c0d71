"""Column functions on the driver's tables."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.functions import scalars as S

AS_OF = "date '2002-03-01'"
HAVERSINE_SQL = """2 * 6371.0 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2))
  * pow(sin(radians(lon2 - lon1) / 2), 2)), sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1))
  * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"""


@query("str_concat", """select c_custkey, concat_ws(' ', c_name, coalesce(case when c_nationkey % 2 = 0 then c_mktsegment end, ''),
  cast(c_nationkey as varchar)) as address from customer""")
def _concat(t):
    rows = t.customer.withColumn("seg", F.expr("case when c_nationkey % 2 = 0 then c_mktsegment end"))
    return rows.select("c_custkey", S.concat_blank(["c_name", "seg", "c_nationkey"]).alias("address"))


@query("str_split_last_char", "select p_partkey, left(p_brand, length(p_brand) - 1) as rest, right(p_brand, 1) as last from part")
def _last(t):
    rest, last = S.split_last(F.col("p_brand"))
    return t.part.select("p_partkey", rest.alias("rest"), last.alias("last"))


@query("str_drop_suffix", "select l_orderkey, l_linenumber, cast(l_partkey * 10 as varchar) as id from lineitem")
def _suffix(t):
    text = F.col("l_partkey").cast("double") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             S.drop_suffix(F.concat(text.cast("bigint").cast("string"), F.lit(".0"))).alias("id"))


@query("str_strip_charset", "select c_custkey, ltrim(c_name, 'Custom#0') as left_cut, rtrim(cast(c_custkey as varchar), '.0') as right_cut from customer")
def _strip(t):
    return t.customer.select("c_custkey", S.strip_set(F.col("c_name"), "Custom#0", "left").alias("left_cut"),
                             S.strip_set(F.col("c_custkey").cast("string"), ".0", "right").alias("right_cut"))


@query("str_replace_chars", "select doc_id, replace(replace(text, ',', ''), '.', '') as text from documents")
def _replace(t):
    return t.documents.select("doc_id", S.replace_chars(F.col("text"), ",.").alias("text"))


@query("str_case", "select p_partkey, upper(p_name) as up, lower(p_type) as low from part")
def _case(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"))


@query("str_split_expand", """select o_orderkey, split_part(o_orderpriority, '-', 1) as level,
  nullif(split_part(o_orderpriority, '-', 2), '') as label, cast(null as varchar) as extra from orders""")
def _expand(t):
    cols = S.split_expand(F.col("o_orderpriority"), "-", 3)
    return t.orders.select("o_orderkey", *[c.alias(n) for c, n in zip(cols, ["level", "label", "extra"])])


@query("str_split_explode", """select doc_id, trim(w) as part from (select doc_id, unnest(string_split(text, ',')) as w from documents)
where trim(w) <> ''""")
def _explode(t):
    return S.split_rows(t.documents.select("doc_id", F.col("text").alias("part")), "part")


@query("str_length_rule", "select doc_id, case when length(text) > 820 then 1 else 0 end as is_long from documents")
def _length(t):
    return t.documents.select("doc_id", F.when(F.length("text") > 820, 1).otherwise(0).alias("is_long"))


@query("str_reverse", "select p_partkey, reverse(p_name) as reversed from part")
def _reverse(t):
    return t.part.select("p_partkey", F.reverse("p_name").alias("reversed"))


@query("str_palindrome", """with w as (select l_orderkey, l_linenumber, cast(l_partkey as varchar) as w from lineitem)
select l_orderkey, l_linenumber, lower(replace(w, ' ', '')) = reverse(lower(replace(w, ' ', ''))) as is_same from w""")
def _palindrome(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.palindrome(F.col("l_partkey").cast("string")).alias("is_same"))


@query("str_char_counts", """select doc_id, ch, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[\\s\\S]')) as ch from documents)
group by doc_id, ch""")
def _chars(t):
    return S.char_counts(t.documents, "doc_id", "text")


@query("str_vowel_counts", "select doc_id, cast(length(text) - length(translate(text, 'aeiouAEIOU', '')) as int) as vowels from documents")
def _vowels(t):
    return t.documents.select("doc_id", S.count_of(F.col("text"), "aeiouAEIOU").alias("vowels"))


@query("str_suffix", "select p_partkey, p_name || '_item' as name from part")
def _add_suffix(t):
    return t.part.select("p_partkey", F.concat("p_name", F.lit("_item")).alias("name"))


TOKENS = {"articles": ["the ", "les "], "queries": ["que", "?"], "rings": ["ring"], "mail": ["@", "mail"]}


@query("str_token_match", """select doc_id, concat_ws(';', case when x like '%the %' or x like '%les %' then 'articles' end,
  case when x like '%@%' or x like '%mail%' then 'mail' end, case when x like '%que%' or x like '%?%' then 'queries' end,
  case when x like '%ring%' then 'rings' end) as labels from (select doc_id, lower(text || chr(10) || source) as x from documents)""")
def _tokens(t):
    return t.documents.select("doc_id", F.array_join(S.token_match(["text", "source"], TOKENS), ";").alias("labels"))


@query("str_levenshtein", "select p_partkey, cast(levenshtein(p_name, lower(p_type || ' ' || p_brand)) as int) as distance from part")
def _lev(t):
    other = F.lower(F.concat_ws(" ", "p_type", "p_brand"))
    return t.part.select("p_partkey", F.levenshtein(F.col("p_name"), other).alias("distance"))


@query("str_clean_lines", """select doc_id, coalesce(string_agg(trim(line, ' ' || chr(9) || chr(13)), chr(10) order by i)
  filter (trim(line, ' ' || chr(9) || chr(13)) <> ''), '') as text
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents) group by doc_id""")
def _lines(t):
    return t.documents.select("doc_id", S.clean_lines(F.col("text")).alias("text"))


# Dates

@query("date_age", f"""select o_orderkey, cast(date_part('year', {AS_OF}) - year(o_orderdate)
  - case when strftime({AS_OF}, '%m%d') < strftime(o_orderdate, '%m%d') then 1 else 0 end as int) as years from orders""")
def _age(t):
    return t.orders.select("o_orderkey", S.age(F.col("o_orderdate"), F.expr(AS_OF)).alias("years"))


@query("date_age_window", f"""select o_orderkey, cast(o_orderdate as date) + interval 3 year <= {AS_OF}
  and cast(o_orderdate as date) + interval 5 year >= {AS_OF} as in_window from orders""")
def _window(t):
    dob = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", S.age_between(dob, 3, 5, F.expr(AS_OF)).alias("in_window"))


@query("date_parts", """select event_id, cast(year(ts) as int) as year, cast(month(ts) as int) as month, cast(weekofyear(ts) as int) as week,
  cast(day(ts) as int) as day, cast(isodow(ts) - 1 as int) as day_of_week from events""")
def _parts(t):
    return t.events.select("event_id", *[c.alias(n) for n, c in S.date_parts(F.col("ts")).items()])


@query("date_month_bounds", """with m as (select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as s from orders)
select o_orderkey, s as month_start, last_day(s) as month_end, cast(s - interval 6 month as date) as lookback_start,
  s - 1 as lookback_end from m""")
def _bounds(t):
    cols = S.month_window(F.to_date("o_orderdate"), 6)
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in cols.items()])


@query("date_add_months", "select o_orderkey, cast(cast(o_orderdate as date) - interval 9 month as date) as d from orders")
def _months(t):
    return t.orders.select("o_orderkey", F.add_months(F.to_date("o_orderdate"), -9).alias("d"))


@query("date_add_days", "select o_orderkey, cast(o_orderdate as date) - 270 as d from orders")
def _days(t):
    return t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), -270).alias("d"))


@query("date_diff_days", """select l_orderkey, l_linenumber, l_partkey, cast(coalesce(date_diff('day', cast(o_orderdate as date),
  case when l_linenumber <> 3 then cast(l_shipdate as date) end), 0) as int) as days
from lineitem join orders on l_orderkey = o_orderkey""")
def _diff(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.when(F.col("l_linenumber") != 3, F.to_date("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.days_between(F.to_date("o_orderdate"), ship, 0).alias("days"))


@query("date_diff_boundaries", f"""select o_orderkey, cast(date_diff('month', o_orderdate, timestamp '2002-03-01') as int) as months,
  cast(date_diff('year', o_orderdate, timestamp '2002-03-01') as int) as years from orders""")
def _boundaries(t):
    a, b = F.col("o_orderdate"), F.expr(AS_OF)
    return t.orders.select("o_orderkey", S.boundary_diff("month", a, b).alias("months"), S.boundary_diff("year", a, b).alias("years"))


@query("date_parse_format", """select o_orderkey, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as d from orders""")
def _parse(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, "2001-13-45").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", S.parse_date(text).alias("d"))


@query("date_business_range", """select o_orderkey, d from (select o_orderkey, d, row_number() over (partition by o_orderkey order by d) as rn
  from (select o_orderkey, cast(unnest(generate_series(cast(o_orderdate as date) + 1, cast(o_orderdate as date) + 12, interval 1 day)) as date) as d
    from orders) where isodow(d) < 6) where rn <= 7""")
def _business(t):
    return t.orders.select("o_orderkey", F.explode(S.next_weekdays(F.to_date("o_orderdate"), 7)).alias("d"))


FREQ = "case o_orderkey % 7 when 0 then 'Daily' when 1 then 'weekday' when 2 then 'weekly' when 3 then 'monthly' when 4 then 'quarterly' when 5 then 'annual' else 'never' end"


@query("date_next_run", f"""with j as (select o_orderkey, cast(o_orderdate as date) as d, {FREQ} as f from orders)
select o_orderkey, f, cast(case lower(f) when 'daily' then d + 1
  when 'weekday' then d + cast(case isodow(d) when 5 then 3 when 6 then 2 else 1 end as int)
  when 'weekly' then d + 7 when 'monthly' then d + interval 1 month
  when 'quarterly' then d + interval 3 month when 'annual' then d + interval 12 month end as date) as next_date from j""")
def _next(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.expr(FREQ).alias("f"))
    return rows.select("o_orderkey", "f", S.next_run(F.col("d"), F.col("f")).alias("next_date"))


# Numbers

@query("math_log1p", """select l_orderkey, l_linenumber, ln(1 + l_quantity) as l_quantity, l_discount from lineitem""")
def _log1p(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return S.log1p_positive(rows, ["l_quantity", "l_discount"])


@query("math_ratio_eps", "select l_orderkey, l_linenumber, l_quantity / (l_discount + 0.01::double) as r from lineitem")
def _ratio(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.ratio(F.col("l_quantity"), F.col("l_discount"), 0.01).alias("r"))


ROW = "select l_orderkey, l_linenumber, l_quantity as a, case when l_partkey % 3 <> 0 then l_discount * 100 end as b, l_tax * 100 as c from lineitem"
ROW_EXPRS = ["l_orderkey", "l_linenumber", "l_quantity as a", "case when l_partkey % 3 <> 0 then l_discount * 100 end as b", "l_tax * 100 as c"]


@query("math_row_mean_std", f"""select l_orderkey, l_linenumber, round(list_avg([a, b, c]), 6) as mean,
  round(list_stddev_samp([a, b, c]), 6) as std from ({ROW})""")
def _row_stats(t):
    cols = [F.col(c) for c in "abc"]
    return t.lineitem.selectExpr(*ROW_EXPRS).select(
        "l_orderkey", "l_linenumber", F.round(S.row_mean(cols), 6).alias("mean"), F.round(S.row_std(cols), 6).alias("std"))


@query("math_entropy", f"""with r as (select l_orderkey, l_linenumber, a, coalesce(b, 0.0) as b, c from ({ROW})),
s as (select *, a + b + c + 1e-9 as t from r)
select l_orderkey, l_linenumber, round(-((a / t) * log2(a / t + 1e-6) + (b / t) * log2(b / t + 1e-6) + (c / t) * log2(c / t + 1e-6)), 6) as bits from s""")
def _entropy(t):
    return t.lineitem.selectExpr(*ROW_EXPRS).select(
        "l_orderkey", "l_linenumber", F.round(S.entropy([F.col(c) for c in "abc"]), 6).alias("bits"))


MONTHS = ", ".join(f"case when (c_custkey + {i}) % {i + 3} = 0 then {i} else 0 end as m{i}" for i in range(1, 7))


@query("math_recency_index", f"""select c_custkey, case when m6 > 0 then 6 when m5 > 0 then 5 when m4 > 0 then 4 when m3 > 0 then 3
  when m2 > 0 then 2 when m1 > 0 then 1 else 7 end as last_positive_index,
  case when m1 > 0 then 1 when m2 > 0 then 2 when m3 > 0 then 3 when m4 > 0 then 4 when m5 > 0 then 5 when m6 > 0 then 6 else 7 end
  as months_since from (select c_custkey, {MONTHS} from customer)""")
def _recency(t):
    rows = t.customer.selectExpr("c_custkey", *MONTHS.split(", "))
    cols = S.recency([F.col(f"m{i}") for i in range(1, 7)])
    return rows.select("c_custkey", *[c.alias(n) for n, c in cols.items()])


GEO = ["c_custkey", "40.5 + (c_custkey % 97) / 200.0D as lat1", "-74.2 + (c_custkey % 89) / 200.0D as lon1",
       "40.6 + (c_nationkey % 7) / 20.0D as lat2", "-74.0 + (c_nationkey % 5) / 20.0D as lon2"]


@query("math_haversine", f"""with g as (select {', '.join(GEO).replace('.0D', '.0::double')} from customer)
select c_custkey, round({HAVERSINE_SQL}, 6) as km from g""")
def _haversine(t):
    c = [F.col(x).cast("double") for x in ("lat1", "lon1", "lat2", "lon2")]
    return t.customer.selectExpr(*GEO).select("c_custkey", F.round(S.haversine(*c), 6).alias("km"))


@query("math_clock_fraction", """select event_id, (event_id % 15 * 60 + event_id % 60) / 900 as share from events""")
def _clock(t):
    clock = F.format_string("%02d:%02d", F.col("event_id") % 15, F.col("event_id") % 60)
    return t.events.select("event_id", S.clock_fraction(clock).alias("share"))


@query("math_factorial", "select p_partkey, cast(factorial(cast(p_size % 13 as int)) as bigint) as f from part")
def _factorial(t):
    return t.part.select("p_partkey", F.factorial(F.col("p_size") % 13).alias("f"))


@query("math_power", "select p_partkey, pow(p_size, 3) as cube from part")
def _power(t):
    return t.part.select("p_partkey", F.pow("p_size", F.lit(3)).alias("cube"))


@query("math_clip", "select l_orderkey, l_linenumber, least(greatest(l_quantity, 5.0), 40.0)::double as q from lineitem")
def _clip(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.clip(F.col("l_quantity"), 5.0, 40.0).alias("q"))


@query("math_extremes", "select l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey, l_orderkey) as top from lineitem")
def _extremes(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest("l_partkey", "l_suppkey", "l_orderkey").alias("top"))


@query("math_bin", """select p_partkey, case when p_size > 0 and p_size <= 40 then
  ((cast(ceil(p_size / 10) as int) - 1) * 10) || '-' || ((cast(ceil(p_size / 10) as int) - 1) * 10 + 9) end as bin from part""")
def _bin(t):
    return t.part.select("p_partkey", S.width_bin(F.col("p_size"), 10, 40).alias("bin"))


# Arrays, maps, JSON

ARR = "array(l_partkey % 50, l_suppkey % 50, cast(l_linenumber as bigint), cast(l_quantity as bigint))"
ARR_SQL = "[l_partkey % 50, l_suppkey % 50, cast(l_linenumber as bigint), cast(l_quantity as bigint)]"


@query("arr_hof", f"""with a as (select l_orderkey, l_linenumber, {ARR_SQL} as a from lineitem)
select l_orderkey, l_linenumber, array_to_string(list_transform(list_filter(a, lambda x: x % 2 = 1), lambda x: x * 2), ',') as odd_doubled,
  cast(list_sum(a) as bigint) as total from a""")
def _hof(t):
    a = F.expr(ARR)
    odd = F.transform(F.filter(a, lambda x: x % 2 == 1), lambda x: x * 2)
    total = F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(odd.cast("array<string>"), ",").alias("odd_doubled"),
                             total.alias("total"))


@query("arr_flatten", f"""with a as (select l_orderkey, l_linenumber, flatten([{ARR_SQL}, [l_partkey % 20, l_suppkey % 20]]) as a from lineitem)
select l_orderkey, l_linenumber, array_to_string(a, ',') as flat, array_to_string(list_filter(a, lambda x: x > 10), ',') as above_ten from a""")
def _flatten(t):
    nested = F.expr(f"array({ARR}, array(l_partkey % 20, l_suppkey % 20))")
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return t.lineitem.select("l_orderkey", "l_linenumber", text(S.flatten_where(nested)).alias("flat"),
                             text(S.flatten_where(nested, lambda x: x > 10)).alias("above_ten"))


@query("arr_explode_struct", """select o_orderkey, i as item, i * o_totalprice as amount from orders
join (select unnest([1, 2, 3]) as i) on i <= o_orderkey % 4
union all select o_orderkey, null, null from orders where o_orderkey % 4 = 0""")
def _unnest(t):
    items = F.expr("""case when o_orderkey % 4 = 0 then cast(array() as array<struct<item: int, amount: double>>)
      else transform(sequence(1, cast(o_orderkey % 4 as int)), i -> struct(i as item, i * o_totalprice as amount)) end""")
    return S.unnest(t.orders.select("o_orderkey", items.alias("items")), "items")


STRUCTS = "array(struct(l_suppkey % 7 as grade, 'b' as name), struct(l_partkey % 7 as grade, 'a' as name), struct(l_orderkey % 7 as grade, 'c' as name))"


@query("arr_sort_struct", """with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  list_sort([row(-(l_suppkey % 7), 'b'), row(-(l_partkey % 7), 'a'), row(-(l_orderkey % 7), 'c')]) as s from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform(s, lambda x: x[2] || cast(-x[1] as varchar)), ',') as ordered from s""")
def _sort(t):
    ordered = S.sort_structs(F.expr(STRUCTS), [("grade", True), ("name", False)])
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], x["grade"].cast("string"))), ",")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("ordered"))


@query("arr_intersect", """select l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_intersect(
  [l_partkey % 4, l_partkey % 5, l_partkey % 6], [l_suppkey % 4, l_suppkey % 5, l_suppkey % 6])), ',') as common from lineitem""")
def _intersect(t):
    a, b = [F.array(*[F.col(c) % k for k in (4, 5, 6)]) for c in ("l_partkey", "l_suppkey")]
    common = F.array_sort(F.array_intersect(a, b)).cast("array<string>")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(common, ",").alias("common"))


@query("arr_group_even_odd", f"""with a as (select l_orderkey, l_linenumber, l_partkey, {ARR_SQL} as a from lineitem)
select l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(a, lambda x: x % 2 = 0), ',') as even,
  array_to_string(list_filter(a, lambda x: x % 2 <> 0), ',') as odd from a""")
def _even_odd(t):
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.even_odd(F.expr(ARR)).alias("m"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey",
                    *[F.array_join(F.col("m")[k].cast("array<string>"), ",").alias(k) for k in ("even", "odd")])


NUMS, NUMS_SQL = "sequence(1L, 1 + o_orderkey % 5)", "range(1, 2 + o_orderkey % 5)"


@query("map_build", f"""select o_orderkey, array_to_string(list_transform({NUMS_SQL}, lambda x: x || '=' || (x * x)), ',') as squares from orders""")
def _build(t):
    return t.orders.select("o_orderkey", S.map_text(S.map_build(F.expr(NUMS), lambda x: x * x)).alias("squares"))


@query("map_invert", f"""select o_orderkey, array_to_string(list_transform({NUMS_SQL}, lambda x: (x * x) || '=' || x), ',') as roots from orders""")
def _invert(t):
    return t.orders.select("o_orderkey", S.map_text(S.map_invert(S.map_build(F.expr(NUMS), lambda x: x * x))).alias("roots"))


@query("map_sum", f"select o_orderkey, cast(list_sum(list_transform({NUMS_SQL}, lambda x: x * o_totalprice)) as double) as total from orders")
def _map_sum(t):
    m = S.map_build(F.expr(NUMS), lambda x: x * F.col("o_totalprice"))
    return t.orders.select("o_orderkey", S.map_sum(m).alias("total"))


@query("map_transform_values", """select o_orderkey, case when o_totalprice <= 250000 then round(o_totalprice * 0.9, 4) end as price,
  round(o_custkey * 0.9, 4)::double as member from orders""")
def _scale(t):
    m = F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("member"), F.col("o_custkey").cast("double"))
    cheap = S.map_scale(m, 0.9, lambda k, v: (k == "member") | (v <= 250000))
    rows = t.orders.select("o_orderkey", cheap.alias("m"))
    return rows.select("o_orderkey", *[F.round(F.try_element_at("m", F.lit(k)), 4).alias(k) for k in ("price", "member")])


@query("json_fields", "select event_id, cast(props->>'k' as int) as k from events")
def _json(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")
