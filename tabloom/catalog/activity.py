"""Job ledger, plays and daily series on the driver's tables."""

from pyspark.sql import functions as F

from tabloom.catalog import query
from tabloom.operators import series as S
from tabloom.operators.ordered import attach
from tabloom.plans import jobs as J
from tabloom.plans import plays as P

DAY = "date '2001-07-20'"
LEDGER = ["o_orderkey as job_id", "o_orderpriority as job_type", "concat('d', o_custkey % 5) as description",
          "cast(o_orderdate as date) as job_start", "case when o_orderstatus = 'F' then cast(o_orderdate as date) end as job_end",
          "cast(date_trunc('month', o_orderdate) as date) as period_from", "last_day(cast(o_orderdate as date)) as period_to"]
REQUESTS = ["o_orderpriority as job_type", "concat('d', c_custkey % 7) as description", "date '2001-08-02' as job_start",
            "cast(date_trunc('month', o_orderdate) as date) as period_from", "last_day(cast(o_orderdate as date)) as period_to"]
LEDGER_SQL = f"ledger as (select {', '.join(LEDGER)} from orders)"


def ledger(t):
    return t.orders.selectExpr(*LEDGER)


@query("job_register", f"""with {LEDGER_SQL},
req as (select distinct {', '.join(REQUESTS)} from orders join customer on c_custkey = o_custkey),
fresh as (select * from req r where not exists (select 1 from ledger l where l.job_type = r.job_type and l.description = r.description
  and l.period_from = r.period_from and l.period_to = r.period_to))
select * from ledger union all
select (select max(job_id) from ledger) + row_number() over (order by job_type, description, period_from, period_to), job_type, description,
  job_start, null, period_from, period_to from fresh""")
def _register(t):
    req = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*REQUESTS)
    return J.job_register(ledger(t), req)


@query("job_detail_append", """select o_orderkey as job_id, 'rows=' || o_custkey as info from orders
union all select o_orderkey, 'status=' || o_orderstatus from orders where o_orderstatus <> 'F'""")
def _detail(t):
    details = t.orders.selectExpr("o_orderkey as job_id", "concat('rows=', o_custkey) as info")
    jobs = t.orders.where("o_orderstatus <> 'F'").selectExpr("o_orderkey as job_id", "o_orderstatus")
    return J.job_detail_append(details, jobs, F.concat(F.lit("status="), F.col("o_orderstatus")))


@query("job_close", f"""with {LEDGER_SQL}, done as (select l_orderkey as job_id, max(cast(l_shipdate as date)) as ended from lineitem
  where l_returnflag = 'R' group by all) select l.job_id, job_type, job_start, coalesce(ended, job_end) as job_end from ledger l left join done d on d.job_id = l.job_id""")
def _close(t):
    done = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.max(F.to_date("l_shipdate")).alias("ended"))
    return J.job_close(ledger(t), done).select("job_id", "job_type", "job_start", "job_end")


@query("job_failures", f"""with {LEDGER_SQL} select l.job_id, l.job_type, l.job_start, 'line ' || l_linenumber as info from ledger l
join lineitem on l_orderkey = l.job_id where job_end is null and job_start >= {DAY} - 1""")
def _failures(t):
    details = t.lineitem.selectExpr("l_orderkey as job_id", "concat('line ', l_linenumber) as info")
    return J.job_failures(ledger(t), details, F.expr(DAY))


MONITOR = ["o_orderkey as last_job", "o_orderpriority as job_type", "o_orderstatus as file_type",
           "case o_orderkey % 4 when 0 then 'weekly' when 1 then 'monthly' when 2 then 'annual' else 'quarterly' end as frequency",
           "cast(o_orderdate as date) as last_start", "case when o_orderstatus = 'F' then cast(o_orderdate as date) end as last_end",
           "o_orderkey % 6 = 0 as has_error", "cast(o_orderkey % 90 as int) as grace_days", "o_orderkey % 12 = 0 as ignore_error",
           "o_orderkey % 5 = 0 as ignore_missed", "o_orderkey % 10 = 3 as ignore_open"]


@query("job_health", f"""with m as (select {', '.join(MONITOR)} from orders),
d as (select *, cast(case frequency when 'weekly' then last_start + 7 when 'monthly' then last_start + interval 1 month
  when 'annual' then last_start + interval 12 month else last_start + interval 3 month end as date) as due from m),
f as (select *, has_error and not ignore_error as e, due < {DAY} and not ignore_missed as s,
  last_end is null and date_diff('day', last_start, {DAY}) > grace_days and not ignore_open as o, job_type || '-' || file_type as name from d)
select last_job, job_type, file_type, due as next_start, case when e then 1 else 0 end as report_error, case when s then 1 else 0 end as report_missed,
  case when o then 1 else 0 end as report_open, concat_ws(chr(10), case when e then name || ': error in job ' || last_job end,
  case when s then name || ': did not run, expected ' || due end, case when o then name || ': not completed within ' || grace_days || ' days' end) as message from f""")
def _health(t):
    return J.job_health(t.orders.selectExpr(*MONITOR), F.expr(DAY))


PLAYS = ["l_orderkey as game_id", "l_linenumber as play_id", "l_partkey as part_id", "l_suppkey as player_id",
         "cast(l_partkey % 4 + 1 as int) as down", "cast(l_suppkey % 12 + 1 as int) as yards_to_go", "l_quantity - 25 as yards_gained",
         "case l_partkey % 9 when 0 then 'S' when 1 then 'IN' when 2 then 'C' end as pass_result",
         "case when l_suppkey % 10 = 0 then 'Y' else 'N' end as nullified", "cast(case when l_partkey % 15 = 0 then 1 else 0 end as int) as fumbles",
         "cast(l_partkey % 30 as int) as home_score", "cast(l_suppkey % 28 as int) as visitor_score", "cast(l_partkey % 100 as int) as yardline",
         "concat(lpad(cast(l_partkey % 15 as string), 2, '0'), ':', lpad(cast(l_suppkey % 60 as string), 2, '0')) as game_clock",
         "l_partkey % 2 = 0 as rush_attempt", "l_partkey % 3 = 0 as dropback", "case when l_partkey % 4 = 0 then 1 end as pass_rusher",
         "case when l_partkey % 5 = 0 then 1 end as caused_pressure", "case when l_suppkey % 2 = 0 then 'Zone' else 'Man' end as coverage",
         "case when l_partkey % 7 = 0 then 1 end as in_motion", "cast(l_suppkey % 25 as int) as play_clock",
         "case when l_partkey % 6 = 0 then round(l_discount * 100) end as time_to_pressure", "l_quantity as rushing_yards", "round(l_tax * 100) as passing_yards",
         "l_suppkey % 32 as offense", "l_partkey % 32 as defense", "l_quantity - round(l_discount * 100) as epa"]
PLAYS_SQL = "plays as (select " + ", ".join(PLAYS).replace("as string)", "as varchar)") + " from lineitem)"


def plays(t):
    return t.lineitem.selectExpr(*PLAYS)


@query("play_success", f"""with {PLAYS_SQL} select game_id, play_id, part_id, down, case when
  (case when down = 1 then yards_gained >= 4 when down = 2 then yards_gained >= yards_to_go / 2 else yards_gained >= yards_to_go end)
  and coalesce(pass_result, '') not in ('S', 'IN') and nullified = 'N' and fumbles = 0 then 1 else 0 end as success from plays""")
def _success(t):
    return P.play_success(plays(t)).select("game_id", "play_id", "part_id", "down", "success")


FEATURES = ["critical_down", "score_differential", "normalized_yardline", "quarter_time_left", "offensive_tendency", "pressure_rate",
            "zone_coverage", "avg_time_to_pressure", "in_motion", "avg_rushing_yards", "avg_passing_yards", "team_avg_epa",
            "defensive_blitz_rate", "red_zone", "goal_to_go", "play_clock_critical"]

@query("play_features", f"""with {PLAYS_SQL},
r as (select *, coalesce(caused_pressure, 0) / (coalesce(pass_rusher, 0) + 1e-5) as pressure_rate from plays)
select game_id, play_id, part_id, case when down in (3, 4) then 1 else 0 end as critical_down, home_score - visitor_score as score_differential,
  abs(yardline - 50) as normalized_yardline, round((part_id % 15 * 60 + player_id % 60) / 900, 6) as quarter_time_left,
  cast(rush_attempt as int) - cast(dropback as int) as offensive_tendency, round(pressure_rate, 3) as pressure_rate,
  case when coverage = 'Zone' then 1 else 0 end as zone_coverage, avg(time_to_pressure) over (partition by player_id) as avg_time_to_pressure,
  coalesce(in_motion, 0) as in_motion, avg(rushing_yards) over (partition by player_id) as avg_rushing_yards,
  avg(passing_yards) over (partition by player_id) as avg_passing_yards, avg(epa) over (partition by offense) as team_avg_epa,
  round(avg(pressure_rate) over (partition by defense), 2) as defensive_blitz_rate, case when yardline >= 80 then 1 else 0 end as red_zone,
  case when yards_to_go <= 10 then 1 else 0 end as goal_to_go, case when play_clock <= 5 then 1 else 0 end as play_clock_critical from r""")
def _features(t):
    out = P.play_features(plays(t))
    digits = {"quarter_time_left": 6, "pressure_rate": 3, "defensive_blitz_rate": 2}  # the other inputs are whole numbers
    return out.select("game_id", "play_id", "part_id", *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in FEATURES])


TRACK = ["l_orderkey as game_id", "l_linenumber as play_id", "case when l_partkey % 3 < 2 then 'BEFORE_SNAP' else 'AFTER_SNAP' end as frame_type",
         "l_quantity as x", "l_discount * 100 as y", "l_tax * 100 as s", "l_quantity / 10 as a", "l_discount as dis",
         "cast(l_partkey % 360 as double) as o", "cast(l_suppkey % 360 as double) as dir"]


@query("tracking_presnap", f"""with tr as (select {', '.join(TRACK)} from lineitem),
st as (select game_id, play_id, round(avg(x), 6) as avg_x, max(x) as max_x, min(y) as min_y, round(avg(s), 6) as avg_s, max(a) as max_a,
  round(sum(dis), 6) as sum_dis, round(avg(o), 6) as avg_o, round(avg(dir), 6) as avg_dir from tr where frame_type = 'BEFORE_SNAP' group by all),
p as (select distinct l_orderkey as game_id, l_linenumber as play_id from lineitem)
select p.*, avg_x, max_x, min_y, avg_s, max_a, sum_dis, avg_o, avg_dir from p left join st on st.game_id = p.game_id and st.play_id = p.play_id""")
def _tracking(t):
    base = t.lineitem.selectExpr("l_orderkey as game_id", "l_linenumber as play_id").distinct()
    out = P.tracking_presnap(t.lineitem.selectExpr(*TRACK), base)
    rounded = ("avg_x", "avg_s", "sum_dis", "avg_o", "avg_dir")
    return out.select("game_id", "play_id", "max_x", "min_y", "max_a", *[F.round(c, 6).alias(c) for c in rounded])


SERIES_SQL = """s as (select user_id as gpu, cast(ts as date) as day, cast(sum(cast(value as decimal(18,2))) as double) / 1000 as utilization,
  cast(max(value) as double) as price, cast(count(*) as double) as revenue from events group by all)"""


def daily(t):
    return t.events.groupBy(F.col("user_id").alias("gpu"), F.to_date("ts").alias("day")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 1000).alias("utilization"),
        F.max("value").alias("price"), F.count("*").cast("double").alias("revenue"))


@query("series_features", f"""with {SERIES_SQL} select gpu, day, utilization, coalesce(lag(utilization) over w, 0) as utilization_lag_1,
  coalesce(lag(utilization, 2) over w, 0) as utilization_lag_2,
  round(case when count(*) over w7 = 7 then avg(utilization) over w7 else 0 end, 6) as utilization_rolling_mean,
  round(case when count(*) over w7 = 7 then avg(revenue) over w7 else 0 end, 6) as revenue_rolling_mean,
  utilization - 0.75::double as utilization_deviation, price / utilization as price_ratio, cast(year(day) as int) as year, cast(month(day) as int) as month,
  cast(weekofyear(day) as int) as week_number, cast(day(day) as int) as dom, cast(isodow(day) - 1 as int) as day_of_week from s
window w as (partition by gpu order by day), w7 as (partition by gpu order by day rows 6 preceding)""")
def _series(t):
    rows = daily(t).withColumnRenamed("day", "date")
    out = S.series_features(rows, "gpu", "date", "utilization", "price", "revenue")
    out = out.withColumnsRenamed({"day": "dom", "date": "day"}).drop("price", "revenue")
    return out.withColumns({c: F.round(c, 6) for c in ("utilization_rolling_mean", "revenue_rolling_mean")})


@query("price_recommend", f"""with {SERIES_SQL},
p as (select gpu, avg(price) as current_price, avg(price * 1.1) as recommended_price, avg(utilization * 0.95 + 0.05) as predicted_utilization,
  avg(utilization) as current_utilization, stddev_samp(utilization) as volatility from s group by gpu)
select gpu, round(current_price, 6) as current_price, round(predicted_utilization, 12) as predicted_utilization, round(volatility, 6) as volatility,
  case when volatility > 0.1 then 'Daily' when volatility > 0.05 then 'Weekly' else 'Monthly' end as frequency,
  round((recommended_price * predicted_utilization - current_price * current_utilization) / (current_price * current_utilization) * 100, 6) as revenue_change_pct,
  case when predicted_utilization >= 0.75 then 1 else 0 end as meets_target,
  round(avg(case when predicted_utilization >= 0.75 then 1 else 0 end) over () * 100, 6) as pct_meeting_target from p""")
def _recommend(t):
    priced = daily(t).selectExpr("gpu", "price", "utilization", "price * 1.1D as best_price", "utilization * 0.95D + 0.05D as predicted")
    rec = S.price_recommend(priced, "gpu")
    out = attach(rec, S.target_share(rec))
    # utilisation is a sum of hundredths over a few days: six digits would often end in an exact half
    rounded = {"current_price": 6, "predicted_utilization": 12, "volatility": 6, "revenue_change_pct": 6, "pct_meeting_target": 6}
    return out.select("gpu", "frequency", "meets_target", *[F.round(c, n).alias(c) for c, n in rounded.items()])


@query("forecast_series")
def _forecast(t):
    return S.forecast_series(t.events, ["user_id"], "ts", "value", 7)


@query("udf_grouped")
def _grouped(t):
    """Split-apply-combine: every series of event values by type and user, fitted in parallel."""
    return S.forecast_series(t.events, ["user_id", "event_type"], "ts", "value", 3)
