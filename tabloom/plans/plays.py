"""Play-level labels and features from play-by-play and tracking rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import clock_fraction
from tabloom.operators.aggregates import multi_stats
from tabloom.operators.ordered import join_back


def play_success(plays: DataFrame) -> DataFrame:
    """1 when the yardage for the down was gained without sack, penalty, interception or fumble."""
    c = F.col
    gained = (
        F.when(c("down") == 1, c("yards_gained") >= 4)
        .when(c("down") == 2, c("yards_gained") >= c("yards_to_go") / 2)
        .when(c("down").isin(3, 4), c("yards_gained") >= c("yards_to_go"))
        .otherwise(False)
    )
    result = F.coalesce("pass_result", F.lit(""))
    clean = ~result.isin("S", "IN") & (c("nullified") == "N") & (c("fumbles") == 0)
    return plays.withColumn("success", F.when(gained & clean, 1).otherwise(0))


def play_features(plays: DataFrame) -> DataFrame:
    """Situation flags and differentials, then per-player and per-team means."""
    c = F.col
    one = lambda rule: F.when(rule, 1).otherwise(0)
    out = plays.withColumns({
        "critical_down": one(c("down").isin(3, 4)),
        "score_differential": c("home_score") - c("visitor_score"),
        "normalized_yardline": F.abs(c("yardline") - 50),
        "quarter_time_left": clock_fraction(c("game_clock")),
        "offensive_tendency": c("rush_attempt").cast("int") - c("dropback").cast("int"),
        "pass_rusher": F.coalesce("pass_rusher", F.lit(0)),
        "caused_pressure": F.coalesce("caused_pressure", F.lit(0)),
        "zone_coverage": one(c("coverage") == "Zone"),
        "in_motion": F.coalesce("in_motion", F.lit(0)),
        "red_zone": one(c("yardline") >= 80),
        "goal_to_go": one(c("yards_to_go") <= 10),
        "play_clock_critical": one(c("play_clock") <= 5),
    })
    out = out.withColumn("pressure_rate", c("caused_pressure") / (c("pass_rusher") + 1e-5))
    # All three statistics come from the same rows, before any of them is joined.
    means = {
        "player_id": {"avg_time_to_pressure": "time_to_pressure", "avg_rushing_yards": "rushing_yards", "avg_passing_yards": "passing_yards"},
        "offense": {"team_avg_epa": "epa"},
        "defense": {"defensive_blitz_rate": "pressure_rate"},
    }
    stats = {k: out.groupBy(k).agg(*[F.avg(src).alias(n) for n, src in m.items()]) for k, m in means.items()}
    for k, s in stats.items():
        out = join_back(out, s, [k])
    return out


def tracking_presnap(tracking: DataFrame, plays: DataFrame) -> DataFrame:
    """Sensor statistics before the snap, joined to the plays."""
    before = tracking.where(F.col("frame_type") == "BEFORE_SNAP")
    stats = multi_stats(before, ["game_id", "play_id"], {
        "x": ["avg", "max", "min"], "y": ["avg", "max", "min"], "s": ["avg", "max"], "a": ["avg", "max"],
        "dis": ["sum"], "o": ["avg"], "dir": ["avg"],
    })
    return plays.join(stats, ["game_id", "play_id"], "left")
