"""Windows over pieces give the same rows as plain windows."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.operators import ordered as O
from tabloom.operators import ranks as K


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 rows; key 1 holds two thirds, one key is NULL, values have gaps."""
    return spark.range(4000).selectExpr(
        "id", "case when id % 3 > 0 then 1L when id % 11 = 0 then null else id % 7 end as k",
        "cast((id * 7919) % 4001 as long) as ts", "case when id % 4 = 0 then id % 50 end as v").cache()


AGGS = {"s": "sum", "hi": "max", "lo": "min", "l": "last"}


def ours():
    return {n: (kind, F.col("v")) for n, kind in AGGS.items()}


def plain_over(w):
    kinds = {"s": F.sum("v"), "hi": F.max("v"), "lo": F.min("v"), "l": F.last("v", ignorenulls=True)}
    return [c.over(w).alias(n) for n, c in kinds.items()]


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_a_plain_window(hot, rows, exclusive, order, keys):
    w = Window.partitionBy(*keys).orderBy(F.col("ts").asc() if order == "asc" else F.col("ts").desc())
    w = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    got = O.running(hot, keys, [("ts", order)], ours(), exclusive)
    assert rows(got, "id", *AGGS) == rows(hot.select("id", *plain_over(w)))


FALLING = {"long": "ts", "double": "case when id % 5 = 0 then null when id % 7 = 0 then double('NaN') else ts / 3 end", "string": "case when id % 5 > 0 then concat('é', ts) end", "long text": "concat(repeat('x', 60 + cast(id % 9 as int)), ts % 5)",
           "date": "date_add(date'2020-01-01', cast(ts as int))", "timestamp": "timestamp_seconds(ts)", "decimal": "cast(ts as decimal(12,2))", "boolean": "ts % 2 = 0"}


@pytest.mark.parametrize("kind", FALLING)
@pytest.mark.parametrize("way", ["asc", "desc"])
def test_every_type_can_rise_and_fall(hot, rows, kind, way):
    df = hot.select("id", "k", "v", F.expr(FALLING[kind]).alias("o"))
    w = Window.partitionBy("k").orderBy(F.col("o").desc() if way == "desc" else F.col("o"), "id").rowsBetween(Window.unboundedPreceding, 0)
    got = O.running(df, ["k"], [("o", way), "id"], ours())
    assert rows(got, "id", *AGGS) == rows(df.select("id", *plain_over(w)))


def test_position_is_dense_over_all_rows(hot):
    got = [r[0] for r in O.position(hot, [], ["ts"]).orderBy("ts").select("rn").collect()]
    assert got == list(range(1, 4001))


@pytest.mark.parametrize("n", [1, 3, 200])
def test_nearby_equals_a_plain_window(hot, rows, n):
    def expr(w):
        return {"p1": F.lag("id", 1).over(w), "pn": F.lag("id", n).over(w),
                "m": F.sum("id").over(w.rowsBetween(-n, Window.currentRow))}

    for keys in (["k"], []):
        plain = hot.select("id", *[c.alias(a) for a, c in expr(Window.partitionBy(*keys).orderBy("ts")).items()])
        assert rows(O.nearby(hot, keys, ["ts"], n, expr), "id", "p1", "pn", "m") == rows(plain)


def test_pieces_cut_a_hot_key_evenly(hot):
    """No task gets the hot key whole: pieces are about even, and only keys that cross a limit count as split."""
    sizes = O.in_pieces(hot, ["k"], ["ts"]).groupBy("__piece").count().toPandas()["count"]
    assert len(sizes) >= 16 and sizes.max() < 4000 / 8
    few = O.in_pieces(hot.where("k = 1 or id < 40"), ["k"], ["ts"]).where("__split").select("k").distinct()
    assert 1 in {r[0] for r in few.collect()}


@pytest.mark.parametrize("empty", [True, False])
def test_no_rows_and_one_row(spark, empty):
    df = spark.range(0 if empty else 1).selectExpr("id", "id as k", "id as ts", "id as v")
    assert O.running(df, ["k"], ["ts"], ours()).count() == O.nearby(df, ["k"], ["ts"], 2, lambda w: {"p": F.lag("v").over(w)}).count() == (0 if empty else 1)


def test_quantiles_match_numpy(hot):
    pdf = hot.toPandas()
    for keys in ([], ["k"]):
        got = O.quantiles(hot, ["id", "v"], {"a": 0.1, "b": 0.5, "c": 0.99}, keys).collect()
        assert len(got) == (2 * pdf["k"].nunique(dropna=False) if keys else 2)
        for r in got:
            part = pdf if not keys else pdf[pdf["k"].isna()] if r["k"] is None else pdf[pdf["k"] == r["k"]]
            assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(part[r["column"]].dropna(), [0.1, 0.5, 0.99]))


def test_quantile_of_many_values(spark):
    """Twenty thousand different values: the pieces are far from whole groups."""
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) as x")
    got = O.quantiles(df, ["x"], {"m": 0.5}).first()["m"]
    assert got == np.median(df.toPandas()["x"])


def test_ffill_forms_agree_and_are_idempotent(hot, rows):
    once = K.ffill(hot, ["k"], ["ts"], ["v"])
    assert rows(once, "id", "v") == rows(K.ffill_by_position(hot, ["k"], ["ts"], ["v"]), "id", "v")
    assert rows(once, "id", "v") == rows(K.ffill(once, ["k"], ["ts"], ["v"]), "id", "v")


def _merged(spans):
    """Spans joined one by one."""
    out = []
    for k, s, e in sorted(spans.itertuples(index=False, name=None)):
        if out and out[-1][0] == k and s <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((k, s, e))
    return out


def test_merge_spans_is_idempotent(spark, rows):
    spans = spark.range(500).selectExpr("id % 5 as k", "(id * 37) % 900 as s", "(id * 37) % 900 + id % 6 as e")
    once = K.merge_spans(spans, ["k"], "s", "e")
    assert rows(once) == rows(K.merge_spans(once, ["k"], "s", "e"))
    assert rows(once, "k", "s", "e") == sorted(_merged(spans.toPandas()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), k=st.integers(1, 12))
def test_tile_sizes_differ_by_at_most_one(spark, n, k):
    sizes = [r["count"] for r in K.tiles(spark.range(n), ["id"], k).groupBy("tile").count().orderBy("tile").collect()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
