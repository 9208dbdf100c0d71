"""Worked examples: input and expected output of the classic table exercises."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import aggregates as A
from tabloom.operators import joins as J
from tabloom.operators import ranks as K
from tabloom.operators.ordered import quantiles
from tabloom.operators.relational import even_double_else_triple


@pytest.fixture
def numbers(spark):
    return lambda xs: spark.createDataFrame([(x,) for x in xs], "x long")


def test_duplicates(numbers, rows):
    assert rows(A.dups(numbers([1, 2, 2, 3, 4, 4, 4]), ["x"])) == [(2, 2), (4, 3)]


def test_missing(numbers, rows):
    assert rows(A.missing_numbers(numbers([1, 2, 4, 5]), "x")) == [(3,)]


def test_medians(numbers):
    df = numbers([3, 1, 4, 1, 5, 9])
    assert A.median_by_position(df, "x").first()[0] == 3.5
    assert quantiles(df, ["x"], {"m": 0.5}).first()["m"] == 3.5


def test_successors(numbers, rows):
    assert rows(J.successors(numbers([1, 2, 3, 5, 6, 8]), "x")) == [(1, 2), (2, 3), (5, 6)]


def test_islands(numbers, rows):
    assert rows(K.islands(numbers([1, 2, 3, 5, 6, 8]), "x")) == [(1, 3, 3), (5, 6, 2), (8, 8, 1)]


def test_rank(numbers, rows):
    assert rows(A.ranked(numbers([20, 10, 30, 40, 50]), "x")) == [(10, 1), (20, 2), (30, 3), (40, 4), (50, 5)]


def test_singletons(numbers, rows):
    assert rows(A.singles(numbers([1, 2, 2, 3, 3, 3, 4]), "x")) == [(1,), (4,)]


def test_even_sum(numbers):
    assert numbers(range(1, 6)).where("x % 2 = 0").agg(F.sum("x")).first()[0] == 6


def test_second_highest(numbers):
    assert A.second_highest(numbers([10, 20, 30, 20, 40]), "x").first()[0] == 30


def test_running_total(numbers, rows):
    got = rows(K.running_total(numbers([10, 20, 30, 40, 50]), "x"))
    assert [t for _, t in got] == [10, 30, 60, 100, 150]


def test_mode(numbers, rows):
    assert [(r["n"], len(r)) for r in A.mode_all(numbers([10, 20, 10, 30, 10, 20]), "x").collect()] == [(3, 2)]
    assert A.mode_all(numbers([1, 1, 2, 2, 3]), "x").count() == 2


def test_merge_intervals(spark, rows):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 5, 7), ("a", 6, 8)], "k string, s int, e int")
    assert rows(K.merge_spans(df, ["k"], "s", "e")) == [("a", 1, 4), ("a", 5, 8)]


@pytest.mark.parametrize("xs, want", [([5, 20, 2, 6], 120), ([1, 3, -5, -2, 10], 30), ([1, 3, 5, -2, 10], 50)])
def test_max_pair(numbers, xs, want):
    assert A.max_pair_product(numbers(xs), "x").first()[0] == want


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_arrays(spark):
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((1, 3), (2, 1), (4, 2))])
    assert [(r.x, r.y) for r in one(spark, S.sort_structs(pairs, [("y", False)]))] == [(2, 1), (4, 2), (1, 3)]
    people = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(g).alias("grade")) for n, g in
                       (("Bob", 85), ("Alice", 90), ("David", 80), ("Charlie", 90))])
    assert [r.name for r in one(spark, S.sort_structs(people, [("grade", True), ("name", False)]))] == ["Alice", "Charlie", "Bob", "David"]
    assert one(spark, F.array_intersect(F.array(*map(F.lit, [1, 2, 3, 4])), F.array(*map(F.lit, [3, 4, 5, 6])))) == [3, 4]
    nested = F.array(*[F.array(*map(F.lit, xs)) for xs in ([5, 12, 17], [8, 10, 14], [7, 19, 22])])
    assert one(spark, S.flatten_where(nested, lambda x: x > 10)) == [12, 17, 14, 19, 22]
    sub = F.array(*[F.array(*map(F.lit, xs)) for xs in ([1, 2, 3], [4, 5, 6], [7, 8, 9])])
    odd = F.transform(sub, lambda a: F.transform(F.filter(a, lambda x: x % 2 == 1), lambda x: x * 2))
    assert one(spark, odd) == [[2, 6], [10], [14, 18]]
    assert one(spark, S.even_odd(F.array(*map(F.lit, [1, 2, 3, 4])))) == {"even": [2, 4], "odd": [1, 3]}


def test_maps(spark):
    m = F.create_map(*[x for k, v in (("a", 1), ("b", 2), ("c", 3)) for x in (F.lit(k), F.lit(v))])
    assert one(spark, S.map_invert(m)) == {1: "a", 2: "b", 3: "c"}
    prices = F.create_map(*[x for k, v in (("apple", 10.0), ("orange", 15.0), ("plum", 30.0)) for x in (F.lit(k), F.lit(v))])
    assert one(spark, S.map_scale(prices, 0.9, lambda k, v: v <= 20)) == {"apple": 9.0, "orange": 13.5}
    assert one(spark, S.map_sum(prices)) == 55.0


def test_text(spark, rows):
    assert one(spark, F.reverse(F.lit("hello world"))) == "dlrow olleh"
    df = spark.createDataFrame([(1, "hello world")], "id int, s string")
    counts = {r.ch: r.n for r in S.char_counts(df, "id", "s").collect()}
    assert counts["l"] == 3 and counts["o"] == 2 and counts["h"] == 1
    assert one(spark, S.palindrome(F.lit("Never odd or even"))) is True
    assert one(spark, S.drop_suffix(F.lit("100.0"))) == "100"
    assert one(spark, S.strip_set(F.lit("100.0"), ".0", "right")) == "1"
    assert one(spark, S.clean_lines(F.lit("  a \n\n\t b\n"))) == "a\nb"


def test_numbers(spark):
    assert one(spark, F.factorial(F.lit(6))) == 720
    got = spark.range(1, 6).select(even_double_else_triple(F.col("id"))).collect()
    assert [r[0] for r in got] == [3, 4, 9, 8, 15]


@pytest.mark.parametrize("last, freq, want", [
    ("2024-01-05", "weekday", "2024-01-08"), ("2024-01-06", "weekday", "2024-01-08"), ("2024-01-07", "weekday", "2024-01-08"),
    ("2024-01-31", "monthly", "2024-02-29"), ("2023-10-31", "quarterly", "2024-01-31"), ("2024-02-29", "annual", "2025-02-28"),
    ("2024-01-01", "daily", "2024-01-02"), ("2024-01-01", "weekly", "2024-01-08"), ("2024-01-01", "hourly", None)])
def test_next_run(spark, last, freq, want):
    got = one(spark, S.next_run(F.lit(last).cast("date"), F.lit(freq)))
    assert (str(got) if got else None) == want


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, S.boundary_diff("month", d("2024-01-31"), d("2024-03-01"))) == 2
    assert one(spark, S.age(d("2000-06-30"), d("2024-06-29"))) == 23
    assert one(spark, S.age(d("2000-06-30"), d("2024-06-30"))) == 24
    assert one(spark, S.age_between(d("2006-06-30"), 18, 75, d("2024-06-30"))) is True
    assert [str(x) for x in one(spark, S.next_weekdays(d("2024-01-05"), 3))] == ["2024-01-08", "2024-01-09", "2024-01-10"]


def test_recency(spark):
    cols = [F.lit(x) for x in (0, 4, 0, 0, 2, 0)]
    got = S.recency(cols)
    assert one(spark, got["last_positive_index"]) == 5 and one(spark, got["months_since"]) == 2
    none = S.recency([F.lit(0)] * 6)
    assert one(spark, none["last_positive_index"]) == 7 and one(spark, none["months_since"]) == 7
