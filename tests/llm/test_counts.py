"""Membership patterns and percentile bisection against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veloquent.llm import distinct, percentiles

KIND = "user_id string, day int, tenant string, identifier string, cells int, n int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    return [("hot" if r.random() < 0.34 else r.choice([None, *[f"u{i}" for i in range(40)]]), r.choice([None, 1, 2, 3, 4]), r.choice([None, "a", "b", "c"]), "clash", 1, 2) for _ in range(900)]


def groups():
    return {"day": F.col("day"), "tenant": F.col("tenant")}


def test_counts_by_set_are_exact(spark, rows):
    t = distinct.patterns(distinct.memberships(spark.createDataFrame(rows, KIND), "user_id", groups()))
    got = {tuple(x)[:3]: x[3] for x in distinct.by_sets(t, [("all", []), ("d", ["day"]), ("t", ["tenant"]), ("dt", ["day", "tenant"])], ["day", "tenant"]).collect()}
    want = defaultdict(set)
    for u, day, ten, *_ in rows:
        if u is not None:
            for k in (("all", None, None), ("d", day, None), ("t", None, ten), ("dt", day, ten)):
                want[k].add(u)
    assert got == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("keep", ["false", "user_id IS NULL"])
def test_nobody_is_counted_as_0(spark, rows, keep):
    """GROUPING SETS with () give one row even over nothing; all other sets give none."""
    df = spark.createDataFrame(rows, KIND).filter(keep)
    got = distinct.by_sets(distinct.patterns(distinct.memberships(df, "user_id", groups())), [("all", []), ("d", ["day"]), ("dt", ["day", "tenant"])], ["day", "tenant"])
    assert [tuple(x) for x in got.collect()] == [("all", None, None, 0)]
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "int", "string", "bigint"]


def test_any_combination(spark, rows):
    t = distinct.patterns(distinct.memberships(spark.createDataFrame(rows, KIND), "user_id", groups())).cache()
    users = lambda f: {r[0] for r in rows if r[0] is not None and f(r)}
    a, b, one = (lambda c: c["tenant"] == "a"), (lambda c: c["tenant"] == "b"), (lambda c: c["day"] == 1)
    ua, ub, u1 = users(lambda r: r[2] == "a"), users(lambda r: r[2] == "b"), users(lambda r: r[1] == 1)
    value = lambda **k: distinct.count_where(t, **k).first()[0]
    assert value(any_of=[a, b]) == len(ua | ub) and value(all_of=[a, b, one]) == len(ua & ub & u1) and value(all_of=[a], none_of=[b]) == len(ua - ub)
    half = distinct.coarser(t, lambda c: F.floor(c["day"] / 3), "half").collect()
    assert {x["half"]: x["n_distinct"] for x in half}[0] == len(users(lambda r: r[1] in (1, 2)))


def test_partials_merge(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    whole = distinct.patterns(distinct.memberships(df, "user_id", groups()))
    parts = [distinct.memberships(df.filter(c), "user_id", groups()) for c in ("day = 1", "day > 1", "day IS NULL")]
    by_time = distinct.patterns(distinct.merge_memberships(*parts))
    ids = [distinct.patterns(distinct.memberships(df.filter(F.pmod(F.hash("user_id"), F.lit(2)) == k), "user_id", groups())) for k in (0, 1)]
    norm = lambda x: {(tuple(map(tuple, r["cells"])), r["n"]) for r in x.collect()}
    assert norm(by_time) == norm(whole) == norm(distinct.merge_patterns(*ids))
    assert distinct.patterns(distinct.memberships(df.limit(0), "user_id", groups())).count() == 0


def nearest_rank(values, p):
    values = sorted(values)
    return values[max(1, (p * len(values) + 99) // 100) - 1]


def test_one_identifier_in_very_many_cells(spark):
    """100,000 cells of one identifier take seconds: each set's groups are told apart by one sort."""
    import time

    rows = spark.range(100_000).select(F.lit("bot").alias("user_id"), (F.col("id") % 1000).cast("int").alias("day"), F.concat(F.lit("t"), F.col("id") / 1000).alias("tenant"))
    t = distinct.patterns(distinct.memberships(rows, "user_id", groups()))
    began = time.time()
    got = distinct.by_sets(t, [("all", []), ("d", ["day"]), ("t", ["tenant"]), ("dt", ["day", "tenant"])], ["day", "tenant"]).groupBy("kind").agg(F.count("*"), F.sum("n_distinct")).collect()
    assert time.time() - began < 30
    assert {tuple(g) for g in got} == {("all", 1, 1), ("d", 1000, 1000), ("t", 100_000, 100_000), ("dt", 100_000, 100_000)}


@pytest.mark.parametrize("levels", [1, 4, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_are_exact(spark, seed, levels):
    r = random.Random(seed)
    draw = [lambda: r.randint(-1, 5), lambda: r.choice([0, 2**31 - 1, -(2**31)]), lambda: r.randint(0, 10**6), lambda: 7]
    rows = []
    for i in range(1200):
        g = "hot" if r.random() < 0.34 else r.choice(["a", "b", None, "one"])
        rows.append((f"i{i}", draw[hash(g or "n") % 4]() if r.random() > 0.05 else None, g, r.choice(["x", "y"]), 1, 2))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "id string, v int, g string, h string, lo int, hi int")
    want = defaultdict(list)
    for i, v, g, h, *_ in dict.fromkeys(rows):
        if v is not None:
            want["g", g].append(v)
            want["h", h].append(v)
    got = percentiles.percentiles(percentiles.histogram(df, "id", "v", ["g", "h"]), (1, 50, 99, 100), levels).collect()
    assert {(x["kind"], x["grp"], x["percentile"]): (x["value"], x["n"]) for x in got} == {(*k, p): (nearest_rank(v, p), len(v)) for k, v in want.items() for p in (1, 50, 99, 100)}


def test_passes_leave_nothing_behind(spark):
    from veloquent import session

    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), (F.col("id") * 1_000_003).cast("bigint").alias("v"), F.lit("g").alias("g"))
    with session.staging(spark):
        before = set(session.files(spark, session.shared_dir(spark)))
        got = percentiles.percentiles(percentiles.histogram(df, "id", "v", ["g"]), (50,)).collect()
        left = set(session.files(spark, session.shared_dir(spark))) - before
        assert got[0]["value"] == 1499 * 1_000_003 and len(left) == 2  # the last pass's two tables
    assert not left & set(session.files(spark, session.shared_dir(spark)))


def test_histograms_merge_and_may_be_empty(spark):
    df = spark.createDataFrame([(f"i{i}", i % 10, "g") for i in range(50)], "id string, v int, g string")
    h = lambda x: percentiles.histogram(x, "id", "v", ["g"])
    two = percentiles.merge(h(df.filter("v < 5")), h(df.filter("v >= 5")))
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, h(df).collect()))
    assert percentiles.percentiles(h(df.limit(0))).count() == 0
