from collections import Counter, defaultdict

from pyspark.sql import functions as F

from metalint.operators import ranking


def _skewed(spark, n=3000):
    """A third of all rows have one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        ((F.col("id") * 7919) % 1009).alias("v"), "id").repartition(6)


def test_rank_in_group_splits_hot_groups_exactly(spark):
    df = _skewed(spark)
    rows = [(r.k, r.v, r.id) for r in df.collect()]
    groups = defaultdict(list)
    for k, v, i in rows:
        groups[k].append((-v, i))
    want = {(k, i): n for k, members in groups.items() for n, (_, i) in enumerate(sorted(members), 1)}
    for limit in (50, 10_000):
        got = ranking.rank_in_group(df, ["k"], [F.col("v").desc(), F.col("id")], "r", max_group=limit).collect()
        assert {(r.k, r.id): r.r for r in got} == want
        assert len(got) == len(rows)


def test_lists_keep_every_value(spark):
    df = _skewed(spark).select("k", F.concat(F.lit("V"), "v").alias("x"))
    want = defaultdict(set)
    for r in df.collect():
        want[r.k].add(r.x)
    got = defaultdict(list)
    for r in sorted(ranking.listed_values(df, ["k"], "x").collect(), key=lambda r: (r.k, r.rank)):
        got[r.k].append(r.x)
        assert r.rank == len(got[r.k])
    assert {k: sorted(v, key=str.lower) for k, v in want.items()} == dict(got)


def test_first_by_takes_the_least_row_with_nulls_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", None, "y"), ("b", 1, None), ("b", 3, "z")], "k string, o int, v string")
    got = {r.k: (r.o, r.v) for r in ranking.first_by(df, ["k"], ["o", "v"]).collect()}
    assert got == {"a": (None, "y"), "b": (1, None)}


def test_top_two_sees_ties_and_shares(spark):
    df = _skewed(spark).select("k", (F.col("v") % 3).alias("v"))
    counts = defaultdict(Counter)
    for r in df.collect():
        counts[r.k][r.v] += 1
    for r in ranking.top_two(df, ["k"], "v").collect():
        best = max(counts[r.k].values())
        winners = [v for v, n in counts[r.k].items() if n == best]
        assert (r.peers, r.distinct_values, r.dominant_count) == (sum(counts[r.k].values()), len(counts[r.k]), best)
        assert r.tied == (len(winners) > 1) and r.dominant_value == min(winners)


def test_mode_outliers_thresholds(spark):
    from metalint.operators.peers import mode_outliers

    def run(values):
        df = spark.createDataFrame([("g", v) for v in values], "g string, v string")
        return [r.v for r in mode_outliers(df, ["g"], "v").collect()]

    assert run(["a", "A", "a", "b"]) == ["b"]
    assert run(["a", "a", "b", "b"]) == []
    assert run(["a", "a", "b"]) == []
    assert run(["a", "a", "a", "a"]) == []
    assert run(["a", "a", "b", "c"]) == []
