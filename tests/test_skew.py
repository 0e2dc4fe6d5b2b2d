import random

from pyspark.sql import functions as F

from glyphflow.plans import skew


def events(spark, seed=1, n=600):
    """A third of the rows belong to one key; order values are unique."""
    rng = random.Random(seed)
    seqs = rng.sample(range(10_000), n)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 40)}", s, rng.choice(["a", "b", None])) for s in seqs]
    return rows, spark.createDataFrame(rows, "key string, seq long, value string").repartition(5)


def test_hot_keys_are_all_found(spark):
    rows, df = events(spark)
    assert [(r["key"], r["n"]) for r in skew.hot_keys(df, "key", min_rows=100).collect()] == [("hot", sum(r[0] == "hot" for r in rows))]
    many = spark.range(6_000).select((F.col("id") % 1_500).alias("key"), "id")
    assert skew.hot_keys(many, "key", min_rows=4).count() == 1_500


def test_more_hot_keys_than_any_bound(spark):
    many = spark.range(6_000).select((F.col("id") % 1_500).alias("key"), F.col("id").alias("seq"))
    out = skew.position_in_group(many, "key", ["seq"], "seq", "i", min_rows=2)
    assert out.where(F.col("i") != F.floor(F.col("seq") / 1_500)).count() == 0


def test_pieces_follow_the_rows():
    assert [skew.pieces_of(n, 10) for n in (1, 20, 95, 10_000_000)] == [2, 2, 10, 1_000_000]


def test_previous_value_with_hot_keys(spark):
    rows, df = events(spark)
    want, last = set(), {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        want.add((key, seq, last.get(key)))
        last[key] = value
    for options in ({}, {"min_rows": 50}, {"min_rows": 7}, {"min_rows": 1}):
        df2 = df.where("value IS NOT NULL")
        got = {(r["key"], r["seq"], r["prev"]) for r in skew.previous_value(df2, "key", "seq", "value", "prev", **options).collect()}
        last, want = {}, set()
        for key, seq, value in sorted(rows, key=lambda r: r[1]):
            if value is not None:
                want.add((key, seq, last.get(key)))
                last[key] = value
        assert got == want


def test_positions_with_hot_keys(spark):
    rows, df = events(spark)
    want, seen = set(), {}
    for key, seq, _ in sorted(rows, key=lambda r: r[1]):
        want.add((key, seq, seen.setdefault(key, 0)))
        seen[key] += 1
    for options in ({}, {"min_rows": 50}, {"min_rows": 7}, {"min_rows": 1}):
        out = skew.position_in_group(df, "key", ["seq"], "seq", "i", **options)
        assert {(r["key"], r["seq"], r["i"]) for r in out.collect()} == want


def test_running_total_over_buckets(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice([1, -1, 3])) for s in rng.sample(range(10**6), 500)]
    df = spark.createDataFrame(rows, "seq long, delta int")
    want, total = {}, 0
    for seq, delta in sorted(rows):
        total += delta
        want[seq] = total
    for bucket_rows in (1, 50, 1000):
        got = skew.running_total(df, "seq", "delta", "depth", bucket_rows=bucket_rows).collect()
        assert {r["seq"]: r["depth"] for r in got} == want
    empty = skew.running_total(df.where("false"), "seq", "delta", "depth")
    assert empty.count() == 0


def test_buckets_follow_the_order_and_share_the_rows(spark):
    rows, df = events(spark)
    out = skew.order_bucket(df, "seq", 6, "_bucket").select("seq", "_bucket").orderBy("seq").collect()
    buckets = [r["_bucket"] for r in out]
    assert buckets == sorted(buckets)
    assert max(buckets.count(b) for b in set(buckets)) < len(rows) / 3
