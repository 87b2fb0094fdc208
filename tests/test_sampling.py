"""Sampling, splitting, permutation and hygiene: invariants, skew and copies."""

import collections

import pytest
from pyspark.sql import functions as F

from flowlab.operators import hygiene, sampling


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows: one label holds two thirds, one holds five rows."""
    kind = F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2995, "mid").otherwise("tiny")
    return spark.range(3000).select("id", kind.alias("label"), (F.col("id") * 1.5).alias("x"))


def test_cap_is_exact_and_reproducible(spark, skewed):
    first = sampling.balanced_sample(skewed, max_per_label=100, seed=42, key_columns=["id"])
    counts = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    assert counts == {"hot": 100, "mid": 100, "tiny": 5}
    expected = rows_of(first)
    for partitions in (1, 7, 64):
        again = sampling.balanced_sample(skewed.repartition(partitions), max_per_label=100, seed=42, key_columns=["id"])
        assert rows_of(again) == expected
    other = sampling.balanced_sample(skewed, max_per_label=100, seed=43, key_columns=["id"])
    assert rows_of(other) != expected
    assert first.columns == skewed.columns


def test_sample_looks_inside_large_buckets(spark, skewed, monkeypatch):
    expected = rows_of(sampling.capped_sample(skewed, "label", 100, seed=42, key_columns=["id"]))
    monkeypatch.setattr(sampling, "LEVELS", (1, 2, 3, 32, 36, 40, 64))
    monkeypatch.setattr(sampling, "EDGE_ROWS", 3)
    assert rows_of(sampling.capped_sample(skewed, "label", 100, seed=42, key_columns=["id"])) == expected


def test_sample_with_a_key_shared_by_many_rows(spark, monkeypatch):
    """One key for all rows: the content decides, and no bucket above the bound is ranked whole."""
    df = spark.range(400).select(F.lit("a").alias("label"), F.lit(7).alias("k"), F.col("id").alias("v"))
    expected = rows_of(sampling.capped_sample(df, "label", 50, seed=1, key_columns=["k"]))
    monkeypatch.setattr(sampling, "EDGE_ROWS", 3)
    assert rows_of(sampling.capped_sample(df, "label", 50, seed=1, key_columns=["k"])) == expected
    assert len(expected) == 50


def test_sample_of_copies(spark):
    copies = spark.range(1000).select(F.lit("a").alias("label"), (F.col("id") % 3).alias("x"))
    got = sampling.capped_sample(copies, "label", 500, seed=1, key_columns=["x"])
    counts = collections.Counter(r.x for r in got.collect())
    assert sum(counts.values()) == 500 and max(counts.values()) <= 334


def test_null_labels_are_left_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, label string")
    assert sampling.balanced_sample(df, max_per_label=5, key_columns=["id"]).count() == 1


def test_split_sizes(spark):
    train, val = sampling.split_train_val(spark.range(10).toDF("id"), 0.15, key_columns=["id"])
    assert (train.count(), val.count()) == (8, 2)


@pytest.mark.parametrize("frac", [0.0, 0.15, 0.5, 1.0])
def test_split_is_a_partition(spark, skewed, frac):
    train, val = sampling.split_train_val(skewed, frac, seed=9, key_columns=["id"])
    assert train.count() == int(3000 * (1 - frac))
    assert rows_of(train.unionByName(val)) == rows_of(skewed)


def test_split_divides_copies_exactly(spark):
    """Two thirds of all rows are copies of one row, so the cut falls among them."""
    df = spark.range(900).select(F.when(F.col("id") < 600, -1).otherwise(F.col("id")).alias("k"), F.lit("v").alias("v"))
    for frac in (0.15, 0.4, 0.7):
        train, val = sampling.split_train_val(df, frac, seed=4, key_columns=["k"])
        assert train.count() == int(900 * (1 - frac))
        assert rows_of(train.unionByName(val)) == rows_of(df)


def test_split_with_a_key_shared_by_different_rows(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    train, val = sampling.split_train_val(df, 0.25, seed=4, key_columns=["k"])
    assert train.count() == 225 and rows_of(train.unionByName(val)) == rows_of(df)


def test_permutation_keeps_counts_and_features(spark, skewed):
    shuffled = sampling.permute_labels(skewed, seed=3, key_columns=["id"], column="new")
    rows = shuffled.collect()
    assert collections.Counter(r.new for r in rows) == collections.Counter(r.label for r in rows)
    assert rows_of(shuffled.select("id", "label", "x")) == rows_of(skewed)
    agree = sum(r.new == r.label for r in rows) / len(rows)
    assert 0.45 < agree < 0.66  # chance: 4/9 + 0.11


def test_permutation_of_copies(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), F.when(F.col("id") < 200, "a").otherwise("b").alias("label"))
    rows = sampling.permute_labels(df, seed=3, key_columns=["k"], column="new").collect()
    assert collections.Counter(r.new for r in rows) == {"a": 200, "b": 100}


def test_null_safe_overlap(spark):
    pool = spark.createDataFrame([(1.0, None), (None, 1.0), (2.0, 3.0), (2.0, 3.0)], "a double, b double")
    reference = spark.createDataFrame([(None, 1.0), (2.0, 3.0)], "a double, b double")
    for bound in (500_000, 0):  # broadcast, then shuffle
        kept = hygiene.exclude_overlap(pool, reference, ["a", "b"], max_broadcast_rows=bound)
        assert rows_of(kept) == [(1.0, None)]
        audit = hygiene.overlap_audit(pool, reference, ["a", "b"], max_broadcast_rows=bound).first()
        assert tuple(audit) == (4, 3, 1)
        assert hygiene.overlap_report(kept, reference, ["a", "b"]).first().overlap == 0
    report = hygiene.overlap_report(pool, reference, ["a", "b"]).first()
    assert tuple(report)[:3] == (3, 2, 2) and report.overlap_share_b == 1.0
    empty = hygiene.overlap_report(pool, reference.limit(0), ["a", "b"]).first()
    assert empty.unique_b == 0 and empty.overlap_share_b is None


@pytest.mark.parametrize("few", [True, False])
def test_overlap_in_one_shuffle(spark, monkeypatch, few):
    """Report, audit and cleaning agree with the single operators, for few shared contents and for many."""
    if not few:
        monkeypatch.setattr(hygiene, "BROADCAST_REFERENCE_ROWS", 0)
    pool = spark.createDataFrame([(1.0, None), (None, 1.0), (2.0, 3.0), (2.0, 3.0), (float("nan"), 4.0), (5.0, 5.0)], "a double, b double")
    reference = spark.createDataFrame([(None, 1.0), (2.0, 3.0), (None, 4.0), (9.0, 9.0)], "a double, b double")
    found = hygiene.overlap(pool, reference, ["a", "b"])
    report = hygiene.overlap_report(pool, reference, ["a", "b"]).first().asDict()
    report |= hygiene.overlap_audit(pool, reference, ["a", "b"]).first().asDict()
    assert found.report.first().asDict() == report and report["rows_removed"] == 4
    kept = hygiene.without_shared(pool, found.shared, ["a", "b"])
    assert sorted(map(str, kept.collect())) == sorted(map(str, hygiene.exclude_overlap(pool, reference, ["a", "b"]).collect()))
    nothing = hygiene.overlap(pool.limit(0), reference.limit(0), ["a", "b"]).report.first()
    assert (nothing.overlap, nothing.rows_before, nothing.rows_removed, nothing.overlap_share_a) == (0, 0, 0, None)


def test_overlap_ignores_number_types_and_nan(spark):
    pool = spark.createDataFrame([(1, float("nan")), (5, 0.5)], "a int, b double")
    reference = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert rows_of(hygiene.exclude_overlap(pool, reference, ["a", "b"])) == [(5, 0.5)]


def test_kept_duplicates_stay(spark):
    pool = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "a double")
    kept = hygiene.exclude_overlap(pool, spark.createDataFrame([(2.0,)], "a double"), ["a"])
    assert kept.count() == 2
    assert hygiene.shared_rows(pool, kept, ["a"]).count() == 1


def test_large_reference_with_colliding_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hygiene, "row_hash", lambda columns: F.expr(f"CAST(pmod({columns[0]}, 3) AS LONG)"))
    pool = spark.createDataFrame([(k % 12, float(k % 12)) for k in range(60)], "a int, b double")
    reference = spark.createDataFrame([(0, 0.0), (3, 3.0), (6, 6.0), (9, 9.0), (1, 1.0), (4, 4.5)], "a int, b double")
    kept = hygiene.exclude_overlap(pool, reference, ["a", "b"], max_broadcast_rows=0).collect()
    assert sorted({r.a for r in kept}) == [2, 4, 5, 7, 8, 10, 11] and len(kept) == 35
    empty = hygiene.exclude_overlap(pool, reference.limit(0), ["a", "b"], max_broadcast_rows=-1)
    assert empty.count() == 60


def test_splits_from_one_search(spark):
    """Every boundary is exact, copies at a boundary are divided by count, and the two-way split is the same as before."""
    rows = [(k, k % 7) for k in range(500)] + [(1000, 0)] * 300  # one key holds many equal rows
    df = spark.createDataFrame(rows, "id long, v long")
    shares = {"a": 0.3, "b": 0.1, "c": 0.35, "d": 0.25}
    out = sampling.with_splits(df, shares, seed=3, key_columns=["id"])
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"a": 240, "b": 80, "c": 280, "d": 200}
    assert sorted(map(tuple, out.drop("split").collect())) == sorted(rows)
    two = sampling.with_split(df, 0.25, seed=3, key_columns=["id"])
    train, val = sampling.split_train_val(df, 0.25, seed=3, key_columns=["id"])
    assert sorted(map(tuple, two.where("split = 'TRAIN'").drop("split").collect())) == sorted(map(tuple, train.collect()))
    assert sorted(map(tuple, two.where("split = 'VAL'").drop("split").collect())) == sorted(map(tuple, val.collect()))
    assert sampling.with_splits(df.limit(0), shares, seed=3, key_columns=["id"]).count() == 0


def test_split_reads_its_input_once_after_the_search(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 3)
    plan = sampling.with_splits(df, {"a": 0.5, "b": 0.2, "c": 0.3}, seed=1, key_columns=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Union" not in plan


@pytest.mark.parametrize("cuts", [10, 100_000])
def test_more_groups_than_may_be_pinned_and_a_hot_bucket(spark, monkeypatch, cuts):
    """With more groups than the bound the cuts stay a table; an overfull last bucket is looked into all the same."""
    df = spark.range(6000).selectExpr("IF(id < 4000, 'hot', concat('g', id % 100)) AS g", "id")
    expected = sampling.capped_sample(df, "g", 15, seed=5, key_columns=["id"])
    monkeypatch.setattr(sampling, "PINNED_CUTS", cuts)
    got = sampling.capped_sample(df, "g", 15, seed=5, key_columns=["id"], edge_rows=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert {r["count"] for r in got.groupBy("g").count().collect()} == {15}


def test_groups_within_their_cap_move_nowhere(spark, skewed):
    """Surely kept rows of a large sample are filtered in place: nothing is grouped or shuffled, copies and nulls stay."""
    rows = skewed.union(skewed.limit(50)).union(spark.sql("SELECT CAST(NULL AS LONG) AS id, 'tiny' AS label, NULL AS x"))
    whole = sampling.capped_sample(rows, "label", 2**40, seed=3, key_columns=["id"], edge_rows=100)
    assert "hashpartitioning" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows.collect()))
    large, small = (sampling.capped_sample(rows, "label", 1000, seed=3, key_columns=["id"], edge_rows=n) for n in (100, 10**6))
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect())) and small.where("label = 'hot'").count() == 1000
