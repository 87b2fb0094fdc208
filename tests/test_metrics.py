"""Hand-worked metrics, average precision, weights and quantiles; brute force where it is small."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import average_precision as ap
from flowlab.operators import metrics, reports
from flowlab.operators.digits import FIRST_SHIFT, ordered_bits, prefix, with_ordered_bits
from flowlab.operators.quantiles import grouped_quantiles
from flowlab.operators.support import class_weights


def summary(spark, pairs):
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    return metrics.per_class(metrics.confusion(df))


def test_phantom_class(spark):
    row = metrics.summary_metrics(summary(spark, [("a", "a"), ("a", "U"), ("b", "b")])).first()
    assert row.accuracy == pytest.approx(2 / 3)
    assert row.macro_f1 == pytest.approx(5 / 9)
    assert row.weighted_f1 == pytest.approx(7 / 9)


def test_rare_metrics_empty_is_null(spark):
    classes = summary(spark, [("a", "a"), ("b", "b")])
    row = metrics.rare_metrics(classes, metrics.is_rare(0)).first()
    assert row.rare_mean_precision is None and row.rare_support_total == 0 and row.rare_classes == []
    row = metrics.rare_metrics(classes, metrics.in_labels(["a", "missing"])).first()
    assert row.rare_mean_recall == 1.0


def test_evaluation_gate(spark):
    df = spark.createDataFrame(
        [("official test", "a", "a"), ("VAL", "a", "a")], "split string, y_true string, y_pred string"
    )
    table = metrics.per_class(metrics.confusion(df, keys=["split"]), ["split"])
    rows = {r.split: r for r in metrics.evaluation_summary(table).collect()}
    assert rows["official test"].rare_mean_recall == 1.0 and rows["official test"].rare_classes == ["a"]
    assert rows["VAL"].rare_mean_recall is None and rows["VAL"].rare_classes == []


def ap_of(spark, scores, truth, **settings):
    rows = [("c" if t else "d", [s, 1 - s]) for s, t in zip(scores, truth)]
    df = spark.createDataFrame(rows, "label string, probs array<double>")
    return ap.average_precision(df, ["c", "d"], only=["c"], **settings).first()


def test_average_precision_with_tie(spark):
    assert ap_of(spark, [0.9, 0.8, 0.8, 0.3], [1, 0, 1, 1]).average_precision == pytest.approx(1 / 3 + 2 / 9 + 1 / 4)
    assert ap_of(spark, [0.9, 0.8], [0, 0]).average_precision == 0.0


def brute_ap(scores, truth):
    total, area = sum(truth), 0.0
    for s in sorted(set(scores), reverse=True):
        seen = [t for x, t in zip(scores, truth) if x >= s]
        here = sum(t for x, t in zip(scores, truth) if x == s)
        area += here / total * (sum(seen) / len(seen))
    return area


def test_average_precision_random(spark):
    rnd = random.Random(3)
    scores = [rnd.choice([rnd.random(), 0.0, 1.0, 1e-9 * rnd.random(), 1 - 1e-9 * rnd.random()]) for _ in range(400)]
    truth = [int(rnd.random() < 0.3) for _ in scores]
    for opened in (1, 20, 10**6):
        assert ap_of(spark, scores, truth, opened=opened).average_precision == pytest.approx(brute_ap(scores, truth))


def test_average_precision_in_one_bucket(spark):
    """All scores share their leading digits; equal ones crowd a part that no digit divides."""
    rnd = random.Random(4)
    scores = [0.75 + 2.0**-48 * rnd.randrange(300) for _ in range(600)] + [0.75 + 2.0**-30] * 200
    truth = [int(rnd.random() < 0.2) for _ in scores]
    for opened in (5, 100, 10**6):
        assert ap_of(spark, scores, truth, opened=opened).average_precision == pytest.approx(brute_ap(scores, truth))


def test_average_precision_by_key(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["m", "n", None]), rnd.choice("cde"), [rnd.random() ** 4, rnd.choice([0.5, None, 1e-9]), rnd.random()]) for _ in range(500)]
    df = spark.createDataFrame(rows, "model string, label string, probs array<double>")
    table = {(r.model, r["class"]): r for r in ap.average_precision(df, ["c", "d", "e"], keys=["model"], opened=10).collect()}
    for model in ("m", "n", None):
        for k, name in enumerate("cde"):
            mine = [(p[k] if p[k] is not None else -1.0, int(y == name)) for m, y, p in rows if m == model]
            assert table[model, name].average_precision == pytest.approx(brute_ap(*zip(*mine)))
            assert table[model, name].positives == sum(t for _, t in mine)
    assert ap.average_precision(df.limit(0), ["c"], keys=["model"]).count() == 0


def test_unknown_rare_class_counts_as_zero(spark):
    df = spark.createDataFrame([("c", [0.9, 0.1]), ("d", [0.2, 0.8])], "label string, probs array<double>")
    table = ap.average_precision(df, ["c", "d"], only=["c", "ghost"])
    assert ap.rare_auprc(table, ["c", "ghost"]).first()[0] == pytest.approx(0.5)
    assert ap.rare_auprc(table, []).first()[0] is None


def test_ordered_bits_are_those_of_the_number(spark):
    rnd = random.Random(1)
    sizes = [0.0, 1.0, 2.0, 1e-300, 5e-324, 2.2250738585072014e-308, 1 - 2**-53, 1 + 2**-52, 8.0, 2.0**1023, 1.7976931348623157e308]
    sizes += [rnd.random() ** 9 for _ in range(200)] + [2.0**k * (1 + rnd.random()) for k in range(-1074, 1023, 7)]
    sizes += [np.nextafter(2.0**k, 0) for k in range(-1000, 1000, 37)] + [2.0**k for k in range(-1074, 1024, 11)] + [float("inf")]
    values = [float(x) for x in sizes] + [-float(x) for x in sizes]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", ordered_bits(F.col("v")))
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits), r.v
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(ordered_bits(F.col("v")).alias("b")).collect()
    assert [r.b for r in odd] == [2**63 - 1, None]
    assert [tuple(r) for r in with_ordered_bits(df, "v", "c").collect()] == [(r.v, r.b, r.b) for r in df.collect()]


def test_the_logarithm_of_a_number_is_taken_once(spark, capsys):
    """Also where rows are counted by their leading digit or joined by it."""
    rows = with_ordered_bits(spark.range(9).select((F.col("id") / 7).alias("v")), "v")
    digit = prefix(F.col("_bits"), FIRST_SHIFT)
    wanted = F.broadcast(spark.createDataFrame([(0,)], "wanted long"))
    for used in (rows.groupBy(digit.alias("p")).agg(F.count("*"), F.min("v")), rows.join(wanted, digit == F.col("wanted"))):
        used.explain()
        plan = capsys.readouterr().out
        assert plan.count("LOG2") == 1 and plan.count("POWER") == 1


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "label string")
    got = {r.label: r.weight for r in class_weights(df).collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["b"] == 2.0


def test_selection_and_fbeta(spark):
    row = spark.range(1).select(
        metrics.selection_score(F.lit(0.95), F.lit(0.90)).alias("over"),
        metrics.selection_score(F.lit(0.88), F.lit(0.90)).alias("under"),
        metrics.fbeta(F.lit(0.8), F.lit(0.5)).alias("f"),
        metrics.fbeta(F.lit(0.0), F.lit(0.0)).alias("zero"),
    ).first()
    assert row.over == pytest.approx(0.8625) and row.under == pytest.approx(0.90)
    assert row.f == pytest.approx(0.714286, abs=1e-6) and row.zero == 0.0


def test_tuning_table_and_best(spark):
    rows = [("a", 0, "TRAIN", 0.95), ("a", 0, "VAL", 0.90), ("b", 1, "TRAIN", 0.88), ("b", 1, "VAL", 0.90),
            ("c", 2, "TRAIN", 0.80), ("c", 2, "VAL", 0.90)]
    df = spark.createDataFrame(rows, "candidate string, idx int, split string, macro_f1 double")
    table = reports.tuning_table(df, order="idx")
    assert [r.candidate for r in table.collect()] == ["b", "c", "a"]  # equal scores: the earlier candidate first
    assert reports.best_candidate(table, order="idx").first().candidate == "b"


def test_model_summary_missing_split(spark):
    schema = "model string, split string, macro_f1 double, rare_mean_precision double, rare_mean_recall double, " \
             "rare_mean_auprc double"
    df = spark.createDataFrame([("m", "VAL", 0.5, None, None, None), ("m", "OFFICIAL TEST", 0.4, 0.1, 0.2, 0.3)], schema)
    row = reports.model_summary(df).first()
    assert row.train_macro_f1 is None and row.train_val_gap is None
    assert row.val_test_gap == pytest.approx(0.1) and row.rare_auprc == 0.3


def test_abstention_of_empty_subset(spark):
    df = spark.createDataFrame([("a", "UNCERTAIN_RARE"), ("a", "a")], "label string, predicted_class string")
    row = reports.abstention_stats(df, ["rare"]).first()
    assert tuple(row) == (0.5, 0.0, 0.5)


def test_classification_report_layout(spark):
    rows = metrics.classification_report(summary(spark, [("a", "a"), ("a", "b"), ("b", "b")])).collect()
    assert [r.label for r in rows] == ["a", "b", "accuracy", "macro avg", "weighted avg"]
    assert rows[2].precision == pytest.approx(2 / 3) and rows[-1].support == 3


POINTS = [0.0, 0.5, 0.55, 0.9, 0.95, 1.0]


@pytest.mark.parametrize("n,opened", [(1, 1), (2, 1), (7, 2), (400, 3), (400, 10**6)])
def test_quantiles_match_numpy(spark, n, opened):
    rnd = random.Random(n)
    kinds = {
        "shares": lambda: rnd.choice([rnd.random(), 0.25, rnd.random() * 1e-6, 1.0]),
        "any": lambda: rnd.choice([rnd.gauss(0, 1e6), -0.0, 0.0, 2.0**40 + rnd.randrange(5), -1e-200, 123456.0]),
        "close": lambda: 1e9 + rnd.randrange(50) * 2.0**-20,  # all leading digits equal
        None: lambda: 7.5,
    }
    values = {g: [make() for _ in range(n)] for g, make in kinds.items()}
    rows = [(g, v) for g, vs in values.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.q): r for r in grouped_quantiles(df, "g", "v", POINTS, opened=opened).collect()}
    assert len(got) == len(values) * len(POINTS)
    for g, vs in values.items():
        for q in POINTS:
            assert got[g, q].n == n and got[g, q].quantile == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=1e-12)


def test_quantiles_read_counts_only_of_a_crowded_value(spark):
    """A hot value is one bucket of one value: its rows are counted, never ranked."""
    df = spark.range(200_000).selectExpr("'g' AS g", "IF(id % 10 < 9, 0.5D, id / 200000D) AS v")
    got = {r.q: r.quantile for r in grouped_quantiles(df, "g", "v", POINTS, opened=50).collect()}
    values = np.where(np.arange(200_000) % 10 < 9, 0.5, np.arange(200_000) / 200_000)
    assert got == {q: pytest.approx(float(np.quantile(values, q)), abs=1e-12) for q in POINTS}
    assert grouped_quantiles(df, "g", "v", POINTS, min_rows=200_001).count() == 0
    assert grouped_quantiles(df.limit(0), "g", "v", POINTS).count() == 0
