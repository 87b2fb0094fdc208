"""Fitted models held against SQL: on columns of few values the best fit is known in closed form.

Order lines get a class that follows their line number, but for one line in five. A tree that parts all line numbers then
holds the class frequencies of each; one boosting step gives 1 / (1 + exp(-2 m)) for the mean m of +-1; regression with an
indicator per line number gives the balanced frequencies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.learning import SQL_LABEL, flows
from checks.tables import load, rounded, sql_per_class
from flowlab.operators.sampling import permute_labels
from flowlab.plans import hierarchical, missing, models, training
from flowlab.schema import FEATURES, TAXONOMY
from flowlab.session import fresh_path, materialize

NUMBERS = range(1, 8)
INDICATORS = [f"is_{v}" for v in NUMBERS]
_LABEL = "concat('k', CASE WHEN (l_orderkey * 7 + l_partkey) % 5 = 0 THEN 1 + l_suppkey % 7 ELSE l_linenumber END)"


def _lines(spark, sf):
    indicators = [f"CAST(l_linenumber = {v} AS DOUBLE) AS is_{v}" for v in NUMBERS]
    return load(spark, sf, "lineitem").selectExpr("CAST(l_linenumber AS DOUBLE) AS value", "0.0D AS still", *indicators, f"{_LABEL} AS label")


def _by_value(model, lines, places=6):
    """(value, class, p) of every line number and class."""
    scored = model.score(lines.drop("label").distinct())
    names = F.array(*[F.lit(c) for c in model.classes])
    pairs = scored.select("value", F.explode(F.arrays_zip(names.alias("c"), F.col("probs").alias("p"))).alias("e"))
    return rounded(pairs.select("value", F.col("e.c").alias("class"), F.col("e.p").alias("p")), "p", places=places)


def _one_tree(lines):
    return training.fit_forest(lines, features=["value", "still"], trees=1, min_rows_per_leaf=1, bootstrap=False)


def closed_forest(spark, sf):
    lines = _lines(spark, sf)
    return _by_value(_one_tree(lines), lines)


def closed_saved(spark, sf):
    """The same tree, saved and loaded by name."""
    lines, root = _lines(spark, sf), fresh_path(spark, "models")
    _one_tree(lines).save(models.model_path(root, "Random Forest"))
    return _by_value(models.load_model(spark, root, "Random Forest"), lines)


def closed_importance(spark, sf):
    """Only the line number parts anything."""
    return rounded(_one_tree(_lines(spark, sf)).feature_importance(spark), "importance")


def closed_boosted(spark, sf):
    lines = _lines(spark, sf)
    preset = dict(maxIter=1, stepSize=1.0, maxDepth=7, minInstancesPerNode=1)
    return _by_value(training.fit_boosted(lines, features=["value"], preset=preset), lines)


def closed_logreg(spark, sf):
    lines = _lines(spark, sf)
    return _by_value(training.fit_logreg(lines, features=INDICATORS, inverse_penalty=1e6), lines, places=2)


#: Class of each line number in the taxonomy: three families of two and one that passes through. Neighbours are of different
#: families, since a tree joins leaves side by side that say the same.
CLASSES = ["BenignTraffic", "Mirai-greeth_flood", "Recon-PortScan", "XSS", "Mirai-udpplain", "Recon-OSScan", "SqlInjection"]
#: One step of boosting, with room for every line number.
ONE_STEP = dict(maxIter=1, stepSize=1.0, maxDepth=7, minInstancesPerNode=1)


def _named(spark, sf):
    """The lines with classes of the taxonomy."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    place = F.substring("label", 2, 1).cast("int")
    return load(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_linenumber AS DOUBLE) AS value", "CAST(l_linenumber % 2 AS DOUBLE) AS odd", "0.0D AS still", f"{_LABEL} AS label"
    ).withColumn("label", F.element_at(names, place))


def _family_tree(feature):
    return lambda rows, _: training.fit_forest(rows, features=[feature, "still"], label="family", trees=1, min_rows_per_leaf=1, bootstrap=False)


def _one_step(rows, _=None):
    return training.fit_boosted(rows, features=["value", "still"], preset=ONE_STEP)


def _two_level(spark, sf):
    """A tree on the line number for the family, chosen over a tree on its parity, and one boosting step for the classes of
    each family."""
    lines = materialize(_named(spark, sf), "named")
    candidates = {"parity": _family_tree("odd"), "number": _family_tree("value")}
    model, chosen = hierarchical.train_hierarchical(
        lines, lines, key_columns=["l_orderkey", "l_linenumber"], max_per_family=2**40, family_candidates=candidates,
        features=["value", "still"], subtype_fit=_one_step,
    )
    return model, chosen, lines


def closed_two_level(spark, sf):
    """The pair of family and class that the two-level model decides on, and its confidences, for every line number; the
    model is saved and loaded first."""
    model, _, lines = _two_level(spark, sf)
    path = fresh_path(spark, "two_level")
    model.save(path)
    scored = models.load(spark, path).score(lines.select("value", "still").distinct())
    kept = scored.select("value", "predicted_family", "predicted_class", "family_confidence", "subtype_confidence", "confidence")
    return rounded(kept, "family_confidence", "subtype_confidence", "confidence")


#: A quarter of the orders is the official test split, another the validation split.
_SPLIT = "CASE l_orderkey % 4 WHEN 0 THEN 'OFFICIAL TEST' WHEN 1 THEN 'VAL' ELSE 'TRAIN' END"


def _two_level_job(spark, sf):
    """The two-level model fitted, saved and evaluated end to end; rare: at most a seventh of the test lines."""
    lines = materialize(_named(spark, sf).withColumn("split", F.expr(_SPLIT)), "named")
    train, val, test = (lines.where(F.col("split") == name).drop("split") for name in ("TRAIN", "VAL", "OFFICIAL TEST"))
    candidates = {"parity": _family_tree("odd"), "number": _family_tree("value")}
    job = hierarchical.two_level_job(
        train, val, test, key_columns=["l_orderkey", "l_linenumber"], max_per_family=2**40, family_candidates=candidates,
        features=["value", "odd", "still"], subtype_fit=_one_step, rare_support_threshold=test.count() // 7, path=fresh_path(spark, "job"),
    )
    return job.evaluation


def two_level_evaluation(spark, sf):
    """Six evaluations of one scoring pass: the family on all splits, the class on two, and where the family is right."""
    rows = _two_level_job(spark, sf).rows.withColumn("rare_classes", F.concat_ws(",", "rare_classes"))
    return rounded(rows, *[c for c, t in rows.dtypes if t == "double"])


def two_level_reports(spark, sf):
    """The per-class reports of family and class on the test split."""
    return rounded(_two_level_job(spark, sf).reports, "precision", "recall", "f1")


def two_level_confidences(spark, sf):
    rows = _two_level_job(spark, sf).confidences
    return rounded(rows, "mean_family_confidence", "mean_subtype_confidence")


def closed_sweep(spark, sf):
    """Two family trees compared on all lines: the better comes first."""
    table = _two_level(spark, sf)[1].table
    return rounded(table.select("candidate", "train_macro_f1", "val_macro_f1"), "train_macro_f1", "val_macro_f1")


def closed_shuffled(spark, sf):
    """A boosting step on permuted labels gives their means for each line number."""
    lines = _named(spark, sf)
    permuted = materialize(permute_labels(lines, seed=7, key_columns=["l_orderkey", "l_linenumber"]), "permuted")
    return _by_value(_one_step(permuted), lines.select("value", "still", "label"))


#: Early stopping whose best round is known: one in three orders is held out, and a sixth of its lines have a class of
#: their own, so that after some rounds closer margins cost more there than they gain.
STOPPING = dict(maxIter=24, stepSize=0.1, maxDepth=7, minInstancesPerNode=1)
PATIENCE = 3
_HELD = "l_orderkey % 3 = 0"
_KIND = f"""concat('k', CASE WHEN {_HELD} AND l_partkey % 6 = 0 OR (l_orderkey * 7 + l_partkey) % 5 = 0
    THEN 1 + l_suppkey % 3 ELSE 1 + l_linenumber % 3 END)"""


def closed_stopping(spark, sf):
    """Log loss over the held-out lines by round, and whether the model keeps the round."""
    lines = load(spark, sf, "lineitem").selectExpr("CAST(l_linenumber AS DOUBLE) AS value", f"{_KIND} AS label", f"{_HELD} AS held")
    model = training.fit_boosted(lines.where("NOT held"), lines.where("held"), features=["value"], preset=STOPPING, patience=PATIENCE)
    kept = [m.getNumTrees for m in model.per_class]
    rows = [(k + 1, round(x, 6), all(k < n for n in kept)) for k, x in enumerate(model.losses)]
    return spark.createDataFrame(rows, "round int, loss double, kept boolean")


def _holed(spark, sf):
    """Flows whose first three features have nulls, NaN and infinities."""
    a, b, c = (F.col(f"`{x}`") for x in FEATURES[:3])
    return flows(spark, sf).withColumns(
        {
            FEATURES[0]: F.when(F.col("flow_id") % 7 != 0, a),
            FEATURES[1]: F.when(F.col("flow_id") % 11 == 0, float("nan")).when(F.col("flow_id") % 13 == 0, float("inf")).otherwise(b),
            FEATURES[2]: F.when(F.col("flow_id") % 17 == 0, float("-inf")).otherwise(c),
        }
    )


def filled_features(spark, sf):
    """What training and scoring see in place of missing and infinite values."""
    rows = _holed(spark, sf)
    filler = missing.assembling_stages(rows, FEATURES)[0]
    return filler.transform(rows).select(
        "flow_id",
        F.col("_filled_0").alias("a"),
        F.col("_missing_0").alias("a_missing"),
        F.col("_filled_1").alias("b"),
        F.col("_missing_1").alias("b_missing"),
        F.col("_filled_2").alias("c"),
    )


def holed_model_rows(spark, sf):
    """A forest fitted and scored on rows with holes: every row gets a prediction with probabilities that sum to one."""
    rows = _holed(spark, sf)
    model = training.fit_forest(rows, trees=20, max_depth=6, min_rows_per_leaf=2)
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    scored = model.predict(rows).select("label", (F.abs(total - 1) < 1e-9).alias("sums"), F.col("y_pred").isNotNull().alias("predicted"))
    return scored.groupBy("label").agg(F.count("*").alias("rows"), F.count_if("sums").alias("sums"), F.count_if("predicted").alias("predicted"))


def _sql(measure: str, places: int) -> str:
    return f"""WITH t AS (SELECT CAST(l_linenumber AS DOUBLE) AS value, {_LABEL} AS label FROM lineitem),
        n AS (SELECT value, label AS class, count(*) AS n FROM t GROUP BY 1, 2),
        g AS (SELECT v.value, c.class, coalesce(n.n, 0) AS n, c.total, sum(coalesce(n.n, 0)) OVER (PARTITION BY v.value) AS of_value
              FROM (SELECT DISTINCT value FROM t) v CROSS JOIN (SELECT label AS class, count(*) AS total FROM t GROUP BY 1) c
              LEFT JOIN n ON n.value = v.value AND n.class = c.class),
        m AS (SELECT value, class, {measure} AS m FROM g)
        SELECT value, class, round(m / sum(m) OVER (PARTITION BY value), {places}) AS p FROM m"""


def _sql_filled() -> str:
    def median(x: str) -> str:
        return f"(SELECT {x} FROM (SELECT {x}, row_number() OVER (ORDER BY {x}) AS r, count(*) OVER () AS n FROM f WHERE isfinite({x})) WHERE r = CAST(ceil(n * 0.5) AS BIGINT))"

    return f"""WITH f AS (SELECT vec_id AS flow_id,
          CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[1] AS DOUBLE) END AS a,
          CASE WHEN vec_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN vec_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(embedding[2] AS DOUBLE) END AS b,
          CASE WHEN vec_id % 17 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(embedding[3] AS DOUBLE) END AS c FROM embeddings)
        SELECT flow_id, coalesce(a, {median('a')}) AS a, CAST(a IS NULL AS DOUBLE) AS a_missing,
          CASE WHEN isnan(b) THEN {median('b')} WHEN isinf(b) THEN (SELECT max(b) FROM f WHERE isfinite(b)) ELSE b END AS b,
          CAST(isnan(b) AS DOUBLE) AS b_missing,
          CASE WHEN isinf(c) THEN (SELECT min(c) FROM f WHERE isfinite(c)) ELSE c END AS c FROM f"""


def _sql_rows() -> str:
    return f"SELECT {SQL_LABEL} AS label, count(*) AS rows, count(*) AS sums, count(*) AS predicted FROM embeddings GROUP BY 1"


_FAMILIES = [TAXONOMY[c] for c in CLASSES]
_NAMED = f"""t AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS value, {CLASSES}[CAST(substr({_LABEL}, 2, 1) AS INT)] AS label,
        {_FAMILIES}[CAST(substr({_LABEL}, 2, 1) AS INT)] AS family FROM lineitem)"""


def _sql_two_level() -> str:
    return f"""WITH {_NAMED},
        n AS (SELECT value, family, label, count(*) AS n FROM t GROUP BY 1, 2, 3),
        f AS (SELECT value, family, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY value) AS of_value FROM n GROUP BY 1, 2),
        s AS (SELECT value, family, label, n, row_number() OVER (PARTITION BY value, family ORDER BY n DESC) AS r FROM n),
        p AS (SELECT f.value, f.family AS predicted_family, s.label AS predicted_class, f.n / f.of_value AS fc,
                CASE WHEN f.family = 'Benign' THEN 1 ELSE 1 / (1 + exp(-2 * (2.0 * s.n / f.n - 1))) END AS sc,
                row_number() OVER (PARTITION BY f.value ORDER BY s.n DESC) AS r
              FROM f JOIN s ON s.value = f.value AND s.family = f.family AND s.r = 1)
        SELECT value, predicted_family, predicted_class, round(fc, 6) AS family_confidence, round(sc, 6) AS subtype_confidence,
          round(fc * sc, 6) AS confidence FROM p WHERE r = 1"""


def _sql_job(final: str) -> str:
    """What each line number is told, from the training lines; then all truths and predictions by level and split."""
    lines = _NAMED.replace(" FROM lineitem)", f", {_SPLIT} AS split FROM lineitem)")
    rare = "split = 'OFFICIAL TEST' AND support > 0 AND support <= (SELECT count(*) // 7 FROM t WHERE split = 'OFFICIAL TEST')"
    return f"""WITH {lines},
        n AS (SELECT value, family, label, count(*) AS n FROM t WHERE split = 'TRAIN' GROUP BY 1, 2, 3),
        f AS (SELECT value, family, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY value) AS of_value,
                row_number() OVER (PARTITION BY value ORDER BY sum(n) DESC) AS place FROM n GROUP BY 1, 2),
        s AS (SELECT value, family, label, n, row_number() OVER (PARTITION BY value, family ORDER BY n DESC) AS r FROM n),
        j AS (SELECT f.value, f.family AS decided, s.label AS class, f.n / f.of_value AS fc,
                CASE WHEN f.family = 'Benign' THEN 1 ELSE 1 / (1 + exp(-2 * (2.0 * s.n / f.n - 1))) END AS sc
              FROM f JOIN s ON s.value = f.value AND s.family = f.family AND s.r = 1 WHERE place <= 2),
        d AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY value ORDER BY fc * sc DESC) = 1),
        w AS (SELECT t.split, t.label, t.family, f.family AS said, decided, class, fc, sc
              FROM t JOIN f ON f.value = t.value AND place = 1 JOIN d ON d.value = t.value),
        c AS (SELECT 'family' AS level, split, family AS y_true, said AS y_pred FROM w
              UNION ALL SELECT 'decided family', split, family, decided FROM w
              UNION ALL SELECT 'subtype', split, label, class FROM w
              UNION ALL SELECT 'subtype, family correct', split, label, class FROM w WHERE family = decided),
        cm AS (SELECT level, split, y_true, y_pred, count(*) AS n FROM c GROUP BY ALL),
        {sql_per_class('cm', ['level', 'split'])},
        ev AS (SELECT level, split, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
                 round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
                 round(avg(precision) FILTER ({rare}), 6) AS rare_mean_precision, round(avg(recall) FILTER ({rare}), 6) AS rare_mean_recall,
                 round(avg(f1) FILTER ({rare}), 6) AS rare_mean_f1,
                 coalesce(string_agg(label, ',' ORDER BY label) FILTER ({rare}), '') AS rare_classes FROM pc GROUP BY 1, 2)
        {final}"""


_JOB_ROWS = """SELECT * FROM ev WHERE level = 'family' OR level = 'subtype' AND split <> 'TRAIN'
    OR level = 'subtype, family correct' AND split = 'OFFICIAL TEST'"""
_JOB_REPORTS = """, o AS (SELECT * FROM pc WHERE split = 'OFFICIAL TEST' AND level IN ('decided family', 'subtype')),
    a AS (SELECT level, split, sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS n, avg(precision) AS mp, avg(recall) AS mr,
            avg(f1) AS mf, sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
            sum(f1 * support) / sum(support) AS wf FROM o GROUP BY 1, 2),
    lines AS (SELECT level, split, 0 AS section, label, precision, recall, f1, support FROM o
      UNION ALL SELECT level, split, 1, 'accuracy', acc, acc, acc, n FROM a
      UNION ALL SELECT level, split, 2, 'macro avg', mp, mr, mf, n FROM a
      UNION ALL SELECT level, split, 3, 'weighted avg', wp, wr, wf, n FROM a)
    SELECT level, split, CAST(section AS INTEGER) AS section, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, support FROM lines"""
_JOB_CONFIDENCES = """SELECT split, round(avg(fc), 6) AS mean_family_confidence, round(avg(sc), 6) AS mean_subtype_confidence
    FROM w GROUP BY 1"""


def _sql_sweep() -> str:
    def f1(by: str) -> str:
        return f"""(SELECT avg(2.0 * tp / (truth + predicted)) FROM (
            SELECT c.family, (SELECT coalesce(sum(n), 0) FROM {by} WHERE family = c.family AND said = c.family) AS tp,
              (SELECT sum(n) FROM {by} WHERE family = c.family) AS truth,
              (SELECT coalesce(sum(n), 0) FROM {by} WHERE said = c.family) AS predicted
            FROM (SELECT DISTINCT family FROM t) c))"""

    def cells(key: str) -> str:
        counts = f"SELECT {key} AS k, family, count(*) AS n FROM t GROUP BY 1, 2"
        return f"SELECT family, n, first_value(family) OVER (PARTITION BY k ORDER BY n DESC) AS said FROM ({counts})"

    return f"""WITH {_NAMED}, a AS ({cells('value')}), b AS ({cells('l_linenumber % 2')})
        SELECT 'number' AS candidate, round({f1('a')}, 6) AS train_macro_f1, round({f1('a')}, 6) AS val_macro_f1
        UNION ALL SELECT 'parity', round({f1('b')}, 6), round({f1('b')}, 6)"""


def _sql_shuffled() -> str:
    return f"""WITH {_NAMED},
        r AS (SELECT value, row_number() OVER (ORDER BY md5(concat_ws('|', '7', l_orderkey, l_linenumber))) AS rn FROM t),
        s AS (SELECT label, count(*) AS n FROM t GROUP BY 1),
        c AS (SELECT label, sum(n) OVER (ORDER BY label) AS upto, sum(n) OVER (ORDER BY label) - n AS frm FROM s),
        g AS (SELECT value, c.label AS class, count(*) AS n FROM r JOIN c ON rn > frm AND rn <= upto GROUP BY 1, 2),
        x AS (SELECT v.value, c.label AS class, coalesce(g.n, 0) AS n, sum(coalesce(g.n, 0)) OVER (PARTITION BY v.value) AS of_value
              FROM (SELECT DISTINCT value FROM t) v CROSS JOIN c LEFT JOIN g ON g.value = v.value AND g.class = c.label),
        m AS (SELECT value, class, 1 / (1 + exp(-2 * (2.0 * n / of_value - 1))) AS m FROM x)
        SELECT value, class, round(m / sum(m) OVER (PARTITION BY value), 6) AS p FROM m"""


def _sql_stopping() -> str:
    """Margins follow a recurrence of the classes' shares; rounds are fitted 6, 12, 24 at a time until boosting stops."""
    return f"""WITH RECURSIVE lines AS (SELECT l_linenumber AS value, {_KIND} AS label, {_HELD} AS held FROM lineitem),
        n AS (SELECT value, label, count(*) AS n FROM lines WHERE NOT held GROUP BY ALL),
        q AS (SELECT v.value, c.label, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY v.value) AS q
              FROM (SELECT DISTINCT value FROM n) v CROSS JOIN (SELECT DISTINCT label FROM n) c LEFT JOIN n USING (value, label)),
        m(k, value, label, q, f) AS (
          SELECT 1, value, label, q, 2 * q - 1 FROM q
          UNION ALL SELECT k + 1, value, label, q, f + {STOPPING['stepSize']} * 4 * (q - 1 / (1 + exp(-2 * f))) FROM m
          WHERE k < {STOPPING['maxIter']}),
        p AS (SELECT k, value, label, 1 / (1 + exp(-2 * f)) AS s, sum(1 / (1 + exp(-2 * f))) OVER (PARTITION BY k, value) AS total FROM m),
        x AS (SELECT k, -avg(ln(s / total)) AS loss FROM lines JOIN p USING (value, label) WHERE held GROUP BY k),
        b AS (SELECT min(k) AS best FROM (SELECT k, loss, min(loss) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND {PATIENCE} FOLLOWING) AS low FROM x)
              WHERE loss = low),
        r AS (SELECT best, CASE WHEN best + {PATIENCE} <= {2 * PATIENCE} THEN {2 * PATIENCE} WHEN best + {PATIENCE} <= {4 * PATIENCE} THEN {4 * PATIENCE}
              ELSE {STOPPING['maxIter']} END AS fitted FROM b)
        SELECT k AS round, round(loss, 6) AS loss, k <= best AS kept FROM x, r WHERE k <= fitted"""


_FREQUENCY = _sql("CAST(n AS DOUBLE)", 6)

QUERIES = {
    "closed_forest": (closed_forest, _FREQUENCY),
    "closed_saved": (closed_saved, _FREQUENCY),
    "closed_importance": (
        closed_importance,
        "SELECT * FROM (VALUES ('value', CAST(1 AS DOUBLE)), ('still', CAST(0 AS DOUBLE))) t(feature, importance)",
    ),
    "closed_boosted": (closed_boosted, _sql("1 / (1 + exp(-2 * (2.0 * n / of_value - 1)))", 6)),
    "closed_logreg": (closed_logreg, _sql("CAST(n AS DOUBLE) / total", 2)),
    "closed_two_level": (closed_two_level, _sql_two_level()),
    "two_level_evaluation": (two_level_evaluation, _sql_job(_JOB_ROWS)),
    "two_level_reports": (two_level_reports, _sql_job(_JOB_REPORTS)),
    "two_level_confidences": (two_level_confidences, _sql_job(_JOB_CONFIDENCES)),
    "closed_sweep": (closed_sweep, _sql_sweep()),
    "closed_shuffled": (closed_shuffled, _sql_shuffled()),
    "closed_stopping": (closed_stopping, _sql_stopping()),
    "filled_features": (filled_features, _sql_filled()),
    "holed_model_rows": (holed_model_rows, _sql_rows()),
}
