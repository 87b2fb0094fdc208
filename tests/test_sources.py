"""CSV by name, schema errors, threshold files, sinks, taxonomy and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from flowlab.functions.decisions import ThresholdConfig
from flowlab.operators import reports, taxonomy
from flowlab.operators.small import pin, small_side
from flowlab.plans.scoring import decide_flat
from flowlab.schema import EXCLUDED, FEATURES, TAXONOMY, conform, flow_schema, require_label
from flowlab.session import fresh_path, materialize, scratch, shared_folder
from flowlab.sources.config import load_threshold_config, save_threshold_config
from flowlab.sources.csv import header_lines, read_archive, read_csv_by_name, read_labelled_test, write_predictions
from flowlab.streaming import scoring as streams


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_csv_by_name(spark, tmp_path):
    folder = str(tmp_path)
    write(folder, "1.csv", "a,b,label\n1,2.5,x\n")
    write(folder, "2.csv", "label,b,a\ny,3.5,4\n")
    got = read_csv_by_name(spark, f"{folder}/*.csv", features=["a", "b"])
    assert sorted(map(tuple, got.collect())) == [(1.0, 2.5, "x"), (4.0, 3.5, "y")]
    with pytest.raises(Exception):  # headers differ: verified, not trusted
        read_csv_by_name(spark, f"{folder}/*.csv", features=["a", "b"], uniform=True).collect()
    with pytest.raises(ValueError, match="zz"):
        read_csv_by_name(spark, f"{folder}/*.csv", features=["a", "zz"])


def test_archive_drops_null_labels_and_keeps_infinity(spark, tmp_path):
    write(str(tmp_path), "1.csv", "a,label\ninf,x\n2,\nbad,y\n")
    got = {r.label: r.a for r in read_archive(spark, f"{tmp_path}/*.csv", features=["a"]).collect()}
    assert got == {"x": float("inf"), "y": None}


def test_labelled_test_checks(spark, tmp_path):
    write(str(tmp_path), "t.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="label"):
        read_labelled_test(spark, f"{tmp_path}/t.csv", features=["a"])
    write(str(tmp_path), "u.csv", "a,label\n1,x\n")
    with pytest.raises(ValueError, match="Missing required columns.*b"):
        read_labelled_test(spark, f"{tmp_path}/u.csv", features=["a", "b"])


def test_flow_contract(spark):
    assert len(FEATURES) == 40 and not set(FEATURES) & set(EXCLUDED)
    wide = spark.range(1).select(*[F.lit("1.5").alias(c) for c in reversed(FEATURES)], F.lit("DDoS").alias("Telnet"))
    projected = conform(wide)
    assert projected.columns == FEATURES and projected.schema == flow_schema(label=None)
    with pytest.raises(ValueError, match="Tot sum"):
        conform(wide.drop("Tot sum"))
    with pytest.raises(ValueError):
        require_label(wide)


def test_taxonomy(spark):
    grouped = taxonomy.families_of()
    assert len(TAXONOMY) == 34
    assert {f: len(x) for f, x in grouped.items()} == {
        "Benign": 1, "Malware": 1, "WebAttack": 5, "DDoS": 12, "Spoofing": 2, "BruteForce": 1, "DoS": 4, "Mirai": 3,
        "Recon": 5,
    }
    ordered = [r.family for r in taxonomy.families_in_order(taxonomy.taxonomy_table(spark)).collect()]
    assert ordered == list(grouped)
    df = spark.createDataFrame([("XSS",), ("NoSuchLabel",)], "label string")
    assert taxonomy.with_family(df.where("label = 'XSS'")).first().family == "WebAttack"
    with pytest.raises(Exception, match="NoSuchLabel"):
        taxonomy.with_family(df).collect()


def test_threshold_defaults(spark, tmp_path):
    assert load_threshold_config(spark, str(tmp_path / "none.json")) == ThresholdConfig()
    assert load_threshold_config(spark, None).enabled is False
    write(str(tmp_path), "t.json", '{"thresholds": {"XSS": 0.4}}')
    config = load_threshold_config(spark, f"{tmp_path}/t.json")
    assert config.enabled and config.rare_classes == ["XSS"] and config.uncertainty_floor == 0.5
    assert config.abstain_label == "UNCERTAIN_RARE" and config.fallback_to_next_rank
    write(str(tmp_path), "e.json", '{\n "enabled": false,\n "thresholds": {}\n}')
    assert load_threshold_config(spark, f"{tmp_path}/e.json").enabled is False


def test_threshold_roundtrip(spark):
    config = ThresholdConfig(True, {"XSS": 0.41}, ["XSS", "SqlInjection"], False, True)
    path = fresh_path(spark, "config")
    save_threshold_config(
        spark, path, config, model_name="m", rare_support_threshold=500, min_recall_ratio=0.85, tuning_scope="hard"
    )
    assert load_threshold_config(spark, path) == config


def test_predictions_as_csv(spark):
    df = spark.createDataFrame([(1, [0.7, 0.3])], "id int, probs array<double>")
    path = fresh_path(spark, "out")
    write_predictions(decide_flat(df, ["A", "B"]), path)
    row = spark.read.option("header", True).csv(path).first()
    assert (row.predicted_class, row.uncertain, row.selected_rank) == ("A", "False", "1")


def test_small_sides(spark):
    table, small = pin(spark.range(5), 5)
    assert small and table.count() == 5
    table, small = pin(spark.range(6), 5)
    assert not small and table.count() == 6
    big = spark.range(100)
    plan = big.join(small_side(spark.range(3)), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_stream_equals_batch(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for i in range(3):
        write(folder, f"{i}.csv", "id,p\n" + "".join(f"{i * 10 + j},{j / 10}\n" for j in range(10)))

    def scorer(rows):
        return decide_flat(rows.select("id", F.array("p", 1 - F.col("p")).alias("probs")), ["A", "B"])

    stream = streams.stream_csv(spark, folder, "id int, p double", files_per_trigger=1)
    out, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    streams.wait(streams.score_to_files(stream, scorer, out, state), 120)
    batch = scorer(spark.read.schema("id int, p double").option("header", True).csv(folder))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))

    stream = streams.stream_csv(spark, folder, "id int, p double", files_per_trigger=1)
    totals, counting = fresh_path(spark, "totals"), fresh_path(spark, "state")
    streams.wait(streams.running_alert_totals(stream, scorer, totals, counting), 120)
    held = streams.alert_totals(spark, totals)
    assert list(map(tuple, streams.running_distribution(held).collect())) == list(map(tuple, reports.alert_distribution(batch).collect()))
    assert tuple(streams.running_tiles(held).first()) == pytest.approx(tuple(reports.alert_tiles(batch).first()))

    # the last batch fails after its totals are written and runs again: nothing is counted twice
    first = scorer(spark.read.schema("id int, p double").option("header", True).csv(f"{folder}/2.csv"))
    streams._added(first.select("alert_level", "uncertain", "confidence"), 2, totals)
    assert streams.running_tiles(streams.alert_totals(spark, totals)).first().total_rows == 30

    # a restart with the same checkpoint reads only the new file
    write(folder, "9.csv", "id,p\n99,0.95\n")
    stream = streams.stream_csv(spark, folder, "id int, p double")
    streams.wait(streams.score_to_files(stream, scorer, out, state), 120)
    assert spark.read.parquet(out).count() == 31
    streams.wait(streams.running_alert_totals(stream, scorer, totals, counting), 120)
    everything = scorer(spark.read.schema("id int, p double").option("header", True).csv(folder))
    held = streams.alert_totals(spark, totals)
    assert tuple(streams.running_tiles(held).first()) == pytest.approx(tuple(reports.alert_tiles(everything).first()))
    assert {r["batch"] for r in spark.read.parquet(totals).select("batch").distinct().collect()} == {0, 1, 2, 3}


def test_labelled_test_files_of_two_layouts(spark, tmp_path):
    write(str(tmp_path), "1.csv", "a,b,label\n1,2,x\n")
    write(str(tmp_path), "2.csv", "b,a,label\n3,4,\n")
    got = read_labelled_test(spark, f"{tmp_path}/*.csv", features=["a", "b"])
    assert got.columns == ["a", "b", "label"]
    assert sorted(map(tuple, got.collect())) == [(1.0, 2.0, "x"), (4.0, 3.0, None)]


def test_layouts_in_one_scan(spark, tmp_path):
    """Cells of several layouts come from one scan; odd numbers, short and long lines, quotes and repeated headers."""
    folder = f"{tmp_path}/in"
    write(folder, "a b+c.csv", 'x,label,y\n1.5,"one, two",2\n\ninf,q,-inf\nx,label,y\nNaN,,nonsense\n')
    write(folder, "b.csv", "y,x\n7\n8,9,10\n")
    write(folder, "c.csv", "label,extra,x\nz,ignored,3e2\n")
    table = read_csv_by_name(spark, folder, features=["x", "y"])
    got = sorted(map(str, map(tuple, table.collect())))
    assert got == sorted(map(str, [
        (1.5, 2.0, "one, two"), (float("inf"), float("-inf"), "q"), (float("nan"), None, None),
        (None, 7.0, None), (9.0, 8.0, None), (300.0, None, "z"),
    ]))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] text") == 1 and "] csv" not in plan and "Union" not in plan


def test_headers_of_awkward_files(spark, tmp_path):
    write(str(tmp_path), "a file+1.csv", "x,label\n1,A\n2,B\n")
    write(str(tmp_path), "b.csv", "\nlabel,x\nC,3\n")
    write(str(tmp_path), "empty.csv", "")
    lines = {r.path.rsplit("/", 1)[-1]: r.header for r in header_lines(spark, f"{tmp_path}/*.csv").collect()}
    assert lines == {"a file+1.csv": "x,label", "b.csv": "label,x"}
    rows = read_csv_by_name(spark, f"{tmp_path}/*.csv", features=["x"]).collect()
    assert sorted((r.x, r.label) for r in rows) == [(1.0, "A"), (2.0, "B"), (3.0, "C")]


def test_scratch_removes_its_tables_only(spark):
    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        inner = materialize(spark.range(5), "inner")
        files = inner.inputFiles()
        assert inner.count() == 5
    assert kept.count() == 3 and not any(os.path.exists(f.removeprefix("file:")) for f in files)
    with pytest.raises(ValueError, match="stop"), scratch(spark):
        files = materialize(spark.range(2), "failed").inputFiles()
        raise ValueError("stop")
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)
    assert materialize(spark.range(4), "after").count() == 4
