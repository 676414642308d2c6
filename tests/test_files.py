"""Readers and writers: round trips on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strokemill.functions import text
from strokemill.operators import curation as cu
from strokemill.sources import files, manifest


def test_manifest_round_trip(spark, tmp_path):
    rows = [(s, f"s{i:03d}", f"i{i}", f"m{i}") for i in range(250) for s in ("train", 'va"l')]
    pairs = spark.createDataFrame(rows, "split string, stem string, image string, mask string")
    lines = files.manifest_lines(pairs, rows=40).orderBy("split", "part", "place").collect()
    for split in ("train", 'va"l'):
        doc = json.loads("\n".join(r.line for r in lines if r.split == split))
        assert (doc["split"], doc["seed"], doc["pair_count"]) == (split, 42, 250)
        assert [p["stem"] for p in doc["pairs"]] == [f"s{i:03d}" for i in range(250)]
    assert len({r.part for r in lines}) > 4
    files.write_manifest(pairs.filter("split = 'train'"), str(tmp_path / "m"))
    parts = sorted((tmp_path / "m" / "split=train").glob("part-*.txt"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert doc["pair_count"] == len(doc["pairs"]) == 250
    (tmp_path / "one.json").write_text(json.dumps(doc))
    assert files.read_manifest(spark, str(tmp_path / "one.json")).count() == 250
    assert files.manifest_lines(pairs.filter("false")).count() == 0


def test_command_text_keeps_the_order_of_lines(spark, tmp_path):
    lines = [f"MOVE {i} 1 2" if i % 7 else "MOVE 1 2" for i in range(5000)]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        good, bad = files.read_commands_text(spark, str(tmp_path / "c.txt"))
        assert good.rdd.getNumPartitions() > 3
        assert [r.x for r in good.orderBy("file", "seq").collect()] == [i for i in range(5000) if i % 7]
        assert bad.count() == 715 and {r.error for r in bad.collect()} == {"bad MOVE"}
        lists = tmp_path / "lists"
        lists.mkdir()
        (lists / "a.txt").write_text("\n".join([f"train: x{i}" for i in range(2000)] + [f"x{i} val" for i in range(0, 2000, 2)]))
        got = {r.id: r.split for r in cu.parse_split_assignments(files.read_split_files(spark, str(lists))).collect()}
        assert got == {f"x{i}": "train" if i % 2 else "val" for i in range(2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"train": ["p", {"stem": "q"}], "dev": 7, "other": ["z"]}))
    (tmp_path / "b.json").write_text(json.dumps([{"split": "test", "id": "p"}, {"split": "val", "image": ["r", "s"]}]))
    rows = cu.split_json_rows(files.read_split_json(spark, str(tmp_path)))
    none = spark.createDataFrame([], "file string, file_ord string, line_ord int, value string")
    got = {r.id: r.split for r in cu.parse_split_assignments(none, rows).collect()}
    assert got == {"p": "test", "q": "train", "7": "val", "r": "val", "s": "val"}


def test_split_line_errors(spark):
    lines = spark.createDataFrame([("ids.txt", 1, 1, "a b"), ("ids.txt", 1, 2, "train: c"), ("val.txt", 2, 1, "d"), ("ids.txt", 1, 3, "# x")], "file string, file_ord int, line_ord int, value string")
    assert [(r.line_ord, r.value) for r in cu.split_line_errors(lines).collect()] == [(1, "a b")]


def test_flatten_ids(spark):
    given = {'["a","b",3]': ["a", "b", "3"], '{"name":"y","id":"x"}': ["x"], '{"n":{"stem":"s"},"p":["p","q"]}': ["s", "p", "q"], '"solo"': ["solo"], "7": ["7"], "null": [], '[[1,[2,{"file":"f\\"g"}]],null,true]': ["1", "2", 'f"g', "true"], "[]": [], "{}": [], "[[[[[1]]]]]": ["1"], "{": [], "plain text": ["plain text"]}
    df = spark.createDataFrame([(k,) for k in given], "v string")
    assert {r.v: r.ids for r in df.select("v", text.flatten_ids(F.col("v")).alias("ids")).collect()} == given
    assert {r.v: r.ids for r in text.with_ids(df, "v").collect()} == given
    deep = "[" * 300 + '{"x": {"b": 1.50, "a": [2]}}' + "]" * 300
    assert text.with_ids(spark.createDataFrame([(deep,), (None,)], "v string"), "v").collect()[0].ids == ["1.50", "2"]


def test_split_lists_of_any_depth(spark):
    deep = '{"train": ' + "[" * 30 + '{"stem": "x"}' + "]" * 30 + ', "val": ["y"]}'
    rows = cu.split_json_rows(spark.createDataFrame([(1, deep)], "file_ord int, value string"))
    assert sorted((r.id, r.split) for r in rows.collect()) == [("x", "train"), ("y", "val")]


def test_ids_that_are_nested_too_deep_fail(spark):
    df = spark.createDataFrame([("[" * 9 + "1" + "]" * 9,)], "v string")
    assert df.select(text.flatten_ids(F.col("v"), 9).alias("ids")).first().ids == ["1"]
    with pytest.raises(Exception, match="deeper than 8 levels"):
        df.select(text.flatten_ids(F.col("v"), 8)).collect()


def test_json_lines_experiments_and_report(spark, tmp_path):
    rows = [("MOVE", 1.0, 2.0, 3.0), ("PEN_UP", None, None, None)]
    files.write_commands_jsonl(spark.createDataFrame(rows, "cmd string, x double, y double, speed double"), str(tmp_path / "j"))
    assert sorted(tuple(r) for r in files.read_commands_jsonl(spark, str(tmp_path / "j")).collect()) == sorted(rows)
    assert all("null" not in p.read_text() for p in (tmp_path / "j").glob("*.json"))
    doc = {"summary": {"run_count": 2, "image_count": 1, "aggregates": [{"runs": 1}, {"runs": 2}], "planning_comparisons": []}, "results": [{"image": "a", "num_paths": 3}, {"image": "b", "mask_dice": 0.5}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    results = files.read_experiments(spark, str(tmp_path / "e.json"))
    assert sorted((r.image, r.num_paths, r.mask_dice) for r in results.collect()) == [("a", 3, None), ("b", None, 0.5)]
    summary = files.read_experiment_summaries(spark, str(tmp_path / "e.json")).collect()
    assert sorted((r.run_count, r.section, r.row) for r in summary) == [(2, "aggregates", '{"runs":1}'), (2, "aggregates", '{"runs":2}')]
    files.write_report_csv(results, str(tmp_path / "csv"), ["image", "num_paths"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["image", "num_paths"]


def test_readiness_steps(spark):
    audits = spark.createDataFrame([(0, 0, 0), (4, 3, 0), (4, 4, 1), (4, 4, 0)], "pairs bigint, binary_like bigint, unreadable bigint")
    got = [tuple(r) for r in cu.readiness(audits).collect()]
    assert got == [(False, False, False, "add pairs"), (True, False, False, "clean masks"), (True, False, False, "train"), (True, True, False, "train")]
    assert [r.next_step for r in cu.readiness(audits, checkpoint=True).collect()][-1] == "infer"



def some_pairs(spark, n):
    stem = F.format_string("s%05d", F.col("id"))
    split = F.when(F.col("id") % 5 == 0, "val").otherwise("train")
    return spark.range(n).repartition(7).select(split.alias("split"), stem.alias("stem"), F.concat(F.lit("i/"), stem).alias("image"), F.concat(F.lit("m/"), stem).alias("mask"))


def test_a_manifest_is_published_as_one_file(spark, tmp_path, monkeypatch):
    pairs = some_pairs(spark, 500)
    lines = files.manifest_lines
    monkeypatch.setattr(manifest, "manifest_lines", lambda p, seed: lines(p, seed, rows=40))
    manifest.publish_manifest(pairs, str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["train.json", "val.json"]
    for split, n in (("train", 400), ("val", 100)):
        doc = json.loads((tmp_path / "m" / f"{split}.json").read_text())
        assert (doc["split"], doc["pair_count"], len(doc["pairs"])) == (split, n, n)
        assert [p["stem"] for p in doc["pairs"]] == sorted(p["stem"] for p in doc["pairs"])
    back = files.read_manifest(spark, str(tmp_path / "m")).select("split", "stem", "image", "mask")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pairs.collect()))


def test_a_failing_task_publishes_nothing(spark, tmp_path):
    manifest.publish_manifest(some_pairs(spark, 20), str(tmp_path / "m"))
    before = {p.name: p.read_text() for p in (tmp_path / "m").iterdir()}
    broken = F.when(F.col("place") == 15, F.raise_error(F.lit("broken"))).otherwise(F.col("line"))
    rows = files.manifest_lines(some_pairs(spark, 40)).select("split", F.col("part").cast("int").alias("part"), F.col("place").cast("bigint").alias("place"), broken.alias("line"))
    with pytest.raises(Exception, match="broken"):
        rows.repartition(4).write.format("manifest").mode("append").option("folder", str(tmp_path / "m")).save()
    assert {p.name: p.read_text() for p in (tmp_path / "m").iterdir()} == before


@pytest.mark.parametrize("digits", [2, 4, 6])
def test_ratios_are_exact_at_any_number_of_buckets(spark, digits):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in cu.exact_ratio_split(rows, "k", 0.2, 0.1, digits=digits).collect()}
    order = sorted(range(1000), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert got == {k: "test" if i >= 900 else "val" if i >= 700 else "train" for i, k in enumerate(order)}
