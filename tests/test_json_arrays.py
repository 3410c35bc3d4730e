import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayline.sources import files, json_arrays

WORDS = ["a", '"', "\\", "}", "{", "]", "[", ",", ":", "é", "漢", "\n", '\\"', "}]", "\\\\", '","', "\t", "x" * 30]


def element(rng):
    row = {"id": rng.randrange(10**9), "s": "".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))}
    if rng.random() < 0.3:
        row["n"] = {"a": [1, {"b": "}{"}], "c": "".join(rng.choice(WORDS) for _ in range(4))}
    if rng.random() < 0.2:
        row["s"] = None
    return row


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


@pytest.mark.parametrize("seed", range(6))
def test_elements_of_a_split_file(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    rows = [element(rng) for _ in range(rng.choice([1, 40, 120]))]
    if seed == 5:
        rows[0]["s"] = "}" * 2000 + '"' * 500  # longer than several ranges
    text = json.dumps(rows, ensure_ascii=seed % 2 == 0, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]))
    path = write(tmp_path, "a.json", rng.choice(["", " \n"]) + text + rng.choice(["", "\n "]))
    pieces = json_arrays._pieces(spark, path)
    assert pieces.rdd.getNumPartitions() > min(4, len(text) // 400)
    got = [json.loads(r.value) for r in json_arrays.array_elements(spark, path).orderBy("element").collect()]
    assert got == rows


def test_many_files_and_schemas(spark, tmp_path, small_ranges):
    rng, want = random.Random(9), []
    for i in range(4):
        rows = [element(rng) for _ in range(30 * i)]
        want += [(r["id"], r["s"], json.dumps(r["n"], separators=(",", ":"), ensure_ascii=False) if "n" in r else None) for r in rows]
        write(tmp_path, f"{i}.json", json.dumps(rows, ensure_ascii=False, separators=(",", ":")))
    schema = T.StructType.fromDDL("id long, s string, n string")
    for stated in (schema, None):
        got = files.read_json_rows(spark, str(tmp_path), stated).select("id", "s", "n").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": 1}]]', '[{"a": "x]', '[1, {"a": 1}]', '[{"a": 1} {"a": 2}]', '[{"a": 1}, 2]', "3", '[{"a": 1}],', "[[{}]]"])
def test_anything_else_fails(spark, tmp_path, text):
    path = write(tmp_path, "bad.json", text)
    with pytest.raises(Exception):
        files.read_json_rows(spark, path, T.StructType.fromDDL("a int")).collect()


def test_empty_arrays_and_fields(spark, tmp_path):
    write(tmp_path, "none.json", "[]")
    write(tmp_path, "blank.json", " [ \n ] ")
    assert files.read_json_rows(spark, str(tmp_path), T.StructType.fromDDL("a int")).count() == 0
    path = write(tmp_path, "null.json", '[{}, {"a": null}, {"a": 4}]')
    assert sorted([r.a for r in files.read_json_rows(spark, path, T.StructType.fromDDL("a int")).collect()], key=str) == [4, None, None]


def test_no_python_and_no_single_task(spark, tmp_path, plan, small_ranges):
    path = write(tmp_path, "a.json", json.dumps([{"id": i} for i in range(400)]))
    text = plan(json_arrays.array_elements(spark, path))
    assert "Python" not in text and "SinglePartition" not in text
