"""One JSON object read in byte ranges against one parser over the whole file."""

import json
import random

import pytest
from pyspark.sql import types as T

from gradeworks.sources import json_object

RECORD = T.StructType([T.StructField("title", T.StringType()), T.StructField("n", T.LongType()),
                       T.StructField("more", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
ODD = ['plain', 'a "quoted" } brace { \\ back', '}}}{{{', '"}', '\\"}', '', 'é𝒳 }', '[]', '\n},', 'x' * 300]


def objects(seed, n):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        record = {"title": rng.choice(ODD) + rng.choice(ODD), "n": rng.randint(0, 9), "more": {rng.choice(ODD): [rng.choice(ODD)] * rng.randint(0, 2)}}
        out[rng.choice([str(i), f"-{i}", f"key {i} }}"])] = rng.choice([record, record, record, None, {}])
    return out


@pytest.mark.parametrize("size", ["40b", "200b", "1m"])
@pytest.mark.parametrize("dump", [{}, {"indent": 2}, {"separators": (",", ":")}], ids=["plain", "indented", "tight"])
def test_ranges_of_any_size(spark, tmp_path, size, dump):
    made = {f"f{k}.json": objects(k, n) for k, n in enumerate((60, 1, 0, 7))}
    for name, data in made.items():
        (tmp_path / name).write_text(json.dumps(data, ensure_ascii=False, **dump) + ("\n" if len(data) % 2 else ""))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, size)
        df = json_object.read_object(spark, str(tmp_path), RECORD)
        got = sorted(df.collect(), key=str)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = []
    for data in made.values():
        for k, v in data.items():
            v = v or {}
            number = int(k) if k.lstrip("-").isdigit() else None
            want.append((number, v.get("title"), v.get("n"), v.get("more")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if size == "40b":
        assert df.rdd.getNumPartitions() > 50


def test_no_file_has_entries(spark, tmp_path):
    (tmp_path / "e.json").write_text(" {} ")
    assert json_object.read_object(spark, str(tmp_path), RECORD).collect() == []
