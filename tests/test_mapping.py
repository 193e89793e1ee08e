"""Columns by their contents: renamed copies are mapped, estimates against exact values, roles on planted columns."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import mapping

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["customer", "supplier", "clients", "items"])
def test_renamed_copies_are_mapped(spark, name):
    rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
    new = [f"x{k}" for k in range(len(rows.columns))]
    order = random.Random(2).sample(range(len(new)), len(new))
    # half of the rows, other names, another order of columns
    copy = rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(2)) == 0).toDF(*new).select([new[k] for k in order])
    found = mapping.assign(mapping.column_matches(mapping.column_slots(copy), mapping.column_slots(rows)))
    assert {a: b for a, (b, _) in found.items()} == dict(zip(new, rows.columns, strict=True))
    assert set(mapping.renamed(copy, found, 0.3).columns) == set(rows.columns)


def test_overlap_is_near_the_jaccard_index(spark):
    a, b = set(range(0, 9000)), set(range(3000, 12000))
    frame = lambda s, c: spark.createDataFrame([(str(x),) for x in s], f"{c} string")
    (row,) = mapping.column_matches(mapping.column_slots(frame(a, "a")), mapping.column_slots(frame(b, "b")), 0.0).collect()
    assert abs(row["overlap"] - len(a & b) / len(a | b)) < 0.12
    (row,) = mapping.column_matches(mapping.column_slots(frame(a, "a")), mapping.column_slots(frame(a, "b")), 0.0).collect()
    assert row["overlap"] == 1.0 and abs(row["score"] - 1) < 1e-9


def test_roles(spark):
    rows = [(k, str(k / 2) if k else "", f"Where is {k}?" if k == 5 else f"see {k}", "x " * 80, f"A-{k}" if k % 10 else None, "some words here", None, f"{80 + k % 19}" if k % 3 else f"about {k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "id int, `a.b` string, q string, t string, c string, w string, none string, y string")
    got = {r["column"]: (r["role"], r["confidence"], r["n"]) for r in mapping.content_roles(mapping.column_slots(frame)).collect()}
    assert got == {
        "id": ("numeric", 0.7, 60), "a.b": ("numeric", 0.7, 59), "q": ("question", 0.7, 60), "t": ("answer", 0.6, 60), "c": ("code", 0.7, 54), "w": ("unknown", 0.3, 60), "y": ("year", 0.8, 60),
    }


def test_ties_and_nothing(spark):
    one = spark.createDataFrame([("v", "v")], "a string, b string")
    slots = mapping.column_slots(one)
    found = mapping.assign(mapping.column_matches(slots, slots))
    assert {a: b for a, (b, _) in found.items()} == {"a": "a", "b": "b"}
    none = mapping.column_slots(one.limit(0))
    assert none.collect() == [] and mapping.column_matches(none, slots).collect() == [] and mapping.content_roles(none).collect() == []
