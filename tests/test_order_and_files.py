"""Exact median, neighbours without a second shuffle, and audits of raw files."""

import csv
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rolecast.operators import audit as A
from rolecast.operators import ordered as O
from rolecast.operators import score as S
from rolecast.sources import raw_files as RF


@pytest.mark.parametrize("kind", ["spread", "copies", "tiny", "near", "wide", "one"])
def test_median_is_exact(spark, kind):
    draw = random.Random(kind)
    values = {
        "spread": [draw.random() for _ in range(4001)], "copies": [0.5] * 900 + [draw.choice([0.0, 0.1, 0.5, 1.0]) for _ in range(601)],
        "tiny": [5e-324 * draw.randrange(9) for _ in range(50)], "near": [0.1 + 2.0**-56 * draw.randrange(5) for _ in range(300)],
        "wide": [draw.choice([-1.7e308, 1.7e308, 1e-300, 0.0, 3.0]) for _ in range(201)], "one": [0.25],
    }[kind]
    rows = [(v,) for v in values] + [(None,), (float("nan"),)]
    assert S.exact_median(spark.createDataFrame(rows, "x double").repartition(4), "x") == statistics.median(values)


def test_median_of_nothing(spark):
    assert S.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_previous_rows_need_one_range_exchange(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(40), f"n{k}", None if k % 11 == 0 else k / 7) for k in range(700)]
    frame = spark.createDataFrame(rows, "a int, b string, c double").repartition(5)
    order = [F.col("a"), F.col("b")]
    found = O.with_previous(frame, order, ["b", "c"])
    got = {r.b: None if r.previous is None else tuple(r.previous) for r in found.collect()}
    ranked = sorted(rows, key=lambda r: (r[0], r[1]))
    assert got == {x[1]: None if p is None else (p[1], p[2]) for p, x in zip([None, *ranked], ranked)}
    plan = O.previous_in_ranges(O.range_sorted(frame, order), ["b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(a" not in plan and "hashpartitioning(b" not in plan
    assert O.with_previous(frame.where("false"), order, ["b"]).count() == 0


def test_audit_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = [(f"CAND_{k:07d}", str(k), str(1 - k / 1000), "r") for k in range(1, 101)]
    frame = spark.createDataFrame(lines, "candidate_id string, rank string, score string, reasoning string").repartition(3)
    counted = frame.mapInArrow(look, frame.schema)
    assert A.audit(counted).count() == 0
    # Once to find the ranges and once to deal the rows; the checks read what is saved.
    assert seen.value <= 200


CONTENTS = [
    b'candidate_id,rank,score,reasoning\nCAND_0000001,1,0.5,"a\nb, ""c"""\n', b'"candidate_id","rank","score","reasoning"\r\nx,"1",,\r\n', b"", b"\n\na,b\n", b"a\xff,b\n", b'x"y,"z"w,"open\n end',
    "﻿candidate_id,rank,score,reasoning\né,日,🙂,\n".encode(), b",,,\n, ,\n1,2\n", b'"a""",""\r"b\rc",d\r',
]


def test_records_are_those_of_a_csv_reader(spark, tmp_path):
    for k, content in enumerate(CONTENTS):
        (tmp_path / f"f{k}.csv").write_bytes(content)
    got = {}
    for r in RF.records(RF.read_raw_files(spark, str(tmp_path))).orderBy("nr").collect():
        got.setdefault(int(r.file[-5]), []).append(list(r.cells))
    for k, content in enumerate(CONTENTS):
        try:
            text = content.decode()
        except UnicodeDecodeError:
            assert k not in got
            continue
        (tmp_path / "one").write_bytes(content)
        with open(tmp_path / "one", newline="", encoding="utf-8") as file:
            assert got.get(k, []) == list(csv.reader(file)), text
        (tmp_path / "one").unlink()


def test_files_are_checked_by_their_bytes(spark, tmp_path):
    for k, content in enumerate(CONTENTS):
        (tmp_path / f"f{k}.{'txt' if k == 8 else 'csv'}").write_bytes(content)
    (tmp_path / "big.csv").write_bytes(b"x" * 3000)
    files = RF.read_raw_files(spark, str(tmp_path), most_bytes=2000)
    found = {}
    for r in A.audit_files(files).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], set()).add((r.check, r.detail.split(", found")[0]))
    header = ("header", "expected candidate_id,rank,score,reasoning")
    assert "f0.csv" not in found and "f1.csv" not in found
    assert found["f2.csv"] == {("header", "file is empty")} and found["f3.csv"] == found["f5.csv"] == found["f6.csv"] == found["f7.csv"] == {header}
    assert found["f4.csv"] == {("encoding", "file is not UTF-8")} and found["big.csv"] == {("file_size", "3000 bytes are not read")}
    assert found["f8.txt"] == {("file_name", "expected a .csv file"), header}


def test_one_raw_output_is_audited_whole(spark, tmp_path):
    lines = [",".join(A.HEADER)] + [f'CAND_{k:07d},{k},{1 - k / 1000},"line\n{k}"' for k in range(1, 101)]
    (tmp_path / "good.csv").write_text("\n".join(lines))
    assert A.audit_raw(RF.read_raw_files(spark, str(tmp_path / "good.csv"))).count() == 0
    lines[5] = "CAND_0000005,5,0.2"
    lines[9] = "CAND_0000009,9,0.9999,rises"
    (tmp_path / "bad.csv").write_text("\n".join(lines))
    kinds = {r.check for r in A.audit_raw(RF.read_raw_files(spark, str(tmp_path / "bad.csv"))).collect()}
    assert kinds == {"width", "rank_gaps", "monotone"}
