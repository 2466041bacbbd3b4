"""Text exports of three instrument families read together."""

import pytest
from pyspark.sql import functions as F

from railguard.operators.contracts import ContractViolation
from railguard.sources import families
from railguard.sources.exports import number, read_lines

OUTCOME = "77777"


def write(folder):
    (folder / "a.txt").write_text(
        f"~ by hand\n~Time[h] U[V] I[A] Ah[Ah] Cyc-Count\n0.5 3.1 -0.5 {OUTCOME} 1\n1 3.2 0.5 {OUTCOME} 2\n"
    )
    (folder / "b.txt").write_bytes(
        ("﻿Run 7; café\n\nCyc-Count;~Time[h];I[A];U[V];Ah[Ah];T1[°C];T-Set[°C]\n"
         f'1;0,25;"0,5";3,3;{OUTCOME};25,5;30\n1;0,5;0,5;3,4;{OUTCOME}\n1;2;3;4;5;6;7;8\n').encode()
    )
    (folder / "c.txt").write_bytes(
        ('"Cycle Count","Start time","Test time",Charge current limit,"Cell ""A"", current",Voltage max,Cell voltage,'
         "Chamber temp,Cell temp,Ah-Cyc-Discharge-0 µ\n"
         f'"3",x,0:01:00.5,9,"1.5",9,3.7,9,21,{OUTCOME}\n3,"y, z",0:02:00,9,1.5,9,3.8,9,21,{OUTCOME}\n').encode("latin-1")
    )
    return str(folder)


def test_three_families_in_one_read(spark, tmp_path):
    lines = read_lines(spark, write(tmp_path))
    rows = families.with_seconds(families.prediction_fields(lines)).orderBy("file", "seconds").collect()
    got = [tuple(r[c] for c in ("file", "family", "cycle_raw", "seconds", "current_raw", "voltage_raw", "temperature_raw")) for r in rows]
    assert got == [
        ("a.txt", "prefixed", "1", 1800.0, "-0.5", "3.1", None),
        ("a.txt", "prefixed", "2", 3600.0, "0.5", "3.2", None),
        ("b.txt", "counter", "1", 900.0, "0,5", "3,3", "25,5"),
        ("b.txt", "counter", "1", 1800.0, "0,5", "3,4", None),
        ("c.txt", "synonyms", "3", 60.5, "1.5", "3.7", "21"),
        ("c.txt", "synonyms", "3", 120.0, "1.5", "3.8", "21"),
    ]
    assert not any(OUTCOME in str(r) for r in rows)
    labels = families.label_fields(lines).groupBy("file").agg(
        F.sum(number("cumulative_raw")).alias("a"), F.sum(number("capacity_raw")).alias("b")
    )
    assert sorted(tuple(r) for r in labels.collect()) == [
        ("a.txt", 155554.0, None), ("b.txt", 155554.0, None), ("c.txt", None, 155554.0)
    ]


def test_headers_joined_without_broadcast_give_the_same(spark, tmp_path, monkeypatch):
    lines = read_lines(spark, write(tmp_path))
    before = families.prediction_fields(lines).drop("line")
    monkeypatch.setattr(families, "BROADCAST_FILES", 1)
    after = families.prediction_fields(lines).drop("line")
    assert before.exceptAll(after).count() == 0 and before.count() == after.count() == 6


@pytest.mark.parametrize(
    "text",
    [
        "1,2,3,4,5\n",
        "~Time[h],U[V],I[A],Ah[Ah],Cyc-Count,Cyc-Count\n0,1,1,1,1,1\n",
        "\n" * 512 + "~Time[h],U[V],I[A],Ah[Ah],Cyc-Count\n0,1,1,1,1\n",
        "Cycle Count,Time,Current,Voltage,Current B\n1,2,3,4,5\n",
    ],
)
def test_files_without_an_admissible_header_are_refused(spark, tmp_path, text):
    (tmp_path / "x.txt").write_text(text)
    with pytest.raises(ContractViolation):
        families.prediction_fields(read_lines(spark, str(tmp_path)))


def test_clock_text_is_refused_where_hours_are_promised(spark, tmp_path):
    (tmp_path / "x.txt").write_text("Cyc-Count;Time[h];I[A];U[V];Ah[Ah]\n1;0:10:00;1;1;1\n")
    fields = families.prediction_fields(read_lines(spark, str(tmp_path)))
    with pytest.raises(ContractViolation):
        families.with_seconds(fields)


def test_nothing_to_read(spark):
    empty = spark.createDataFrame([], "file string, block_start bigint, line bigint, value string")
    assert families.with_seconds(families.prediction_fields(empty)).count() == 0
