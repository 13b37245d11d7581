"""Texts that repeat one thing thousands of times: every detector reads them whole, without deep stacks or long searches."""
import time

import pytest

from citegrove.operators import extract


def run(spark, text, what=extract.extract_all):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return what(df).orderBy("start").collect()


def test_table_of_numbers(spark):
    table = "REsp 1.741.784/PR consta da planilha: " + " ".join(f"{i % 900 + 100}.{i % 700 + 200}" for i in range(10_000)) + ". Veja o RE 1.492.256."
    got = run(spark, table)
    assert table[got[0]["start"]:got[0]["end"]] == "REsp 1.741.784/PR" and table[got[-1]["start"]:got[-1]["end"]] == "RE 1.492.256"
    rows = run(spark, "valores " + "; ".join(str(1000 + i) for i in range(10_000)), extract.scan_numbers)
    assert [r["number_text"] for r in rows] == [str(1000 + i) for i in range(10_000)]


def test_long_lists(spark):
    numbers = [str(i + 1) for i in range(2_000)]
    got = run(spark, "Súmulas " + ", ".join(numbers[:-1]) + " e 2000/STJ")
    assert [r["norm_key"] for r in got] == [f"sumula|STJ|false|{n}" for n in numbers]
    text = "art. 5º" + ", LXXVIII" * 3_000 + ", do CPC"
    assert [(r["start"], r["end"]) for r in run(spark, text)] == [(0, len(text))]
    names = " ".join(["Silva"] * 2_000)
    text = f"decisão do STJ de 2019 (Rel. Min. {names})"
    assert [(r["start"], r["end"]) for r in run(spark, text)] == [(0, len(text))]
    text = "REsp 1.741.784/PR" + "".join(f" e 1.996.{i % 900 + 100}/RJ" for i in range(1_000))
    assert len(run(spark, text)) == 1_001


@pytest.mark.parametrize("text", ["l. " * 5_000 + "fim", "o l S " * 2_000, "- . " * 5_000, "REsp 12" + " l" * 4_000 + " x", "1" * 20_000 + "x", "1.-" * 8_000])
def test_dirt_takes_no_time(spark, text):
    start = time.time()
    run(spark, text)
    assert time.time() - start < 60


def test_ordinal_far_from_its_number(spark):
    for blanks in (1, 4, 5, 10, 40):
        rows = run(spark, "nº" + " " * blanks + "SS. 413", extract.scan_numbers)
        assert [r["number_text"] for r in rows] == ["SS. 413"]
    assert [r["number_text"] for r in run(spark, "o SS. 413", extract.scan_numbers)] == ["413"]


def test_offsets_beside_invisible_characters(spark):
    text = "x​ " + "palavra " * 20_000 + "REsp 1.741.784​/PR e a Sú​mula 331 do TST"
    got = run(spark, text)
    assert [text[r["start"]:r["end"]] for r in got] == ["REsp 1.741.784​/PR", "Sú​mula 331 do TST"]
