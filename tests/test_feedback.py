"""Learned corrections: which entry they update, and which entries count."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from certloom.operators import enrich, lookups, matching
from certloom.sources import readers

ENTRY = "id string, updated_at string, template_name string, device_name string, device_code string, source_aliases array<string>"
RECORD = "record_id long, explicit string, source_code string, device_name string, device_code string, file_name string, raw_text string"


def learned(spark, existing, corrections):
    out = matching.learn_feedback(spark.createDataFrame(existing, ENTRY), spark.createDataFrame(corrections, ENTRY))
    return sorted((r["id"], r["template_name"], r["device_code"], tuple(r["source_aliases"])) for r in out.collect())


def test_an_entry_of_a_removed_template_hides_no_older_one(spark):
    entries = spark.createDataFrame([
        ("1", "2024", "A.docx", "", "K1", ["天平甲"]), ("2", "2025", "gone.docx", "", "K1", ["天平甲"])], ENTRY)
    records = spark.createDataFrame([(1, "", "", "", "K1", "f", "t")], RECORD)
    templates = spark.createDataFrame([("A.docx",)], "template_name string")
    out = matching.match_template(records, templates, entries).first()
    assert (out["template_name"], out["matched_by"]) == ("A.docx", "feedback:default")


def test_a_correction_without_a_code_updates_the_entry_of_its_name(spark):
    got = learned(spark, [("1", "2024", "A.docx", "天平", "K1", ["天平甲"])], [("2", "2025", "B.docx", "天平", "", ["天平甲"])])
    assert got == [("1", "B.docx", "", ("天平甲",))]


def test_a_correction_updates_the_entry_that_shares_an_alias(spark):
    got = learned(spark, [("1", "2024", "A.docx", "", "K1", ["老 名字"]), ("5", "2024", "E.docx", "", "K5", ["别的"])],
                  [("2", "2025", "B.docx", "", "K2", ["新名字", "老名字"]), ("3", "2026", "C.docx", "", "K2", ["第三"]), ("4", "2027", "D.docx", "", "", ["第三"])])
    assert got == [("1", "D.docx", "", ("老 名字", "新名字", "第三")), ("5", "E.docx", "K5", ("别的",))]


def test_corrections_that_teach_nothing(spark):
    rows = [("2", "2025", " ", "n", "", ["别名"]), ("3", "2025", "B.docx", "n", "", []), ("4", "2025", "B.docx", "n", "K", [" "])]
    assert learned(spark, [], rows) == []


def test_corrections_that_say_the_same_are_followed_once(spark, monkeypatch):
    rows, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: (made := write(df), rows.append(made.count()))[0])
    many = [(f"{n:03d}", f"2025-{n:03d}", f"T{n}.docx", "天平", "K-1" if n % 2 else "k1", ["天平 甲" if n % 3 else "天平甲"]) for n in range(200)]
    other = [("900", "2026", "Z.docx", "", "", ["天平甲"]), ("901", "2024", "Y.docx", "台秤", "K9", ["台秤"])]
    assert learned(spark, [("x", "2020", "X.docx", "", "", ["台秤"])], many + other) == [
        ("000", "Z.docx", "", ("天平甲",)), ("x", "Y.docx", "K9", ("台秤",))]
    assert rows[0] == 4 and max(rows) == 4


def test_catalogues_are_read_whole(spark):
    text = json.dumps([{"name": f"n{i}"} for i in range(2_500)])
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(F.size(readers.parse_catalog_json("t"))).first()[0] == 2_500
    assert frame.select(F.size(readers.parse_catalog_json("t", 7))).first()[0] == 7


def test_filter_by_an_empty_catalogue_keeps_everything(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, name string")
    names = spark.createDataFrame([("B",), ("b",)], "name string")
    assert [r["row_id"] for r in enrich.catalog_semi_filter(rows, names).collect()] == [2]
    assert enrich.catalog_semi_filter(rows, names.where("name = 'x'")).count() == 2


def test_long_texts_are_searched_without_copies(spark):
    words = " ".join(f"w{i * 7919 % 100_003}" for i in range(20_000))
    texts = spark.createDataFrame([(1, words), (2, "none"), (3, "")], "row_id int, t string")
    needles = spark.createDataFrame([("w0 w7919", 1), ("no", 2), ("absent", 3)], "needle string, n int")
    got = lookups.pattern_hits(texts, "row_id", F.col("t"), needles, "needle", ["n"]).collect()
    assert sorted((r["row_id"], r["n"]) for r in got) == [(1, 1), (2, 2)]
