"""Worked examples with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from certloom.functions import cells as cf
from certloom.functions import dates, numbers
from certloom.functions import text as tx
from certloom.functions.cells import FieldRule
from certloom.operators import align, cells, enrich, extract, fields, matching, metrics, records, sheets
from certloom.operators.cells import SchemaColumn
from certloom.plans.align import SCHEMA


def lit_array(*values):
    return F.array(*[F.lit(v) for v in values])


def test_linearity(spark):
    row = spark.createDataFrame([("50 100 150", "5 10 15")], "linearity_ux_values string, linearity_u2_values string")
    out = metrics.apply_formulas(row.withColumns({"receive_date": F.lit(""), "calibration_date": F.lit("")})).first()
    assert (out.linearity_fi_values, out.linearity_f_avg, out.linearity_fi_delta_percent) == ("10 10 10", "10", "0 0 0")


def test_linearity_keeps_a_stated_value(spark):
    row = spark.createDataFrame(
        [("50 100", "5 10", "99.9")], "linearity_ux_values string, linearity_u2_values string, linearity_f_avg string")
    assert metrics.apply_formulas(row).first().linearity_f_avg == "99.9"


def test_profile_formulas(spark):
    row = spark.createDataFrame(
        [("882B 屏蔽室.docx", "-20 -18 -19", "-70 -66 -68")], "template string, shield_p1_dbm_values string, shield_p2_dbm_values string")
    out = metrics.apply_formulas(row, "template").first()
    assert (out.shield_se_db_values, out.shield_se_avg_db) == ("50 48 49", "49")
    row = spark.createDataFrame([("58 15kV击穿电压试验仪", "15 15.5 16")], "template string, breakdown_voltage_values_kv string")
    out = metrics.apply_formulas(row, "template").first()
    assert (out.breakdown_voltage_avg_kv, out.breakdown_voltage_stddev_kv) == ("15.5", "0.4082")


@pytest.mark.parametrize("raw, col, text, least", [
    ("2-l1", 0, "2.11", 0.9), ("C02", 2, "CO2", 0.9), ("g z", 3, "GZ", 0.9), ("I0O12l", 4, "100121", 0.9), ("21.5", 0, "21.5", 0)])
def test_column_rule(one, raw, col, text, least):
    out = one(lambda t: cf.column_rule(t, col), raw)
    if raw == "21.5":
        assert (out["text"], out["score"]) == ("", 0.2)
    else:
        assert out["text"] == text and out["score"] >= least


def test_owner_and_medium_noise(one):
    assert one(lambda t: cf.column_rule(t, 1), "A")["score"] < 0.5
    assert one(lambda t: cf.suppress_noise(F.col(t), F.lit(0.99), F.lit(2)), "unknown") is True


def test_row_consistency(one):
    values = {"col_08": "50.0", "col_09": "40.0", "col_18": "50.0", "col_19": "1.8", "col_20": "45.0", "col_29": "√", "col_33": ""}
    out = one(lambda t: cf.row_inconsistencies(lambda k: F.lit(values[k])))
    assert [r["reason"] for r in out] == ["volume_deviation", "weight_loss_inconsistent", "conclusion_missing"]


def test_table_quality_of_an_empty_table(spark):
    made = spark.range(37).select(F.lit(1).alias("table_id"), F.lit(1).alias("row"), (F.col("id") + 1).cast("int").alias("col"), F.lit("").alias("final_text"))
    review = spark.range(20).select(F.lit(1).alias("table_id"))
    assert cells.table_quality(made, review).first().ok is False


def test_check_lines(one):
    assert one(extract.check_lines, "一、一般检查：\n(1)夹具能夹紧试样。\n(2)两夹具间距可以调整。") == ["夹具能夹紧试样。", "两夹具间距可以调整。"]


def test_requirement_match(spark):
    sources = ["外观完好", "(1)夹具能夹紧试样。", "(2)两夹头间的最大起始距离：500mm", "负荷齐全", "计数器正常"]
    frame = spark.createDataFrame([(["两夹具间最大距离应为 mm"], sources)], "t array<string>, s array<string>")
    out = frame.select(matching.match_requirements(F.col("t"), F.col("s")).alias("m")).first()["m"][0]
    assert out["source_no"] == 2 and out["score"] >= 0.30


def test_requirements_use_each_line_once(spark):
    frame = spark.createDataFrame([(["夹具能夹紧试样", "夹具能夹紧试样"], ["夹具能夹紧试样"])], "t array<string>, s array<string>")
    out = frame.select(matching.match_requirements(F.col("t"), F.col("s")).alias("m")).first()["m"]
    assert [m["source_no"] for m in out] == [0, None]


def test_measured_items(one):
    text = "夹角测量\n实测值：60 °\n力值 U=0.1 N,k=2\n实 测 值（N）：5.10\n其它\n实测值："
    out = one(lambda t: extract.measured_items(tx.squeezed_lines(t)), text)
    assert [(m["anchor"], m["value"], m["unit"]) for m in out] == [("夹角测量", "60", "°"), ("力值", "5.10", "N")]


def test_value_and_series_maps(one):
    text = "标称值(N)\t0.05\t0.1\t0.2\n校准值(N)\t0.052\t0.12\t0.21"
    out = one(lambda t: extract.value_maps(F.col(t)), text)
    assert {m["key"]: m["value"] for m in out if m["map_no"] == 1} == {"0.05": "0.052", "0.1": "0.12", "0.2": "0.21"}
    series = one(lambda t: matching.series_for_label(extract.series_maps(F.col(t)), F.lit("标准值(N)")), text)
    assert series == ["0.05", "0.1", "0.2"]
    assert one(lambda t: matching.series_for_label(extract.series_maps(F.col(t)), F.lit("实际值(N)")), text) == ["0.052", "0.12", "0.21"]


def test_column_value_map_with_carried_key(one):
    text = "量程\t实测值\n10\t1.0\n\t1.1\n20\t2.0\n以下空白\tx\n30\t3.0"
    out = one(lambda t: extract.value_maps(F.col(t)), text)
    assert {m["key"]: m["value"] for m in out} == {"10": "1.1", "20": "2.0"}


def test_paired_series(one):
    text = "频率\tP1(dBm)\tP2(dBm)\tSE(dB)\n1\t-27.2\t-33.2\t6.0\n2\t-27.2\t-33.3\t"
    out = one(lambda t: extract.paired_series(F.col(t)), text)
    assert [tuple(r) for r in out] == [("-27.2", "-33.2", "6.0"), ("-27.2", "-33.3", "6.1")]


def test_background_noise(one):
    text = "160 kV 背景噪声 0.3 pC\n0 kV 背景噪声 0.2pC\n220 kV 背景噪声：0.4 pC"
    assert one(lambda t: extract.background_noise(tx.squeezed_lines(t)), text) == ["0.2", "0.3", "0.4"]


def test_rule_checks_and_distance(one):
    sources = lit_array("双向旋转平稳", "两夹头间最大起始距离：500 mm", "施加负荷后试件处于平直", "负荷齐全")
    wanted = ["旋转夹头应能双向旋转", "两夹具间距离最大距离为 mm", "试样始终处于平直状态", "扭转次数可设定", "负荷齐全"]
    got = [one(lambda t, w=w: matching.rule_check(F.lit(w), sources)) for w in wanted]
    assert got == [True, True, True, False, True]
    assert one(lambda t: matching.fill_distance(F.lit("最大距离为 ＿ mm"), sources)) == "最大距离为 500mm"


def test_basis_mode(one):
    assert one(tx.basis_mode, "□检测 ☑校准") == "校准"
    assert one(tx.basis_mode, "√ 检测 □校准") == "检测"


def test_series_fields_follow_the_measured_line(one):
    text = "电荷量Urel=0.1%,k=2；上升沿Urel=0.3%\n电荷量\n实测 10 20 30\n上升沿 1.5 1.6"
    assert one(lambda t: extract.series_values(tx.split_lines(t), ["电荷量"]), text) == "10 20 30"
    assert one(lambda t: extract.series_values(tx.split_lines(t), ["上升沿"]), text) == "1.5 1.6"
    assert one(lambda t: extract.urel_percent(F.col(t), tx.split_lines(t), ["电荷量"]), text) == "0.1"


def test_feedback_identity_mismatch_rules_out(spark):
    entries = spark.createDataFrame(
        [("1", "2024", "T", "压力表", "AB1", ["压力表"])],
        "id string, updated_at string, template_name string, device_name string, device_code string, source_aliases array<string>")
    rows = spark.createDataFrame(
        [(1, "温度计", "ab-1", "压力表"), (2, "压力表", "ab-1", ""), (3, "", "", "某压力 表记录"), (4, "压力表", "", "x")],
        "record_id int, device_name string, device_code string, raw_text string")
    out = matching.match_by_feedback(
        rows, entries, "record_id", F.col("device_name"), F.col("device_code"), matching.search_text(F.lit(""), F.col("raw_text")))
    assert {r.record_id: r.by_feedback for r in out.collect()} == {1: None, 2: "T", 3: "T", 4: "T"}


@pytest.mark.parametrize("hint, template", [
    ("软击穿试验仪", "R-825B 软化击穿试验仪.docx"), ("介损系统", "R-819B 局部放电测试系统.docx"), ("卷绕", "线材卷绕试验机.docx")])
def test_name_synonyms(one, hint, template):
    core = lambda v: one(lambda t: matching.core_name(matching.full_name(F.col(t))), v)
    assert core(hint) == core(template)


def test_prune_draft(one):
    kept = records.prune_fields(F.create_map(F.lit("factory_serial_no"), F.lit("A200441033"), F.lit("owner"), F.lit(" ")))
    found = F.create_map(F.lit("factory_serial_no"), F.lit("A200441033"), F.lit("ownership_code"), F.lit("金鸽"))
    assert one(lambda t: kept) == {"factory_serial_no": "A200441033"}
    assert one(lambda t: records.prune_recognized(kept, found)) == {"ownership_code": "金鸽"}


LINES = {
    "2.11 Ar GZ A200441033 22.5 15.0 43.4": ["2.11", "", "Ar", "GZ", "A200441033", "22.5", "15.0", "43.4"],
    "2.11 金码 Ar GZ A200441033 22.5 15.0 43.4": ["2.11", "金码", "Ar", "GZ", "A200441033", "22.5", "15.0", "43.4"],
    "2.11 WL HE147226 22.5 15.0 46.6": ["2.11", "", "", "WL", "HE147226", "22.5", "15.0", "46.6"],
    "2.11 AI 1m HE147226 22.5 15.0 46.6": ["2.11", "", "Ar", "1m", "HE147226", "22.5", "15.0", "46.6"],
    "2.11 341 CO2 G工 A220033187 22.5 15.0": ["2.11", "341", "CO2", "G工", "A220033187", "22.5", "15.0"],
}


def test_line_alignment(spark):
    for line, expected in LINES.items():
        schema = SCHEMA[:len(expected)]
        values = spark.createDataFrame([(line,)], "t string").select(
            align.align_line_to_schema(F.col("t"), schema).alias("v")).first()["v"]
        assert [values[c.key] for c in schema] == expected, line


def test_alignment_trace_and_choice(spark):
    schema = [*SCHEMA[:5], SchemaColumn(5, "valve", "瓶阀检验", rule=FieldRule("checkbox_choice", choices=[("校阀", ["校阀"]), ("换阀", ["换阀"])]))]
    frame = spark.createDataFrame([("2.11 Ar GZ A200441033 √校阀 □换阀",)], "t string")
    out = frame.select(
        align.align_line_to_schema(F.col("t"), schema).alias("v"), align.align_trace(F.col("t"), schema).alias("r"),
        align.choice_warnings(F.col("t"), schema).alias("w")).first()
    assert out["v"]["valve"] == "校阀" and out["w"] == {}
    assert [t["blank_kept"] for t in out["r"]][:3] == [False, True, False]


def test_slots_do_not_shift(spark):
    schema = [SchemaColumn(n, f"c{n}", f"L{n}") for n in range(6)]
    rows = [(1, 1, 0, "", "", t, [x, 0, x + 8, 5]) for t, x in (("2.11", 0), ("AIR", 20), ("JM", 30), ("HE14", 40), ("7226", 45), ("22.5", 52))]
    made = spark.createDataFrame(rows, "table_id int, row int, col int, column_key string, column_label string, final_text string, bbox array<int>")
    out = cells.cells_to_records(made, schema).first()
    assert (out.c0, out.c1, out.c2, out.c3, out.c4, out.c5) == ("2.11", "", "AIR", "JM", "HE147226", "22.5")


@pytest.mark.parametrize("raw, value, flipped", [("20.06", "20.06", False), ("07.13", "13.07", True), ("2020年6月", "20.06", False), ("x", None, False)])
def test_year_month(one, raw, value, flipped):
    out = one(dates.year_month, raw)
    assert (out["value"], out["flipped"]) == (value, flipped)


def test_exclusive_choice_conflict(one):
    choices = [("校阀", ["校阀"]), ("换阀", ["换阀"])]
    out = one(lambda t: cf.exclusive_choice(t, choices), "☑校阀 ☑换阀")
    assert out["value"] == "" and out["warning"].startswith("瓶阀检验冲突")
    assert one(lambda t: cf.exclusive_choice(t, choices), "口校阀 换阀")["value"] == "换阀"


@pytest.mark.parametrize("raw, expected", [("１２０ｏ", "1200"), ("l2。5kg", "12.5"), ("1.2.3", "1.2"), ("无", None)])
def test_clean_number(one, raw, expected):
    assert one(lambda t: numbers.clean_number(tx.fold_width(t)), raw) == expected


def test_unicode_spaces(one):
    assert one(tx.squeeze, "　校准  证书　") == "校准 证书"
    assert one(tx.compact, "校　准  x") == "校准x"


@pytest.mark.parametrize("raw, expected", [
    ("Instrument name: 压力表", "压力表"), ("WRH-I:26030901F", "WRH-I:26030901F"), ("Model: Type: K9", "K9"), ("型号：X", "型号：X")])
def test_english_labels(one, raw, expected):
    assert one(tx.strip_english_label, raw) == expected


DOCUMENT = """原始记录
缆专检号：GL-2024-001
委托单位：上海某某有限公司
气瓶名称：低温冲击试验装置
型号/编号：WRH-I:26030901F
制造厂商：无锡仪器厂
收样日期：2024年3月5日
校准依据
1. GB/T 2951.14-2008
2. JB/T 4278.1-2011
其它校准信息 地点：3号楼 温度：20.5℃ 湿度：45%RH
一、一般检查
(1) 夹具能夹紧试样"""


def test_extract_fields(spark):
    out = fields.extract_fields(spark.createDataFrame([(1, DOCUMENT)], "doc_id int, text string")).first()
    assert (out.device_name, out.device_model, out.device_code) == ("低温冲击试验装置", "WRH-I", "26030901F")
    assert (out.manufacturer, out.certificate_no, out.unit_name) == ("无锡仪器厂", "GL-2024-001", "上海某某有限公司")
    assert (out.temperature, out.humidity, out.basis_mode) == ("20.5", "45", "校准")
    assert out.basis_standard_items == ["GB/T 2951.14-2008", "JB/T 4278.1-2011"]
    assert (out.release_date, out.source_profile) == ("2024年03月06日", "template_form_word")


def test_split_and_extract_fills_from_the_whole_text(spark):
    text = "缆专检号：A-1\n设备名称: 甲表\n型号: K9-AA\n设备名称: 乙表\n型号: K7-BB"
    out = fields.split_and_extract(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("record_no").collect()
    assert [r.device_name for r in out] == ["甲表", "乙表"]
    assert {r.certificate_no for r in out} == {"A-1"}


def test_group_summary_round_trip(one):
    summary = "1. 甲 | K9 | -\n2. 乙 | - | N7"
    back = one(lambda t: extract.parse_group_summary(F.col(t)), summary)
    assert [tuple(r) for r in back] == [("甲", "K9", ""), ("乙", "", "N7")]


def test_all_blocks(one):
    text = "a\n开始 1\nb\n结束\nc\n开始 2\nd"
    assert one(lambda t: extract.all_blocks(tx.split_lines(t), ["开始"], ["结束"]), text) == "开始 1\nb\n开始 2\nd"


def test_key_values_lists_and_rows(one):
    assert [tuple(r) for r in one(extract.key_value_rows, "a: 1\nb：2")] == [("a", "1"), ("b", "2")]
    assert one(extract.key_value_rows, "a: 1\nb") is None
    assert one(extract.list_items, "1. x\nGB/T 1-2000") == ["x", "GB/T 1-2000"]
    rows = one(extract.measurement_rows, "气瓶名称\t型号\n天平\tT1\tN1\t0~9")
    assert [(r["name"], r["code"], r["measurement_range"]) for r in rows] == [("天平", "N1", "0~9")]


def test_hammer_rows(one):
    text = "实际值(g) " + " ".join(map(str, range(12))) + "\n实际值(g) 1 2"
    out = one(lambda t: extract.hammer_rows(tx.squeezed_lines(t), [F.lit(""), F.lit("7,8")]), text)
    assert out == [[str(n) for n in range(2, 12)], ["7", "8"]]


def test_neighbor_cell(spark):
    frame = spark.createDataFrame([([["设备名称", "Instrument name", "天平"], ["型号", ""], ["K9", "x"]],)], "t array<array<string>>")
    out = frame.select(extract.neighbor_cell(F.col("t"), ["设备名称"]).alias("a"), extract.neighbor_cell(F.col("t"), ["型号"]).alias("b")).first()
    assert (out.a, out.b) == ("天平", "K9")


def test_context_aliases_never_overwrite(spark):
    frame = spark.createDataFrame([("own", "other", "b"), (" ", "other", "b")], "device_name string, `设备名称` string, name string")
    assert [r.device_name for r in sheets.resolve_aliases(frame).collect()] == ["own", "other"]
    value = sheets.aliased_value(F.create_map(F.lit("b"), F.lit(" ")), F.create_map(F.lit("a"), F.lit("task")), "b", {"a": ["b"]})
    assert frame.select(value.alias("v")).first().v == "task"


def test_unique_fill_never_invents(spark):
    rows = spark.createDataFrame(
        [("f", "s", 1, "A", "M", "C1", "X"), ("f", "s", 2, None, "M", "c-1", None), ("f", "s", 3, "A", "M", "C2", "Y"),
         ("f", "s", 4, "A", "M", None, None), ("g", "s", 1, None, None, "C1", None)],
        "file_id string, sheet string, row_idx int, device_name string, device_model string, device_code string, manufacturer string")
    out = {(r.file_id, r.row_idx): r for r in enrich.unique_lookup_fill(rows).collect()}
    assert (out["f", 2].device_name, out["f", 2].manufacturer) == ("A", "X")
    assert out["f", 4].manufacturer is None  # two makers share the name and model
    assert out["g", 1].device_name is None  # another file


def test_formula_and_rule_registries(spark):
    numbers.register_formula("upper", lambda f, cfg: {cfg["target_key"]: F.upper(f[cfg["source_key"]])})
    assert "upper" in numbers.FORMULAS
    del numbers.FORMULAS["upper"]
    cf.register_field_rule("upper", lambda v, rule, label: F.upper(v))
    try:
        assert spark.range(1).select(cf.apply_field_rule(F.lit("a"), FieldRule("upper")).alias("x")).first().x == "A"
    finally:
        del cf.FIELD_RULE_TYPES["upper"]


def test_sort_is_stable_in_both_directions(spark):
    frame = spark.createDataFrame([(1, "b"), (2, "A"), (3, "B"), (4, "a")], "pos int, v string")
    from certloom.operators import explore

    assert [r.pos for r in explore.sort_records(frame, "v", "pos").collect()] == [2, 4, 1, 3]
    assert [r.pos for r in explore.sort_records(frame, "v", "pos", descending=True).collect()] == [1, 3, 2, 4]
