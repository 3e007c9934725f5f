"""Rules, search, checks of written codes, amendments and sinks over a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from stratalex.functions.rules import RULES, rule_columns, rule_id
from stratalex.operators.corpus import Corpus
from stratalex.operators.verify import amend
from stratalex.plans.classify import classify_lines, describe
from stratalex.schemas import LINE_ITEMS, TARIFF_LINES
from stratalex.sources import sinks

EXPECTED = {
    "Clear silicone sealant, cartridge": "3214.10.00",
    "Caulks for window frames": "3214.10.00",
    "Painters fillings for facades": "3214.90.00",
    "Copper slip in a pot": "3403.99.90",
    "Lithium grease, spray": "3403.99.10",
    "Petroleum lubricants": "3403.19.90",
    "Wood glue, 500 g": "3506.10.00",
    "Contact adhesives": "3506.10.00",
    "Epoxy adhesive, 20 kg": "3506.91.00",
    "Hide glue in a hobbock": "3506.99.00",
    "White portland cement": "2523.21.00",
    "Portland cement clinkers": "2523.10.00",
    "Slag cement": "2523.90.00",
    "Asphalt sealants for gutters": "2715.00.20",
    "Asphalt compounds": "2715.00.90",
    "Bearing seals, set of four": "8484.20.00",
    "Petrol additives": "3811.90.00",
    "Tectyl wax as an aerosol": "3403.19.10",
    "Corban for cables": "3403.99.90",
    "Green scouring pads": "6805.30.00",
    "Gear box oils": "3403.99.90",
    "Hydraulic oils": "3403.99.90",
    "Hydraulic oils, petroleum": "2710.19.80",
    "Crankcase oils": None,
    "Rust preventing primer": None,
    "Greaseproof baking sheets": None,
    "Garden chairs": None,
}


def row(n, code, description, duty="Free", path=None):
    d = code.replace(".", "")
    return (n, code, code, d, "1", d[:2], d[:4], description, path or description, path or description, "kg", duty, None, None, None, None, None, True, 1)


def node(n, digits, description):
    return (n, None, digits, digits, None, digits[:2], digits[:4], description, description, description, None, None, None, None, None, None, None, False, 0)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        node(1, "2710", "Petroleum oils:"),
        row(2, "2710.12.00", "Light spirit", "5%", "Petroleum oils | Light spirit"),
        row(3, "2710.19.30", "Oil for crankcases", "10%", "Petroleum oils | Oil for crankcases"),
        node(4, "3214", "Putty and mastics"),
        row(5, "3214.10.00", "Mastics in tubes", "Free", "Putty and mastics | Mastics in tubes"),
        row(6, "3214.90.00", "Other", "Free", "Putty and mastics"),
        row(7, "3506.10.00", "Glue put up for retail sale", "20%"),
        row(8, "7318.15.37", "With a hexagon head, stainless", "10%", "Screws and bolts | With a hexagon head, stainless"),
        row(9, "7318.15.90", "Other", "10%", "Screws and bolts"),
        row(10, "3403.99.90", "Other", "Free", "Lubricating greases"),
    ]
    return Corpus(spark.createDataFrame(rows, TARIFF_LINES), "2026-08-28")


def test_rules(spark):
    df = spark.createDataFrame([(d,) for d in EXPECTED], "d string").withColumn("rule", rule_id(F.col("d")))
    got = {r.d: (r.rule, r.rule_code) for r in df.withColumns(rule_columns(F.col("rule"), F.col("d"))).collect()}
    assert {d: code for d, (_, code) in got.items()} == EXPECTED
    assert got["Crankcase oils"][0] == "petroleum_oil_2710" and got["Garden chairs"][0] is None


def test_rule_order():
    assert [r.name for r in RULES] == "bituminous_mastic_2715 mechanical_seal_8484 oil_additive_3811 surface_coating_3403_19 surface_coating_3403_99 abrasive_6805 lubricant_3403 synthetic_gearbox_3403 mineral_hydraulic_2710 synthetic_hydraulic_3403 petroleum_oil_2710 hydraulic_cement_2523 mastic_3214 adhesive_3506".split()


def test_lines_and_sinks(spark, corpus, tmp_path):
    lines = [
        ("a", 0, "P1", "Clear silicone sealant", 10.0, "", None, "3214.90.00", False),
        ("a", 1, None, "Caulks for window frames", 1.0, "", None, "3214.90.00", True),
        ("a", 2, None, "Wood glue, 500 g", None, "", None, None, False),
        ("a", 3, None, "Clear silicone sealant", 2.0, "", None, "3214.10.00", False),
        ("a", 4, None, "Bearing grease", 1.0, "", None, "3304.99.90", False),
        ("b", 0, None, "hex bolts, stainless", 2.5, "", None, "9999.99.99", False),
        ("b", 1, None, "Crankcase oils", 4.0, "", None, None, False),
        ("b", 2, None, "Tin", None, "", None, None, False),
        ("b", 3, None, "12", None, "", None, None, False),
        ("b", 4, None, "umbrella", None, "", None, "3304.99.90", False),
    ]
    done = classify_lines(spark.createDataFrame(lines, LINE_ITEMS), corpus, headers=True).cache()
    got = {(r.source_file, r.line_number): r for r in done.collect()}
    assert len(got) == 10
    code = lambda s, n: (got[s, n].hs_code, got[s, n].flag)
    assert [code("a", n) for n in range(1, 6)] == [("3214.10.00", "incorrect"), ("3214.10.00", "incorrect"), ("3506.10.00", ""), ("3214.10.00", "ok"), ("3403.99.90", "critical")]
    assert [code("b", n) for n in range(1, 6)] == [("7318.15.37", "incorrect"), ("2710.19.30", ""), (None, ""), (None, ""), (None, "critical")]
    assert got["a", 2].handwritten_shown == '3214.90.00 "' and got["a", 2].flag_note == "Handwritten 3214.90.00 does not match 3214.10.00. The quote repeats the line above."
    assert got["b", 1].flag_note == "Handwritten 9999.99.99 is not a declarable code on this schedule."
    assert got["a", 4].recommended_label == "3214.10.00 · No change" and got["a", 1].header == "32.14 Putty and mastics"
    assert got["a", 1].wco_reasoning.startswith("Handwritten 3214.90.00 does not match 3214.10.00. Classified under the WCO Harmonized System as applied in SARS Schedule 1 Part 1 (28 August 2026). Mastics, sealants")
    assert "Written 3214.90.00 is another subheading of heading 32.14." in got["a", 1].explanation
    assert "3214.10.00 falls in heading 32.14: Putty and mastics. The schedule split reads: Mastics in tubes." in got["a", 1].explanation
    assert "Chapter 33 covers beauty" in got["a", 5].explanation
    assert got["a", 4].wco_reasoning.endswith("General duty: Free (SARS Schedule 1 Part 1, 28 August 2026).")
    assert "Subheading wording \"With a hexagon head, stainless\" is preferred" in got["b", 1].wco_reasoning or got["b", 1].flag == "incorrect"
    assert got["b", 2].score < 100 and got["b", 2].rule_id == "petroleum_oil_2710"
    assert got["b", 3].wco_reasoning.startswith("No declarable tariff line") and got["b", 4].wco_reasoning.startswith("No product description")
    # Sinks
    sinks.emit(done, str(tmp_path / "out.json"), "both")
    back = spark.read.option("header", "true").csv(str(tmp_path / "out.csv"))
    assert back.columns == list(sinks.PUBLIC_FIELDS) and back.count() == 10
    assert {r.quantity for r in back.collect()} == {"10", "1", "2", "2.5", "4", None}
    assert spark.read.json(str(tmp_path / "out.json")).count() == 10
    assert json.loads(sinks.json_array(sinks.public(done)))[0]["hs_code"]
    assert sinks.flagged(done).first().flagged == 5
    edits = spark.createDataFrame([("a", 1, "3214.90.00"), ("a", 3, "12345678"), ("b", 4, "12")], "source_file string, line_number int, code string")
    changed = {(r.source_file, r.line_number): r for r in amend(done, edits, corpus).collect()}
    assert changed["a", 1].amended and changed["a", 1].hs_code == "3214.90.00" and changed["a", 1].duty_rate_general == "Free"
    assert changed["a", 3].hs_code == "1234.56.78" and changed["a", 3].duty_rate_general == "20%"
    assert changed["b", 4].error == "Enter an 8-digit HS code for 12." and not changed["a", 2].amended
    notes = {r.line_number: r.note for r in sinks.report_rows(amend(done, edits, corpus).filter("source_file = 'a'"), 5).collect()}
    assert notes[1] == "Incorrect · Amended · Free" and notes[4] == "Correct · Free"
    token, record = sinks.seal(done.filter("source_file = 'a'"), "Ann", "x.pdf", ["Ann"])
    assert sinks.verify_seal(record, token).first().lines[4].flag == "critical" and sinks.verify_seal(record, "no").count() == 0
    with pytest.raises(ValueError):
        sinks.seal(done, "Bob", "x.pdf", ["Ann"])


def test_describe(spark, corpus):
    r = describe(spark, "  Crankcase   oils", corpus, quantity="1,000").first()
    assert (r.line_number, r.source_file, r.description, r.quantity, r.hs_code) == (1, "manual", "Crankcase oils", 1000.0, "2710.19.30")
