"""Schedule parsing and the code hierarchy."""

import random

from pyspark.sql import functions as F

from stratalex.operators import hierarchy as h

SCHEDULE = """
                                  CHAPTER 1
LIVE ANIMALS
NOTES:
1. This chapter covers all live animals.
Heading / CD  Article description
01.01          Live horses, asses:
0101.2         - Horses:
0101.21      4 -- Pure-bred breeding ani-   u     free    free   free
               mals
0101.29      1 -- Other:                        kg    450c/kg
                                                      with a maximum of 96%
                                                      of 6%
Date: 2026-08-28
01.02          Live bovine animals
0102.10.10   7 - Cows  kg  1,8c/kg   20%
0102.10.90   5 - Other kg  10%
0102.90      3 - Other
12
  CHAPTER 2
MEAT
02.01        Meat of bovine animals    kg   40%   free
"""


def test_build(spark):
    src = spark.createDataFrame([("s", SCHEDULE)], "source_file string, text string")
    rows = h.parse_rows(src)
    tariff = h.build_tariff(rows).orderBy("id").collect()
    got = [(r.digits, r.check_digit, r.description, r.level, r.is_leaf, r.hs_code, r.duty_general) for r in tariff]
    assert got == [
        ("0101", None, "Live horses, asses:", 0, False, None, None),
        ("01012", None, "Horses:", 1, False, None, None),
        ("010121", "4", "Pure-bred breeding animals", 2, True, "0101.21.00", "Free"),
        ("010129", "1", "Other:", 2, True, "0101.29.00", "450c/kg with a maximum of 96%"),
        ("0102", None, "Live bovine animals", 0, False, None, None),
        ("01021010", "7", "Cows", 1, True, "0102.10.10", "1.8c/kg"),
        ("01021090", "5", "Other", 1, True, "0102.10.90", "10%"),
        ("010290", "3", "Other", 1, True, "0102.90.00", "Unknown"),
        ("0201", None, "Meat of bovine animals", 0, False, None, None),
    ]
    by = {r.digits: r for r in tariff}
    assert by["010121"].legal_path == "Live horses, asses | Horses | Pure-bred breeding animals" and by["010129"].legal_path == "Live horses, asses | Horses" and by["010129"].heading == "0101"
    assert by["01021010"].duty_eu_uk == "20%" and by["01021010"].statistical_unit == "kg"
    chapters = {r.chapter: (r.title, r.notes) for r in h.chapters(src).collect()}
    assert chapters == {"01": ("LIVE ANIMALS", "NOTES: 1. This chapter covers all live animals."), "02": ("MEAT", "")}
    counts = h.build_counts(h.build_tariff(rows), h.chapters(src)).first()
    assert (counts.nodes, counts.leaves, counts.chapters, counts.unknown_duty) == (9, 5, 2, 1)


def test_ancestors_like_a_stack(spark):
    rng, data, want = random.Random(5), [], {}
    for doc in range(40):
        stack = []
        for pos in range(rng.randint(1, 25)):
            d = "010" + rng.choice("12") + "".join(rng.choice("12") for _ in range(rng.choice([0, 0, 1, 2, 4])))
            while stack and not (d.startswith(stack[-1][1]) and len(d) > len(stack[-1][1])):
                stack.pop()
            want[doc, pos] = [p for p, _ in stack]
            stack.append((pos, d))
            data.append((doc, pos, d, "x"))
    rows = spark.createDataFrame(data, "source_file int, pos int, digits string, description string")
    got = h.ancestors(rows).groupBy("source_file", "pos").agg(F.sort_array(F.collect_list("a_pos")).alias("a")).collect()
    assert {(r.source_file, r.pos): r.a for r in got} == {k: v for k, v in want.items() if v}


def test_duty(spark):
    df = spark.createDataFrame([("free",), ("with a maximum of",), ("animals",), ("450c/kg or 6%",), ("",)], "t string")
    assert [r.x for r in df.coalesce(1).select(h.is_duty_fragment(F.col("t")).alias("x")).collect()] == [True, True, False, True, False]
    cut = df.limit(1).select(h.split_continuation(F.lit("     breeding animals      with a maximum of 96%")).alias("c")).first().c
    assert (cut.left, cut.right) == ("breeding animals", "with a maximum of 96%")


def test_only_lengths_that_occur_are_carried(spark, monkeypatch):
    """A stored table is not written again, and no value is carried for digits of a length that no row has."""
    from stratalex import storage
    from stratalex.operators import scan

    digits = "1234 123410 12341020 123490 12341030 1235 1235101010 123590".split()
    df = spark.createDataFrame([("d", k, d, d, "4", f"goods {k}", None, ["5%"]) for k, d in enumerate(digits)], "source_file string, pos long, raw_code string, digits string, check_digit string, description string, unit string, duties array<string>")
    written, carried, scans, run = [], [], scan.running, storage.materialise
    for module in (scan, h):
        monkeypatch.setattr(module, "materialise", lambda t, name: written.append(name) or run(t, name))
    monkeypatch.setattr(h, "running", lambda *a, **kw: carried.extend(kw.get("last") or {}) or scans(*a, **kw))
    got = {r.id: r for r in h.build_tariff(run(df, "rows")).collect()}
    assert carried == ["_h4", "_h6", "_h8"] and written == ["scan", "placed"]
    assert [got[k + 1].legal_path for k in range(8)] == ["goods 0", "goods 0 | goods 1", "goods 0 | goods 1 | goods 2", "goods 0 | goods 3", "goods 0 | goods 4", "goods 5", "goods 5 | goods 6", "goods 5 | goods 7"]
    assert [got[k + 1].is_leaf for k in range(8)] == [False, False, True, True, True, False, False, True]
    assert h.build_tariff(df.limit(0)).count() == 0
