"""Extraction of product lines from garden and workshop orders."""

from stratalex.operators.lines import collect_descriptions, documents_with_lines, extract_lines

ALIGNED = """
FERNHOLLOW NURSERY
Proforma 88-17

Part no      Description                      Quantity
TR-40        Folding hand trowel              12
HOSE/25      Reinforced garden hose 25m       3
KN_7         Pruning knife with sheath        6
2 x Spare blade for pruning knife
Total                                         23
Ladder under the total                        1
"""
WITH_SERIALS = """
Delivery of the ninth of May
Part nr      Description                      Serial no   Qty
BK-210       Mountain bicycle frame           N/A         2  8714.91
BK-211       Carbon seat post                 N/A         4  ditto
BK-212       Rubber handlebar grips           N/A         9  "
LT100-5      Front lamp with dynamo           N/A         3  8512.10
"""
NO_HEADER = """
    Delivered by road
    BK-210 Mountain bicycle frame NA 2
    BK-211 Carbon seat post NA 4 "
    BK-212 Rubber handlebar grips NA 9 "
"""


def items(spark, **texts):
    docs = spark.createDataFrame(list(texts.items()), "source_file string, text string")
    got = extract_lines(docs).orderBy("source_file", "pos").collect()
    return {k: [r for r in got if r.source_file == k] for k in texts}


def test_texts(spark):
    got = items(
        spark,
        aligned=ALIGNED,
        serials=WITH_SERIALS,
        bare=NO_HEADER,
        free="SPADE-3 Digging spade with ash handle 7\n5 x Bag of bark mulch 40L\nHOE/9 Draw hoe 2\nHOE/9 Draw hoe 2\nThanks for your custom",
        ends="Description\nClay pot\n\n\nPot that comes too late",
        nothing="",
    )
    r = got["aligned"]
    assert [(x.part_number, x.description, x.quantity) for x in r] == [("TR-40", "Folding hand trowel", 12), ("HOSE/25", "Reinforced garden hose 25m", 3), ("KN_7", "Pruning knife with sheath", 6), (None, "Spare blade for pruning knife", 2)]
    r = got["serials"]
    assert [x.description for x in r] == ["Mountain bicycle frame", "Carbon seat post", "Rubber handlebar grips", "Front lamp with dynamo"]
    assert [x.noted_code for x in r] == ["8714.91.00"] * 3 + ["8512.10.00"]
    assert [x.same_as_above for x in r] == [False, True, True, False] and [x.quantity for x in r] == [2, 4, 9, 3]
    r = got["bare"]
    assert [x.description for x in r] == ["Mountain bicycle frame", "Carbon seat post", "Rubber handlebar grips"]
    assert [(x.same_as_above, x.noted_code) for x in r] == [(False, None), (True, None), (True, None)]
    r = got["free"]
    assert [(x.part_number, x.description, x.quantity) for x in r] == [("SPADE-3", "Digging spade with ash handle", 7), (None, "Bag of bark mulch 40L", 5), ("HOE/9", "Draw hoe", 2)]
    assert [x.description for x in got["ends"]] == ["Clay pot"]
    assert got["nothing"] == []


def test_descriptions(spark):
    plain = "\n  Garden hose reel\n    Watering can, zinc\n  Hose reel\n 2) Seed tray with lid\n"
    headed = "\n  Old stock: broken rake\n  Part no      Description                      Qty\n  RK-1         Leaf rake                        4\n  WB-9         Wheelbarrow tyre                 2\n  Total                                         6\n"
    bare = "\n  Shelf four holds the twine\n  Description\n  Jute twine\n  Bamboo canes\n"
    docs = spark.createDataFrame([("p", plain), ("h", headed), ("b", bare)], "source_file string, text string")
    got = {r.source_file: r.descriptions for r in collect_descriptions(docs).collect()}
    assert got["p"] == ["Garden hose reel", "Watering can, zinc", "Seed tray with lid"]
    assert got["h"] == ["Leaf rake", "Wheelbarrow tyre"]
    assert got["b"] == ["Jute twine", "Bamboo canes"]


def test_tables(spark):
    table = [["Part no", "Part description", "Qty", "Note"], ["RK-1", "Leaf rake", "4", "8201.30"], ["", None, "", ""], ["tin", "Rake handle", "1,500", '"'], ["RK-1", "Leaf rake", "4", "8201.30"]]
    plain = [["Description", "Quantity"], ["Total due", "4"], ["Wheelbarrow", "2"]]
    late = [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"], ["i", "j"], ["Description", "Quantity"], ["Never read", "2"]]
    docs = spark.createDataFrame([("a", "9 x never read", [table]), ("b", "2 x Jute twine", [[["x"]]]), ("c", "", [plain, late])], "source_file string, text string, tables array<array<array<string>>>")
    got = extract_lines(docs).orderBy("source_file", "pos").collect()
    assert [(r.source_file, r.part_number, r.description, r.quantity, r.noted_code, r.same_as_above) for r in got] == [
        ("a", "RK-1", "Leaf rake", 4.0, "8201.30.00", False),
        ("a", None, "Rake handle", 1500.0, "8201.30.00", True),
        ("b", None, "Jute twine", 2.0, None, False),
        ("c", None, "Wheelbarrow", 2.0, None, False),
    ]


def test_documents_with_lines(spark, monkeypatch):
    """The same documents as those of the lines, without a line being placed, filled or told from its repeats."""
    from stratalex.operators import lines

    table = [["Part no", "Part description", "Qty"], ["RK-1", "Leaf rake", "4"]]
    texts = {"a": (ALIGNED, []), "s": (WITH_SERIALS, []), "n": (NO_HEADER, []), "t": ("nothing here", [table]), "f": ("2 x Jute twine\n2 x Jute twine", []), "none": ("nothing here", []), "empty": ("", []), "null": (None, None), "heads": ("Description  Qty", [[["Description", "Quantity"]]])}
    docs = spark.createDataFrame([(k, *v) for k, v in texts.items()], "path string, text string, tables array<array<array<string>>>")
    want = {r.source_file for r in extract_lines(docs, "path").collect()}
    monkeypatch.setattr(lines, "materialise", None)
    got = [r.path for r in documents_with_lines(docs, "path").collect()]
    assert sorted(got) == sorted(want) and want == {"a", "s", "n", "t", "f"}
