"""Copybooks with groups, repeats, redefinitions and signs."""

from srcloom.sources import copybooks as CB

TEXT = """      * 05 NOT-HERE PIC 9.
       01 A.
          05 B.
             10 C PIC X(3).
             10 D OCCURS 2 TIMES.
                15 E PIC S99.
                15 F PIC 9V9 OCCURS 2.
          05 G PIC S9(4) COMP-3 VALUE 0.30.
          05 H REDEFINES B PIC X(2).
          05 FILLER PIC X.
          05 I PIC S9(3) SIGN TRAILING SEPARATE.
          88 J VALUE 'x. 05 K PIC 9.'.
       77 L PIC 99.
"""


def read(spark, lines, text=TEXT, record=1):
    files = spark.createDataFrame([("a.cpy", text), ("none.cpy", "no items"), ("null.cpy", None)], "path string, content string")
    records = spark.createDataFrame([(i, "a.cpy", record, v) for i, v in enumerate(lines)], "i int, path string, record int, value string")
    rows = CB.cut_records(records, CB.record_layouts(CB.layout_tree(files))).orderBy("i").collect()
    return [None if r.fields is None else {f["name"].split(".")[-1] + f["index"]: f["value"] for f in r.fields} for r in rows]


def test_groups_take_the_span_of_their_members(spark):
    files = spark.createDataFrame([("a.cpy", TEXT), ("null.cpy", None)], "path string, content string")
    got = [(r.record, r.qualified, r.start, r.width, r.times) for r in CB.layout_tree(files).orderBy("item_ord").collect()]
    assert got == [
        (1, "a", 1, 23, 1), (1, "a.b", 1, 15, 1), (1, "a.b.c", 1, 3, 1), (1, "a.b.d", 4, 12, 2), (1, "a.b.d.e", 4, 2, 1), (1, "a.b.d.f", 6, 4, 2),
        (1, "a.g", 16, 3, 1), (1, "a.h", 1, 2, 1), (1, "a.filler", 19, 1, 1), (1, "a.i", 20, 4, 1), (2, "l", 1, 2, 1),
    ]


def test_fields_of_every_repeat_with_signs(spark):
    one, bad, short, none = read(spark, ["abc" + "1K" + "1234" + "0}" + "5678" + "???" + "-" + "012-", "abc" + "x1" + "12  " + "1p" + "0000" + "???" + "-" + "0123", "ab", None])
    assert one == {"c": "abc", "e1": "-12", "f1,1": "1.2", "f1,2": "3.4", "e2": "0", "f2,1": "5.6", "f2,2": "7.8", "g": None, "h": "ab", "i": "-12"}
    assert (bad["e1"], bad["f1,1"], bad["f1,2"], bad["e2"], bad["i"]) == (None, "1.2", None, "-10", None)
    assert short["c"] == "ab" and short["h"] == "ab" and short["e1"] is None and set(none.values()) == {None}
    assert read(spark, ["07"], record=2) == [{"l": "07".lstrip("0")}] and read(spark, ["x"], record=9) == [None]
