"""Copybooks as level trees, and fixed-width records read by the layout of their own copybook.

A copybook's items are folded in its row with a stack: an item stays open until one of its level or a lower level number
comes, so a group takes the span of its members, OCCURS multiplies it, and REDEFINES goes back to where the named item
starts. A record meets its layout by an equality join, so records of many kinds are read in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.text import ML, S, WORD, find_all, let
from srcloom.sources.fixed_width import picture_scale, picture_width

#: An item up to its full stop; a point before a digit belongs to a number.
ITEM = rf"(?i){ML}^{S}*([0-9]{{2}}){S}+([{WORD}-]+)((?:[^.]|\.(?=[0-9]))*)\."
CLAUSES = {
    "picture": rf"(?i){S}PIC(?:TURE)?(?:{S}+IS)?{S}+(S?[0-9XAV()]+)",
    "times": rf"(?i){S}OCCURS{S}+(?:[0-9]+{S}+TO{S}+)?([0-9]+)",
    "redefines": rf"(?i){S}REDEFINES{S}+([{WORD}-]+)",
    "usage": rf"(?i){S}(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|PACKED-DECIMAL)(?![{WORD}-])",
    "sign": rf"(?i){S}(LEADING|TRAILING)(?![{WORD}])",
    "separate": rf"(?i){S}(SEPARATE)(?![{WORD}])",
}

# The characters of a last or first digit that carries a sign.
PLUS_DIGITS = "{ABCDEFGHI"
MINUS_DIGITS = "}JKLMNOPQR"
MINUS_DIGITS_ASCII = "pqrstuvwxy"

_PLACED = "at int, record int, level int, name string, path string, chain array<int>, start int, times int, picture string, kind string, scale int, sign string"
_OPEN = "at int, level int, path string, chain array<int>, start int, times int, back int"
_ACC = (
    f"named_struct('record', 0, 'next', 1, 'open', cast(array() as array<struct<{', '.join(p.replace(' ', ':', 1) for p in _OPEN.split(', '))}>>), "
    f"'placed', cast(array() as array<struct<{', '.join(p.replace(' ', ':', 1) for p in _PLACED.split(', '))}>>), 'ends', cast(array() as array<struct<at:int,width:int>>))"
)


def _lower(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def _item(text: Column) -> Column:
    """Clauses of one item; quoted values are left out of sight."""
    rest = F.regexp_replace(F.regexp_extract(text, ITEM, 3), r"'[^']*'|\"[^\"]*\"", "''")
    clause = lambda name: F.regexp_extract(rest, CLAUSES[name], 1)
    picture, times = F.upper(clause("picture")), clause("times")
    level = F.regexp_extract(text, ITEM, 1).cast("int")
    return F.struct(
        F.when(level == 77, 1).otherwise(level).alias("level"), _lower(F.regexp_extract(text, ITEM, 2)).alias("name"), picture.alias("picture"),
        F.when(times == "", 1).otherwise(times.cast("int")).alias("times"), _lower(clause("redefines")).alias("redefines"),
        F.upper(clause("usage")).alias("usage"), F.upper(clause("sign")).alias("sign"), (clause("separate") != "").alias("separate"),
    )


def _width(item: Column) -> Column:
    """Bytes of one item: packed digits are two to a byte, binary ones 2, 4 or 8 by their number."""
    digits = picture_width(item["picture"])
    plain = digits + (item["separate"] & item["picture"].startswith("S")).cast("int")
    packed = item["usage"].isin("COMP-3", "COMPUTATIONAL-3", "PACKED-DECIMAL")
    binary = F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8)
    used = F.when(packed, F.floor(digits / 2).cast("int") + 1).when(item["usage"].isin("COMP-1", "COMPUTATIONAL-1"), 4)
    used = used.when(item["usage"].isin("COMP-2", "COMPUTATIONAL-2"), 8).when(item["usage"] != "", binary).otherwise(plain)
    return F.when((item["picture"] == "") & ~item["usage"].isin("COMP-1", "COMP-2", "COMPUTATIONAL-1", "COMPUTATIONAL-2"), 0).otherwise(used)


def _kind(item: Column) -> Column:
    number = item["picture"].rlike("^S?9")
    return F.when((item["picture"] == "") & (item["usage"] == ""), "group").when(item["usage"] != "", "binary").when(number, "number").otherwise("text")


def _sign(item: Column) -> Column:
    side = F.when(item["sign"] == "LEADING", "leading").otherwise("trailing")
    return F.when(~item["picture"].startswith("S"), "").when(item["separate"], F.concat(side, F.lit(" separate"))).otherwise(side)


def _closed(acc: Column, level: Column, body: Callable[[Column], Column]) -> Column:
    """Close the open items from this level on, innermost first."""
    closing = F.reverse(F.filter(acc["open"], lambda o: o["level"] >= level))

    def close(a: Column, o: Column) -> Column:
        end = o["start"] + (a["next"] - o["start"]) * o["times"]
        ended = F.struct(o["at"].alias("at"), (end - o["start"]).alias("width"))
        return F.struct(F.greatest(end, o["back"]).alias("next"), F.concat(a["ends"], F.array(ended)).alias("ends"))

    start = F.struct(acc["next"].alias("next"), acc["ends"].alias("ends"))
    return let(F.aggregate(closing, start, close), body)


def _place(acc: Column, at: Column, item: Column) -> Column:
    """Open one item behind those that it closes."""
    opens_record = item["level"] == 1

    def placed(left: Column) -> Column:
        stay = F.filter(acc["open"], lambda o: o["level"] < item["level"])
        record = acc["record"] + opens_record.cast("int")
        same = F.filter(acc["placed"], lambda p: (p["record"] == record) & (p["name"] == item["redefines"]))
        back = F.when(opens_record, 1).otherwise(left["next"])
        start = F.when(item["redefines"] == "", back).otherwise(F.coalesce(F.try_element_at(same, F.lit(-1))["start"], back))
        above = F.try_element_at(stay, F.lit(-1))
        path = F.concat(F.coalesce(F.concat(above["path"], F.lit(".")), F.lit("")), item["name"])
        chain = F.concat(F.coalesce(above["chain"], F.array().cast("array<int>")), F.array(at))
        fields = {
            "at": at, "record": record, "level": item["level"], "name": item["name"], "path": path, "chain": chain, "start": start, "times": item["times"],
            "picture": item["picture"], "kind": _kind(item), "scale": picture_scale(item["picture"]), "sign": _sign(item),
        }
        opened = {"at": at, "level": item["level"], "path": path, "chain": chain, "start": start, "times": item["times"], "back": back}
        as_struct = lambda parts: F.struct(*[c.alias(n) for n, c in parts.items()])
        return F.struct(
            record.alias("record"), (start + _width(item)).alias("next"), F.concat(stay, F.array(as_struct(opened))).alias("open"),
            F.concat(acc["placed"], F.array(as_struct(fields))).alias("placed"), left["ends"].alias("ends"),
        )

    return _closed(acc, item["level"], placed)


def layout_tree(files: DataFrame) -> DataFrame:
    """Every item of every copybook (path, content): item_ord, record, level, name, qualified name, start, width, times and more.

    ``start`` counts from 1 within the record of a 01 or 77 item, for the first of repeated items; ``width`` holds all
    repeats. Levels 66 and 88 take no room and are left out, as are comments (a star in the seventh column); a file without
    items gives no row, nor does a null. Items that redefine an unknown name go on where they stand."""
    code = F.regexp_replace(F.col("content"), rf"{ML}^.{{6}}\*.*$", "")
    items = F.filter(F.transform(find_all(code, ITEM), _item), lambda i: ~i["level"].isin(66, 88))
    folded = files.select("path", items.alias("items")).where(F.size("items") > 0)
    numbered = F.transform("items", lambda item, i: F.struct(i.alias("at"), item.alias("item")))

    def finish(acc: Column) -> Column:
        ends = _closed(acc, F.lit(0), lambda left: F.array_sort(left["ends"]))
        return F.zip_with(acc["placed"], ends, lambda p, e: F.struct(p.alias("p"), e["width"].alias("width")))

    folded = folded.select("path", F.aggregate(numbered, F.expr(_ACC), lambda acc, n: _place(acc, n["at"], n["item"]), finish).alias("fields"))
    return folded.select("path", F.posexplode("fields").alias("item_ord", "f")).select(
        "path", "item_ord", "f.p.record", "f.p.level", "f.p.name", F.col("f.p.path").alias("qualified"), "f.p.kind", "f.p.picture", "f.p.scale", "f.p.sign",
        "f.p.times", "f.p.start", "f.width", "f.p.chain",
    )


def record_layouts(tree: DataFrame) -> DataFrame:
    """One row per copybook and record: its elementary fields, each repeat of a repeated one with its index (``2``, or ``2,1``
    inside a repeated group); fillers are left out. A copybook is one value of one row already, so its items meet in one."""
    item = F.struct("item_ord", "name", "qualified", "kind", "scale", "sign", "times", "start", "width", "chain")
    records = tree.groupBy("path", "record").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def repeats(f: Column) -> Column:
        over = F.filter(F.col("items"), lambda a: F.array_contains(f["chain"], a["item_ord"]) & (a["times"] > 1))
        first = F.expr("array(named_struct('shift', 0, 'index', ''))")

        def spread(acc: Column, a: Column) -> Column:
            step = (a["width"] / a["times"]).cast("int")
            comma = lambda o: F.when(o["index"] == "", "").otherwise(F.concat(o["index"], F.lit(",")))
            return F.flatten(F.transform(acc, lambda o: F.transform(
                F.sequence(F.lit(1), a["times"]), lambda k: F.struct((o["shift"] + (k - 1) * step).alias("shift"), F.concat(comma(o), k.cast("string")).alias("index"))
            )))

        return F.transform(F.aggregate(over, first, spread), lambda o: F.struct(
            f["qualified"].alias("name"), o["index"].alias("index"), f["kind"].alias("kind"), f["scale"].alias("scale"), f["sign"].alias("sign"),
            (f["start"] + o["shift"]).alias("start"), (f["width"] / f["times"]).cast("int").alias("width"),
        ))

    leaves = F.filter("items", lambda f: (f["kind"] != "group") & (f["name"] != "filler"))
    return records.select("path", "record", F.flatten(F.transform(leaves, repeats)).alias("fields"))


def _number(raw: Column, field: Column) -> Column:
    """A number in plain digits with a point and a minus, or null where the characters are no number."""
    signed = field["sign"]
    last = F.when(signed.startswith("leading"), F.left(raw, F.lit(1))).otherwise(F.right(raw, F.lit(1)))
    others = F.when(signed.startswith("leading"), F.substring(raw, F.lit(2), F.length(raw))).otherwise(F.left(raw, F.length(raw) - 1))
    digit = F.translate(last, PLUS_DIGITS + MINUS_DIGITS + MINUS_DIGITS_ASCII, "0123456789" * 3)
    joined = F.when(signed.endswith("separate"), others).when(signed == "leading", F.concat(digit, others)).when(signed == "trailing", F.concat(others, digit)).otherwise(raw)
    minus = F.when(signed.endswith("separate"), last == "-").when(signed != "", last.rlike(f"^[{MINUS_DIGITS.replace('}', chr(92) + '}')}{MINUS_DIGITS_ASCII}]$")).otherwise(False)
    good = joined.rlike("^[0-9]+$") & (F.length(raw) == field["width"]) & (~signed.endswith("separate") | last.isin("+", "-"))

    def text(digits: Column) -> Column:
        padded = F.lpad(digits, F.greatest(F.length(digits), field["scale"] + 1), F.lit("0"))
        whole = F.regexp_replace(F.left(padded, F.length(padded) - field["scale"]), "^0+(?=.)", "")
        shown = F.when(field["scale"] > 0, F.concat(whole, F.lit("."), F.right(padded, field["scale"]))).otherwise(whole)
        return F.when(minus & digits.rlike("[1-9]"), F.concat(F.lit("-"), shown)).otherwise(shown)

    return F.when(good, let(joined, text))


def cut_records(records: DataFrame, layouts: DataFrame, line: str = "value", copybook: str = "path", record: str = "record") -> DataFrame:
    """Each record with ``fields``: ``array<struct<name, index, value>>`` by the layout of its copybook and record number.

    Texts lose their trailing blanks, numbers are in plain digits. A field beyond the end of the line, digits that are none and
    binary or packed fields (which have no form in a text) are null; a record without a layout has null for its fields."""
    shapes = layouts.select(F.col("path").alias("__path"), F.col("record").alias("__record"), F.col("fields").alias("__fields"))
    joined = records.join(shapes, (F.col(copybook) == F.col("__path")) & (F.col(record) == F.col("__record")), "left")

    def read(f: Column) -> Column:
        raw = F.substring(F.col(line), f["start"], f["width"])
        value = F.when(F.length(F.col(line)) < f["start"], None).when(f["kind"] == "text", F.rtrim(raw)).when(f["kind"] == "number", _number(raw, f))
        return F.struct(f["name"].alias("name"), f["index"].alias("index"), value.alias("value"))

    return joined.withColumn("fields", F.transform("__fields", read)).drop("__path", "__record", "__fields")
