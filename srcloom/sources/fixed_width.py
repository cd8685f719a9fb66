"""Fixed-width records described by a copybook."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.text import ML, S, WORD, find_all


@dataclass(frozen=True)
class Field:
    name: str
    start: int  # 1-based
    width: int
    kind: str  # text, int or decimal
    scale: int = 0


# The employee record.
EMPLOYEE_RECORD = [
    Field("emp_id", 1, 6, "int"),
    Field("emp_name", 7, 30, "text"),
    Field("emp_dept", 37, 10, "text"),
    Field("emp_salary", 47, 9, "decimal", 2),
    Field("emp_hours", 56, 3, "int"),
    Field("emp_status", 59, 1, "text"),
]


def parse_records(records: DataFrame, layout: list[Field], line: str = "value") -> DataFrame:
    """Cut each record by the layout. A digit field that holds anything else, or
    a record that is too short, gives null instead of a failed job."""

    def cut(field: Field) -> Column:
        raw = F.substring(F.col(line), field.start, field.width)
        if field.kind == "text":
            return F.rtrim(raw).alias(field.name)
        digits = F.when(raw.rlike(f"^[0-9]{{{field.width}}}$"), raw)
        if field.kind == "int":
            return digits.cast("int" if field.width <= 9 else "long").alias(field.name)
        whole = F.left(digits, F.lit(field.width - field.scale))
        part = F.right(digits, F.lit(field.scale))
        return F.concat(whole, F.lit("."), part).cast(f"decimal({field.width},{field.scale})").alias(field.name)

    return records.select(*[cut(f) for f in layout])


def read_fixed_width(spark: SparkSession, path: str, layout: list[Field]) -> DataFrame:
    return parse_records(spark.read.text(path), layout)


def picture_width(picture: Column) -> Column:
    """Characters a picture takes: repeats in brackets, single signs, no V or S."""
    repeats = F.aggregate(
        find_all(picture, r"(?i)[X9A]\(([0-9]+)\)", 1), F.lit(0), lambda acc, n: acc + n.cast("int")
    )
    singles = F.length(
        F.regexp_replace(F.regexp_replace(picture, r"(?i)[X9A]\([0-9]+\)", ""), "(?i)[^X9A]", "")
    )
    return repeats + singles


def picture_scale(picture: Column) -> Column:
    """Digits right of the implied point."""
    right = F.regexp_extract(picture, r"(?i)V(.*)$", 1)
    return F.when(right == "", 0).otherwise(picture_width(right))


def picture_type(picture: Column) -> Column:
    """Target type of a picture: f64 with a point, i32 or i64 by digits, else String."""
    upper = F.upper(picture)
    digits = F.regexp_extract(upper, r"9\(([0-9]+)\)", 1)
    return (
        F.when(upper.contains("V") | upper.contains("."), "f64")
        .when(upper.rlike("^S?9"), F.when((digits != "") & (digits.cast("int") > 9), "i64").otherwise("i32"))
        .otherwise("String")
    )


#: A group item has no picture; level 01 and 77 start a record.
ANY_ITEM = rf"(?i){ML}^{S}*([0-9]{{2}}){S}+([{WORD}-]+)(?:{S}+PIC{S}+(S?[0-9XAV()]+))?"


def infer_layout(files: DataFrame) -> DataFrame:
    """Fields of every PIC clause of a file: record, level, name, type, width, scale and offset.

    Offsets run within a record: each 01 or 77 item starts a new one. Items are folded in the file's row."""
    def as_field(item: Column) -> Column:
        picture = F.regexp_extract(item, ANY_ITEM, 3)
        return F.struct(
            F.regexp_extract(item, ANY_ITEM, 1).cast("int").alias("level"),
            F.replace(F.lower(F.regexp_extract(item, ANY_ITEM, 2)), F.lit("-"), F.lit("_")).alias("name"), picture.alias("picture"),
            picture_type(picture).alias("type"), F.when(picture == "", 0).otherwise(picture_width(picture)).alias("width"), picture_scale(picture).alias("scale"),
        )

    items = files.select("path", F.transform(find_all(F.col("content"), ANY_ITEM), as_field).alias("items"))
    start = F.expr("named_struct('record', 0, 'next', 1, 'at', cast(array() as array<struct<record:int,start:int>>))")

    def step(acc: Column, item: Column) -> Column:
        opens = item["level"].isin(1, 77)
        record, at = acc["record"] + opens.cast("int"), F.when(opens, 1).otherwise(acc["next"])
        return F.struct(record.alias("record"), (at + item["width"]).alias("next"), F.concat(acc["at"], F.array(F.struct(record.alias("record"), at.alias("start")))).alias("at"))

    placed = items.withColumn("at", F.aggregate("items", start, step, lambda acc: acc["at"]))
    pairs = F.filter(F.arrays_zip("items", "at"), lambda p: p["items"]["picture"] != "")
    rows = placed.select("path", F.posexplode_outer(pairs).alias("field_ord", "p")).where(F.col("p").isNotNull())
    return rows.select("path", "field_ord", "p.items.*", F.col("p.at.record").alias("record"), F.col("p.at.start").alias("start"))


def layout_fields(rows: list) -> list[Field]:
    """The layout of one record, from rows of ``infer_layout`` in order, for ``parse_records``."""
    kinds = {"f64": "decimal", "i32": "int", "i64": "int", "String": "text"}
    return [Field(r["name"], r["start"], r["width"], kinds[r["type"]] if r["scale"] or r["type"] != "f64" else "int", r["scale"]) for r in rows]
