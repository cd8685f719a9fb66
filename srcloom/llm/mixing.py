"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources, in the order of their names with null last, weigh 1, 2, 3 and again, and share the words of all documents.
A source gives at most ``most`` times its own words; what is above is shared by weight among the others until none is
above. A document's expected copies are its source's target over its source's words. Within a source the expected
copies are summed up in order, one random offset is added, and a document is taken once for each whole number that its
step of the sum passes.

Documents stand in order of size class, so the taken words come near the target. All documents of a source expect the
same number of copies, so the running sum is place times ratio. Places come from counts of small cells (source, size
class, hash), so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.common import WORD, numbered, settle, unwrapped, wrapped

WEIGHTS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """The number of binary digits and the four digits after the first: classes are within 1/16 of each other."""
    bits = F.length(F.bin(size))
    return (bits * 32 + F.expr("shiftright(size_, greatest(length(bin(size_)) - 5, 0))")).cast("int")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Capped sources keep their cap and the rest is shared anew until no source is above; each round is one aggregate,
    and only its three sums reach the driver. Without words all targets are 0."""
    weighted = settle(
        numbered(sources, "ordinal", F.col("source").isNull(), F.col("source")).select(
            "source", "source_size", (F.pmod(F.col("ordinal") - 1, F.lit(WEIGHTS)) + 1).alias("weight")
        ),
        "weights",
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    share, above = 0, 0  # the open share and open weight; sources above their share by these are capped
    taken = None
    while True:
        is_capped = F.lit(False) if taken is None else cap * F.lit(above) < F.col("weight") * F.lit(share)
        capped, weight, n = weighted.agg(
            F.coalesce(F.sum(F.when(is_capped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0)), F.count_if(is_capped)
        ).first()
        if n == taken or not weight:
            break
        share, above, taken = total - capped, weight, n
    open_share = F.col("weight") * F.lit(float(share)) / F.lit(float(above or 1))
    return weighted.select(
        "source", "source_size", F.when(is_capped, cap.cast("double")).otherwise(open_share).alias("target")
    )


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None,
    most: int = 3, seed: str = "mix",
) -> DataFrame:
    """All rows with size, source_size, target, copies and taken (copies times size).

    Null texts have size 0, a null source is a source and comes last, null ids are places like others. Repeated rows
    count each; of rows equal in id and size any may take the place of another. Empty documents are taken like others
    of their source and add no words. Sources without words have target 0 and are not taken. Added columns replace
    input columns of the same name; an empty table gives an empty one. The same input and seed give the same rows."""
    size = F.col(f"row.`{size_col}`").cast("bigint") if size_col else word_count(F.col(f"row.`{text_col}`"))
    name = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("null"))
    rows = (
        wrapped(docs)
        .select("row", F.col(f"row.`{source_col}`").alias("source_"), size.alias("size_"), F.md5(name).alias("hash_"))
        .withColumn("class_", size_class(F.col("size_")))
        .withColumn("cell_", F.substring("hash_", 1, 2))
    )
    cells = settle(
        rows.groupBy("source_", "class_", "cell_").agg(F.count("*").alias("n"), F.sum("size_").alias("words")), "cells"
    )
    sources = cells.groupBy(F.col("source_").alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(sources, most)
    # At most some 1,000 size classes times 256 cells stand in one window, whatever the source holds.
    before = Window.partitionBy("source_").orderBy("class_", "cell_").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source_", "class_", "cell_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    known = starts.join(goal, starts["source_"].eqNullSafe(goal["source"])).select(
        F.col("source_").alias("s"), F.col("class_").alias("c"), F.col("cell_").alias("h"), "start", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"), offset.alias("offset"),
    )
    place = F.row_number().over(Window.partitionBy("source_", "class_", "cell_").orderBy("hash_", F.col("size_"), f"row.`{id_col}`"))
    upto = lambda k: F.floor(k * F.col("ratio") + F.col("offset"))
    joined = (
        rows.withColumn("place", place)
        .join(known, F.col("source_").eqNullSafe(F.col("s")) & (F.col("class_") == F.col("c")) & (F.col("cell_") == F.col("h")))
        .withColumn("k", (F.col("start") + F.col("place")).cast("double"))
        .withColumn("copies", (upto(F.col("k")) - upto(F.col("k") - 1)).cast("bigint"))
    )
    return unwrapped(
        joined.select("row", F.col("size_").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("size_")).alias("taken")),
        ["size", "source_size", "target", "copies", "taken"],
    )


def emit(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of the input."""
    columns = docs.columns
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"),
        word_count(F.col(text_col)).alias("words"),
    )
    taken = mix(named, size_col="words", **options).where("copies > 0")
    each = taken.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return each.select(*[F.col("doc").getField(c).alias(c) for c in columns])
