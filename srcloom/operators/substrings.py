"""Which texts contain which names, without comparing all with all.

A name of n characters stands in a text where a piece of n characters of the text equals it, so texts are listed by their
pieces of the lengths that names have, and pieces and names meet in one equality join. Only pieces are listed that begin as
a name of their length does: the beginnings are marked in a table of bits whose size does not hang on the input. So a text
has few pieces beyond those that are names. Names beyond ``WHOLE`` characters meet by their first ones and are compared in
full. Pieces that very many texts have are dealt over several tasks. All sides of the joins grow with the names and texts,
so they are merged: a side just small enough to be broadcast would be held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.operators.ordered import settle

#: Characters of a beginning.
GRAM = 3
#: Texts of one piece that one task takes at most, on average.
LIST = 100_000
#: Longest piece that is listed.
WHOLE = 64
#: Bits for the beginnings of names, and counters for the pieces of texts: what the driver holds at most.
BITS, COUNTERS = 1 << 20, 1 << 16


def _table(values: dict[int, int], size: int, default: int) -> Column:
    """Whole numbers by their place, as one constant."""
    return F.split(F.lit(",".join(str(values.get(i, default)) for i in range(size))), ",").cast("array<bigint>")


def _bit(beginning: Column, length: Column) -> Column:
    return F.pmod(F.xxhash64(beginning, length), F.lit(BITS))


def _counter(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(COUNTERS)).cast("int")


def _pieces(text: Column, lengths: list[int], marked: Column, size: int) -> Column:
    """The distinct pieces of ``text`` that are as long as a name and begin as a name of that length does."""
    def begins(i: Column, n: int, of: Column) -> Column:
        bit = _bit(F.substring(text, i, F.lit(n)), of)
        return F.getbit(F.get(marked, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1

    def starts(n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.filter(places, lambda i: begins(i, n, F.lit(0 if n == size else n)))

    def from_start(i: Column) -> Column:
        fitting = F.filter(F.array(*[F.lit(n) for n in lengths if n >= size]), lambda n: (n <= F.length(text) - i + 1) & begins(i, size, n))
        return F.transform(fitting, lambda n: F.substring(text, i, n))

    def short(n: int) -> Column:
        return F.transform(starts(n), lambda i: F.substring(text, i, F.lit(n)))

    some = [short(n) for n in lengths if n < size]
    if lengths[-1] >= size:
        some.append(F.flatten(F.transform(starts(size), from_start)))
    return F.array_distinct(F.concat(*some))


def contained(names: DataFrame, texts: DataFrame, name: str = "name", text: str = "text", size: int = GRAM, most: int = LIST) -> DataFrame:
    """(name, text) for each distinct name and each distinct text that contains it; nulls and empty names pair with nothing."""
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = names.select(F.col(name).alias("name")).where("name <> ''").distinct().withColumn("piece", F.left("name", F.lit(WHOLE)))
    # dealt by number: few bytes are much work here
    texts = texts.select(F.col(text).alias("text")).where("text <> ''").repartition(tasks, "text").distinct()
    beginning, length = F.left("name", F.least(F.length("name"), F.lit(size))), F.length("piece")
    # a name is marked with its length, and one that is not shorter than a beginning without it too
    bits = F.array_distinct(F.array(_bit(beginning, length), _bit(beginning, F.when(length >= size, 0).otherwise(length))))
    words = (
        names.select(length.alias("length"), F.explode(bits).alias("at"))
        .select("length", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"), F.collect_set("length").alias("lengths")).collect()
    )
    lengths = sorted({n for r in words for n in r["lengths"]})
    if not lengths:
        return names.select("name", F.lit("").alias("text")).where("false")
    marked = _table({r["word"]: r["bits"] for r in words}, BITS // 64, 0)
    # written, for the pieces are counted first
    listed = settle(texts.select("text", F.explode(_pieces(F.col("text"), lengths, marked, size)).alias("piece")))
    counts = listed.groupBy(_counter(F.col("piece")).alias("counter")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()
    if counts:
        hands = F.get(_table({r["counter"]: -(-r["n"] // most) for r in counts}, COUNTERS, 1), _counter(F.col("piece")))
        listed = listed.withColumn("hand", F.pmod(F.xxhash64("text"), hands))
        names = names.withColumn("hand", F.explode(F.sequence(F.lit(0).cast("bigint"), hands - 1)))
    keys = ["piece", "hand"] if counts else ["piece"]
    return names.join(listed.hint("merge"), keys).where(F.contains("text", "name")).select("name", "text")
