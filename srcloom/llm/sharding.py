"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring of cells. A row hashes to a cell and belongs to the next point clockwise;
when that point's shard is full, the row goes on clockwise to the next shard with room. Loads are bounded exactly:
with n rows and k shards each shard takes n // k rows, and the first n % k shards one more.

Which rows overflow depends only on the number of rows in each cell, so the walk is done on those counts (as many as
the ring has cells, whatever the data), and rows find their shard by their place within the cell.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.common import unwrapped, wrapped


def ring(shards: int, points: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; a node ends its arc with its cell."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for point in range(points):
            cell = zlib.crc32(f"shard {shard} point {point}".encode()) % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], cells: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, from, to, shard, slot of the first row): rows numbered from..to-1 of a cell go to the shard.

    In each round every node takes what waits at it as far as its shard has room; the rest moves to the next node."""
    shards = max(s for _, s in nodes) + 1
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting[at % len(nodes)].append((cell, 0, counts[cell]))
    pieces = []
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for i, (_, shard) in enumerate(nodes):
            for cell, low, high in waiting[i]:
                if take := min(room[shard] - used[shard], high - low):
                    pieces.append((cell, low, low + take, shard, used[shard]))
                    used[shard] += take
                if low + take < high:
                    moved[(i + 1) % len(nodes)].append((cell, low + take, high))
        waiting = moved
    return pieces


def ring_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def shard_rows(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", points: int = 64, cells: int = 1 << 14,
    key_col: str | None = None,
) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within the shard).

    The ring position is a hash of id and text, so nulls are places like others and copies with their own ids, or ids
    with several texts, are spread. Rows equal in both share a cell; any of them may take any of their places. Shard
    counts differ by one at most. ``key_col`` names a column that holds the hash already, so that texts need not travel. Added columns replace input columns of the same name; an empty table stays empty.
    Only the counts of cells (at most ``cells`` rows) reach the driver; the pieces broadcast back are bounded by
    cells + points * shards squared."""
    if cells < shards * points:
        raise ValueError("the ring needs a cell for every point")
    spark = docs.sparkSession
    key = F.col(f"row.`{key_col}`") if key_col else ring_key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"))
    rows = wrapped(docs).withColumn("key", key).withColumn("cell", F.pmod("key", F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}
    pieces = walk(counts, ring(shards, points, cells), cells) if counts else []
    # one row per cell, so that the join cannot repeat rows
    by_cell: dict[int, list] = {}
    for cell, *piece in pieces:
        by_cell.setdefault(cell, []).append(tuple(piece))
    found = spark.createDataFrame(
        list(by_cell.items()), "cell int, pieces array<struct<low:bigint,high:bigint,shard:int,slot:bigint>>"
    )
    place = F.row_number().over(Window.partitionBy("cell").orderBy("key", f"row.`{id_col}`")).cast("bigint") - 1
    piece = F.filter("pieces", lambda p: (p["low"] <= F.col("place")) & (F.col("place") < p["high"]))[0]
    return unwrapped(
        rows.withColumn("place", place).join(F.broadcast(found), "cell").withColumn("piece", piece)
        .select("row", F.col("piece.shard").alias("shard"), (F.col("piece.slot") + F.col("place") - F.col("piece.low")).alias("slot")),
        ["shard", "slot"],
    )
