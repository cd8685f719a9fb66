"""Benchmark decontamination by Wu-Manber search for word windows.

A window is ``window`` consecutive words of an item; a shorter item is one window. Windows of one length share a
search table: the block of the last words under the search position tells how far no window can end (shift table);
where the shift is 0, the bucket of that block holds the windows that end with it, and they are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, by_name, by_place, byte_texts, settle

WINDOW = 10
#: Digits, letters and all that is not ASCII make words; A-Z are lower-cased.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Search:
    """Shift and bucket tables of windows of one length; ``items`` are numbers of the benchmark items."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[int]]):
        self.length = len(next(iter(windows)))
        self.block = min(2, self.length)
        self.longest = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[int]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                part = window[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.longest), self.length - end)
            self.bucket[window[-self.block :]][window] = items

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of each occurrence."""
        shift, block, length, longest = self.shift, self.block, self.length, self.longest
        end, n = length, len(words)
        while end <= n:
            step = shift.get(tuple(words[end - block : end]), longest)
            if step:
                end += step
                continue
            part = tuple(words[end - length : end])
            if items := self.bucket[part[-block:]].get(part):
                yield end - length, items
            end += 1


def searches(items: list[tuple[int, bytes | None]], window: int) -> list[Search]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            by_length[size][tuple(words[start : start + size])].add(item)
    return [Search(dict(w)) for w in by_length.values()]


def scan(words: list[bytes], tables: list[Search]) -> tuple[list[list[int]], set[int]]:
    """Runs [start, end) of hit words, merged and in order, and the items found."""
    spans, items = [], set()
    for table in tables:
        for start, found in table.find(words):
            spans.append((start, start + table.length))
            items |= found
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs, items


def benchmark_blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """The items in blocks of about ``most_bytes`` of text, and whether another follows; one block is held at a time.

    Null items have no words; rows of one id are all searched and count as one item."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    turn = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r[0], bytes(r[1])) for r in items.where(turn == k).toLocalIterator()], k + 1 < n


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None, block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per row of ``docs``: its columns ``keep`` (else the id as doc_id), n_words, runs of hit words and item ids.

    The benchmark is the query set: it is searched in blocks of bounded size, each broadcast as search tables and read
    against all documents; what a block finds is written before the next is read. Null and empty texts have no words and
    are never hit; ids may be null or repeated, item ids are whole numbers; an empty benchmark hits nothing. Kept columns
    named n_words, runs or items give way to the results. Runs count words from 0, end exclusive."""
    columns = ["doc_id"] if keep is None else keep
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) if keep is None else docs
    text_col = "text" if keep is None else text_col
    return by_name(_searched(docs, columns, text_col, benchmark, window, block_bytes), columns, ("n_words", "runs", "items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows without a passage of the benchmark, with all their columns as they are, whatever their names.

    Each row is judged by its text alone: ids may be null or repeated, equal texts stay or go together, texts without
    words stay."""
    return by_name(_searched(docs, docs.columns, text_col, benchmark, window, block_bytes).where(F.size("runs") == 0), docs.columns)


def _searched(docs: DataFrame, own: list[str], text_col: str, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """The columns by their places, n_words, runs and items."""
    spark = docs.sparkSession
    arrow_batches(spark)
    text = f"c{own.index(text_col)}" if text_col in own else "text"
    docs = by_place(docs, own, **({} if text_col in own else {"text": F.col(f"`{text_col}`")}))
    columns = docs.columns
    out = docs.withColumns(
        {"n_words": F.lit(0).cast("bigint"), "runs": F.expr("cast(array() as array<array<int>>)"), "items": F.expr("cast(array() as array<bigint>)")}
    )
    for block, more in benchmark_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def read(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tables = searches(sent.value, window)
            for batch in batches:
                n_words, runs, items = [], [], []
                at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
                for t, old, had in zip(byte_texts(batch, text), batch.column(at["runs"]).to_pylist(), batch.column(at["items"]).to_pylist(), strict=True):
                    words = words_of(t)
                    new, found = scan(words, tables)
                    n_words.append(len(words))
                    runs.append(union(old, new) if old else new)
                    items.append(sorted(found | set(had)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(at[c]) for c in columns), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.int64()))],
                    [*columns, "n_words", "runs", "items"],
                )

        out = out.mapInArrow(read, out.schema)
        if more:
            out = settle(out, "searched")
    return out


def union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for start, end in sorted(map(tuple, [*a, *b])):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs
