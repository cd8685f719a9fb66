"""Two tokenizers over the same texts: where their tokens end together, and which tokens stand for each other.

Tokens of both cover the bytes of " " + text. Byte places where tokens of both end cut a text into groups; tokens that
share a group are linked. The shorter list of ends drives a galloping search into the longer; the common places slice
the groups, and the differences of their ranks are the numbers of tokens that overlap.

A pair of ids is rated by the number of documents that link it. Documents travel as chunks: a chunk is written with the
distinct pairs of its documents, pairs are counted over all chunks, and each chunk gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, byte_texts, settle
from srcloom.llm.galloping import common

#: Pairs of ids (distinct within their documents) of a chunk; one document may exceed it.
CHUNK = 1 << 20
#: Links of a group beyond which they are counted by distinct ids instead of written out one by one.
WIDE = 1024
#: Characters that are tokenized and aligned at a time, so that batches of long texts stay small.
SLICE = 1 << 20
# Fixed value: the pattern of byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Tokenizer = tuple[Callable[[list[str]], list[np.ndarray]], list[bytes]]
_loaded: dict[str, Tokenizer] = {}


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Ranked:
    """The same ids from a faster library, which takes the vocabulary of the file as ranks.

    Both libraries merge the pair of lowest rank first. They cut words by tables of characters of their own, so every character is
    tried once, in several surroundings; texts with one that they take differently are left to the file's library."""

    def __init__(self, library, vocabulary: dict[bytes, int]):
        self.library = library
        self.fast = tiktoken.Encoding("ranked", pat_str=WORD_PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.agrees = np.zeros(0x110000, np.int8)  # 1: yes, 2: no
        self.agrees[:128] = [self.tried(chr(c)) for c in range(128)]

    def tried(self, c: str) -> int:
        probes = (f"a{c}a", f"1{c}1", f",{c},", f" {c} {c}", f"{c}{c} ", f"a{c} a", f"'{c}s")
        return 2 - all(self.fast.encode_ordinary(s) == self.library.encode(s, add_special_tokens=False).ids for s in probes)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.ids(f" {t}") for t in texts]

    def ids(self, text: str) -> list[int]:
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            for code in np.unique(codes[self.agrees[codes] == 0]).tolist():
                self.agrees[code] = self.tried(chr(code))
            if (self.agrees[codes] == 2).any():
                return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_level(path: str) -> Tokenizer:
    """Ids of each text with a blank before it, and the bytes of every id; strings of special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer as Library

    tokenizer = Library.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = byte_alphabet()
    of = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for name, i in tokenizer.get_vocab(with_added_tokens=False).items():
        of[i] = bytes(letters[c] for c in name)
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, cut = rules["model"], rules["pre_tokenizer"] or {}
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    # ids must be ranks: single bytes first, then what the merges make, in their order
    ranked = not rules["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    ranked = ranked and merged == list(range(256, 256 + len(merged))) and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
    whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
    encode = Ranked(tokenizer, {b: i for i, b in enumerate(of[: 256 + len(merged)])}) if ranked else whole
    return lambda texts: [np.array(ids, np.int64) for ids in encode(texts)], of


def pieces(path: str) -> Tokenizer:
    """Ids of each text, before which the model sets a blank itself, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace("▁", " ").encode()
        for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    ]
    return lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)], of


def load(path: str) -> Tokenizer:
    """The tokenizer of a file by its ending; once for each worker."""
    if path not in _loaded:
        _loaded[path] = (pieces if path.endswith(".model") else byte_level)(path)
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    """Number of ids, read on the driver to choose the type of pairs."""
    if path.endswith(".model"):
        return len(load(path)[1])
    with open(path, encoding="utf-8") as f:
        tokenizer = json.load(f)
    return max([*tokenizer["model"]["vocab"].values(), *(t["id"] for t in tokenizer["added_tokens"])]) + 1


class Side:
    """One tokenizer's ids with what is looked up by id."""

    def __init__(self, path: str, last: str):
        self.encode, self.bytes_of = load(path)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        # what a token writes into the groups' text: its id, and a comma unless it is the last of its side of the group
        self.written = np.array([f"{i}{mark}".encode() for i in range(len(self.bytes_of)) for mark in (",", last)], object)


class Aligned:
    """The tokens of many texts on one line of bytes, and their groups."""

    def __init__(self, a: Side, b: Side, texts: list[bytes]):
        one, two = (side.encode([t.decode() for t in texts]) for side in (a, b))
        self.good = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            whole = b" " + t
            self.good[i] = bool(t) and all(b"".join(map(side.bytes_of.__getitem__, ids.tolist())) == whole for side, ids in ((a, one[i]), (b, two[i])))
        none = np.empty(0, np.int64)
        one, two = ([ids if ok else none for ids, ok in zip(x, self.good, strict=True)] for x in (one, two))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (one, two))
        self.a, self.b = (np.concatenate([none, *ids]) for ids in (one, two))
        ends_a, ends_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])  # each text begins where the last ended
        # per text the side of fewer tokens drives the search; texts do not share an end
        doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        fewer = self.n_a <= self.n_b
        at_a, at_b = [], []
        for flag in (True, False):
            own_a, own_b = np.flatnonzero(fewer[doc_a] == flag), np.flatnonzero(fewer[doc_b] == flag)
            x, y = common(ends_a[own_a], ends_b[own_b])
            at_a.append(own_a[x])
            at_b.append(own_b[y])
        self.last_a, self.last_b = np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))  # last tokens of the groups
        self.wide_a = np.diff(self.last_a, prepend=-1)  # tokens of a group on either side
        self.wide_b = np.diff(self.last_b, prepend=-1)
        self.doc = doc_a[self.last_a]  # the text of each group
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        self.n_links = np.bincount(self.doc, weights=self.wide_a * self.wide_b, minlength=len(texts)).astype(np.int64)

    def digests(self, a: Side, b: Side) -> list[str]:
        """Hashes of the groups' texts ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
        group_a = np.repeat(np.arange(len(self.wide_a)), self.wide_a)
        group_b = np.repeat(np.arange(len(self.wide_b)), self.wide_b)
        is_last_a, is_last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        is_last_a[self.last_a] = is_last_b[self.last_b] = 1
        line = np.empty(len(self.a) + len(self.b), object)  # the tokens of a, then of b, group by group
        line[np.arange(len(self.a)) + (np.cumsum(self.wide_b) - self.wide_b)[group_a]] = a.written[2 * self.a + is_last_a]
        line[np.arange(len(self.b)) + np.cumsum(self.wide_a)[group_b]] = b.written[2 * self.b + is_last_b]
        line, ends = line.tolist(), np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(b"".join(line[e - n : e])[:-1]).hexdigest() if n else "" for e, n in zip(ends, self.n_a + self.n_b, strict=True)]

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) for each pair of ids linked in a text, in order; a pair is the first id times ``size_b``
        plus the second. Groups of many links are counted by their distinct ids."""
        many = self.wide_a * self.wide_b
        narrow = np.flatnonzero(many <= WIDE)
        each = np.repeat(narrow, many[narrow])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(many[narrow]) - many[narrow], many[narrow])
        first_a, first_b = (self.last_a - self.wide_a + 1)[each], (self.last_b - self.wide_b + 1)[each]
        x, y = inside // self.wide_b[each], inside % self.wide_b[each]
        texts, found = [self.doc[each]], [self.a[first_a + x] * size_b + self.b[first_b + y]]
        counts = [np.ones(len(each), np.int64)]
        for g in np.flatnonzero(many > WIDE):
            i, n = np.unique(self.a[self.last_a[g] - self.wide_a[g] + 1 : self.last_a[g] + 1], return_counts=True)
            j, m = np.unique(self.b[self.last_b[g] - self.wide_b[g] + 1 : self.last_b[g] + 1], return_counts=True)
            found.append((i[:, None] * size_b + j).ravel())
            counts.append((n[:, None] * m).ravel())
            texts.append(np.full(len(found[-1]), self.doc[g]))
        text, pair, n = (np.concatenate(v) for v in (texts, found, counts))
        order = np.lexsort((pair, text))
        text, pair, n = text[order], pair[order], n[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
        starts = np.flatnonzero(new)
        return text[starts], pair[starts], np.add.reduceat(n, starts) if len(starts) else n


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of some ``most`` bytes together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """For each row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_links`` are the pairs of token occurrences that share a group. A pair of ids counts the rows that hold it linked;
    ``count_sum`` adds these counts over the links, ``n_best`` counts links whose pair has the highest count of its
    first id, ties included. Null and empty texts, and texts whose tokens do not give back " " + text, have no tokens:
    zeros and ''. Ids may be null, repeated and of any type; every row is told apart. An empty table gives an empty one;
    other columns are not read. A text is tokenized whole; its tokens are in memory at once."""
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    size_b = vocabulary_size(path_b)
    small = vocabulary_size(path_a) * size_b < 1 << 31
    word, dtype = ("int", np.int32) if small else ("long", np.int64)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Side(path_a, "|"), Side(path_b, ";")
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            """The chunk's distinct pairs, each with the number of its rows that link it."""
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return batch_of(1, pairs=[pair.astype(dtype)], links=[n.astype(np.int32)])

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            shape = schema()
            return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()) if f.name == "chunk" else pa.array(columns.get(f.name, [None] * n), f.type) for f in shape], schema=shape)

        def schema() -> pa.Schema:
            counts = [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            item = pa.int32() if small else pa.int64()
            return pa.schema([("chunk", pa.int64()), ("doc_id", id_type), *counts, ("groups_sha256", pa.string()), ("pairs", pa.list_(item)), ("links", pa.list_(pa.int32()))])

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0), [t or b"" for t in byte_texts(batch)]
            for start, end in slices(texts):
                found = Aligned(a, b, texts[start:end])
                text, pair, n = found.pairs(size_b)
                cuts = np.searchsorted(text, np.arange(1, end - start))
                yield batch_of(
                    end - start, doc_id=ids.slice(start, end - start), n_a=found.n_a, n_b=found.n_b, n_groups=found.n_groups, n_links=found.n_links, groups_sha256=found.digests(a, b),
                    pairs=np.split(pair.astype(dtype), cuts), links=np.split(n.astype(np.int32), cuts),
                )
                held.append(pair)
                size += len(pair)
                if size >= chunk:
                    yield close()
                    number, held, size = number + 1, [], 0
        if size:
            yield close()

    shape = f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{word}>, links array<int>"
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokens, shape), "tokens")
    documents = rows.where(F.col("groups_sha256").isNotNull())
    of_chunks = rows.where(F.col("groups_sha256").isNull()).select("chunk", F.inline(F.arrays_zip("pairs", "links"))).withColumnsRenamed({"pairs": "pair", "links": "n"})
    counts = settle(of_chunks.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    first = lambda c: F.floor(F.col(c) / size_b).cast("int")
    # one row for each id of the first vocabulary, so its size is known
    best = counts.groupBy(first("pair").alias("a")).agg(F.max("n").alias("most"))
    rated = counts.withColumn("a", first("pair")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = of_chunks.select(F.col("chunk").alias("of"), "pair").join(rated, "pair").select("of", "pair", "n", "best")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a chunk with its pairs: bounded by the size of a chunk."""
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, n, is_best = pair[order], right.column("n").to_numpy()[order], right.column("best").to_numpy()[order]
        lists = left.column("pairs").combine_chunks()
        places = np.searchsorted(pair, lists.flatten().to_numpy())
        links = left.column("links").combine_chunks().flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(left.num_rows), np.diff(lists.offsets.to_numpy()))
        sums = [exact_sums(row, v, left.num_rows) for v in ((links * is_best[places], links * n[places]) if len(places) else (links, links))]
        columns = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table([columns[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    linked = documents.where("n_links > 0").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(rate, out)
    zero = F.lit(0).cast("bigint")
    alone = documents.where("n_links = 0").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256")
    return linked.unionByName(alone)


def exact_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by row; rows are in order."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.searchsorted(row, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]
