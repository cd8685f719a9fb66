"""Filter audit, tokenizer alignment and token counts against brute force and the tokenizers' own libraries."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from srcloom.llm import alignment as A
from srcloom.llm import audit as U
from srcloom.llm import galloping as G
from srcloom.llm import token_counts as K
from srcloom.llm.queries import QUERIES

BYTES, PIECES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [
    (1, None, None), (2, "", "s"), (3, "one two", "s"), (3, "one two", "s"), (None, "one two", None), (None, "one two", "t"), (4, "one two", ""), (5, "ONE # TWO", "t"),
    (6, "Word naïve 漢字 🙂 <|endoftext|> it's  we'll\t\n<s> " * 3000, "t"), (7, "  \x00  ​", "s"), (7, "x" * 5000, "s"), (8, "é é ﬁ İ Σς 'Re", "t"), (9, " lead and trail ", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    shape = "doc_id long, text string, source string, mask int, part string, id long, n_tokens int, chunk int, pairs int, links int, sizes int, step int"
    return spark.createDataFrame([(*r, 1, "p", 5, 1, 1, 1, 1, 1, 1) for r in ODD], shape).repartition(3)


def test_gallop_finds_every_place():
    rng = np.random.default_rng(5)
    for _ in range(300):
        hay, needles = (np.sort(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        start = rng.integers(-5, 50, len(needles))
        want = np.searchsorted(hay, needles)
        assert (G.gallop(needles, hay) == want).all() and (G.gallop(needles, hay, start) == want).all()
        one, two, three = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(3))
        assert G.difference(one, two).tolist() == sorted({*one.tolist()} - {*two.tolist()})
        assert G.union([one, two, three]).tolist() == sorted({*one.tolist(), *two.tolist(), *three.tolist()})
        x, y = G.common(one, two)
        assert one[x].tolist() == two[y].tolist() == sorted({*one.tolist()} & {*two.tolist()})


def plain_audit(rows, good, toxic, letters):
    """Every order run row by row."""
    out, parts = {}, sorted({r[1] or "" for r in rows})
    for part in parts:
        own = [(i, m) for i, p, m in rows if (p or "") == part]
        shapley = Counter()
        for order in itertools.permutations(letters):
            gone = 0
            for step, c in enumerate(order, 1):
                bit = 1 << letters.index(c)
                new = [i for i, m in own if m & bit and not m & gone]
                shapley[c] += len(new)
                gone |= bit
                out[part, "".join(order), step] = [
                    sum(not m & gone for _, m in own), len(new), sum(1 for _, m in own if m & bit and m & (gone & ~bit)), sum(m == bit for _, m in own),
                    sum(i in good for i in new), sum(i in toxic for i in new),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("block", [U.BLOCK, 5])
def test_audit_against_every_order(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", None]), rng.randrange(16)) for _ in range(200)] + [(7, "a", 3)] * 50
    marks = [(i, rng.choice([True, False, None]), rng.choice([True, False])) for i in [*range(0, 60, 2), None, 4, 8]]
    good, toxic = ({m[0] for m in marks if m[k] and m[0] is not None} for k in (1, 2))
    frame = spark.createDataFrame(rows, "id long, part string, mask int").repartition(3)
    got = U.audit(frame, spark.createDataFrame(marks, "id int, good boolean, toxic boolean"), "ABCD", block=block)
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == plain_audit(rows, good, toxic, "ABCD")


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_repeats_of_smaller_ids(spark, hot):
    rows = [(i, "p", 0, t.encode()) for i, t in [(5, "x"), (3, "x"), (3, "x"), (9, "y"), (None, "x"), (None, "z"), (1, "z")]] + [(i, "q", 1, b"hot") for i in range(20, 60)]
    got = Counter((r.id, r.mask) for r in U.with_repeats(spark.createDataFrame(rows, "id long, part string, mask int, digest binary"), hot=hot).collect())
    assert got == Counter([(5, 16), (3, 0), (3, 0), (9, 0), (None, 0), (None, 0), (1, 0), (20, 1), *((i, 17) for i in range(21, 60))])


def test_text_masks():
    assert [U.text_mask(t) for t in (b"", b"a b", b"A b", b"a | b", b"a " * 100)] == [1, 1, 5, 9, 2]
    words = " ".join(f"w{i}" for i in range(60)).encode()
    assert U.text_mask(words) == 0 and U.text_mask("É ".encode() + words) == 0
    assert U.words_of(b"a b\x0bc a\x1cd" * 9, piece=4) == (28, len({*(b"a b\x0bc a\x1cd" * 9).split()}))


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, 1), (99, 1, 1)], "doc_id int, quality int, toxic int")
    got = U.audit_texts(odd, labels).collect()
    least = {}
    for i, t, _ in ODD:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = [(i, p, U.text_mask((t or "").encode()) + 16 * (i is not None and i > least[t or ""])) for i, t, p in ODD]
    want = plain_audit(rows, {3}, {3, 6}, "ABCDE")
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert U.audit_texts(odd.limit(0), labels).collect() == [] and len(U.audit_texts(odd, labels.limit(0)).collect()) == 120 * 5 * 3


def plain_alignment(rows):
    """Token by token, from the libraries' own output."""
    one = Tokenizer.from_file(BYTES)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = A.byte_alphabet()
    names = {i: bytes(letters[c] for c in n) for n, i in one.get_vocab(with_added_tokens=False).items()}
    piece = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    all_links, kept = Counter(), []
    for _, text in rows:
        a, b = one.encode(f" {text}", add_special_tokens=False).ids if text else [], two.encode(text) if text else []
        bytes_a, bytes_b, whole = [names[i] for i in a], [piece(i) for i in b], f" {text}".encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            kept.append(None)
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        groups, x, y = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            i, j = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append((a[x:i], b[y:j]))
            x, y = i, j
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        all_links.update(links.keys())
        kept.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (p, _), n in all_links.items():
        best[p] = max(best[p], n)
    out = []
    for (i, _), found in zip(rows, kept, strict=True):
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        best_links = sum(n for pair, n in links.items() if all_links[pair] == best[pair[0]])
        out.append((i, n_a, n_b, len(groups), sum(links.values()), best_links, sum(n * all_links[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def aligned(frame):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


@pytest.mark.parametrize(("chunk", "wide"), [(A.CHUNK, A.WIDE), (40, 0)])
def test_alignment_of_odd_rows(spark, odd, monkeypatch, chunk, wide):
    """Small chunks and groups counted by distinct ids give the same."""
    monkeypatch.setattr(A, "WIDE", wide)
    assert aligned(A.align(odd, BYTES, PIECES, chunk=chunk)) == plain_alignment([(i, t) for i, t, _ in ODD])
    assert A.align(odd.limit(0), BYTES, PIECES).collect() == []
    none = A.align(odd.where("doc_id < 3"), BYTES, PIECES).collect()
    assert len(none) == 2 and all(r.n_a == r.n_links == r.count_sum == 0 and r.groups_sha256 == "" for r in none)


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    a, b = A.Side(BYTES, "|"), A.Side(PIECES, ";")
    texts = [("　" * 30 + "漢" * 20 + " a b").encode(), b"one two three"]
    narrow = A.Aligned(a, b, texts).pairs(32000)
    monkeypatch.setattr(A, "WIDE", 0)
    wide = A.Aligned(a, b, texts).pairs(32000)
    assert all((x == y).all() for x, y in zip(narrow, wide, strict=True))


def test_words_give_the_ids_of_whole_texts():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    encode, _ = A.byte_level(BYTES)
    rng = random.Random(7)
    pool = ["'s", "'Re", " ", "  ", "\n\n", "\t", "abc", "Ü", "12", "٣", "½", "漢字", "🙂", "<|endoftext|>", "!?", "\x1c", "　", "é", chr(0x558), chr(0xA7CE), "\x00"]
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert encode([text])[0].tolist() == library.encode(f" {text}", add_special_tokens=False).ids, repr(text)


def test_alignment_query_on_all_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(QUERIES["op12_alignment"](spark, sf_dir)) == plain_alignment(rows)


def test_splitter_in_chunks_of_any_size():
    rng = np.random.default_rng(3)
    classes = np.append(rng.integers(0, 10, 3000, dtype=np.int8), np.int8(K.SPACE))
    want = K.piece_begins(classes, 1).tolist()
    assert all(K.piece_begins(classes, n).tolist() == want for n in (2, 7, 64, 4096))


def test_token_counts_are_those_of_the_library():
    library, own = Tokenizer.from_file(WORDS), K.compiled(WORDS)
    rng = random.Random(11)
    pool = ["'s", "'t", "'re", "'VE", "'ll", "'l", "'r", "'", "''", " ", "\n", " ", "​", "\x1c", "ing", "the", "Straße", "ΣΑΣ", "İ", "ſ", "K", "12", "٣½", "漢字", "한글", "🙂👍🏽", "é", "ọ̈̂",
            "<|endoftext|>", "<|startoftext|>", "<|END", "!?.", "\x00", "x" * 70, chr(0x558), chr(0x1F9FF), chr(0xE000), "﻿"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeinorstu") for _ in range(rng.randrange(1, 80))) for _ in range(2000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(texts).tolist() == want


def test_transducer_forgets_and_counts_the_same(monkeypatch):
    texts = [" ".join("".join(random.Random(i * 50 + j).choices("etaoinshr", k=9)) for j in range(40)) for i in range(20)] + ["ab" * 3000]
    own = K.Compiled(WORDS)
    want = own.counts(texts).tolist()
    monkeypatch.setattr(K, "STATES", 50)
    assert K.Compiled(WORDS).counts(texts).tolist() == want


def test_long_texts_in_stretches():
    text = ("Some words, it's 12 <|endoftext|> naïve\n" * 500).encode()
    cut = list(K.stretches(text, 300))
    assert len(cut) > 20 and b"".join(cut) == text
    own = K.compiled(WORDS)
    assert sum(own.counts([s.decode() for s in cut])) == own.counts([text.decode()])[0]


def test_token_counts_of_odd_rows(odd):
    library = Tokenizer.from_file(WORDS)
    want = []
    for i, t, _ in ODD:
        n = len(library.encode(t, add_special_tokens=False).ids) if t else 0
        want.append((i, len((t or "").encode()), n, n > 2048))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in K.count_tokens(odd, WORDS).collect())
    assert got == Counter(want)
    assert K.count_tokens(odd.limit(0), WORDS).collect() == []
    with pytest.raises(ValueError, match="word ends"):
        K.Compiled(BYTES)


def test_token_count_query_on_all_documents(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows}
    got = QUERIES["op13_token_counts"](spark, sf_dir).withColumn("right", F.col("over_limit") == (F.col("n_tokens") > 2048)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.right for r in got)
