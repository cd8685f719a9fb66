"""Near-duplicates, repeats, shards, mixes and the pipeline against brute force and on odd inputs."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from srcloom.llm import lattice as L
from srcloom.llm import minhash as M
from srcloom.llm import mixing as X
from srcloom.llm import repeats as R
from srcloom.llm import sharding as S
from srcloom.llm.common import components, meet, numbered, running_sum, span_hashes
from srcloom.llm.queries import ORACLES, QUERIES

ODD = "doc_id long, text string, lang string, source string, n_chars long, shard int, copies long, row string, size long"
ODD_ROWS = [
    (1, None, None, None, 1, 1, 1, "a", 1), (2, "", "en", "s", 1, 1, 1, "a", 1), (3, "one two three", None, None, 1, None, None, None, None),
    (3, "one two three", None, None, 1, None, None, None, None), (None, "one  TWO three", "en", "s", 1, 1, 1, "a", 1), (5, "One two three", "en", "t", 1, 1, 1, "a", 1),
    (6, "word " * 30_000, "en", "s", 1, 1, 1, "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


def roots_of(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def test_components_of_long_and_wide_graphs(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    rows = chain + star + [(140, 100), (7, 7)]
    frame = spark.createDataFrame(rows, "a long, b long")
    assert {r.node: r.root for r in components(frame).collect()} == roots_of([r for r in rows if r[0] != r[1]])
    assert components(frame.limit(0)).collect() == []


def test_numbered_is_the_order_of_all_rows(spark):
    frame = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "v long, _n string").repartition(5)
    assert [(r.v, r.place) for r in numbered(frame, "place", F.col("v")).orderBy("v").collect()] == [(i, i + 1) for i in range(101)]


def test_span_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = span_hashes(running_sum(data), np.array([0, 3, 6, 0]), np.array([3, 6, 9, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def shingle_set(text):
    words = text.lower().encode().split() if text else []
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows, least=85):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return roots_of(links), sets


def made_texts(seed, groups, copies):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for _ in range(copies):
            text = list(base)
            for p in rng.integers(0, 200, rng.integers(0, 5)):
                text[p] = f"v{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [M.BLOCK, 6])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    """Small blocks take the way of large clusters: leaders, parts and pairs of blocks."""
    rows = made_texts(3, 4, 14) + [(900, None), (901, "a b"), (902, "A  b"), (903, "")]
    split = M.cluster_roots
    monkeypatch.setattr(M, "cluster_roots", lambda members, **more: split(members, block=block, **more))
    want, sets = near_groups(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in M.near_duplicates(frame).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want.get(r.doc_id, r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    same = [(M.signature(values[:2000]) == M.signature(values[i : 2000 + i])).mean() for i in range(200, 1000, 40)]
    real = [(2000 - i) / (2000 + i) for i in range(200, 1000, 40)]
    assert abs(np.mean(same) - np.mean(real)) < 0.05


def test_near_duplicates_of_odd_rows(odd):
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (-1, 1, None, True), (5, 1, 3, False), (6, 1, 6, True)], key=str)
    assert sorted(r.doc_id or -1 for r in M.keep_one(odd).collect()) == [-1, 1, 2, 3, 6]
    assert M.near_duplicates(odd.limit(0)).collect() == []


def test_ids_with_several_texts_link_all_their_groups(spark):
    rng = np.random.default_rng(2)
    one, two, three = ([f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(3))
    near = lambda words: " ".join([*words[:60], "other", *words[61:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, " ".join(three)), (0, " ".join(two)), (4, " ".join(three)), (None, near(three)), (None, near(three))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in M.near_duplicates(frame).collect())
    assert got == Counter([(1, 0), (1, 0), (2, 0), (3, 0), (4, 4), (0, 0), (4, 4), (None, None), (None, None)])
    assert Counter(r.doc_id for r in M.keep_one(frame).collect()) == Counter([0, 4, None])


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_clashing_columns(spark, sf_dir, stage):
    names = ["score", "runs", "items", "n_words", "gone_id", "copies", "shard", "slot", "row", "c0", "text_", "id_", "y", "turn", "key", "node"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    crowded = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    _, step = corpus_pipeline.STAGES[stage]
    plain, got = step(spark, docs, sf_dir), step(spark, crowded, sf_dir)
    assert set(got.columns) == set(crowded.columns)
    if stage < 4:
        assert got.columns == crowded.columns and all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in plain.collect())
    empty = step(spark, crowded.limit(0), sf_dir)
    assert empty.collect() == [] and set(empty.columns) == set(crowded.columns)


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * 2
    found = L.nearest_point(x)
    assert all(float(p.sum()) % 2 == 0 for p in found) and np.isin(np.abs(found * 2 % 2), (0, 1)).all()
    shorter = ((x[:, None, :] - found[:, None, :] - L.ROOTS[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - found) ** 2).sum(axis=1) <= shorter + 1e-9).all()
    assert len(L.ROOTS) == 240 and len({tuple(r) for r in L.ROOTS}) == 240
    other = L.next_point(x, found)
    assert np.allclose(((x - other) ** 2).sum(axis=1), shorter)


@pytest.mark.parametrize("block", [L.BLOCK, 7])
def test_near_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(6):
        centre = rng.normal(size=24)
        for _ in range(12):
            rows.append((len(rows), (centre + rng.normal(size=24) * 0.12).tolist(), int(rng.integers(0, 2))))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(3)]
    want = Counter()
    links = []
    for i, a, la in rows:
        for j, b, lb in rows:
            if i != j and la == lb and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                want[i] += 1
                links.append((i, j))
    root = roots_of(links)
    odd_rows = [(700, None, 1), (701, [0.0] * 24, 1), (702, [float("nan")] * 24, 1), (703, rows[0][1], None), (None, rows[0][1], rows[0][2]), (704, [1.0, None], 1), (705, [], 1), (706, [1.0, 2.0], 1), (707, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>, label int").withColumn("keys", F.lit(1))
    got = {r.vec_id: r for r in L.near_vectors(frame, block=block).collect()}
    found = sum(got[i].n_links for i, *_ in rows)
    assert len(got) == len(rows) + len(odd_rows) and found >= 0.97 * sum(want.values())
    assert all(got[i].n_links <= want[i] for i, *_ in rows)
    if found == sum(want.values()):
        assert all(got[i].component_id == root.get(i, i) for i, *_ in rows)
    assert got[706].n_links == got[707].n_links == 1 and got[707].component_id == 706
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (700, 701, 702, 703, 704, 705)) and got[None].component_id is None
    assert L.near_vectors(frame.limit(0)).collect() == []


def test_suffix_array_of_small_alphabets():
    rng = np.random.default_rng(6)
    for _ in range(150):
        data = bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 90)).tolist()) + R.END
        data += data if rng.random() < 0.3 else b""
        assert R.suffix_array(data, 10_000).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def repeats(texts, length):
    where = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [R.MOST, 2])
def test_repeats_against_brute_force(spark, most):
    """A small ``most`` takes the way of crowded anchors."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(chr(c) for c in rng.choice([97, 98, 99, 100, 228, 32], n))
    shared = [word(90) for _ in range(4)]
    texts = [word(int(rng.integers(0, 60))) + (shared[i % 4][int(rng.integers(0, 40)) :] if i % 3 else "") + word(int(rng.integers(0, 80))) for i in range(40)]
    texts += ["a" * 200, "a" * 130, texts[1], texts[1], word(40) * 5, "", None, "short"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in R.cut_repeats(frame, length=48, gram=16, most=most, block=500).collect()}
    want = repeats([(t or "").encode() for t in texts], 48)
    assert [got[i] for i in range(len(texts))] == want


def test_large_keys_stay_where_they_are(spark):
    """A plain join brings the rows of the large key into one partition."""
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") % 4 > 0).cast("long").alias("a"), F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("b"))
    found = rows.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("odd", F.col("b") % 2 == 1)
    largest = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert largest(rows.join(found, ["a", "b"])) >= 30_000
        assert largest(meet(rows, found, ["a", "b"], "n")) < 10_000
        assert meet(rows, found, ["a", "b"], "n").exceptAll(rows.join(found, ["a", "b"])).count() == 0
        assert meet(rows, found.where("odd"), ["a", "b"], "n").count() == 30_000
        assert meet(rows, found.where("n < 2"), ["a", "b"], "n", hot=10).count() == 10_000
        assert meet(rows.limit(0), found.limit(0), ["a", "b"], "n").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_repeats_of_common_lines_and_copies(spark):
    """One line that stands many times in most texts, and one text with very many copies."""
    rng = np.random.default_rng(31)
    word = lambda n: "".join(chr(c) for c in rng.choice([97, 98, 99, 100, 228, 32], n))
    line, copied = word(20), word(150)
    texts = [word(int(rng.integers(0, 60))) + line * int(rng.integers(0, 12)) + word(int(rng.integers(0, 60))) for _ in range(60)]
    texts += [copied] * 1100 + [word(30) + copied[20:110] + word(30), "", None] + ["short"] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in R.cut_repeats(frame, length=48, gram=16, block=500).collect()}
    want = repeats([(t or "").encode() for t in texts], 48)
    assert [got[i] for i in range(len(texts))] == want


def test_planted_passages_are_told_by_removed_bytes(spark):
    """Passages of over 50 words go if they have the 400 bytes of the contract; ``n_bytes`` is the size of the input."""
    rng = np.random.default_rng(41)
    words = lambda n, low, high: " ".join("".join(chr(c) for c in rng.integers(97, 123, rng.integers(low, high))) for _ in range(n))
    long, short = words(60, 7, 11), words(55, 3, 6)
    assert len(long) >= 400 > len(short) + 2
    texts = [words(40, 3, 9) + (f" {long} ", f" {short} ", " ")[i % 3] + words(40, 3, 9) for i in range(30)]
    rows = R.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[i] for i in range(len(texts))] == repeats([t.encode() for t in texts], 400)
    assert all((got[i][1] >= len(long)) == (i % 3 == 0) and (got[i][1] > 0) == (i % 3 == 0) for i in got)
    assert all(got[i][0] == len(t) for i, t in enumerate(texts))


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 110, 5000).tolist())
    monkeypatch.setattr(R, "_PIECE", 700)
    _, _, lo, hi = R.contexts(data, 48, 16)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert (np.sort(covered) == np.arange(5000 - 48 + 1)).all()


def test_repeats_of_odd_rows(odd):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in R.cut_repeats(odd).collect())
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 13, 0, 0), (3, 13, 0, 0), (-1, 14, 0, 0), (5, 13, 0, 0), (6, 150_000, 150_000, 1)])
    assert R.cut_repeats(odd.limit(0)).collect() == []


def test_ring_walk_fills_every_shard():
    nodes = S.ring(5, 7, 97)
    assert len(nodes) == 35 and nodes == sorted(nodes)
    for counts in ({3: 101}, {i: i % 4 for i in range(97)}, {}, {0: 1, 96: 2}):
        pieces = S.walk(counts, nodes, 97)
        loads = Counter()
        for _, low, high, shard, slot in pieces:
            assert slot == loads[shard]
            loads[shard] += high - low
        total = sum(counts.values())
        assert sum(loads.values()) == total and all(loads[s] == total // 5 + (s < total % 5) for s in range(5))
        for cell, n in counts.items():
            assert sorted(x for c, low, high, *_ in pieces if c == cell for x in range(low, high)) == list(range(n))


def test_few_rows_move_when_documents_are_added():
    nodes = S.ring(16, 64, 4096)
    rng = np.random.default_rng(1)
    before = dict(Counter(rng.integers(0, 4096, 20_000).tolist()))
    after = dict(before)
    for c in rng.integers(0, 4096, 200).tolist():
        after[c] = after.get(c, 0) + 1
    place = lambda counts: {(c, i): s for c, low, high, s, _ in S.walk(counts, nodes, 4096) for i in range(low, high)}
    one, two = place(before), place(after)
    assert sum(two[k] != s for k, s in one.items()) < 0.1 * len(one)


def test_shards_of_all_rows(spark, sf_dir, odd):
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys()) and all(r.size == len(docs[r.doc_id].encode()) + 1 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    got = S.shard_rows(odd, 3)
    assert Counter(r.shard for r in got.collect()) == {0: 3, 1: 2, 2: 2} and set(got.columns) == {*odd.columns, "slot"}
    assert S.shard_rows(odd.limit(0), 3).collect() == []


def shared_out(sizes):
    """Targets by repeated sharing, source by source."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        got = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if got[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **got}
        capped |= {s: 3 * sizes[s] for s in above}


def test_targets_and_near_mixes(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "x " * int(rng.integers(1, 40)), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", "é"], 3000, p=[0.6, 0.2, 0.15, 0.03, 0.02]))]
    rows += [(5000 + i, "y " * 9, None) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = X.mix(frame).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = shared_out(sizes), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 80 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, X.mix(frame.repartition(7)).collect()))
    emitted = Counter(r.doc_id for r in X.emit(frame).collect())
    assert emitted == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_odd_rows(odd):
    got = X.mix(odd)
    assert set(got.columns) == {*odd.columns, "source_size", "target", "taken"} and got.count() == len(ODD_ROWS)
    assert X.emit(odd).columns == odd.columns
    assert X.mix(odd.limit(0)).collect() == [] and X.emit(odd.limit(0)).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in X.mix(odd.where("doc_id < 3")).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    frame = QUERIES[name](spark, sf_dir)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    assert sorted(columns) == sorted(frame.columns)
    assert Counter(tuple(map(plain, row)) for row in result.fetchall()) == Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())


def test_pipeline_stages_keep_their_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    good = corpus_pipeline.good_quality(spark, docs, sf_dir)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.columns == columns and sum(i in kept for i in clean) >= 0.95 * len(clean)
    one = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    want, _ = near_groups([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.SIMILARITY)
    ids = {r.doc_id for r in docs.collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i in ids if want.get(i, i) == i}
    free = corpus_pipeline.decontaminated(spark, docs, sf_dir)
    bad = {r.doc_id for r in QUERIES["op6_decontamination"](spark, sf_dir).where("contaminated").collect()}
    assert bad and free.columns == columns and {r.doc_id for r in free.collect()} == ids - bad
    mixed = corpus_pipeline.mixed(spark, docs, sf_dir)
    taken = {r.doc_id: r.copies for r in QUERIES["op8_mixing"](spark, sf_dir).collect() if r.copies}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter(taken)
    placed = corpus_pipeline.sharded(spark, docs, sf_dir)
    assert set(placed.columns) == {*columns, "shard", "slot"} and placed.count() == docs.count()


@pytest.mark.parametrize("block", [M.BLOCK, 6])
def test_near_dedup_stage_links_from_80_percent(spark, sf_dir, monkeypatch, block):
    """Copies with 0.80 to 0.85 of common shingles go in the stage and stay in op5; small blocks take the way of leaders."""
    rng = np.random.default_rng(17)
    rows = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 9000, 200)]
        for places in ([], [20, 60, 100, 140], [25, 65, 105, 150], [10, 50, 90, 130, 170]):
            text = list(base)
            for p in places:
                text[p] = f"v{len(rows)}x{p}"
            rows.append((len(rows), " ".join(text)))
    sets = {i: shingle_set(t) for i, t in rows}
    at = lambda least: roots_of([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])
    kept = lambda root: {i for i in sets if root.get(i, i) == i}
    assert kept(at(80)) < kept(at(85))
    split = M.cluster_roots
    monkeypatch.setattr(M, "cluster_roots", lambda members, **more: split(members, block=block, **more))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, sf_dir).collect()} == kept(at(80))
    assert {r.doc_id for r in M.near_duplicates(frame).where("kept").collect()} == kept(at(85))
