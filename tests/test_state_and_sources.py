"""State folds cut at any place, progress guards, readers and writers."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from srcloom.operators import migration_state as M
from srcloom.plans import state_queries as Q
from srcloom.sources import code_tree as CT
from srcloom.sources import file_tree as FT
from srcloom.sources import fixed_width as FW
from srcloom.sources import state_files as SF

HAPPY = ["analyzing", "analyzed", "segmenting", "segmented", "migrating", "validating", "assembling", "completed"]


def requests(spark, by_project):
    rows = [(p, i, s) for p, states in by_project.items() for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "project string, event_id int, to_state string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id"))
    )


@pytest.mark.parametrize("chunks", [1, 3, 17])
def test_fold_of_one_hot_project(spark, chunks):
    """One project holds nearly all requests and is cut into many chunks."""
    hot = (HAPPY + ["idle", "completed", "analyzing", "failed", "idle"]) * 20
    folded = M.fold_transitions(requests(spark, {"a": HAPPY, "hot": hot, "z": ["completed"]}), chunks=chunks)
    rows = folded.where("project = 'hot'").orderBy("ts", "event_id").collect()
    state = "idle"
    for r in rows:
        assert r.from_state == state and r.accepted == (r.to_state in M.ALLOWED[state])
        state = r.to_state if r.accepted else state
        assert r.state == state
    final = {r.project: (r.state, r.n_rejected) for r in M.final_states(folded).collect()}
    assert final["a"] == ("completed", 0) and final["z"] == ("idle", 1)


@pytest.mark.parametrize("least", [3, 10, 100])
def test_fold_in_pieces(spark, least):
    """Hot projects are cut into pieces; ties of time stay together; starts and unknown states count."""
    rng = random.Random(least)
    rows = [(p, rng.randrange(n), i, rng.choice([*M.STATES, "odd", None])) for p, n in (("a", 3), ("hot", 90), (None, 40), ("one", 1)) for i in range(5 * n)]
    given = spark.createDataFrame(rows, "project string, t int, event_id int, to_state string").withColumn("ts", F.timestamp_seconds("t"))
    starts = spark.createDataFrame([("hot", "migrating"), ("a", "failed"), ("new", "idle")], "project string, state string")
    got = {(r.project, r.event_id): (r.from_state, r.accepted, r.state) for r in M.fold_transitions(given, starts=starts, least=least, chunks=8).collect()}
    checked = {(r.project, r.event_id): r.previous for r in M.check_transitions(given, least=least).collect()}
    want, previous = {}, {}
    for project in {r[0] for r in rows}:
        state, last = {"hot": "migrating", "a": "failed"}.get(project, "idle"), None
        for _, _, i, target in sorted((r for r in rows if r[0] == project), key=lambda r: (r[1], r[2])):
            accepted = target in M.ALLOWED[state]
            want[project, i] = (state, accepted, target if accepted else state)
            previous[project, i] = last or "idle"
            state, last = want[project, i][2], target
    assert got == want and checked == previous
    assert M.fold_transitions(given.limit(0), least=least).collect() == []


def test_transition_check_of_one_hot_project(spark):
    checked = M.check_transitions(requests(spark, {"hot": HAPPY * 10, "b": ["analyzing"]}))
    rows = checked.where("project = 'hot'").orderBy("ts").collect()
    states = HAPPY * 10
    assert [r.previous for r in rows] == ["idle"] + states[:-1]
    assert all(r.allowed == (r.to_state in M.ALLOWED[r.previous]) for r in rows)


def test_accepted_and_rejected_cover_all_requests(spark, sf_dir):
    given = Q.requests(spark, sf_dir)
    totals = M.final_states(M.fold_transitions(given)).agg(F.sum("n_accepted") + F.sum("n_rejected")).first()[0]
    assert totals == given.count()


def test_progress_guard_and_counts(spark):
    rows = [("p", "a", "validated", 1), ("p", "b", "validated", 1), ("p", "c", "failed", 3), ("p", "d", "pending", 0), ("e", None, None, None)]
    segments = spark.createDataFrame(rows, "project string, segment_id string, state string, attempts int")
    got = {r.project: r for r in M.progress(segments).collect()}
    assert (got["p"].completed, got["p"].failed, got["p"].pending, got["p"].progress_pct) == (2, 1, 1, 50.0)
    assert (got["e"].total_segments, got["e"].progress_pct) == (0, 0.0)
    assert [r.segment_id for r in M.retryable(segments).collect()] == ["d"]


def test_upsert_keeps_values_that_are_not_null(spark):
    rows = [("p", "s", 1, 1, "migrating", "boom"), ("p", "s", 2, 2, "validated", None), ("p", "s", 3, 3, None, None)]
    updates = spark.createDataFrame(rows, "project string, segment_id string, ts int, event_id int, state string, last_error string")
    row = M.upsert_segments(updates).first()
    assert (row.state, row.last_error) == ("validated", "boom")


def test_code_tree(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / ".git").mkdir()
    (tmp_path / "src" / "deep" / "A.CPP").write_bytes(b"int x;\r\nint y = \xff;\r\n")
    (tmp_path / "src" / "b.java").write_text("class B {\n}\n")
    (tmp_path / "src" / "big.php").write_text("x" * 200)
    (tmp_path / "src" / "notes.txt").write_text("no code")
    root = str(tmp_path / "src")
    rows = {r.path: r for r in CT.scan_code_tree(spark, root).collect()}
    assert set(rows) == {"deep/A.CPP", "b.java"}
    assert rows["deep/A.CPP"].language == "cpp" and rows["deep/A.CPP"].content == "int x;\nint y = �;\n"
    folder = CT.folder_files(CT.scan_code_tree(spark, root, "folder", max_bytes=100)).withColumn("folder", F.lit("src"))
    total = CT.folder_totals(folder).first()
    assert (total.total_files, total.total_lines, total.detected_language, total.suggested_migration) == (2, 4, "java7", "java7_to_python")
    assert [(r.name, r.is_dir) for r in CT.file_catalogue(CT.list_tree(spark, root)).collect()] == [
        ("deep", True), ("b.java", False), ("big.php", False), ("notes.txt", False),
    ]


def test_file_tree_round_trip(spark, tmp_path):
    rows = [("a/b.cpp", "int x;\n", "fn b() {}\n"), ("a/c.java", "class C {}\n", None), ("top.cob", "", ""), ("ü/deep/er/x.rs", "use a;\n", None)]
    files = spark.createDataFrame(rows, "path string, content string, migrated_code string").repartition(3)
    root = str(tmp_path / "out")
    for _ in range(2):  # the second time over the first
        CT.write_code_tree(files, root, "rust")
        got = {r.path: (bytes(r.content).decode(), r.length, r.is_dir) for r in FT.read_tree(spark, root, spread="3").collect()}
        want = {"a/b.rs": "fn b() {}\n", "a/c.java": "class C {}\n", "top.rs": "", "ü/deep/er/x.rs": "use a;\n"}
        assert got == {p: (t, len(t.encode()), False) for p, t in want.items()}
        # the scan of code leaves empty files out, as Spark's reader of binary files does
        assert {r.path: r.content for r in CT.scan_code_tree(spark, root).collect()} == {p: t for p, t in want.items() if t}
    assert sorted(os.listdir(tmp_path)) == ["out"]
    assert [(r.name, r.is_dir, r.size) for r in CT.list_folder(spark, root).collect()] == [("a", True, None), ("ü", True, None), ("top.rs", False, 0)]
    with pytest.raises(ValueError, match="more than once"):
        CT.write_code_tree(files.union(spark.createDataFrame([("a/b.c", "", "x")], files.schema)), root, "rust")
    with pytest.raises(Exception, match="FileExistsError"):
        FT.write_tree(files.limit(1), str(tmp_path / "out"), overwrite=False)


def test_failed_write_leaves_nothing(spark, tmp_path):
    files = spark.createDataFrame([("ok/one.rs", "x"), ("../out.rs", "y")], "path string, content string").repartition(2)
    with pytest.raises(Exception, match="not a path below"):
        FT.write_tree(files, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
    assert FT.read_tree(spark, str(tmp_path / "nowhere")).collect() == []


def test_size_limit_reaches_the_reader(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn a() {}")
    df = CT.scan_code_tree(spark, str(tmp_path), max_bytes=50).select("path")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan


def test_state_files(spark, tmp_path):
    good = tmp_path / "in" / "p1" / SF.HIDDEN_NAMES[0]
    bad = tmp_path / "in" / "p2" / SF.HIDDEN_NAMES[0]
    boss = tmp_path / "in" / "p3" / SF.HIDDEN_NAMES[1]
    for f in (good, bad, boss):
        f.parent.mkdir(parents=True)
    good.write_text(json.dumps({
        "project_name": "pay", "state": "analyzing", "odd_key": 1, "segments": {"a::b": {"segment_id": "a::b", "state": "pending", "attempts": 2}},
        "event_log": [{"type": "t", "detail": "d", "timestamp": "2024"}],
    }))
    bad.write_text("{ not json")
    boss.write_text(json.dumps({"client": {"name": "Bank"}, "execution": {"status": "failed"}}))
    os.utime(good, (2_000_000_000, 2_000_000_000))
    root = str(tmp_path / "in")
    plain, supervised = SF.read_plain(spark, root, SF.HIDDEN_NAMES[0]), SF.read_supervised(spark, root, SF.HIDDEN_NAMES[1])
    assert plain.first().mtime.year == 2033
    assert [(r.project_name, r.state) for r in plain.collect()] == [("pay", "analyzing")]
    assert [(r.project, r.segment_key, r.attempts) for r in SF.state_segments(plain).collect()] == [("pay", "a::b", 2)]
    assert SF.state_events(plain).count() == 1
    assert SF.latest_snapshot(plain, supervised).first().path.endswith("p3/.supervised_state.json")
    SF.write_state(plain.drop("path", "mtime"), str(tmp_path / "out"))
    assert SF.read_state_table(spark, str(tmp_path / "out")).first().segments["a::b"].state == "pending"


def test_fixed_width_file(spark, tmp_path):
    record = "000042" + "ANA".ljust(30) + "SALES".ljust(10) + "000123456" + "170" + "A"
    (tmp_path / "emp.dat").write_text(record + "\n" + record[:46] + "\n")
    good, short = FW.read_fixed_width(spark, str(tmp_path / "emp.dat"), FW.EMPLOYEE_RECORD).orderBy(F.desc("emp_status")).collect()
    assert (good.emp_id, good.emp_name, str(good.emp_salary), good.emp_hours, good.emp_status) == (42, "ANA", "1234.56", 170, "A")
    assert short.emp_salary is None and short.emp_hours is None


def test_layout_of_a_copybook(spark):
    text = "       01 EMP.\n         05 EMP-ID PIC 9(6).\n         05 EMP-PAY PIC S9(7)V99.\n         05 EMP-OK PIC XX.\n         05 BIG PIC 9(12).\n"
    text += "       01 WS-TOTALS.\n         05 N PIC 9(4).\n         05 S PIC X(3).\n       77 K PIC 99.\n"
    rows = FW.infer_layout(spark.createDataFrame([("a.cpy", text)], "path string, content string")).orderBy("field_ord").collect()
    assert [(r.name, r.type, r.width, r.scale, r.start) for r in rows] == [
        ("emp_id", "i32", 6, 0, 1), ("emp_pay", "f64", 9, 2, 7), ("emp_ok", "String", 2, 0, 16), ("big", "i64", 12, 0, 18),
        ("n", "i32", 4, 0, 1), ("s", "String", 3, 0, 5), ("k", "i32", 2, 0, 1),
    ]
    assert [r.record for r in rows] == [1, 1, 1, 1, 2, 2, 3]
    line = "000042" + "000012345" + "OK" + "000000000007"
    got = FW.parse_records(spark.createDataFrame([(line,)], "value string"), FW.layout_fields(rows[:4])).first()
    assert (got.emp_id, str(got.emp_pay), got.emp_ok, got.big) == (42, "123.45", "OK", 7)


def test_written_code_comes_back(spark, tmp_path):
    files = spark.createDataFrame([("a.rs", "rust", "fn a() {}"), ("b.py", "python", "x")], "path string, language string, content string")
    CT.write_code(files, str(tmp_path / "out"), "language")
    assert spark.read.parquet(str(tmp_path / "out")).where("language = 'rust'").first().content == "fn a() {}"


def test_assembled_files_hold_each_segment_once(spark):
    rows = [("a/x.cob", 5, 1, "two"), ("a/x.cob", 1, 0, "one"), ("b/x.cob", 1, 0, "other"), ("a/x.cob", 9, 2, "")]
    df = spark.createDataFrame(rows, "path string, start_line int, seg_ord int, migrated_code string")
    got = {r.out_file: r.content for r in M.assemble(df, "rust").collect()}
    assert got == {"a/x.rs": "one\n\ntwo", "b/x.rs": "other"}


def test_cascade_by_stem_reads_segments_once(spark):
    """Stems are asked for several times; the segments behind them are computed once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(f"a/f{i}.c", f"f{i}::x", "migrated") for i in range(30)]
    segments = spark.createDataFrame(rows, "path string, segment_id string, state string").mapInArrow(count, "path string, segment_id string, state string")
    compiled = spark.createDataFrame([("a/f2.rs", True, ""), ("a/xf29.rs", False, "bad")], "out_file string, success boolean, errors string")
    cascade = M.compile_cascade_by_stem(segments, compiled)
    got = {r.segment_id: r.state for r in cascade.collect()}
    assert "Broadcast" not in cascade._jdf.queryExecution().executedPlan().toString()  # the sides grow with the input
    assert got["f2::x"] == got["f29::x"] == "failed" and got["f3::x"] == "migrated" and len(got) == 30
    assert seen.value == 30


def test_tree_passed_through_in_batches(spark, tmp_path, monkeypatch):
    """Every file is written and read again, and no batch's files stay on disk."""
    monkeypatch.setattr(CT, "new_folder", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    rows = [(f"d{i % 3}/f{i}.c", f"int x{i};", f"let x{i};" if i % 2 else None) for i in range(40)]
    files = spark.createDataFrame(rows, "path string, content string, migrated_code string")
    held = []

    def taken(tree):
        held.append(tree.count())
        return tree.select("path", "content")

    got = {tuple(r) for r in CT.pass_through_tree(spark, files, "rust", taken, most=7).collect()}
    assert got == {(f"d{i % 3}/f{i}." + ("rs" if i % 2 else "c"), f"let x{i};" if i % 2 else f"int x{i};") for i in range(40)}
    assert sum(held) == 40 and max(held) < 20 and len(held) == 6
    assert [f.name.split("-")[0] for f in tmp_path.iterdir()] == ["kept"]


def test_batches_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """The reader counts 4 MB for a file, so 32 files were a task; the setting is put back."""
    monkeypatch.setattr(CT, "new_folder", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    files = spark.createDataFrame([(f"d{i % 3}/f{i}.c", f"é {i}" * (i % 2), None) for i in range(1500)], "path string, content string, migrated_code string")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    got = CT.pass_through_tree(spark, files, "rust", lambda tree: tree.select("path", "content", F.spark_partition_id().alias("task")), most=800).collect()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    # empty files are left out by the scanner
    assert sorted((r.path, r.content) for r in got) == sorted((f"d{i % 3}/f{i}.c", f"é {i}") for i in range(1, 1500, 2))
    assert len({r.task for r in got}) <= 8


def test_wide_folders_are_cut_into_shares(spark, tmp_path, monkeypatch):
    """The driver holds no wide level; shares of a folder have all its files and folders once."""
    root = tmp_path / "wide"
    want = set()
    for i in range(60):
        folder = root / f"n{i % 3}" / f"p{i}" / "deep"
        folder.mkdir(parents=True)
        for path in (folder / ".x", folder.parent / "y", root / f"n{i % 3}" / f"f{i}", root / "top"):
            path.write_text("t")
            want.add(str(path.relative_to(root)))
    monkeypatch.setattr(FT, "WIDE", 10)
    parts = FT.TreeReader({"path": str(root), "spread": "8"}).partitions()
    held = [s for p in parts for s in p.starts]
    assert len(parts) == 8 and len(held) == 1 + 3 * 3 and {s.folder for s in held} == {str(root), *(f"{root}/n{i}" for i in range(3))}
    reader = FT.TreeReader({"path": str(root), "spread": "8"})
    got = [path for p in parts for b in reader.read(p) for path in b.column("path").to_pylist()]
    assert sorted(got) == sorted(want)
    one = FT.TreeReader({"path": str(root / "n0"), "spread": "8"})
    found = [path for p in one.partitions() for b in one.read(p) for path in b.column("path").to_pylist()]
    assert sorted(found) == sorted(x.removeprefix("n0/") for x in want if x.startswith("n0/"))


def test_a_small_table_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The rows are dealt by path first: one task that reads a table does not write all of its files."""
    files = spark.range(200).coalesce(1).selectExpr("concat('d', id, '/f') as path", "cast(id as string) as content")
    asked = []
    frame = type(files)
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *by: asked.append(by) or repartition(self, *by))
    root = str(tmp_path / "out")
    FT.write_tree(files, root)
    assert asked == [(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")]
    assert FT.read_tree(spark, root).select(F.col("content").cast("string")).distinct().count() == 200


def test_both_layouts_come_in_one_walk(spark, tmp_path):
    for i, (name, text) in enumerate([
        (SF.HIDDEN_NAMES[0], '{"project_name": "a", "state": "DONE", "total_segments": 3, "more": 1}'), (SF.HIDDEN_NAMES[1], '{"client": {"name": "b"}, "execution": {"status": "OK"}}'),
        (SF.HIDDEN_NAMES[0], "{broken"), (SF.HIDDEN_NAMES[1], "[1"), (SF.HIDDEN_NAMES[0], "{}"), ("other.json", "{}"), (SF.HIDDEN_NAMES[1], ""),
    ]):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / name).write_text(text)
    both = SF.read_layouts(spark, str(tmp_path), *SF.HIDDEN_NAMES)
    for name, is_supervised, alone in ((SF.HIDDEN_NAMES[0], False, SF.read_plain), (SF.HIDDEN_NAMES[1], True, SF.read_supervised)):
        layout = "supervised" if is_supervised else "plain"
        got = both.where(F.col("is_supervised") == is_supervised).select("path", "mtime", f"{layout}.*")
        assert sorted(map(str, got.collect())) == sorted(map(str, alone(spark, str(tmp_path), name).collect())) != []
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
