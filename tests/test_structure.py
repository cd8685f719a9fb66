"""Symbols and segments of small files, one language and quirk at a time."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from srcloom.operators import segments as SG
from srcloom.operators import symbols as SY

CPP = """#include <iostream>
#include "shape.h"

// because of tests
const int LIMIT = 5;

struct Point {
    int x;
};

static double area(double w, const Point& p);

int main(int argc, char** argv) {
    int local = 1;
    if (argc > 1 && local) {
        return 1;
    } else {
        return LIMIT;
    }
}

enum Color { RED, GREEN };
"""
COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAY.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  WS-TOTAL PIC 9(5).
       01  FILLER PIC X.
       77 WS-N PIC 9.
       COPY PAYREC.
       PROCEDURE DIVISION.
       MAIN-PARA.
           PERFORM CALC.
           STOP RUN.
       CALC.
           IF WS-N > 1
               ADD 1 TO WS-TOTAL
           END-IF.
"""
JAVA = """package a.b;

import java.util.List;
import java.util.Map;

public class Outer extends Base implements One, Two {
    public Outer(int x) {
    }

    public static List<String> names(int a, String b) throws IOException {
        for (String s : all) { if (s != null) { use(s); } }
        return null;
    }

    private class Inner {
        protected int size() { return 1; }
    }
}
"""
RUST = """use std::io;
use std::collections::{HashMap, HashSet};

pub struct Ñame;

pub fn run<T>(a: T, b: &str) -> Vec<T> {
    match a { _ => {} }
}

fn open(
"""


def analysed(spark, files):
    rows = [(p, p.rsplit("/", 1)[-1].rsplit(".", 1)[0], lang, c) for p, lang, c in files]
    return SY.analyse_corpus(spark.createDataFrame(rows, "path string, stem string, language string, content string"))


def one(spark, language, content):
    return analysed(spark, [("d/f.x", language, content)]).first()


def shape(row):
    return [(s.name, s.kind, s.start_line, s.end_line) for s in row.symbols]


def test_cpp(spark):
    row = one(spark, "cpp", CPP)
    assert row.imports == ["iostream", "shape.h"]
    # A prototype takes the next block as its own.
    assert shape(row) == [
        ("area", "function", 11, 20), ("main", "function", 13, 20), ("Point", "struct", 7, 9), ("Color", "enum", 22, 22),
    ]
    main = row.symbols[1]
    assert (main.params, main.return_type, main.complexity) == (["int argc", "char** argv"], "int", 4)
    assert row.global_vars == ["LIMIT"]
    assert row.total_lines == len(CPP.split("\n"))


def test_cobol(spark):
    row = one(spark, "cobol", COBOL)
    assert row.imports == ["IDENTIFICATION DIVISION", "DATA DIVISION", "PROCEDURE DIVISION", "COPY PAYREC"]
    assert row.global_vars == ["WS-TOTAL", "WS-N"]
    assert shape(row) == [("MAIN-PARA", "function", 10, 12), ("CALC", "function", 13, 15), ("END-IF", "function", 16, 17)]
    files = analysed(spark, [("f.cob", "cobol", COBOL)]).select("path", "stem", "language", "content")
    assert [s.name for s in SY.analyse_corpus(files, drop_end_verbs=True).first().symbols] == ["MAIN-PARA", "CALC"]


def test_java(spark):
    row = one(spark, "java", JAVA)
    assert row.imports == ["package:a.b", "java.util.List", "java.util.Map"]
    # Constructors have no return type and do not match.
    assert [(s.name, s.kind) for s in row.symbols] == [
        ("Outer", "class"), ("Inner", "class"), ("names", "function"), ("size", "function"),
    ]
    assert row.symbols[0].dependencies == ["Base", "One", "Two"]
    assert (row.symbols[0].start_line, row.symbols[0].end_line) == (6, 18)


def test_rust_and_open_block(spark):
    row = one(spark, "rust", RUST)
    assert row.imports == ["std::io", "std::collections::{HashMap, HashSet}"]
    assert shape(row) == [("run", "function", 6, 8), ("Ñame", "struct", 4, 8)]
    assert row.symbols[0].return_type == "Vec<T>"
    lonely = one(spark, "rust", "\n".join(["fn f() {"] + ["x"] * 40))
    assert shape(lonely) == [("f", "function", 1, 20)]


def test_empty_and_unknown_files(spark):
    for language in ["cpp", "cobol", "java", "rust", "unknown"]:
        row = one(spark, language, "")
        assert (row.symbols, row.imports, row.global_vars, row.total_lines) == ([], [], [], 1)


def segments(spark, language, content):
    rows = SG.segment_corpus(analysed(spark, [("d/f.x", language, content)])).orderBy("seg_ord").collect()
    return rows


def test_cpp_segments(spark):
    rows = segments(spark, "cpp", CPP)
    assert [(r.segment_id, r.kind, r.start_line, r.end_line) for r in rows] == [
        ("f::header", "header", 1, 4), ("f::globals", "globals", 5, 5), ("f::Point", "struct", 7, 9),
        ("f::area", "function", 11, 20), ("f::main", "function", 13, 20), ("f::Color", "enum", 22, 22),
    ]
    assert rows[0].code == "\n".join(CPP.split("\n")[:4])
    assert rows[4].code.startswith("int main") and rows[4].code.endswith("}")


def test_java_segments_hold_their_methods(spark):
    rows = segments(spark, "java", JAVA)
    assert [(r.name, r.kind) for r in rows] == [("imports/includes", "header"), ("Outer", "class"), ("Inner", "class")]
    assert rows[1].dependencies == ["Base", "One", "Two"]


def test_last_group_of_a_name_wins_in_first_place(spark):
    code = "fn f() {\n}\nfn g() {\n}\nfn f() {\n    1\n}\n"
    assert [(r.name, r.start_line) for r in segments(spark, "rust", code)] == [("f", 5), ("g", 3)]


def test_header_takes_use_inside_words(spark):
    rows = segments(spark, "rust", "// x\nlet y = because it;\nuse a::b;\nfn f() {\n}\n")
    assert rows[0].code == "// x\nlet y = because it;\nuse a::b;"


def test_same_stem_in_two_folders(spark):
    files = [("a/f.rs", "rust", "fn one() {\n}\n"), ("b/f.rs", "rust", "fn one() {\n}\n")]
    rows = SG.segment_corpus(analysed(spark, files)).collect()
    assert len(rows) == 2 and len({r.segment_id for r in rows}) == 1 and len({r.path for r in rows}) == 2


def test_spans_lie_inside_their_files(spark, sf_dir):
    from srcloom.plans.structure_queries import analysed as corpus

    nested = corpus(spark, sf_dir)
    rows = SG.segment_corpus(nested, "total_lines")
    assert rows.where("start_line < 1 or end_line > total_lines or start_line > end_line").isEmpty()


def test_context_digests_add_up(spark):
    nested = analysed(spark, [("a/f.rs", "rust", "fn one() {\n}\n"), ("a/g.rs", "rust", "fn two() {\n}\n"), ("b/g.rs", "rust", "")])
    nested = nested.withColumn("project", F.substring("path", 1, 1))
    lines = SY.context_lines(nested, "project")
    texts = {r.path: r.context for r in lines.collect()}
    assert texts["a/f.rs"] == "// Archivo: f.rs (3 líneas)\n//   function: one"
    digest = lambda *paths: str(sum(int(hashlib.md5(f"{p}\n{texts[p]}".encode()).hexdigest()[:12], 16) for p in paths))
    got = {r.segment_id: r for r in SG.attach_context(SG.segment_corpus(nested, "project"), lines, "project").collect()}
    whole = "\n".join([SG.CONTEXT_TITLE, texts["a/f.rs"], texts["a/g.rs"]])
    assert set(got) == {"f::one", "g::two"}
    assert all((r.context_files, r.context_chars, r.context_digest) == (2, len(whole), digest("a/f.rs", "a/g.rs")) for r in got.values())


def test_time_grows_in_proportion_to_the_file(spark):
    """One generated file of 1 and of 4 MB: a look-up per symbol, not a scan of the file per symbol."""
    one = 'int fn_%d(int a) {\n    if (a > 3) {\n        return 1;\n    }\n    for (int i = 0; i < a; i++) { a++; }\n    printf("part");\n    return a;\n}\n'
    taken = []
    for size in (1_000_000, 4_000_000):
        n = size // len(one)
        files = spark.createDataFrame([("a.cpp", "cpp", "".join(one % i for i in range(n)))], "path string, language string, content string")
        start = time.perf_counter()
        row = SY.symbol_table(SY.analyse_corpus(files)).agg(F.count("*").alias("n"), F.sum("complexity").alias("c"), F.max("end_line").alias("e")).first()
        taken.append(time.perf_counter() - start)
        assert (row.n, row.c, row.e) == (n, 3 * n, 8 * n)
    assert taken[1] < 8 * taken[0]


def _some_files(spark, sf_dir):
    from srcloom.plans.derived import source_files

    return source_files(spark, sf_dir).where("o_orderkey < 200")


def test_outlines_are_those_of_the_analysis(spark, sf_dir):
    files = _some_files(spark, sf_dir)
    fields = ("params", "kind", "name")
    short = SY.symbol_outlines(files, *fields)
    assert "__braces" not in short._jdf.queryExecution().analyzed().toString()
    whole = SY.symbol_table(SY.analyse_corpus(files)).select("path", "sym_ord", *fields)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(SY.symbol_table(short).select("path", "sym_ord", *fields)) == rows(whole) and whole.count() > 100
    assert rows(short.select("path", "total_lines")) == rows(SY.analyse_corpus(files).select("path", "total_lines"))


def test_segments_apart_need_no_others(spark, sf_dir):
    analysed = SY.analyse_corpus(_some_files(spark, sf_dir))
    for kind in SG.APART:
        columns = ["path", "segment_id", "kind", "code", "start_line", "end_line"]
        want = SG.segment_corpus(analysed).where(F.col("kind") == kind).select(columns)
        got = SG.segment_corpus(analysed, kinds=(kind,)).select(columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


ODD_FILES = [
    ("a.cpp", "cpp", CPP), ("a.cob", "cobol", COBOL),
    ("b.cpp", "cpp", "struct A {\n int x;\n};\nclass A {\n};\nint A(int b) {\n return b;\n}\nenum E { X };\nenum E { Y };\n"),
    ("c.java", "java", "import a.b;\n" + "\n" * 25 + "class C {\n  public int f(int a) { return a; }\n  private void g() {\n"),
    ("d.java", "java", "}\n" + " \n" * 30 + "public class D extends B implements I, J {\n}\n class D {\n}\npublic int D(int a) {\n}\n"),
    ("e.rs", "rust", "use a::b;\npub struct R;\nfn f(a: i32) -> i32 { a }\nstruct Q {\n x: i32,\n}\nfn Q() { }\n"),
    ("f.cob", "cobol", "      \n\n       A.\n\n       END-IF.\n       B.\n\n\n"),
    ("g.cpp", "cpp", "\u0001int limit = 1;\nint other\n = 2;\n\u0002struct S {\nint f(int a) {\n}\n};\nother = 3;\n"),
    ("h.rs", "rust", "".join(f"fn f{i % 40}(a: i32) {{\n}}\n\n" for i in range(90))),
    ("i.txt", "unknown", "class X {}"), ("j.cpp", "cpp", ""), ("k.cpp", "cpp", None), ("l.java", "java", "import\tx;\nclass"),
]


def _odd_files(spark):
    rows = [(p, p.split(".")[0], lang, text) for p, lang, text in ODD_FILES]
    return spark.createDataFrame(rows, "path string, stem string, language string, content string")


def test_segments_of_kinds_come_from_spans(spark, sf_dir):
    columns = ["path", "segment_id", "kind", "code", "start_line", "end_line"]
    rows = lambda df: sorted(map(str, df.collect()))
    for files in (_odd_files(spark), _some_files(spark, sf_dir)):
        spans = SY.analyse_corpus(files, scored=False)
        whole = SG.segment_corpus(SY.analyse_corpus(files))
        for kinds in (("struct", "class"), ("function",), ("enum",)):
            want = whole.where(F.col("kind").isin(*kinds))
            assert rows(SG.segment_corpus(spans, kinds=kinds).select(columns)) == rows(want.select(columns)) and want.count()
            assert rows(SG.segment_corpus(SY.analyse_corpus(files), kinds=kinds).drop("seg_ord")) == rows(want.drop("seg_ord"))


def test_names_of_segments_without_their_code(spark, sf_dir):
    for files in (_odd_files(spark), _some_files(spark, sf_dir)):
        names = SG.segment_names(F.col("content"), F.col("imports"), F.col("global_vars"), F.col("symbols"))
        got = SY.analyse_corpus(files, scored=False).withColumn("names", names)
        want = SG.with_segments(SY.analyse_corpus(files)).withColumn("names", F.col("segments.id_part"))
        rows = lambda df: sorted(map(str, df.select("path", "total_lines", SY.context_text(), "names").collect()))
        assert rows(got) == rows(want)


def test_queries_of_spans_look_for_no_branches(spark, sf_dir):
    from srcloom.plans import catalogue

    plan = catalogue.QUERIES["container_segments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "EVALUATE" not in plan and "import |use " not in plan and SY.CPP_RECORD in plan


def test_index_of_a_file_matches_twin():
    """Block ends and branches found in one pass, against a second opinion that goes over the lines."""
    from srcloom.operators.file_analysis import Index
    from test_text import block_end_of, complexity_of, random_text

    rng = random.Random(9)
    pieces = ["{", "}", "{", "}", "x", " ", "if ", "else", "é", "||", "&&", "|||", "iffy", "END-IF", "for(", "_if", "matché", "case", "1if"]
    texts = [random_text(rng, rng.randint(1, 30), pieces) for _ in range(300)] + ["", "}\n{\n}\n}", "{\n" * 30, "}\n" * 3 + "{}" * 9]
    for text in texts:
        lines, idx = text.split("\n"), Index(text)
        assert idx.n_lines == len(lines)
        for start in range(1, len(lines) + 1):
            end = idx.block_end(start)
            assert end == block_end_of(lines, start) and idx.complexity(start, end) == complexity_of(lines, start, end), (text, start)


def test_classes_are_found_around_their_word():
    from srcloom.operators.file_analysis import class_heads, compiled

    rng, pattern = random.Random(10), compiled(SY.JAVA_CLASS)
    pieces = ["class ", "class", "A", " ", "\n", "public", "private ", "abstract ", "final", "{", "extends B", " implements C, D", "x", "protected\t", "classclass "]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [m.span() for m in class_heads(pattern, text)] == [m.span() for m in pattern.finditer(text)], text


def test_whole_segments_are_made_in_two_passes_over_a_file(spark, sf_dir):
    """Scored symbols and their segments come from no expression over lines, braces or matches, and each is made once."""
    from srcloom.plans import catalogue

    for name in ("segments", "most_complex_segment", "assembled_files", "compile_cascade"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2 and SY.CPP_RECORD not in plan and "EVALUATE" not in plan
