"""Text building blocks against a plain second opinion and known edge cases."""

import random
import re
import time

from pyspark.sql import functions as F

from srcloom.functions import languages as L
from srcloom.functions import text as T

BRANCH_WORDS = ["if", "else", "for", "while", "switch", "case", "catch", "PERFORM", "IF", "EVALUATE", "match"]


def block_end_of(lines, start):
    depth, opened = 0, False
    for no in range(start, len(lines) + 1):
        for ch in lines[no - 1]:
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
                if opened and depth == 0:
                    return no
    return min(start + 19, len(lines))


def complexity_of(lines, start, end):
    block = "\n".join(lines[start - 1 : end])
    hits = sum(len(re.findall(rf"\b{w}\b", block)) for w in BRANCH_WORDS)
    return min(10, 1 + hits + len(re.findall("&&", block)) + len(re.findall(r"\|\|", block)))


def random_text(rng, n_lines, pieces):
    return "\n".join("".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(n_lines))


def test_block_end_and_complexity_match_twin(spark):
    rng = random.Random(7)
    pieces = ["{", "}", "{", "}", "x", " ", "if ", "else", "é", "||", "&&", "iffy", "END-IF", "for(", "_if"]
    texts = [random_text(rng, rng.randint(1, 30), pieces) for _ in range(150)]
    texts += ["", "\n", "{" * 20 + "\n" + "}" * 20, "}\n{\n}\n}", "a\n" * 40, "{\n" * 15 + "}\n" * 14]
    rows = [(i, t, s) for i, t in enumerate(texts) for s in range(1, t.count("\n") + 2)]
    df = spark.createDataFrame(rows, "id int, content string, start int").withColumn("idx", T.line_index(F.col("content")))
    df = df.withColumn("end", T.block_end(F.col("idx"), F.col("start")))
    df = df.withColumn("score", T.complexity(F.col("idx"), F.col("start"), F.col("end")))
    for r in df.select("id", "start", "end", "score").collect():
        lines = texts[r.id].split("\n")
        assert r.end == block_end_of(lines, r.start), (texts[r.id], r.start)
        assert r.score == complexity_of(lines, r.start, r.end), (texts[r.id], r.start, r.end)


def test_blocks_of_a_large_open_and_deep_file(spark):
    """Time grows with the file: an open first block, 40 levels and closing braces without partners."""
    deep = "{\n" * 40 + "x\n" + "}\n" * 40

    def seconds(n):
        text = "{\n" + (deep + "fn f() { y }\n}\n") * n
        df = spark.createDataFrame([(text,)], "content string").withColumn("idx", T.line_index(F.col("content")))
        start = time.time()
        starts = (1, 2, 41, 60, 82, 83)
        got = df.select(*[T.block_end(F.col("idx"), F.lit(s)) for s in starts]).first()
        spent = time.time() - start
        lines = text.split("\n")
        assert list(got) == [block_end_of(lines, s) for s in starts]
        return spent

    seconds(5)
    small, large = seconds(600), seconds(6000)  # 0.1 and 1.1 MB
    assert large < 30 * max(small, 0.5), (small, large)


def test_match_table_matches_twin(spark):
    rng = random.Random(8)
    texts = [random_text(rng, rng.randint(1, 20), ["ab", "a", "b", "\n", " ", "é", "\u0001"]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for r in df.select("id", T.match_table(F.col("content"), "a\\s*b+").alias("m")).collect():
        want = [(m.group(0), texts[r.id].count("\n", 0, m.start()) + 1) for m in re.finditer(r"a[\s]*b+", texts[r.id])]
        assert [(x.text, x.start_line) for x in r.m] == want


def test_decode_and_line_counts(spark):
    df = spark.createDataFrame([(b"a\r\nb\rc\xff",), (b"",), (b"x\n",), (b"\n\n",)], "content binary")
    got = df.select(T.decode_text(F.col("content")).alias("t")).select(
        "t", T.line_count_split(F.col("t")).alias("a"), T.line_count_splitlines(F.col("t")).alias("b"),
        T.line_count_stripped(F.col("t")).alias("c"),
    ).collect()
    want = ["a\nb\nc�", "", "x\n", "\n\n"]
    assert [r.t for r in got] == want
    for r, t in zip(got, want):
        assert (r.a, r.b, r.c) == (len(t.split("\n")), len(t.splitlines()), len(t.strip().split("\n")))


def test_path_parts(spark):
    rows = [("a/b/main.cpp", "main", ".cpp", "cpp"), ("x.tar.gz", "x.tar", ".gz", "unknown"), ("d/.hidden", ".hidden", "", "unknown"),
            ("d/README", "README", "", "unknown"), ("q/A.COB", "A", ".COB", "cobol"), ("q/h.H", "h", ".H", "c")]
    df = spark.createDataFrame([(r[0],) for r in rows], "path string")
    p = F.col("path")
    got = df.select(T.stem(p), T.suffix(p), L.language_of_path(p)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_split_list_drops_empty_parts(spark):
    got = spark.range(1).select(T.split_list(F.lit(" int a, map<int, int> b,, ")).alias("p")).first().p
    assert got == ["int a", "map<int", "int> b"]


def test_match_table_by_pieces_and_by_lines(spark):
    """Few and many matches, texts that hold the marks themselves, matches over several lines and at both ends."""
    import re

    texts = ["", "ab", "\n\nab\nx ab ab\n", "a\n\nb\nab", "\u0001ab\n\u0002ab", "x\n" + "ab\n\n" * 80, "$0 \\ab\n$1ab", None, "ab\n" * 32, "ab\n" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for r in df.select("id", T.match_table(F.col("content"), "a\\s*b").alias("m")).collect():
        text = texts[r.id]
        want = None if text is None else [(m[0], text[: m.start()].count("\n") + 1) for m in re.finditer(r"a\s*b", text)]
        assert r.m == want if want is None else [tuple(x) for x in r.m] == want
