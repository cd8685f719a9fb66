"""Queries of the rewrite rules.

Statements are derived from line items, one construct each by a number of the
row; the checking SQL spells out what each must become.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import rewrite as RW
from srcloom.plans.derived import source_files, table
from srcloom.plans.registry import query
from srcloom.plans.structure_queries import FILES

_KEYS = "l_orderkey * 10 + l_linenumber as id, l_partkey as pk, cast(l_quantity as int) as q"

# (statement, what it becomes) as SQL over pk and q; ` splices a column.
CPP_TRANSFORM = [
    ("    int* p`pk` = new int[`q`];", "    let mut p`pk`: Vec<i32> = vec![0; `q`];"),
    ("Foo* p`pk` = new Foo[`q`];", "let mut p`pk`: Vec<Foo> = vec![Default::default(); `q`];"),
    ("delete p`pk`;", "drop(p`pk`);"),
    ("  delete[] p`pk`;", "  drop(p`pk`);"),
    ("std::unique_ptr<Foo> u`pk` = std::make_unique<Foo>(`q`);", "let u`pk`: Box<Foo> = Box::new(`q`);"),
    ("std::shared_ptr<double> s`pk` = std::make_shared<double>(`q`);", "let s`pk`: Rc<f64> = Rc::new(`q`);"),
    ("const int* c`pk` = &x`q`;", "let c`pk`: &i32 = &x`q`;"),
    ("double* d`pk` = &y`q`;", "let d`pk`: &mut f64 = &mut y`q`;"),
    ('std::string s`pk` = "text `q`";', 'let s`pk`: String = String::from("text `q`");'),
    ("std::string t`pk` = other`q`;", "let t`pk`: String = other`q`.clone();"),
    ("if (s`pk`.empty()) n = s.length() + t.size();", "if (s`pk`.is_empty()) n = s.len() + t.len();"),
    ('s`pk`.append("x`q`"); f(s.c_str()); g(std::to_string(n`q`));', 's`pk`.push_str("x`q`"); f(s.as_str()); g(n`q`.to_string());'),
    ("for (int i = 0; i < n`q`; i++) {", "for i in 0..n`q` {"),
    ("for (auto& it : items`q`) {", "for it in &items`q` {"),
    ("for (const auto it : items`q`) {", "for it in items`q` {"),
    ("while ( a < `q` ) {", "while a < `q` {"),
    ("typedef unsigned int uid`pk`;", "type Uid`pk` = u32;"),
    ("Foo* f`pk` = new Foo(`q`, 2);", "let f`pk`: Box<Foo> = Box::new(`q`, 2);"),
    ("x`pk` = nullptr;", "x`pk` = None;"),
    ("#include <map>", "use std::collections::HashMap;"),
    ("#include <part`pk`>", "// TODO: Rust crate for <part`pk`>"),
    ('#include "part`pk`.hpp"', "mod part`pk`;"),
    ("using namespace std;", "// no namespaces; see mod and use"),
]
CPP_HARD = [
    ("unsigned long long v`pk` = `q`;", "u64 v`pk` = `q`;"),
    ("std::vector<int> v`pk`; string t; bool b = true;", "Vec<i32> v`pk`; String t; bool b = true;"),
    ("std::map<int, double> m`pk`; char* c = nullptr;", "HashMap<i32, f64> m`pk`; char* c = None;"),
    ('  std::cout << "v " << x`pk` << std::endl;', '  println!("v {}", x`pk`);'),
    ('cout << "only `q`";', 'println!("only `q`");'),
    ('    printf("%d of %s\\n", a`pk`, b);', '    println!("{} of {}", a`pk`, b);'),
    ('printf("done `q`");', 'println!("done `q`");'),
    ("p = new Foo(`q`);", "p = Box::new(Foo::new(`q`));"),
    ("p = new Foo[`q`];", "p = vec![0; `q`];"),
    ("delete [] p`pk`;", "drop(p`pk`);"),
    ("std::shared_ptr<Foo> s`pk`;", "Arc<Foo> s`pk`;"),
    ("auto u`pk` = std::make_unique<Foo>(`q`);", "auto u`pk` = Box::new(Foo::new(`q`));"),
]
COBOL = [
    ('           DISPLAY "total `q`".', '    println!("total `q`");'),
    ('           DISPLAY "sum-of" WS-P-`pk`', '    println!("sum-of {}", ws_p_`pk`);'),
    ("           DISPLAY WS-P-`pk`.", '    println!("{}", ws_p_`pk`);'),
    ("           MOVE `q` TO WS-P-`pk`.", "    ws_p_`pk` = `q`;"),
    ('           MOVE "A-`q`" TO WS-P-`pk`', '    ws_p_`pk` = String::from("A-`q`");'),
    ("           MOVE IN-A TO WS-P-`pk`", "    ws_p_`pk` = in_a;"),
    ("           ADD `q` TO WS-P-`pk`.", "    ws_p_`pk` += `q`;"),
    ("           SUBTRACT IN-A FROM WS-P-`pk`", "    ws_p_`pk` -= in_a;"),
    ("           MULTIPLY IN-A BY IN-B GIVING WS-P-`pk`", "    ws_p_`pk` = in_a * in_b;"),
    ("           COMPUTE WS-P-`pk` = IN-A * `q`.", "    ws_p_`pk` = in_a * `q`;"),
    ("           STOP RUN.", "    return;"),
    ("           PERFORM CALC-P-`pk`.", "    calc_p_`pk`();"),
    ("           IF WS-P-`pk` GREATER THAN `q` AND IN-A NOT EQUAL TO 5", "    if ws_p_`pk` > `q` && in_a != 5 {"),
    ("           ELSE", "    } else {"),
    ("           END-IF.", "    }"),
    ("           PERFORM CALC-P UNTIL WS-P-`pk` EQUAL TO `q`", "    while !(ws_p_`pk` == `q`) {|        calc_p();|    }"),
    ("           EVALUATE WS-P-`pk`", "    match ws_p_`pk` {"),
    ("           WHEN `q`", "        `q` => {"),
    ('           WHEN "K`q`"', '        "K`q`" => {'),
    ("           WHEN OTHER", "        _ => {"),
    ("           END-EVALUATE.", "    }"),
    ("           READ FILE-`pk`", "           READ FILE-`pk`"),
]
JAVA = [
    ("x`pk` = Collections.unmodifiableList(Arrays.asList(`q`, 2));", "x`pk` = List.of(`q`, 2);"),
    ("x`pk` = Collections.unmodifiableSet(new HashSet<>(Arrays.asList(`q`)));", "x`pk` = Set.of(`q`);"),
    ("x`pk` = new HashSet<Integer>(Arrays.asList(`q`));", "x`pk` = Set.of(`q`);"),
    ("x`pk` = Collections.emptyMap();", "x`pk` = Map.of();"),
    ("x`pk` = Collections.singletonList(`q`);", "x`pk` = List.of(`q`);"),
    ("    List<String> l`pk` = new ArrayList<>();", "    var l`pk` = new ArrayList<String>();"),
    ("    HashMap<String, Integer> m`pk` = new HashMap<>(`q`);", "    var m`pk` = new HashMap<String, Integer>(`q`);"),
    ("    Foo f`pk` = new Foo(`q`);", "    var f`pk` = new Foo(`q`);"),
    ("    Foo f`pk` = new Bar(`q`);", "    Foo f`pk` = new Bar(`q`);"),
    ("List<String> l`pk` = new ArrayList<>();", "List<String> l`pk` = new ArrayList<>();"),
    ("if (o`pk` instanceof Foo) { Foo f = (Foo) o`pk`; f.run(`q`); }", "if (o`pk` instanceof Foo f) {  f.run(`q`); }"),
    ("if (o`pk` instanceof Foo) { Bar f = (Bar) o`pk`; }", "if (o`pk` instanceof Foo) { Bar f = (Bar) o`pk`; }"),
]


def _splice(text: str) -> str:
    parts = []
    for i, piece in enumerate(text.split("`")):
        if i % 2:
            parts.append(piece)
        else:
            quoted = "'" + piece.replace("'", "''") + "'"
            parts.append(f"replace({quoted}, '|', chr(10))" if "|" in piece else quoted)
    return "concat(" + ", ".join(parts) + ", '')"


def _case(rows: list[tuple[str, str]], side: int) -> str:
    arms = " ".join(f"when {i} then {_splice(r[side])}" for i, r in enumerate(rows))
    return f"case (pk + q) % {len(rows)} {arms} end"


def statements(spark, sf_dir, rows):
    # Spark reads \\ in a literal as one backslash; the checking engine does not.
    text = _case(rows, 0).replace("\\", "\\\\")
    # The keys are narrow and the work on them is not: they are dealt out anew, whatever the input's splits.
    keys = table(spark, sf_dir, "lineitem").selectExpr(*_KEYS.split(", ")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.selectExpr("id", "pk", "q", f"{text} as content")


def _statement_query(name: str, rows: list[tuple[str, str]], rules: list) -> None:
    @query(name, f"with s as (select {_KEYS} from lineitem) select id, pk, {_case(rows, 1)} as rewritten from s")
    def run(spark, sf_dir):
        return RW.rewrite(statements(spark, sf_dir, rows), rules).select("id", "pk", "rewritten")


_statement_query("rewrite_cpp_transform", CPP_TRANSFORM, RW.TRANSFORM_CPP_RULES)
_statement_query("rewrite_cpp_hard", CPP_HARD, RW.HARD_CPP_RULES)
_statement_query("rewrite_cobol", COBOL, RW.COBOL_RULES)
_statement_query("rewrite_java", JAVA, RW.JAVA_RULES)
_statement_query(
    "rewrite_one_rule",
    [
        ("x`pk` = Collections.singleton(`q`);", "x`pk` = Set.of(`q`);"),
        ("x`pk` = Collections.emptyList();", "x`pk` = List.of();"),
        ("x`pk` = new Foo(`q`);", "x`pk` = new Foo(`q`);"),
    ],
    RW.named([RW.JAVA_COLLECTIONS_HARD, RW.CPP_MEMORY], "java_collections_modern"),
)
_statement_query("rewrite_version_gate", [(a, b if i < 5 else a) for i, (a, b) in enumerate(JAVA)], RW.up_to_version(RW.JAVA_RULES, 9))

_TYPES_SQL = "content"
for _p, _r in [
    (r"\bint\b", "i32"), (r"\bvoid\b", "()"), (r"\bstd::vector<([^>]+)>", r"Vec<\1>"), (r"\bNULL\b", "None"),
]:
    _TYPES_SQL = f"regexp_replace({_TYPES_SQL}, '{_p}', '{_r}', 'g')"
_CPP = FILES + ", cpp as (select path, content from files where language = 'cpp'), "
_CPP_TYPES = _CPP + f"typed as (select path, content, {_TYPES_SQL} as rewritten from cpp)"


def _cpp(spark, sf_dir):
    return source_files(spark, sf_dir).where("language = 'cpp'")


@query("rewrite_cpp_types", _CPP_TYPES + """ select path, md5(rewritten) as digest, list_sum(list_transform(list_zip(string_split(content, chr(10)), string_split(rewritten, chr(10))),
  lambda p: case when p[1] <> p[2] then 1 else 0 end)) as lines_changed from typed""")
def rewrite_cpp_types(spark, sf_dir):
    out = RW.rewrite(_cpp(spark, sf_dir), [RW.CPP_TYPES])
    return out.select("path", F.md5("rewritten").alias("digest"), F.col("rewrite_log")[0]["n_changes"].alias("lines_changed"))


@query("rewrite_line_diff", _CPP_TYPES + """, diffs as (select path, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no,
    unnest(string_split(content, chr(10))) as old, unnest(string_split(rewritten, chr(10))) as new from typed)
  select path, line_no, old, new, row_number() over (partition by path order by line_no) <= 30 as shown from diffs where old <> new""")
def rewrite_line_diff(spark, sf_dir):
    return RW.line_diff(RW.rewrite(_cpp(spark, sf_dir), [RW.CPP_TYPES]), "content", "rewritten", "path")


@query("rewrite_includes", _CPP + r"""mapped as (select path, 2 as n_includes,
    replace(replace(content, concat('#include <stdio.h>', chr(10)), concat('// TODO: find Rust equivalent for stdio', chr(10))), '#include <vector>', '// Vec is built-in') as t from cpp)
  select path, n_includes, md5(t) as digest from mapped""")
def rewrite_includes(spark, sf_dir):
    return _cpp(spark, sf_dir).select(
        "path", RW.count_includes(F.col("content")).alias("n_includes"), F.md5(RW.map_includes(F.col("content"))).alias("digest")
    )


# Whole files by the rule set of their migration: includes, types and output of C++, collections of Java, Rust as it is.
@query("rewrite_corpus", FILES + rf""", mapped as (select path, language, replace(replace(content, '#include <stdio.h>', '// TODO: find Rust equivalent for stdio'), '#include <vector>', '// Vec is built-in') as content from files),
    typed as (select path, language, content as old, {_TYPES_SQL} as typed from mapped where language = 'cpp'),
    out as (select path, language, regexp_replace(typed, 'printf\("([^"]*)"\);', 'println!("\1");', 'g') as rewritten,
        2 + list_sum(list_transform(list_zip(string_split(old, chr(10)), string_split(typed, chr(10))), lambda p: case when p[1] <> p[2] then 1 else 0 end))
          + len(regexp_extract_all(typed, 'printf\("')) as n from typed
      union all select path, language, regexp_replace(content, 'Arrays\.asList\(([^)]*)\)', 'List.of(\1)', 'g'), len(regexp_extract_all(content, 'Arrays\.asList\(([^)]*)\)')) from files where language = 'java'
      union all select path, language, content, 0 from files where language = 'rust')
  select path, language, md5(rewritten) as digest, n::bigint as n_changes from out""")
def rewrite_corpus(spark, sf_dir):
    files = source_files(spark, sf_dir).where("language <> 'cobol'")
    return RW.rewrite_corpus(files).select(
        "path", "language", F.md5("rewritten").alias("digest"),
        F.aggregate("rewrite_log", F.lit(0), lambda n, r: n + r["n_changes"]).cast("bigint").alias("n_changes"),
    )


_JAVA_LOG = FILES + r""", logged as (select path, len(regexp_extract_all(content, 'Arrays\.asList\(([^)]*)\)')) as n from files where language = 'java')"""


@query("rewrite_change_log", _JAVA_LOG + " select path, 0 as step, 'java_collections_modern' as rule, n as n_changes, n > 0 as modified from logged")
def rewrite_change_log(spark, sf_dir):
    java = source_files(spark, sf_dir).where("language = 'java'")
    return RW.change_log(RW.rewrite(java, [RW.JAVA_COLLECTIONS_HARD]), "path")


@query("rewrite_summary", FILES + r""", counted as (select language, len(regexp_extract_all(content, 'Arrays\.asList\(([^)]*)\)')) as n from files)
  select language, count(*) as files_processed, count(*) filter (where n > 0) as files_modified, sum(n) as total_changes from counted group by language""")
def rewrite_summary(spark, sf_dir):
    return RW.rewrite_summary(RW.rewrite(source_files(spark, sf_dir), [RW.JAVA_COLLECTIONS_HARD]), "language")


@query("cobol_fields", FILES + " select path, lower(stem) as program, 0 as field_ord, 'ws_a' as name, '9(5)' as picture, 'i32' as type from files where language = 'cobol'")
def cobol_fields(spark, sf_dir):
    return RW.cobol_fields(source_files(spark, sf_dir).where("language = 'cobol'"))


@query("record_fields", FILES + " select path, replace(stem, 'f', 'S') as record, 0 as field_ord, 'x' as field, 'i32' as rust_type from files where language = 'cpp'")
def record_fields(spark, sf_dir):
    return RW.record_fields(_cpp(spark, sf_dir))


@query("enum_values", """with s as (select l_orderkey * 10 + l_linenumber as id, l_partkey as pk, l_suppkey as sk from lineitem)
  select concat('e', id, '_', pk, '_', sk) as path, concat('E', pk) as enum, unnest([0, 1]) as value_ord, unnest(['LowStock', concat('Part', sk)]) as value from s""")
def enum_values(spark, sf_dir):
    enums = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('e', l_orderkey * 10 + l_linenumber, '_', l_partkey, '_', l_suppkey) as path",
        "concat('enum E', l_partkey, ' { LOW_STOCK = 1, part_', l_suppkey, ' };') as content",
    )
    return RW.enum_values(enums)


_CENSUS = FILES + r""", patterns(construct, pattern) as (values ('arrays_as_list', 'Arrays\.asList\(([^)]*)\)'), ('picture', '(?i)PIC\s+[9XSV]'),
  ('printf', '\bprintf\s*\('), ('include', '#include'), ('perform', '(?i)\bPERFORM\b'), ('display', '(?i)\bDISPLAY\b')),
  counted as (select language, construct, len(regexp_extract_all(content, pattern)) as hits from files, patterns)"""


@query("construct_census", _CENSUS + " select language, construct, sum(hits) as n_hits, count(*) filter (where hits > 0) as n_files from counted group by all")
def construct_census(spark, sf_dir):
    return RW.census(source_files(spark, sf_dir), RW.LEGACY_CONSTRUCTS, "language")


@query("counted_constructs", """with s as (select l_partkey % 3 as kind from lineitem) select construct, sum(case when kind = k then 1 else 0 end) as n_hits,
  sum(case when kind = k then 1 else 0 end) as n_files from s, (values ('text_block', 0), ('switch_assign', 1)) as c(construct, k) group by construct""")
def counted_constructs(spark, sf_dir):
    code = table(spark, sf_dir, "lineitem").selectExpr(
        """case l_partkey % 3 when 0 then concat('String s = "a', l_partkey, '" + "b" + "c";')
           when 1 then concat('    String label;', chr(10), '    switch (code', l_partkey, ') {') else 'int x;' end as content"""
    )
    return RW.census(code, RW.COUNTED_CONSTRUCTS)
