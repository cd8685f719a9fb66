"""Rule-table rewrites of source text, as a batch job.

A rule is data. Text rules are ordered (pattern, replacement) steps over the
whole text; line rules give a new line for a line they know. Both stay in the
file's row; the log of a rewrite is a column beside the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import languages as L
from srcloom.functions import text as T
from srcloom.functions.text import ML, S, W, WB, WE, WORD

ONCE = "once"


@dataclass(frozen=True)
class Step:
    """``count`` says what adds to the changes: the matches of the pattern (None),
    of another pattern, ``ONCE`` for any match, or nothing (""). ``needs`` is a
    text every match holds: without it no pattern is run, which is the usual case."""

    pattern: str
    replacement: str
    count: str | None = None
    needs: str = ""


@dataclass(frozen=True)
class TextRule:
    name: str
    steps: tuple[Step, ...]
    version: int = 0
    # Changes are the lines that differ from the input, by position.
    by_lines: bool = False


@dataclass(frozen=True)
class LineRule:
    """``new_line`` is null for a line the rule leaves alone."""

    name: str
    new_line: Callable[[Column], Column]
    version: int = 0


@dataclass(frozen=True)
class FileRule:
    """Sees the whole text: ``new_text`` of it, and ``changes`` counted on it."""

    name: str
    new_text: Callable[[Column], Column]
    changes: Callable[[Column], Column]
    version: int = 0


Rule = TextRule | LineRule | FileRule
# Rules may set these marks for the rules after them; marks of the source are escaped while rules run.
_TYPED = "\u0001"
_DEFAULT = "\u0002"
_ESCAPE = "\u0003"


def _steps(*rows: tuple[str, ...]) -> tuple[Step, ...]:
    """Steps from (pattern, replacement) or (pattern, replacement, needed text)."""
    return tuple(Step(r[0], r[1], needs=r[2] if len(r) > 2 else "") for r in rows)


def differing_lines(before: Column, after: Column) -> Column:
    """Lines that differ, by position, up to the shorter text."""
    differ = F.zip_with(
        T.split_lines(before), T.split_lines(after), lambda a, b: F.coalesce(a != b, F.lit(False))
    )
    return F.size(F.filter(differ, lambda d: d))


def _apply_to_lines(text: Column, rule: LineRule) -> Column:
    return F.transform(
        T.split_lines(text), lambda x: F.struct(x.alias("old"), rule.new_line(x).alias("new"))
    )


def rewrite(files: DataFrame, rules: list[Rule], text: str = "content") -> DataFrame:
    """Adds ``rewritten`` and ``rewrite_log``, one entry per rule in order."""
    out = files.withColumn("rewritten", T.escape(F.col(text), _TYPED + _DEFAULT, _ESCAPE))
    log = []
    for i, rule in enumerate(rules):
        before, changes = f"__before_{i}", f"__changes_{i}"
        out = out.withColumn(before, F.col("rewritten"))
        if isinstance(rule, LineRule):
            out = out.withColumn("__lines", _apply_to_lines(F.col("rewritten"), rule))
            out = out.withColumn(
                changes, F.size(F.filter("__lines", lambda x: x["new"].isNotNull()))
            ).withColumn(
                "rewritten", F.array_join(F.transform("__lines", lambda x: F.coalesce(x["new"], x["old"])), "\n")
            ).drop("__lines")
        elif isinstance(rule, FileRule):
            out = out.withColumns({changes: rule.changes(F.col("rewritten")), "rewritten": rule.new_text(F.col("rewritten"))})
        else:
            out = out.withColumn(changes, F.lit(0))
            for step in rule.steps:
                current = F.col("rewritten")
                if rule.by_lines or step.count == "":
                    hits = F.lit(0)
                elif step.count == ONCE:
                    hits = current.rlike(step.pattern).cast("int")
                elif step.count is None:
                    hits = T.count_matches(current, step.pattern)
                else:
                    hits = F.when(current.rlike(step.pattern), T.count_matches(current, step.count)).otherwise(0)
                changed = F.regexp_replace(current, step.pattern, step.replacement)
                if step.needs:
                    present = current.contains(step.needs)
                    hits, changed = F.when(present, hits).otherwise(0), F.when(present, changed).otherwise(current)
                out = out.withColumns({changes: F.col(changes) + hits, "rewritten": changed})
            if rule.by_lines:
                out = out.withColumn(changes, differing_lines(F.col(before), F.col("rewritten")))
        log.append(
            F.struct(
                F.lit(i).alias("step"), F.lit(rule.name).alias("rule"), F.col(changes).alias("n_changes"),
                (F.col(before) != F.col("rewritten")).alias("modified"),
            )
        )
    empty = F.array().cast("array<struct<step:int,rule:string,n_changes:int,modified:boolean>>")
    out = out.withColumn("rewrite_log", F.array(*log) if log else empty)
    out = out.withColumn("rewritten", T.unescape(F.col("rewritten"), _TYPED + _DEFAULT, _ESCAPE))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def rewrite_corpus(files: DataFrame, migrations: dict[str, str] | None = None) -> DataFrame:
    """Every file by the rule set of its language's migration; other files stay as they are, with an empty log."""
    migrations = migrations or {"cobol": "cobol_to_rust", "cpp": "cpp_to_rust", "c": "cpp_to_rust", "java": "java8_to_java17"}
    known: dict[str, list[str]] = {}
    for language, migration in migrations.items():
        known.setdefault(migration, []).append(language)
    language = F.coalesce("language", F.lit(""))
    parts = [rewrite(files.where(language.isin(*names)), RULE_SETS[m]) for m, names in known.items()]
    parts.append(rewrite(files.where(~language.isin(*migrations)), []))
    return reduce(DataFrame.unionByName, parts)


def up_to_version(rules: list, version: int) -> list:
    return [r for r in rules if r.version <= version]


def named(rules: list, name: str) -> list:
    return [r for r in rules if r.name == name]


def change_log(rewritten: DataFrame, *keys: str) -> DataFrame:
    return rewritten.select(*keys, F.inline_outer("rewrite_log"))


def rewrite_summary(rewritten: DataFrame, *keys: str) -> DataFrame:
    total = F.aggregate("rewrite_log", F.lit(0), lambda acc, r: acc + r["n_changes"])
    modified = F.exists("rewrite_log", lambda r: r["modified"])
    return (
        rewritten.select(*keys, total.alias("n"), modified.alias("modified")).groupBy(*keys).agg(
            F.count("*").alias("files_processed"), F.count_if("modified").alias("files_modified"),
            F.sum("n").alias("total_changes"),
        )
    )


DIFF_LINES = 30


def line_diff(rewritten: DataFrame, before: str, after: str, *keys: str) -> DataFrame:
    """Differing lines by position, numbered; the first 30 are marked as shown."""
    pairs = F.arrays_zip(T.split_lines(F.col(before)).alias("old"), T.split_lines(F.col(after)).alias("new"))
    numbered = F.transform(
        pairs, lambda p, i: F.struct((i + 1).alias("line_no"), p["old"].alias("old"), p["new"].alias("new"))
    )
    different = F.filter(numbered, lambda p: ~p["old"].eqNullSafe(p["new"]))
    rows = rewritten.select(*keys, F.posexplode_outer(different).alias("k", "d")).where(F.col("k").isNotNull())
    return rows.select(*keys, "d.*", (F.col("k") < DIFF_LINES).alias("shown"))


def census(files: DataFrame, patterns: dict[str, str], *keys: str, text: str = "content") -> DataFrame:
    """Hits of each pattern and the files that hold it, per key."""
    counted = F.array(
        *[
            F.struct(F.lit(n).alias("construct"), T.count_matches(F.col(text), p).alias("hits"))
            for n, p in patterns.items()
        ]
    )
    return (
        files.select(*keys, F.inline_outer(counted)).groupBy(*keys, "construct")
        .agg(F.sum("hits").alias("n_hits"), F.count_if(F.col("hits") > 0).alias("n_files"))
    )


# --- names -----------------------------------------------------------------------


def snake_names(text: Column) -> Column:
    """COBOL-NAMES to snake_case: every word with an inner hyphen."""

    def one(token: Column) -> Column:
        lead = F.regexp_extract(token, "^(-*)", 1)
        trail = F.regexp_extract(token, "(-*)$", 1)
        core = F.substring(token, F.length(lead) + 1, F.length(token) - F.length(lead) - F.length(trail))
        return F.when(
            token.rlike(f"{W}-+{W}"), F.concat(lead, F.replace(F.lower(core), F.lit("-"), F.lit("_")), trail)
        ).otherwise(token)

    return F.array_join(F.transform(T.find_all(text, f"[{WORD}-]+|[^{WORD}-]+"), one), "")


def snake_outside_quotes(text: Column) -> Column:
    """The same, but quoted text stays; an open quote does not quote."""

    def by_part(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            open_end = (i == F.size(parts) - 1) & (F.size(parts) % 2 == 0)
            return F.when((i % 2 == 0) | open_end, snake_names(part)).otherwise(part)

        return F.array_join(F.transform(parts, one), '"')

    return F.when(text.contains("-"), T.let(F.split(text, '"', -1), by_part)).otherwise(text)


def hyphens_to_snake(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


# --- COBOL to Rust ---------------------------------------------------------------

_N = rf"([{WORD}-]+)"
_END = rf"\.?{S}*$"
# Verbs by line, the first that fits wins.
COBOL_VERBS = [
    (rf'(?i)^{S}*DISPLAY{S}+"([^"]*)"{_END}', '    println!("$1");'),
    (rf'(?i)^{S}*DISPLAY{S}+"([^"]*)"{S}+{_N}{_END}', '    println!("$1 {}", $2);'),
    (rf"(?i)^{S}*DISPLAY{S}+{_N}{_END}", '    println!("{}", $1);'),
    (rf"(?i)^{S}*MOVE{S}+(\p{{Nd}}+){S}+TO{S}+{_N}{_END}", "    $2 = $1;"),
    (rf'(?i)^{S}*MOVE{S}+"([^"]*)"{S}+TO{S}+{_N}{_END}', '    $2 = String::from("$1");'),
    (rf"(?i)^{S}*MOVE{S}+{_N}{S}+TO{S}+{_N}{_END}", "    $2 = $1;"),
    (rf"(?i)^{S}*ADD{S}+(\p{{Nd}}+){S}+TO{S}+{_N}{_END}", "    $2 += $1;"),
    (rf"(?i)^{S}*ADD{S}+{_N}{S}+TO{S}+{_N}{_END}", "    $2 += $1;"),
    (rf"(?i)^{S}*SUBTRACT{S}+(\p{{Nd}}+){S}+FROM{S}+{_N}{_END}", "    $2 -= $1;"),
    (rf"(?i)^{S}*SUBTRACT{S}+{_N}{S}+FROM{S}+{_N}{_END}", "    $2 -= $1;"),
    (rf"(?i)^{S}*MULTIPLY{S}+{_N}{S}+BY{S}+{_N}{S}+GIVING{S}+{_N}{_END}", "    $3 = $1 * $2;"),
    (rf"(?is)^{S}*COMPUTE{S}+{_N}{S}*={S}*(.+?){_END}", "    $1 = $2;"),
    (rf"(?i)^{S}*STOP{S}+RUN{_END}", "    return;"),
    (rf"(?i)^{S}*PERFORM{S}+{_N}{_END}", "    $1();"),
]
_ANY_VERB = rf"(?i)^{S}*(?:DISPLAY|MOVE|ADD|SUBTRACT|MULTIPLY|COMPUTE|STOP|PERFORM){S}"
_ANY_CONTROL = rf"(?i)^{S}*(?:IF|ELSE|END-IF|PERFORM|EVALUATE|WHEN|END-EVALUATE)(?:{S}|\.|$)"
# Conditions and their Rust operators.
COBOL_CONDITIONS = [
    (rf"(?i){WB}NOT{S}+EQUAL{S}+TO{WE}", "!="),
    (rf"(?i){WB}GREATER{S}+THAN{WE}", ">"),
    (rf"(?i){WB}LESS{S}+THAN{WE}", "<"),
    (rf"(?i){WB}EQUAL{S}+TO{WE}", "=="),
    (rf"(?i){WB}NOT{S}*>", "<="),
    (rf"(?i){WB}NOT{S}*<", ">="),
    (rf"(?i){WB}AND{WE}", "&&"),
    (rf"(?i){WB}OR{WE}", "||"),
    (rf"(?i){WB}NOT{WE}", "!"),
]


def _verb_line(line: Column) -> Column:
    chosen = None
    for pattern, replacement in COBOL_VERBS:
        new = F.regexp_replace(line, pattern, replacement)
        chosen = F.when(line.rlike(pattern), new) if chosen is None else chosen.when(line.rlike(pattern), new)
    return F.when(line.rlike(_ANY_VERB), T.let(chosen, snake_outside_quotes))


def cobol_condition(condition: Column) -> Column:
    out = T.strip(condition)
    for pattern, replacement in COBOL_CONDITIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return snake_names(out)


def _control_line(line: Column) -> Column:
    word = lambda *names: line.rlike(rf"(?i)^{S}*(?:{'|'.join(names)})\.?{S}*$")
    is_if = rf"(?is)^{S}*IF{S}+(.+?){_END}"
    until = rf"(?is)^{S}*PERFORM{S}+{_N}{S}+UNTIL{S}+(.+?){_END}"
    evaluate = rf"(?i)^{S}*EVALUATE{S}+{_N}{_END}"
    when = rf'(?i)^{S}*WHEN{S}+"?([^"\n\t \r\f\x0B]+)"?{_END}'
    get = lambda p, g: F.regexp_extract(line, p, g)
    value = get(when, 1)
    arm = (
        F.when(F.upper(value) == "OTHER", "        _ => {")
        .when(value.rlike(r"^[+-]?\p{Nd}+(_\p{Nd}+)*$"), F.concat(F.lit("        "), value, F.lit(" => {")))
        .otherwise(F.concat(F.lit('        "'), value, F.lit('" => {')))
    )
    chosen = (
        F.when(
            line.rlike(is_if) & ~line.rlike("(?i)END-IF"),
            F.concat(F.lit("    if "), cobol_condition(get(is_if, 1)), F.lit(" {")),
        )
        .when(word("ELSE"), F.lit("    } else {"))
        .when(word("END-IF"), F.lit("    }"))
        .when(
            line.rlike(until),
            F.concat(
                F.lit("    while !("), cobol_condition(get(until, 2)), F.lit(") {\n        "),
                hyphens_to_snake(get(until, 1)), F.lit("();\n    }"),
            ),
        )
        .when(line.rlike(evaluate), F.concat(F.lit("    match "), hyphens_to_snake(get(evaluate, 1)), F.lit(" {")))
        .when(line.rlike(when), arm)
        .when(word("END-EVALUATE"), F.lit("    }"))
    )
    return F.when(line.rlike(_ANY_CONTROL), chosen)


COBOL_RULES = [
    LineRule("cobol_verbs_to_rust", _verb_line),
    LineRule("cobol_control_flow_to_rust", _control_line),
]

_DIVISION = rf"(?i)^{S}*{W}[{WORD}-]*{S}+DIVISION"
_FIELD = rf"(?is)^{S}*(?:01|77){S}+{_N}{S}+PIC{S}+(.+?){_END}"
_PROGRAM = rf"(?im){ML}^{S}*PROGRAM-ID\.{S}*{_N}\.?{S}*$"


def cobol_fields(files: DataFrame) -> DataFrame:
    """Elementary 01/77 items of the data division, with the program they are in."""

    def numbered(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: F.struct(i.alias("no"), x.alias("line"), F.upper(x).alias("upper")))

    def pick(rows: Column) -> Column:
        marks = F.filter(
            rows, lambda r: r["line"].rlike(_DIVISION) & r["upper"].rlike("DATA|PROCEDURE")
        )
        items = F.filter(rows, lambda r: r["line"].rlike(_FIELD))
        return T.let(
            marks,
            lambda ms: F.filter(
                items,
                lambda r: F.coalesce(
                    F.try_element_at(F.filter(ms, lambda m: m["no"] < r["no"]), F.lit(-1))["upper"].contains("DATA"),
                    F.lit(False),
                ),
            ),
        )

    from srcloom.sources.fixed_width import picture_type

    program = F.try_element_at(T.find_all(F.col("content"), _PROGRAM, 1), F.lit(-1))
    rows = files.select(
        "path", F.coalesce(hyphens_to_snake(program), F.lit("program")).alias("program"),
        F.posexplode_outer(T.let(numbered(T.split_lines(F.col("content"))), pick)).alias("field_ord", "f"),
    ).where(F.col("field_ord").isNotNull())
    picture = F.rtrim(T.strip(F.regexp_extract("f.line", _FIELD, 2)), F.lit("."))
    return rows.select(
        "path", "program", "field_ord", hyphens_to_snake(F.regexp_extract("f.line", _FIELD, 1)).alias("name"),
        picture.alias("picture"), picture_type(picture).alias("type"),
    )


# --- C++ to Rust: the hard rules ----------------------------------------------------

# Headers and their Rust lines.
HARD_INCLUDES = {
    "iostream": "// use std::io; (println! no necesita import)",
    "vector": "// Vec is built-in", "string": "// String is built-in",
    "map": "use std::collections::HashMap;", "unordered_map": "use std::collections::HashMap;",
    "set": "use std::collections::HashSet;", "unordered_set": "use std::collections::HashSet;",
    "memory": "// Box, Rc, Arc are in std",
    "fstream": "use std::fs::File;\nuse std::io::{BufRead, BufReader, Write};",
    "algorithm": "// iterators have sort, find, etc.", "functional": "// closures are built-in",
    "numeric": "// iter().sum(), iter().product()", "cmath": "// use f64 methods: sqrt(), abs(), etc.",
    "math.h": "// use f64 methods", "stdio.h": "// use println!, eprintln!", "stdlib.h": "// use std::process",
    "cstdlib": "// use std::process", "cassert": "// use assert!, debug_assert!", "thread": "use std::thread;",
    "mutex": "use std::sync::Mutex;", "atomic": "use std::sync::atomic::{AtomicBool, AtomicI32, Ordering};",
}
TRANSFORM_INCLUDES = {
    "iostream": "use std::io::{self, Write};", "fstream": "use std::fs;", "sstream": "use std::fmt;",
    "vector": "// Vec<T> está en el prelude de Rust", "string": "// String y &str están en el prelude de Rust",
    "map": "use std::collections::HashMap;", "unordered_map": "use std::collections::HashMap;",
    "set": "use std::collections::HashSet;", "unordered_set": "use std::collections::HashSet;",
    "algorithm": "// Rust usa iteradores y métodos de Iterator trait",
    "memory": "use std::rc::Rc;\nuse std::sync::Arc;", "cmath": "// Rust: use f64 methods directly",
    "math.h": "// Rust: use f64 methods directly", "cstdlib": "use std::process;",
    "cstdio": "use std::io::{self, Write};", "cassert": "// Rust: use assert!() macro",
    "mutex": "use std::sync::Mutex;", "thread": "use std::thread;", "functional": "// Rust: closures are native",
    "optional": "// Rust: Option<T> está en el prelude", "variant": "// Rust: use enum para variantes",
    "array": "// Rust: arrays [T; N] son nativos", "deque": "use std::collections::VecDeque;",
    "queue": "use std::collections::VecDeque;", "stack": "// Rust: use Vec<T> como stack (push/pop)",
    "utility": "// Rust: tuples son nativos",
}
INCLUDE_LINE = rf'^{S}*#include{S}*[<"]({W}+)(?:\.{W}+)?[>"]'


def map_includes(text: Column) -> Column:
    """Include lines to their Rust lines; a line already given is not repeated."""
    header = lambda x: F.regexp_extract(x, INCLUDE_LINE, 1)

    def mapped(line: Column) -> Column:
        todo = F.concat(F.lit("// TODO: find Rust equivalent for "), header(line))
        return F.struct(
            line.alias("line"),
            F.when(line.rlike(INCLUDE_LINE), F.coalesce(L.lookup(HARD_INCLUDES, header(line)), todo)).alias("rust"),
        )

    def emit(rows: Column) -> Column:
        kept = F.filter(
            rows,
            lambda r, i: r["rust"].isNull() | (F.array_position(rows["rust"], r["rust"]) == i + 1),
        )
        return F.array_join(F.transform(kept, lambda r: F.coalesce(r["rust"], r["line"])), "\n")

    return T.let(F.transform(T.split_lines(text), mapped), emit)


def count_includes(text: Column) -> Column:
    return F.size(F.filter(T.split_lines(text), lambda x: x.rlike(INCLUDE_LINE)))


CPP_INCLUDES = FileRule("cpp_includes_to_rust", map_includes, count_includes)


# Types in order, longest first.
CPP_TYPES = TextRule(
    "cpp_types_to_rust",
    _steps(
        *[
            (rf"{WB}{a.replace(' ', S + '+')}{WE}", b, a.split(" ")[-1])
            for a, b in [
                ("unsigned long long", "u64"), ("long long", "i64"), ("unsigned long", "u64"),
                ("unsigned int", "u32"), ("unsigned char", "u8"), ("long double", "f64"), ("long", "i64"),
                ("double", "f64"), ("float", "f32"), ("char", "char"), ("bool", "bool"), ("size_t", "usize"),
                ("int", "i32"), ("void", "()"), ("std::string", "String"), ("string", "String"),
            ]
        ],
        (rf"{WB}std::vector<([^>]+)>", "Vec<$1>", "vector<"),
        (rf"{WB}vector<([^>]+)>", "Vec<$1>", "vector<"),
        (rf"{WB}std::map<([^,]+),{S}*([^>]+)>", "HashMap<$1, $2>", "std::map<"),
        (rf"{WB}std::set<([^>]+)>", "HashSet<$1>", "std::set<"),
        (rf"{WB}nullptr{WE}", "None", "nullptr"),
        (rf"{WB}NULL{WE}", "None", "NULL"),
        (rf"{WB}true{WE}", "true", "true"),
        (rf"{WB}false{WE}", "false", "false"),
    ),
    by_lines=True,
)

_COUT = rf"(?s)^({S}*)(?:std::)?cout{S}*<<{S}*(.+?){S}*;.*$"
_PRINTF = rf'(?s)^({S}*)printf{S}*\({S}*"([^"]*)"(?:{S}*,{S}*(.+?))?{S}*\){S}*;.*$'
_LINE_BREAKS = ("std::endl", "endl", '"\\n"', "'\\n'")
# Format letters.
PRINTF_SPECIFIERS = [
    ("%d", "{}"), ("%i", "{}"), ("%f", "{:.2}"), ("%lf", "{:.2}"), ("%s", "{}"), ("%c", "{}"), ("%ld", "{}"),
    ("%lu", "{}"), ("\\n", ""),
]


def _println(indent: Column, form: Column, args: Column) -> Column:
    tail = F.when(args != "", F.concat(F.lit('", '), args, F.lit(");"))).otherwise(F.lit('");'))
    return F.concat(indent, F.lit('println!("'), form, tail)


def _output_line(line: Column) -> Column:
    indent = F.regexp_extract(line, _COUT, 1)
    pieces = F.filter(
        F.transform(F.split(F.regexp_extract(line, _COUT, 2), f"{S}*<<{S}*", -1), T.strip),
        lambda p: ~p.isin(*_LINE_BREAKS),
    )
    quoted = lambda p: p.startswith('"') & p.endswith('"')
    cout = T.let(
        pieces,
        lambda ps: _println(
            indent,
            F.array_join(
                F.transform(ps, lambda p: F.when(quoted(p), F.substring(p, F.lit(2), F.greatest(F.length(p) - 2, F.lit(0)))).otherwise("{}")), ""
            ),
            F.array_join(F.filter(ps, lambda p: ~quoted(p)), ", "),
        ),
    )
    form = F.regexp_extract(line, _PRINTF, 2)
    for spec, rust in PRINTF_SPECIFIERS:
        form = F.replace(form, F.lit(spec), F.lit(rust))
    printf = _println(F.regexp_extract(line, _PRINTF, 1), form, F.regexp_extract(line, _PRINTF, 3))
    return F.when(line.rlike(_COUT), cout).when(line.rlike(_PRINTF), printf)


CPP_OUTPUT = LineRule("cpp_output_to_rust", _output_line)
# Patterns and what replaces them.
CPP_MEMORY = TextRule(
    "cpp_memory_to_rust",
    (
        Step(rf"{WB}new{S}+({W}+)\(([^)]*)\)", "Box::new($1::new($2))", rf"{WB}new{S}+{W}+\(", needs="new"),
        Step(rf"{WB}new{S}+({W}+)\[([^\]]+)\]", "vec![0; $2]", ONCE, needs="new"),
        Step(rf"{WB}delete{S}*(?:\[\])?{S}*({W}+){S}*;", "drop($1);", rf"{WB}delete{WE}", needs="delete"),
        Step(rf"{WB}std::unique_ptr<({W}+)>", "Box<$1>", "", needs="unique_ptr"),
        Step(rf"{WB}std::shared_ptr<({W}+)>", "Arc<$1>", "", needs="shared_ptr"),
        Step(rf"{WB}std::make_unique<({W}+)>\(([^)]*)\)", "Box::new($1::new($2))", "", needs="make_unique"),
        Step(rf"{WB}std::make_shared<({W}+)>\(([^)]*)\)", "Arc::new($1::new($2))", "", needs="make_shared"),
    ),
)
HARD_CPP_RULES = [CPP_INCLUDES, CPP_TYPES, CPP_OUTPUT, CPP_MEMORY]

# --- C++ to Rust: the transform rules -------------------------------------------------

# Single types of the transform rules.
TRANSFORM_TYPES = {
    "int": "i32", "long": "i64", "short": "i16", "char": "char", "float": "f32", "double": "f64", "bool": "bool",
    "unsigned int": "u32", "unsigned long": "u64", "unsigned short": "u16", "unsigned char": "u8",
    "size_t": "usize", "void": "()",
}
_ZERO_TYPES = "i32|i64|i16|f32|f64|u32|u64|u16|u8|usize"


def _resolve_types() -> tuple[Step, ...]:
    """Types caught by a rule stand between marks; look them up and drop the marks."""
    named_types = [Step(f"{_TYPED}{a}{_TYPED}", b, "", _TYPED) for a, b in TRANSFORM_TYPES.items() if " " not in a]
    return (*named_types, Step(_TYPED, "", "", _TYPED))


_PTR = rf"{S}*\*{S}*"
# Patterns and what replaces them.
TRANSFORM_MEMORY = TextRule(
    "Memory Management → Ownership",
    (
        Step(rf"{ML}^({S}*)({W}+){_PTR}({W}+){S}*={S}*new{S}+{W}+\(([^)]*)\);", f"$1let $3: Box<{_TYPED}$2{_TYPED}> = Box::new($4);", needs="new"),
        Step(rf"{ML}^({S}*)delete{S}+({W}+);", "$1drop($2);", needs="delete"),
        Step(rf"{ML}^({S}*)delete{S}*\[\]{S}*({W}+);", "$1drop($2);", needs="delete"),
        Step(
            rf"{ML}^({S}*)std::unique_ptr<({W}+)>{S}+({W}+){S}*={S}*std::make_unique<{W}+>\(([^)]*)\);",
            f"$1let $3: Box<{_TYPED}$2{_TYPED}> = Box::new($4);", needs="make_unique",
        ),
        Step(
            rf"{ML}^({S}*)std::shared_ptr<({W}+)>{S}+({W}+){S}*={S}*std::make_shared<{W}+>\(([^)]*)\);",
            f"$1let $3: Rc<{_TYPED}$2{_TYPED}> = Rc::new($4);", needs="make_shared",
        ),
        Step(rf"{WB}nullptr{WE}", "None", ONCE, needs="nullptr"),
        *_resolve_types(),
    ),
)
# Patterns and what replaces them.
TRANSFORM_POINTERS = TextRule(
    "Raw Pointers → Safe References",
    (
        Step(rf"(?d)const{S}+({W}+){_PTR}({W}+){S}*={S}*(.+?);", f"let $2: &{_TYPED}$1{_TYPED} = $3;", needs="const"),
        Step(rf"{ML}^({S}*)({W}+){_PTR}({W}+){S}*={S}*&({W}+);", f"$1let $3: &mut {_TYPED}$2{_TYPED} = &mut $4;", needs="&"),
        Step(
            rf"{ML}^({S}*)({W}+){_PTR}({W}+){S}*={S}*new{S}+{W}+\[(.+?)\];",
            f"$1let mut $3: Vec<{_TYPED}$2{_TYPED}> = vec![{_DEFAULT}{_TYPED}$2{_TYPED}{_DEFAULT}; $4];", needs="new",
        ),
        *_resolve_types(),
        Step(f"{_DEFAULT}(?:{_ZERO_TYPES}){_DEFAULT}", "0", "", _DEFAULT),
        Step(f"{_DEFAULT}[^{_DEFAULT}]*{_DEFAULT}", "Default::default()", "", _DEFAULT),
    ),
)
# Patterns and what replaces them.
TRANSFORM_STRINGS = TextRule(
    "std::string → String/&str",
    (
        Step(rf'{ML}^({S}*)std::string{S}+({W}+){S}*={S}*("(?:[^"\\]|\\.)*");', "$1let $2: String = String::from($3);", needs="std::string"),
        Step(rf"{ML}^({S}*)std::string{S}+({W}+){S}*={S}*({W}+);", "$1let $2: String = $3.clone();", needs="std::string"),
        Step(r"\.(?:length|size)\(\)", ".len()", ONCE),
        Step(r"\.append\(([^)]+)\)", ".push_str($1)", ONCE, needs=".append"),
        Step(r"\.c_str\(\)", ".as_str()", ONCE, needs=".c_str"),
        Step(r"\.empty\(\)", ".is_empty()", ONCE, needs=".empty"),
        Step(rf"std::to_string\(({W}+)\)", "$1.to_string()", ONCE, needs="std::to_string"),
    ),
)
# Patterns and what replaces them.
TRANSFORM_LOOPS = TextRule(
    "Control Flow → Rust",
    _steps(
        (
            rf"for{S}*\({S}*(?:int|size_t|unsigned){S}+({W}+){S}*={S}*({W}+){S}*;{S}*\1{S}*<{S}*({W}+){S}*;{S}*\1{S}*\+\+{S}*\)",
            "for $1 in $2..$3", "for",
        ),
        (rf"for{S}*\({S}*(?:const{S}+)?(?:auto|({W}+)){S}*&{S}*({W}+){S}*:{S}*({W}+){S}*\)", "for $2 in &$3", "for"),
        (rf"for{S}*\({S}*(?:const{S}+)?auto{S}+({W}+){S}*:{S}*({W}+){S}*\)", "for $1 in $2", "for"),
        (rf"(?d)while{S}*\({S}*(.+?){S}*\){S}*\{{", "while $1 {", "while"),
    ),
)
_TYPEDEF = rf"(?d)^({S}*)typedef{S}+(.+?){S}+({W}+);"


def _typedef_line(line: Column) -> Column:
    get = lambda g: F.regexp_extract(line, _TYPEDEF, g)
    old, name = T.strip(get(2)), get(3)
    return F.when(
        line.rlike(_TYPEDEF),
        F.concat(
            get(1), F.lit("type "), F.upper(F.left(name, F.lit(1))), F.substring(name, F.lit(2), F.length(name)),
            F.lit(" = "), F.coalesce(L.lookup(TRANSFORM_TYPES, old), old), F.lit(";"),
            F.regexp_replace(line, _TYPEDEF, ""),
        ),
    )


def _include_line(line: Column) -> Column:
    system = rf"^({S}*)#include{S}*<({W}+)>"
    local = rf'^({S}*)#include{S}*"({W}+)\.h(?:pp)?"'
    using = rf"^({S}*)using{S}+namespace{S}+{W}+;.*$"
    header = F.regexp_extract(line, system, 2)
    todo = F.concat(F.lit("// TODO: Rust crate for <"), header, F.lit(">"))
    return (
        F.when(
            line.rlike(system),
            F.concat(
                F.regexp_extract(line, system, 1), F.coalesce(L.lookup(TRANSFORM_INCLUDES, header), todo),
                F.regexp_replace(line, system, ""),
            ),
        )
        .when(line.rlike(local), F.regexp_replace(line, local, "$1mod $2;"))
        .when(line.rlike(using), F.regexp_replace(line, using, "$1// no namespaces; see mod and use"))
    )


TRANSFORM_INCLUDE = LineRule("#include → use statements", _include_line)
TRANSFORM_TYPEDEF = LineRule("typedef → type", _typedef_line)
TRANSFORM_CPP_RULES = [
    TRANSFORM_INCLUDE, TRANSFORM_TYPEDEF, TRANSFORM_STRINGS, TRANSFORM_MEMORY, TRANSFORM_POINTERS, TRANSFORM_LOOPS,
]

_RECORD = rf"{ML}^{S}*struct{S}+({W}+){S}*\{{([^}}]+)\}};"
_ENUM = rf"{ML}^{S}*enum{S}+({W}+){S}*\{{([^}}]+)\}};"
_MEMBER = rf"({W}[{WORD} \n\t\r\f\x0B]*?){S}+({W}+);"


def record_fields(files: DataFrame) -> DataFrame:
    """Fields of simple structs, with their Rust types."""
    bodies = files.select("path", F.explode_outer(T.find_all(F.col("content"), _RECORD)).alias("body"))
    members = bodies.select(
        "path", F.regexp_extract("body", _RECORD, 1).alias("record"),
        F.posexplode_outer(T.find_all(F.regexp_extract("body", _RECORD, 2), _MEMBER)).alias("field_ord", "member"),
    ).where(F.col("member").isNotNull())
    kind = T.strip(F.regexp_extract("member", _MEMBER, 1))
    return members.select(
        "path", "record", "field_ord", F.regexp_extract("member", _MEMBER, 2).alias("field"),
        F.coalesce(L.lookup(TRANSFORM_TYPES, kind), kind).alias("rust_type"),
    )


def enum_values(files: DataFrame) -> DataFrame:
    """Values of simple enums in PascalCase; assigned numbers are dropped."""
    bodies = files.select("path", F.explode_outer(T.find_all(F.col("content"), _ENUM)).alias("body"))
    values = bodies.select(
        "path", F.regexp_extract("body", _ENUM, 1).alias("enum"),
        F.posexplode_outer(T.split_list(F.regexp_extract("body", _ENUM, 2))).alias("value_ord", "value"),
    ).where(F.col("value").isNotNull())
    name = T.strip(F.split("value", "=", -1)[0])
    pascal = F.replace(F.initcap(F.replace(F.lower(name), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return values.select("path", "enum", "value_ord", pascal.alias("value")).where("value <> ''")


# --- Java 8 to 17 -----------------------------------------------------------------------

# Patterns and what replaces them.
JAVA_COLLECTIONS_HARD = TextRule(
    "java_collections_modern",
    _steps(
        (r"Arrays\.asList\(([^)]*)\)", "List.of($1)", "asList"), (r"Collections\.emptyList\(\)", "List.of()", "emptyList"),
        (r"Collections\.emptyMap\(\)", "Map.of()", "emptyMap"), (r"Collections\.emptySet\(\)", "Set.of()", "emptySet"),
        (r"Collections\.singletonList\(([^)]+)\)", "List.of($1)", "singletonList"), (r"Collections\.singleton\(([^)]+)\)", "Set.of($1)", "singleton"),
    ),
)
# Patterns and what replaces them.
JAVA_COLLECTIONS = TextRule(
    "collection_factory",
    tuple(
        Step(p, r, ONCE, n)
        for p, r, n in [
            (r"Arrays\.asList\(([^)]*)\)", "List.of($1)", "asList"),
            (rf"Collections\.unmodifiableList\({S}*List\.of\(([^)]*)\){S}*\)", "List.of($1)", "unmodifiableList"),
            (rf"Collections\.unmodifiableSet\({S}*new{S}+HashSet<[^>]*>\(List\.of\(([^)]*)\)\){S}*\)", "Set.of($1)", "unmodifiableSet"),
            (rf"new{S}+HashSet<[^>]*>\({S}*List\.of\(([^)]*)\){S}*\)", "Set.of($1)", "HashSet"),
            (r"Collections\.emptyList\(\)", "List.of()", "emptyList"), (r"Collections\.emptySet\(\)", "Set.of()", "emptySet"),
            (r"Collections\.emptyMap\(\)", "Map.of()", "emptyMap"), (r"Collections\.singletonList\(([^)]*)\)", "List.of($1)", "singletonList"),
        ]
    ),
    version=9,
)
# Declared types and the types they are built with.
JAVA_SUBTYPES = {
    "List": "ArrayList|LinkedList|CopyOnWriteArrayList",
    "Map": "HashMap|TreeMap|LinkedHashMap|ConcurrentHashMap",
    "Set": "HashSet|TreeSet|LinkedHashSet",
    "Queue": "LinkedList|PriorityQueue|ArrayDeque",
    "Deque": "ArrayDeque|LinkedList",
}


def _var_steps() -> tuple[Step, ...]:
    pairs = [(f"({W}+)", r"\2")] + [(f"({d})", f"(?:{c})") for d, c in JAVA_SUBTYPES.items()]
    steps = []
    for declared, built in pairs:
        head, tail = rf"{ML}^({S}+){declared}", rf"({S}*\([^)]*\){S}*;)"
        # A diamond takes the declared generics.
        steps.append(Step(rf"{head}(<[^>]+>){S}+({W}+{S}*={S}*new ({built}))<>{tail}", "$1var $4$3$6", needs="new"))
        steps.append(Step(rf"{head}(?:<[^>]+>)?{S}+({W}+{S}*={S}*new{S}+{built}(?:<[^>]*>)?{S}*\([^)]*\){S}*;)", "$1var $3", needs="new"))
    return tuple(steps)


JAVA_VAR = TextRule("var_keyword", _var_steps(), version=10)
JAVA_INSTANCEOF = TextRule(
    "instanceof_pattern",
    _steps(
        (
            rf"if{S}*\({S}*({W}+){S}+instanceof{S}+({W}+){S}*\){S}*\{{({S}*)\2{S}+({W}+){S}*={S}*\(\2\){S}*\1{S}*;",
            "if ($1 instanceof $2 $4) {$3", "instanceof",
        )
    ),
    version=16,
)
JAVA_RULES = [JAVA_COLLECTIONS, JAVA_VAR, JAVA_INSTANCEOF]

# Constructs that are counted only.
LEGACY_CONSTRUCTS = {
    "arrays_as_list": r"Arrays\.asList\(([^)]*)\)", "picture": rf"(?i)PIC{S}+[9XSV]",
    "printf": rf"{WB}printf{S}*\(", "include": r"#include", "perform": rf"(?i){WB}PERFORM{WE}",
    "display": rf"(?i){WB}DISPLAY{WE}",
}
COUNTED_CONSTRUCTS = {
    "text_block": rf'{W}+{S}+{W}+{S}*={S}*"(?:[^"\\]|\\.)*"(?:{S}*\+{S}*"(?:[^"\\]|\\.)*"){{2,}}{S}*;',
    "switch_assign": rf"{S}+{W}+(?:<[^>]+>)?{S}+{W}+{S}*;{S}*\n{S}*switch{S}*\([^)]+\){S}*\{{",
}

# The rules of each migration, in order.
RULE_SETS: dict[str, list[Rule]] = {
    "cobol_to_rust": COBOL_RULES,
    "cpp_to_rust": HARD_CPP_RULES,
    "java8_to_java17": [JAVA_COLLECTIONS_HARD],
}
