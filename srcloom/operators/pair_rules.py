"""Checks of a migrated text against its source, one row per pair.

All rules read the two texts in the pair's own row, so checking pairs is a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions import text as T
from srcloom.functions.text import ML, S, W, WB, WE, WORD

# What counts as a function or a type, by language; others as Rust.
FUNCTION_PATTERNS = {
    "cpp": rf"{WB}{W}+{S}+{W}+{S}*\([^)]*\){S}*\{{",
    "c": rf"{WB}{W}+{S}+{W}+{S}*\([^)]*\){S}*\{{",
    "cobol": rf"{ML}^{S}{{6}}{S}+[{WORD}-]+\.{S}*$",
    "java": rf"(?d)(?:public|private|protected){S}+.*{W}+{S}*\([^)]*\){S}*\{{",
    "rust": rf"{WB}fn{S}+{W}+",
}
TYPE_PATTERNS = {
    "cpp": rf"{WB}(?:struct|class|enum){S}+{W}+",
    "c": rf"{WB}(?:struct|enum|typedef){S}+",
    "cobol": rf"{ML}^{S}{{6}}{S}+01{S}+",
    "java": rf"{WB}class{S}+{W}+",
    "rust": rf"{WB}(?:struct|enum){S}+{W}+",
}
# Crates that are known, and the marks of C and C++ that Rust code should not hold, with their labels.
KNOWN_CRATES = [
    "std", "core", "alloc", "collections", "io", "fs", "fmt", "sync", "thread", "net", "path",
    "env", "process", "serde", "tokio", "anyhow", "thiserror", "clap",
]
OWN_CRATE = "crate"
RUST_USE_ROOT = rf"{ML}^use{S}+({W}+)"
LITERAL = r'"([^"]{4,})"'
RESIDUAL_MARKERS = {
    "NULL (usar None)": rf"{WB}NULL{WE}",
    "#include (no es Rust)": rf"#include{S}*<",
    "cout (no es Rust)": rf"{WB}cout{S}*<<",
    "printf (usar println!/format!)": rf"{WB}printf{S}*\(",
    "new (usar Box::new o constructor)": rf"{WB}new{S}+{W}+{S}*\(",
    "delete (no existe en Rust)": rf"{WB}delete{S}+",
    "void (usar -> () en Rust)": rf"{WB}void{S}+{W}+{S}*\(",
}
MIN_FUNCTION_RATIO = 0.7
MIN_TYPE_RATIO = 0.5
MIN_SIZE_RATIO, MAX_SIZE_RATIO = 0.3, 4.0
MIN_LITERAL_RATIO = 0.3
MIN_OUTPUT_CHARS = 10

RESULT = (
    "struct<rule_name:string,passed:boolean,category:string,severity:string,message:string,details:string>"
)


@dataclass(frozen=True)
class Rule:
    """A check as data: when it holds and what it says. A ``passed`` that comes
    out null (the check could not be made) counts as a failed warning; ``check_pairs``
    turns division by zero, a cast that fails and an index that is not there into nulls."""

    name: str
    category: str
    severity: str
    passed: Column
    message: Column
    details: Column | None = None

    def outcome(self) -> Column:
        """The result without its texts."""
        return F.struct(
            F.lit(self.name).alias("rule_name"),
            F.coalesce(self.passed, F.lit(False)).alias("passed"),
            F.lit(self.category).alias("category"),
            F.when(self.passed.isNull(), "warning").otherwise(self.severity).alias("severity"),
        )

    def result(self) -> Column:
        broken = self.passed.isNull()
        passed = F.coalesce(self.passed, F.lit(False))
        details = self.details if self.details is not None else F.lit("")
        return F.struct(
            F.lit(self.name).alias("rule_name"),
            passed.alias("passed"),
            F.lit(self.category).alias("category"),
            F.when(broken, "warning").otherwise(self.severity).alias("severity"),
            F.when(broken, "rule could not be computed").otherwise(self.message).alias("message"),
            F.when(passed | broken, "").otherwise(details).alias("details"),
        )


def _by_language(language: Column, text: Column, patterns: dict[str, str]) -> Column:
    chosen = None
    for name, pattern in patterns.items():
        if name != "rust":
            hit = T.count_matches(text, pattern)
            chosen = F.when(language == name, hit) if chosen is None else chosen.when(language == name, hit)
    return chosen.otherwise(T.count_matches(text, patterns["rust"]))


def count_functions(language: Column, text: Column) -> Column:
    return _by_language(language, text, FUNCTION_PATTERNS)


def count_types(language: Column, text: Column) -> Column:
    return _by_language(language, text, TYPE_PATTERNS)


def literals(text: Column) -> Column:
    return F.array_distinct(T.find_all(text, LITERAL, 1))


def residual_markers(text: Column) -> Column:
    """Labels of the source-language marks a Rust text still holds."""
    found = [F.when(text.rlike(p), F.lit(label)) for label, p in RESIDUAL_MARKERS.items()]
    return F.array_compact(F.array(*found))


def pair_measures(pairs: DataFrame) -> DataFrame:
    """Everything the built-in rules compare, measured once per pair."""
    source, migrated = F.coalesce("source", F.lit("")), F.coalesce("migrated", F.lit(""))
    source_language, target_language = F.col("source_language"), F.col("target_language")
    braces = lambda b: F.length(migrated) - F.length(F.replace(migrated, F.lit(b), F.lit("")))
    suspicious = F.filter(
        T.find_all(migrated, RUST_USE_ROOT, 1), lambda root: ~root.isin(*KNOWN_CRATES, OWN_CRATE)
    )
    is_rust = target_language == "rust"
    # Columns, not one struct: the optimizer would take a struct to pieces and
    # measure again at every use.
    measured = {
        "source_functions": count_functions(source_language, source),
        "target_functions": count_functions(target_language, migrated),
        "source_types": count_types(source_language, source),
        "target_types": count_types(F.lit("rust"), migrated),
        "target_chars": F.length(T.strip(migrated)),
        "source_lines": T.line_count_stripped(source),
        "target_lines": T.line_count_stripped(migrated),
        "suspicious": F.when(is_rust, suspicious),
        "source_literals": literals(source),
        "target_literals": literals(migrated),
        "opens": F.when(is_rust, braces("{")),
        "closes": F.when(is_rust, braces("}")),
        "markers": F.when(is_rust, residual_markers(migrated)),
    }
    m = lambda name: F.col(f"m_{name}")
    issues = F.concat(
        F.when(
            m("opens") != m("closes"),
            F.array(F.format_string("braces: %d open, %d close", m("opens"), m("closes"))),
        ).otherwise(F.array().cast("array<string>")),
        F.transform(m("markers"), lambda x: F.concat(F.lit("mark left: "), x)),
    )
    return pairs.withColumns({f"m_{n}": c for n, c in measured.items()}).withColumns(
        {
            "m_kept": F.size(F.array_intersect(m("source_literals"), m("target_literals"))),
            "m_had": F.size(m("source_literals")),
            "m_issues": issues,
        }
    )


def built_in_rules() -> list[Rule]:
    m = lambda name: F.col(f"m_{name}")
    is_rust = F.col("target_language") == "rust"
    not_rust = "only for Rust"
    ratio = m("target_lines") / m("source_lines")
    kept, had, issues = m("kept"), m("had"), m("issues")
    suspicious = F.concat(F.lit("["), F.array_join(m("suspicious"), ", "), F.lit("]"))
    share = F.round(kept / F.greatest(had, F.lit(1)) * 100).cast("int")

    def before_after(what: str) -> Column:
        return F.format_string(f"{what}: %d before, %d after", m(f"source_{what}"), m(f"target_{what}"))

    return [
        Rule(
            "function_count", "structural", "warning", m("target_functions") >= m("source_functions") * F.lit(MIN_FUNCTION_RATIO),
            before_after("functions"), F.lit(f"at least {MIN_FUNCTION_RATIO:.0%} of the functions should be there"),
        ),
        Rule(
            "struct_count", "structural", "warning", m("target_types") >= m("source_types") * F.lit(MIN_TYPE_RATIO),
            before_after("types"), F.lit(f"at least {MIN_TYPE_RATIO:.0%} of the types should be there"),
        ),
        Rule(
            "no_empty_output", "semantic", "error", m("target_chars") > MIN_OUTPUT_CHARS,
            F.format_string("characters: %d", m("target_chars")), F.lit(f"more than {MIN_OUTPUT_CHARS} characters expected"),
        ),
        Rule(
            "size_ratio", "semantic", "warning", ratio.between(MIN_SIZE_RATIO, MAX_SIZE_RATIO),
            before_after("lines"), F.format_string(f"%.2f times the lines, {MIN_SIZE_RATIO} to {MAX_SIZE_RATIO} expected", ratio),
        ),
        Rule(
            "no_hallucinated_imports", "semantic", "warning", ~is_rust | (F.size(m("suspicious")) == 0),
            F.when(~is_rust, not_rust).otherwise(F.format_string("unknown imports: %d", F.size(m("suspicious")))), suspicious,
        ),
        Rule(
            "preserves_logic", "semantic", "warning", (had == 0) | (kept / F.greatest(had, F.lit(1)) >= F.lit(MIN_LITERAL_RATIO)),
            F.format_string("literals found again: %d of %d", kept, had),
            F.format_string(f"%d percent, at least {100 * MIN_LITERAL_RATIO:.0f} expected", share),
        ),
        Rule(
            "valid_rust_syntax", "syntactic", "error", ~is_rust | (F.size(issues) == 0),
            F.when(~is_rust, not_rust).otherwise(F.format_string("findings: %d", F.size(issues))), F.array_join(issues, "\n"),
        ),
    ]


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions that are resolved inside give null where they cannot be computed, however the session is set."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def check_pairs(pairs: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """Pairs with the results of all rules, in rule order, and the blocking flag.

    A rule that cannot be computed for a pair gives a failed warning there and the others go on; only what raises on
    purpose (``raise_error``, ``assert_true``) ends the job."""
    with lenient(pairs.sparkSession):
        return _check_pairs(pairs, built_in_rules() + list(extra_rules or []))


def _check_pairs(pairs: DataFrame, rules: list[Rule]) -> DataFrame:

    def flag(results: Column) -> Column:
        blocked = F.exists(results, lambda r: ~r["passed"] & (r["severity"] == "error"))
        return T.let(
            blocked, lambda b: F.transform(results, lambda r: r.withField("blocked", b))
        )

    measured = pair_measures(pairs)
    return (
        measured
        .withColumn("results", T.let(F.array(*[r.result() for r in rules]), flag))
        .withColumn("blocked", F.col("results")[0]["blocked"])
        .drop(*[c for c in measured.columns if c not in pairs.columns])
    )


def results_of(pairs: DataFrame, rules: list[Rule] | tuple[str, ...], texts: bool = True) -> DataFrame:
    """Pairs with the results of some rules (built-in ones by name), measured for these only; without the blocking flag,
    which hangs on all rules. Without ``texts`` no messages are made."""
    with lenient(pairs.sparkSession):
        chosen = [r for r in built_in_rules() if r.name in rules] if isinstance(rules, tuple) else rules
        measured = pair_measures(pairs)
        made = F.array(*[r.result() if texts else r.outcome() for r in chosen])
        return measured.withColumn("results", made).drop(*[c for c in measured.columns if c not in pairs.columns])


def rule_results(checked: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per pair and rule. Filter here rather than before: a
    filter on the long rows is not pushed under the measures and run twice."""
    return checked.select(*keys, F.posexplode_outer("results").alias("rule_ord", "r")).select(
        *keys, "rule_ord", "r.*"
    )


def pair_summary(checked: DataFrame, *keys: str) -> DataFrame:
    passed = F.size(F.filter("results", lambda r: r["passed"]))
    return checked.select(
        *keys, "blocked", passed.alias("n_passed"), (F.size("results") - passed).alias("n_failed")
    )


def rule_summary(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys, "rule_name", "category", "severity").agg(
        F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed")
    )


def violations(checked: DataFrame, *keys: str) -> DataFrame:
    """Failed rules of blocked pairs only."""
    return rule_results(checked, *keys).where("blocked and not passed").drop("blocked")


def marker_census(texts: DataFrame, text: str) -> DataFrame:
    """How many texts hold each residual mark, and how often."""
    counted = F.array(
        *[
            F.struct(F.lit(label).alias("marker"), T.count_matches(F.col(text), p).alias("hits"))
            for label, p in RESIDUAL_MARKERS.items()
        ]
    )
    return (
        texts.select(F.inline_outer(counted))
        .groupBy("marker")
        .agg(F.count_if(F.col("hits") > 0).alias("n_texts"), F.sum("hits").alias("n_hits"))
    )
