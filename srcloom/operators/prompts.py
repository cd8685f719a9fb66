"""Data work around a model call: prompts before it, clean answers after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import formats as FM
from srcloom.functions import languages as L
from srcloom.functions import text as T

CODE_SLOT = "{source_code}"
# The supported migrations. The wording is the caller's to change.
TEMPLATES = {
    "cpp_to_rust": "Convert this C++ code to safe, idiomatic Rust. Answer with code only.\n\n{source_code}",
    "java8_to_java17": "Modernise this Java 8 code to Java 17. Answer with code only.\n\n{source_code}",
    "cobol_to_java": "Convert this COBOL program to Java 17. Answer with code only.\n\n{source_code}",
    "java7_to_python": "Convert this Java 7 code to Python 3. Answer with code only.\n\n{source_code}",
    "php_to_python": "Convert this PHP code to Python 3. Answer with code only.\n\n{source_code}",
    "html_to_react": "Convert this page to a React component. Answer with code only.\n\n{source_code}",
    "cobol_to_rust": "Convert this COBOL program to safe Rust. Answer with code only.\n\n{source_code}",
}
OUTPUT_EXTENSIONS = {"python": ".py", "rust": ".rs", "java": ".java", "react": ".tsx"}
OTHER_EXTENSION = ".txt"
ERROR_CHARS = 500


def build_prompts(requests: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Fills the template of each request; an unknown type gives an error that
    lists the known ones. The few templates are constants of the plan."""
    kind, code = F.col("migration_type"), F.col("source_code")
    template = L.lookup(templates, kind)
    known = "['" + "', '".join(templates) + "']"
    source, target = FM.migration_sides(kind)
    return requests.withColumns(
        {
            "source_language": source,
            "target_language": target,
            "prompt": F.replace(template, F.lit(CODE_SLOT), code),
            "success": template.isNotNull(),
            "error": F.when(
                template.isNull(),
                F.concat(F.lit("no template for "), kind, F.lit(f"; there are {known}")),
            ),
        }
    )


def with_hint(rewritten: DataFrame, prompt: str) -> DataFrame:
    """Where rules changed anything, the prompt names them and holds the rewritten text."""
    done = F.filter("rewrite_log", lambda r: r["n_changes"] > 0)
    names = F.array_join(F.transform(done, lambda r: F.concat(r["rule"], F.lit(": "), r["n_changes"])), ", ")
    hint = F.concat(
        F.lit("\n// Rules that have changed this code, and how often:\n// "),
        names, F.lit("\n// Convert what they left:\n\n"), F.col("rewritten"),
    )
    return rewritten.withColumn(prompt, F.when(F.size(done) > 0, hint).otherwise(F.col(prompt)))


# Characters Unicode keeps for internal use stand for the two kinds of tag lines.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def clean_response(text: Column) -> Column:
    """Drops thinking blocks line-wise, one that never closes to the end, then the
    code fences around the rest."""
    free = T.escape(T.strip(text), _OPEN + _CLOSE, "\ufdd2")
    marked = F.regexp_replace(free, r"(?md)^[^\n]*<think>[^\n]*$", _OPEN)
    marked = F.regexp_replace(marked, r"(?md)^[^\n]*</think>[^\n]*$", _CLOSE)
    spoken = F.regexp_replace(marked, rf"{_OPEN}[^{_CLOSE}]*(?:{_CLOSE}\n?|\z)", "")
    spoken = T.strip(F.regexp_replace(spoken, rf"{_CLOSE}\n?", ""))
    opened = F.when(
        spoken.startswith("```"), F.regexp_replace(spoken, r"^```[^\n]*\n", "")
    ).otherwise(spoken)
    bare = T.let(
        opened, lambda o: T.strip(F.when(o.endswith("```"), F.left(o, F.length(o) - 3)).otherwise(o))
    )
    return T.unescape(bare, _OPEN + _CLOSE, "\ufdd2")


def outcomes(responses: DataFrame) -> DataFrame:
    """Success, languages and the shortened error of each answer."""
    source, target = FM.migration_sides(F.col("migration_type"))
    success = F.col("error").isNull()
    return responses.select(
        "*", source.alias("source_language"), target.alias("target_language"), success.alias("success"),
        F.when(success, clean_response(F.col("response"))).otherwise("").alias("migrated_code"),
        F.left("error", F.lit(ERROR_CHARS)).alias("short_error"),
    )


def output_name(target: Column, file_name: Column) -> Column:
    """File name for a target: base name without its last suffix, new extension."""
    base = F.regexp_replace(T.basename(file_name), r"\.[^.]*$", "")
    return F.concat(base, F.coalesce(L.lookup(OUTPUT_EXTENSIONS, target), F.lit(OTHER_EXTENSION)))
