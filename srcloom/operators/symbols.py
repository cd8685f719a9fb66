"""Structure of source files: imports, global variables and symbols.

Input is one row per file with ``path``, ``language`` and ``content``. All work
is done inside the row, so analysing a corpus is a scan with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import text as T
from srcloom.functions.text import ML, S, SPACE, W, WORD
from srcloom.operators.file_analysis import ANALYSIS, analyser

SYMBOL = (
    "struct<name:string,kind:string,start_line:int,end_line:int,params:array<string>,"
    "return_type:string,dependencies:array<string>,complexity:int>"
)
#: A symbol without what only its text tells.
SPAN = "struct<name:string,kind:string,start_line:int,end_line:int>"
_NO_TEXTS = "array<string>"

# What counts as an import, a variable or a symbol, by language.
# Possessive (++, *+) wherever the next character cannot belong to the repeat.
CPP_INCLUDE = rf'#include{S}*+[<"]([^>"]++)[>"]'
CPP_FUNCTION = (
    rf"{ML}^(?:static{S}++|inline{S}++|virtual{S}++|extern{S}++)*"
    rf"([{WORD}:*&<>]++(?:{S}*+[*&])?+){S}++([{WORD}:]++){S}*+\(([^)]*+)\){S}*+"
    rf"(?:const{S}*+)?(?:override{S}*+)?[{{;]"
)
CPP_RECORD = rf"{ML}^(?:typedef{S}++)?(?:struct|class){S}++({W}++){S}*+[{{:]"
CPP_ENUM = rf"{ML}^(?:typedef{S}++)?enum{S}++({W}++){S}*+\{{"
CPP_GLOBAL = rf"{ML}^(?:const{S}++|static{S}++)?([{WORD}:]++){S}++({W}++){S}*+="
COBOL_DIVISION = rf"{ML}^{S}{{6}}{S}++({W}[{WORD}-]*+){S}++DIVISION"
COBOL_COPY = rf"(?i)COPY{S}++([{WORD}-]++)"
COBOL_VARIABLE = rf"{ML}^{S}{{6}}{S}++(?:01|77){S}++([{WORD}-]++)"
COBOL_PARAGRAPH = rf"{ML}^{S}{{6}}{S}++([{WORD}-]++)\.{S}*$"
JAVA_IMPORT = rf"{ML}^import{S}++([{WORD}.]++);"
JAVA_PACKAGE = rf"{ML}^package{S}++([{WORD}.]++);"
JAVA_CLASS = (
    rf"(?=[{SPACE}acfp])(?:public|private|protected)?{S}*+(?:abstract{S}++|final{S}++)?class{S}++({W}++)"
    rf"(?:{S}++extends{S}++({W}++))?(?:{S}++implements{S}++([{WORD},{SPACE}]+))?{S}*\{{"
)
JAVA_METHOD = (
    rf"(?:public|private|protected){S}++(?:static{S}++)?(?:final{S}++)?([{WORD}<>\[\]]++){S}++({W}++){S}*+"
    rf"\(([^)]*+)\){S}*+(?:throws{S}++[{WORD},{SPACE}]+)?{S}*\{{"
)
RUST_USE = rf"{ML}^use{S}++([{WORD}:{{}}*,{SPACE}]++);"
RUST_FUNCTION = (
    rf"{ML}^(?:pub{S}++)?fn{S}++({W}++){S}*+(?:<[^>]*+>)?{S}*+\(([^)]*+)\){S}*+"
    rf"(?:->{S}*+([{WORD}<>&\[\]]++))?{S}*+\{{"
)
RUST_STRUCT = rf"{ML}^(?:pub{S}++)?struct{S}++({W}++)"
NOT_PARAGRAPHS = ("DIVISION", "SECTION", "STORAGE")
NOT_VARIABLES = ("FILLER",)
COBOL_END_VERB = r"(?i)^END-"
_PATTERNS = {
    n: p for n, p in globals().items() if n.startswith(("CPP_", "COBOL_", "JAVA_", "RUST_")) and n != "COBOL_END_VERB"
}


def _symbol(
    idx: dict[str, Column],
    hit: Column,
    pattern: str,
    *,
    name: int,
    kind: str | Callable[[Column], Column],
    params: int | None = None,
    returns: int | None = None,
    dependencies: Callable[[Column], Column] | None = None,
    scored: bool = True,
    fields: tuple[str, ...] = (),
) -> Column:
    """One match as a symbol whose block is delimited by braces; with ``fields`` only those, none of which needs lines.

    Without branches in ``idx`` it is a span."""
    group = lambda g: F.regexp_extract(hit["text"], pattern, g)
    own = {
        "name": group(name),
        "kind": F.lit(kind) if isinstance(kind, str) else kind(hit["text"]),
        "params": T.split_list(group(params)) if params else F.array().cast(_NO_TEXTS),
    }
    if fields:
        return F.struct(*[own[f].alias(f) for f in fields])
    start = hit["start_line"]

    def span(end: Column) -> list[Column]:
        return [own["name"].alias("name"), own["kind"].alias("kind"), start.alias("start_line"), end.alias("end_line")]

    def build(end: Column) -> Column:
        return F.struct(
            *span(end),
            own["params"].alias("params"),
            (T.strip(group(returns)) if returns else F.lit("")).alias("return_type"),
            (dependencies(hit["text"]) if dependencies else F.array().cast(_NO_TEXTS)).alias("dependencies"),
            (T.complexity(idx, start, end) if scored else F.lit(1)).alias("complexity"),
        )

    if "branches" not in idx:
        return F.struct(*span(T.block_end(idx, start)))
    return T.let(T.block_end(idx, start), build)


def _symbols(content: Column, idx: dict[str, Column] | tuple[str, ...], pattern: str, **groups) -> Column:
    """``idx``: the lines of the file, or the names of fields that need none."""
    if isinstance(idx, tuple):
        hits = F.transform(T.find_all(content, pattern), lambda text: F.struct(text.alias("text")))
        return F.transform(hits, lambda hit: _symbol({}, hit, pattern, fields=idx, **groups))
    return F.transform(
        T.match_table(content, pattern), lambda hit: _symbol(idx, hit, pattern, **groups)
    )


def cpp_functions(content: Column, idx: dict[str, Column]) -> Column:
    return _symbols(content, idx, CPP_FUNCTION, name=2, kind="function", params=3, returns=1)


def cpp_records(content: Column, idx: dict[str, Column]) -> Column:
    kind = lambda text: F.when(text.contains("struct"), "struct").otherwise("class")
    return _symbols(content, idx, CPP_RECORD, name=1, kind=kind)


def cpp_enums(content: Column, idx: dict[str, Column]) -> Column:
    return _symbols(content, idx, CPP_ENUM, name=1, kind="enum", scored=False)


def _java_parents(text: Column) -> Column:
    base = F.regexp_extract(text, JAVA_CLASS, 2)
    faces = F.regexp_extract(text, JAVA_CLASS, 3)
    return F.concat(
        F.when(base != "", F.array(base)).otherwise(F.array().cast(_NO_TEXTS)),
        F.when(faces != "", F.transform(F.split(faces, ",", -1), T.strip)).otherwise(
            F.array().cast(_NO_TEXTS)
        ),
    )


def java_classes(content: Column, idx: dict[str, Column]) -> Column:
    return _symbols(content, idx, JAVA_CLASS, name=1, kind="class", dependencies=_java_parents)


def java_methods(content: Column, idx: dict[str, Column]) -> Column:
    return _symbols(content, idx, JAVA_METHOD, name=2, kind="function", params=3, returns=1)


def rust_functions(content: Column, idx: dict[str, Column]) -> Column:
    return _symbols(content, idx, RUST_FUNCTION, name=1, kind="function", params=2, returns=3)


def rust_structs(content: Column, idx: dict[str, Column]) -> Column:
    return _symbols(content, idx, RUST_STRUCT, name=1, kind="struct", scored=False)


def cobol_paragraphs(content: Column, idx: dict[str, Column], drop_end_verbs: bool = False) -> Column:
    """A paragraph ends where the next candidate starts, kept or not."""

    def bounded(hits: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            end = F.when(i + 1 < F.size(hits), F.get(hits, i + 1)["start_line"] - 1).otherwise(idx["n_lines"])
            span = [
                F.regexp_extract(hit["text"], COBOL_PARAGRAPH, 1).alias("name"),
                F.lit("function").alias("kind"),
                hit["start_line"].alias("start_line"),
                end.alias("end_line"),
            ]
            if "branches" not in idx:
                return F.struct(*span)
            return F.struct(
                *span,
                F.array().cast(_NO_TEXTS).alias("params"),
                F.lit("").alias("return_type"),
                F.array().cast(_NO_TEXTS).alias("dependencies"),
                T.complexity(idx, hit["start_line"], end).alias("complexity"),
            )

        return F.transform(hits, one)

    def kept(symbol: Column) -> Column:
        keep = ~symbol["name"].rlike("(?i)" + "|".join(NOT_PARAGRAPHS))
        return keep & ~symbol["name"].rlike(COBOL_END_VERB) if drop_end_verbs else keep

    if isinstance(idx, tuple):
        own = {"kind": F.lit("function"), "params": F.array().cast(_NO_TEXTS)}
        names = F.transform(T.find_all(content, COBOL_PARAGRAPH, 1), lambda n: F.struct(n.alias("name")))
        return F.transform(F.filter(names, kept), lambda s: F.struct(*[own.get(f, s["name"]).alias(f) for f in idx]))
    return F.filter(T.let(T.match_table(content, COBOL_PARAGRAPH), bounded), kept)


def imports_of(language: Column, content: Column) -> Column:
    package = T.find_all(content, JAVA_PACKAGE, 1)
    java = F.concat(
        F.transform(F.slice(package, 1, 1), lambda p: F.concat(F.lit("package:"), p)),
        T.find_all(content, JAVA_IMPORT, 1),
    )
    cobol = F.concat(
        F.transform(T.find_all(content, COBOL_DIVISION, 1), lambda d: F.concat(d, F.lit(" DIVISION"))),
        F.transform(T.find_all(content, COBOL_COPY, 1), lambda c: F.concat(F.lit("COPY "), c)),
    )
    return (
        F.when(language.isin("c", "cpp"), T.find_all(content, CPP_INCLUDE, 1))
        .when(language == "cobol", cobol)
        .when(language == "java", java)
        .when(language == "rust", F.transform(T.find_all(content, RUST_USE, 1), T.strip))
        .otherwise(F.array().cast(_NO_TEXTS))
    )


def symbols_of(language: Column, content: Column, idx: dict[str, Column], drop_end_verbs: bool = False) -> Column:
    return (
        F.when(
            language.isin("c", "cpp"),
            F.concat(cpp_functions(content, idx), cpp_records(content, idx), cpp_enums(content, idx)),
        )
        .when(language == "cobol", cobol_paragraphs(content, idx, drop_end_verbs))
        .when(language == "java", F.concat(java_classes(content, idx), java_methods(content, idx)))
        .when(language == "rust", F.concat(rust_functions(content, idx), rust_structs(content, idx)))
        .otherwise(F.array().cast(f"array<{_symbol_type(idx)}>"))
    )


def _symbol_type(idx: dict[str, Column] | tuple[str, ...]) -> str:
    if isinstance(idx, tuple):
        return "struct<" + ",".join(f"{f}:{'array<string>' if f == 'params' else 'string'}" for f in idx) + ">"
    return SYMBOL if "branches" in idx else SPAN


def symbol_outlines(files: DataFrame, *fields: str, drop_end_verbs: bool = False) -> DataFrame:
    """One nested row per file: total_lines and its symbols with some of name, kind and params only.

    Nothing looks for lines, block ends or complexity, which are most of an analysis."""
    symbols = symbols_of(F.col("language"), F.col("content"), fields, drop_end_verbs)
    return files.withColumns({"symbols": symbols, "total_lines": T.line_count_split(F.col("content"))})


def globals_of(language: Column, content: Column, symbols: Column) -> Column:
    """C/C++ assignments at column 0 outside every function; COBOL 01/77 items."""
    functions = F.filter(symbols, lambda s: s["kind"] == "function")
    outside = T.let(
        functions,
        lambda fs: F.filter(
            T.match_table(content, CPP_GLOBAL),
            lambda g: ~F.exists(
                fs, lambda f: g["start_line"].between(f["start_line"], f["end_line"])
            ),
        ),
    )
    cpp = F.transform(outside, lambda g: F.regexp_extract(g["text"], CPP_GLOBAL, 2))
    cobol = F.filter(
        T.find_all(content, COBOL_VARIABLE, 1), lambda v: ~v.rlike(f"(?i)^(?:{'|'.join(NOT_VARIABLES)})$")
    )
    return (
        F.when(language.isin("c", "cpp"), cpp)
        .when(language == "cobol", cobol)
        .otherwise(F.array().cast(_NO_TEXTS))
    )


def analyse_corpus(files: DataFrame, drop_end_verbs: bool = False, scored: bool = True) -> DataFrame:
    """One nested row per file: lines, imports, global variables and symbols.

    Scored symbols need every field: files go through Python once (``file_analysis``). Without ``scored`` symbols are
    spans, made by expressions: no parameters, types, dependencies and complexity are looked for."""
    content, language = F.col("content"), F.col("language")
    if scored:
        analyse = analyser(_PATTERNS, NOT_PARAGRAPHS, NOT_VARIABLES, COBOL_END_VERB if drop_end_verbs else None)
        told = F.arrow_udf(analyse, ANALYSIS.format(symbol=SYMBOL))(language, F.make_valid_utf8(content))
        analysed = files.withColumn("__told", told)
        return analysed.withColumns({n: F.col(f"__told.{n}") for n in ("symbols", "imports", "global_vars", "total_lines")}).drop("__told")
    braces = T.line_index_parts(content)["braces"]
    parts = T.line_index_parts(content, F.col("__braces"))
    del parts["branches"]
    idx = {n: F.col(f"__{n}") for n in parts}
    return (
        files.withColumn("__braces", braces)
        .withColumns({f"__{n}": c for n, c in parts.items() if n != "braces"})
        .withColumn("symbols", symbols_of(language, content, idx, drop_end_verbs))
        .withColumn("imports", imports_of(language, content))
        .withColumn("global_vars", globals_of(language, content, F.col("symbols")))
        .withColumn("total_lines", idx["n_lines"])
        .drop(*[f"__{n}" for n in parts])
    )


def explode_rows(nested: DataFrame, *keep: str, array: str, position: str, value: str) -> DataFrame:
    """One row per element. The outer form keeps the optimizer from testing the
    array for emptiness first, which would compute the array a second time."""
    return nested.select(*keep, F.posexplode_outer(array).alias(position, value)).where(
        F.col(position).isNotNull()
    )


def symbol_table(analysed: DataFrame, *keep: str) -> DataFrame:
    """Flat symbols with their order in the file."""
    rows = explode_rows(analysed, "path", "language", *keep, array="symbols", position="sym_ord", value="s")
    return rows.select("path", "language", *keep, "sym_ord", "s.*")


def import_table(analysed: DataFrame) -> DataFrame:
    return explode_rows(
        analysed, "path", "language", array="imports", position="import_ord", value="import_name"
    )


def global_table(analysed: DataFrame) -> DataFrame:
    return explode_rows(
        analysed, "path", "language", array="global_vars", position="var_ord", value="var_name"
    )


def file_rollup(analysed: DataFrame) -> DataFrame:
    """The nested form of a file's analysis, as it is stored."""
    return analysed.select(
        F.col("path").alias("filepath"), "language", "total_lines", "imports", "global_vars", "symbols"
    )


def project_totals(analysed: DataFrame, *keys: str) -> DataFrame:
    """Files, lines and symbols; files without symbols count."""
    return analysed.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        F.sum("total_lines").alias("total_lines"),
        F.sum(F.size("symbols")).alias("total_symbols"),
    )


def file_summary(analysed: DataFrame) -> DataFrame:
    """Per file: a text with the first ten imports and every symbol's signature."""
    def signature(s: Column) -> Column:
        returns = F.when(s["return_type"] != "", F.concat(F.lit(" -> "), s["return_type"])).otherwise("")
        return F.concat(
            F.lit("//   "), s["kind"], F.lit(": "), s["name"], F.lit("("), F.array_join(s["params"], ", "),
            F.lit(")"), returns, F.lit(" [L"), s["start_line"], F.lit("-"), s["end_line"], F.lit("]"),
        )

    imports = F.when(F.size("imports") > 0, F.array_join(F.slice("imports", 1, 10), ", ")).otherwise("ninguno")
    head = F.array(
        F.concat(
            F.lit("// Archivo: "), T.basename(F.col("path")), F.lit(" ("), F.col("language"), F.lit(", "),
            F.col("total_lines"), F.lit(" líneas)"),
        ),
        F.concat(F.lit("// Imports: "), imports),
        F.lit("// Símbolos:"),
    )
    return analysed.select(
        "path", F.array_join(F.concat(head, F.transform("symbols", signature)), "\n").alias("summary")
    )


CONTEXT_SYMBOLS = 10


def context_text(n_symbols: int = CONTEXT_SYMBOLS) -> Column:
    """A file's part of the project context: its heading and its first symbols."""
    heading = F.concat(
        F.lit("// Archivo: "), T.basename(F.col("path")), F.lit(" ("), F.col("total_lines"), F.lit(" líneas)")
    )
    listed = F.transform(
        F.slice("symbols", 1, n_symbols),
        lambda s: F.concat(F.lit("//   "), s["kind"], F.lit(": "), s["name"]),
    )
    return F.array_join(F.concat(F.array(heading), listed), "\n")


def context_lines(analysed: DataFrame, *keys: str, n_symbols: int = CONTEXT_SYMBOLS) -> DataFrame:
    """Project context, one row per file."""
    return analysed.select(*keys, "path", context_text(n_symbols).alias("context"))


def most_complex(symbols: DataFrame, limit: int = 10) -> DataFrame:
    """The report of the most complex symbols; earlier ones win ties."""
    return symbols.orderBy(F.desc("complexity"), "path", "sym_ord").limit(limit)
