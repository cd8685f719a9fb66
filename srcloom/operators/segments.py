"""Cutting analysed files into segments that can be migrated one by one.

Works inside the file's row: header, global variables, then one group per
struct, class, free function or enum. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import text as T
from srcloom.operators.file_analysis import cutter
from srcloom.operators.symbols import explode_rows

# What marks a header line and what opens a comment line. A word
# counts only with something after it, as in a line without its outer blanks.
HEADER_LINE = (
    rf"#include|(?:import |use |COPY |package ).*{T.NOT_S}|^{T.S}*+(?://|/\*|\*)"
)

SEGMENT = (
    "struct<name:string,id_part:string,kind:string,code:string,start_line:int,end_line:int,"
    "dependencies:array<string>,complexity:int>"
)


def _segment(name, id_part, kind, code, start, end, dependencies=None, score=None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(name).alias("name"),
        as_column(id_part).alias("id_part"),
        as_column(kind).alias("kind"),
        code.alias("code"),
        as_column(start).alias("start_line"),
        as_column(end).alias("end_line"),
        (dependencies if dependencies is not None else F.array().cast("array<string>")).alias("dependencies"),
        as_column(score if score is not None else 1).alias("complexity"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{SEGMENT}>")


def header_segment(lines: Column, imports: Column) -> Column:
    """First header line up to the first other line that is not blank."""

    def line_class(line: Column) -> Column:
        return F.when(line.rlike(HEADER_LINE), 2).when(line.rlike(T.NOT_S), 0).otherwise(1)

    def cut(classes: Column) -> Column:
        first = F.array_position(classes, F.lit(2)).cast("int")

        def from_first(f: Column) -> Column:
            rest = F.slice(classes, f + 1, F.greatest(F.size(classes) - f, F.lit(0)))
            stop = F.array_position(rest, F.lit(0)).cast("int")
            taken = F.when(stop > 0, stop).otherwise(F.size(rest) + 1)
            code = F.array_join(F.slice(lines, f, taken), "\n")
            return F.when(
                f > 0, F.array(_segment("imports/includes", "header", "header", code, 1, taken))
            ).otherwise(_none())

        return T.let(first, from_first)

    return F.when(F.size(imports) == 0, _none()).otherwise(
        T.let(F.transform(lines, line_class), cut)
    )


def globals_segment(lines: Column, global_vars: Column) -> Column:
    """Lines with an ``=`` and the name of any global variable."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    used = F.filter(
        F.filter(numbered, lambda x: x["line"].contains("=")),
        lambda x: F.exists(global_vars, lambda v: x["line"].contains(v)),
    )

    def build(us: Column) -> Column:
        code = F.array_join(us["line"], "\n")
        one = _segment(
            "variables_globales", "globals", "globals", code, us[0]["no"], F.element_at(us, -1)["no"]
        )
        return F.when(F.size(us) > 0, F.array(one)).otherwise(_none())

    return F.when(F.size(global_vars) == 0, _none()).otherwise(T.let(used, build))


def symbol_groups(symbols: Column, scored: bool = True) -> Column:
    """Groups of symbols: a container with the functions that start inside it,
    functions of no container, enums. A later group of the same name replaces an
    earlier one but keeps its place. Without ``scored`` symbols and groups are spans."""
    containers = F.filter(symbols, lambda s: s["kind"].isin("struct", "class"))
    functions = F.filter(symbols, lambda s: s["kind"] == "function")
    enums = F.filter(symbols, lambda s: s["kind"] == "enum")

    def group(s: Column, end: Column, score: Callable[[], Column]) -> Column:
        told = [s["dependencies"].alias("dependencies"), score().alias("complexity")] if scored else []
        return F.struct(
            s["name"].alias("name"), s["kind"].alias("kind"), s["start_line"].alias("start_line"), end.alias("end_line"), *told
        )

    def alone(s: Column) -> Column:
        return group(s, s["end_line"], lambda: s["complexity"])

    def grouped(k: Column) -> Column:
        def with_members(c: Column) -> Column:
            members = F.filter(k["functions"], lambda f: f["start_line"].between(c["start_line"], c["end_line"]))
            most = lambda ms, field: F.greatest(c[field], F.coalesce(F.array_max(ms[field]), c[field]))
            return T.let(members, lambda ms: F.struct(
                group(c, most(ms, "end_line"), lambda: most(ms, "complexity")).alias("group"), ms["name"].alias("members")
            ))

        def assemble(cs: Column) -> Column:
            assigned = F.flatten(cs["members"])
            free = T.let(
                assigned,
                lambda names: F.filter(k["functions"], lambda f: ~F.array_contains(names, f["name"])),
            )
            groups = F.concat(cs["group"], F.transform(free, alone), F.transform(k["enums"], alone))
            return T.let(groups, last_of_each)

        def last_of_each(gs: Column) -> Column:
            newest_first = F.reverse(gs)
            newest = lambda names: F.transform(
                F.array_distinct(gs["name"]), lambda n: newest_first[F.array_position(names, n).cast("int") - 1]
            )
            return F.when(F.size(F.array_distinct(gs["name"])) == F.size(gs), gs).otherwise(T.let(newest_first["name"], newest))

        return T.let(F.transform(k["containers"], with_members), assemble)

    kinds = F.struct(
        containers.alias("containers"), functions.alias("functions"), enums.alias("enums")
    )
    return T.let(kinds, grouped)


def symbol_segments(lines: Column, symbols: Column, kinds: tuple[str, ...] = (), scored: bool = True) -> Column:
    """The groups of symbols as segments; with ``kinds`` only groups of these. Spans leave dependencies and complexity null."""
    def cut(g: Column, all_lines: Column) -> Column:
        unknown = F.lit(None).cast("array<string>"), F.lit(None).cast("int")
        told = (F.array_sort(F.array_distinct(g["dependencies"])), g["complexity"]) if scored else unknown
        return _segment(
            g["name"], g["name"], g["kind"], T.slice_lines(all_lines, g["start_line"], g["end_line"]),
            g["start_line"], g["end_line"], *told,
        )

    groups = symbol_groups(symbols, scored)
    wanted = F.filter(groups, lambda g: g["kind"].isin(*kinds)) if kinds else groups
    # bound, for as the only use of a column the lines would be cut anew for each group
    made = T.let(lines, lambda all_lines: F.transform(wanted, lambda g: cut(g, all_lines)))
    return F.filter(made, lambda s: ~T.is_blank(s["code"]))


def segment_names(content: Column, imports: Column, global_vars: Column, symbols: Column) -> Column:
    """``id_part`` of each segment in order, as all segments have it, for symbols that are spans. No code is put together."""
    def named(lines: Column) -> Column:
        some = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        header = (F.size(imports) > 0) & F.exists(lines, lambda x: x.rlike(HEADER_LINE))
        used = lambda x: x.contains("=") & F.exists(global_vars, lambda v: x.contains(v))
        # most code begins with a line that is not blank
        kept = F.filter(symbol_groups(symbols, False), lambda g: (
            ((g["end_line"] >= g["start_line"]) & F.get(lines, g["start_line"] - 1).rlike(T.NOT_S))
            | ~T.is_blank(T.slice_lines(lines, g["start_line"], g["end_line"]))
        ))
        return F.concat(
            some(header, "header"), some((F.size(global_vars) > 0) & F.exists(lines, used), "globals"), F.transform(kept, lambda g: g["name"])
        )

    return T.let(T.split_lines(content), named)


#: Kinds of segments that hang on no other segment.
APART = ("header", "globals")
#: Kinds of segments that are made of symbols, and the languages that have them.
GROUPED = {
    "struct": ("c", "cpp", "rust"), "class": ("c", "cpp", "java"), "function": ("c", "cpp", "cobol", "java", "rust"), "enum": ("c", "cpp"),
}


def with_segments(analysed: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row per file with its segments in order; with ``kinds`` (of APART, or of GROUPED) only those, and no work on others.

    Where symbols are spans, dependencies and complexity of their segments are null."""
    if not (set(kinds) <= set(APART) or set(kinds) <= set(GROUPED)):
        raise ValueError(f"kinds that can be made alone are {APART}, or some of {tuple(GROUPED)}, not {kinds}")
    grouped = tuple(k for k in kinds if k in GROUPED)
    scored = "complexity" in analysed.schema["symbols"].dataType.elementType.names
    if scored and not kinds:  # every field of every kind
        columns = F.make_valid_utf8("content"), F.col("imports"), F.col("global_vars"), F.col("symbols")
        return analysed.withColumn("segments", F.arrow_udf(cutter(HEADER_LINE), f"array<{SEGMENT}>")(*columns))
    split = analysed.withColumn("lines", T.split_lines(F.col("content")))
    lines = F.col("lines")
    made = {
        "header": lambda: header_segment(lines, F.col("imports")),
        "globals": lambda: globals_segment(lines, F.col("global_vars")),
        "symbols": lambda: symbol_segments(lines, F.col("symbols"), grouped, scored),
    }
    wanted = [make() for kind, make in made.items() if not kinds or kind in kinds or (kind == "symbols" and grouped)]
    return split.withColumn("segments", F.concat(*wanted)).drop("lines")


def segment_corpus(analysed: DataFrame, *keep: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Flat segments. ``path`` is part of the key: equal stems may meet in one id. ``seg_ord`` counts what is made."""
    return segment_rows(with_segments(analysed, kinds), *keep)


def segment_rows(nested: DataFrame, *keep: str) -> DataFrame:
    rows = explode_rows(
        nested, "path", "stem", "language", *keep,
        array="segments", position="seg_ord", value="s",
    )
    return rows.select(
        "path", "language", *keep, "seg_ord",
        F.concat_ws("::", "stem", "s.id_part").alias("segment_id"),
        "s.kind", "s.name", "s.code", "s.start_line", "s.end_line", "s.dependencies", "s.complexity",
    )


def _held_by(container: str, function: str) -> str:
    return f"{function}.start_line between {container}.start_line and {container}.end_line"


def containment(analysed: DataFrame) -> DataFrame:
    """Container and function pairs of a file; both lists stand in the file's row, so nothing is joined."""
    pairs = F.expr(
        "flatten(transform(filter(symbols, c -> c.kind in ('struct', 'class')), c -> transform("
        f"filter(symbols, f -> f.kind = 'function' and {_held_by('c', 'f')}), f -> struct(c.name as container, f.name as function))))"
    )
    rows = explode_rows(analysed.withColumn("pairs", pairs), "path", array="pairs", position="pair_ord", value="p")
    return rows.select("path", "p.container", "p.function")


def free_functions(analysed: DataFrame) -> DataFrame:
    """Functions whose name no container of the file holds."""
    held = F.expr(
        "transform(filter(symbols, f -> f.kind = 'function' and exists(symbols, c -> c.kind in ('struct', 'class') and "
        f"{_held_by('c', 'f')})), f -> f.name)"
    )
    free = F.expr("filter(symbols, f -> f.kind = 'function' and not array_contains(held_names, f.name))")
    found = analysed.withColumn("held_names", held).withColumn("free", free)
    return explode_rows(found, "path", array="free", position="free_ord", value="f").select("path", "f.name", "f.start_line")


def prompt_context(segments: DataFrame, context: Column | None = None) -> DataFrame:
    """The text that introduces a segment, with the project context if there is one."""
    dependencies = F.when(F.size("dependencies") > 0, F.array_join("dependencies", ", ")).otherwise("none")
    own = F.concat(
        F.lit("// Part: "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(")\n// Needs: "),
        dependencies, F.lit("\n\n"), F.col("code"),
    )
    if context is not None:
        own = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), own)).otherwise(own)
    return segments.withColumn("prompt_context", own)


CONTEXT_TITLE = "// === The project so far ==="


def context_digests(context: DataFrame, key: str) -> DataFrame:
    """One row per project: files, size of its context and a digest that adds up.

    The context itself stays in its rows (project, path), to be read in path
    order. The digest sums the first 12 hex digits of md5 over path and text, so a
    project of any size is partial aggregates; no task ever holds one."""
    part = F.conv(F.substring(F.md5(F.concat("path", F.lit("\n"), "context")), 1, 12), 16, 10)
    return context.groupBy(key).agg(
        F.count("*").alias("context_files"),
        (F.sum(F.length("context") + 1) + len(CONTEXT_TITLE)).alias("context_chars"),
        F.sum(part.cast("decimal(20,0)")).cast("string").alias("context_digest"),
    )


def attach_context(segments: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Give every segment the size and digest of its project's context, joined on the project."""
    return segments.join(context_digests(context, key), key, "left")
