"""Queries over the derived corpus: text functions, symbols and segments.

The checking SQL finds symbols line by line and block ends with windows over a
brace table, so it shares no method with the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions import languages as L
from srcloom.functions import text as T
from srcloom.operators import segments as SG
from srcloom.operators import symbols as SY
from srcloom.operators.ordered import settle
from srcloom.plans.derived import sql_source_files, source_files, table
from srcloom.plans.registry import query

FILES = "with " + sql_source_files()
LINES = FILES + r""",
cut as (select *, string_split(content, chr(10)) as ls from files),
lines as (select path, stem, language, len(ls) as total_lines, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from cut)"""

# The patterns of declarations, as in the operators.
_FN_CPP = r"^(?:static\s+|inline\s+|virtual\s+|extern\s+)*([\w:*&<>]+(?:\s*[*&])?)\s+([\w:]+)\s*\(([^)]*)\)\s*(?:const\s*)?(?:override\s*)?[{;]"
_REC_CPP = r"^(?:typedef\s+)?(?:struct|class)\s+(\w+)\s*[{:]"
_ENUM_CPP = r"^(?:typedef\s+)?enum\s+(\w+)\s*\{"
_CLS_JAVA = r"(?:public|private|protected)?\s*(?:abstract\s+|final\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?\s*\{"
_FN_JAVA = r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?([\w<>\[\]]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{"
_FN_RUST = r"^(?:pub\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?:->\s*([\w<>&\[\]]+))?\s*\{"
_STRUCT_RUST = r"^(?:pub\s+)?struct\s+(\w+)"
_PARA = r"^\s{6}\s+([\w-]+)\.\s*$"


def _found(language: str, rank: int, kind: str, pattern: str, name: int, params: int, returns: int, scored: bool) -> str:
    group = lambda g: f"regexp_extract(line, '{pattern}', {g})" if g else "''"
    return (
        f"select path, stem, language, total_lines, line_no as start_line, {rank} as rank, {kind} as kind, "
        f"{group(name)} as name, {group(params)} as params, {group(returns)} as return_type, {scored} as scored "
        f"from lines where language = '{language}' and regexp_matches(line, '{pattern}')"
    )


SYMBOLS = (
    LINES
    + ",\nbraced as ("
    + "\nunion all ".join(
        [
            _found("cpp", 0, "'function'", _FN_CPP, 2, 3, 1, True),
            _found("cpp", 1, "case when line like '%struct%' then 'struct' else 'class' end", _REC_CPP, 1, 0, 0, True),
            _found("cpp", 2, "'enum'", _ENUM_CPP, 1, 0, 0, False),
            _found("java", 0, "'class'", _CLS_JAVA, 1, 0, 0, True),
            _found("java", 1, "'function'", _FN_JAVA, 2, 3, 1, True),
            _found("rust", 0, "'function'", _FN_RUST, 1, 2, 3, True),
            _found("rust", 1, "'struct'", _STRUCT_RUST, 1, 0, 0, False),
        ]
    )
    + r"""),
brace as (
  select path, line_no, ch, row_number() over (partition by path order by line_no, k) as pos
  from (select path, line_no, unnest(regexp_extract_all(line, '[{}]')) as ch,
               unnest(range(1, len(regexp_extract_all(line, '[{}]')) + 1)) as k
        from lines where language <> 'cobol')),
depths as (
  select *, sum(case ch when '{' then 1 else -1 end) over (partition by path order by pos) as cum from brace),
based as (
  select b.path, b.rank, b.start_line,
    coalesce(sum(case d.ch when '{' then 1 else -1 end) filter (where d.line_no < b.start_line), 0) as base,
    min(d.pos) filter (where d.ch = '{' and d.line_no >= b.start_line) as first_open
  from braced b left join depths d on d.path = b.path group by all),
ended as (
  select s.path, s.rank, s.start_line, min(d.line_no) as end_line
  from based s join depths d on d.path = s.path and d.ch = '}' and d.cum = s.base and d.pos > s.first_open
  group by all),
candidates as (
  select path, stem, language, total_lines, line_no as start_line, regexp_extract(line, '^\s{6}\s+([\w-]+)\.\s*$', 1) as name
  from lines where language = 'cobol' and regexp_matches(line, '^\s{6}\s+([\w-]+)\.\s*$')),
spans as (
  select b.path, b.stem, b.language, b.total_lines, b.rank, b.kind, b.name, b.params, b.return_type, b.scored, b.start_line,
    coalesce(e.end_line, least(b.start_line + 19, b.total_lines)) as end_line
  from braced b left join ended e using (path, rank, start_line)
  union all
  select * from (
    select path, stem, language, total_lines, 0 as rank, 'function' as kind, name, '' as params, '' as return_type, true as scored, start_line,
      coalesce(lead(start_line) over (partition by path order by start_line) - 1, total_lines) as end_line
    from candidates) where not regexp_matches(upper(name), 'DIVISION|SECTION|STORAGE')),
branches as (
  select path, line_no, len(regexp_extract_all(line, '\b(?:if|else|for|while|switch|case|catch|PERFORM|IF|EVALUATE|match)\b'))
    + len(regexp_extract_all(line, '&&')) + len(regexp_extract_all(line, '\|\|')) as hits from lines),
upto as (select path, line_no, sum(hits) over (partition by path order by line_no) as hits from branches),
symbols as (
  select s.path, s.stem, s.language, s.total_lines, s.kind, s.name,
    array_to_string(list_filter(list_transform(string_split(s.params, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') as params,
    trim(s.return_type) as return_type, s.start_line, s.end_line,
    case when s.scored then least(10, 1 + e.hits - coalesce(b.hits, 0)) else 1 end as complexity,
    row_number() over (partition by s.path order by s.rank, s.start_line) - 1 as sym_ord
  from spans s join upto e on e.path = s.path and e.line_no = s.end_line
    left join upto b on b.path = s.path and b.line_no = s.start_line - 1),
import_rows as (
  select path, language, row_number() over (partition by path order by rank, line_no) - 1 as import_ord, import_name from (
    select path, language, line_no, 0 as rank, regexp_extract(line, '#include\s*[<"]([^>"]+)[>"]', 1) as import_name
      from lines where language = 'cpp' and regexp_matches(line, '#include\s*[<"]([^>"]+)[>"]')
    union all select path, language, line_no, 0, concat(regexp_extract(line, '^\s{6}\s+(\w[\w-]*)\s+DIVISION', 1), ' DIVISION')
      from lines where language = 'cobol' and regexp_matches(line, '^\s{6}\s+(\w[\w-]*)\s+DIVISION')
    union all select path, language, line_no, 1, concat('COPY ', regexp_extract(line, '(?i)COPY\s+([\w-]+)', 1))
      from lines where language = 'cobol' and regexp_matches(line, '(?i)COPY\s+([\w-]+)')
    union all select path, language, line_no, 0, concat('package:', regexp_extract(line, '^package\s+([\w.]+);', 1))
      from lines where language = 'java' and regexp_matches(line, '^package\s+([\w.]+);')
    union all select path, language, line_no, 1, regexp_extract(line, '^import\s+([\w.]+);', 1)
      from lines where language = 'java' and regexp_matches(line, '^import\s+([\w.]+);')
    union all select path, language, line_no, 0, trim(regexp_extract(line, '^use\s+([\w:{}*,\s]+);', 1))
      from lines where language = 'rust' and regexp_matches(line, '^use\s+([\w:{}*,\s]+);'))),
global_rows as (
  select path, language, row_number() over (partition by path order by line_no) - 1 as var_ord, var_name from (
    select l.path, l.language, l.line_no, regexp_extract(l.line, '^(?:const\s+|static\s+)?([\w:]+)\s+(\w+)\s*=', 2) as var_name
      from lines l where language = 'cpp' and regexp_matches(l.line, '^(?:const\s+|static\s+)?([\w:]+)\s+(\w+)\s*=')
      and not exists (select 1 from spans f where f.path = l.path and f.kind = 'function' and l.line_no between f.start_line and f.end_line)
    union all select path, language, line_no, regexp_extract(line, '^\s{6}\s+(?:01|77)\s+([\w-]+)', 1)
      from lines where language = 'cobol' and regexp_matches(line, '^\s{6}\s+(?:01|77)\s+([\w-]+)')
      and upper(regexp_extract(line, '^\s{6}\s+(?:01|77)\s+([\w-]+)', 1)) <> 'FILLER'))
"""
)

_SYMBOL_COLUMNS = "path, language, sym_ord, name, kind, start_line, end_line, params, return_type, complexity"


def analysed(spark, sf_dir, scored: bool = True) -> DataFrame:
    return SY.analyse_corpus(source_files(spark, sf_dir), scored=scored)


def flat(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("params", F.array_join("params", ", ")).drop("dependencies")


def _language_symbols(name: str, language: str, kinds: tuple[str, ...]) -> None:
    wanted = ", ".join(f"'{k}'" for k in kinds)

    @query(name, SYMBOLS + f"select {_SYMBOL_COLUMNS} from symbols where language = '{language}' and kind in ({wanted})")
    def run(spark, sf_dir):
        files = source_files(spark, sf_dir).where(F.col("language") == language)
        return flat(SY.symbol_table(SY.analyse_corpus(files))).where(F.col("kind").isin(*kinds))


_language_symbols("cpp_functions", "cpp", ("function",))
_language_symbols("cpp_records", "cpp", ("struct", "class"))
_language_symbols("cpp_enums", "cpp", ("enum",))
_language_symbols("cobol_paragraphs", "cobol", ("function",))
_language_symbols("java_methods", "java", ("function",))
_language_symbols("rust_functions", "rust", ("function",))
_language_symbols("rust_structs", "rust", ("struct",))


_WORDS = r"\b(?:if|else|for|while|switch|case|catch|PERFORM|IF|EVALUATE|match)\b"


# A class of the derived corpus runs from its head to the last line that is not empty.
@query(
    "java_classes",
    FILES + rf"""select path, regexp_extract(content, 'class (\w+)', 1) as name,
      len(string_split(split_part(content, 'public class', 1), chr(10))) as start_line, len(string_split(content, chr(10))) - 1 as end_line,
      least(10, 1 + len(regexp_extract_all(content, '{_WORDS}')) + len(regexp_extract_all(content, '&&'))) as complexity,
      concat_ws(', ', nullif(regexp_extract(content, 'extends (\w+)', 1), ''), nullif(regexp_extract(content, 'implements (\w+)', 1), '')) as dependencies
    from files where language = 'java'""",
)
def java_classes(spark, sf_dir):
    files = source_files(spark, sf_dir).where("language = 'java'")
    return (
        SY.symbol_table(SY.analyse_corpus(files)).where("kind = 'class'")
        .select("path", "name", "start_line", "end_line", "complexity", F.array_join("dependencies", ", ").alias("dependencies"))
    )


@query("corpus_symbols", SYMBOLS + f"select {_SYMBOL_COLUMNS} from symbols")
def corpus_symbols(spark, sf_dir):
    return flat(SY.symbol_table(analysed(spark, sf_dir)))


def _imports(name: str, language: str, extra: str = "true") -> None:
    @query(name, SYMBOLS + f"select * from import_rows where language = '{language}' and {extra}")
    def run(spark, sf_dir):
        files = source_files(spark, sf_dir).where(F.col("language") == language)
        return SY.import_table(SY.analyse_corpus(files)).where(extra)


_imports("cpp_includes", "cpp")
_imports("cobol_divisions", "cobol", "import_name not like 'COPY %'")
_imports("cobol_copy_members", "cobol", "import_name like 'COPY %'")
_imports("java_imports", "java")
_imports("rust_uses", "rust")


def _globals(name: str, language: str) -> None:
    @query(name, SYMBOLS + f"select * from global_rows where language = '{language}'")
    def run(spark, sf_dir):
        files = source_files(spark, sf_dir).where(F.col("language") == language)
        return SY.global_table(SY.analyse_corpus(files))


_globals("cpp_globals", "cpp")
_globals("cobol_variables", "cobol")


@query(
    "corpus_rollup",
    SYMBOLS + """, named as (select path, count(*) as n, string_agg(concat(kind, ' ', name), ', ' order by sym_ord) as names from symbols group by path),
      imported as (select path, string_agg(import_name, ', ' order by import_ord) as names from import_rows group by path),
      held_vars as (select path, string_agg(var_name, ', ' order by var_ord) as names from global_rows group by path)
    select f.path as filepath, f.language, len(string_split(f.content, chr(10))) as total_lines, coalesce(i.names, '') as imports,
      coalesce(v.names, '') as global_vars, coalesce(n.n, 0) as n_symbols, coalesce(n.names, '') as symbols
    from files f left join named n using (path) left join imported i using (path) left join held_vars v using (path)""",
)
def corpus_rollup(spark, sf_dir):
    return SY.file_rollup(analysed(spark, sf_dir)).select(
        "filepath", "language", "total_lines", F.array_join("imports", ", ").alias("imports"), F.array_join("global_vars", ", ").alias("global_vars"),
        F.size("symbols").alias("n_symbols"), F.expr("array_join(transform(symbols, s -> concat(s.kind, ' ', s.name)), ', ')").alias("symbols"),
    )


@query(
    "corpus_totals",
    SYMBOLS + """select f.language, count(*) as total_files, sum(len(string_split(f.content, chr(10)))) as total_lines,
      sum(coalesce(n, 0)) as total_symbols from files f
      left join (select path, count(*) as n from symbols group by path) s using (path) group by f.language""",
)
def corpus_totals(spark, sf_dir):
    return SY.project_totals(analysed(spark, sf_dir), "language")


@query(
    "most_complex_symbols",
    SYMBOLS + "select path, sym_ord, name, kind, complexity, start_line from symbols order by complexity desc, path, sym_ord limit 10",
)
def most_complex_symbols(spark, sf_dir):
    rows = SY.symbol_table(analysed(spark, sf_dir)).select("path", "sym_ord", "name", "kind", "complexity", "start_line")
    return SY.most_complex(rows)


@query(
    "file_summaries",
    SYMBOLS + r""", imported as (select path, string_agg(import_name, ', ' order by import_ord) filter (where import_ord < 10) as names from import_rows group by path),
    signed as (select path, string_agg(concat('//   ', kind, ': ', name, '(', params, ')',
        case when return_type <> '' then concat(' -> ', return_type) else '' end, ' [L', start_line, '-', end_line, ']'), chr(10) order by sym_ord) as texts
      from symbols group by path)
    select f.path, concat('// Archivo: ', regexp_extract(f.path, '([^/]*)$', 1), ' (', f.language, ', ', len(string_split(f.content, chr(10))), ' líneas)', chr(10),
      '// Imports: ', coalesce(names, 'ninguno'), chr(10), '// Símbolos:', case when texts is null then '' else concat(chr(10), texts) end) as summary
    from files f left join imported using (path) left join signed using (path)""",
)
def file_summaries(spark, sf_dir):
    return SY.file_summary(analysed(spark, sf_dir))


_CONTEXT_SQL = r""", listed as (
  select path, string_agg(concat('//   ', kind, ': ', name), chr(10) order by sym_ord) filter (where sym_ord < 10) as texts from symbols group by path),
context as (
  select concat('d', f.o_orderkey % 100) as project, f.path, concat('// Archivo: ', regexp_extract(f.path, '([^/]*)$', 1), ' (', len(string_split(f.content, chr(10))), ' líneas)',
    case when texts is null then '' else concat(chr(10), texts) end) as context
  from files f left join listed using (path))"""


def _with_project(df: DataFrame) -> DataFrame:
    return df.withColumn("project", F.concat(F.lit("d"), F.col("o_orderkey") % 100))


@query("project_context", SYMBOLS + _CONTEXT_SQL + " select project, path, context from context")
def project_context(spark, sf_dir):
    return SY.context_lines(_with_project(SY.symbol_outlines(source_files(spark, sf_dir), "name", "kind")), "project")


# --- segments ---------------------------------------------------------------

SEGMENTS = (
    SYMBOLS
    + r""",
classed as (
  select path, stem, line_no, line, total_lines,
    case when regexp_matches(line, '#include|import |use |COPY |package ') or regexp_matches(trim(line), '^(//|/\*|\*)') then 2
         when trim(line) = '' then 1 else 0 end as class
  from lines where path in (select path from import_rows)),
firsts as (select *, min(case when class = 2 then line_no end) over (partition by path) as first_hit from classed),
stops as (select *, min(case when class = 0 and line_no > first_hit then line_no end) over (partition by path) as stop from firsts),
headers as (
  select path, stem, 'imports/includes' as name, 'header' as id_part, 'header' as kind, string_agg(line, chr(10) order by line_no) as code,
    1 as start_line, count(*) as end_line, 1 as complexity, 0 as part, 0 as place
  from stops where line_no >= first_hit and line_no < coalesce(stop, total_lines + 1) group by path, stem),
global_lines as (
  select distinct l.path, l.stem, l.line_no, l.line from lines l join global_rows g on g.path = l.path
  where contains(l.line, g.var_name) and contains(l.line, '=')),
global_segments as (
  select path, stem, 'variables_globales' as name, 'globals' as id_part, 'globals' as kind, string_agg(line, chr(10) order by line_no) as code,
    min(line_no) as start_line, max(line_no) as end_line, 1 as complexity, 1 as part, 0 as place
  from global_lines group by path, stem),
held as (
  select c.path, c.sym_ord, f.name, f.end_line, f.complexity
  from symbols c join symbols f on f.path = c.path and f.kind = 'function' and f.start_line between c.start_line and c.end_line
  where c.kind in ('struct', 'class')),
groups as (
  select c.path, c.stem, c.name, c.kind, c.start_line, greatest(c.end_line, max(h.end_line)) as end_line,
    greatest(c.complexity, max(h.complexity)) as complexity, 0 as tier, c.sym_ord
  from symbols c left join held h on h.path = c.path and h.sym_ord = c.sym_ord where c.kind in ('struct', 'class')
  group by c.path, c.stem, c.name, c.kind, c.start_line, c.end_line, c.complexity, c.sym_ord
  union all select path, stem, name, kind, start_line, end_line, complexity, 1, sym_ord from symbols s
    where kind = 'function' and not exists (select 1 from held h where h.path = s.path and h.name = s.name)
  union all select path, stem, name, kind, start_line, end_line, complexity, 2, sym_ord from symbols where kind = 'enum'),
placed as (
  select *, min(tier * 1000000 + sym_ord) over (partition by path, name) as place,
    row_number() over (partition by path, name order by tier desc, sym_ord desc) as newest from groups),
symbol_segments as (
  select p.path, p.stem, p.name, p.name as id_part, p.kind, array_to_string(c.ls[p.start_line:p.end_line], chr(10)) as code,
    p.start_line, p.end_line, p.complexity, 2 as part, p.place
  from placed p join cut c using (path) where newest = 1),
segments as (
  select path, name, concat(stem, '::', id_part) as segment_id, kind, code, start_line, end_line, complexity,
    row_number() over (partition by path order by part, place) - 1 as seg_ord
  from (select * from headers union all select * from global_segments union all select * from symbol_segments where trim(code, e' \n\t') <> ''))
"""
)


def corpus_segments(spark, sf_dir, kinds: tuple[str, ...] = ()) -> DataFrame:
    return SG.segment_corpus(_with_project(analysed(spark, sf_dir)), "project", kinds=kinds)


@query("segments", SEGMENTS + "select path, seg_ord, segment_id, kind, name, code, start_line, end_line, complexity, '' as dependencies from segments")
def segments(spark, sf_dir):
    return corpus_segments(spark, sf_dir).select(
        "path", "seg_ord", "segment_id", "kind", "name", "code", "start_line", "end_line", "complexity",
        F.array_join("dependencies", ",").alias("dependencies"),
    )


def _segment_kinds(name: str, kinds: tuple[str, ...]) -> None:
    wanted = ", ".join(f"'{k}'" for k in kinds)

    @query(name, SEGMENTS + f"select path, segment_id, kind, code, start_line, end_line from segments where kind in ({wanted})")
    def run(spark, sf_dir):
        files = source_files(spark, sf_dir)
        if set(kinds) <= set(SG.GROUPED):
            files = files.where(F.col("language").isin(*{x for k in kinds for x in SG.GROUPED[k]}))
        made = SG.segment_corpus(SY.analyse_corpus(files, scored=not set(kinds) <= set(SG.GROUPED)), kinds=kinds)
        return made.select("path", "segment_id", "kind", "code", "start_line", "end_line")


_segment_kinds("header_segments", ("header",))
_segment_kinds("global_segments", ("globals",))
_segment_kinds("container_segments", ("struct", "class"))
_segment_kinds("function_segments", ("function",))
_segment_kinds("enum_segments", ("enum",))


_FUNCTION_LINES = rf"""functions as (
  select path, language, line_no as start_line, regexp_extract(line, '{_FN_CPP}', 2) as name from lines where language = 'cpp' and regexp_matches(line, '{_FN_CPP}')
  union all select path, language, line_no, regexp_extract(line, '{_FN_JAVA}', 2) from lines where language = 'java' and regexp_matches(line, '{_FN_JAVA}')
  union all select path, language, line_no, regexp_extract(line, '{_FN_RUST}', 1) from lines where language = 'rust' and regexp_matches(line, '{_FN_RUST}')
  union all select path, language, line_no, regexp_extract(line, '{_PARA}', 1) from lines where language = 'cobol' and regexp_matches(line, '{_PARA}')
    and not regexp_matches(upper(line), 'DIVISION|SECTION|STORAGE'))"""


# In the derived corpus only Java classes hold functions: all of their file.
@query("containment_pairs", LINES + ", " + _FUNCTION_LINES + r""" select path, regexp_extract(content, 'class (\w+)', 1) as container, name as function
  from functions join files using (path) where functions.language = 'java'""")
def containment_pairs(spark, sf_dir):
    return SG.containment(analysed(spark, sf_dir))


@query("free_functions", LINES + ", " + _FUNCTION_LINES + " select path, name, start_line from functions where language <> 'java'")
def free_functions(spark, sf_dir):
    return SG.free_functions(analysed(spark, sf_dir))


@query("segment_spans", SEGMENTS + "select path, segment_id, end_line - start_line + 1 as span, complexity from segments")
def segment_spans(spark, sf_dir):
    return corpus_segments(spark, sf_dir).select(
        "path", "segment_id", (F.col("end_line") - F.col("start_line") + 1).alias("span"), "complexity"
    )


@query("most_complex_segment", SEGMENTS + "select path, segment_id, complexity from segments order by complexity desc, path, seg_ord limit 1")
def most_complex_segment(spark, sf_dir):
    rows = corpus_segments(spark, sf_dir).select("path", "seg_ord", "segment_id", "complexity")
    return rows.orderBy(F.desc("complexity"), "path", "seg_ord").limit(1).drop("seg_ord")


@query("segment_prompt_context", SEGMENTS + """select path, segment_id,
  concat('// Part: ', name, ' (', kind, ')', chr(10), '// Needs: none', chr(10), chr(10), code) as prompt_context from segments""")
def segment_prompt_context(spark, sf_dir):
    return SG.prompt_context(corpus_segments(spark, sf_dir)).select("path", "segment_id", "prompt_context")


@query("segments_with_context", SEGMENTS + _CONTEXT_SQL + r""", joined as (
  select project, count(*) as context_files, sum(length(context) + 1) + length('// === The project so far ===') as context_chars,
    sum(('0x' || substr(md5(concat(path, chr(10), context)), 1, 12))::bigint)::varchar as context_digest from context group by project)
  select s.path, s.segment_id, j.project, context_files, context_chars, context_digest
  from segments s join files f using (path) join joined j on j.project = concat('d', f.o_orderkey % 100)""")
def segments_with_context(spark, sf_dir):
    # Both sides need the analysis: names and heading are written once. Only spans are looked for.
    names = SG.segment_names(F.col("content"), F.col("imports"), F.col("global_vars"), F.col("symbols"))
    nested = settle(
        _with_project(analysed(spark, sf_dir, scored=False)).withColumn("names", names).select(
            "path", "project", SY.context_text().alias("context"),
            F.expr("transform(names, n -> concat_ws('::', stem, n))").alias("segment_ids"),
        )
    )
    rows = SY.explode_rows(nested, "path", "project", array="segment_ids", position="seg_ord", value="segment_id").drop("seg_ord")
    return SG.attach_context(rows, nested, "project")


# --- text functions ------------------------------------------------------------


@query("path_parts", FILES + r""" select path, language, concat(stem, ext) as basename, stem, ext as suffix from files""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return source_files(spark, sf_dir).select(
        "path", L.language_of_path(p).alias("language"), T.basename(p).alias("basename"),
        T.stem(p).alias("stem"), T.suffix(p).alias("suffix"),
    )


@query("document_line_counts", r"""select doc_id, len(string_split(text, chr(10))) as split_lines,
  case when text = '' then 0 when right(text, 1) = chr(10) then len(string_split(text, chr(10))) - 1 else len(string_split(text, chr(10))) end as splitlines,
  len(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))) as stripped_lines from documents""")
def document_line_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.line_count_split(t).alias("split_lines"), T.line_count_splitlines(t).alias("splitlines"),
        T.line_count_stripped(t).alias("stripped_lines"),
    )


@query("numbered_lines", LINES + " select path, line_no, line from lines")
def numbered_lines(spark, sf_dir):
    split = source_files(spark, sf_dir).withColumn("lines", T.split_lines(F.col("content")))
    return SY.explode_rows(split, "path", array="lines", position="line_no", value="line").withColumn("line_no", F.col("line_no") + 1)


@query("page_pattern_counts", r"""select page_id, len(regexp_extract_all(html, '[{}]')) as braces,
  len(regexp_extract_all(html, '<a href="')) as links, len(regexp_extract_all(html, '"([^"]{4,})"')) as literals from pages""")
def page_pattern_counts(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.count_matches(h, "[{}]").alias("braces"), T.count_matches(h, '<a href="').alias("links"),
        T.count_matches(h, '"([^"]{4,})"').alias("literals"),
    )


@query("call_match_table", LINES + r""", hits as (
  select path, line_no as start_line, unnest(regexp_extract_all(line, '(\w+)\(([^()]*)\)')) as text from lines)
  select path, start_line, text, regexp_extract(text, '(\w+)\(([^()]*)\)', 1) as callee from hits""")
def call_match_table(spark, sf_dir):
    pattern = rf"({T.W}+)\(([^()\n]*)\)"
    matched = source_files(spark, sf_dir).withColumn("calls", T.match_table(F.col("content"), pattern))
    rows = SY.explode_rows(matched, "path", array="calls", position="call_ord", value="m")
    return rows.select("path", "m.start_line", "m.text", F.regexp_extract("m.text", pattern, 1).alias("callee"))


@query("string_literals", r"""select page_id, unnest(list_distinct(regexp_extract_all(html, '"([^"]{4,})"', 1))) as literal from pages""")
def string_literals(spark, sf_dir):
    found = table(spark, sf_dir, "pages").withColumn("literals", F.array_distinct(T.find_all(F.col("html"), '"([^"]{4,})"', 1)))
    return SY.explode_rows(found, "page_id", array="literals", position="literal_ord", value="literal").select("page_id", "literal")


@query("document_previews", r"select doc_id, trim(replace(left(text, 80), chr(10), ' ')) as preview from documents")
def document_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.strip(F.replace(F.left("text", F.lit(80)), F.lit("\n"), F.lit(" "))).alias("preview")
    )


@query("parameter_lists", SYMBOLS + """select path, sym_ord, unnest(string_split(params, ', ')) as param from symbols where params <> ''""")
def parameter_lists(spark, sf_dir):
    symbols = SY.symbol_table(SY.symbol_outlines(source_files(spark, sf_dir), "params"))
    rows = SY.explode_rows(symbols, "path", "sym_ord", array="params", position="param_ord", value="param")
    return rows.select("path", "sym_ord", "param")
