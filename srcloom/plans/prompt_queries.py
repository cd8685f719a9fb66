"""Queries around the model call, and of folders and file pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.functions import formats as FM
from srcloom.functions import text as T
from srcloom.operators import prompts as P
from srcloom.operators import rewrite as RW
from srcloom.plans.derived import source_files, table
from srcloom.plans.registry import query
from srcloom.plans.structure_queries import FILES
from srcloom.sources import code_tree as CT

_TYPES = ["cpp_to_rust", "java8_to_java17", "cobol_to_java", "java7_to_python", "php_to_python", "html_to_react", "cobol_to_rust", "perl_to_go"]
_TYPE_SQL = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "][conv_id % 8 + 1]"
_TURNS = f"""turns as (select u.conv_id, u.turn, {_TYPE_SQL.replace('conv_id', 'u.conv_id')} as migration_type, u.text as request, a.text as answer
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user')"""
_WRAPPED = _TURNS + """, wrapped as (select *, case conv_id % 4 when 0 then answer when 1 then concat('```rust', chr(10), answer, chr(10), '```')
  when 2 then concat('<think>', chr(10), 'plan ', turn, chr(10), '</think>', chr(10), '```', chr(10), answer, chr(10), '```')
  else concat('ok', chr(10), '<think> open', chr(10), answer) end as response from turns)"""


def turns(spark, sf_dir):
    """User turns with the answer in the next turn: an equality join on the unique
    (conversation, turn), so a long conversation is spread over all tasks."""
    said = table(spark, sf_dir, "conversations")
    asked = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("request"), (F.col("turn") + 1).alias("next"))
    answered = said.where("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("answer"))
    kinds = ", ".join(f"'{t}'" for t in _TYPES)
    return asked.join(answered, ["conv_id", "next"]).selectExpr(
        "conv_id", "turn", f"element_at(array({kinds}), cast(conv_id % 8 + 1 as int)) as migration_type", "request", "answer"
    )


def wrapped(spark, sf_dir):
    return turns(spark, sf_dir).selectExpr(
        "*", r"""case conv_id % 4 when 0 then answer when 1 then concat('```rust\n', answer, '\n```')
          when 2 then concat('<think>\nplan ', turn, '\n</think>\n```\n', answer, '\n```') else concat('ok\n<think> open\n', answer) end as response"""
    )


_TEMPLATE_ROWS = ", ".join("('" + k + "', '" + v.replace("\n", "' || chr(10) || '") + "')" for k, v in P.TEMPLATES.items())
_KNOWN = "[''" + "'', ''".join(P.TEMPLATES) + "'']"


@query("prompts", f"""with {_TURNS}, templates(migration_type, template) as (values {_TEMPLATE_ROWS})
  select conv_id, turn, replace(template, '{{source_code}}', request) as prompt, template is not null as success,
    case when template is null then concat('no template for ', migration_type, '; there are {_KNOWN}') end as error
  from turns left join templates using (migration_type)""")
def prompts(spark, sf_dir):
    built = P.build_prompts(turns(spark, sf_dir).withColumnRenamed("request", "source_code"))
    return built.select("conv_id", "turn", "prompt", "success", "error")


@query("migration_sides", f"""with {_TURNS} select conv_id, turn, split_part(migration_type, '_to_', 1) as source, split_part(migration_type, '_to_', -1) as target from turns""")
def migration_sides(spark, sf_dir):
    source, target = FM.migration_sides(F.col("migration_type"))
    return turns(spark, sf_dir).select("conv_id", "turn", source.alias("source"), target.alias("target"))


@query("hint_prompts", FILES + r""", java as (select path, content, len(regexp_extract_all(content, 'Arrays\.asList\(([^)]*)\)')) as n,
    regexp_replace(content, 'Arrays\.asList\(([^)]*)\)', 'List.of(\1)', 'g') as rewritten from files where language = 'java')
  select path, case when n > 0 then concat(chr(10), '// Rules that have changed this code, and how often:', chr(10), '// java_collections_modern: ', n, chr(10),
    '// Convert what they left:', chr(10), chr(10), rewritten) else content end as prompt from java""")
def hint_prompts(spark, sf_dir):
    java = source_files(spark, sf_dir).where("language = 'java'").withColumn("prompt", F.col("content"))
    return P.with_hint(RW.rewrite(java, [RW.JAVA_COLLECTIONS_HARD]), "prompt").select("path", "prompt")


@query("clean_responses", f"with {_WRAPPED} select conv_id, turn, case when conv_id % 4 = 3 then 'ok' else trim(answer) end as code from wrapped")
def clean_responses(spark, sf_dir):
    return wrapped(spark, sf_dir).select("conv_id", "turn", P.clean_response(F.col("response")).alias("code"))


@query("response_outcomes", f"""with {_WRAPPED} select conv_id, turn, conv_id % 5 <> 0 as success, case when conv_id % 5 = 0 then left(request, 500) end as short_error,
  case when conv_id % 5 = 0 then '' when conv_id % 4 = 3 then 'ok' else trim(answer) end as migrated_code from wrapped""")
def response_outcomes(spark, sf_dir):
    responses = wrapped(spark, sf_dir).withColumn("error", F.when(F.col("conv_id") % 5 == 0, F.col("request")))
    return P.outcomes(responses).select("conv_id", "turn", "success", "short_error", "migrated_code")


@query("output_names", FILES + r""" select path, concat(stem, case o_orderkey % 5 when 0 then '.py' when 1 then '.rs' when 2 then '.java' when 3 then '.tsx' else '.txt' end) as output from files""")
def output_names(spark, sf_dir):
    target = F.element_at(F.array(*[F.lit(x) for x in ["python", "rust", "java", "react", "go"]]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return source_files(spark, sf_dir).select("path", P.output_name(target, F.col("path")).alias("output"))


@query("folder_totals", FILES + r""", kept as (select regexp_replace(path, '/[^/]*$', '') as folder, path, ext, len(string_split(content, chr(10))) - 1 as lines
    from files where ext <> '.rs')
  select folder, count(*) as total_files, sum(lines) as total_lines, arg_min(case ext when '.cpp' then 'cpp' when '.cob' then 'cobol' else 'java7' end, path) as detected_language,
    arg_min(case ext when '.cpp' then 'cpp_to_rust' when '.cob' then 'cobol_to_rust' else 'java7_to_python' end, path) as suggested_migration from kept group by folder""")
def folder_totals(spark, sf_dir):
    files = source_files(spark, sf_dir).select("path", "content", F.length("content").alias("length"), T.parent(F.col("path")).alias("folder"))
    return CT.folder_totals(CT.folder_files(files))


@query("document_folders", """select source as folder, count(*) as total_files, sum(case when text = '' then 0 else len(string_split(text, chr(10))) - case when right(text, 1) = chr(10) then 1 else 0 end end) as total_lines
  from documents group by source""")
def document_folders(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".html")).alias("path"), F.col("text").alias("content"),
        F.octet_length("text").alias("length"), F.col("source").alias("folder"),
    )
    return CT.folder_totals(CT.folder_files(files)).select("folder", "total_files", "total_lines")


@query("folder_listing", FILES + " select distinct split_part(path, '/', 2) as name, true as is_dir from files")
def folder_listing(spark, sf_dir):
    return CT.file_catalogue(source_files(spark, sf_dir).select(F.regexp_replace("path", "^src/", "").alias("path")))


@query("paired_files", FILES + r""", done as (select concat('f', o_orderkey) as stem, concat('src/d', o_orderkey % 100) as folder, case when o_orderstatus = 'F' then concat('fn f', o_orderkey, '() {}') else '' end as code
    from orders where o_orderstatus <> 'P')
  select f.path, concat(folder_of, '/', f.stem, '.rs') as target_file, coalesce(code, '') as target_code, case when coalesce(code, '') <> '' then 'migrated' else 'pending' end as status
  from (select *, regexp_replace(path, '/[^/]*$', '') as folder_of from files) f left join done d on d.stem = f.stem and d.folder = folder_of""")
def paired_files(spark, sf_dir):
    sources = source_files(spark, sf_dir).withColumn("folder", T.parent(F.col("path")))
    migrated = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").selectExpr(
        "concat('f', o_orderkey) as stem", "concat('src/d', o_orderkey % 100) as folder",
        "concat('src/d', o_orderkey % 100, '/f', o_orderkey, '.rs') as path",
        "case when o_orderstatus = 'F' then concat('fn f', o_orderkey, '() {}') else '' end as content",
    )
    return CT.pair_files(sources, migrated).select("path", "target_file", "target_code", "status")
