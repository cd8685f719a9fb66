"""A code corpus derived from the given tables: one order is one file.

Used to exercise the engine on code-shaped input that grows with the tables.
The text fragments are plain SQL that means the same in Spark and in the
checking engine, so both sides read byte-equal files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGE = (
    "case o_orderkey % 4 when 0 then 'cpp' when 1 then 'cobol' when 2 then 'java' else 'rust' end"
)
EXTENSION = (
    "case o_orderkey % 4 when 0 then '.cpp' when 1 then '.cob' when 2 then '.java' else '.rs' end"
)


def _text(*lines: str) -> str:
    """SQL for lines of text; ``{expr}`` in a line is a spliced SQL expression."""
    parts: list[str] = []
    for line in lines:
        for i, piece in enumerate(line.split("`")):
            if piece:
                parts.append(piece if i % 2 else "'" + piece + "'")
        parts.append("chr(10)")
    return "concat(" + ", ".join(parts) + ")"


def file_header() -> str:
    cpp = _text(
        "#include <stdio.h>", "#include <vector>", "", "struct S`o_orderkey` {", "    int x;", "};",
        "", "enum E`o_orderkey` {", "    LOW,", "    HIGH", "};", "", "int limit = 10;", "",
    )
    cobol = _text(
        "       IDENTIFICATION DIVISION.", "       PROGRAM-ID. F`o_orderkey`.",
        "       DATA DIVISION.", "       WORKING-STORAGE SECTION.",
        "       COPY MEMBER-`o_orderkey % 5`.", "       01  WS-A PIC 9(5).", "       PROCEDURE DIVISION.",
    )
    java = _text(
        "package corpus;", "", "import java.util.Arrays;", "", "public class C`o_orderkey` {",
    )
    rust = _text("use std::io;", "", "pub struct R`o_orderkey` {", "    x: i32,", "}", "")
    return (
        f"case o_orderkey % 4 when 0 then {cpp} when 1 then {cobol} when 2 then {java} else {rust} end"
    )


FILE_FOOTER = "case when o_orderkey % 4 = 2 then concat('}', chr(10)) else '' end"
PAIR_HEADER = _text("use std::io;", "", "struct S`o_orderkey`;", "")


def _function(pk: str, sk: str, q: str, flag: str) -> dict[str, str]:
    name = f"fn_`{pk}`_`{sk}`"
    loop = f"case when {flag} = 'R' then {_text('    for (int i = 0; i < a; i++) {{ b++; }}'.replace('{{', '{').replace('}}', '}'))} else '' end"
    cpp = (
        "concat("
        + _text(f"int {name}(int a, int b) {{", f"    if (a > `{q}`) {{", "        return b;", "    }")
        + f", {loop}, "
        + _text(f'    printf("part `{pk}`");', "    return a;", "}")
        + ")"
    )
    cobol = _text(
        f"       P-`{pk}`-`{sk}`.", f"           IF WS-A > `{q}`", f'               DISPLAY "part `{pk}`"',
        "           END-IF.",
    )
    java = _text(
        f"    public int {name}(int a, int b) {{", f"        if (a > `{q}` && b > 0) {{ return b; }}",
        f"        return Arrays.asList(a, `{pk}`).size();", "    }",
    )
    rust = _text(
        f"fn {name}(a: i32) -> i32 {{", f"    if a > `{q}` {{ return 1; }}", f'    println!("part `{pk}`");',
        "    a", "}",
    )
    return {"cpp": cpp, "cobol": cobol, "java": java, "rust": rust}


def source_function(pk: str, sk: str, q: str, flag: str) -> str:
    f = _function(pk, sk, q, flag)
    return (
        f"case o_orderkey % 4 when 0 then {f['cpp']} when 1 then {f['cobol']} "
        f"when 2 then {f['java']} else {f['rust']} end"
    )


def rust_function(pk: str, sk: str, q: str, flag: str) -> str:
    return _function(pk, sk, q, flag)["rust"]


PATH = f"concat('src/d', o_orderkey % 100, '/f', o_orderkey, {EXTENSION})"
STEM = "concat('f', o_orderkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their functions in order. A file is one value of one row, so
    its functions meet in that row; only keys travel, the text is made after.
    Both sides are cut by order once, which serves the grouping and the join and
    keeps the number of tasks up for the text work behind them."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.struct(
                F.col("l_linenumber").alias("n"),
                F.col("l_partkey").alias("pk"),
                F.col("l_suppkey").alias("sk"),
                F.col("l_extendedprice").alias("price"),
                F.col("l_quantity").cast("int").alias("q"),
                F.col("l_returnflag").alias("flag"),
            ).alias("f"),
        )
        .repartition(n, "o_orderkey")
        .groupBy("o_orderkey")
        .agg(F.array_sort(F.collect_list("f")).alias("functions"))
    )
    orders = table(spark, sf_dir, "orders").repartition(n, "o_orderkey")
    return orders.join(items, "o_orderkey", "left")


_JOINED = "array_join(transform(coalesce(functions, array()), f -> {}), '')"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source side: path, stem, ext, language, content."""
    body = _JOINED.format(source_function("f.pk", "f.sk", "f.q", "f.flag"))
    return order_functions(spark, sf_dir).selectExpr(
        "o_orderkey",
        f"{PATH} as path",
        f"{STEM} as stem",
        f"{EXTENSION} as ext",
        f"{LANGUAGE} as language",
        f"concat({file_header()}, {body}, {FILE_FOOTER}) as content",
    )


def perturb(body_all: str, body_sparse: str) -> str:
    """The migrated text of an order, damaged in a known way per status and priority."""
    by_status = f"""case o_orderstatus
        when 'O' then concat({PAIR_HEADER}, {body_sparse})
        when 'P' then concat({PAIR_HEADER}, {body_all}, 'fn tail() {{ let p = NULL;', chr(10))
        else concat({PAIR_HEADER}, {body_all}) end"""
    return f"""case o_orderpriority
        when '1-URGENT' then ''
        when '5-LOW' then concat('use fake_crate_', o_orderkey % 7, '::x;', chr(10), {by_status})
        else {by_status} end"""


def migration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text with its migrated text, which is always Rust."""
    source = _JOINED.format(source_function("f.pk", "f.sk", "f.q", "f.flag"))
    rust = rust_function("f.pk", "f.sk", "f.q", "f.flag")
    every = _JOINED.format(rust)
    sparse = f"array_join(transform(filter(coalesce(functions, array()), (f, i) -> i % 4 = 0), f -> {rust}), '')"
    return order_functions(spark, sf_dir).selectExpr(
        "o_orderkey as pair_id",
        "concat('d', o_orderkey % 100) as project",
        f"{PATH} as path",
        f"concat({STEM}, '::all') as segment_id",
        f"{LANGUAGE} as source_language",
        "'rust' as target_language",
        f"concat({file_header()}, {source}, {FILE_FOOTER}) as source",
        f"{perturb(every, sparse)} as migrated",
    )


_ORDER_KEYS = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag"
_ITEM = ("l_partkey", "l_suppkey", "cast(l_quantity as int)", "l_returnflag")


def sql_source_files() -> str:
    """The body of a ``files`` common table expression for the checking engine."""
    return f"""files as (
      select o_orderkey, {PATH} as path, {STEM} as stem, {EXTENSION} as ext, {LANGUAGE} as language,
        concat({file_header()}, coalesce(string_agg({source_function(*_ITEM)}, '' order by {_ORDER_KEYS})
          filter (where l_orderkey is not null), ''), {FILE_FOOTER}) as content
      from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"""


def sql_migration_pairs() -> str:
    """The body of a ``pairs`` common table expression for the checking engine."""
    return f"""numbered as (
      select *, row_number() over (partition by l_orderkey order by {_ORDER_KEYS}) - 1 as fn_no from lineitem),
    texts as (
      select o_orderkey, any_value(o_orderstatus) as o_orderstatus, any_value(o_orderpriority) as o_orderpriority,
        coalesce(string_agg({source_function(*_ITEM)}, '' order by fn_no) filter (where l_orderkey is not null), '') as src,
        coalesce(string_agg({rust_function(*_ITEM)}, '' order by fn_no) filter (where l_orderkey is not null), '') as every,
        coalesce(string_agg({rust_function(*_ITEM)}, '' order by fn_no) filter (where l_orderkey is not null and fn_no % 4 = 0), '') as sparse
      from orders left join numbered on l_orderkey = o_orderkey group by o_orderkey),
    pairs as (
      select o_orderkey as pair_id, concat('d', o_orderkey % 100) as project, {PATH} as path,
        concat({STEM}, '::all') as segment_id, {LANGUAGE} as source_language, 'rust' as target_language,
        concat({file_header()}, src, {FILE_FOOTER}) as source, {perturb("every", "sparse")} as migrated
      from texts)"""
