"""Queries over copybooks, one per nation with widths of its own, and over records written by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.plans.derived import table
from srcloom.plans.registry import query
from srcloom.sources import copybooks as CB

#: Lines of a nation's copybook as SQL of its key k; both engines read them alike.
_LINES = [
    "'       01 CUSTOMER-REC.'", "'      * key first'", "'          05 CUST-KEY PIC 9(8).'", "'          05 WHO.'",
    "concat('             10 CUST-NAME PIC X(', 20 + k, ').')", "'             10 SEGMENT PIC X(10) VALUE ''A. PIC 9(3)''.'",
    "'             88 IS-BUILDER VALUE ''BUILDING''.'", "'          05 BALANCE PIC S9(7)V99.'",
    "concat('          05 MARKS OCCURS ', 2 + k % 3, ' TIMES.')", "'             10 MARK PIC 9(2).'", "'             10 FILLER PIC X.'",
    "'       01 NOTE-REC.'", "'          05 NOTE-KEY PIC 9(8).'", "'          05 NOTE-TEXT PIC X(12).'", "'          05 NOTE-TAIL REDEFINES NOTE-TEXT.'",
    "'             10 HEAD PIC X(4).'", "'             10 REST PIC X(8).'", "'          05 DEBT PIC S9(5) SIGN LEADING SEPARATE.'",
]
#: record, level, qualified name, kind, start, width, times; of k too.
_ITEMS = [
    (1, 1, "customer_rec", "group", "1", "(47 + k + 3 * (2 + k % 3))", "1"), (1, 5, "customer_rec.cust_key", "number", "1", "8", "1"),
    (1, 5, "customer_rec.who", "group", "9", "(30 + k)", "1"), (1, 10, "customer_rec.who.cust_name", "text", "9", "(20 + k)", "1"),
    (1, 10, "customer_rec.who.segment", "text", "(29 + k)", "10", "1"), (1, 5, "customer_rec.balance", "number", "(39 + k)", "9", "1"),
    (1, 5, "customer_rec.marks", "group", "(48 + k)", "(3 * (2 + k % 3))", "(2 + k % 3)"), (1, 10, "customer_rec.marks.mark", "number", "(48 + k)", "2", "1"),
    (1, 10, "customer_rec.marks.filler", "text", "(50 + k)", "1", "1"),
    (2, 1, "note_rec", "group", "1", "26", "1"), (2, 5, "note_rec.note_key", "number", "1", "8", "1"), (2, 5, "note_rec.note_text", "text", "9", "12", "1"),
    (2, 5, "note_rec.note_tail", "group", "9", "12", "1"), (2, 10, "note_rec.note_tail.head", "text", "9", "4", "1"),
    (2, 10, "note_rec.note_tail.rest", "text", "13", "8", "1"), (2, 5, "note_rec.debt", "number", "21", "6", "1"),
]


def copybooks(spark, sf_dir):
    text = "concat_ws(chr(10), " + ", ".join(_LINES).replace("''", "\\'") + ")"
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) as k").selectExpr("concat('n', k, '.cpy') as path", f"{text} as content")


_TREE = " union all ".join(
    f"select 'n' || k || '.cpy' as path, {i} as item_ord, {r} as record, {level} as level, '{name}' as qualified, '{kind}' as kind, "
    f"{start} as start, {width} as width, {times} as times from n"
    for i, (r, level, name, kind, start, width, times) in enumerate(_ITEMS)
)


@query("copybook_tree", f"with n as (select n_nationkey::int as k from nation) {_TREE}")
def copybook_tree(spark, sf_dir):
    return CB.layout_tree(copybooks(spark, sf_dir)).select("path", "item_ord", "record", "level", "qualified", "kind", "start", "width", "times")


_RECORDS = """with c as (select *, c_nationkey::int as k, cast(c_acctbal as decimal(9,2)) as bal from customer),
  marks as (select c_custkey, unnest(range(1, 3 + k % 3)) as i from c)
  select c_custkey, 1 as record, 'customer_rec.cust_key' as name, '' as index, c_custkey::varchar as value from c
  union all select c_custkey, 1, 'customer_rec.who.cust_name', '', c_name from c
  union all select c_custkey, 1, 'customer_rec.who.segment', '', c_mktsegment from c
  union all select c_custkey, 1, 'customer_rec.balance', '', bal::varchar from c
  union all select c_custkey, 1, 'customer_rec.marks.mark', i::varchar, (((c_custkey + i) % 100)::int)::varchar from marks
  union all select c_custkey, 2, 'note_rec.note_key', '', c_custkey::varchar from c
  union all select c_custkey, 2, 'note_rec.note_text', '', left(c_mktsegment, 4) || 'tail' || (c_custkey % 7) from c
  union all select c_custkey, 2, 'note_rec.note_tail.head', '', left(c_mktsegment, 4) from c
  union all select c_custkey, 2, 'note_rec.note_tail.rest', '', 'tail' || (c_custkey % 7) from c
  union all select c_custkey, 2, 'note_rec.debt', '', ((c_custkey % 1999) - 999)::varchar from c"""


def rendered_records(spark, sf_dir):
    """Two records per customer, written by hand in the layout of the customer's nation."""
    c = table(spark, sf_dir, "customer").selectExpr("*", "cast(c_nationkey as int) as k", "cast(cast(c_acctbal as decimal(9,2)) * 100 as bigint) as cents", "concat('n', c_nationkey, '.cpy') as path")
    digits = "lpad(cast(abs(cents) as string), 9, '0')"
    balance = f"concat(left({digits}, 8), translate(right({digits}, 1), '0123456789', case when cents < 0 then '}}JKLMNOPQR' else '{{ABCDEFGHI' end))"
    marks = "array_join(transform(sequence(1, 2 + k % 3), i -> concat(lpad(cast((c_custkey + i) % 100 as string), 2, '0'), '/')), '')"
    one = c.selectExpr("c_custkey", "path", "1 as record", f"concat(lpad(c_custkey, 8, '0'), rpad(c_name, 20 + k, ' '), rpad(c_mktsegment, 10, ' '), {balance}, {marks}) as value")
    debt = "concat(case when c_custkey % 1999 < 999 then '-' else '+' end, lpad(cast(abs(c_custkey % 1999 - 999) as string), 5, '0'))"
    two = c.selectExpr("c_custkey", "path", "2 as record", f"concat(lpad(c_custkey, 8, '0'), left(c_mktsegment, 4), rpad(concat('tail', c_custkey % 7), 8, ' '), {debt}) as value")
    return one.unionByName(two)


@query("copybook_records", _RECORDS)
def copybook_records(spark, sf_dir):
    layouts = CB.record_layouts(CB.layout_tree(copybooks(spark, sf_dir)))
    read = CB.cut_records(rendered_records(spark, sf_dir), layouts)
    return read.select("c_custkey", "record", F.explode("fields").alias("f")).select("c_custkey", "record", "f.*")
