"""Queries of the batch jobs, report formats and fixed-width records."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.functions import formats as FM
from srcloom.operators import batch_jobs as J
from srcloom.plans.derived import sql_source_files, source_files, table
from srcloom.plans.registry import query
from srcloom.sources import fixed_width as FW

STAFF = """with staff as (select c_custkey as emp_id, c_name as emp_name, c_mktsegment as emp_dept,
  cast(greatest(c_acctbal, 0) as decimal(9,2)) as emp_salary, cast(140 + c_custkey % 50 as int) as emp_hours,
  case when c_custkey % 10 = 0 then 'I' else 'A' end as emp_status from customer)"""
PAID = STAFF + """, cents as (select *, cast(emp_salary * 100 as bigint) as c, greatest(emp_hours - 160, 0) as over from staff where emp_status = 'A'),
  gross as (select *, (over * c * 150) // 16000 as o, c + (over * c * 150) // 16000 as g from cents),
  paid as (select emp_id, emp_name, emp_dept, cast(o / 100.0 as decimal(18,2)) as overtime_pay, cast(g / 100.0 as decimal(18,2)) as gross_pay,
    cast(((g * 30) // 100) / 100.0 as decimal(18,2)) as tax, cast((g - (g * 30) // 100) / 100.0 as decimal(18,2)) as net_pay from gross)"""
PRODUCTS = """with products as (select p_partkey as code, p_name as name, p_size as quantity, cast(p_retailprice as decimal(9,2)) as price,
    p_type as category, p_size * 20 as stock, p_size as minimo from part),
  sold as (select l_orderkey * 10 + l_linenumber as seq, l_partkey as code, cast(l_quantity as int) as cantidad from lineitem),
  registered as (select seq, code, name, cantidad, price * cantidad as subtotal from sold join products using (code)),
  stocked as (select code, stock - coalesce(s, 0) as stock_left from products left join (select code, sum(cantidad) as s from sold group by code) using (code))"""


def staff(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as emp_id", "c_name as emp_name", "c_mktsegment as emp_dept",
        "cast(greatest(c_acctbal, 0) as decimal(9,2)) as emp_salary", "cast(140 + c_custkey % 50 as int) as emp_hours",
        "case when c_custkey % 10 = 0 then 'I' else 'A' end as emp_status",
    )


def staff_pe(spark, sf_dir):
    return staff(spark, sf_dir).selectExpr(
        "emp_id as id", "emp_name as nombre", "emp_salary as salario", "emp_dept as departamento"
    )


def products(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as code", "p_name as name", "p_size as quantity", "cast(p_retailprice as decimal(9,2)) as price",
        "p_type as category", "p_size * 20 as stock", "p_size as minimo",
    )


def sold(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as seq", "l_partkey as code", "cast(l_quantity as int) as cantidad"
    )


@query("payroll", PAID + " select * from paid")
def payroll(spark, sf_dir):
    return J.payroll(staff(spark, sf_dir))


@query("payroll_totals", PAID + " select count(*) as emp_count, sum(net_pay) as total_payroll from paid")
def payroll_totals(spark, sf_dir):
    return J.payroll_totals(J.payroll(staff(spark, sf_dir)))


@query("inventory_value", PRODUCTS + " select count(*) as total_products, sum(quantity * price) as total_value from products")
def inventory_value(spark, sf_dir):
    return J.inventory_value(products(spark, sf_dir))


@query("low_stock", PRODUCTS + " select code, name, quantity from products where quantity < 10")
def low_stock(spark, sf_dir):
    return J.low_stock(products(spark, sf_dir)).select("code", "name", "quantity")


@query("sales_register", PRODUCTS + " select * from registered")
def sales_register(spark, sf_dir):
    return J.sales(products(spark, sf_dir), sold(spark, sf_dir))


@query("stock_after_sales", PRODUCTS + " select * from stocked")
def stock_after_sales(spark, sf_dir):
    return J.stock_after_sales(products(spark, sf_dir), sold(spark, sf_dir))


@query("day_totals", PRODUCTS + " select sum(subtotal) as revenue, count(*) as transactions from registered")
def day_totals(spark, sf_dir):
    return J.day_totals(J.sales(products(spark, sf_dir), sold(spark, sf_dir)))


@query("stock_alerts", PRODUCTS + " select * from stocked where stock_left < 100")
def stock_alerts(spark, sf_dir):
    return J.stock_alerts(J.stock_after_sales(products(spark, sf_dir), sold(spark, sf_dir)))


@query("stock_alert_count", PRODUCTS + " select count(*) as alerts from stocked where stock_left < 100")
def stock_alert_count(spark, sf_dir):
    return J.stock_alerts(J.stock_after_sales(products(spark, sf_dir), sold(spark, sf_dir))).agg(F.count("*").alias("alerts"))


_NET = STAFF + """, pe as (select emp_id as id, emp_name as nombre, emp_dept as departamento, emp_salary as bruto, emp_salary * 0.13 as afp,
  greatest(emp_salary - 7000, 0) * 0.08 as impuesto, emp_salary * 0.09 as essalud from staff), net as (select *, bruto - afp - impuesto as neto from pe)"""


@query("net_salaries", _NET + " select * from net")
def net_salaries(spark, sf_dir):
    return J.net_salaries(staff_pe(spark, sf_dir))


@query("net_salary_total", _NET + " select sum(neto) as total from net")
def net_salary_total(spark, sf_dir):
    return J.net_salaries(staff_pe(spark, sf_dir)).agg(F.sum("neto").alias("total"))


@query("department_report", STAFF + " select emp_dept as departamento, count(*) as n, sum(emp_salary) as total_salario, round(sum(emp_salary)::double / count(*), 4) as media from staff group by emp_dept")
def department_report(spark, sf_dir):
    report = J.department_report(staff_pe(spark, sf_dir))
    return report.withColumn("media", F.round(F.col("total_salario").cast("double") / F.col("n"), 4))


@query("document_search", "select doc_id from documents where contains(lower(text), 'tion des')")
def document_search(spark, sf_dir):
    return J.search(table(spark, sf_dir, "documents"), "TION des", "text").select("doc_id")


@query("row_search", "select c_custkey from customer where contains(lower(concat_ws('|', c_name, c_mktsegment)), 'mach') or contains(lower(c_name), '77')")
def row_search(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    hit = J.matches("MACH", "c_name", "c_mktsegment") | J.matches("77", "c_name")
    return customers.where(hit).select("c_custkey")


@query("stock_bands", PRODUCTS + """ select code, case when stock <= minimo * 8 + 100 then 'BAJO' when stock <= (minimo * 8 + 100) * 2 then 'MEDIO' else 'OK' end as band from products""")
def stock_bands(spark, sf_dir):
    return products(spark, sf_dir).select(
        "code", J.stock_band(F.col("stock"), F.col("minimo") * 8 + 100).alias("band")
    )


@query("panel_tiles", PRODUCTS + """ select p.products, p.alerts, r.sales, r.revenue from
  (select count(*) as products, count(*) filter (where stock <= minimo) as alerts from products) p,
  (select count(*) as sales, sum(subtotal) as revenue from registered) r""")
def panel_tiles(spark, sf_dir):
    return J.panel_tiles(products(spark, sf_dir), J.sales(products(spark, sf_dir), sold(spark, sf_dir)))


_LABELS = """with coded as (select event_id, [200, 201, 400, 401, 403, 404, 500, 302][event_id % 8 + 1] as code, upper(dayname(ts)) as day,
  case event_type when 'view' then 'DEBUG' when 'click' then 'INFO' when 'signup' then 'WARNING' when 'error' then 'ERROR' else 'TRACE' end as level from events)"""


@query("event_labels", _LABELS + """ select event_id, case code when 200 then 'OK' when 201 then 'Created' when 400 then 'Bad Request' when 401 then 'Unauthorized'
  when 403 then 'Forbidden' when 404 then 'Not Found' when 500 then 'Internal Server Error' else 'Unknown' end as label,
  case when event_id % 9 = 0 then 'Invalid' when day in ('SATURDAY', 'SUNDAY') then 'Weekend' else 'Weekday' end as day_type,
  case level when 'WARNING' then 'WARN' when 'TRACE' then 'UNKNOWN' else level end as prefix from coded""")
def event_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "element_at(array(200, 201, 400, 401, 403, 404, 500, 302), cast(event_id % 8 + 1 as int)) as code",
        "case when event_id % 9 = 0 then 'HOLIDAY' else upper(date_format(ts, 'EEEE')) end as day",
        """case event_type when 'view' then 'DEBUG' when 'click' then 'INFO' when 'signup' then 'WARNING'
           when 'error' then 'ERROR' else 'TRACE' end as level""",
    )
    return events.select(
        "event_id", J.status_text(F.col("code")).alias("label"), J.day_type(F.col("day")).alias("day_type"),
        J.log_prefix(F.col("level")).alias("prefix"),
    )


@query("last_value_per_key", "select user_id, arg_max(value, row(ts, event_id)) as value from events group by user_id order by user_id")
def last_value_per_key(spark, sf_dir):
    return J.last_value_per_key(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id")


@query("fixed_width_records", STAFF + """ select cast(emp_id as int) as emp_id, left(emp_name, 30) as emp_name, left(emp_dept, 10) as emp_dept, emp_salary, emp_hours, emp_status from staff""")
def fixed_width_records(spark, sf_dir):
    rendered = staff(spark, sf_dir).selectExpr(
        """concat(lpad(cast(emp_id as string), 6, '0'), rpad(left(emp_name, 30), 30, ' '), rpad(left(emp_dept, 10), 10, ' '),
           lpad(cast(cast(emp_salary * 100 as bigint) as string), 9, '0'), lpad(cast(emp_hours as string), 3, '0'), emp_status) as value"""
    )
    return FW.parse_records(rendered, FW.EMPLOYEE_RECORD)


@query("copybook_layout", "with " + sql_source_files() + r""" select path, 0 as field_ord, 1 as level, 'ws_a' as name, '9(5)' as picture, 'i32' as type,
  5 as width, 0 as scale, 1 as record, 1 as start from files where language = 'cobol' and contains(content, '01  WS-A PIC 9(5).')""")
def copybook_layout(spark, sf_dir):
    return FW.infer_layout(source_files(spark, sf_dir).where("language = 'cobol'"))


@query("money_format", PRODUCTS + " select seq, code, 'S/. ' || format('{:,.2f}', subtotal::double) as amount from registered")
def money_format(spark, sf_dir):
    rows = J.sales(products(spark, sf_dir), sold(spark, sf_dir))
    return rows.select("seq", "code", FM.money(F.col("subtotal")).alias("amount"))


_SECONDS = "with timed as (select event_id, cast(floor(value * 50) as bigint) as seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, event_id % 101 as rate, event_type from events)"


@query("report_formats", _SECONDS + """ select event_id,
  case when seconds < 60 then seconds || ' segundos' when seconds < 3600 then (seconds // 60) || 'm ' || (seconds % 60) || 's'
    else (seconds // 3600) || 'h ' || ((seconds % 3600) // 60) || 'm' end as duration,
  case when seconds < 60 then seconds || 's' else (seconds // 60) || 'm' end as tile,
  left(iso, 19) as second, left(iso, 10) as day, case when rate >= 80 then 'success' when rate >= 50 then 'warning' else 'danger' end as band,
  case event_type when 'purchase' then '✓ COMPLETADO' when 'error' then '✗ FALLIDO' when 'click' then '⟳ EN PROGRESO' when 'view' then '⏸ PAUSADO' else 'DESCONOCIDO' end as label
  from timed""")
def report_formats(spark, sf_dir):
    timed = table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(floor(value * 50) as bigint) as seconds", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as iso",
        "event_id % 101 as rate",
        "case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'click' then 'in_progress' when 'view' then 'paused' else event_type end as status",
    )
    return timed.select(
        "event_id", FM.report_duration(F.col("seconds")).alias("duration"), FM.tile_duration(F.col("seconds")).alias("tile"),
        FM.timestamp_second(F.col("iso")).alias("second"), FM.timestamp_day(F.col("iso")).alias("day"),
        FM.rate_band(F.col("rate")).alias("band"), FM.status_label(F.col("status")).alias("label"),
    )
