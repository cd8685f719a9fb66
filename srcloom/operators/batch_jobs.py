"""The business jobs of the example code base: payroll, inventory, sales, panels.

Amounts are decimals or whole cents. Totals are aggregated before any join, and
lookups are inner or left joins that adaptive execution may split or broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions import languages as L

# Fixed values of the jobs.
STANDARD_HOURS = 160
OVERTIME_RATE_PERCENT = 150
TAX_PERCENT = 30
LOW_STOCK = 10
STOCK_ALERT = 100
PENSION_RATE = "0.13"
HEALTH_RATE = "0.09"
INCOME_TAX_RATE = "0.08"
INCOME_TAX_FROM = 7000
STATUS_TEXTS = {
    "200": "OK", "201": "Created", "400": "Bad Request", "401": "Unauthorized", "403": "Forbidden",
    "404": "Not Found", "500": "Internal Server Error",
}
WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY")
WEEKEND = ("SATURDAY", "SUNDAY")
LOG_PREFIXES = {"DEBUG": "DEBUG", "INFO": "INFO", "WARNING": "WARN", "ERROR": "ERROR"}


def _dollars(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def _whole_part(amount: Column, divisor: int) -> Column:
    return ((amount - amount % divisor) / divisor).cast("long")


def payroll(staff: DataFrame) -> DataFrame:
    """Active staff with overtime, gross, tax and net. Every store truncates to
    cents; whole cents make that exact."""
    cents = (F.col("emp_salary") * 100).cast("long")
    over = F.greatest(F.col("emp_hours") - STANDARD_HOURS, F.lit(0)).cast("long")
    overtime = _whole_part(over * cents * OVERTIME_RATE_PERCENT, STANDARD_HOURS * 100)
    return (
        staff.where("emp_status = 'A'")
        .withColumn("overtime_cents", overtime)
        .withColumn("gross_cents", cents + F.col("overtime_cents"))
        .withColumn("tax_cents", _whole_part(F.col("gross_cents") * TAX_PERCENT, 100))
        .select(
            "emp_id", "emp_name", "emp_dept",
            _dollars(F.col("overtime_cents")).alias("overtime_pay"),
            _dollars(F.col("gross_cents")).alias("gross_pay"),
            _dollars(F.col("tax_cents")).alias("tax"),
            _dollars(F.col("gross_cents") - F.col("tax_cents")).alias("net_pay"),
        )
    )


def payroll_totals(paid: DataFrame) -> DataFrame:
    return paid.agg(F.count("*").alias("emp_count"), F.sum("net_pay").alias("total_payroll"))


def inventory_value(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total_products"), F.sum(F.col("quantity") * F.col("price")).alias("total_value")
    )


def low_stock(products: DataFrame, limit: int = LOW_STOCK) -> DataFrame:
    return products.where(F.col("quantity") < limit)


def sales(catalogue: DataFrame, sold: DataFrame) -> DataFrame:
    """Each sale with its product and subtotal; unknown codes are dropped."""
    return sold.join(catalogue, "code").select(
        "seq", "code", "name", "cantidad", (F.col("price") * F.col("cantidad")).alias("subtotal")
    )


def stock_after_sales(stock: DataFrame, sold: DataFrame) -> DataFrame:
    """Sales are summed per code first, so a best seller is one row in the join."""
    by_code = sold.groupBy("code").agg(F.sum("cantidad").alias("sold"))
    left = F.col("stock") - F.coalesce("sold", F.lit(0))
    return stock.join(by_code, "code", "left").select("code", left.alias("stock_left"))


def day_totals(registered: DataFrame) -> DataFrame:
    return registered.agg(F.sum("subtotal").alias("revenue"), F.count("*").alias("transactions"))


def stock_alerts(stock_left: DataFrame, limit: int = STOCK_ALERT) -> DataFrame:
    return stock_left.where(F.col("stock_left") < limit)


def net_salaries(staff: DataFrame) -> DataFrame:
    """Pension, income tax above a limit, net; the health rate is shown, not taken."""
    gross = F.col("salario")
    rate = lambda r: F.lit(r).cast("decimal(3,2)")
    pension = gross * rate(PENSION_RATE)
    tax = F.greatest(gross - INCOME_TAX_FROM, F.lit(0)) * rate(INCOME_TAX_RATE)
    return staff.select(
        "id", "nombre", "departamento", gross.alias("bruto"), pension.alias("afp"), tax.alias("impuesto"),
        (gross * rate(HEALTH_RATE)).alias("essalud"), (gross - pension - tax).alias("neto"),
    )


def department_report(staff: DataFrame) -> DataFrame:
    return staff.groupBy("departamento").agg(
        F.count("*").alias("n"), F.sum("salario").alias("total_salario"), F.avg("salario").alias("media")
    )


def matches(needle: str, *columns: str) -> Column:
    """The text stands, in any case, in any of the columns; conditions combine in one filter."""
    cell = lambda c: F.lower(F.col(c).cast("string")).contains(needle.lower())
    return reduce(lambda a, b: a | b, [cell(c) for c in columns])


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the text, in any case, in any of the columns."""
    return rows.where(matches(needle, *columns))


def stock_band(stock: Column, minimum: Column) -> Column:
    return F.when(stock <= minimum, "BAJO").when(stock <= minimum * 2, "MEDIO").otherwise("OK")


def panel_tiles(products: DataFrame, registered: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side."""
    left = products.agg(
        F.count("*").alias("products"), F.count_if(F.col("stock") <= F.col("minimo")).alias("alerts")
    ).withColumn("one", F.lit(1))
    right = registered.agg(
        F.count("*").alias("sales"), F.sum("subtotal").alias("revenue")
    ).withColumn("one", F.lit(1))
    return left.join(right, "one").drop("one")


def status_text(code: Column) -> Column:
    return F.coalesce(L.lookup(STATUS_TEXTS, code.cast("string")), F.lit("Unknown"))


def day_type(day: Column) -> Column:
    return F.when(day.isin(*WEEKDAYS), "Weekday").when(day.isin(*WEEKEND), "Weekend").otherwise("Invalid")


def log_prefix(level: Column) -> Column:
    return F.coalesce(L.lookup(LOG_PREFIXES, level), F.lit("UNKNOWN"))


def last_value_per_key(writes: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last write of each key, listed by key."""
    return writes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value)).orderBy(key)
