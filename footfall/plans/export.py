"""Reports as CSV and JSON for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MAX_ROWS = 5_000


def neutralized(x: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(x.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def for_csv(report: DataFrame) -> DataFrame:
    """Text neutralised, fractions rounded to two places, whole numbers as they are."""
    out = []
    for f in report.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NumericType):
            out.append((F.round(c, 2) if f.dataType.typeName() in ("double", "float") else c).alias(f.name))
        else:
            out.append(neutralized(c.cast("string")).alias(f.name))
    return report.select(*out)


def write_csv(report: DataFrame, path: str) -> None:
    for_csv(report).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def envelope(report: DataFrame, site_id: int, start: str, end: str, accuracy: str = "exact") -> DataFrame:
    """One row, `value`: JSON of the report's first MAX_ROWS rows with where and when they hold."""
    rows = report.limit(MAX_ROWS)
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    one = rows.agg(F.collect_list(own).alias("rows"))
    return one.select(F.to_json(F.struct(F.lit(site_id).alias("site"), F.lit(start).alias("from"), F.lit(end).alias("to"), F.lit(accuracy).alias("accuracy"), "rows")).alias("value"))


def by_name(parts: dict[str, DataFrame], column: str = "report") -> DataFrame:
    """Several reports in one table, missing columns null."""
    out = None
    for name, rows in parts.items():
        named = rows.withColumn(column, F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out
