"""Writers: JSON envelopes, CSV with fixed headers, JSON lines, text, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_envelope(rows: DataFrame, path: str, name: str, order: list, extra: dict[str, Column] | None = None, version: str = "1") -> None:
    """One JSON document ``{version, generated_at, ..., name: [rows]}``.

    For tables of fields or aliases, whose size follows distinct attribute names, not catalog rows.
    """
    listed = rows.select(F.struct(F.row_number().over(Window.orderBy(*order)).alias("o"), F.struct(*rows.columns).alias("r")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias(name))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    listed.select(F.lit(version).alias("version"), stamp.alias("generated_at"), *[c.alias(k) for k, c in (extra or {}).items()], name).coalesce(1).write.mode("overwrite").json(path)




def write_alias_map(aliases: DataFrame, path: str) -> None:
    """``{version, generated_at, aliases: {text: field_id}}``."""
    one = aliases.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "field_id")))).alias("aliases"))
    one.select(F.lit("1").alias("version"), F.current_timestamp().cast("string").alias("generated_at"), "aliases").coalesce(1).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, header: list[str] | None = None) -> None:
    """CSV with header; columns of ``header`` that rows lack are empty, null is empty."""
    cols = [(F.col(c).cast("string") if c in rows.columns else F.lit("")).alias(c) for c in header or rows.columns]
    rows.select(*cols).na.fill("").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_lines(rows: DataFrame, path: str, column: str = "line") -> bool:
    """A text file, only if there is a line to write."""
    if rows.isEmpty():
        return False
    rows.select(column).write.mode("overwrite").text(path)
    return True


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def to_json_text(c: Column) -> Column:
    return F.coalesce(F.to_json(c), F.lit("{}"))
