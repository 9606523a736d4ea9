"""Lines of interval files: typed rows, and the failing lines with their reasons.

Method: every line is read permissively under an explicit schema that keeps the raw text of a corrupt one. Lines that
come out clean and hold no quote keep the reader's fields; all others are split again by the exact rules of the format
(quoting first, then the number of fields). The values are checked by what may be cast, not by trying the cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the line format. \z is the end of the text; $ would also match before a last line end.
SKIPPED = r"^[ \t\r]*(\z|#|(track|browser)([ \t\r]|\z))"
FIELD = r'(?:[ \r]*+"[^"]*+(?:""[^"]*+)*+"[ \r]*+|[^"\t]*+)'
WELL_QUOTED = rf"^{FIELD}(?:\t{FIELD})*+\z"
WHOLE = r"^[0-9]+\z"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

_SCHEMA = "f0 string, f1 string, f2 string, f3 string, f4 string, raw string"
_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw", "comment": "\x00"}


def _bare(field: Column) -> Column:
    """A field without the blanks around it and, if quoted, without its quotes."""
    f = F.regexp_replace(field, r"^[ \r]+|[ \r]+\z", "")
    return F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)


def _as_position(f: Column) -> Column:
    """Digits as a position; null where they aren't digits or exceed every possible length (18 digits)."""
    digits = F.regexp_replace(f, "^0+(?=.)", "")
    return F.when(f.rlike(WHOLE) & (F.length(digits) <= 18), digits).try_cast("bigint")


def classify(lines: DataFrame, sizes: DataFrame, line: str = "line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Each line that must be a row: ``keep``, ``raw``, ``reason`` and ``chrom, st, ed, val, annotation``.

    ``reason`` is null for a valid row, else the first that applies of ``quoting``, ``column_count``, ``chrom``,
    ``position``, ``val``; the typed columns are then null. ``annotation`` is null if there is no fifth field, and empty
    if that is empty. Null and blank lines, comments and ``track`` or ``browser`` lines are no rows. ``sizes`` has one row
    per valid ``chrom`` with its ``chrom_len``.
    """
    if clash := set(keep) & {"raw", "reason", "chrom", "st", "ed", "val", "annotation"}:
        raise ValueError(f"columns to keep have the names of result columns: {sorted(clash)}")
    text = F.col(line)
    rows = lines.select(*keep, text.alias("raw")).where(text.isNotNull() & ~text.rlike(SKIPPED))
    end = F.regexp_replace("raw", r"[ \r]+\z", "")
    rows = rows.withColumn("_read", F.from_csv(end, _SCHEMA, _OPTIONS))
    clean = F.col("_read.raw").isNull() & ~F.col("raw").contains('"') & ~end.contains("\r") & ~end.contains("\n")
    by_reader = F.array(*[F.coalesce(F.col(f"_read.f{i}"), F.lit("")) for i in range(5)])
    good_quotes = F.col("raw").rlike(WELL_QUOTED)
    by_rule = F.when(good_quotes, F.regexp_extract_all(F.concat(F.lit("\t"), "raw"), F.lit(rf"\t({FIELD})"), F.lit(1)))
    rows = rows.withColumn("_f", F.when(clean, by_reader).otherwise(by_rule))
    field = [_bare(F.get("_f", F.lit(i))) for i in range(5)]
    rows = rows.select(*keep, "raw", F.col("_f").isNull().alias("_q"), F.size("_f").alias("_n"), *[f.alias(f"_{i}") for i, f in enumerate(field)])
    known = sizes.select(F.col("chrom").alias("_chrom"), F.col("chrom_len").alias("_len"))
    rows = rows.join(known, (F.col("_0") == F.col("_chrom")) & F.col("_n").isin(4, 5), "left")
    rows = rows.withColumns({"_st": _as_position(F.col("_1")), "_ed": _as_position(F.col("_2"))})
    reason = (
        F.when(F.col("_q"), "quoting")
        .when(~F.col("_n").isin(4, 5), "column_count")
        .when(F.col("_chrom").isNull(), "chrom")
        .when(~F.coalesce((F.col("_st") < F.col("_ed")) & (F.col("_ed") <= F.col("_len")), F.lit(False)), "position")
        .when(~F.col("_3").rlike(DECIMAL), "val")
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(
        *keep, "raw", "reason", F.when(ok, F.col("_0")).alias("chrom"), F.when(ok, F.col("_st")).alias("st"), F.when(ok, F.col("_ed")).alias("ed"),
        F.when(ok, F.col("_3")).try_cast("double").alias("val"), F.when(ok, F.col("_4")).alias("annotation"),
    )


def valid_rows(lines: DataFrame, sizes: DataFrame, line: str = "line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The valid rows of :func:`classify`, typed: ``keep, chrom, st, ed, val, annotation``."""
    return classify(lines, sizes, line, keep).where("reason is null").drop("raw", "reason")


def failing_lines(lines: DataFrame, sizes: DataFrame, line: str = "line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The failing lines of :func:`classify`: ``keep, raw, reason``."""
    return classify(lines, sizes, line, keep).where("reason is not null").select(*keep, "raw", "reason")
