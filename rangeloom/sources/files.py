"""Readers and writers of interval, feature, point and region files, and of whole tracks as sorted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number_text, strict_double, strict_long
from ..operators.sharding import running, shard_of

#: Lines that are no rows: blank, comments, track and browser lines.
SKIPPED = r"^[ \t\r]*(\z|#|(track|browser)([ \t\r]|\z))"
_SPACE = "[ \t]+"


def _rows(lines: DataFrame, line: str) -> DataFrame:
    return lines.where(F.col(line).isNotNull() & ~F.col(line).rlike(SKIPPED))


def parse_signal(lines: DataFrame, line: str = "value", strict: bool = False) -> DataFrame:
    """Signal lines ``chrom st ed val [annotation]``, separated by blanks or tabs: ``(chrom, st, ed, val, annotation, error)``.

    The annotation is the trimmed rest of the line, null if there is none. A line with too few fields, numbers that
    aren't numbers or ``st >= ed`` has its text in ``error`` and nulls elsewhere; with ``strict`` it raises.
    """
    t = F.regexp_replace(line, r"^[ \t]+|[ \t\r]+\z", "")
    f = F.split(t, _SPACE, 5)
    st, ed, val = strict_long(F.get(f, F.lit(1))), strict_long(F.get(f, F.lit(2))), strict_double(F.get(f, F.lit(3)))
    rows = _rows(lines, line).select(*[c for c in lines.columns if c != line], t.alias("_t"), F.get(f, F.lit(0)).alias("chrom"), st.alias("st"), ed.alias("ed"), val.alias("val"), F.get(f, F.lit(4)).alias("annotation"))
    ok = F.coalesce((F.col("st") < F.col("ed")) & F.col("val").isNotNull(), F.lit(False))
    names = ("chrom", "st", "ed", "val", "annotation")
    if strict:  # in every column, so that none can be read without the check
        fail = F.raise_error(F.concat(F.lit("not a signal line: "), "_t"))
        return rows.select(*[c for c in rows.columns if c not in (*names, "_t")], *[F.when(ok, F.col(c)).otherwise(fail).alias(c) for c in names], F.lit(None).cast("string").alias("error"))
    rows = rows.withColumn("error", F.when(~ok, F.col("_t")))
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in names}).drop("_t")


def parse_features(lines: DataFrame, line: str = "value") -> DataFrame:
    """Feature lines ``chrom st ed [rest]``: ``(chrom, st, ed, other, error)``; ``other`` is the rest of the line, empty if there is none."""
    t = F.regexp_replace(line, r"[\r]+\z", "")
    f = F.split(t, "[ \t]", 4)
    st, ed = (strict_long(F.get(f, F.lit(i))) for i in (1, 2))
    rows = _rows(lines, line).select(*[c for c in lines.columns if c != line], t.alias("_t"), F.get(f, F.lit(0)).alias("chrom"), st.alias("st"), ed.alias("ed"), F.coalesce(F.get(f, F.lit(3)), F.lit("")).alias("other"))
    ok = F.coalesce(F.col("st") <= F.col("ed"), F.lit(False))
    rows = rows.withColumn("error", F.when(~ok, F.col("_t")))
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in ("chrom", "st", "ed", "other")}).drop("_t")


def read_signal(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows = parse_signal(spark.read.text(path), strict=strict)
    return rows.drop("error") if strict else rows


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(spark.read.text(path))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region files ``chrom st ed [n]``: ``(chrom, st, ed, n)``, ``n`` null if absent."""
    return parse_features(spark.read.text(path)).where("error is null").select("chrom", "st", "ed", F.trim("other").try_cast("bigint").alias("n"))


def signal_line(annotation: bool = False, digits: int = 6) -> Column:
    """The line of a signal row: values with at most ``digits`` decimals; the annotation, where there is one, last."""
    parts = [F.col("chrom"), F.col("st").cast("string"), F.col("ed").cast("string"), number_text(F.col("val"), digits)]
    return F.concat_ws("\t", *parts, *([F.when(F.col("annotation") != "", F.col("annotation"))] if annotation else []))


def feature_line() -> Column:
    return F.concat_ws("\t", "chrom", F.col("st").cast("string"), F.col("ed").cast("string"), F.when(F.col("other") != "", F.col("other")))


def sorted_by_place(df: DataFrame) -> DataFrame:
    """By chrom and start, in as many ranges as the cluster's shuffle has: a large chrom is spread over several."""
    return df.repartitionByRange("chrom", "st").sortWithinPartitions("chrom", "st", "ed")


def write_signal(signal: DataFrame, path: str, annotation: bool = False) -> None:
    """One text line per row; files and lines in order of place."""
    sorted_by_place(signal).select(signal_line(annotation).alias("value")).write.text(path)


def write_features(features: DataFrame, path: str) -> None:
    sorted_by_place(features).select(feature_line().alias("value")).write.text(path)


def build_track(rows: DataFrame, path: str) -> DataFrame:
    """Stores rows as a table sorted by place, so that files and row groups can be skipped by chrom and position; returns it."""
    sorted_by_place(rows).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def build_missing(rows_of: dict[str, DataFrame]) -> list[str]:
    """Stores each track whose path has no table yet; the paths written."""
    done = []
    for path, rows in rows_of.items():
        spark = rows.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            build_track(rows, path)
            done.append(path)
    return done


def numbered_features(features: DataFrame, keys: tuple[str, ...] = ("track_id", "chrom"), tie: str = "feature_id") -> DataFrame:
    """Features with ``ord``: 0, 1, ... by start, end and ``tie`` within ``keys`` (rows without a start come first)."""
    k = F.struct(*keys)
    s = features.drop("ord").withColumns({"_k": k, "_s": F.coalesce(shard_of(F.col("st"), 1 << 16), F.lit(-(2**62)))})
    return running(s, ["_k"], "_s", ["st", "ed", tie], {"ord": F.lit(1).cast("bigint")}, inclusive=False).withColumn("ord", F.col("ord").cast("bigint")).drop("_k", "_s")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A file with the number of points in its first line, then a point ``x y`` per line: ``(x, y)``. Raises ``ValueError`` if the number is wrong."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    f = F.split(F.trim("value"), _SPACE)
    n = lines.where(F.size(f) == 1).select(F.col("value").try_cast("bigint").alias("n")).collect()
    points = lines.where(F.size(f) == 2).select(F.get(f, F.lit(0)).cast("bigint").alias("x"), F.get(f, F.lit(1)).cast("bigint").alias("y"))
    if len(n) != 1 or n[0]["n"] != points.count():
        raise ValueError("the number of points in the file's first line is wrong")
    return points


def write_points(points: DataFrame, path: str) -> None:
    """The inverse of :func:`read_points`, in order of x and y."""
    spark = points.sparkSession
    head = spark.createDataFrame([(points.count(),)], "n bigint").select(F.lit(0).alias("_o"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.col("n").cast("string").alias("value"))
    body = points.select(F.lit(1).alias("_o"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange("_o", "x", "y").sortWithinPartitions("_o", "x", "y").select("value").write.text(path)
