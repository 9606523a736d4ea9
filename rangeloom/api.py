"""Objects over tables, for interactive use: a track, its chroms, features and points. Every method is one small query or returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import points as pts
from .operators import sequence as sq
from .operators import signal as sg
from .sources import files


class Track:
    """A signal: non-overlapping intervals with values."""

    def __init__(self, signal: DataFrame):
        self.signal = signal

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Track:
        """A stored track (a folder or .parquet) or a text file of signal lines."""
        return cls(spark.read.parquet(path) if path.rstrip("/").endswith((".parquet", ".track")) else files.read_signal(spark, path))

    def save(self, path: str) -> Track:
        """Stores the track in order of place, with its running sums."""
        return Track(files.build_track(sg.cumulated(self.signal), path))

    def dump(self, path: str, annotation: bool = False) -> None:
        files.write_signal(self.signal, path, annotation)

    def chroms(self) -> list[str]:
        return [r[0] for r in self.signal.select("chrom").distinct().orderBy("chrom").collect()]

    def chrom_id(self, chrom: str) -> int:
        """Place of the chrom in the order of names, -1 if unknown."""
        names = self.chroms()
        return names.index(chrom) if chrom in names else -1

    def _region(self, chrom: str, st: int, ed: int, n: int = 1) -> DataFrame:
        if st >= ed or n < 1:
            raise ValueError("a region needs st < ed and at least one window")
        return self.signal.sparkSession.createDataFrame([(0, chrom, st, ed, n)], "region_id bigint, chrom string, st bigint, ed bigint, n bigint")

    def _near(self, chrom: str, st: int, ed: int) -> DataFrame:
        """The intervals that a region can say anything about: a stored track skips the others by chrom and position. Sums within a region don't need the running sums."""
        near = self.signal.where((F.col("chrom") == chrom) & (F.col("st") <= ed) & (F.col("ed") > st))
        return near.select("chrom", "st", "ed", "val")

    def summary(self, op: str, chrom: str, st: int, ed: int, n: int = 1):
        """``avg, sum, cov, min, max, stdev, cnt`` of ``n`` windows as a list; ``lst`` and ``map`` as rows and values."""
        r, near = self._region(chrom, st, ed, n), self._near(chrom, st, ed)
        if op == "lst":
            return [tuple(x)[1:] for x in sg.listed(near, r).orderBy("st").collect()]
        if op == "map":
            return [x["val"] for x in sg.base_values(near, r).orderBy("pos").collect()]
        col = {"cnt": "started"}.get(op, op)
        return [x[col] for x in sg.window_summary(near, r, [col]).orderBy("bin").select(col).collect()]

    def region(self, chrom: str, st: int, ed: int) -> dict:
        """All measures of one region."""
        return sg.region_summary(self._near(chrom, st, ed), self._region(chrom, st, ed)).drop("region_id").head().asDict()

    def at(self, chrom: str, pos: int) -> dict:
        """All that is known about one position."""
        p = self.signal.sparkSession.createDataFrame([(chrom, pos)], "chrom string, pos bigint")
        return sg.at_positions(self.signal.where(F.col("chrom") == chrom), p).drop("chrom", "pos").head().asDict()

    def interval(self, chrom: str, i: int) -> dict | None:
        """The i-th interval of a chrom, None if there is none; an absent annotation is empty."""
        row = sg.cumulated(self.signal.where(F.col("chrom") == chrom)).where(F.col("idx") == i).head()
        if row is None:
            return None
        d = row.asDict()
        return {k: d[k] for k in ("st", "ed", "val")} | {"annotation": d.get("annotation") or ""}

    def batch(self, regions: DataFrame) -> DataFrame:
        """Window summaries of many regions ``(region_id, chrom, st, ed, n)`` at once."""
        return sg.window_summary(self.signal, regions)


class Features:
    """Annotated intervals that may overlap, numbered by place within their chrom."""

    def __init__(self, rows: DataFrame, meta: str = ""):
        self.rows, self.meta = rows, meta

    def size(self, chrom: str) -> int:
        return self.rows.where(F.col("chrom") == chrom).count()

    def get(self, chrom: str, i: int) -> tuple | None:
        r = self.rows.where((F.col("chrom") == chrom) & (F.col("ord") == i)).select("st", "ed", F.coalesce("other", F.lit("")).alias("other")).head()
        return None if r is None else tuple(r)

    def dump(self, path: str) -> None:
        files.write_features(self.rows, path)


class Points:
    """A multiset of points ``(x, y)``."""

    def __init__(self, points: DataFrame):
        self.points = points

    def size(self) -> int:
        return self.points.count()

    def count(self, x1: int, x2: int, y1: int, y2: int) -> int:
        """Points in ``[x1, x2) x [y1, y2)``; reversed bounds are swapped."""
        (x1, x2), (y1, y2) = sorted((x1, x2)), sorted((y1, y2))
        return self.points.where((F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)).count()

    def dominated(self, x: int, y: int) -> int:
        return self.points.where((F.col("x") < x) & (F.col("y") < y)).count()

    def grid(self, xs: list[int], ys: list[int]) -> DataFrame:
        return pts.grid_count(self.points, xs, ys)

    def heatmap(self, x1: int, x2: int, y1: int, y2: int, nx: int, ny: int) -> DataFrame:
        return pts.heatmap(self.points, x1, x2, y1, y2, nx, ny)

    def rectangles(self, boxes: DataFrame) -> DataFrame:
        return sq.box_count(self.points, boxes, "x", "y")
