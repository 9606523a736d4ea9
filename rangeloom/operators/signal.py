"""A signal is a table ``(chrom, st, ed, val)`` of non-overlapping half-open intervals; this module answers questions about it.

Values count in whole units of ``1 / SCALE`` wherever they are summed, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join, overlap_join
from .sequence import extremes
from .sharding import join_on, neighbour, running, scan, shard_of, spread

SCALE = 1000
SHARD = 1 << 16
KEYS = ["chrom"]


def units(val: Column, scale: int = SCALE) -> Column:
    """``val`` in whole units; null for null and NaN."""
    return F.when(~F.isnan(val), F.round(val * scale).cast("bigint"))


def composite(rows: DataFrame, key: str = "chrom", source: str = "track_id", st: str = "st", ed: str = "ed", val: str = "val") -> DataFrame:
    """The sum of all sources' values at each position, as a signal ``(chrom, st, ed, val)`` in pieces between boundaries.

    Rows equal in source, chrom, st and ed count once; rows that aren't valued or have no ``st < ed`` count nothing.
    """
    u = units(F.col(val))
    good = rows.where(F.col(key).isNotNull() & (F.col(st) < F.col(ed)) & u.isNotNull())
    once = good.groupBy(F.col(source).alias("_src"), F.col(key).alias("chrom"), F.col(st).alias("_a"), F.col(ed).alias("_b")).agg(F.min(u).alias("_u"))
    ends = F.array(F.struct(F.col("_a").alias("p"), F.col("_u").alias("u"), F.lit(1).alias("d")), F.struct(F.col("_b").alias("p"), (-F.col("_u")).alias("u"), F.lit(-1).alias("d")))
    ev = once.select("chrom", F.explode(ends).alias("_e")).select("chrom", "_e.*").groupBy("chrom", "p").agg(F.sum("u").alias("u"), F.sum("d").alias("d"))
    ev = ev.withColumn("_s", shard_of(F.col("p"), SHARD))
    ev = scan(ev, KEYS, "_s", ["p"], {"level": F.col("u"), "depth": F.col("d")}, after=("_next", ["p"]))
    return ev.where("depth > 0").select("chrom", F.col("p").alias("st"), F.col("_next.p").alias("ed"), (F.col("level") / F.lit(float(SCALE))).alias("val"))


def cumulated(signal: DataFrame) -> DataFrame:
    """The signal (a table that has these columns already, as a stored track, comes back as it is) with ``idx`` (position in its chrom), ``next_st`` (start of the next interval), and before each interval
    ``cov0``, ``sum0``, ``sqr0``: covered bases, sum of values and of squares over bases, in units."""
    if {"idx", "u", "cov0", "sum0", "sqr0", "next_st"} <= set(signal.columns):
        return signal
    u, n = units(F.col("val")), F.col("ed") - F.col("st")
    s = signal.withColumns({"_s": shard_of(F.col("st"), SHARD), "u": u})
    sums = {"idx": F.lit(1).cast("bigint"), "cov0": n, "sum0": F.col("u") * n, "sqr0": F.col("u").cast("decimal(19,0)") * F.col("u").cast("decimal(19,0)") * n.cast("decimal(19,0)")}
    return scan(s, KEYS, "_s", ["st"], sums, inclusive=False, after=("_next", ["st"])).withColumn("next_st", F.col("_next.st")).drop("_s", "_next")


def _d(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _prefixes(signal: DataFrame, points: DataFrame, pos: str, *wanted: str) -> DataFrame:
    """``points`` with what lies before each position: of ``started`` (intervals that start at or before), ``cov``, ``sum``, ``sqr`` (bases,
    and sums over bases in units), ``value`` (null if uncovered) those ``wanted``, as ``_started`` and so on. One as-of join."""
    need = {"started": ["idx"], "cov": ["ed", "cov0"], "sum": ["ed", "u", "sum0"], "sqr": ["ed", "u", "sqr0"], "value": ["ed", "val"]}
    cols = list(dict.fromkeys(["chrom", "st", *[c for w in wanted for c in need[w]]]))
    p = asof_join(points, cumulated(signal).select(*cols), KEYS, pos, "st", "_hit")
    h = lambda f: F.col(f"_hit.{f}")
    part = F.least(h("ed"), F.col(pos)) - h("st")
    zero = F.lit(0).cast("bigint")
    is_ = {
        "started": lambda: F.coalesce(h("idx") + 1, zero), "cov": lambda: F.coalesce(h("cov0") + part, zero), "sum": lambda: F.coalesce(h("sum0") + h("u") * part, zero),
        "sqr": lambda: F.coalesce(h("sqr0") + _d(h("u")) * _d(h("u")) * _d(part), F.lit(0)).cast("decimal(38,0)"), "value": lambda: F.when(F.col(pos) < h("ed"), h("val")),
    }
    return p.select(*points.columns, *[is_[w]().alias(f"_{w}") for w in wanted])


def at_positions(signal: DataFrame, points: DataFrame, pos: str = "pos") -> DataFrame:
    """Each point with what the signal says about it; ``points`` has ``chrom`` and ``pos``.

    ``value`` (0 if uncovered), ``rank`` (number of the last interval that starts at or before, -1 if none), ``cover_idx``
    and ``cover_off`` (that interval and ``pos - st + 1`` if it covers the point, else the next number and 0), ``coverage``,
    ``prefix_sum`` and ``prefix_sqr`` over bases before the point, ``started`` (intervals that start at or before),
    ``next`` and ``prev`` (nearest covered position at or after, at or before; -1 if none).
    """
    c = cumulated(signal)
    p = asof_join(points, c, KEYS, pos, "st", "_hit")
    first = signal.groupBy("chrom").agg(F.min("st").alias("_first"))
    p = join_on(p, first, KEYS)
    h, x = (lambda f: F.col(f"_hit.{f}")), F.col(pos)
    inside = F.coalesce(x < h("ed"), F.lit(False))
    part = F.least(h("ed"), x) - h("st")
    zero = F.lit(0).cast("bigint")
    return p.select(
        *points.columns,
        F.when(inside, h("val")).otherwise(0.0).alias("value"),
        F.coalesce(h("idx"), F.lit(-1)).cast("bigint").alias("rank"),
        F.when(inside, h("idx")).otherwise(F.coalesce(h("idx") + 1, zero)).alias("cover_idx"),
        F.when(inside, x - h("st") + 1).otherwise(zero).alias("cover_off"),
        F.coalesce(h("cov0") + part, zero).alias("coverage"),
        (F.coalesce(h("sum0") + h("u") * part, zero) / F.lit(float(SCALE))).alias("prefix_sum"),
        (F.coalesce(h("sqr0") + _d(h("u")) * _d(h("u")) * _d(part), F.lit(0)).cast("double") / F.lit(float(SCALE * SCALE))).alias("prefix_sqr"),
        F.coalesce(h("idx") + 1, zero).alias("started"),
        F.when(inside, x).otherwise(F.coalesce(F.when(h("st").isNull(), F.col("_first")).otherwise(h("next_st")), F.lit(-1))).cast("bigint").alias("next"),
        F.when(inside, x).otherwise(F.coalesce(h("ed") - 1, F.lit(-1))).cast("bigint").alias("prev"),
    )


def valid_regions(regions: DataFrame) -> DataFrame:
    """Regions that can be answered: chrom given, ``st < ed``."""
    return regions.where("chrom is not null and st < ed")


def region_errors(regions: DataFrame) -> DataFrame:
    """``(region_id, error)``: regions without a chrom or with ``st >= ed`` (``interval``), or without a number of windows of at least 1 (``windows``)."""
    e = F.when(~F.coalesce(F.col("chrom").isNotNull() & (F.col("st") < F.col("ed")), F.lit(False)), "interval").when(~F.coalesce(F.col("n") >= 1, F.lit(False)), "windows")
    return regions.select("region_id", e.alias("error")).where("error is not null")


def pieces(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """Overlapping pairs: the region's columns, ``a, b`` (the shared bases), ``v`` (value), ``u`` (units), ``i_st, i_ed``."""
    both = overlap_join(valid_regions(regions), signal, prefix="i_")
    return both.select(*regions.columns, F.greatest("st", "i_st").alias("a"), F.least("ed", "i_ed").alias("b"), F.col("i_val").alias("v"), units(F.col("i_val")).alias("u"), "i_st", "i_ed")


#: What each measure is made of.
PARTS = {
    "sum": ("sum",), "sqrsum": ("sqr",), "cov": ("cov",), "avg": ("sum", "cov"), "stdev": ("sum", "sqr", "cov"), "cov_frac": ("cov",), "started": ("started",),
    "min": ("value",), "max": ("value",), "min_or_null": ("value",), "max_or_null": ("value",),
}
_SUMS = {"started": "bigint", "cov": "bigint", "sum": "bigint", "sqr": "decimal(38,0)"}


def _measures(wanted: list[str]) -> dict[str, Column]:
    s = F.coalesce(F.col("_sum"), F.lit(0)) / F.lit(float(SCALE))
    q = F.coalesce(F.col("_sqr"), F.lit(0)).cast("double") / F.lit(float(SCALE * SCALE))
    c = F.coalesce(F.col("_cov"), F.lit(0)).cast("bigint")
    all_ = {
        "sum": s, "sqrsum": q, "cov": c, "avg": F.when(c > 0, s / c), "stdev": F.when(c > 0, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / c) / c))),
        "min": F.coalesce("_lo", F.lit(0.0)), "max": F.coalesce("_hi", F.lit(0.0)), "min_or_null": F.col("_lo"), "max_or_null": F.col("_hi"), "started": F.coalesce("_started", F.lit(0)).cast("bigint"),
    }
    return {w: all_[w] for w in wanted if w in all_}


def _wanted(measures, known: list[str]) -> tuple[list[str], list[str], bool]:
    """The measures asked for (all of ``known`` by default), the running sums they need, and whether extremes are needed."""
    wanted = list(known if measures is None else measures)
    if bad := set(wanted) - set(known):
        raise ValueError(f"unknown measures {sorted(bad)}; there are {known}")
    need = {x for w in wanted for x in PARTS[w]}
    return wanted, [x for x in _SUMS if x in need], "value" in need


REGION_MEASURES = ["sum", "sqrsum", "cov", "avg", "stdev", "min", "max", "min_or_null", "max_or_null"]
WINDOW_MEASURES = ["sum", "avg", "cov", "min", "max", "min_or_null", "max_or_null", "stdev", "cov_frac", "started"]


def region_summary(signal: DataFrame, regions: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Per valid region ``sum, sqrsum, cov, avg, stdev, min, max, min_or_null, max_or_null`` (or the ``measures`` named) over its bases.

    ``avg`` and ``stdev`` (population, per base) are null without covered bases, ``min`` and ``max`` then 0. Regions of
    unknown chroms have nothing covered. Region ids are unique. Sums are differences of running sums at the two ends, so
    they cost the same for every length; only extremes read the intervals within.
    """
    wanted, sums, extremes = _wanted(measures, REGION_MEASURES)
    good = valid_regions(regions)
    out = good.select("region_id")
    if sums:
        ends = F.explode(F.array(F.struct(F.col("st").alias("p"), F.lit(-1).alias("d")), F.struct(F.col("ed").alias("p"), F.lit(1).alias("d")))).alias("_e")
        at = _prefixes(signal, good.select("region_id", "chrom", ends).select("region_id", "chrom", "_e.p", "_e.d"), "p", *sums)
        out = join_on(out, at.groupBy("region_id").agg(*[F.sum(F.col("d") * F.col(f"_{c}")).alias(f"_{c}") for c in sums]), ["region_id"])
    if extremes:
        out = join_on(out, pieces(signal, regions).groupBy("region_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")), ["region_id"])
    return out.select("region_id", *[e.alias(n) for n, e in _measures(wanted).items()])


def edge(i: Column) -> Column:
    """Left edge of window ``i`` of the ``n`` nearly equal windows of ``[st, ed)``."""
    st, ed, n = F.col("st"), F.col("ed"), F.col("n")
    return st + _div(2 * (ed - st) * i + n, 2 * n)


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative numbers."""
    return F.call_function("div", a, b)


def window_of(x: Column) -> Column:
    """Number of the window of ``[st, ed)`` in ``n`` that holds base ``x``: the inverse of :func:`edge`."""
    return _div(F.col("n") * (2 * (x - F.col("st")) + 1) - 1, 2 * (F.col("ed") - F.col("st")))


def windowed(regions: DataFrame) -> DataFrame:
    """Regions that can be cut into windows: valid, ``n >= 1``."""
    return valid_regions(regions).where("n >= 1")


def bin_edges(regions: DataFrame) -> DataFrame:
    """``(region_id, bin, bin_st, bin_ed)`` of regions with more bases than windows."""
    r = spread(windowed(regions).where("ed - st > n"), F.lit(0).cast("bigint"), F.col("n") - 1, "bin")
    return r.select("region_id", "bin", edge(F.col("bin")).alias("bin_st"), edge(F.col("bin") + 1).alias("bin_ed"))


def upsample_slots(regions: DataFrame, *keep: str) -> DataFrame:
    """``(region_id, keep..., bin, base)`` of regions with at most as many bases as windows: the base that each window repeats."""
    r = spread(windowed(regions).where("ed - st <= n"), F.lit(0).cast("bigint"), F.col("n") - 1, "bin")
    w = F.col("ed") - F.col("st")
    return r.select("region_id", *keep, "bin", (F.col("st") + _div(w * (2 * F.col("bin") + 1) - 1, 2 * F.col("n"))).alias("base"))


def window_summary(signal: DataFrame, regions: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Per window of each region ``(region_id, bin, sum, avg, cov, min, max, min_or_null, max_or_null, stdev, cov_frac, started)``, or the
    ``measures`` named.

    Running sums are looked up at every edge of a window, by one as-of join, and each window is the difference of its two
    edges. Only extremes read the intervals: each overlapping pair is split at the windows' edges. ``started`` counts intervals
    whose start lies in ``(bin_st, bin_ed]``. Regions with no more bases than windows repeat each base's value: ``sum``, ``avg``,
    ``min`` and ``max`` are then the base's value or null, ``cov`` and ``started`` 1 or 0, ``stdev`` 0. Region ids are unique.
    """
    wanted, sums, extremes = _wanted(measures, WINDOW_MEASURES)
    r = windowed(regions).select("region_id", "chrom", "st", "ed", "n")
    wide = r.where("ed - st > n")
    zero = F.lit(0).cast("bigint")
    edges = spread(wide, zero, F.col("n"), "bin").select("region_id", "chrom", "bin", edge(F.col("bin")).alias("p"), (F.col("bin") < F.col("n")).alias("_in"), F.lit(False).alias("_one"))
    slots = upsample_slots(regions.select("region_id", "chrom", "st", "ed", "n"), "chrom").select("region_id", "chrom", "bin", F.col("base").alias("p"), F.lit(True).alias("_in"), F.lit(True).alias("_one"))
    at = _prefixes(signal, edges.unionByName(slots), "p", *sums, "value")
    # an edge ends a window and begins the next; the difference adds up by window
    both = F.explode(F.array(F.struct(F.lit(0).alias("b"), F.lit(-1).alias("d")), F.struct(F.lit(-1).alias("b"), F.lit(1).alias("d")))).alias("_w")
    cut = at.where("not _one").select("*", both).where("case when _w.b = 0 then _in else bin > 0 end")
    size = F.col("_w.d") * F.col("p")
    cut = cut.select("region_id", (F.col("bin") + F.col("_w.b")).alias("bin"), size.alias("_size"), *[(F.col("_w.d") * F.col(f"_{c}")).cast(_SUMS[c]).alias(f"_{c}") for c in sums])
    if extremes:
        within = spread(pieces(signal, wide), window_of(F.col("a")), window_of(F.col("b") - 1), "bin").select("region_id", "bin", F.col("v").alias("_lo"), F.col("v").alias("_hi"))
        cut = cut.unionByName(within, allowMissingColumns=True)
    agg = cut.groupBy("region_id", "bin").agg(F.sum("_size").alias("_size"), *[F.sum(f"_{c}").alias(f"_{c}") for c in sums], *([F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")] if extremes else []))
    m = _measures(wanted) | ({"cov_frac": F.coalesce("_cov", zero) / F.col("_size")} if "cov_frac" in wanted else {})
    out = agg.select("region_id", "bin", *[m[x].alias(x) for x in wanted])
    v = F.col("_value")
    one = F.when(v.isNotNull(), F.lit(1)).otherwise(0).cast("bigint")
    repeat = {"cov": one, "started": one, "cov_frac": one.cast("double"), "stdev": F.lit(0.0)}
    return out.unionByName(at.where("_one").select("region_id", "bin", *[repeat.get(x, v).alias(x) for x in wanted]))


def listed(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """The intervals that meet each region, unclipped: ``(region_id, st, ed, val)``."""
    return pieces(signal, regions).select("region_id", F.col("i_st").alias("st"), F.col("i_ed").alias("ed"), F.col("v").alias("val"))


def base_values(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """``(region_id, pos, val)`` of every base of each valid region, ``val`` null where it is uncovered."""
    r = spread(valid_regions(regions), F.col("st"), F.col("ed") - 1, "pos").select("region_id", "pos", F.lit(None).cast("double").alias("v"))
    got = spread(pieces(signal, regions), F.col("a"), F.col("b") - 1, "pos").select("region_id", "pos", "v")
    return r.unionByName(got).groupBy("region_id", "pos").agg(F.max("v").alias("val"))


def found_ranges(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """``(region_id, first, last)``: numbers of the first and one past the last interval that meets the region; null if none does."""
    good = valid_regions(regions)
    ends = F.explode(F.array(F.struct(F.col("st").alias("p"), F.lit(0).alias("w")), F.struct((F.col("ed") - 1).alias("p"), F.lit(1).alias("w")))).alias("_e")
    at = _prefixes(signal, good.select("region_id", "chrom", ends).select("region_id", "chrom", "_e.p", "_e.w"), "p", "started", "value")
    first = F.max(F.when(F.col("w") == 0, F.col("_started") - F.col("_value").isNotNull().cast("int")))
    hit = at.groupBy("region_id").agg(first.alias("first"), F.max(F.when(F.col("w") == 1, F.col("_started"))).alias("last"))
    some = F.col("first") < F.col("last")
    return join_on(good.select("region_id"), hit, ["region_id"]).select("region_id", F.when(some, F.col("first")).cast("bigint").alias("first"), F.when(some, F.col("last")).cast("bigint").alias("last"))


def covered_at_length(signal: DataFrame, points: DataFrame, length: str = "pos") -> DataFrame:
    """Inverse of the covered length: ``(points..., idx)``, the number of intervals that have less than ``length`` covered bases before them."""
    c = cumulated(signal).select("chrom", "cov0", "idx")
    got = asof_join(points.withColumn("_w", F.col(length) - 1), c, KEYS, "_w", "cov0", "_hit")
    return got.select(*points.columns, F.coalesce(F.col("_hit.idx") + 1, F.lit(0)).cast("bigint").alias("idx"))


def track_summary(signal: DataFrame) -> DataFrame:
    """Per chrom ``intervals, last_position, covered, distinct_values, min_val, max_val, scale, delta``."""
    u = units(F.col("val"))
    return signal.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("intervals"), F.max("ed").alias("last_position"), F.sum(F.col("ed") - F.col("st")).alias("covered"), F.countDistinct(u).alias("distinct_values"),
        F.min("val").alias("min_val"), F.max("val").alias("max_val"), F.lit(SCALE).cast("bigint").alias("scale"), F.min(u).alias("delta"),
    )


def _islands(signal: DataFrame, joined: Column, cols: list[str]) -> DataFrame:
    """The signal with ``island``: the number of the run of rows of which each but the first is ``joined`` to the one before (``before``)."""
    s = signal.withColumn("_s", shard_of(F.col("st"), SHARD))
    s = neighbour(s, KEYS, "_s", ["st"], cols, "before")
    s = s.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1).cast("bigint"))
    return running(s, KEYS, "_s", ["st"], {"island": F.col("_new")})


def merged_equal(signal: DataFrame) -> DataFrame:
    """Abutting intervals of equal value as one: ``(chrom, st, ed, val, n)``."""
    same = (F.col("before.ed") == F.col("st")) & (F.col("before.val") == F.col("val"))
    return _islands(signal, same, ["ed", "val"]).groupBy("chrom", "island").agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.min("val").alias("val"), F.count(F.lit(1)).alias("n")).drop("island")


def segments(signal: DataFrame) -> DataFrame:
    """Maximal runs of abutting intervals: ``(chrom, st, ed, n)``."""
    return _islands(signal, F.col("before.ed") == F.col("st"), ["ed"]).groupBy("chrom", "island").agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.count(F.lit(1)).alias("n")).drop("island")


def gap_lengths(signal: DataFrame) -> DataFrame:
    """``(chrom, st, gap)``: uncovered bases before each interval, from 0 for the first."""
    s = neighbour(signal.withColumn("_s", shard_of(F.col("st"), SHARD)), KEYS, "_s", ["st"], ["ed"], "before")
    return s.select("chrom", "st", (F.col("st") - F.coalesce("before.ed", F.lit(0))).alias("gap"))


def dense(signal: DataFrame, pos: str = "pos", val: str = "v") -> DataFrame:
    """``(chrom, pos, v)`` of every covered base."""
    return spread(signal.select("chrom", "st", "ed", "val"), F.col("st"), F.col("ed") - 1, "_p").select("chrom", F.col("_p").alias(pos), F.col("val").alias(val))


def runs_of(bases: DataFrame) -> DataFrame:
    """The inverse of :func:`dense`: bases ``(chrom, pos, v)`` to intervals of equal value; zeros and nulls are dropped."""
    one = bases.where("v <> 0").select("chrom", F.col("pos").alias("st"), (F.col("pos") + 1).alias("ed"), F.col("v").alias("val"))
    return merged_equal(one).drop("n")


def overlap_violations(rows: DataFrame, keys: tuple[str, ...] = ("track_id", "chrom")) -> DataFrame:
    """``(track_id, chrom, st, ed, problem)``: rows with ``ed <= st`` (``empty``), and rows that start before a row before them ends (``overlap``)."""
    k = F.struct(*keys)
    s = rows.where("st is not null and ed is not null and chrom is not null").select(k.alias("_k"), "st", "ed").groupBy("_k", "st", "ed").agg(F.count(F.lit(1)).alias("_n"))
    s = s.withColumn("_s", shard_of(F.col("st"), SHARD))
    s = scan(s, ["_k"], "_s", ["st", "ed"], highs={"_until": F.col("ed")})
    p = F.when(F.col("ed") <= F.col("st"), "empty").when((F.col("_until") > F.col("st")) | (F.col("_n") > 1), "overlap")
    return s.select("_k.*", "st", "ed", p.alias("problem")).where("problem is not null")


def zone_map(signal: DataFrame, size: int = 16) -> DataFrame:
    """``(chrom, zone, n, min_val, max_val)`` of every ``size`` consecutive intervals."""
    return cumulated(signal).groupBy("chrom", (F.col("idx") - F.pmod("idx", F.lit(size))).alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.min("val").alias("min_val"), F.max("val").alias("max_val"))


def sampled_sums(signal: DataFrame, every: int = 64) -> DataFrame:
    """``(chrom, idx, sum0, sqr0)``: sums over bases before every ``every``-th interval, in units."""
    return cumulated(signal).where(F.pmod("idx", F.lit(every)) == 0).select("chrom", "idx", "sum0", F.col("sqr0").cast("double").alias("sqr0"))


def index_ranges(signal: DataFrame, size: int = 100) -> DataFrame:
    """``(chrom, first, last, psum, lo, hi)`` of each range of ``size`` interval numbers: sum over bases before it, minimum and maximum in it."""
    c = cumulated(signal).withColumn("first", F.col("idx") - F.pmod("idx", F.lit(size)))
    out = c.groupBy("chrom", "first").agg((F.max("idx") + 1).alias("last"), F.min_by("sum0", "idx").alias("psum"), F.min("val").alias("lo"), F.max("val").alias("hi"))
    return out.withColumn("psum", F.col("psum") / F.lit(float(SCALE)))


def index_extremes(signal: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(qid, psum, lo, hi)`` of interval numbers ``[i, j)`` of a chrom: sum over bases before interval ``i``, least and greatest value in the range.

    ``ranges`` has ``qid, chrom, i, j``. Numbers beyond the chrom's last are left out; null where none remains, ``psum`` where there is no ``i``.
    """
    c = cumulated(signal).select("chrom", "idx", "val", "sum0")
    size = c.groupBy("chrom").agg(F.count(F.lit(1)).alias("_n"))  # a row per chrom
    size = size.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = join_on(c, size.select("chrom", "_o"), KEYS, "inner").select((F.col("_o") + F.col("idx")).alias("pos"), "val", "sum0")
    q = join_on(ranges.select("qid", "chrom", F.greatest("i", F.lit(0)).alias("i"), "j"), size, KEYS)
    q = q.select("qid", (F.col("_o") + F.col("i")).alias("b"), (F.col("_o") + F.least("j", "_n")).alias("e"), (F.col("i") < F.col("_n")).alias("_in"))
    ext = extremes(line.select("pos", F.col("val").alias("v")), q.where("b < e").select("qid", "b", "e"))
    sums = join_on(q.where("_in").select("qid", F.col("b").alias("pos")), line.select("pos", "sum0"), ["pos"], "inner").select("qid", (F.col("sum0") / F.lit(float(SCALE))).alias("psum"))
    return join_on(join_on(ranges.select("qid"), sums, ["qid"]), ext.select("qid", F.col("min").alias("lo"), F.col("max").alias("hi")), ["qid"])


def order_violations(rows: DataFrame, keys: tuple[str, ...] = ("track_id", "chrom"), order: str = "ord") -> DataFrame:
    """``(track_id, chrom, ord, problem)``: rows that, in the order given, start before the row before (``start``), or start with it and
    end earlier (``end``); and rows with ``ed <= st`` (``empty``). Rows with a null key part, ``st``, ``ed`` or order aren't looked at."""
    good = rows.dropna(subset=[*keys, "st", "ed", order]).select(F.struct(*keys).alias("_k"), "st", "ed", F.col(order).alias("_i"))
    s = neighbour(good.withColumn("_s", shard_of(F.col("_i"), SHARD)), ["_k"], "_s", ["_i", "st", "ed"], ["st", "ed"], "_b")
    p = F.when(F.col("ed") <= F.col("st"), "empty").when(F.col("st") < F.col("_b.st"), "start").when((F.col("st") == F.col("_b.st")) & (F.col("ed") < F.col("_b.ed")), "end")
    return s.select("_k.*", F.col("_i").alias(order), p.alias("problem")).where("problem is not null")


def end_pairs(rows: DataFrame, keys: tuple[str, ...] = ("track_id", "chrom"), id_: str = "ord") -> DataFrame:
    """Starts and ends of intervals in one order of place, and each interval's pair: ``(track_id, chrom, ord, first, span)``.

    ``first`` is the number of the start among all starts and ends of its key, by position and ``id_``; ``span`` is how many
    places later its end comes. Rows with ``ed <= st`` or nulls are left out; ``id_`` is unique within the keys.
    """
    k = F.struct(*keys)
    good = rows.dropna(subset=[*keys, id_]).where("st < ed")
    each = good.select(k.alias("_k"), F.col(id_).alias("_i"), F.explode(F.array("st", "ed")).alias("_p")).withColumn("_s", shard_of(F.col("_p"), SHARD))
    n = running(each, ["_k"], "_s", ["_p", "_i"], {"_n": F.lit(1).cast("bigint")}, inclusive=False).groupBy("_k", "_i").agg(F.min("_n").cast("bigint").alias("first"), (F.max("_n") - F.min("_n")).cast("bigint").alias("span"))
    return n.select("_k.*", F.col("_i").alias(id_), "first", "span")


def depth(rows: DataFrame, keys: tuple[str, ...] = ("track_id", "chrom")) -> DataFrame:
    """Sweep over the ends of possibly overlapping intervals: ``(track_id, chrom, pos, depth)`` after each position where it changes."""
    k = F.struct(*keys)
    good = rows.where("st < ed and chrom is not null").select(k.alias("_k"), F.explode(F.array(F.struct(F.col("st").alias("p"), F.lit(1).alias("d")), F.struct(F.col("ed").alias("p"), F.lit(-1).alias("d")))).alias("_e"))
    ev = good.groupBy("_k", F.col("_e.p").alias("pos")).agg(F.sum("_e.d").alias("_d")).where("_d <> 0").withColumn("_s", shard_of(F.col("pos"), SHARD))
    return running(ev, ["_k"], "_s", ["pos"], {"depth": F.col("_d")}).select("_k.*", "pos", "depth")


def quantised(signal: DataFrame, digits: int = 3) -> DataFrame:
    """Values as whole numbers and back: ``(chrom, st, code, rank, back)``; ``code`` is ``val * 10^digits`` less the chrom's smallest, ``rank`` its place in the chrom's dictionary.

    Both follow from shards of values: the distinct values of a shard are numbered in it, and a scan of the shards' counts gives
    what lies below. The dictionary has one row per chrom and distinct value, joined on both.
    """
    f = 10**digits
    s = signal.select("chrom", "st", F.round(F.col("val") * f).cast("bigint").alias("_u"))
    low = s.groupBy("chrom").agg(F.min("_u").alias("_low"))
    words = s.groupBy("chrom", "_u").agg(F.lit(1).cast("bigint").alias("_one")).withColumn("_s", shard_of(F.col("_u"), SHARD))
    ranks = running(words, KEYS, "_s", ["_u"], {"rank": F.col("_one")}, inclusive=False).select("chrom", "_u", F.col("rank").cast("bigint").alias("rank"))
    ranks = join_on(ranks, low, ["chrom"])  # a row per distinct value and chrom
    out = join_on(s, ranks, ["chrom", "_u"])
    return out.select("chrom", "st", (F.col("_u") - F.col("_low")).alias("code"), "rank", (F.col("_u") / F.lit(float(f))).alias("back"))
