"""Summary requests as addresses ``?file=&op=&chrom=&start=&end=[&w=]`` and their answers as JSON arrays, many at a time."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signal as sg

OPERATIONS = {"avg": "avg", "sum": "sum", "min": "min", "max": "max", "cov": "cov", "stdev": "stdev", "cnt": "started"}
MOST_WINDOWS = 10_000


def requests(addresses: DataFrame, url: str = "url", key: str = "region_id") -> DataFrame:
    """``(region_id, op, chrom, st, ed, n, error)`` of each address; without ``w`` one window. ``error`` says what is wrong, or is null."""
    part = lambda k: F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(k))
    raw = part("w")
    r = addresses.select(key, part("op").alias("op"), part("chrom").alias("chrom"), part("start").try_cast("bigint").alias("st"), part("end").try_cast("bigint").alias("ed"), F.when(raw.isNull(), F.lit(1).cast("bigint")).otherwise(raw.try_cast("bigint")).alias("n"))
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(bad(F.col("op").isin(*OPERATIONS)), "unknown operation")
        .when(F.col("chrom").isNull() | bad(F.col("st") < F.col("ed")), "invalid interval")
        .when(bad((F.col("n") >= 1) & (F.col("n") <= MOST_WINDOWS)), "invalid number of windows")
    )
    return r.withColumn("error", error)


def answers_of(signals: dict[str, DataFrame], addresses: DataFrame, url: str = "url", key: str = "region_id") -> DataFrame:
    """:func:`answers` of several tracks: each address is asked of the track its ``file`` names; 404 where there is none."""
    named = addresses.withColumn("_file", F.coalesce(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit("file")), F.lit("")))
    out = named.where(~F.col("_file").isin(*signals)).select(F.col(key).alias("region_id"), F.lit(404).alias("status"), F.lit("unknown file").alias("body"))
    for name, signal in signals.items():
        out = out.unionByName(answers(signal, named.where(F.col("_file") == name), url, key))
    return out


def answers(signal: DataFrame, addresses: DataFrame, url: str = "url", key: str = "region_id") -> DataFrame:
    """``(region_id, status, body)``: 200 and a JSON array of the windows' values (null where there is none), or 400 and the error."""
    r = requests(addresses, url, key).withColumnRenamed(key, "region_id")
    good = r.where("error is null")
    w = sg.window_summary(signal, good.select("region_id", "chrom", "st", "ed", "n"))
    one = F.coalesce(*[F.when(F.col("op") == k, F.coalesce(F.col(c).cast("string"), F.lit("null"))) for k, c in OPERATIONS.items()])
    w = w.join(good.select("region_id", "op"), "region_id").select("region_id", "bin", one.alias("_v"))
    # a request has at most 10,000 windows, so its answer fits a row
    body = w.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("bin", "_v"))).alias("_l"))
    ok = body.select("region_id", F.lit(200).alias("status"), F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["_v"]), ","), F.lit("]")).alias("body"))
    return ok.unionByName(r.where("error is not null").select("region_id", F.lit(400).alias("status"), F.col("error").alias("body")))


def handle(signal: DataFrame | dict[str, DataFrame], address: str) -> tuple[int, str]:
    """The answer to one address, of one track or of the one of several that ``file`` names."""
    if not parse_qs(urlparse(address).query):
        return 404, "no query"
    several = isinstance(signal, dict)
    spark = next(iter(signal.values())).sparkSession if several else signal.sparkSession
    asked = spark.createDataFrame([(0, address)], "region_id bigint, url string")
    row = (answers_of if several else answers)(signal, asked).head()
    return row["status"], row["body"]


def server(signal: DataFrame | dict[str, DataFrame], port: int, host: str = "127.0.0.1") -> HTTPServer:
    """An HTTP server that answers summary requests; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = handle(signal, self.path)
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if status == 200 else "text/plain")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return HTTPServer((host, port), Handler)
