import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from rangeloom.api import Features, Points, Track
from rangeloom.sources import files, service
from rangeloom.streaming import windows

SIGNAL = [("chr20", 5, 9, 0.02, "abc"), ("chr19", 2000, 2300, -1.0, None), ("chr19", 2300, 2600, -0.75, "ggg g")]


def lines(spark, path):
    import glob
    import os

    return [x.rstrip("\n") for p in sorted(glob.glob(os.path.join(path, "part-*"))) for x in open(p, encoding="utf-8")]


def test_signal_files(spark, tmp_path):
    df = spark.createDataFrame(SIGNAL, "chrom string, st bigint, ed bigint, val double, annotation string")
    files.write_signal(df, str(tmp_path / "plain"))
    files.write_signal(df, str(tmp_path / "noted"), annotation=True)
    assert lines(spark, tmp_path / "plain") == ["chr19\t2000\t2300\t-1", "chr19\t2300\t2600\t-0.75", "chr20\t5\t9\t0.02"]
    back = files.read_signal(spark, str(tmp_path / "noted"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(SIGNAL, key=str)
    t = Track.load(spark, str(tmp_path / "plain")).save(str(tmp_path / "x.track"))
    assert Track.load(spark, str(tmp_path / "x.track")).region("chr19", 0, 9000)["sum"] == -525 and t.chroms() == ["chr19", "chr20"]
    assert files.build_missing({str(tmp_path / "x.track"): df, str(tmp_path / "y.track"): df}) == [str(tmp_path / "y.track")]


def test_bad_lines(spark, tmp_path):
    p = tmp_path / "x.bedgraph"
    p.write_text("# c\n\ntrack type=x\nchr1 1 5 2\nchr1\t5\t5\t1\nchr1 1 x 1\nchr1 7\nchr1  8\t9  1e1   a note \n")
    rows = files.parse_signal(spark.read.text(str(p))).collect()
    assert [tuple(r)[:5] for r in rows if r["error"] is None] == [("chr1", 1, 5, 2.0, None), ("chr1", 8, 9, 10.0, "a note")]
    assert [r["error"] for r in rows if r["error"]] == ["chr1\t5\t5\t1", "chr1 1 x 1", "chr1 7"]
    with pytest.raises(Exception, match="not a signal line"):
        files.read_signal(spark, str(p)).collect()


def test_features(spark, tmp_path):
    rows = [("chr1", 1, 3, "abc"), ("chr1", 2, 4, "def x"), ("chr2", 1, 50, ""), ("chr2", 1, 8, None)]
    df = spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "feature_id bigint, track_id bigint, chrom string, st bigint, ed bigint, other string")
    f = Features(files.numbered_features(df), "meta")
    assert f.get("chr1", 1) == (2, 4, "def x") and f.get("chr2", 0) == (1, 8, "") and f.get("chr2", 1) == (1, 50, "") and f.get("chr2", 2) is None and f.size("chr1") == 2
    f.dump(str(tmp_path / "bed"))
    assert lines(spark, tmp_path / "bed") == ["chr1\t1\t3\tabc", "chr1\t2\t4\tdef x", "chr2\t1\t8", "chr2\t1\t50"]
    back = files.read_features(spark, str(tmp_path / "bed"))
    assert {tuple(r)[:4] for r in back.collect()} == {(c, s, e, o or "") for c, s, e, o in rows}
    (tmp_path / "q").write_text("chr1 5 9\nchr2\t1\t4\t7\n")
    assert sorted(map(tuple, files.read_regions(spark, str(tmp_path / "q")).collect())) == [("chr1", 5, 9, None), ("chr2", 1, 4, 7)]


def test_points(spark, tmp_path):
    xy = [(3, 1), (1, 2), (1, 2), (0, 9)]
    files.write_points(spark.createDataFrame(xy, "x bigint, y bigint"), str(tmp_path / "p"))
    assert lines(spark, tmp_path / "p") == ["4", "0 9", "1 2", "1 2", "3 1"]
    p = Points(files.read_points(spark, str(tmp_path / "p")))
    assert p.size() == 4 and p.count(0, 2, 0, 3) == 2 and p.count(2, 0, 3, 0) == 2 and p.dominated(4, 2) == 1
    (tmp_path / "bad").write_text("3\n1 2\n")
    with pytest.raises(ValueError):
        files.read_points(spark, str(tmp_path / "bad"))


def test_service(spark):
    s = spark.createDataFrame([("c", 0, 10, 2.0), ("c", 20, 30, 4.0)], "chrom string, st bigint, ed bigint, val double")
    assert service.handle(s, "/x?file=f&op=avg&chrom=c&start=0&end=40&w=4") == (200, "[2.0,null,4.0,null]")
    assert service.handle(s, "/x?op=cov&chrom=c&start=0&end=40") == (200, "[20]")
    assert service.handle(s, "/x?op=cov&chrom=c&start=0&end=40&w=10001")[0] == 400 and service.handle(s, "/x?op=no&chrom=c&start=0&end=4")[0] == 400
    two = {"f": s, "g": s.limit(0)}
    assert [service.handle(two, f"/x?file={f}&op=cov&chrom=c&start=0&end=40") for f in "fgh"] == [(200, "[20]"), (200, "[0]"), (404, "unknown file")]
    web = service.server(two, 0)
    threading.Thread(target=web.handle_request).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/x?file=f&op=max&chrom=c&start=0&end=40") as r:
        assert (r.status, r.read()) == (200, b"[4.0]")
    web.server_close()
    assert service.handle(s, "/x?op=avg&chrom=c&start=9&end=4") == (400, "invalid interval") and service.handle(s, "/x")[0] == 404


def test_streams(spark, tmp_path):
    rows = [(f"k{i % 2}", i * 600, float(i), i // 7 % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, sec bigint, v double, state bigint").withColumn("ts", F.timestamp_seconds("sec"))
    for part in range(3):
        df.where(F.col("sec") % 3 * 0 + F.floor(F.col("sec") / 12000) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.opened(spark, str(tmp_path / "in"))
    out = windows.drained(spark, windows.tumbling(stream, "k", "ts", "v", late="1000 hours"), "complete").collect()
    assert sum(r["n"] for r in out) == 60 and len(out) == 20 and all(r["n"] == 3 for r in out)
    s = windows.drained(spark, windows.sessions(windows.opened(spark, str(tmp_path / "in")), "k", "ts", "21 minutes", late="1000 hours"), "complete").collect()
    assert sorted((r["k"], r["n"]) for r in s) == [("k0", 30), ("k1", 30)]
    c = windows.drained(spark, windows.changes(windows.opened(spark, str(tmp_path / "in")), "k", "sec", "state")).collect()
    want = 0
    for k in ("k0", "k1"):
        last = None
        for kk, _, _, st in rows:
            if kk == k and st != last:
                want, last = want + 1, st
    assert len(c) == want


def test_late_rows(spark, tmp_path):
    import time

    def add(rows):
        df = spark.createDataFrame(rows, "k string, sec bigint, v double").withColumn("ts", F.timestamp_seconds("sec"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times

    hour = 3600
    add([("a", 10, 1.0), ("a", 20 * hour, 2.0)])
    add([("a", 21 * hour, 3.0), ("a", 19 * hour + 5, 4.0)])
    add([("a", 30 * hour, 5.0), ("a", 50, 8.0)])  # the last is late by more than a day
    stream = windows.opened(spark, str(tmp_path / "in"))
    one = stream.sparkSession.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.drained(spark, windows.tumbling(one, "k", "ts", "v")).collect()
    assert sorted((r["n"], r["sum"]) for r in out) == [(1, 100), (1, 200), (1, 300), (1, 400)]  # neither the late row nor the open window
    got = windows.drained(spark, windows.changes(one, "k", "sec", "v")).collect()
    assert sorted(r["pos"] for r in got) == [10, 20 * hour, 21 * hour, 30 * hour]
