"""The tail of a growing log: every whole line once, whatever is cut, lost or run again."""

import json

import pytest
from pyspark.sql import functions as F

from memspark.streaming import tail


def run(spark, log, out, check, **k):
    q = tail.keep_once(tail.tailed(spark, str(log), **k), str(out), str(check))
    q.awaitTermination()


def kept(spark, out):
    return sorted((r["offset"], r["line"]) for r in spark.read.parquet(str(out)).select("offset", "line").collect())


def of(text):
    at, found = 0, []
    for line in text.encode().split(b"\n")[:-1]:
        found.append((at, line.decode()))
        at += len(line) + 1
    return found


@pytest.mark.parametrize("size", [1, 2, 7, 50, 10_000])
def test_ranges_give_every_line_once(tmp_path, size):
    text = "".join(f"{'é' * (i % 5)}{i}\n" * (i % 3) for i in range(40)) + "\n\nlast\n"
    (tmp_path / "log").write_text(text + "not yet")
    path = str(tmp_path / "log")
    end = tail.whole(path)
    assert end == len(text.encode())
    reader = tail.TailReader(path, size)
    assert [x for p in reader.partitions({"at": 0}, {"at": end}) for x in reader.read(p)] == of(text)
    middle = len(text.encode()[:60].rsplit(b"\n", 1)[0]) + 1
    assert [x for p in reader.partitions({"at": middle}, {"at": end}) for x in reader.read(p)] == [x for x in of(text) if x[0] >= middle]
    (tmp_path / "empty").write_text("no end")
    assert tail.whole(str(tmp_path / "empty")) == 0 == tail.whole(str(tmp_path / "none"))


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    log, out, check = tmp_path / "log.jsonl", tmp_path / "out", tmp_path / "check"
    said = lambda a, b: "".join(json.dumps({"t": i, "node": f"n{i % 3}"}) + "\n" for i in range(a, b))
    log.write_text(said(0, 20) + '{"t": 99')
    run(spark, log, out, check, range_bytes=64)
    assert kept(spark, out) == of(said(0, 20))
    log.write_text(said(0, 20) + '{"t": 99, "node": "late"}\n' + said(20, 30))
    text = log.read_text()

    def lost(rows, number):  # rows are written, then the run is lost before its batch is committed
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("lost")

    q = tail.tailed(spark, str(log)).writeStream.foreachBatch(lost).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    log.write_text(text + said(30, 35))
    run(spark, log, out, check)
    run(spark, log, out, check)  # nothing new
    assert kept(spark, out) == of(text + said(30, 35))
    counts = {r["node"]: r["n"] for r in spark.read.parquet(str(out)).select(F.from_json("line", "t bigint, node string").alias("x")).groupBy("x.node").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"n0": 12, "n1": 12, "n2": 11, "late": 1}
