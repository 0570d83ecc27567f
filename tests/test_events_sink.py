import json
import os
import random

import pytest

from paperloom.sources import events_sink as sink


def source(spark, tmp_path):
    return spark.readStream.schema(sink.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def add(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, sink.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))


@pytest.mark.parametrize("kind", ["sse", "ndjson"])
def test_lines_keep_their_order_and_are_written_once(spark, tmp_path, kind):
    r = random.Random(1)
    given = [[(d, k * 10 + p, f"line {d}.{k}.{p}\nü {{}}" if p != 3 else None) for d in range(6) for p in range(5)] for k in range(3)]
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k, rows in enumerate(given):
        add(spark, tmp_path, k, r.sample(rows, len(rows)))
        sink.stream_lines(source(spark, tmp_path), path, checkpoint, kind).awaitTermination()
    got = sink.committed_lines(spark, path).collect()
    want = sorted(x for rows in given for x in rows if x[2] is not None)
    assert sorted((x["doc"], x["place"], x["line"]) for x in got) == want
    for d in range(6):
        own = sorted((x for x in got if x["doc"] == d), key=lambda x: (x["batch"], x["nth"]))
        assert [x["place"] for x in own] == sorted(x["place"] for x in own)
    # A batch that is run again, its commit not yet noted by the stream, writes nothing twice.
    for log in ("commits",):
        last = max((f for f in os.listdir(f"{checkpoint}/{log}") if f.isdigit()), key=int)
        os.remove(f"{checkpoint}/{log}/{last}")
        crc = f"{checkpoint}/{log}/.{last}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    before = sorted(os.listdir(path))
    sink.stream_lines(source(spark, tmp_path), path, checkpoint, kind).awaitTermination()
    assert sorted(map(str, sink.committed_lines(spark, path).collect())) == sorted(map(str, got))
    assert sorted(os.listdir(path)) == before


def test_what_a_failed_task_left_is_not_read(spark, tmp_path):
    from pyspark.sql.types import StructType

    writer = sink._Writer(str(tmp_path), "ndjson", StructType.fromDDL(sink.SCHEMA))
    done, left = writer.write(iter([(1, 1, "b"), (1, 0, "a")])), writer.write(iter([(1, 0, "again")]))
    writer.commit([done, None, writer.write(iter([]))], 0)
    assert [x["line"] for x in sorted(sink.committed_lines(spark, str(tmp_path)).collect(), key=lambda x: x["nth"])] == ["a", "b"]
    writer.abort([left], 1)
    assert left.file not in os.listdir(tmp_path)
    assert json.load(open(sink._manifest(str(tmp_path), 0)))["lines"] == 2
    assert sink.committed_lines(spark, str(tmp_path / "none")).count() == 0
