"""A data source that streams rows as server-sent events or NDJSON, with a commit of its own.

``df.writeStream.format("paperloom_events").option("path", folder).option("kind", "sse")`` takes rows (doc, place, line). A
batch's lines of a document come in order of place; batches come one after another. A task writes its part to a file of
its own; the driver then commits the batch by writing one manifest that names the parts. A reader follows the
manifests alone, so what a failed or repeated task left is never read, and a batch that is run again after its commit
writes nothing. The folder must be one that the driver and all executors share, as Python writes it.

Null lines are left out. A task holds its share of one batch, to put it in order: bound batches at the source.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from paperloom.sources.scratch import scratch_path

NAME = "paperloom_events"
SCHEMA = "doc long, place long, line string"


@dataclass
class _Part(WriterCommitMessage):
    file: str
    lines: int


def _manifest(path: str, batch: int) -> str:
    return os.path.join(path, f"batch-{batch:012d}.json")


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, kind: str, schema: StructType):
        self.path, self.kind, self.names = path, kind, schema.names

    def write(self, iterator: Iterator) -> _Part:
        doc, place, line = (self.names.index(c) for c in ("doc", "place", "line"))
        rows = sorted(((r[doc], r[place], r[line]) for r in iterator if r[line] is not None), key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0)))
        name = f"part-{uuid.uuid4().hex}"
        if rows:
            os.makedirs(self.path, exist_ok=True)
            with open(os.path.join(self.path, name), "w", encoding="utf-8") as out:
                for d, p, text in rows:
                    if self.kind == "sse":
                        body = "".join(f"data: {x}\n" for x in text.split("\n"))
                        out.write(f"id: {d}:{p}\n{body}\n")
                    else:
                        out.write(json.dumps({"doc": d, "place": p, "line": text}, ensure_ascii=False) + "\n")
        return _Part(name if rows else "", len(rows))

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        os.makedirs(self.path, exist_ok=True)
        parts = [m for m in messages if m is not None and m.file]
        if os.path.exists(_manifest(self.path, batchId)):  # it was committed before the stream could note it
            self.abort(messages, batchId)
            return
        held = _manifest(self.path, batchId) + f".{uuid.uuid4().hex}"
        with open(held, "w", encoding="utf-8") as out:
            json.dump({"batch": batchId, "kind": self.kind, "parts": [m.file for m in parts], "lines": sum(m.lines for m in parts)}, out)
        os.rename(held, _manifest(self.path, batchId))

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m is not None and m.file and os.path.exists(os.path.join(self.path, m.file)):
                os.remove(os.path.join(self.path, m.file))


@dataclass
class _File(InputPartition):
    batch: int
    file: str
    kind: str


class _Reader(DataSourceReader):
    """(batch, doc, place, line, nth) of all committed lines; ``nth`` is a line's place in its part."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        out = []
        for name in sorted(os.listdir(self.path)) if os.path.isdir(self.path) else []:
            if name.startswith("batch-") and name.endswith(".json"):
                with open(os.path.join(self.path, name), encoding="utf-8") as f:
                    said = json.load(f)
                out += [_File(said["batch"], part, said["kind"]) for part in said["parts"]]
        return out or [_File(-1, "", "none")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.file:
            return
        with open(os.path.join(self.path, partition.file), encoding="utf-8") as f:
            text = f.read()
        if partition.kind == "sse":
            for nth, event in enumerate(e for e in text.split("\n\n") if e):
                head, *body = event.split("\n")
                doc, place = (None if x == "None" else int(x) for x in head.removeprefix("id: ").split(":"))
                yield partition.batch, doc, place, "\n".join(x.removeprefix("data: ") for x in body), nth
        else:
            for nth, line in enumerate(text.split("\n")[:-1]):
                row = json.loads(line)
                yield partition.batch, row["doc"], row["place"], row["line"], nth


class EventsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "batch long, doc long, place long, line string, nth long"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://").removeprefix("file:")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._path())

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        kind = self.options.get("kind", "ndjson")
        if kind not in ("sse", "ndjson"):
            raise ValueError("kind is sse or ndjson")
        return _Writer(self._path(), kind, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventsSource)


def stream_lines(lines: DataFrame, path: str, checkpoint: str, kind: str = "ndjson"):
    """Streams rows (doc, place, line) into ``path``; a document's lines of a batch go to one task. Returns the query, which ends when all there is now is written."""
    register(lines.sparkSession)
    dealt = lines.select(F.col("doc").cast("long").alias("doc"), F.col("place").cast("long").alias("place"), "line").repartition("doc")
    return dealt.writeStream.format(NAME).option("path", path).option("kind", kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_lines(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).load()


def progressive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents, streamed as events and read back: its document, place and length."""
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parquet*")
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    path = scratch_path(spark, "events").removeprefix("file://").removeprefix("file:")
    stream_lines(lines, path, scratch_path(spark, "events-checkpoint"), "sse").awaitTermination()
    return committed_lines(spark, path).select("doc", "place", F.length("line").cast("long").alias("n_chars"))


QUERIES = {"progressive_lines": progressive_lines}
ORACLE_SQL = {"progressive_lines": "SELECT doc_id AS doc, k - 1 AS place, length(l[k]) AS n_chars FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"}
