"""Token ids in files: canonical, length-limited Huffman codes, decoded by table in independent blocks.

A folder holds two Parquet tables.

* ``codebook``: id, count and bits. Code lengths come from the counts over all documents by package-merge,
  at most ``limit`` bits; the codes follow from the lengths alone (canonical: shorter first, then by id).
* ``blocks``: first (number of ids before the block, over all documents), n, bits (the codes one after
  another, most significant bit first), marks (the bits of every ``STEP`` ids as little-endian 16-bit
  numbers: their running sum gives the bit offsets of the checkpoints), crc32 (of the ids as
  little-endian 32-bit numbers) and docs (id, start and n_tokens of each document with ids in the block).

A block needs no other one. Its checkpoints are decoded side by side: one look-up in a table of 2^limit
entries gives an id and its length for all of them. Documents are sorted by id over the whole cluster,
and ``first`` counts along that order, so blocks in the order of ``first`` are the ids of all documents in
ascending order of doc_id.

Texts are sorted by range, encoded once and kept as raw blocks in a written table; counts, codes and the
files come from that. What reaches the driver is one row a partition and one an id of the vocabulary.
Only documents that cross a block's end are brought together to read them, each by its start, which is unique.

Null texts are empty: the end id alone. Null ids come first; equal ids are ordered by a hash of the text, and
repeated rows are documents each for themselves. An empty table gives empty files. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.chat import vocabulary
from paperloom.llm.common import parts, persisted
from paperloom.llm.packing import _U4, _byte_letters

END_ID = 0
LIMIT, BLOCK, STEP = 16, 32768, 128
#: Entries in a Python worker's cache of ids; when it is full, the half not asked for lately goes.
CACHE = 1_000_000
#: Blocks decoded side by side.
_TOGETHER = 8
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocab: str):
    """text -> ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own."""
    return _encoders(vocab)[0]


@lru_cache(2)
def _encoders(vocab: str):
    """(encode, known): of whole texts, and of runs where these can be looked up, else none.

    The byte-level splitter never joins a word to the white space behind it, so runs between white space,
    with one space before them, are encoded once and remembered, and so are the words inside. Texts with
    characters whose class the two languages might see differently, or with what may be a special token, go
    through the tokenizer whole; so do all texts if the tokenizer has other parts.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_str(vocab)

    def encode_whole(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    said = json.loads(vocab)
    split = said.get("pre_tokenizer") or {}
    if said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or not all(t["content"].startswith("<|") for t in said.get("added_tokens", [])):
        return encode_whole, None
    words_of, runs_of = regex.compile(_SPLIT).findall, re.compile(r" ?\S+|\s+(?!\S)|\s").findall
    odd = re.compile("[^\x00-\x1b\x20-ɏ]|<\\|").search
    letters = _byte_letters()
    spelled, tokenize = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}, whole.model.tokenize

    def word_ids(word: str) -> bytes:
        return array(_U4, [t.id for t in tokenize(word.translate(spelled))]).tobytes()

    class Known(dict):
        """Ids of runs and of words: those asked for lately, and those before."""

        before: dict[str, bytes] = {}

        def __missing__(self, run: str) -> bytes:
            ids = self.before.get(run)
            if ids is not None:
                pass
            elif run.lstrip(" ").isalpha():
                ids = word_ids(run)
            elif run[-1] in ".,!" and run[:-1].lstrip(" ").isalpha():
                ids = self[run[:-1]] + marks[run[-1]]
            else:
                words = words_of(run)
                ids = b"".join([self[w] for w in words]) if len(words) > 1 else word_ids(run)
            if len(self) >= CACHE // 2:
                self.before = dict(self)
                self.clear()
            if len(run) <= 64:
                self[run] = ids
            return ids

    known, marks = Known(), {c: word_ids(c) for c in ".,!"}

    def encode(text: str) -> bytes:
        return encode_whole(text) if odd(text) else b"".join(map(known.__getitem__, runs_of(text)))

    return encode, known


#: 1 for ASCII letters, 2 for digits, 3 for other marks than the apostrophe, else 0.
_KIND = np.array([0 if c > 126 or c < 33 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)


def _run_starts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the runs ``encoder`` looks up begin in texts that lie one after another, and the end of all; white space is ASCII.

    They are also cut between letters, digits and marks, where the splitter always cuts (not so at an apostrophe).
    """
    space = buf == 32
    white = space | ((buf >= 9) & (buf <= 13))
    inner = np.ones(len(buf) + 1, bool)
    inner[bounds] = False
    starts = ~inner
    to_white = white[1:] & ~white[:-1]
    to_dark = white[:-1] & ~white[1:] & inner[1:-1]
    starts[1:-1] |= to_white | (to_dark & ~space[:-1])
    kind = _KIND[buf]
    wide = np.flatnonzero(buf[:-1] == 0xC3)
    wide = wide[(buf[wide + 1] != 0x97) & (buf[wide + 1] != 0xB7)]  # U+00C0 to U+00FF are letters but for two
    kind[wide] = kind[wide + 1] = 1
    starts[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    starts[:-2] |= to_dark  # the last white character is no part of those before it
    return np.flatnonzero(starts)


def _odd_texts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts with white space outside ASCII, characters from U+0240 on or what may be a special token: places among ``bounds``."""
    a, b = buf[:-1], buf[1:]
    pairs = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == ord("<")) & (b == ord("|")))
    at = np.concatenate((np.flatnonzero((buf >= 0xC9) | ((buf >= 0x1C) & (buf <= 0x1F))), np.flatnonzero(pairs)))
    return np.unique(np.searchsorted(bounds, at, side="right") - 1)


def encode_texts(vocab: str, texts: pa.Array, together: int = 8_000_000) -> Iterator[bytes]:
    """What ``encoder`` gives for each text (null: empty). Of some ``together`` bytes of texts each different run is looked up once."""
    encode, known = _encoders(vocab)
    if known is None:
        yield from (encode(x or "") for x in texts.to_pylist())
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + together, side="right")) - 1)
        some, bounds = texts.slice(lo, hi - lo), offsets[lo : hi + 1] - offsets[lo]
        lo = hi
        if not bounds[-1]:
            yield from [b""] * len(some)
            continue
        buf = np.frombuffer(some.buffers()[2], np.uint8)[offsets[hi - len(some)] : offsets[hi]]
        odd = {i: encode(some[i].as_py()) for i in _odd_texts(buf, bounds).tolist()}
        if odd:
            some = pc.if_else(pa.array([i in odd for i in range(len(some))]), "", some)
            bounds = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            if bounds[0] == bounds[-1]:
                yield from (odd.get(i, b"") for i in range(len(some)))
                continue
            buf, bounds = np.frombuffer(some.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
        at = _run_starts(buf, bounds)
        runs = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf)]).dictionary_encode()
        found = [known[x] for x in runs.dictionary.to_numpy(zero_copy_only=False)]
        flat, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = runs.indices.to_numpy()
        n = sizes[each]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[each] - ends[:-1], n)].tobytes()
        cuts = (4 * ends[np.searchsorted(at, bounds)]).tolist()
        yield from (odd[i] if i in odd else ids[a:z] for i, (a, z) in enumerate(zip(cuts, cuts[1:])))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol, at most ``limit``, that make the total least: package-merge.

    Each level holds the symbols by weight, merged with pairs of the level before. Of the last level the
    first 2n - 2 entries are taken, of each level before it both halves of the pairs taken; a symbol's
    length is the number of levels that took it. Symbols stand in order, so a number a level says which.
    """
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    own = np.asarray(counts, np.int64)[order]
    merged, levels = own, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        bits[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return bits


class Code:
    """Canonical codes of ids with the given lengths, and the table that decodes them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, limit: int = LIMIT):
        rank = np.lexsort((ids, bits))
        ids, bits = ids[rank].astype(np.int64), bits[rank].astype(np.int64)
        span = 1 << (limit - bits)
        self.limit = limit
        self.code, self.bits = np.zeros(int(ids.max(initial=0)) + 1, np.uint64), np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        self.code[ids], self.bits[ids] = (np.cumsum(span) - span) >> (limit - bits), bits
        self.table_id, self.table_bits = np.zeros(1 << limit, "<u4"), np.ones(1 << limit, np.int64)
        self.table_id[: span.sum()], self.table_bits[: span.sum()] = np.repeat(ids, span), np.repeat(bits, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, marks) of a block."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        # A code lies in the 64 bits from its first bit's 32-bit word on; codes of one word are joined first.
        shifted = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        joined, place = np.bitwise_or.reduceat(shifted, first), word[first]
        out = np.zeros(int(place[-1]) + 2, np.uint32)
        out[place] |= (joined >> np.uint64(32)).astype(np.uint32)
        out[place + 1] |= joined.astype(np.uint32)
        steps = np.add.reduceat(bits, np.arange(0, len(ids), STEP))
        return out[: (int(ends[-1]) + 31) // 32].astype(">u4").tobytes(), steps.astype("<u2").tobytes()

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of several blocks (n, bits, marks), all their checkpoints side by side."""
        spare = bytes((STEP * self.limit // 32 + 2) * 4)
        words = np.frombuffer(b"".join([x for _, bits, _ in blocks for x in (bits, spare)]), ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, base = [], 0
        for _, bits, marks in blocks:
            steps = np.frombuffer(marks, "<u2").astype(np.int64)
            at.append(np.cumsum(steps) - steps + base * 8)
            base += len(bits) + len(spare)
        pos = np.concatenate(at)
        out = np.empty((len(pos), STEP), "<u4")
        down = np.uint64(64 - self.limit)
        last = (len(pairs) - 1) * 32  # a block's last checkpoint may run on past its ids
        for k in range(STEP):
            seen = (pairs[pos >> 5] << (pos & 31).astype(np.uint64)) >> down
            out[:, k] = self.table_id[seen]
            pos = np.minimum(pos + self.table_bits[seen], last)
        return [x.reshape(-1)[:n] for (n, _, _), x in zip(blocks, np.split(out, np.cumsum([len(a) for a in at])[:-1]))]


def _docs_type(ids: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("doc_id", ids), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def raw_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Ids in ascending order of the documents: part, first (within the part), n, ids and docs, written and read back."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(tokenizer))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    # The third key spreads one repeated row.
    ordered = given.repartitionByRange(parts(spark), *keys, F.spark_partition_id()).sortWithinPartitions(*keys)
    docs_type = _docs_type(given.schema["doc_id"].dataType)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("docs", docs_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        id_type = None
        held, first, inside, total = bytearray(), 0, [], 0

        def block(size: int) -> pa.RecordBatch:
            nonlocal first, inside
            ids = bytes(held[: size * 4])
            del held[: size * 4]
            where = pa.StructArray.from_arrays([pa.array([x[i] for x in inside], (id_type, pa.int64(), pa.int64())[i]) for i in range(3)], ["doc_id", "start", "n_tokens"])
            docs = pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), where)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.binary()), docs], ["part", "first", "n", "ids", "docs"])
            first += size
            inside = [x for x in inside if x[1] + x[2] > first]
            return out

        for b in batches:
            id_type = b.column(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_texts(vocab.value, b.column(1))):
                ids += end
                held += ids
                inside.append((doc_id, total, len(ids) // 4))
                total += len(ids) // 4
                while len(held) >= BLOCK * 4:
                    yield block(BLOCK)
        if held:
            yield block(len(held) // 4)

    return persisted(ordered.mapInArrow(run, schema), "token-blocks", compression="zstd")


def id_counts(raw: DataFrame) -> DataFrame:
    """How often each id occurs: (id, count). A task sends one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in b.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "count"])

    return raw.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, limit: int = LIMIT) -> None:
    """Encodes all documents into the folder ``path``."""
    spark = docs.sparkSession
    raw = raw_blocks(docs, id_col, text_col, tokenizer, end_id)
    counts = id_counts(raw).orderBy("id").collect()  # at most the vocabulary
    ids, n = np.array([r["id"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64)
    bits = code_lengths(n, limit)
    spark.createDataFrame([(*map(int, x), limit) for x in zip(ids, n, bits)], "id long, count long, bits int, limit int").coalesce(1).write.parquet(f"{path}/codebook")
    sizes = {r["part"]: r["n"] for r in raw.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a partition
    before = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[p] for p in sorted(sizes)]]).tolist()))
    code = spark.sparkContext.broadcast((ids, bits, before))
    schema = T.StructType([T.StructField(c, t) for c, t in (("first", T.LongType()), ("n", T.LongType()), ("bits", T.BinaryType()), ("marks", T.BinaryType()), ("crc32", T.LongType()), ("docs", raw.schema["docs"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits, before = code.value
        own = Code(ids, bits, limit)
        for b in batches:
            base = [before[p] for p in b.column("part").to_pylist()]
            coded = [own.encode(np.frombuffer(x.as_buffer(), "<u4")) for x in b.column("ids")]
            crcs = [zlib.crc32(x.as_buffer()) for x in b.column("ids")]
            docs = b.column("docs")
            flat = docs.flatten()
            lengths = docs.value_lengths().to_numpy()
            starts = pa.array(flat.field("start").to_numpy() + np.repeat(np.array(base, np.int64), lengths))
            moved = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.StructArray.from_arrays([flat.field("doc_id"), starts, flat.field("n_tokens")], ["doc_id", "start", "n_tokens"]))
            first = pa.array(b.column("first").to_numpy() + np.array(base, np.int64))
            yield pa.RecordBatch.from_arrays([first, b.column("n"), pa.array([x for x, _ in coded], pa.binary()), pa.array([x for _, x in coded], pa.binary()), pa.array(crcs, pa.int64()), moved], schema.names)

    raw.mapInArrow(run, schema).write.parquet(f"{path}/blocks", compression="none")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit bytes).

    Every block is checked against its CRC-32.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    blocks = spark.read.parquet(f"{path}/blocks")
    code = spark.sparkContext.broadcast((np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64), book[0]["limit"] if book else LIMIT))
    id_field = blocks.schema["docs"].dataType.elementType["doc_id"]
    schema = T.StructType([id_field, *[T.StructField(c, t) for c, t in (("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("at", T.LongType()), ("ids", T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(*code.value)
        for b in batches:
            for lo in range(0, len(b), _TOGETHER):
                some = b.slice(lo, _TOGETHER)
                decoded = own.decode(list(zip(some.column("n").to_pylist(), some.column("bits").to_pylist(), some.column("marks").to_pylist())))
                rows: list[tuple] = []
                docs = some.column("docs")
                flat, lengths = docs.flatten(), docs.value_lengths().to_pylist()
                starts, sizes, at = flat.field("start").to_pylist(), flat.field("n_tokens").to_pylist(), 0
                for ids, first, crc, n_docs in zip(decoded, some.column("first").to_pylist(), some.column("crc32").to_pylist(), lengths):
                    flow = ids.tobytes()
                    if zlib.crc32(flow) != crc:
                        raise ValueError(f"the block from id {first} on is damaged")
                    for start, n in zip(starts[at : at + n_docs], sizes[at : at + n_docs]):
                        a, z = max(start - first, 0), min(start + n - first, len(ids))
                        piece = flow[4 * a : 4 * z]
                        whole = z - a == n
                        rows.append((start, n, zlib.crc32(piece), first + a, piece if with_ids or not whole else None))
                    at += n_docs
                types = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([flat.field("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], schema.names)

    found = persisted(blocks.mapInArrow(run, schema), "token-pieces")
    inside = F.when(F.col("ids").isNull(), F.lit(True)).otherwise(F.length("ids") == F.col("n_tokens") * 4)
    cut = found.where(~inside).groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("pieces"))
    cut = cut.select("doc_id", "start", "n_tokens", F.reduce("pieces", F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids"))
    out = found.where(inside).select("doc_id", "start", "n_tokens", "ids_crc32", "ids").unionByName(cut.withColumn("ids_crc32", F.crc32("ids")))
    return out if with_ids else out.drop("ids")
