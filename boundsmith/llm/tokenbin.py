"""Token ids as length-delimited binary records, with an offset index.

A shard file is a run of records, each framed as

    uint64 length | uint32 masked CRC of the length | payload | uint32 masked CRC of the payload

(little-endian).  The payload is a flag byte (1: the id is null), the document id
as int64, the bytes per token (2 where every id fits, else 4) and the ids.
Beside each shard an index file holds offset and size of every record as two
uint64, so that a shuffled reader can seek to any record.  The checksum is
CRC-32, masked by rotation and a constant, so that a CRC of data that holds
CRCs stays sound.

Defined cases: a null or empty text is the end id alone; a null document id
comes first; rows that repeat are written each, equal ids in the order of their
texts; columns of other names don't matter; an empty table gives shards without
records.

Scale: rows are range-partitioned by id (and a hash of the text, which splits a
hot id), each task writes one shard of its own under a name that holds the task
attempt, and only the names that successful tasks report are read; a retried task
never touches another attempt's file.  The driver holds one line per shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundsmith.llm.common import mapped, new_path
from boundsmith.llm.tokens import encoder

_MASK = 0xA282EAD8  # fixed value of the masked-checksum format
_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<BqB")
_TAIL = struct.Struct("<I")
_FLUSH = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + _TAIL.pack(masked(size)) + payload + _TAIL.pack(masked(payload))


def unframe(data: memoryview | bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place of the next one."""
    length, crc = _HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError(f"record length at {at} fails its checksum")
    start = at + _HEAD.size
    payload = bytes(data[start : start + length])
    if len(payload) != length or masked(payload) != _TAIL.unpack_from(data, start + length)[0]:
        raise ValueError(f"record at {at} fails its checksum")
    return payload, start + length + _TAIL.size


def to_payload(doc_id: int | None, ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    return _DOC.pack(doc_id is None, doc_id or 0, 2 if narrow else 4) + (wide.astype("<u2").tobytes() if narrow else ids)


def from_payload(payload: bytes) -> tuple[int | None, bytes]:
    null, doc_id, width = _DOC.unpack_from(payload)
    body = payload[_DOC.size :]
    return None if null else doc_id, np.frombuffer(body, "<u2").astype("<u4").tobytes() if width == 2 else body


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> list[tuple[str, int, int]]:
    """Write all documents in ascending id order.

    Returns ``(shard uri, documents, ids)`` for each shard, in order.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(shards, "i", F.xxhash64("t")).sortWithinPartitions("i", F.xxhash64("t"), "t")
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        fs, at = _open(name)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        n_docs = n_ids = offset = 0
        with fs.open_output_stream(at + ".bin") as data, fs.open_output_stream(at + ".idx") as index:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                part: list[bytes] = []
                size = 0
                for doc_id, tokens in zip(ids, encoder(tokenizer).encode(batch.column(1)), strict=True):
                    record = frame(to_payload(doc_id, tokens + end))
                    index.write(struct.pack("<QQ", offset, len(record)))
                    part.append(record)
                    offset += len(record)
                    size += len(record)
                    n_docs += 1
                    n_ids += len(tokens) // 4 + 1
                    if size >= _FLUSH:
                        data.write(b"".join(part))
                        part, size = [], 0
                data.write(b"".join(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()]), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], names=["p", "name", "docs", "ids"]
        )

    done = mapped(ordered, write, "p long, name string, docs long, ids long").collect()
    return [(r.name, r.docs, r.ids) for r in sorted(done, key=lambda r: r.p)]


def read_shard(uri: str, block: int = 8 << 20) -> Iterator[tuple[int | None, bytes]]:
    """Id and token ids of every record of a shard, by its index."""
    fs, at = _open(uri)
    with fs.open_input_file(at + ".bin") as data, fs.open_input_stream(at + ".idx") as index:
        while entries := index.read(16 * 4096):
            places = np.frombuffer(entries, "<u8").reshape(-1, 2)
            k = 0
            while k < len(places):
                first = int(places[k, 0])
                last = k
                while last + 1 < len(places) and int(places[last + 1].sum()) - first <= block:
                    last += 1
                data.seek(first)
                held = data.read(int(places[last].sum()) - first)
                for offset, _ in places[k : last + 1].tolist():
                    yield from_payload(unframe(held, offset - first)[0])
                k = last + 1


def read_records(spark: SparkSession, shards: list[tuple[str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids`` of every record, read from the files.

    ``start`` counts the ids of all documents before; ``ids`` holds little-endian
    unsigned 32-bit integers.
    """
    starts, total = [], 0
    for _, _, n in shards:
        starts.append(total)
        total += n
    known = spark.sparkContext.broadcast([(s[0], at) for s, at in zip(shards, starts, strict=True)])
    names = [id_col, "start", "n_tokens", "ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                uri, start = known.value[k]
                rows: list[tuple] = []
                size = 0
                for doc_id, ids in read_shard(uri):
                    rows.append((doc_id, start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size >= _FLUSH:
                        yield as_batch(rows)
                        rows, size = [], 0
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    n = max(1, len(shards))
    return mapped(spark.range(0, len(shards), 1, n), read, f"`{id_col}` long, start long, n_tokens long, ids binary")
