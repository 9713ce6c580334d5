"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A shard is a run of frames: length (unsigned 64-bit), masked CRC-32C of these 8 bytes, payload, masked CRC-32C of the
payload, all little-endian. A payload holds the doc_id, a width and the ids, in 16 bits each where the vocabulary
allows. Beside each shard, its index has 20 bytes a record: doc_id, offset and length of the frame.

Documents are dealt to shards by ranges of doc_id, and of a hash of the text where very many share an id, and stand in
ascending order in each, so shard by shard the ids are in order over all documents. A shard is written under a name of the attempt's own and then renamed, so a task that
runs again after a lost executor replaces it whole.

Null and empty texts give a sequence of the end id alone. A null doc_id sorts first and is read back as null. Of
repeated ids the order is by a hash of the text, then by text. An empty table gives no shards. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from engramlake.session import new_folder, partitions, stage

SHARDS = "shard int, path string, index_path string, n_records long, n_ids long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
#: Castagnoli's polynomial, reflected; the mask's constant (fixed values of the format).
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LANE = 64  # 32-bit words
HEAD = "<qBBI"  # doc_id, whether it is null, bytes of an id, number of ids
ENTRY = "<qQI"


@lru_cache(maxsize=1)
def _tables():
    """Steps of the register over 4 bytes by halves of the register, and over a lane of zeros."""
    import numpy as np

    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    by = [one]
    for _ in range(3):
        by.append((by[-1] >> 8) ^ one[by[-1] & 255])
    half = np.arange(65536)
    low, high = by[3][half & 255] ^ by[2][half >> 8], by[1][half & 255] ^ by[0][half >> 8]
    far = []
    for start in (half.astype(np.uint32), half.astype(np.uint32) << np.uint32(16)):
        for _ in range(LANE):
            start = low[start & 0xFFFF] ^ high[start >> 16]
        far.append(start)
    return low, high, *far


def crc32c(buffers: list[bytes]):
    """CRC-32C of each buffer of 4 bytes or more, many at a time: buffers are cut into lanes that advance together."""
    import numpy as np

    if not buffers:
        return np.zeros(0, np.uint32)
    low, high, far_low, far_high = _tables()
    sizes = np.array([len(b) for b in buffers])
    if sizes.min() < 4:
        raise ValueError("a buffer of 4 bytes at least is needed")
    lanes = -(-sizes // (4 * LANE))
    ends = np.cumsum(lanes)
    data = np.zeros(int(ends[-1]) * 4 * LANE, np.uint8)  # zeros before a buffer leave the register at zero
    for b, end, n in zip(buffers, ends * 4 * LANE, sizes):
        data[end - n : end] = np.frombuffer(b, np.uint8)
        data[end - n : end - n + 4] ^= 255  # the register begins with ones
    words = np.ascontiguousarray(data.view("<u4").reshape(-1, LANE).T)
    crc = np.zeros(words.shape[1], np.uint32)
    for w in words:
        crc ^= w
        crc = low[crc & 0xFFFF] ^ high[crc >> 16]
    order = np.argsort(-lanes, kind="stable")
    first, lanes = (ends - lanes)[order], lanes[order]
    out = np.zeros(len(buffers), np.uint32)
    for k in range(int(lanes[0])):
        n = int(np.searchsorted(-lanes, -k, side="left"))  # those of more than k lanes
        out[:n] = far_low[out[:n] & 0xFFFF] ^ far_high[out[:n] >> 16] ^ crc[first[:n] + k]
    back = np.empty_like(out)
    back[order] = out ^ 0xFFFFFFFF
    return back


def crc32c_lengths(lengths):
    """CRC-32C of each length as 8 bytes."""
    import numpy as np

    low, high, *_ = _tables()
    words = np.asarray(lengths, "<u8").view("<u4").reshape(-1, 2)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(2):
        crc ^= words[:, k]
        crc = low[crc & 0xFFFF] ^ high[crc >> 16]
    return crc ^ 0xFFFFFFFF


def masked(crc):
    """Turned by 15 bits and moved by a constant, so that a checksum of checksums is no weaker."""
    import numpy as np

    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    sizes = [len(p) for p in payloads]
    heads, tails = masked(crc32c_lengths(sizes)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [struct.pack("<QI", n, h) + p + struct.pack("<I", t) for n, h, p, t in zip(sizes, heads.tolist(), payloads, tails.tolist())]


def payload(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    """ids: as unsigned 32-bit integers; narrow: they fit 16 bits."""
    import numpy as np

    n = len(ids) // 4
    return struct.pack(HEAD, doc_id or 0, doc_id is None, 2 if narrow else 4, n) + (np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)


def opened(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id, ids as unsigned 32-bit integers."""
    import numpy as np

    doc_id, null, width, n = struct.unpack_from(HEAD, payload)
    body = payload[struct.calcsize(HEAD) :]
    if len(body) != n * width:
        raise ValueError("a record's length and its number of ids differ")
    return None if null else doc_id, np.frombuffer(body, "<u2").astype("<u4").tobytes() if width == 2 else body


def file_system(uri: str):
    """The file system of a folder of the shared store, and the path in it; also for other stores than local ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def read_frames(stream, at_once: int = 4 << 20) -> Iterator[list[bytes]]:
    """Payloads in lists of about at_once bytes; both checksums of each frame are verified."""
    import numpy as np

    def verified(sizes, heads, payloads, tails):
        if (masked(crc32c_lengths(sizes)) != np.array(heads, np.uint32)).any() or (masked(crc32c(payloads)) != np.array(tails, np.uint32)).any():
            raise ValueError("a record's checksum is wrong")
        return payloads

    held: tuple[list, list, list, list] = ([], [], [], [])
    while head := stream.read(12):
        size, crc = struct.unpack("<QI", head)
        if not held[0] and (masked(crc32c_lengths([size])) != crc).any():
            raise ValueError("a record's checksum is wrong")
        body = stream.read(size + 4)
        if len(body) != size + 4:
            raise ValueError("a shard ends within a record")
        for part, x in zip(held, (size, crc, body[:-4], struct.unpack("<I", body[-4:])[0])):
            part.append(x)
        if sum(held[0][-1:]) and sum(held[0]) >= at_once:
            yield verified(*held)
            held = ([], [], [], [])
    if held[0]:
        yield verified(*held)


def write(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the shards and return their list (SHARDS), one row for each."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def shard(batches: Iterable) -> Iterator:
        import os

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from engramlake.llm.tokens import word_ids

        words, end = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()
        narrow = words.tokenizer.get_vocab_size() <= 65536 and end_id < 65536
        store, path = file_system(folder)
        no, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        at = n_records = n_ids = 0
        out = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, index = (store.open_output_stream(f"{path}/.{own}.{x}") for x in ("records", "index"))
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = part.column(0).to_pylist()
                payloads = [payload(i, words.encode(t) + end, narrow) for i, t in zip(ids, part.column(1).to_pylist())]
                for i, p, f in zip(ids, payloads, frames(payloads)):
                    out.write(f)
                    index.write(struct.pack(ENTRY, i or 0, at, len(f)))
                    at += len(f)
                    n_ids += struct.unpack_from(HEAD, p)[3]
                n_records += len(ids)
        if out is None:
            return
        names = []
        for x, s in (("records", out), ("index", index)):
            s.close()
            names.append(f"shard-{no:05d}.{x}")
            store.move(f"{path}/.{own}.{x}", f"{path}/{names[-1]}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([no], pa.int32()), "path": [f"{folder}/{names[0]}"], "index_path": [f"{folder}/{names[1]}"], "n_records": [n_records], "n_ids": [n_ids]})

    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order, "text")
    return stage(dealt.mapInArrow(shard, SHARDS), "record-shards")


def read(shards: DataFrame) -> DataFrame:
    """RECORDS from the files of write(): start is the number of ids in all documents before."""
    spark = shards.sparkSession
    base, starts = 0, {}
    for r in sorted(shards.select("shard", "n_ids").collect()):  # one row for each shard
        starts[r.shard], base = base, base + r.n_ids

    def records(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for no, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = file_system(uri)
                start = starts[no]
                with store.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for payloads in read_frames(stream):
                        docs, ids = zip(*map(opened, payloads))
                        n = np.array([len(x) // 4 for x in ids], np.int64)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(docs, pa.int64()), "start": start + np.cumsum(n) - n, "n_tokens": n,
                                "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64()), "shard": np.full(len(n), no, np.int32),
                            }
                        )
                        start += int(n.sum())

    return shards.select("shard", "path").repartition(max(partitions(spark), len(starts))).mapInArrow(records, RECORDS)


def read_at(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted doc_ids (column doc_id), by the offset indexes alone: for reads in any order."""

    def entries(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for uri, index in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                store, path = file_system(index)
                with store.open_input_stream(path) as s:
                    x = np.frombuffer(s.read(), np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("size", "<u4")]))
                yield pa.RecordBatch.from_pydict({"doc_id": x["doc_id"], "path": [uri] * len(x), "at": x["at"].astype(np.int64), "size": x["size"].astype(np.int64)})

    def fetch(batches: Iterable) -> Iterator:
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            docs, ids = [], []
            for uri, at, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                store, path = file_system(uri)
                with store.open_input_file(path) as f:
                    doc, found = opened(next(read_frames(io.BytesIO(f.read_at(size, at))))[0])
                docs.append(doc)
                ids.append(np.frombuffer(found, "<u4").astype(np.int64).tolist())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    index = shards.select("path", "index_path").mapInArrow(entries, "doc_id long, path string, at long, size long")
    return index.join(wanted.select("doc_id").distinct(), "doc_id").select("path", "at", "size").mapInArrow(fetch, "doc_id long, ids array<long>")
