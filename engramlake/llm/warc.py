"""WARC archives: written as monolithic gzip streams, normalised to one gzip member a record with an offset index.

Some writers compress a whole archive as one gzip stream, of which no record can be read without all before it. The
normaliser inflates such a stream once, from start to end in pieces of bounded size, and writes each record as a member
of its own into a new archive, with a sidecar index: offset, length, page_id and type of each record. Readers then seek.

Payloads that are equal and have MIN_REVISIT bytes at least are written once, as the response of the least page_id; the
others are revisit records that name it. Roles are decided from digests alone (grouped with partial counts, so a large
group of copies moves one row a task), and the revisits of each partition of the pages are put in a table of its own,
by their place in it. The task that writes a partition's archive reads that table, so no html is shuffled; it fails
where a digest isn't that of the row in this place, should a partition ever be cut otherwise.

Archives are written under names of the attempt's own and then renamed, so a task that runs again replaces its file
whole. A monolithic archive goes as soon as its normalised form is in place; a task that runs again and finds only that
form takes it as it stands.

Null and empty html is an empty payload. A null url or page_id is left out of the record and read back as null.
Repeated rows with the least id of their payload are responses all. An empty table gives no archives and no rows.
Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from engramlake.llm.records import file_system
from engramlake.session import new_folder, partitions, release, stage

MIN_REVISIT = 100  # bytes
LEVEL = 1  # of compression
PIECE = 1 << 20
#: offset, length, page_id, whether it has one, whether it is a revisit
ENTRY = "<QQq??"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # of capture; the tables have none


# --- records -----------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response, or where refers_to is given a revisit."""
    revisit = refers_to is not None
    block = HTTP + (b"" if revisit else payload)
    heads = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        heads.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        heads.append(("X-Page-ID", str(page_id)))
    if revisit:
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) from a stream's pieces, holding one record and one piece at most."""
    held = bytearray()
    source = iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record's head")
                return
        found = headers(bytes(held[:end]))
        size = end + 4 + int(found["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("an archive ends within a record")
        yield found, bytes(held[:size])
        del held[:size]


def inflated(stream) -> Iterator[bytes]:
    """A gzip stream's content in pieces, through all of its members."""
    inflate, fed = zlib.decompressobj(31), False
    while data := stream.read(PIECE):
        while data:
            out = inflate.decompress(data, PIECE)
            if out:
                yield out
            fed = not inflate.eof
            if fed:
                data = inflate.unconsumed_tail
            else:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    if fed:
        yield inflate.flush()
        if not inflate.eof:
            raise ValueError("a gzip stream ends early")


def normalise(stream, out, index) -> int:
    """Write a monolithic archive's records as members to out and their entries to index; gives their number."""
    at = n = 0
    for found, whole in split_records(inflated(stream)):
        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = c.compress(whole) + c.flush()
        out.write(member)
        index.write(struct.pack(ENTRY, at, len(member), int(found.get("x-page-id", 0)), "x-page-id" in found, found["warc-type"] == "revisit"))
        at += len(member)
        n += 1
    return n


def opened(member: bytes) -> tuple:
    """RECORDS' values of one member; a response's length and digest are those of what is there."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    found = headers(head)
    block = rest[: int(found["content-length"])]
    number = lambda k: int(found[k]) if k in found else None
    digest, size = found["warc-payload-digest"].removeprefix("sha256:"), number("x-payload-length")
    if found["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"the payload of page {found.get('x-page-id')} isn't what was written")
    return number("x-page-id"), size, digest, found["warc-type"], number("x-refers-to-page-id")


# --- archives ----------------------------------------------------------------------------------------------------


def _placed(pages: DataFrame) -> DataFrame:
    """(part, at, page_id, digest, size): partition and place in it of every page, and its payload's SHA-256 and length."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                own = batch.slice(low, 256)
                payloads = [(t or "").encode() for t in own.column(2).to_pylist()]
                n = len(payloads)
                columns = [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), own.column(0), pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()), pa.array(map(len, payloads), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "at", "page_id", "digest", "size"])
                at += n

    return pages.mapInArrow(run, "part int, at long, page_id long, digest binary, size long")


def write_revisits(pages: DataFrame, folder: str) -> None:
    """Tables (at, digest, refers_to) in folder/part=N of the pages of partition N that are revisits."""
    d = stage(_placed(pages), "payloads")
    least = d.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = d.join(least, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    again.select("part", "at", "digest", "refers_to").repartition(partitions(pages.sparkSession), "part").sortWithinPartitions("part", "at").write.partitionBy("part").parquet(folder)
    release(d)


def _revisits(folder: str, part: int) -> dict[int, tuple[bytes, int]]:
    import pyarrow.parquet as pq

    store, path = file_system(f"{folder}/part={part}")
    if store.get_file_info(path).type.name == "NotFound":
        return {}
    from pyarrow.fs import FileSelector

    found: dict[int, tuple[bytes, int]] = {}
    for f in store.get_file_info(FileSelector(path)):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as s:
                t = pq.ParquetFile(s).read(columns=["at", "digest", "refers_to"])
            found.update(zip(t["at"].to_pylist(), zip(t["digest"].to_pylist(), t["refers_to"].to_pylist())))
    return found


def _attempt(store, path: str, name: str):
    own = f"{path}/.{uuid.uuid4().hex}.{name}"
    return own, store.open_output_stream(own, compression=None)


def write_monolithic(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One gzip stream a partition; gives their list (path)."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    roles = new_folder(pages.sparkSession, "revisits")
    write_revisits(rows, roles)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, path = file_system(folder)
        part, at = TaskContext.get().partitionId(), 0
        again, out, own = _revisits(roles, part), None, None
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for page_id, url, text in zip(*(c.to_pylist() for c in batch.slice(low, 256).columns)):
                    if out is None:
                        own, out = _attempt(store, path, "mono")
                    payload = (text or "").encode()
                    digest = hashlib.sha256(payload)
                    known, refers_to = again.pop(at, (None, None))
                    if known not in (None, digest.digest()):
                        raise ValueError(f"row {at} of partition {part} isn't the one that was read before")
                    out.write(pack.compress(record(page_id, url, payload, len(payload), digest.hexdigest(), refers_to)))
                    at += 1
        if again:
            raise ValueError(f"partition {part} has lost rows since it was read before")
        if out is not None:
            out.write(pack.flush())
            out.close()
            name = f"mono-{part:05d}.warc.gz"
            store.move(own, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return stage(rows.mapInArrow(run, "path string"), "warc-monolithic")


def normalise_all(archives: DataFrame, keep: bool = False) -> DataFrame:
    """(path, index_path, n_records) of the normalised forms of archives (path); each monolithic one goes when its members
    and their index are in place, unless kept."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = file_system(uri)
                folder, _, name = path.rpartition("/")
                new = [f"members-{name}", f"{name.removesuffix('.warc.gz')}.index"]
                if store.get_file_info(path).type.name == "NotFound":  # an earlier attempt was through with it
                    n = store.get_file_info(f"{folder}/{new[1]}").size // struct.calcsize(ENTRY)
                else:
                    (a, out), (b, index) = (_attempt(store, folder, x) for x in ("members", "index"))
                    with store.open_input_stream(path, compression=None) as stream:
                        n = normalise(stream, out, index)
                    for own, s, to in ((a, out, new[0]), (b, index, new[1])):
                        s.close()
                        store.move(own, f"{folder}/{to}")
                    if not keep:
                        store.delete_file(path)
                at = uri.rpartition("/")[0]
                yield pa.RecordBatch.from_pydict({"path": [f"{at}/{new[0]}"], "index_path": [f"{at}/{new[1]}"], "n_records": pa.array([n], pa.int64())})

    spark = archives.sparkSession
    # Tasks of even work: archives, which are about as large as the partitions they were written from, one by one.
    return stage(archives.select("path").repartition(max(1, partitions(spark))).mapInArrow(run, "path string, index_path string, n_records long"), "warc-members")


def read(archives: DataFrame) -> DataFrame:
    """RECORDS of normalised archives (path, index_path), each record by its index entry."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uri, index in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                store, at = file_system(index)
                with store.open_input_stream(at) as s:
                    entries = list(struct.iter_unpack(ENTRY, s.read()))
                store, path = file_system(uri)
                with store.open_input_file(path) as f:
                    for low in range(0, len(entries), 500):
                        own = entries[low : low + 500]
                        f.seek(own[0][0])
                        rows = [opened(f.read(e[1])) for e in own]  # they stand one after the other
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spark = archives.sparkSession
    return archives.select("path", "index_path").repartition(max(1, partitions(spark))).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read them back."""
    return read(normalise_all(write_monolithic(pages)))


ORACLE = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
g as (select *, case when payload_bytes >= {MIN_REVISIT} then min(page_id) over (partition by payload_digest) else page_id end as least from d)
select page_id, payload_bytes, payload_digest, case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id <> least then least end as refers_to from g"""
