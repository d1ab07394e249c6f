"""Deterministic sharded WARC archives.

Records are range-sorted by page id, then by the SHA-1 of the payload, so that rows of one id can fall into several
ranges; each range is one shard, whose files roll over when their compressed size reaches a bound. The cuts between
shards follow from the rows alone: they are quantiles of the keys whose hashes lie below a bound, and as many as the
payloads' bytes ask for. Headers and digests are made anew from the payload. So equal tables give equal bytes, however they are
partitioned. Tasks write under temporary names; the manifest, a table that Spark commits with exactly one attempt of each
task, names what counts; its files then get their final names, and other attempts' files are deleted. A run that dies
before leaves temporary files only, and publishing may be repeated.

Of records with equal payloads of at least REVISIT_BYTES, that with the largest page id is the response and others
revisit it. Defined cases: a null html is an empty payload; a null url an empty target; pages without an id sort first
and never are responses that others refer to unless all equal ones lack ids; rows that repeat the response's id are
responses too; rows of one id are ordered by payload digest, then url; rows equal in id and payload are one shard's; an
empty table gives an empty manifest; a very long payload takes memory for itself alone; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import file_system, forget, new_folder, written

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
#: Payload bytes of a shard: as many as give MANY shards, but within these bounds.
SHARD_BYTES, MANY = (2 << 20, 1 << 30), 1024
#: Keys sampled for each cut, about: those whose hashes lie below a bound.
SAMPLED = 20
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, number int, name string, temporary string, n_records long, n_bytes long, sha256 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record's bytes, uncompressed. A revisit has the length and digest of the payload, not the payload."""
    whole = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = whole if refers_to is not None else whole + payload
    digest = lambda b: "sha1:" + b32encode(b).decode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", digest(bytes.fromhex(sha1))),
        ("WARC-Block-Digest", digest(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers[4:4] = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time of its own."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(f: io.RawIOBase, size: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed members of a file one by one: memory is bounded by the largest record."""
    d, out = zlib.decompressobj(31), []
    while chunk := f.read(size):
        while chunk:
            out.append(d.decompress(chunk))
            chunk = d.unused_data
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("truncated archive")


def cuts_of(keys: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 keys (id, key2) that divide the distinct ones of the table into like parts. The driver gets about
    SAMPLED * n keys: their number is counted, or estimated alike whatever the partitions, and that share of hashes is kept."""
    if n == 1:
        return (np.zeros(0, np.int64),) * 2
    at = F.xxhash64("id", "key2")
    total = keys.agg(F.approx_count_distinct(at, 0.02)).first()[0]
    if (share := SAMPLED * n / max(1, total)) < 1:
        keys = keys.filter(at < int(share * (1 << 64)) - (1 << 63))
    rows = sorted((r["id"], r["key2"]) for r in keys.distinct().collect())
    chosen = sorted({rows[len(rows) * i // n] for i in range(1, n)}) if rows else []
    return tuple(np.array(x, np.int64) for x in zip(*chosen, strict=True)) if chosen else (np.zeros(0, np.int64),) * 2


def places(cuts: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The number of cuts at or before each (id, key)."""
    first, last = (np.searchsorted(cuts[0], ids, side) for side in ("left", "right"))
    out = first.copy()
    tied = np.flatnonzero(first < last)  # their id is that of cuts
    for a, b in {(int(a), int(b)) for a, b in zip(first[tied], last[tied], strict=True)}:
        own = tied[first[tied] == a]
        out[own] = a + np.searchsorted(cuts[1][a:b], keys[own], "right")
    return out


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives in the folder; returns their manifest, MANIFEST, which is also written beside them."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    every = written(rows.select("id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("n")), "digests")
    key2 = lambda sha1: F.conv(F.hex(F.substring(sha1, 1, 7)), 16, 10).cast("long")
    total = every.agg(F.sum("n")).first()[0] or 0
    small, large = SHARD_BYTES
    shards = max(1, min(-(-total // small), max(MANY, -(-total // large))))
    none = -(1 << 63)  # the place of rows without an id
    cuts = cuts_of(every.select(F.coalesce("id", F.lit(none)).alias("id"), key2("sha1").alias("key2")), shards)
    digests = every.filter(F.col("n") >= revisit_bytes).select("id", "sha1")

    @F.pandas_udf("int")
    def shard(id_, key):
        import pandas as pd

        return pd.Series(places(cuts, id_.to_numpy(np.int64), key.to_numpy(np.int64)), dtype="int32")

    shared = digests.groupBy("sha1").agg(F.max("id").alias("to"), F.count("*").alias("n")).filter("n > 1 and to is not null").select("sha1", "to")
    # instructions travel with the pages to their place in the order: the pages themselves are shuffled once
    turned = digests.join(shared, "sha1").filter("id is null or id != to").select("id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("sha1").alias("payload"), "to").distinct()
    both = turned.unionByName(rows.select("id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("to")))
    both = both.withColumn("key2", key2(F.when(F.col("kind") == 0, F.col("payload")).otherwise(F.unhex(F.sha1("payload")))))
    dealt = both.withColumn("shard", shard(F.coalesce("id", F.lit(none)), "key2")).repartitionById(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "key2", "kind", F.col("url").asc_nulls_first(), "payload").select("id", "kind", "url", "payload", "to", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        shard, number, attempt = -1, 0, uuid.uuid4().hex
        out, state, current, to, fed = None, None, (), {}, False

        def closed() -> pa.RecordBatch:
            out.close()
            row = {"shard": shard, "number": number, "name": f"{shard:06d}-{number:05d}.warc.gz", "temporary": f"_{shard:06d}-{number:05d}.{attempt}.tmp", **state, "sha256": state["sha256"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], MANIFEST_ARROW)

        for b in batches:
            for page, kind, url, payload, target, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != shard:
                    if out is not None:
                        yield closed()
                    out, shard, number = None, own, 0
                if (page,) != current or fed and not kind:  # what the next payload's rows are told
                    current, to = (page,), {}
                fed = bool(kind)
                if not kind:
                    to[payload] = target
                    continue
                sha1 = hashlib.sha1(payload)
                refers = to.get(sha1.digest()) if to else None
                data = _member(record(page, url, payload, sha1.hexdigest(), refers))
                if out is not None and state["n_bytes"] + len(data) > file_bytes:
                    yield closed()
                    out, number = None, number + 1
                if out is None:
                    out = files.open_output_stream(f"{base}/_{shard:06d}-{number:05d}.{attempt}.tmp", compression=None)
                    state = {"n_records": 0, "n_bytes": 0, "sha256": hashlib.sha256(), "first_id": page, "last_id": page}
                out.write(data)
                state["sha256"].update(data)
                state |= {"n_records": state["n_records"] + 1, "n_bytes": state["n_bytes"] + len(data), "last_id": page}
        if out is not None:
            yield closed()

    manifest = written(dealt.mapInArrow(run, MANIFEST), "manifest")
    publish(manifest, folder)
    forget(every)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return manifest


MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def publish(manifest: DataFrame, folder: str) -> None:
    """Give the files of the manifest their final names; those that have them already stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        files, base = file_system(folder)
        for b in batches:
            for name, temporary in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                there, final = files.get_file_info([f"{base}/{temporary}", f"{base}/{name}"])
                if there.type != FileType.NotFound:
                    files.move(f"{base}/{temporary}", f"{base}/{name}")
                elif final.type == FileType.NotFound:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield b

    manifest.select("name", "temporary").mapInArrow(run, "name string, temporary string").agg(F.count("*")).first()
    from pyarrow.fs import FileSelector

    files, base = file_system(folder)
    for f in files.get_file_info(FileSelector(base, allow_not_found=True)):  # of attempts that the manifest doesn't name
        if f.base_name.startswith("_") and f.base_name.endswith(".tmp"):
            files.delete_file(f.path)


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of the archives. Digests are checked: a response's payload against its digest, each block against its own."""
    schema = RECORDS if with_payload else RECORDS.replace("payload binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def number(urn: str) -> int | None:
        return int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from base64 import b32decode

        files, base = file_system(folder)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in members(f):
                        at = raw.index(b"\r\n\r\n")
                        h = dict(line.split(": ", 1) for line in raw[len(VERSION) : at].decode().split("\r\n"))
                        block = raw[at + 4 : at + 4 + int(h["Content-Length"])]
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        response = h["WARC-Type"] == "response"
                        if response and hashlib.sha1(payload).hexdigest() != digest or "sha1:" + b32encode(hashlib.sha1(block).digest()).decode() != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a digest does not fit its record {h['WARC-Record-ID']}")
                        size = int(head.rpartition(b": ")[2])
                        refers = None if response else number(h["WARC-Refers-To"])
                        rows.append({"page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload": payload if response else None, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": refers})
                        held += len(payload) if with_payload else 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("name").repartition(max(1, min(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1000)), "name").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """What is read back of the archives of all pages."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
