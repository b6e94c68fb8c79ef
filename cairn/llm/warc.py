"""WARC archives: one gzip member per record, and a sequential reader that trusts nothing.

Writing: payload digests are computed and grouped (only digests and ids are shuffled for that); the
least page id of equal payloads of at least ``least`` bytes is the response, others are revisits that
refer to it. Each task appends its records to archives of its own in the shared folder, under a name
that no other attempt has; only the names that successful tasks returned are read.

Reading: an archive is read in blocks. Each gzip member is decompressed incrementally, the record's
header is parsed as soon as it is whole, Content-Length frames the block, and SHA-256 digests of block
and payload are verified as the bytes pass. Memory holds one record at most. A damaged member, a wrong
length or a wrong digest raises ``WarcError`` with the archive and the offset. Afterwards ``verify``
holds each revisit's digest and length against the response that it refers to.

Records carry what WARC/1.1 asks for: a date, an identifier (a UUID of page id and payload digest, so
that a revisit can name its response), a target, and revisits the profile of equal payload digests.

Edge cases: null html is an empty payload; small payloads are all responses; a null id is written as
an empty field and read back as null; repeated ids are records of their own (a page never revisits its
own id), and share an identifier only if their payloads are the same too; a null or empty url has the
target ``urn:page:<id>``. Very long payloads are one record; an empty table has no archives; extra
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._shared import cut, local_path, scratch

LEAST, ROLL = 100, 1 << 30
_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def _identifier(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit has no block; its header has the payload's digest and length."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"" if refers_to is not None else payload
    page = "" if page_id is None else str(page_id)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _identifier(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n") or f"urn:page:{page}",
        "Content-Type": "text/html; charset=utf-8",
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
        "WARC-Payload-Digest": "sha256:" + digest,
        "Payload-Length": str(len(payload)),
        "Page-ID": page,
    }
    if refers_to is not None:
        head["WARC-Profile"] = PROFILE
        head["WARC-Refers-To"] = _identifier(refers_to, digest)
        head["Refers-To-Page-ID"] = str(refers_to)
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + _END) + z.flush()


def read(path: str, block: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload block) of each record in order."""
    with open(path, "rb") as f:
        data, offset = b"", 0
        while True:
            if not data:
                data = f.read(block)
                if not data:
                    return
            start, z = offset, zlib.decompressobj(31)
            out, head, need, sha, body = bytearray(), None, 0, hashlib.sha256(), []
            while not z.eof:
                if not data:
                    data = f.read(block)
                    if not data:
                        raise WarcError(f"{path}@{start}: the member is cut off")
                try:
                    out += z.decompress(data, block)
                except zlib.error as e:
                    raise WarcError(f"{path}@{start}: {e}") from None
                rest = z.unused_data if z.eof else z.unconsumed_tail
                offset += len(data) - len(rest)
                data = rest
                if head is None and (end := out.find(_END)) >= 0:
                    lines = out[:end].decode().split("\r\n")
                    if lines[0] != "WARC/1.1":
                        raise WarcError(f"{path}@{start}: {lines[0][:20]!r} begins the record")
                    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                    need = int(head["Content-Length"])
                    del out[: end + 4]
                if head is not None and need and out:
                    part = bytes(out[:need])
                    sha.update(part)
                    body.append(part)
                    need -= len(part)
                    del out[: len(part)]
            if head is None or need or bytes(out) != _END:
                raise WarcError(f"{path}@{start}: the block isn't as long as its header tells")
            whole = b"".join(body)
            if head["WARC-Block-Digest"] != "sha256:" + sha.hexdigest():
                raise WarcError(f"{path}@{start}: the block's digest differs")
            if head["WARC-Type"] == "response" and (head["WARC-Payload-Digest"] != "sha256:" + sha.hexdigest() or int(head["Payload-Length"]) != len(whole)):
                raise WarcError(f"{path}@{start}: the payload's digest or length differs")
            yield head, whole


def _write(batches, folder: str, roll: int):
    """Archives of this task; yields their paths."""
    name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{os.urandom(6).hex()}"
    f, count, paths = None, 0, []
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def close():
        f.flush()
        os.fsync(f.fileno())
        f.close()

    for b in batches:
        for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
            if f is None:
                paths.append(f"{name}-{len(paths):04d}.warc.gz")
                f, count = open(paths[-1], "wb"), 0
            data = record(page, url, html or b"", refers, date)
            f.write(data)
            count += len(data)
            if count >= roll:
                close()
                f = None
    if f is not None:
        close()
    if paths:
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes an archive record for each row; (path) of the archives."""
    ship(df.sparkSession)
    local = local_path(folder)
    os.makedirs(local, exist_ok=True)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("html"))
    digests = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest"))
    first = digests.groupBy("n", "digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    later = digests.join(first, ["n", "digest"]).where("page_id <> refers_to").groupBy("page_id", "n", "digest").agg(F.min("refers_to").alias("refers_to"))
    revisit = later.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "refers_to"))).alias("of"))
    joined = pages.join(revisit, "page_id", "left").select("page_id", "url", "html", F.when(F.col("of").isNotNull() & (F.octet_length("html") >= least), F.get(F.map_values(F.map_filter("of", lambda k, v: k == F.sha2("html", 256))), F.lit(0))).alias("refers_to"))
    return cut(joined.mapInArrow(partial(_write, folder=local, roll=roll), "path string"), "archives")


def _read(batches, with_payload: bool):
    for b in batches:
        for path in b.column(0).to_pylist():
            rows, size = [], 0

            def out(rows):
                cols = list(zip(*rows))
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                n = len(names) - (not with_payload)
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])

            for head, body in read(path):
                number = lambda k: int(head[k]) if head.get(k) else None  # noqa: B023, E731
                rows.append((number("Page-ID"), head["WARC-Target-URI"], int(head["Payload-Length"]), head["WARC-Payload-Digest"][7:], head["WARC-Type"], number("Refers-To-Page-ID"), body))
                size += len(body) if with_payload else 200
                if size > 4 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records; a task reads some archives, each in order."""
    ship(paths.sparkSession)
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    spread = paths.select("path").repartition(max(1, paths.count()))  # a task for each archive; a path is all that moves
    return spread.mapInArrow(partial(_read, with_payload=with_payload), kind)


def verify(records: DataFrame) -> None:
    """Raises ``WarcError`` if a revisit's digest or length isn't that of a response with the id it refers to."""
    same = ["payload_digest", "payload_bytes"]
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *same).distinct()
    lost = wanted.join(records.where("record_type = 'response'").select("page_id", *same), ["page_id", *same], "left_anti")
    if (r := lost.first()) is not None:
        raise WarcError(f"a revisit refers to page {r.page_id}, which has no response with the digest {r.payload_digest}")


def round_trip(df: DataFrame, **cols) -> DataFrame:
    """Writes all rows to archives in the shared folder, reads them back and verifies revisits."""
    records = cut(read_archives(write(df, scratch(df.sparkSession, "warc"), **cols)).drop("url"), "records")
    verify(records)
    return records


ORACLE = f"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first from p
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST} and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {LEAST} and first <> page_id then first end as refers_to from f
"""
