"""Web archives inside ZIP packages: written by tasks, read back by byte ranges without extraction.

A package is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, in which every WARC record
is a gzip member of its own, and ``indexes/index.cdxj`` with a line per record (key, time, and JSON with the record's
offset and length inside the first member).  A reader needs the ends of the file only: the end record, the ZIP64 end
record where 32 bits (or 16) do not do, the central directory, and the local header of each member it wants, whose
length decides where the member's bytes begin.  As they are stored, an offset in the index is then a place in the file.

* ``write_archives``: rows of pages become records.  Of rows with equal payloads (by SHA-1, of at least
  ``min_payload`` bytes) those with the smallest id are ``response`` records and the others ``revisit`` it, without a
  payload.  The smallest ids are found by an aggregate over (digest, id), and joined to the pages.  A task closes a
  package after ``archive_bytes`` and opens the next one.  File names hold the task attempt, and the table of packages
  that is returned is written by Spark's commit protocol: what a lost or repeated attempt has left is in no table.
* ``read_index``: packages to one row per record (package, place, length and the fields of the index line); a package
  without an index is scanned.  Its members may be gzip or plain, the directory ZIP or ZIP64, with bytes before it.
* ``read_records``: index rows, filtered as one likes, to records.  Rows are dealt by (package, stretch of
  ``read_bytes``) and each task reads neighbouring records with one range read.

Packages are opened with ``pyarrow.fs``, so the folder can be any store that it knows; on a cluster it is a folder
below ``spark.checkpoint.dir`` unless one is given.

Edge cases: a null page is an empty payload, and shares one digest with the empty ones; rows that repeat the smallest
id are all ``response``; a null id revisits the others' smallest id, and is ``response`` where there is none; null
urls give no target; an empty table gives no package and no row; extra columns are not carried.  A member that is
compressed or encrypted inside the ZIP cannot be read by range and raises an error, as do cut or damaged packages.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import cut_lineage, ensure_checkpoint_dir

# Fixed names and signatures of the formats.
DATA_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _END64_AT, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _END64_AT_SIZE, _END64_SIZE, _ENTRY_SIZE, _LOCAL_SIZE = 22, 20, 56, 46, 30
_MAX_COMMENT = 0xFFFF
_CRLF2 = b"\r\n\r\n"

READ_STEP = 1 << 20
RECORD_SCHEMA = ("archive string, record_id string, record_type string, target_uri string, payload_digest string, "
                 "payload_bytes long, refers_to string, digest_ok boolean, payload binary")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- records

def record_urn(key: object) -> str:
    """A record's name from a row's id (which may be null)."""
    return "<urn:page:null>" if key is None else f"<urn:page:id:{quote(str(key), safe='')}>"


def urn_key(urn: str | None) -> str | None:
    """The id, as text, that ``record_urn`` was given."""
    m = re.fullmatch(r"<urn:page:id:(.*)>", urn or "")
    return unquote(m[1]) if m else None


def payload_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _header_value(value: str) -> str:
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._")


def warc_record(kind: str, urn: str, date: str, block: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    """One record, uncompressed."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", date), *fields,
            ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + _CRLF2


def page_record(key: object, url: str | None, payload: bytes, sha1: str, refers_to: str | None, date: str) -> bytes:
    """The ``response`` of a page, or its ``revisit`` of the record of another id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", _header_value(url) if url else None), ("WARC-Payload-Digest", f"sha1:{sha1}"),
              ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return warc_record("response", record_urn(key), date, http + payload, fields)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    return warc_record("revisit", record_urn(key), date, http, fields)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


def parse_record(raw: bytes) -> dict[str, object]:
    """The columns of ``RECORD_SCHEMA`` (but ``archive``) of an uncompressed record."""
    head, sep, rest = raw.partition(_CRLF2)
    if not head.startswith(b"WARC/") or not sep:
        raise ValueError("no WARC record where the index says one begins")
    field = _fields(head)
    block = rest[:int(field["content-length"])]
    if len(block) < int(field["content-length"]):
        raise ValueError("a WARC record ends before its length")
    kind, payload, said = field.get("warc-type"), block, {}
    if field.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_CRLF2)
        said = _fields(http)
    digest = field.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind == "revisit":
        size, known, payload = int(said.get("content-length", 0)), None, None
    else:
        size, real = len(payload), payload_sha1(payload)
        digest, known = digest or real, (digest or real) == real
    return {"record_id": field.get("warc-record-id"), "record_type": kind, "target_uri": field.get("warc-target-uri"),
            "payload_digest": digest, "payload_bytes": size, "refers_to": field.get("warc-refers-to"), "digest_ok": known,
            "payload": payload}


def index_key(url: str | None) -> str:
    """The sort key of an index line: host labels from the top down, then the path."""
    parts = urlsplit(url or "")
    host = ",".join(reversed((parts.hostname or "").split(".")))
    return re.sub(r"\s", "%20", f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower())


# ---------------------------------------------------------------- packages

class PackageWriter:
    """One package: records go straight into the stored data member, their index lines after it."""

    def __init__(self, path: str, date: str, level: int = 6):
        store, inner = file_system(path)
        self.path, self.date, self.level, self.lines, self.at = path, date, level, [], 0
        self.out = store.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA_MEMBER, "w", force_zip64=True)
        self._put(warc_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", date, b"format: WARC File Format 1.1\r\n",
                              [("Content-Type", "application/warc-fields")]))

    def _put(self, raw: bytes) -> tuple[int, int]:
        squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        at, self.at = self.at, self.at + len(packed)
        self.data.write(packed)
        return at, len(packed)

    def add(self, kind: str, url: str | None, sha1: str, raw: bytes) -> None:
        at, size = self._put(raw)
        entry = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha1:{sha1}", "type": kind,
                 "length": str(size), "offset": str(at), "filename": DATA_MEMBER.rpartition("/")[2]}
        self.lines.append(f"{index_key(url)} {re.sub('[^0-9]', '', self.date)} {json.dumps(entry)}\n")

    def close(self) -> None:
        self.data.close()
        self.lines.sort()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as member:
            for line in self.lines:
                member.write(line.encode("utf-8"))
        self.zip.close()
        self.out.close()


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    packed: int         # bytes in the file
    header: int         # place of the local header


class Package:
    """A ZIP file seen through ``read_at(place, length)``: its directory and where its members' bytes begin."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        start = max(0, size - _END_SIZE - _MAX_COMMENT)
        tail = read_at(start, size - start)
        at = tail.rfind(_END)
        # The end record is followed by its comment and nothing else.
        while at >= 0 and (at + _END_SIZE > len(tail)
                           or at + _END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        self.entries, cd_size, cd_at = struct.unpack_from("<10xHII", tail, at)
        end = start + at
        # Writers may add a ZIP64 end where the plain one would do; it lies between that and the directory.
        where = read_at(end - _END64_AT_SIZE, _END64_AT_SIZE) if end >= _END64_AT_SIZE else b""
        if where.startswith(_END64_AT):
            self.entries, cd_size, cd_at, end = self._end64(struct.unpack_from("<8xQ", where)[0], end - _END64_AT_SIZE)
        # Bytes that were put before the ZIP shift every place.
        self.shift = end - cd_size - cd_at
        if self.shift < 0:
            raise ValueError("the ZIP directory is larger than the file")
        self.directory = (end - cd_size, end)

    def _end64(self, said: int, before: int) -> tuple[int, int, int, int]:
        """Entries, directory size and place, and the place of the ZIP64 end record, which ends before ``before``."""
        for at in (said, before - _END64_SIZE):        # the second one if bytes were put before the ZIP
            raw = self.read_at(at, _END64_SIZE) if 0 <= at <= before - _END64_SIZE else b""
            if raw.startswith(_END64):
                entries, size, place = struct.unpack_from("<32xQQQ", raw)
                return entries, size, place, at
        raise ValueError("no ZIP64 end of a directory")

    def members(self) -> Iterator[Member]:
        """The entries of the central directory, read step by step."""
        at, end = self.directory
        buf, i = b"", 0
        for _ in range(self.entries):
            while True:         # the entry's fixed part, then its name and fields
                held = len(buf) - i
                need = _ENTRY_SIZE + (sum(struct.unpack_from("<28xHHH", buf, i)) if held >= _ENTRY_SIZE else 0)
                if held >= need and held >= _ENTRY_SIZE:
                    break
                more = self.read_at(at, min(READ_STEP, end - at))
                if not more:
                    raise ValueError("the ZIP directory is cut")
                at, buf, i = at + len(more), buf[i:] + more, 0
            if not buf.startswith(_ENTRY, i):
                raise ValueError("a damaged ZIP directory")
            flags, method, packed, size, n, extra, comment, header = struct.unpack_from("<8xHH8xIIHHH8xI", buf, i)
            name = buf[i + _ENTRY_SIZE:i + _ENTRY_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437")
            wide = self._wide(buf[i + _ENTRY_SIZE + n:i + _ENTRY_SIZE + n + extra])
            if size == 0xFFFFFFFF:
                wide.pop(0)
            if packed == 0xFFFFFFFF:
                packed = wide.pop(0)
            if header == 0xFFFFFFFF:
                header = wide.pop(0)
            i += need
            yield Member(name, method, flags, packed, header + self.shift)

    @staticmethod
    def _wide(extra: bytes) -> list[int]:
        """The 64-bit numbers of the ZIP64 field."""
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                return list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            extra = extra[4 + n:]
        return []

    def data(self, member: Member) -> int:
        """The place of the member's first byte."""
        if member.method or member.flags & 1:
            raise ValueError(f"{member.name} is compressed or encrypted inside the ZIP and cannot be read by range")
        raw = self.read_at(member.header, _LOCAL_SIZE)
        if not raw.startswith(_LOCAL):
            raise ValueError(f"no local header of {member.name}")
        return member.header + _LOCAL_SIZE + sum(struct.unpack_from("<26xHH", raw))

    def chunks(self, member: Member) -> Iterator[bytes]:
        at = self.data(member)
        end = at + member.packed
        while at < end:
            got = self.read_at(at, min(READ_STEP, end - at))
            if not got:
                raise ValueError(f"{member.name} is cut")
            at += len(got)
            yield got


def open_package(path: str) -> Package:
    store, inner = file_system(path)
    file = store.open_input_file(inner)
    return Package(lambda at, n: file.read_at(n, at), file.size())


def _unzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of a run of gzip members."""
    one = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield one.decompress(chunk)
            chunk = one.unused_data
            if one.eof:
                one = zlib.decompressobj(31)


def _lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _scan_gzip(package: Package, member: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of the gzip members of a stored member."""
    begin = end = 0
    one = zlib.decompressobj(31)
    for chunk in package.chunks(member):
        while chunk:
            one.decompress(chunk)
            end += len(chunk) - len(one.unused_data)
            chunk = one.unused_data
            if one.eof:
                yield begin, end - begin
                begin, one = end, zlib.decompressobj(31)
    if end > begin:
        raise ValueError(f"{member.name} is cut")


def _scan_plain(package: Package, member: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of the records of a stored member that is not compressed at all."""
    start, at = package.data(member), 0
    while at < member.packed:
        head = b""
        while _CRLF2 not in head:
            more = package.read_at(start + at + len(head), min(1 << 14, member.packed - at - len(head)))
            if not more:
                raise ValueError(f"{member.name} is cut")
            head += more
        head = head.partition(_CRLF2)[0]
        size = len(head) + 4 + int(_fields(head)["content-length"]) + 4
        yield at, size
        at += size


def package_index(path: str) -> Iterator[tuple]:
    """``offset`` (in the file), ``length``, ``url``, ``record_type``, ``payload_digest`` of a package's records."""
    package = open_package(path)
    data: dict[str, Member] = {}
    indexes: list[Member] = []
    for m in package.members():
        folder, _, name = m.name.rpartition("/")
        if folder == "archive" and re.search(r"\.warc(\.gz)?$", name):
            data[name] = m
        elif folder == "indexes" and re.search(r"\.cdxj?(\.gz)?$", name):
            indexes.append(m)
    starts = {name: package.data(m) for name, m in data.items()}
    for m in indexes:
        chunks = package.chunks(m)
        for line in _lines(_unzipped(chunks) if m.name.endswith(".gz") else chunks):
            if b"{" in line:
                e = json.loads(line[line.index(b"{"):])
                yield (starts[e["filename"]] + int(e["offset"]), int(e["length"]), e.get("url"), e.get("type"),
                       (e.get("digest") or "").rpartition(":")[2] or None)
    if not indexes:
        for name, m in data.items():
            for at, size in (_scan_gzip if name.endswith(".gz") else _scan_plain)(package, m):
                yield starts[name] + at, size, None, None, None


# ---------------------------------------------------------------- Spark jobs

def with_owners(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``: the smallest id with an equal payload, where it is another one.

    The aggregate sees digests and ids only. Its side of the join is one row per repeated payload, and rows of a
    payload that very many pages share stay on the side that adaptive execution can split.
    """
    named = pages.withColumn("sha1", F.sha1("payload"))
    owners = (named.where(F.octet_length("payload") >= min_payload).groupBy("sha1")
              .agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 AND owner IS NOT NULL"))
    owners = cut_lineage(owners.select("sha1", "owner"))
    joined = named.join(owners, "sha1", "left")
    other = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(other, F.col("owner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0, archive_bytes: int = 256 << 20,
                   date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write all rows of ``pages``; ``archive, n_records, n_bytes`` of every package (a written table)."""
    spark = pages.sparkSession
    folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/threadlens-warc-{uuid.uuid4().hex}").rstrip("/")
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, inner = file_system(folder)
        store.create_dir(inner, recursive=True)
        done: list[tuple[str, int, int]] = []
        package: PackageWriter | None = None

        def finish() -> None:
            package.close()
            done.append((package.path, len(package.lines), package.at))

        for batch in batches:
            for i in range(batch.num_rows):
                if package is None:
                    package = PackageWriter(
                        f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.wacz", date)
                key, url, payload, sha1, refers = (c[i].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode("ascii")
                package.add("response" if refers is None else "revisit", url, digest,
                            page_record(key, url, payload, digest, refers, date))
                if package.at >= archive_bytes:
                    finish()
                    package = None
        if package is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["archive", "n_records", "n_bytes"])

    return cut_lineage(with_owners(src, min_payload).mapInArrow(run, "archive string, n_records long, n_bytes long"))


def read_index(archives: DataFrame, rows: int = 10_000) -> DataFrame:
    """``archive, offset, length, url, record_type, payload_digest`` of all records. ``archives``: column ``archive``."""
    names = ["archive", "offset", "length", "url", "record_type", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                for entry in package_index(path):
                    held.append((path, *entry))
                    if len(held) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    # A package is a task's work: few rows, dealt out evenly.
    return (archives.select("archive").where("archive IS NOT NULL").repartition("archive")
            .mapInArrow(run, "archive string, offset long, length long, url string, record_type string, "
                             "payload_digest string"))


def read_records(index: DataFrame, read_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records of the index rows (``archive, offset, length``), by range reads. Columns as ``RECORD_SCHEMA``;
    without ``payloads`` that column is null."""
    schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                        ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                        ("refers_to", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Neighbouring records of a package, up to ``read_bytes`` in all (one at least)."""
        name, run = None, []
        for batch in batches:
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if run and (path != name or at != run[-1][0] + run[-1][1] or at + size - run[0][0] > read_bytes):
                    yield name, run
                    run = []
                name = path
                run.append((at, size))
        if run:
            yield name, run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for path, run in runs(batches):
            if path != name:
                store, inner = file_system(path)
                name, file = path, store.open_input_file(inner)
            first = run[0][0]
            raw = memoryview(file.read_at(run[-1][0] + run[-1][1] - first, first))
            out, held = [], 0
            for at, size in run:
                part = raw[at - first:at - first + size]
                if len(part) < size:
                    raise ValueError(f"{path} is cut")
                record = parse_record(zlib.decompress(part, 31) if part[:2] == b"\x1f\x8b" else bytes(part))
                held += len(record["payload"] or b"")
                out.append(record | {"archive": path} | ({} if payloads else {"payload": None}))
                if held >= read_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    dealt = (index.select("archive", "offset", "length")
             .repartition("archive", F.floor(F.col("offset") / F.lit(read_bytes)))
             .sortWithinPartitions("archive", "offset"))
    return dealt.mapInArrow(read, RECORD_SCHEMA)


def page_rows(records: DataFrame, id_type: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records written by ``write_archives``."""
    def key(urn: str) -> F.Column:
        quoted = F.regexp_extract(urn, "^<urn:page:id:(.*)>$", 1)
        return F.when(F.col(urn).startswith("<urn:page:id:"), F.url_decode(quoted)).cast(id_type)

    return records.where("record_type IN ('response', 'revisit')").select(
        key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        key("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, min_payload: int = 0, **write: object) -> DataFrame:
    """Write all pages into packages, and their rows as read back from these."""
    id_type = pages.schema[str(write.get("id_col", "page_id"))].dataType.simpleString()
    archives = write_archives(pages, min_payload=min_payload, **write)
    return page_rows(read_records(read_index(archives), payloads=False), id_type)


# Base 32 of the 160 bits of a SHA-1, five hexadecimal digits at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
        lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                         (((('0x' || substr(h, 5 * g + 1, 5))::INTEGER >> b) & 31) + 1)::INTEGER, 1)), '')), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS owner FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to FROM d
"""
