"""Web archives in ZIP packages: WARC records written with revisits, and read back by ranges, without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, ship, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DAY = (1980, 1, 1, 0, 0, 0)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, which every machine must reach, and the path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _line(text: str) -> str:
    """A header's value without what would end its line."""
    return re.sub("[\x00-\x1f\x7f]", lambda m: quote(m[0]), text)


def record(page_id: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A record: a response with its payload, or, with refers_to, a revisit, which has the headers of the response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _urn(page_id: str | None) -> str:
    return "urn:page" if page_id is None else f"urn:page:{quote(page_id, safe='')}"


def _of_urn(urn: str) -> str | None:
    name = urn.strip("<>")
    return unquote(name[len("urn:page:") :]) if name.startswith("urn:page:") else None


def surt(url: str) -> str:
    """The key that an index is sorted by: the host's parts from the last to the first, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return _line(url.lower()).replace(" ", "%20")
    return _line(f"{host}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}").replace(" ", "%20")


class Package:
    """A package that is being written: stored archive members, then their index, the list of pages and what the package holds."""

    def __init__(self, out, member_bytes: int) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member_bytes, self.members, self.size, self.index, self.resources = member_bytes, 0, 0, [], []
        self.member = None

    def _open(self, name: str):
        self.name, self.at, self.sum = name, 0, hashlib.sha256()
        self.member = self.zip.open(zipfile.ZipInfo(name, DAY), "w", force_zip64=True)

    def _write(self, data: bytes) -> None:
        self.member.write(data)
        self.sum.update(data)
        self.at += len(data)
        self.size += len(data)

    def _close(self) -> None:
        if self.member is not None:
            self.member.close()
            self.resources.append({"name": self.name.rpartition("/")[2], "path": self.name, "hash": f"sha256:{self.sum.hexdigest()}", "bytes": self.at})
            self.member = None

    def add(self, url: str | None, digest: str, revisit: bool, date: str, data: bytes) -> None:
        if self.member is not None and self.at >= self.member_bytes:
            self._close()
        if self.member is None:
            self._open(f"archive/data-{self.members:05d}.warc.gz")
            self.members += 1
        packed = gzip.compress(data, 5, mtime=0)
        entry = {"url": url or "", "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(packed)), "offset": str(self.at), "filename": self.name.rpartition("/")[2]}
        self.index.append(f"{surt(url or '')} {re.sub('[^0-9]', '', date)} {json.dumps(entry)}\n")
        self._write(packed)

    def close(self, date: str) -> None:
        self._close()
        self.index.sort()
        pages = (json.dumps({"url": json.loads(x.split(" ", 2)[2])["url"], "ts": date}) + "\n" for x in self.index)
        for name, lines in (("indexes/index.cdxj", self.index), ("pages/pages.jsonl", ['{"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}\n', *pages])):
            self._open(name)
            for line in lines:
                self._write(line.encode())
            self._close()
        what = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": date, "resources": self.resources})
        self.zip.writestr(zipfile.ZipInfo("datapackage.json", DAY), what)
        self.zip.close()


def _packages(folder: str, date: str, package_bytes: int, member_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = store(folder)
        system.create_dir(top, recursive=True)
        package = out = None
        done: list[tuple[str, int]] = []

        def end() -> None:
            nonlocal package
            package.close(date)
            out.close()
            done.append((path, len(package.index)))
            package = None

        for batch in batches:
            ids, urls, texts, sizes, digests, refers = batch.columns
            for i in range(len(batch)):
                if package is None:
                    path = f"{uuid.uuid4().hex}.wacz"  # another attempt of the task writes other files
                    out = system.open_output_stream(f"{top}/{path}")
                    package = Package(out, member_bytes)
                url, digest, to = urls[i].as_py(), digests[i].as_py(), refers[i].as_py()
                payload = None if to is not None else (texts[i].as_py() or "").encode()
                package.add(url, digest, to is not None, date, record(ids[i].as_py(), url, payload, sizes[i].as_py(), digest, to, date))
                if package.size >= package_bytes:
                    end()
        if package is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z", package_bytes: int = 1 << 28, member_bytes: int = 1 << 26, folder: str | None = None) -> DataFrame:
    """Write a record for each page into packages in a shared folder; the manifest (path, records) of these is a table there.

    Of pages with equal payloads of least bytes at least, the one with the greatest id is a response and the others revisit it; they carry no
    payload. All others are responses. Equal payloads are those with equal SHA-1, length and 64-bit hash. Payloads are counted by partial
    aggregation, and pages meet only the row of their payload, by a join whose large partitions can be split.

    Each task writes packages of about package_bytes under names of its own and tells them in the manifest, which is committed as
    a whole; packages of an attempt that was lost are in no manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("text")).withColumns({"size": F.octet_length("text").cast("long"), "digest": F.sha1("text"), "hash": F.xxhash64("text")})
    same = ["digest", "size", "hash"]
    several = rows.where(F.col("size") >= least).groupBy(*same).agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(*same, "keeper")
    # the narrow side is hashed, so that pages stream past it and are never sorted
    marked = rows.join(several.hint("shuffle_hash"), same, "left").select(
        F.col("id").cast("string").alias("id"), "url", F.when(F.col("keeper").isNull() | F.col("id").eqNullSafe(F.col("keeper")), F.col("text")).alias("text"), "size", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper").cast("string")).alias("refers_to"),
    )
    return written(marked.mapInArrow(_packages(folder, date, package_bytes, member_bytes), "path string, records long"))


class Member(NamedTuple):
    """A file of a package: how it is packed, and where its bytes lie in the package."""

    name: str
    method: int
    begin: int
    packed: int
    size: int


@dataclass
class Reader:
    """The directory of a package of which any range of bytes can be read, and nothing else is."""

    read: Callable[[int, int], bytes]
    size: int

    def _end(self) -> tuple[int, int, int, int]:
        """Entries, size and place of the central directory, and by how much all places are off."""
        tail = self.read(at := max(0, self.size - 65_557), min(self.size, 65_557))
        k = tail.rfind(b"PK\x05\x06")
        while k >= 0 and (len(tail) < k + 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("not a ZIP package: it has no end of a central directory")
        count, size, place = struct.unpack_from("<HII", tail, k + 10)
        end = at + k
        if end >= 20 and (mark := self.read(end - 20, 20))[:4] == b"PK\x06\x07":  # ZIP64
            where = struct.unpack_from("<Q", mark, 8)[0]
            big = self.read(where, 56)
            if big[:4] != b"PK\x06\x06":  # the package stands behind other bytes
                where = end - 76
                big = self.read(where, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("a ZIP64 locator without its record")
            count, size, place = struct.unpack_from("<QQQ", big, 32)
            end = where
        return count, size, place, end - size - place

    def members(self) -> list[Member]:
        count, size, place, off = self._end()
        raw, k, out = self.read(place + off, size), 0, []
        for _ in range(count):
            if raw[k : k + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack_from("<HH", raw, k + 8)
            packed, full, n, m, c, _, _, _, head = struct.unpack_from("<IIHHHHHII", raw, k + 20)
            name = raw[k + 46 : k + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, j = raw[k + 46 + n : k + 46 + n + m], 0
            while j + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, j)
                if kind == 1:  # the fields that don't fit, in this order
                    long = list(struct.unpack_from(f"<{length // 8}Q", extra, j + 4))
                    full = long.pop(0) if full == 0xFFFFFFFF else full
                    packed = long.pop(0) if packed == 0xFFFFFFFF else packed
                    head = long.pop(0) if head == 0xFFFFFFFF else head
                j += 4 + length
            if flags & 1:
                raise ValueError(f"{name} is encrypted")
            local = self.read(head + off, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"{name} has no local header")
            out.append(Member(name, method, head + off + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, full))
            k += 46 + n + m + c
        return out

    def whole(self, m: Member) -> bytes:
        raw = self.read(m.begin, m.packed)
        if m.method == 8:
            raw = zlib.decompress(raw, -15)
        elif m.method:
            raise ValueError(f"{m.name} is packed by method {m.method}")
        return gzip.decompress(raw) if m.name.endswith(".gz") else raw

    def records(self) -> Iterator[tuple[str, int, int]]:
        """(member, place in the package, length) of all records: from the indexes, or by a walk through members that no index names."""
        members = self.members()
        archives = {m.name: m for m in members if re.search(r"\.warc(\.gz)?$", m.name)}
        for m in archives.values():
            if m.method:
                raise ValueError(f"{m.name} isn't stored, so its records can't be read by ranges")
        short = {n.rpartition("/")[2]: n for n in archives}
        named = set()
        for m in members:
            if re.search(r"\.cdxj?(\.gz)?$", m.name):
                for line in io.BytesIO(self.whole(m)):
                    if b"{" in line:
                        x = json.loads(line[line.index(b"{") :])
                        name = x["filename"] if x["filename"] in archives else short[x["filename"]]
                        named.add(name)
                        yield name, archives[name].begin + int(x["offset"]), int(x["length"])
        for name, m in archives.items():
            if name not in named:
                for at, length in self._walk(m):
                    yield name, m.begin + at, length

    def _walk(self, m: Member) -> Iterator[tuple[int, int]]:
        """Where the compressed records of a member lie."""
        at = begin = 0
        machine, rest = zlib.decompressobj(31), b""
        while at < m.size or rest:
            if not rest:
                rest = self.read(m.begin + at, min(1 << 20, m.size - at))
                at += len(rest)
            machine.decompress(rest)
            rest = machine.unused_data
            if machine.eof:
                end = at - len(rest)
                yield begin, end - begin
                begin, machine = end, zlib.decompressobj(31)


def reader(path: str) -> Reader:
    system, name = store(path)
    f = system.open_input_file(name)
    return Reader(lambda at, n: f.read_at(n, at) if n else b"", f.size())


def parse(raw: bytes) -> dict:
    """A record's headers, its own and those of HTTP, by lower-case names, and its payload."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    of = lambda some: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in some)}
    out = of(lines[1:])
    block = rest[: int(out["content-length"])]
    if len(block) < int(out["content-length"]):
        raise ValueError(f"a record of {out['content-length']} bytes ends after {len(block)}")
    http, _, payload = block.partition(b"\r\n\r\n") if out.get("content-type", "").startswith("application/http") else (b"", b"", block)
    return {"warc": out, "http": of(http.decode("utf-8", "replace").split("\r\n")[1:]), "payload": payload}


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = list(reader(path).records())  # of one package, which is bounded
            names, places, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "member", "offset", "length"])


def locate(manifest: DataFrame) -> DataFrame:
    """Columns (path, member, offset, length): where each record of each package lies. A package's directory and indexes are read, no archive."""
    ship(manifest.sparkSession)
    return manifest.select("path").repartition("path").mapInArrow(_located, "path string, member string, offset long, length long")


def _read(payloads: bool, gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, own = None, None
        for batch in batches:
            rows = list(zip(*[batch.column(n).to_pylist() for n in ("path", "offset", "length", "member")]))
            i = 0
            while i < len(rows):
                j, end = i + 1, rows[i][1] + rows[i][2]  # neighbours are read at once
                while j < len(rows) and rows[j][0] == rows[i][0] and 0 <= rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - rows[i][1] <= most:
                    end = rows[j][1] + rows[j][2]
                    j += 1
                if rows[i][0] != path:
                    path = rows[i][0]
                    own = reader(path)
                raw = own.read(rows[i][1], end - rows[i][1])
                out: list[tuple] = []
                for _, at, n, member in rows[i:j]:
                    x = parse(raw[at - rows[i][1] : at - rows[i][1] + n])
                    w = x["warc"]
                    told = base64.b32decode(w["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in w else None
                    full = w["warc-type"] != "revisit"
                    digest = hashlib.sha1(x["payload"]).hexdigest() if full else told
                    size = len(x["payload"]) if full else int(x["http"].get("content-length", 0))
                    out.append((path, member, at, n, _of_urn(w["warc-record-id"]), w["warc-type"], w.get("warc-target-uri"), w.get("warc-date"), digest, told is None or told == digest, size, _of_urn(w["warc-refers-to"]) if "warc-refers-to" in w else None, x["payload"] if payloads and full else None))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64(), pa.string(), pa.binary()]
                names = ["path", "member", "offset", "length", "page_id", "record_type", "url", "date", "payload_digest", "intact", "payload_bytes", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                i = j

    return run


def read_archives(manifest: DataFrame, payloads: bool = True, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """The records of the packages of a manifest (path): path, member, offset, length, page_id, record_type, url, date, payload_digest (bare
    lower-case hex), intact (a response's payload has the digest that its record tells), payload_bytes (of the full payload, also for revisits),
    refers_to, and the payload of responses, unless payloads is off.

    Records are dealt out by ranges of their packages, so a large package is read by many tasks; each reads neighbouring records at
    once, most bytes at most (or one longer record), and leaves gaps of over gap bytes out.

    Defined cases: an empty manifest has no records. What isn't a package, is encrypted, or has archives that aren't stored is an error.
    """
    spans = locate(manifest).repartition("path", F.floor(F.col("offset") / (4 * most))).sortWithinPartitions("path", "offset")
    return spans.mapInArrow(_read(payloads, gap, most), "path string, member string, offset long, length long, page_id string, record_type string, url string, date string, payload_digest string, intact boolean, payload_bytes long, refers_to string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", **parameters) -> DataFrame:
    """Columns (page_id, payload_bytes, payload_digest, record_type, refers_to, intact) for each row of pages, as read back from archives of them.

    Defined cases: a null html is empty; empty and short payloads are always responses. A null url is left out. Rows that repeat an
    id are records of their own; if their payload is that of the greatest id and this is theirs, all of them are responses. A row with a null
    id revisits the payload's greatest id, and is a response if all of its payload's ids are null. An empty table gives an empty result.
    Other columns are ignored.
    """
    kind = dict(pages.select(F.col(id_col).alias("id")).dtypes)["id"]
    got = read_archives(write_archives(pages, id_col, url_col, text_col, **parameters), payloads=False)
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest (path) of all packages in a folder that Spark can list, for archives that others wrote."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path")
