"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

Each record is a gzip member of its own. A payload that several pages share is
stored once, with the page of the largest id; the others become revisit records.
The reader checks framing, lengths and digests of every record. Where a check
fails it searches for the next gzip member or version line, whichever is nearer,
from which a whole record can be read, goes on from there, and logs the bytes
between as quarantined. A member may hold any number of records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Rows, filesystem, materialize, qualified, released, shared_dir

#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 64 << 20
#: At most so many groups of equal payloads (some 10 MB) are broadcast.
BROADCAST_GROUPS = 100_000
#: Parts that a larger table of groups, and so a hot group, is joined in.
SALTS = 32
#: Archives are read by at most so many tasks.
READ_TASKS = 20_000

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"
#: No version line is longer.
LINE = 12
#: Bytes of an archive that are held at first, and at most: a record, or a member, that is longer is checked piece by piece.
WINDOW, LONGEST = 8 << 20, 64 << 20
#: Bytes of such a piece.
PIECE = 4 << 20
#: Anywhere, as damage can take the line break before it; what follows is checked in full.
_version_line = re.compile(rb"WARC/\d\.\d\r?\n")


def digest32(content: bytes) -> str:
    return _base32(hashlib.sha1(content))


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(content) + packer.flush()


class Damaged(ValueError):
    """A failed check, with the records that could still be read before it; ``cut`` if more bytes could mend it."""

    def __init__(self, why: str, records: Iterable[dict] = (), cut: bool = False):
        super().__init__(why)
        self.records, self.cut = list(records), cut


def parse_headers(content: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """The headers of the record at ``at`` and where its block begins."""
    line = _version_line.match(content, at)
    if not line:
        raise Damaged("no version line", cut=len(content) - at < LINE)
    end = content.find(b"\r\n\r\n", line.end())
    if end < 0:
        raise Damaged("headers do not end", cut=True)
    headers = {}
    for row in content[line.end() : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Damaged("header without a name")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    return headers, end + 4


class Block:
    """A record's block, whole or piece by piece: its digests, and its payload if it is an HTTP message."""

    def __init__(self, headers: dict[str, str], keep: bool = True):
        self.headers, self.keep = headers, keep
        self.is_http = headers.get("content-type", "").startswith("application/http")
        self.whole, self.body = hashlib.sha1(), hashlib.sha1()
        self.head, self.in_body, self.length, self.parts = b"", not self.is_http, 0, []

    def add(self, piece: bytes) -> None:
        self.whole.update(piece)
        if not self.is_http:
            return
        if not self.in_body:
            self.head += piece
            self.head, mark, piece = self.head.partition(b"\r\n\r\n")
            self.in_body = bool(mark)
        if self.in_body:
            self.body.update(piece)
            self.length += len(piece)
            if self.keep:
                self.parts.append(piece)

    def record(self) -> dict:
        """What the record says, once all is added; raises ``Damaged`` if a digest or length differs."""
        headers = self.headers
        if (said := headers.get("warc-block-digest")) and said != "sha1:" + _base32(self.whole):
            raise Damaged("block digest differs")
        found = {"headers": headers, "type": headers.get("warc-type", "")}
        if self.is_http:
            size = re.search(rb"(?im)^content-length:\s*(\d+)", self.head)
            found |= {"payload": b"".join(self.parts) if self.keep else None, "size": int(size[1]) if size else self.length}
            said, own = headers.get("warc-payload-digest", "").removeprefix("sha1:"), _base32(self.body)
            if found["type"] == "response":
                if said and said != own:
                    raise Damaged("payload digest differs")
                if size and self.length != int(size[1]):
                    raise Damaged("payload length differs")
            found["digest"] = said or own
        return found


def parse(content: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises ``Damaged`` if any check fails."""
    headers, start = parse_headers(content, at)
    stop = start + int(headers["content-length"])
    if content[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says", cut=stop + 4 > len(content))
    block = Block(headers)
    block.add(content[start:stop])
    return block.record(), stop + 4


class _Source:
    """The bytes from a place of a file on, unpacked if a gzip member begins there, piece by piece."""

    def __init__(self, read_at: Callable[[int, int], bytes], at: int):
        self.read_at, self.at, self.held = read_at, at, b""
        mark = b""
        while len(mark) < len(MEMBER) and (piece := read_at(at + len(mark), len(MEMBER) - len(mark))):
            mark += piece
        self.reader = zlib.decompressobj(31) if mark == MEMBER else None

    def _more(self) -> bytes:
        if self.reader is None:
            piece = self.read_at(self.at, PIECE)
            self.at += len(piece)
            return piece
        while not self.reader.eof:
            packed = self.reader.unconsumed_tail
            if not packed:
                packed = self.read_at(self.at, PIECE)
                self.at += len(packed)
                if not packed:
                    raise Damaged("gzip member is cut short", cut=True)
            try:
                piece = self.reader.decompress(packed, PIECE)
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            if piece:
                return piece
        return b""

    def fill(self, n: int) -> bool:
        while len(self.held) < n and (piece := self._more()):
            self.held += piece
        return len(self.held) >= n

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes, none at the end."""
        self.fill(1)
        piece, self.held = self.held[:n], self.held[n:]
        return piece

    @property
    def end(self) -> int:
        return self.at - (len(self.held) if self.reader is None else len(self.reader.unused_data))


def long_records(read_at: Callable[[int, int], bytes], at: int, keep: bool = True) -> tuple[list[dict], int]:
    """The record, or the records of the gzip member, at ``at``, whatever its length, and where it ends.

    Blocks go through running digests and are not held, but for payloads that ``keep`` asks
    for. Raises ``Damaged`` if a check fails, with the records that a broken member begins with.
    """
    source, records, trusted = _Source(read_at, at), [], 0
    try:
        while True:
            if not source.fill(LINE) and records and not source.held:
                return records, source.end
            if records and _version_line.match(source.held):
                trusted = len(records)
            searched = 0
            while source.held.find(b"\r\n\r\n", max(0, searched - 3)) < 0 and _version_line.match(source.held[:LINE]) and (searched := len(source.held)) < LONGEST:
                if not source.fill(len(source.held) + 1):
                    break
            headers, start = parse_headers(source.held)
            source.held = source.held[start:]
            block, left = Block(headers, keep), int(headers["content-length"])
            while left:
                if not (piece := source.take(left)):
                    raise Damaged("block does not end where its length says", cut=True)
                block.add(piece)
                left -= len(piece)
            if not source.fill(4) or source.held[:4] != b"\r\n\r\n":
                raise Damaged("block does not end where its length says")
            source.held = source.held[4:]
            records.append(block.record())
            if source.reader is None:
                return records, source.end
    except Damaged as e:
        raise Damaged(str(e), [r for r in records[:trusted] if "warc-block-digest" in r["headers"]] if source.reader else (), e.cut) from None


def _unpack(view: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where it ends; ``Damaged`` has the leading records of a broken one."""
    reader, parts, place, size = zlib.decompressobj(31), [], at, 1 << 16
    # fed in growing pieces, as its end is not known
    while place < len(view):
        piece = view[place : place + size]
        try:
            parts.append(reader.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}", _leading(_before_error(view, at))) from None
        place += len(piece)
        if reader.eof:
            return b"".join(parts), place - len(reader.unused_data)
        size = min(8 * size, 8 << 20)
    raise Damaged("gzip member is cut short", _leading(b"".join(parts)), cut=True)


def _before_error(view: memoryview, at: int, step: int = 64) -> bytes:
    """What a broken member gives before its error; a failing call gives nothing, so the steps are small."""
    reader, parts = zlib.decompressobj(31), []
    for place in range(at, len(view), step):
        try:
            parts.append(reader.decompress(view[place : place + step]))
        except zlib.error:
            break
    return b"".join(parts)


def _leading(body: bytes) -> Iterator[dict]:
    """The records that a broken member begins with.

    Its checksum vouches for nothing, so each must have a block digest that agrees and
    the next version line right behind it; what follows a failed check may be copied
    from damaged bytes, and is not read.
    """
    at = 0
    while True:
        try:
            found, at = parse(body, at)
        except Damaged:
            return
        if "warc-block-digest" not in found["headers"] or not _version_line.match(body, at):
            return
        yield found


#: The reason of what stands for "more bytes are needed from here on".
MORE = "more"


def _scan(size: int, read: Callable[[int], tuple], starts: Callable[[int], int], final: bool = True) -> Iterator[tuple[int, int, object, str | None]]:
    """What ``read`` gives from place to place, and the gaps up to the next of ``starts`` where it does not fail.

    Unless this is the ``final`` part of the content, it ends with ``MORE`` where more bytes could change what follows.
    """
    at, held = 0, None
    while at < size:
        try:
            found, end = held or read(at)
            held = None
            yield at, end, found, None
            at = end
            continue
        except Damaged as e:
            failed, gap = e, at
        cut = failed.cut
        while not (cut and not final) and (at := starts(at + 1)) < size:
            try:
                held = read(at)
                break
            except Damaged as e:
                cut = cut or e.cut
                if e.records:
                    break
        if cut and not final:
            yield gap, size, None, MORE
            return
        if at >= size and not final:  # a start can be cut by the end
            at = max(gap + 1, size - LINE)
        if failed.records:
            yield gap, at, [(r, None) for r in failed.records], None
        yield gap, at, None, str(failed)


def _next_line(content: bytes, after: int) -> int:
    found = _version_line.search(content, after)
    return found.start() if found else len(content)


def salvage(content: bytes, final: bool = True) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """``(start, end, record, None)`` of whole records and ``(start, end, None, why)`` of gaps, in order.

    Gzip members and plain records may follow each other in any order. The records of
    a member, and the gaps between them, all have the byte range of the member; those
    that a broken member begins with have that of the gap it leaves.
    """
    view, ahead = memoryview(content), [-1, -1]

    def starts(after: int) -> int:
        if ahead[0] < after:
            found = content.find(MEMBER, after)
            ahead[0] = len(content) if found < 0 else found
        if ahead[1] < after:
            ahead[1] = _next_line(content, after)
        return min(ahead)

    def read(at: int) -> tuple[list[tuple[dict | None, str | None]], int]:
        if not content.startswith(MEMBER, at):
            found, end = parse(content, at)
            return [(found, None)], end
        body, end = _unpack(view, at)
        inside = [(found, why) for _, _, found, why in _scan(len(body), lambda i: parse(body, i), lambda i: _next_line(body, i))]
        if not any(found for found, _ in inside):
            raise Damaged(inside[0][1] if inside else "no version line")
        return inside, end

    for start, end, found, why in _scan(len(content), read, starts, final):
        for part, reason in found or [(None, why)]:
            yield start, end, part, reason


def salvage_stream(read_at: Callable[[int, int], bytes], window: int = WINDOW, longest: int = LONGEST, payloads: bool = True) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """``salvage`` of a file that ``read_at(place, n)`` gives piece by piece; what is held grows to ``longest`` bytes at most.

    A record or member that is longer is read by ``long_records``, without its payload
    unless ``payloads`` are asked for. Neighbouring gaps with one reason are one gap.
    """
    held, base, size, ended = b"", 0, window, False
    gap: tuple[int, int, None, str] | None = None

    def put(start: int, end: int, found: dict | None, why: str | None) -> Iterator[tuple]:
        nonlocal gap
        if gap and (found or gap[1] != start or gap[3] != why):
            yield gap
            gap = None
        if found:
            yield start, end, found, None
        else:
            gap = (gap[0] if gap else start, end, None, why)

    while not (ended and not held):
        while len(held) < size and not ended:
            piece = read_at(base + len(held), size - len(held))
            held, ended = held + piece, not piece
        rest, more = 0, False
        for start, end, found, why in salvage(held, ended):
            if why == MORE:
                rest, more = start, True
                break
            yield from put(base + start, base + end, found, why)
            rest = end
        if more and not rest and len(held) >= longest:
            try:
                records, stop = long_records(read_at, base, payloads)
                for found in records:
                    yield from put(base, stop, found, None)
                held, base, ended = b"", stop, False
            except Damaged as e:
                member_at = held.find(MEMBER, 1)
                following = min(_next_line(held, 1), len(held) if member_at < 0 else member_at)
                # a start can be cut by the end of what is held
                following = following if following < len(held) or ended else max(1, len(held) - LINE)
                for found in e.records:
                    yield from put(base, base + following, found, None)
                yield from put(base, base + following, None, str(e))
                held, base = held[following:], base + following
            size = max(window, len(held))
            continue
        # a record that is not whole yet needs a longer window
        size = min(max(longest, window), window + len(held) - rest if rest else 2 * max(len(held), window))
        held, base = held[rest:], base + rest
    if gap:
        yield gap


WRITTEN = "path string, n_records long, n_bytes long"
_WRITTEN = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = filesystem(folder)
        out, parts, held, number = Rows(_WRITTEN), [], 0, 0

        def close() -> None:
            nonlocal parts, held, number
            path = f"{root}/part-{task.partitionId():07d}-{number:05d}.warc.gz"
            with files.open_output_stream(f"{path}.{task.taskAttemptId()}.tmp", compression=None) as f:
                for part in parts:
                    f.write(part)
            files.move(f"{path}.{task.taskAttemptId()}.tmp", path)
            out.add(0, path, len(parts), held)
            parts, held = [], 0
            number += 1

        for batch in batches:
            for page, url, html, refers_to, revisit in zip(*batch.columns, strict=True):
                parts.append(member(record(page.as_py(), url.as_py(), html.as_py(), refers_to.as_py(), revisit.as_py())))
                held += len(parts[-1])
                if held >= archive_bytes:
                    close()
        if parts:
            close()
        yield out.batch()

    return run


def payload_roles(spark: SparkSession, rows: DataFrame, least_bytes: int, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Adds ``first``, the largest page id of the rows with an equal payload, where there is more than one."""
    eligible = F.length("html") >= least_bytes
    narrow = rows.where(eligible).select("page_id", F.sha1("html").alias("hash"))
    shared = narrow.groupBy("hash").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = materialize(spark, shared, "warc-shared")
    rows = rows.withColumn("hash", F.when(eligible, F.sha1("html")))
    if shared.count() <= broadcast_groups:
        return rows.join(F.broadcast(shared), "hash", "left").drop("hash")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(shared, ["hash", "salt"], "left").drop("hash", "salt")


def write_warc(
    spark: SparkSession,
    pages: DataFrame,
    folder: str,
    revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns a row per archive.

    Rows whose payloads (html in UTF-8, null as empty) are equal and have at least
    ``revisit_bytes`` bytes are stored once: the largest page_id is the response,
    the others revisit it. Rows that repeat the largest page_id are responses too,
    and so are all rows of a group without any page_id. Null urls leave the target
    out; an empty table gives no archives. Other columns are not read.
    """
    folder = qualified(spark, folder)
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    )
    rows = payload_roles(spark, rows, revisit_bytes, broadcast_groups)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return materialize(spark, rows.mapInArrow(released(_write(folder, archive_bytes)), WRITTEN), "warc-manifest")


RECORDS = (
    "path string, start long, end long, record_type string, page_id long, url string, payload binary,"
    " payload_bytes long, payload_digest string, refers_to long, damage string"
)
_RECORDS = pa.schema(
    [
        ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("damage", pa.string()),
    ]
)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _read(folder: str, payloads: bool, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        out = Rows(_RECORDS)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    for start, end, found, why in salvage_stream(lambda at, n: f.read_at(n, at), longest=longest, payloads=payloads):  # noqa: B023
                        if found is None:
                            full = out.add(0, path, start, end, "quarantine", None, None, None, None, None, None, why)
                        else:
                            h = found["headers"]
                            payload = found.get("payload") if payloads and found["type"] == "response" else None
                            full = out.add(
                                len(payload or b""), path, start, end, found["type"], _page(h.get("warc-record-id")), h.get("warc-target-uri"),
                                payload, found.get("size"), found.get("digest"), _page(h.get("warc-refers-to")), None,
                            )
                        if full:
                            yield out.batch()
        yield out.batch()

    return run


def read_warc(spark: SparkSession, paths: DataFrame, folder: str, payloads: bool = True, longest: int = LONGEST) -> DataFrame:
    """Every record of the archives named in ``paths.path``, and a row for each quarantined byte gap.

    Gaps have record_type ``quarantine``, their byte range ``[start, end)`` and the
    failed check in ``damage``; whole records have null there. The records of one
    gzip member have its byte range, as do gaps inside it. An archive is read piece by
    piece; of a record or member of more than ``longest`` bytes only its payload is held, if
    ``payloads`` are asked for.
    """
    tasks = max(1, min(paths.count(), READ_TASKS))
    return paths.select("path").repartition(tasks).mapInArrow(released(_read(qualified(spark, folder), payloads, longest)), RECORDS)


def log_quarantine(records: DataFrame, folder: str) -> DataFrame:
    """The gaps among ``records`` (as ``read_warc`` gives them), written to ``folder`` and read again."""
    gaps = records.where(F.col("damage").isNotNull()).select("path", "start", "end", (F.col("end") - F.col("start")).alias("n_bytes"), "damage")
    gaps.write.mode("append").parquet(folder)
    return records.sparkSession.read.schema(gaps.schema).parquet(folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    written = write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, revisit_bytes=0)
    records = materialize(spark, read_warc(spark, written, folder, payloads=False), "warc-records")
    log_quarantine(records, f"{folder}-quarantine")
    wanted, found = written.agg(F.sum("n_records")).first()[0] or 0, records.where("damage is null").count()
    if wanted != found:
        raise ValueError(f"{wanted} records written, {found} read; gaps are in {folder}-quarantine")
    return records.where("damage is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# SHA-1 as base32: five hex digits are four letters
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hash, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
OP7_SQL = f"""
WITH body AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hash FROM pages
), last AS (
  SELECT html, max(page_id) AS first FROM body GROUP BY html
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM body JOIN last USING (html)
"""
