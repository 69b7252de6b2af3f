"""WARC archives written in shards, the same whatever the cluster: sorted by range, rolled by size, committed by a manifest.

Pages are put in order of (page_id, digest) and cut into shards at borders that depend on the
rows alone. Which page of equal payloads is the response is settled on narrow rows; those
decisions travel to the shards beside the pages, so payloads are exchanged once. Each shard is
written under temporary names; the manifest of the attempts that succeeded says which of them
take their final names, and only its own renaming makes the archives visible.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, shared_dir

LOW = -(1 << 63)
#: Payload bytes of a shard, shards at most (beyond them shards grow), and sampled places for each of them.
SHARD_BYTES, SHARDS, SAMPLED = 16 << 20, 4096, 256
#: Compressed bytes at which a file is closed.
ROLL_BYTES = 1 << 30
FILE = "shard int, seq int, path string, bytes long, records long, sha256 string"
DATE = "2024-01-01T00:00:00Z"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would use for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def storage(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a qualified path, as tasks see it, and the path in it."""
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pa.fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, digest: str, n: int) -> str:
    """The same for the same page at every run; n counts rows that share page_id and payload."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}|{n}'.encode()).digest()[:16], version=5)}>"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _lines(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def _uri(url: str | None, page_id: int | None) -> str:
    """A header holds no blanks and no ends of line; a page without URL is named by its id."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:x-page:{page_id}")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers: tuple[int | None] | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the page that `refers` holds: head and block, all digests and lengths made anew."""
    payload_digest = sha1(payload)
    http = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers else http + payload
    head = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, n)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers else None),
        ("WARC-Refers-To", record_id(refers[0], digest, 0) if refers else None), ("WARC-Page-Id", page_id), ("WARC-Refers-To-Page-Id", refers[0] if refers else None),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _lines("WARC/1.1", head) + block + b"\r\n\r\n"


def info_record(name: str, date: str = DATE) -> bytes:
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _lines("WARC/1.1", head) + block + b"\r\n\r\n"


def file_name(shard: int, seq: int) -> str:
    return f"warc-{shard:05d}-{seq:05d}.warc.gz"


class Roller:
    """Writes the records of one shard, each a gzip member, and closes a file once it reaches a size."""

    def __init__(self, top: str, shard: int, roll_bytes: int, level: int):
        self.fs, self.top = storage(top)
        self.shard, self.roll_bytes, self.level = shard, roll_bytes, level
        self.attempt, self.seq, self.out = uuid.uuid4().hex, 0, None
        self.fs.create_dir(f"{self.top}/_temporary", recursive=True)

    def _put(self, record: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        for data in (z.compress(record), z.flush()):
            self.out.write(data)
            self.hash.update(data)
            self.bytes += len(data)
        self.records += 1

    def write(self, record: bytes):
        """The file's row of the manifest, if this record closed it."""
        if self.out is None:
            self.path = f"{self.top}/_temporary/{self.attempt}-{self.seq:05d}.warc.gz"
            self.out = self.fs.open_output_stream(self.path, compression=None)
            self.hash, self.bytes, self.records = hashlib.sha256(), 0, 0
            self._put(info_record(file_name(self.shard, self.seq)))
        self._put(record)
        return self.close() if self.bytes >= self.roll_bytes else None

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.out, self.seq = None, self.seq + 1
        return self.shard, self.seq - 1, self.path, self.bytes, self.records, self.hash.hexdigest()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "seq", "path", "bytes", "records", "sha256"])


def heads(pages: DataFrame) -> DataFrame:
    """page_id, digest (SHA-256 of the payload), size, and place: text that sorts by page_id (null last), then by digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page_id, digest = F.col("page_id").cast("long"), F.sha2(payload, 256)
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(LOW))), 16, "0")
    place = F.concat(F.when(page_id.isNull(), F.lit("n" + "0" * 16)).otherwise(F.concat(F.lit("i"), number)), F.substring(digest, 1, 16))
    return pages.select(page_id.alias("page_id"), digest.alias("digest"), F.length(payload).cast("long").alias("size"), place.alias("place"), F.col("url").cast("string").alias("url"), payload.alias("payload"))


def borders(narrow: DataFrame, shard_bytes: int, most: int = SHARDS) -> list[str]:
    """First places of all shards but the first: equal shares of the bytes of places picked by their hash.

    About SAMPLED places for each shard are picked, whatever the partitions; how even shards are depends on
    them, what is written does not.
    """
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, min(most, -(-int(total) // shard_bytes)))
    if shards == 1:
        return []
    bar = min((1 << 63) - 1, (1 << 63) * SAMPLED * shards // n)
    picked = narrow.filter(F.shiftrightunsigned(F.xxhash64("place"), 1) <= F.lit(bar)).groupBy("place").agg(F.sum(F.col("size") + 1).alias("size"))
    picked = sorted((r["place"], r["size"]) for r in picked.collect())
    whole, upto, found = sum(s for _, s in picked), 0, []
    for place, size in picked:
        if upto * shards >= whole * (len(found) + 1) and place > (found[-1] if found else ""):
            found.append(place)
        upto += size
    return found


def shard_of(place, found: list[str]):
    """How many of the borders a place reaches; two short searches, 64 borders at a time."""
    if not found:
        return F.lit(0)
    reached = lambda all_, x: F.size(F.filter(all_, lambda b: b <= x))
    blocks = [found[i : i + 64] for i in range(0, len(found), 64)]
    full = [b[-1] for b in blocks if len(b) == 64]
    at = reached(F.split(F.lit(",".join(full)), ","), place) if full else F.lit(0)
    # behind the last full block stands one that no place reaches
    block = F.element_at(F.split(F.lit(";".join([*(",".join(b) for b in blocks), "~"])), ";"), at + 1)
    return (at * 64 + reached(F.split(block, ","), place)).cast("int")


def write_archives(spark: SparkSession, pages: DataFrame, out: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> str:
    """Write pages (page_id, url, html) as WARC files below `out`, and give back its qualified path.

    Of payloads of at least min_bytes that are equal, the page of the smallest page_id (of equal
    ones the first URL) is the response and all others revisit it; a null page_id comes last. A
    null html is an empty payload; a null or empty URL becomes one made of the page_id. Rows that
    share everything each have a record. An empty table gives a manifest without files. Other
    columns are not read. Files have the same names and bytes at every run over the same rows.
    Files without a place in the manifest belong to attempts that failed, and go.
    """
    ws = Workspace(spark)
    out = qualified(spark, out)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path
    fs = jpath(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath(f"{out}/_manifest")):
        raise FileExistsError(f"{out} holds archives already")
    rows = heads(pages)
    narrow = ws.table("heads", rows.select("page_id", "digest", "size", "place"))
    firsts = narrow.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = ws.table("firsts", firsts.filter("n > 1").select("digest", "first"))
    found = borders(narrow, shard_bytes)
    shard = shard_of(F.col("place"), found).alias("shard")
    settled = narrow.select("page_id", "digest", "place").join(firsts.hint("merge"), "digest").distinct()
    settled = settled.select(shard, "place", "digest", F.lit(0).alias("kind"), "page_id", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    every = rows.select(shard, "place", "digest", F.lit(1).alias("kind"), "page_id", F.lit(None).cast("long").alias("first"), "url", "payload")
    dealt = every.unionByName(settled).repartitionById(len(found) + 1, F.col("shard")).sortWithinPartitions("place", "digest", "kind", "url")

    def write(batches):
        roller, group, refers, n, shares = None, None, None, 0, False
        for b in batches:
            names = ("shard", "digest", "kind", "page_id", "first", "url", "payload")
            for shard_, digest, kind, page_id, first, url, payload in zip(*(b.column(c) for c in names)):
                digest, page_id = digest.as_py(), page_id.as_py()
                if group != (page_id, digest):
                    group, n, shares = (page_id, digest), 0, False
                if not kind.as_py():
                    shares, refers = True, first.as_py()
                    continue
                roller = roller or Roller(out, shard_.as_py(), roll_bytes, level)
                revisit = (refers,) if shares and (n or refers != page_id) else None
                closed = roller.write(page_record(page_id, url.as_py(), payload.as_py(), digest, n, revisit))
                n += 1
                if closed:
                    yield _rows([closed])
        if roller and (closed := roller.close()):
            yield _rows([closed])

    def commit(batches):
        """Temporary names become final ones; a second attempt finds its work done."""
        where, top = storage(out)
        for b in batches:
            done = []
            for r in b.to_pylist():
                final = f"{top}/{file_name(r['shard'], r['seq'])}"
                if where.get_file_info(r["path"]).type == pa.fs.FileType.File:
                    where.move(r["path"], final)
                if where.get_file_info(final).size != r["bytes"]:
                    raise OSError(f"{final} is not the file that was written")
                done.append((*(r[c] for c in ("shard", "seq")), file_name(r["shard"], r["seq"]), *(r[c] for c in ("bytes", "records", "sha256"))))
            yield _rows(done)

    files = ws.table("files", dealt.mapInArrow(write, FILE))
    staged = f"{out}/_manifest-{uuid.uuid4().hex}"
    files.mapInArrow(commit, FILE).write.json(staged)
    if not fs.rename(jpath(staged), jpath(f"{out}/_manifest")):
        raise OSError(f"the manifest of {out} could not be committed")
    fs.delete(jpath(f"{out}/_temporary"), True)
    return out


def members(stream, chunk: int = 1 << 20):
    """Offset and content of every gzip member of a stream, one at a time, and each raw chunk as it is read (as None, chunk)."""
    z, offset, parts, held = zlib.decompressobj(31), 0, [], 0
    while data := stream.read(chunk):
        yield None, data
        while data:
            parts.append(z.decompress(data))
            held += len(data) - len(z.unused_data)
            data = z.unused_data
            if z.eof:
                yield offset, b"".join(parts)
                offset, parts, held, z = offset + held, [], 0, zlib.decompressobj(31)
    if held:
        raise ValueError("a record is cut off")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (by lower-case name) and block of a record; lengths and digests have to hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    if not version.startswith("WARC/1.") or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("not a whole record")
    if fields.get("warc-block-digest", "") not in ("", f"sha1:{sha1(block)}"):
        raise ValueError("a block does not fit its digest")
    return fields, block


def read_archives(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, file and offset of every page record, and payload on demand (null for revisits).

    Only files of the manifest are read, each by one task, a record at a time; sizes, digests
    and counts are checked, and what does not fit is an error.
    """
    out = qualified(spark, out)
    manifest = spark.read.schema(FILE).json(f"{out}/_manifest")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        where, top = storage(out)
        for b in batches:
            for r in b.to_pylist():
                digest, n, rows, held = hashlib.sha256(), 0, [], 0
                with where.open_input_stream(f"{top}/{r['path']}", compression=None) as stream:
                    for offset, data in members(stream):
                        if offset is None:
                            digest.update(data)
                            continue
                        n += 1
                        fields, block = parsed(data)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                        kept = fields["warc-type"] == "response"
                        if kept and (len(payload) != size or fields["warc-payload-digest"] != f"sha1:{sha1(payload)}"):
                            raise ValueError(f"a payload of {r['path']} does not fit its digest")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        rows.append((number("warc-page-id"), size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], number("warc-refers-to-page-id"), fields["warc-target-uri"], r["path"], offset, payload if payloads and kept else None))
                        held += len(data) if payloads else 0
                        if len(rows) >= 1024 or held >= 8 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema)
                if n != r["records"] or digest.hexdigest() != r["sha256"]:
                    raise ValueError(f"{r['path']} is not as it was written")

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, payload binary"
    found = manifest.coalesce(1).repartition(max(1, manifest.count())).mapInArrow(read, kinds)
    return found if payloads else found.drop("payload")


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    out = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 takes five bits at a time: four letters of five hexadecimal digits.
OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first,
      row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS n FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
FROM d
"""
