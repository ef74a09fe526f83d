"""WARC archives and their capture index (operator 4).

Pages become WARC records; equal payloads are stored once and revisited by the others. Reading the
archives back gives one capture run per file, sorted by URL key and time. The runs are cut at common
key ranges, and each range is merged from its run slices by a loser tree; ranges follow each other,
so the whole index is in global order and numbered within each URL's history.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wheeltrace.llm.common import table
from wheeltrace.llm.registry import query
from wheeltrace.session import materialize, scratch_folder

LEAST_BYTES = 1000
FILE_RECORDS = 2000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, ts string, page_id string, record_type string, refers_to string, payload_bytes long, " \
    "payload_digest string, file string, start long, size long"


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload is stored with a larger page_id."""
    light = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    light = materialize(light.drop("n"), "digests")
    best = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialize(best.drop("n"), "stored")
    late = light.join(best, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return materialize(late.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")


def _field(name: str, value) -> list:
    return [F.lit(f"{name}: "), value if not isinstance(value, str) else F.lit(value), F.lit(CRLF)]


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               ts_col: str | None = None, least: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write one record per row as gzip WARC files into ``folder``.

    Payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least`` bytes
    those with the largest id are responses, the others revisits; null ids only revisit others.
    Rows without ``ts_col`` are dated by their id in seconds from 2020. Line breaks in a URL
    are dropped; a null URL is empty.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                      F.coalesce(F.col(html_col), F.lit("")).alias("html"),
                      (F.col(ts_col) if ts_col else F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(10**9)), F.lit(0)))).alias("at"))
    late = revisits(pages, least)
    rows = pages.withColumn("digest", F.sha1("html"))
    rows = rows.join(late, rows["page_id"].eqNullSafe(late["_id"]) & (rows["digest"] == late["_digest"]), "left")
    again = F.col("refers_to").isNotNull()
    size = F.octet_length("html").cast("string")
    block = F.when(again, F.lit("HTTP/1.1 200 OK" + CRLF * 2)).otherwise(F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2), F.col("html")))
    rows = rows.withColumn("block", block)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.lit(f"WARC/1.1{CRLF}"),
        *_field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        *_field("WARC-Record-ID", name("page_id")),
        *_field("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        *_field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        *_field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        *_field("WARC-Payload-Length", size),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name("refers_to"), F.lit(CRLF))).otherwise(""),
        *_field("Content-Type", "application/http; msgtype=response"),
        *_field("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block")]
    out = rows.select(F.concat(*head).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(folder)


def _index_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in INDEX.split(", "))])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, offset and size of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split(CRLF)[1:])
        size = int(fields["Content-Length"])
        block = data[stop + 4:stop + 4 + size]
        if len(block) != size:
            raise ValueError("truncated record")
        end = stop + 4 + size + 4
        yield fields, block, at, end - at
        at = end


def url_key(url: str) -> str:
    """Sort key: reversed host labels, then path and query."""
    rest = url.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].split("."))) + ")" + (slash + path if slash else "/")


def _capture(fields: dict[str, str], block: bytes) -> tuple:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":  # taken from the archive itself, and the header held against it
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
        n = len(payload)
    else:
        n = int(fields["WARC-Payload-Length"])
    ident = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
    refers = ident(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], ident(fields["WARC-Record-ID"]), kind, refers, n, digest


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One sorted run of captures per archive file."""
    schema = _index_schema()

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                archive = zlib.decompressobj(31).decompress(data.as_buffer())
                name = posixpath.basename(path)
                rows = [(*_capture(f, b), name, at, n) for f, b, at, n in records(archive)]
                rows.sort(key=_order)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).select("path", "content").where(F.length("content") > 0)
    return files.mapInArrow(run, INDEX)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] or ""


class LoserTree:
    """K-way merge of sorted lists: inner nodes keep the loser, so each step plays one path."""

    def __init__(self, runs: list[list[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None:
            return False
        return self.heads[b] is None or (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.loser[node]
            if other < 0:  # still empty while the tree is built: wait here
                self.loser[node] = winner
                return
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.loser[0]] is not None:
            i = self.loser[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None
            self._play(i)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Merge capture runs into one index in global order; adds ``seq`` and ``capture_no``.

    ``seq`` grows along (urlkey, ts, page_id as text); ``capture_no`` numbers the captures of a URL key
    from 1. The ranges hold whole (key, time, page) triples, so a key with very many captures is spread
    over several tasks; one task holds one range.
    """
    order = ["urlkey", "ts", "page_id"]
    placed = runs.repartitionByRange(*order, "start").sortWithinPartitions("file", *[F.asc_nulls_first(c) for c in order])

    def merge(batches):
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                slices.setdefault(row[7], []).append(row)
        if not slices:
            return
        rows, key, number = [], None, 0
        for row in LoserTree(list(slices.values()), _order):
            number = number + 1 if row[0] == key else 1
            key = row[0]
            rows.append((*row, number))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = _index_schema().append(pa.field("number", pa.int64()))
    merged = placed.mapInArrow(merge, INDEX + ", number long").withColumn("seq", F.monotonically_increasing_id())
    merged = materialize(merged, "index").withColumn("part", F.shiftright("seq", 33))
    # a key that goes on in the next range: at most two keys of a range are at its border
    ends = merged.groupBy("part").agg(F.min("urlkey").alias("a"), F.max("urlkey").alias("b"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("urlkey"))
    counts = merged.join(F.broadcast(ends), ["part", "urlkey"]).groupBy("part", "urlkey").count()  # two rows per range
    earlier = Window.partitionBy("urlkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("part", "urlkey", F.sum("count").over(earlier).alias("before"))
    out = merged.join(F.broadcast(carry), ["part", "urlkey"], "left")
    return out.withColumn("capture_no", F.col("number") + F.coalesce("before", F.lit(0))).drop("part", "number", "before")


def archive_pages(df: DataFrame, **columns) -> DataFrame:
    """Write pages as WARC into the shared folder, read the archives back, and merge their index.

    Columns: urlkey, ts, page_id, record_type, refers_to (as text), payload_bytes, payload_digest, file,
    start, size (place of the record in the uncompressed archive), seq, capture_no. One row per input
    row; an empty table gives an empty index; other columns of the input are not read.
    """
    spark = df.sparkSession
    folder = posixpath.join(scratch_folder(spark), f"warc-{uuid.uuid4().hex}")
    write_warc(df, folder, **columns)
    # written once: finding the ranges reads the runs too, and the archives should be opened once
    return merge_runs(materialize(capture_runs(spark, folder), "runs"))


@query("op4_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= {LEAST_BYTES} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN m.top IS NULL OR m.top = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.top <> d.page_id THEN m.top END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= {LEAST_BYTES}
""")
def op4_warc(spark, sf_dir) -> DataFrame:
    index = archive_pages(table(spark, sf_dir, "pages"))
    return index.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))
