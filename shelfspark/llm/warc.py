"""WARC archives: writing, the monolithic gzip normaliser and reading by offset.

``write_monolithic`` lets Spark's text writer gzip whole files of WARC records, one
stream per file. ``normalise`` inflates each such stream once, rewrites every record as
a gzip member of its own and leaves an offset index beside the archive.
``read_members`` then reads single records by their offsets.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import scratch_path

MIN_PAYLOAD = 1000
RECORDS_PER_FILE = 20_000
LEVEL = 4
CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "archive string, seq bigint, offset bigint, length bigint, record_id string, record_type string"
READ = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "target_uri string, payload binary"
)


def payload_roles(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to``.

    Among equal payloads of ``min_payload`` bytes or more the row with the largest page_id
    is the response and the others revisit it; smaller payloads are all responses. Rows
    that repeat the largest page_id are all responses; a null page_id is a response only
    where no row with an id has that payload. A null html is the empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    digested = rows.withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))}
    )
    tops = (
        digested.where(F.col("payload_bytes") >= min_payload)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("top"), F.count("*").alias("copies"))
        .where("copies > 1 AND top IS NOT NULL")
        .select("payload_digest", "top")
    )
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return digested.join(tops, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit & (F.col("payload_bytes") >= min_payload), "revisit").otherwise("response").alias("record_type"),
        F.when(revisit & (F.col("payload_bytes") >= min_payload), F.col("top")).alias("refers_to"),
    )


def _record(date: str) -> Column:
    """The text of a record up to, not including, the two line ends that close it."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # Control characters and blanks of a URL would break the header.
    url = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), page)), r"[\x00-\x20\x7F]", "_")
    ident = F.md5(F.concat_ws(":", page, "payload_digest").cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(ident, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", page)).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        )).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_monolithic(
    roles: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Write the rows of ``payload_roles`` as WARC files, each gzipped as one stream.

    A file holds at most ``records_per_file`` records, so that its size stays bounded.
    """
    roles.select(_record(date).alias("value")).write.option("compression", "gzip").option(
        "lineSep", CRLF + CRLF
    ).option("maxRecordsPerFile", records_per_file).text(folder)


def inflate(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The inflated stream in pieces; further gzip members of the file follow on."""
    unpack = zlib.decompressobj(31)
    for at in range(0, len(raw), step):
        piece = raw[at : at + step]
        while piece:
            out = unpack.decompress(piece)
            if out:
                yield out
            piece = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            else:
                piece = b""
    tail = unpack.flush()
    if tail:
        yield tail


def head_fields(head: bytes) -> dict[str, str]:
    """Header lines of a record; names in lower case."""
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, the record's bytes with its closing line ends) of a stream of records.

    Holds one record at a time. A stream that ends within a record raises ValueError.
    """
    buffer, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        piece = next(pieces, None)
        if piece is None:
            done = True
        else:
            buffer.extend(piece)
        return not done

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if buffer.strip():
                raise ValueError("the stream ends within a record's header")
            return
        fields = head_fields(bytes(buffer[:end]))
        total = end + 4 + int(fields["content-length"]) + 4
        while len(buffer) < total and more():
            pass
        if len(buffer) < total or buffer[total - 4 : total] != b"\r\n\r\n":
            raise ValueError("a record's block does not end where its length says")
        yield fields, bytes(buffer[:total])
        del buffer[:total]


def member(record: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrite every gzipped WARC file in ``source`` into ``target``; return the offset index.

    ``target`` must be reachable from every executor. Each archive ``x.warc.gz`` has one
    gzip member per record and beside it ``x.idx`` with a line of seq, offset, length,
    record id and type for each. The index of all archives also is a table in
    ``target``/index (``archive, seq, offset, length, record_id, record_type``), which is
    returned. Archives are written under another name and then moved, so a task that runs
    again replaces what it left. A file without records gives an empty archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc")
                rows, offset = [], 0
                hidden = f"{base}/archives/_{name}-{hashlib.sha1(path.encode()).hexdigest()[:8]}"
                with store.open_output_stream(f"{hidden}.warc") as out:
                    for seq, (fields, record) in enumerate(records(inflate(content.as_py()))):
                        packed = member(record, level)
                        out.write(packed)
                        rows.append(
                            (f"{name}.warc.gz", seq, offset, len(packed), fields.get("warc-record-id"), fields.get("warc-type"))
                        )
                        offset += len(packed)
                with store.open_output_stream(f"{hidden}.index", compression=None) as out:
                    out.write("".join("\t".join(map(str, x[1:])) + "\n" for x in rows).encode())
                for made, wanted in ((f"{hidden}.warc", f"{name}.warc.gz"), (f"{hidden}.index", f"{name}.idx")):
                    wanted = f"{base}/archives/{wanted}"
                    if store.get_file_info(wanted).type != fs.FileType.NotFound:  # left by an earlier attempt
                        store.delete_file(wanted)
                    store.move(made, wanted)
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["archive", "seq", "offset", "length", "record_id", "record_type"],
                )

    _make_folder(spark, f"{target}/archives")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    files.mapInArrow(run, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def parse_page(record: bytes) -> tuple:
    """The columns of ``READ`` from a record; a response's payload is held against its digest."""
    end = record.index(b"\r\n\r\n")
    fields = head_fields(record[:end])
    block = record[end + 4 : end + 4 + int(fields["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    kind, told = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    told = base64.b32decode(told).hex() if len(told) == 32 else told
    size = int(fields.get("x-payload-length", len(payload)))
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if told and found != told:
            raise ValueError(f"digest of record {fields.get('warc-record-id')} does not hold")
        told, size = found, len(payload)
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
    return (
        None if page is None else int(page), size, told, kind, None if refers is None else int(refers),
        fields.get("warc-target-uri"), payload if kind == "response" else None,
    )


def read_members(index: DataFrame, target: str, payload: bool = False) -> DataFrame:
    """Read each record of the index by its offset; columns of ``READ``, the payload only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        opened, handle = None, None
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = []
                for name, offset, length in zip(*(c.to_pylist() for c in batch.slice(part, 256).columns), strict=True):
                    if name != opened:
                        handle = store.open_input_file(f"{base}/archives/{name}")
                        opened = name
                    handle.seek(offset)
                    got = parse_page(zlib.decompress(handle.read(length), 31))
                    rows.append(got if payload else (*got[:6], None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = [x.split()[0] for x in READ.split(", ")]
                columns: list[Callable] = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return index.select("archive", "offset", "length").mapInArrow(run, READ)


def archive_pages(pages: DataFrame, target: str | None = None, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives below ``target`` and read them back.

    One row per row of ``pages``: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri``. Empty table: no rows. Repeated rows are records of their own.
    Other columns of ``pages`` play no part. ``target`` is a new folder, by default below
    the shared one.
    """
    spark = pages.sparkSession
    target = target or scratch_path(spark, "warc")
    if "://" not in target and target.startswith("file:"):
        target = "file://" + target.removeprefix("file:")
    write_monolithic(payload_roles(pages, min_payload), f"{target}/monolithic")
    index = normalise(spark, f"{target}/monolithic", target)
    return read_members(index, target).drop("payload")
