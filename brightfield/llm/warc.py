"""Web archive derivatives: response records to linked metadata records and plain-text conversion records.

A record is a row ``record_id, warc_type, target_uri, date, refers_to, content_type, headers, block, block_digest,
payload_digest, damage``; ``headers`` is a map of the remaining named fields, ``block`` the bytes as they stand in the
archive, ``damage`` says what is wrong with a record (null: nothing). Files hold one gzip member a record, as readers of
archives expect.
"""

from __future__ import annotations

import gzip
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small_batches

RECORD = (
    "record_id string, warc_type string, target_uri string, date string, refers_to string, content_type string, "
    "headers map<string,string>, block binary, block_digest string, payload_digest string, damage string"
)
NAMES = [x.split()[0] for x in RECORD.split(", ")]
#: Character references that are decoded natively; texts with any other are decoded by the rules of HTML in Python.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def record_id(*parts: Column) -> Column:
    """A name-based identifier: the same parts give the same URN, in any run and partition."""
    h = F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)
    at = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-8"), at(14, 3), F.lit("-a"), at(18, 3), F.lit("-"), at(21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


_OTHER = rf"&(?!(?:{'|'.join(x[1:-1] for x in REFERENCES)});)[#A-Za-z]"
_WHITE = re.compile("[\\x09-\\x0D\\xA0]")


def _decode(text: str) -> str:
    """All character references decoded once; those of white space give a blank, as &nbsp; does."""
    return re.sub(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)", lambda m: _WHITE.sub(" ", entities.unescape(m[0])), text)


#: What goes from a page, in this order, and what comes in its place: comments, scripts and styles; runs of white space; block tags; other tags.
_STRIP = ((r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " "), (r"[\x20\x09-\x0D]+", " "), (rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n"), (r"<[^>]*>", ""))


def _bare(html: Column) -> Column:
    """The page without markup, its references as they are."""
    for pattern, put in _STRIP:
        html = F.regexp_replace(html, pattern, put)
    return html


@F.pandas_udf(StringType())
def _in_python(bare: pd.Series, body: pd.Series, charset: pd.Series) -> pd.Series:
    """Texts that the native way cannot read: given bare (references of any kind), or as bytes in some charset."""

    def read(text: str | None, raw: bytes | None, name: str | None) -> str | None:
        if raw is not None:
            try:
                text = raw.decode(name, errors="replace")
            except LookupError:  # no such charset
                text = raw.decode(errors="replace")
            for pattern, put in _STRIP:
                text = re.sub(pattern, put, text)
        return None if text is None else _decode(text)

    return pd.Series([read(*x) for x in zip(bare, body, charset, strict=True)], dtype=object)


def _read(bare: Column, body: Column | None = None, charset: Column | None = None) -> Column:
    """References decoded, blanks around line ends gone. Only texts with a reference beyond ``REFERENCES``, and those that
    come as bytes in a ``charset``, go to Python."""
    t = bare
    for name, char in REFERENCES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    none = F.lit(None)
    found = _in_python(F.when(bare.rlike(_OTHER), bare), none.cast("binary") if body is None else body, none.cast("string") if charset is None else charset)
    return F.trim(F.regexp_replace(F.coalesce(found, t), r" *\n[ \n]*", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """All text of the page: comments, scripts and styles go, block tags end lines, references are decoded, white space is folded."""
    return _read(_bare(html))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table (``page_id, url, html``); null html is an empty payload, null url an empty target."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.sha2(html.cast("binary"), 256)).alias("record_id"),
        F.lit("response").alias("warc_type"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.create_map(F.lit("WARC-Identified-Payload-Type"), F.lit("text/html")).alias("headers"),
        F.concat(http, html).cast("binary").alias("block"),
        digest(F.concat(http, html)).alias("block_digest"),
        digest(html).alias("payload_digest"),
        F.lit(None).cast("string").alias("damage"),
    )


def derivatives(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A metadata and a conversion record of every response record; other record types give none.

    Either refers to its source by ``refers_to`` and keeps the source's target, date and headers; the source's digests
    stand in ``headers`` as ``Source-Block-Digest`` and ``Source-Payload-Digest``. The metadata block lists the source
    header fields of the HTTP message and the counts of the text; the conversion block is the page's plain text with its
    header fields of the HTTP message and the counts of the text; the conversion block is the page's plain text with its
    own digests, read in the charset that the HTTP header names (UTF-8 without one; bytes that it cannot read become
    U+FFFD). Blocks are bytes, whole however long.

    Null blocks count as empty; repeated responses give repeated records; damaged ones give what could be read of them; an
    empty table gives none. ``keep`` names further columns to carry; where a name is one of a record's own, it comes as
    ``source_<name>``.
    """
    block = F.coalesce(F.col("block").cast("binary"), F.lit(b""))
    carried = [F.col(c).alias(f"source_{c}" if c in NAMES else c) for c in keep]
    given = F.struct(*carried, F.lit(0).alias("none")).alias("given")
    # a cast to string leaves the bytes as they are, and the head is what stands before the first empty line
    before = F.substring_index(block.cast("string"), "\r\n\r\n", 1).cast("binary")
    source = records.filter(F.col("warc_type") == "response").select(given, "record_id", "target_uri", "date", "headers", "block_digest", "payload_digest", block.alias("block"), before.alias("before"))
    cut_off = F.octet_length("before") < F.octet_length("block")
    head = F.when(cut_off, F.decode("before", "ISO-8859-1")).otherwise("")
    body = F.when(cut_off, F.substring("block", F.octet_length("before") + 5, F.octet_length("block"))).otherwise(F.col("block"))
    source = source.withColumn("head", head).withColumn("body", body).drop("block", "before")
    charset = F.lower(F.regexp_extract("head", r"(?im)^content-type:[^\r\n]*?charset=[\"']?([\w.:-]+)", 1))
    source = source.withColumn("charset", F.when(charset.isin("", "utf-8", "utf8", "us-ascii", "ascii"), F.lit(None)).otherwise(charset))
    utf8 = F.when(F.col("charset").isNull(), F.make_valid_utf8(F.col("body").cast("string"))).otherwise("")
    foreign = F.when(F.col("charset").isNotNull(), F.col("body"))
    source = source.withColumn("bare", _bare(utf8)).withColumn("text", _read(F.col("bare"), foreign, F.col("charset"))).drop("bare", "charset")
    linked = F.map_concat(
        F.coalesce(F.map_filter("headers", lambda k, v: ~k.startswith("Source-")), F.create_map().cast("map<string,string>")),
        F.create_map(
            F.lit("Source-Block-Digest"), F.coalesce("block_digest", F.lit("")), F.lit("Source-Payload-Digest"), F.coalesce("payload_digest", F.lit(""))
        ),
    )
    lines = F.split("head", "\r\n")
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("source-status: "), F.coalesce(F.get(lines, F.lit(0)), F.lit(""))),
        F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("source-header: "), x)),
        F.concat(F.lit("source-bytes: "), F.octet_length("body").cast("string")),
        F.concat(F.lit("text-chars: "), F.length("text").cast("string")),
        F.concat(F.lit("text-lines: "), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("string")),
        F.lit(""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = source.select("given", "target_uri", "date", F.col("record_id").alias("refers_to"), linked.alias("headers"), F.explode(kinds).alias("k"))
    own = digest(F.col("k.block"))
    return out.select(
        *(f"given.{c}" for c in [f"source_{c}" if c in NAMES else c for c in keep]),
        record_id(F.col("k.warc_type"), F.coalesce("refers_to", F.lit("")), own).alias("record_id"),
        F.col("k.warc_type").alias("warc_type"), "target_uri", "date", "refers_to", F.col("k.content_type").alias("content_type"), "headers",
        F.col("k.block").cast("binary").alias("block"), own.alias("block_digest"), own.alias("payload_digest"), F.lit(None).cast("string").alias("damage"),
    )


_FIELDS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Refers-To": "refers_to",
           "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest"}


def to_bytes(row: dict) -> bytes:
    """One record as it stands in a file, in a gzip member of its own."""
    body = bytes(row["block"] or b"")
    named = {k: row[v] for k, v in _FIELDS.items() if row[v]} | dict(row["headers"] or {})
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in named.items())
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n", mtime=0)


_BY_NAME = {k.lower(): v for k, v in _FIELDS.items()}


class Reader:
    """Records out of an archive's lines (bytes without the line feed), one after the other; it holds one record at most."""

    def __init__(self):
        self.row: dict | None = None
        self.lines: list[bytes] = []
        self.left = 0  # bytes of the block that are still to come; -1: no length was given
        self.in_head = False

    def line(self, line: bytes) -> dict | None:
        """The record that this line completes, if it does."""
        if self.row is None:
            if line.startswith(b"WARC/"):
                self.row, self.in_head, self.left, self.lines = dict.fromkeys(NAMES) | {"headers": {}}, True, -1, []
            return None
        if self.in_head:
            text = line.decode(errors="replace").strip()
            if text:
                self._field(text)
                return None
            self.in_head = False
            if self.left > 0:
                return None
            if self.left < 0:
                self.row["damage"] = "no length"
            return self._done()
        self.lines.append(line)
        self.left -= len(line) + 1
        return self._done() if self.left <= 0 else None

    def _field(self, text: str) -> None:
        name, _, value = text.partition(":")
        name, value = name.strip(), value.strip()
        if name.lower() == "content-length":
            self.left = int(value) if value.isascii() and value.isdigit() else -1
        elif name.lower() in _BY_NAME:
            self.row[_BY_NAME[name.lower()]] = value
        else:
            self.row["headers"][name] = value

    def _done(self) -> dict:
        row, block = self.row, b"\n".join([*self.lines, b""])
        # the line that ends the block goes on with the line end after the record
        row["block"] = block[: len(block) + self.left] if self.left < 0 and self.lines else block
        self.row, self.lines = None, []
        return row

    def close(self) -> dict | None:
        """What is left of a record when the archive ends inside it."""
        if self.row is None:
            return None
        self.row["damage"], self.left = ("head cut off" if self.in_head else "block cut off"), 0
        row = self._done()
        row["block"] = row["block"][:-1]  # the last line's feed may never have been there
        return row


def read_warc(spark, path: str, batch: int = 16 << 20) -> DataFrame:
    """Records of archive files, compressed (one gzip member a record, or any) or not, a task for each file.

    Spark's reader inflates and hands on lines, so a task holds one record and a batch of about ``batch`` bytes, however
    large the file is. A file that ends in the middle, or whose compressed bytes are damaged, gives all records before
    that place; the one it ends in has ``damage`` set. Bytes between records are skipped. An empty file gives no rows.
    """
    small_batches(spark, 100_000, "8m")
    lines = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))
    packed = F.lower("file").rlike(r"\.(gz|bz2|zst|deflate)$")
    # only files that are not compressed are read in parts: their lines come back together in order
    split = lines.filter(~packed).withColumn("n", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "block_start", "n").drop("n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, current = Reader(), None
        held: list[dict] = []
        size = 0
        for pdf in batches:
            for file, line in zip(pdf["file"], pdf["line"], strict=True):
                if file != current:
                    held += [x for x in [reader.close()] if x]
                    current = file
                if row := reader.line(line):
                    held.append(row)
                    size += len(row["block"])
                    if size >= batch:
                        yield pd.DataFrame(held, columns=NAMES)
                        held, size = [], 0
        held += [x for x in [reader.close()] if x]
        if held:
            yield pd.DataFrame(held, columns=NAMES)

    columns = ["line", "file"]
    return lines.filter(packed).select(columns).mapInPandas(run, RECORD).unionByName(split.select(columns).mapInPandas(run, RECORD))


def archive_members(records: DataFrame) -> DataFrame:
    """``record_id, member``: each record's bytes; a file of members one after the other is a valid archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pd.DataFrame({"record_id": pdf["record_id"], "member": [to_bytes(r) for r in rows]})

    small_batches(records.sparkSession)
    return records.select(*NAMES).mapInPandas(run, "record_id string, member binary")
