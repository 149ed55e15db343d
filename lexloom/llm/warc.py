"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing is native: Spark's text writer puts records down byte for byte, with the end
of a record as line separator, to any file system.

Reading doesn't trust the magic string: a payload may hold it. The files are scanned
as lines that end before `\\nWARC/1.`; each line that parses as a header is a
candidate, and its Content-Length says where its successor must start. Tasks emit
these record-to-successor offsets (no payload, if the record ends with its line).
A record is real if it is reachable from the file's start. Chains are first followed
inside segments of `SEGMENT` candidates; over the segments' entries, pointer jumping
doubles the reach of each link until none is left, so a file of n segments takes
log2(n) rounds. Last, each segment marks the chain behind its entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import cut, remove, rows, shared_dir, table

LEAST_SHARED = 100
SALT = 32
MOST_BROADCAST = 200_000
SEGMENT = 2048
RECORDS_PER_FILE = 20_000
MAGIC = "WARC/1."
_BREAK = "\n" + MAGIC
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, url string"


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_SHARED, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """`pages` as (page_id, url, payload, digest, first): first is the page that a revisit refers to, else null.

    Of equal payloads the smallest id is the response; rows that share it are all
    responses, rows with a null id are revisits where another has an id. Groups of equal
    payloads are aggregated to (digest, smallest id), which moves no payload. Up to
    `most_broadcast` of these groups (some 100 bytes each) are broadcast to the pages;
    more are joined by a shuffle under a salt, so that no payload's copies meet in one task."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), url.alias("url"), text.alias("payload"),
        F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("bigint").alias("size"),
    )
    shared = base.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.where("n > 1 and low is not null").select("digest", "low"))
    if shared.count() <= most_broadcast:
        joined = base.join(F.broadcast(shared), "digest", "left")
    else:
        salts = shared.select("digest", "low", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        joined = salted.join(salts, ["digest", "salt"], "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("low")), F.col("low"))
    return joined.select("page_id", "url", "payload", "digest", "size", other.alias("first"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record for each row of `pages`; null payloads are empty. Extra columns are not written."""
    nl = "\r\n"
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(nl))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), "[\\x00-\\x20\\x7F]", "%20")
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), "payload"))
    header = F.concat(
        F.lit(f"{MAGIC}1{nl}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    records = roles(pages, id_col, payload_col).select(F.concat(header, F.lit(nl), block).alias("value"))
    writer = records.write.option("lineSep", nl * 2).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


def _number(value: str | None) -> int | None:
    """The page of an urn; None for other ones."""
    body = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body.lstrip("-").isdigit() else None


def parse(head: bytes) -> dict[str, str] | None:
    """Fields of a record header by lower-case name, or None if it is none."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].removeprefix(MAGIC).isdigit():
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return None
        fields[name.lower()] = value.strip()
    return fields if fields.get("content-length", "").isdigit() and fields.get("warc-type") else None


def _digest_of(fields: dict[str, str], block: bytes) -> tuple[int, str]:
    """Length and SHA-256 of the payload: what follows the HTTP header of the block."""
    at = block.find(b"\r\n\r\n")
    payload = block[at + 4 :] if at >= 0 and fields.get("content-type", "").startswith("application/http") else block
    return len(payload), hashlib.sha256(payload).hexdigest()


def _record(fields: dict[str, str], block: bytes | None) -> dict:
    """Result columns of a record; a revisit's size and digest are those its header gives of the full payload."""
    kind = fields["warc-type"]
    size, digest = (None, None) if block is None else _digest_of(fields, block)
    named = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        length = fields.get("x-payload-length", "")
        size, digest = int(length) if length.isdigit() else None, named
    return {
        "page_id": _number(fields.get("warc-record-id")), "record_type": kind, "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "url": fields.get("warc-target-uri"),
    }


_LINE = f"file string, block bigint, nr bigint, size bigint, step bigint, {FIELDS}, intact boolean, whole boolean"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line: its number in the block, its size, the step to its successor if it is a candidate, and the
    record's columns if the record ends with the line (whole)."""
    names, schema = _names(_LINE), _schema(_LINE)
    where, nr = None, 0
    for batch in batches:
        out = []
        for file, block, value in zip(rows(batch, "file"), rows(batch, "block"), rows(batch, "value")):
            nr = nr + 1 if where == (file, block) else 0
            where = file, block
            row = dict.fromkeys(names) | {"file": file, "block": block, "nr": nr, "size": len(value)}
            magic = value if value.startswith(MAGIC.encode()) and block == 0 and nr == 0 else MAGIC.encode() + value
            lead = len(magic) - len(value)
            end = magic.find(b"\r\n\r\n")
            fields = parse(magic[:end]) if end >= 0 else None
            whole = False
            if fields:
                length = int(fields["content-length"])
                row["step"] = end + 4 + length + 4 - lead  # from the line's start to where the next record starts
                body = magic[end + 4 : end + 4 + length]
                tail = magic[end + 4 + length :]
                whole = len(body) == length and tail in (b"\r\n\r", b"\r\n\r\n")
                row |= _record(fields, body if whole else None)
                named = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                row["intact"] = not named or row["payload_digest"] == named
            out.append(row | {"whole": whole})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _names(fields: str) -> list[str]:
    return [x.split()[0] for x in fields.split(", ")]


def _schema(fields: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, nr, value), numbered as `_candidates` does."""
    where, nr = None, 0
    for batch in batches:
        numbers = []
        for key in zip(rows(batch, "file"), rows(batch, "block")):
            nr = nr + 1 if where == key else 0
            where = key
            numbers.append(nr)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(2)], ["file", "block", "nr", "value"])


def _walk(fn):
    """Wrap a function over one segment's Arrow table for applyInArrow."""
    return lambda t: fn(t.sort_by("at"))


def _exits(t: pa.Table) -> pa.Table:
    """Per candidate the place where its chain leaves the segment."""
    at, nxt = t.column("at").to_pylist(), t.column("nxt").to_pylist()
    out: dict[int, int] = {}
    for a, n in zip(reversed(at), reversed(nxt)):
        out[a] = out.get(n, n)
    return pa.table({"file": t.column("file"), "segment": t.column("segment"), "at": t.column("at"), "exit": pa.array([out[a] for a in at], pa.int64())})


def _marks(t: pa.Table) -> pa.Table:
    """The candidates on the chains behind the segment's entries."""
    at, nxt, entry = (t.column(c).to_pylist() for c in ("at", "nxt", "entry"))
    link, real = dict(zip(at, nxt)), set()
    for a, e in zip(at, entry):
        while e and a in link and a not in real:
            real.add(a)
            a = link[a]
    keep = sorted(real)
    return pa.table({"file": pa.array([t.column("file")[0].as_py()] * len(keep), pa.string()), "at": pa.array(keep, pa.int64())})


def reachable(links: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(file, at) of the records on the chain from each file's start, from candidates (file, at, nxt).

    Offsets ascend along a chain. Segments hold `segment` candidates of a file."""
    order = Window.partitionBy("file", "block").orderBy("at")
    seg = F.concat_ws(":", "block", F.floor((F.row_number().over(order) - 1) / segment).cast("string"))
    links = cut(links.withColumn("segment", seg).select("file", "segment", "at", "nxt"))
    exits = cut(links.groupBy("file", "segment").applyInArrow(_walk(_exits), "file string, segment string, at bigint, exit bigint"))
    # Nodes: file starts, and candidates at which some chain enters a segment.
    entries = exits.select("file", F.col("exit").alias("at")).distinct()
    nodes = exits.join(entries, ["file", "at"], "left_semi").unionByName(exits.where("at = 0")).distinct()
    jump = cut(nodes.select("file", "at", F.col("exit").alias("to")))
    real = jump.where("at = 0").select("file", "at").distinct()
    while not jump.isEmpty():
        more = real.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        real = cut(real.union(more).distinct())
        second = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(second, ["file", "to"]).select("file", "at", F.col("then").alias("to")))
    marked = links.join(real.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "segment").applyInArrow(_walk(_marks), "file string, at bigint")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives at `path`: file, at, page_id, record_type, refers_to, payload_bytes, payload_digest, url, intact.

    Compressed files (.gz) are read whole by a task, others in splits. Offsets are
    those of the uncompressed bytes. A record cut off at the end of a file has
    intact false; a file that starts with no record gives none. payload_digest is
    computed from the payload, but for revisits, whose header names it."""
    lines = spark.read.option("lineSep", _BREAK).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    found = cut(lines.mapInArrow(_candidates, _LINE))
    gap = len(_BREAK)
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + gap).alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("file", "block").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inner", F.coalesce(F.sum(F.col("size") + gap).over(inner), F.lit(0))).join(cut(bases), ["file", "block"])
    # `text_at` is where the line starts, `at` where its record does: the magic string before it belongs to the record
    text_at = F.col("base") + F.col("inner")
    at = F.when(text_at == 0, F.lit(0)).otherwise(text_at - len(MAGIC))
    placed = cut(placed.withColumns({"text_at": text_at, "at": at, "nxt": text_at + F.col("step")}).drop("inner", "base"))
    real = cut(reachable(placed.where("step is not null").select("file", "block", "at", "nxt")))
    known = placed.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    known = cut(known)
    whole = known.where("real and whole").select("file", "at", *_names(FIELDS), "intact")
    odd = known.where("real and not whole")
    return whole if odd.isEmpty() else whole.unionByName(_pieced(known, lines))


def _pieced(known: DataFrame, lines: DataFrame) -> DataFrame:
    """Records whose payload holds the magic string: their lines are read again and put together.

    Only lines of such records are gathered, and of each record its own ones."""
    order = Window.partitionBy("file").orderBy("text_at").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("real"), F.struct("at", "nxt", "whole")), ignorenulls=True).over(order)
    odd = known.where("real and not whole").select("file").distinct()
    inside = known.join(odd, "file", "left_semi").withColumn("own", own).where("not own.whole and text_at <= own.nxt")
    keys = inside.select("file", "block", "nr", "text_at", F.col("own.at").alias("start"))
    again = lines.mapInArrow(_numbered, "file string, block bigint, nr bigint, value binary")
    parts = again.join(cut(keys), ["file", "block", "nr"]).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("text_at", "value"))).alias("parts"))
    fields_out = f"file string, at bigint, {FIELDS}, intact boolean"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, at, pieces in zip(rows(batch, "file"), rows(batch, "start"), rows(batch, "parts")):
                data = _BREAK.encode().join(p["value"] for p in pieces)
                data = data if at == 0 and data.startswith(MAGIC.encode()) else MAGIC.encode() + data
                end = data.find(b"\r\n\r\n")
                fields = parse(data[:end])
                length = int(fields["content-length"])
                body = data[end + 4 : end + 4 + length]
                row = _record(fields, body)
                named = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                out.append({"file": file, "at": at} | row | {"intact": len(body) == length and (not named or named == row["payload_digest"])})
            yield pa.RecordBatch.from_pylist(out, schema=_schema(fields_out))

    return parts.mapInArrow(build, fields_out)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every row of `pages`, written, read back and digested; the archives are removed.

    A null html is an empty payload; rows that share a page_id give a record each; an empty table gives no rows."""
    path = shared_dir(spark)
    write(table(spark, sf_dir, "pages"), path)
    found = cut(read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"))
    remove(spark, path)
    return found


def oracle_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
m AS (SELECT s, min(page_id) AS low FROM d WHERE n >= {LEAST_SHARED} GROUP BY s)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to, true AS intact
FROM d LEFT JOIN m USING (s)"""
