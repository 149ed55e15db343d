"""JSON lines with strict records: encode and decode requests, and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import RecordError
from lexloom.plans import frame
from lexloom.plans.tokenizer import Tokenizer

MOST_BYTES = 8 << 20
FIELDS = {"encode": "text string, pair string", "decode": "ids array<bigint>"}


def read(spark: SparkSession, path: str, kind: str = "encode", most_bytes: int = MOST_BYTES) -> DataFrame:
    """record (1 and up, in the order of the lines of all files), id (JSON text, null if absent) and the fields of the kind.

    A line that is blank, longer than `most_bytes`, no JSON object, lacks a field or
    has one that is not known fails with the number of the first such record."""
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return check(numbered(placed), kind, most_bytes)


def numbered(placed: DataFrame) -> DataFrame:
    """(line, file, at) with record: counts per partition are summed up, so no single task sorts all lines."""
    from pyspark.sql import Window

    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))  # a row a partition
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(bases), "part").select("line", (F.col("base") + inside + 1).alias("record"))


def check(lines: DataFrame, kind: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    names = ["id", *(f.split()[0] for f in FIELDS[kind].split(", "))]
    needed = "text" if kind == "encode" else "ids"
    keys = F.json_object_keys("line")
    unknown = F.array_except(keys, F.array(*map(F.lit, names)))
    value = F.from_json("line", FIELDS[kind])
    id_value = F.get_json_object("line", "$.id")
    raw = F.when(F.array_contains(keys, "id"), F.to_json(F.try_variant_get(F.try_parse_json("line"), "$.id", "variant")))
    fault = (
        F.when(F.octet_length("line") + 1 > most_bytes, F.lit("is too long"))
        .when(F.trim("line") == "", F.lit("is blank"))
        .when(F.try_parse_json("line").isNull() | keys.isNull(), F.lit("is no JSON object"))
        .when(F.size(unknown) > 0, F.concat(F.lit("has unknown fields: "), F.array_join(unknown, ", ")))
        .when(value[needed].isNull(), F.lit(f"has no {needed}"))
    )
    fault = fault if kind == "encode" else fault.when(F.exists(value["ids"], lambda i: i.isNull() | (i < 0)), F.lit("has bad ids"))
    found = lines.select("record", F.array_contains(keys, "id").alias("has_id"), F.coalesce(raw, F.when(F.array_contains(keys, "id"), F.coalesce(id_value, F.lit("null")))).alias("id"), value.alias("v"), fault.alias("fault"))
    bad = found.where("fault is not null").orderBy("record").select("record", "fault").first()
    if bad is not None:
        raise RecordError(f"record {bad[0]} {bad[1]}")
    return found.select("record", "id", *(F.col("v")[n].alias(n) for n in names[1:]))


def _line(id_json: Column, body: Column) -> Column:
    """One object; the id is echoed as it was written, and left out if there was none."""
    inner = F.substring(F.to_json(body), F.lit(2), F.length(F.to_json(body)))
    return F.when(id_json.isNull(), F.to_json(body)).otherwise(F.concat(F.lit('{"id":'), id_json, F.lit(","), inner))


def encode_batch(records: DataFrame, tokenizer: Tokenizer, add_special_tokens: bool = True, ignore_settings: bool = False, char_offsets: bool = False) -> DataFrame:
    """(record, line) with an encoding for each record, in JSON; one that can't be encoded fails the job with its number."""
    t = tokenizer.bare() if ignore_settings else tokenizer
    kept = ["record", "id"]
    fields = [f.split()[0] for f in frame.ENCODING.split(", ")]
    made = []
    for pair in (None, "pair"):
        part = records.where(F.col("pair").isNull() if pair is None else F.col("pair").isNotNull())
        made.append(frame.encode(part, t, "text", pair, kept, add_special_tokens, "char" if char_offsets else "byte", errors=True))
    fault = F.raise_error(F.concat(F.lit("record "), F.col("record").cast("string"), F.lit(": "), F.col("error")))
    both = made[0].unionByName(made[1]).withColumn("ids", F.when(F.col("error").isNotNull(), fault.cast("array<bigint>")).otherwise(F.col("ids")))
    offsets = F.transform("offsets", lambda o: F.array(o["start"], o["end"]))
    body = F.struct(F.struct(*(offsets.alias(f) if f == "offsets" else F.col(f) for f in fields)).alias("encoding"))
    return both.select("record", _line(F.col("id"), body).alias("line"))


def decode_batch(records: DataFrame, tokenizer: Tokenizer, skip_special_tokens: bool = True) -> DataFrame:
    """(record, line) with the text of each record; an unknown id is an error."""
    texts = frame.decode(records, tokenizer, "ids", ["record", "id"], skip_special_tokens, strict=True)
    return texts.select("record", _line(F.col("id"), F.struct("text")).alias("line"))


def write(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines in the order of their records, by ranges; files sort by name."""
    lines.repartitionByRange("record").sortWithinPartitions("record").select("line").write.mode(mode).text(path)
