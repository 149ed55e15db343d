"""Tokenizers over DataFrames: encode, decode, count, train, budget.

Encoding is one narrow pass: the tokenizer is broadcast, built once a worker, and only
the columns it reads go to Python, in Arrow batches. Truncation windows, padding and
templates have native forms in `lexloom.functions.columns` for ids that are columns
already."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lexloom.errors import ConfigError, LexloomError, RecordError
from lexloom.functions import columns, plain
from lexloom.functions.align import Aligned
from lexloom.functions.memo import portions
from lexloom.operators.encoding import Encoding
from lexloom.plans.flat import Unfit
from lexloom.plans.tokenizer import Tokenizer, row_error

ENCODING = (
    "ids array<bigint>, tokens array<string>, offsets array<struct<start:int,end:int>>, type_ids array<int>, word_ids array<int>, "
    "special_tokens_mask array<int>, attention_mask array<int>, sequence_ids array<int>"
)


#: Bytes of text that encoding works on at once, and tokens that its kernel holds as Python objects before it hands them on.
PORTION = 1 << 18
TOKENS = 1 << 14
#: Bytes of text, or of ids at eight bytes each, that the passes of strings and ids work on at once.
STRINGS, IDS = 1 << 20, 4 << 20


def _batches(df: DataFrame, names: dict[str, str], fn: Callable[[dict[str, list], int], Iterator[tuple[list[int], list[pa.Array]]]], fields: str, keep: list[str]) -> DataFrame:
    """Rows from `fn` over portions of the named columns, as Arrow columns beside the number of the row that each belongs to; `keep` columns ride along.

    `fn` gets the columns of a portion and where it starts in its batch."""
    packed = df.select(*([F.struct(*keep).alias("__row")] if keep else []), *(F.col(c).alias(n) for n, c in names.items()))
    row_type = packed.schema["__row"].dataType.simpleString() if keep else ""
    full = f"__row {row_type}, {fields}" if keep else fields
    out_schema = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in portions(batch, list(names), PORTION):
                for rows, columns in fn({n: part.column(part.schema.get_field_index(n)).to_pylist() for n in names}, start):
                    if keep:
                        columns = [part.column(0).take(pa.array(rows, pa.int32())).cast(out_schema.field(0).type), *columns]
                    yield pa.RecordBatch.from_arrays(columns, names=out_schema.names)
                start += part.num_rows

    out = packed.mapInArrow(run, full)
    return out.select("__row.*", *(c for c in out.columns if c != "__row")) if keep else out


def _gathered(found: Iterator[tuple[int, int, dict]], schema: pa.Schema) -> Iterator[tuple[list[int], list[pa.Array]]]:
    """(row, size, fields) as Arrow columns, handed on whenever `TOKENS` have come together."""
    rows, fields, size = [], [], 0
    for k, n, row in found:
        rows.append(k)
        fields.append(row)
        size += n
        if size >= TOKENS:
            yield rows, pa.RecordBatch.from_pylist(fields, schema=schema).columns
            rows, fields, size = [], [], 0
    if rows:
        yield rows, pa.RecordBatch.from_pylist(fields, schema=schema).columns


#: Bytes of input, as the optimizer estimates them, below which `spread` deals rows anew.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores, if it is small: a file with one row group is read by one task, whatever the cores.

    A large table has row groups enough and stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def _row(e: Encoding, fields: list[str] | None = None) -> dict:
    own = {"offsets": lambda: [{"start": a, "end": b} for a, b in e.offsets], "sequence_ids": e.sequence_ids}
    return {c: own[c]() if c in own else getattr(e, c) for c in ([f.split()[0] for f in ENCODING.split(", ")] if fields is None else fields)}


def _flat(e: Encoding, path: list[int]) -> Iterator[tuple[list[int], Encoding]]:
    yield path, e
    for k, o in enumerate(e.overflowing):
        yield from _flat(o, [*path, k])


def encode(
    df: DataFrame, tokenizer: Tokenizer, text: str = "text", pair: str | None = None, keep: list[str] | None = None,
    add_special_tokens: bool = True, offsets: str = "byte", overflow: bool = False, errors: bool = False, fields: list[str] | None = None,
) -> DataFrame:
    """`keep` columns and an encoding per row; with `overflow` a row per window, told by `path` ([] is the main one).

    text and pair are strings, or arrays of words; null texts count as empty. A row that
    cannot be encoded fails the job, or with `errors` comes with its fault in the column
    `error` and null in the others. Of an encoding's columns only `fields` are made, if they
    are given. Batch-longest padding needs a batch, so it is not applied here: see `pad`."""
    bare = tokenizer.with_padding(None) if tokenizer.padding and not isinstance(tokenizer.padding.strategy, dict) else tokenizer
    shared = df.sparkSession.sparkContext.broadcast(bare)
    keep = [c for c in df.columns if c not in (text, pair)] if keep is None else keep
    kinds = dict(f.split(" ", 1) for f in ENCODING.split(", "))
    own = list(kinds) if fields is None else [c for c in kinds if c in fields]
    clash = set(keep) & {"path", "error", *own}
    if clash:
        raise ConfigError(f"columns {sorted(clash)} would clash with those of an encoding; rename or leave them out of keep")
    if fields is not None and set(fields) - kinds.keys():
        raise ConfigError(f"an encoding has no {sorted(set(fields) - kinds.keys())}")
    wanted = [*(["path"] if overflow else []), *own, *(["error"] if errors else [])]
    full = ", ".join(f"{c} {({'path': 'array<int>', 'error': 'string'} | kinds)[c]}" for c in wanted)
    schema = to_arrow_schema(_parse_datatype_string(full))

    def by_kernel(texts: list, seconds: list | None, start: int) -> Iterator[tuple[int, int, dict]]:
        for k, a in enumerate(texts):
            try:
                e = shared.value.encode(a, seconds[k] if seconds else None, add_special_tokens, offsets)
            except LexloomError as error:
                if not errors:
                    raise row_error(f"{start + k} of its batch ({str(a)[:40]!r})", error) from error
                yield k, 1, {"path": [], "error": str(error)}
                continue
            for path, part in _flat(e, []) if overflow else [([], e)]:
                yield k, len(part), {"path": path} | _row(part, own)

    def run(got: dict[str, list], start: int) -> Iterator[tuple[list[int], list[pa.Array]]]:
        texts = ["" if x is None else x for x in got["text"]]
        seconds = ["" if x is None else x for x in got["pair"]] if pair else None
        arrays = shared.value.arrays()
        if arrays is not None:
            try:
                rows, found = arrays.columns(texts, seconds, add_special_tokens, offsets, overflow, wanted)
                return iter([(rows, [found[c] for c in wanted])])
            except (Unfit, LexloomError):  # the kernel does these texts, or tells which of them is at fault
                pass
        return _gathered(by_kernel(texts, seconds, start), schema)

    return _batches(df, {"text": text} | ({"pair": pair} if pair else {}), run, full, keep)


def ids_column(df: DataFrame, tokenizer: Tokenizer, text: str = "text", add_special_tokens: bool = True, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns and ids alone: no offsets, tokens or masks cross to the JVM."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    keep = [c for c in df.columns if c != text] if keep is None else keep

    packed = df.select(F.struct(*(keep or [F.lit(0)])).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, "text", IDS)):
            texts = part.column(1).fill_null("").to_numpy(zero_copy_only=False)
            ids, ends = shared.value.ids_batch(texts, add_special_tokens)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["row", "ids"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<bigint>")
    return out.select("row.*", "ids") if keep else out.select("ids")


def numbered(df: DataFrame, names: list[str], tokens: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns and ids: the place in `names` of each of the tokens, null for one that isn't there; a null array stays null."""
    shared = df.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))
    keep = [c for c in df.columns if c != tokens] if keep is None else keep
    packed = df.select(F.struct(*(keep or [F.lit(0)])).alias("row"), F.col(tokens).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, "tokens", IDS)):
            lists = part.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.index_in(lists.flatten(), value_set=shared.value).cast(pa.int64())
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, ids, mask=lists.is_null())], ["row", "ids"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<bigint>")
    return out.select("row.*", "ids") if keep else out.select("ids")


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", keep: list[str] | None = None, skip_special_tokens: bool = True, strict: bool = False, out: str = "text") -> DataFrame:
    """`keep` columns and the text of each array of ids; a null array gives an empty text; unknown ids drop out, or fail the job if `strict`."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    keep = [c for c in df.columns if c not in (ids, out)] if keep is None else keep
    packed = df.select(F.struct(*(keep or [F.lit(0)])).alias("row"), F.col(ids).cast("array<bigint>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, "ids", IDS)):
            t, lists = shared.value, part.column(1)
            flat, whole = lists.flatten(), lists.null_count == 0
            text = None
            if not strict and whole and flat.null_count == 0:
                ends = lists.offsets.to_numpy().astype(np.int64)
                found = flat.to_numpy(), ends - ends[0], skip_special_tokens
                text = t.decode_lists(*found)
                text = t.decode_fused(*found) if text is None else text
            if text is None:
                text = pa.array([t.decode([i for i in x or [] if i is not None], skip_special_tokens, strict) for x in lists.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), text], ["row", out])

    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {out} string")
    return found.select("row.*", out) if keep else found.select(out)


def count(df: DataFrame, tokenizer: Tokenizer, text: str = "text", keep: list[str] | None = None, add_special_tokens: bool = True, settings: bool = False) -> DataFrame:
    """`keep` columns and token_count, with truncation and padding off unless `settings`."""
    found = ids_column(df, tokenizer if settings else tokenizer.bare(), text, add_special_tokens, keep)
    return found.withColumn("token_count", F.size("ids").cast("bigint")).drop("ids")


def pad(df: DataFrame, tokenizer: Tokenizer, batch: str | Column) -> DataFrame:
    """Pad encodings to the longest of each batch, or to the fixed length; `batch` names what rows are padded together."""
    how = tokenizer.padding
    if how is None:
        return df
    if isinstance(how.strategy, dict):
        size = F.lit(how.strategy["Fixed"])
    else:
        main = F.size("path") == 0 if "path" in df.columns else F.lit(True)
        # overflow is padded along, but doesn't set the length
        size = F.max(F.when(main, F.size("ids"))).over(Window.partitionBy(batch))
    if (k := how.pad_to_multiple_of):
        size = F.ceil(size / k) * k
    fill = {"ids": how.pad_id, "tokens": how.pad_token, "type_ids": how.pad_type_id, "word_ids": None, "special_tokens_mask": 1, "attention_mask": 0, "sequence_ids": None}
    df = df.withColumn("__size", size.cast("int"))
    kinds = dict(df.dtypes)
    side = how.direction.lower()
    made = {c: columns.padded(F.col(c), F.col("__size"), v, side).cast(kinds[c]) for c, v in fill.items()}
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    n = F.greatest(F.col("__size") - F.size("offsets"), F.lit(0))
    more = F.array_repeat(zero, n)
    made["offsets"] = F.concat("offsets", more) if side == "right" else F.concat(more, F.col("offsets"))
    return df.withColumns(made).drop("__size")


def batches_of(df: DataFrame, order: str, size: int) -> Column:
    """A batch key of `size` consecutive rows by `order`. One global order needs one task: use a column of your own at scale."""
    return F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size)


def vocab_frame(df: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(token, id) of a tokenizer's vocabulary, added tokens included."""
    rows = sorted(tokenizer.vocab().items(), key=lambda x: (x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "token string, id bigint")


#: Rows of a vocabulary that are broadcast; a larger one is joined by a shuffle. A row costs some 100 bytes.
MOST_BROADCAST = 2_000_000


def _near(df: DataFrame) -> DataFrame:
    """`df` to be broadcast, if it has no more than `MOST_BROADCAST` rows."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def word_level_ids(words: DataFrame, vocab: DataFrame, unk_id: int, word: str = "word") -> DataFrame:
    """`words` with the id of each word: a vocabulary join, by broadcast as far as its size allows that."""
    known = vocab.select(F.col("token").alias(word), "id")
    return words.join(_near(known), word, "left").withColumn("id", F.coalesce("id", F.lit(unk_id)))


def unknown_ids(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids") -> DataFrame:
    """Rows of (id) that no token has; empty, if all decode."""
    known = vocab_frame(df, tokenizer).select("id")
    return df.select(F.explode(ids).alias("id")).distinct().join(_near(known), "id", "left_anti")


def normalized(df: DataFrame, tokenizer: Tokenizer, text: str = "text", keep: list[str] | None = None, out: str = "normalized") -> DataFrame:
    """`keep` columns and each text as the normalizer leaves it; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    packed = df.select(F.struct(*(keep or [F.lit(0)])).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        step = plain.normalizer(t.specs["normalizer"]) or t.normalize
        for part in (p for batch in batches for p in portions(batch, "text", STRINGS)):
            texts = [None if x is None else step(x) for x in part.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", out])

    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {out} string")
    return found.select("row.*", out) if keep else found.select(out)


def splits(df: DataFrame, tokenizer: Tokenizer, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, pos, piece and the range of the original in characters that it stands for, after normalizing and splitting."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    keep = [c for c in df.columns if c != text] if keep is None else keep

    fields = "pos int, piece string, start int, stop int"
    schema = to_arrow_schema(_parse_datatype_string(fields))

    def found(texts: list[str | None]) -> Iterator[tuple[int, int, dict]]:
        t = shared.value
        for k, x in enumerate(texts):
            whole = Aligned(x or "")
            if t.normalizer:
                t.normalizer(whole)
            parts = [p for p in (t.pre_tokenizer(whole) if t.pre_tokenizer else [whole]) if p.text]
            for pos, p in enumerate(parts):
                a, b = p.original_span(0, len(p))
                yield k, 1, {"pos": pos, "piece": p.text, "start": a, "stop": b}

    return _batches(df, {"text": text}, lambda got, start: _gathered(found(got["text"]), schema), fields, keep)


def words(df: DataFrame, tokenizer: Tokenizer, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, pos and word: normalized and split, without cutting out added tokens, as training counts them. Null has no words."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    packed = df.select(F.struct(*(keep or [F.lit(0)])).alias("row"), F.col(text).alias("text"))

    def aligned(t: Tokenizer) -> Callable[[str], list[str]]:
        def run(x: str) -> list[str]:
            whole = Aligned(x)
            if t.normalizer:
                t.normalizer(whole)
            return [p.text for p in (t.pre_tokenizer(whole) if t.pre_tokenizer else [whole])]

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        normal, split = plain.normalizer(t.specs["normalizer"]), plain.splitter(t.specs["pre_tokenizer"])
        words_of = (lambda x: split(normal(x))) if normal and split else aligned(t)
        for part in (p for batch in batches for p in portions(batch, "text", STRINGS)):
            found, sizes = [], []
            for x in part.column(1).fill_null("").to_numpy(zero_copy_only=False):
                own = [w for w in words_of(x) if w]
                found += own
                sizes.append(len(own))
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for at in range(0, len(found), 1 << 17):  # a text's words may be very many
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[cut])), pa.array(pos[cut].astype(np.int32)), pa.array(found[cut], pa.string())], ["row", "pos", "word"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, pos int, word string")
    return out.select("row.*", "pos", "word") if keep else out.select("pos", "word")


#: Splitters with an exact native form, by type; options as in tokenizer.json.
_NATIVE = {
    "Whitespace": lambda c, s: columns.whitespace(c),
    "WhitespaceSplit": lambda c, s: columns.whitespace_split(c),
    "BertPreTokenizer": lambda c, s: columns.bert_split(c),
    "Digits": lambda c, s: columns.digits(c, s.get("individual_digits", False)),
    "Punctuation": lambda c, s: columns.punctuation(c, s.get("behavior", "Isolated")),
}


def word_counts(df: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """(word, n): native where splitter and normalizer allow, with map-side partial sums before the shuffle."""
    spec, norm = tokenizer.specs["pre_tokenizer"], tokenizer.specs["normalizer"]
    if spec and spec.get("type") in _NATIVE and (norm is None or norm.get("type") == "Lowercase"):
        source = columns.lowercase(F.col(text)) if norm else F.col(text)
        found = df.select(F.explode(_NATIVE[spec["type"]](source, spec)).alias("word"))
    else:
        found = words(df, tokenizer, text, []).select("word")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, tokenizer: Tokenizer, trainer: object, text: str = "text") -> Tokenizer:
    """A tokenizer with a model trained on `df`; specials become added tokens. See `lexloom.plans.training`."""
    from lexloom.plans import training

    model = training.model(word_counts(df, tokenizer, text), trainer)
    return tokenizer.with_model(model).with_tokens(trainer.special_tokens)


def budget(df: DataFrame, tokenizer: Tokenizer, limit: int, source: dict[str, str], path: str, id_col: str = "id", text: str = "text") -> DataFrame:
    """Write id, text, token_count, ids, offsets and the tokenizer's origin to `path`, if no record has more than `limit` tokens.

    One record over the limit fails the run and nothing appears at `path`; an
    existing path is never overwritten. Rows are written beside it and renamed."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".partial")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ConfigError(f"{path} exists")
    found = encode(df.select(id_col, text, F.col(text).alias("__text")), tokenizer.bare(), "__text", keep=[id_col, text])
    origin = F.struct(*(F.lit(source.get(k)).alias(k) for k in ("source", "revision", "sha256")))
    out = found.select(id_col, text, F.size("ids").cast("bigint").alias("token_count"), "ids", "offsets", origin.alias("tokenizer"))
    out.write.mode("overwrite").json(temp.toString())
    written = spark.read.schema(out.schema).json(temp.toString())
    over = written.where(F.col("token_count") > limit).orderBy(id_col).select(id_col, "token_count").first()
    if over is not None:
        fs.delete(temp, True)
        raise RecordError(f"record {over[0]} has {over[1]} tokens; the limit is {limit}")
    if not fs.rename(temp, target):
        raise ConfigError(f"{path} could not be put in place")
    return spark.read.schema(out.schema).json(path)
