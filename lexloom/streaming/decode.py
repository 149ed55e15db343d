"""Incremental decoding: ids arrive one by one, text leaves as soon as it is certain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.errors import DecoderError
from lexloom.plans.tokenizer import Tokenizer

_UNSURE = "\N{REPLACEMENT CHARACTER}"


class DecodeStream:
    """State of one stream: ids not yet let go, the text that they start with, and how many of them it covers."""

    def __init__(self, tokenizer: Tokenizer, skip_special_tokens: bool = True, ids: list[int] | None = None, prefix: str = "", covered: int = 0) -> None:
        self.tokenizer, self.skip = tokenizer, skip_special_tokens
        self.ids, self.prefix, self.covered = list(ids or []), prefix, covered

    def _text(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, self.skip)

    def prefill(self, ids: Iterable[int]) -> None:
        """Ids that are context: nothing is shown for them. An unfinished character at their end stays pending."""
        ids = list(ids)
        whole = self._text(ids)
        for back in range(1, min(3, len(ids)) + 1) if whole.endswith(_UNSURE) else ():
            text = self._text(ids[:-back])
            if not text.endswith(_UNSURE):
                # a real replacement character stands for itself and is not walked over
                if self.tokenizer.id_to_token(ids[-back]) == _UNSURE:
                    break
                self.ids, self.prefix, self.covered = ids, text, len(ids) - back
                return
        self.ids, self.prefix, self.covered = ids, whole, len(ids)

    def step(self, i: int) -> str | None:
        return self.step_many([i])

    def step_many(self, ids: Iterable[int]) -> str | None:
        self.ids += ids
        text = self._text(self.ids)
        if len(text.encode()) <= len(self.prefix.encode()) or text.endswith(_UNSURE):
            return None
        if not text.startswith(self.prefix):
            raise DecoderError("the text of a stream no longer starts with what was shown")
        out = text[len(self.prefix) :]
        self.ids = self.ids[self.covered :]
        self.prefix = self._text(self.ids)
        self.covered = len(self.ids)
        return out


STATE = "ids array<bigint>, prefix string, covered int"


def decode_stream(
    df: DataFrame, tokenizer: Tokenizer, key: str = "key", order: str = "seq", ids: str = "id", skip_special_tokens: bool = True,
    context: DataFrame | None = None, idle_ms: int | None = None,
) -> DataFrame:
    """(key, seq, text) as text becomes certain, from a stream of (key, seq, id).

    Spark promises no order inside a micro-batch, so a key's rows are sorted by
    `order`; the state of a key holds the few ids that a pending character needs.
    `context`, a table of (key, ids array), gives keys a prefilled start: nothing is shown
    for its ids. A key that gets no ids for `idle_ms` milliseconds of processing time is
    forgotten, with what it had pending; without a limit keys are kept for good."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    kinds = dict(df.dtypes)
    thin = df.select(F.col(key).alias("key"), F.col(order).alias("seq"), F.col(ids).cast("bigint").alias("id"))
    if context is None:
        thin = thin.withColumn("before", F.lit(None).cast("array<bigint>"))
    else:
        first = context.select(F.col(key).alias("key"), F.col("ids").cast("array<bigint>").alias("before"))
        thin = thin.join(first, "key", "left")

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("seq")
        if state.exists:
            held, prefix, covered = state.get
            stream = DecodeStream(shared.value, skip_special_tokens, [int(i) for i in held], prefix, covered)
        else:
            stream = DecodeStream(shared.value, skip_special_tokens)
            before = rows["before"].iloc[0]
            if before is not None and len(before):
                stream.prefill(int(i) for i in before)
        out = []
        for seq, i in zip(rows["seq"], rows["id"]):
            text = stream.step(int(i))
            if text is not None:
                out.append((group[0], seq, text))
        state.update((stream.ids, stream.prefix, stream.covered))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, order, "text"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, text string"
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return thin.groupBy("key").applyInPandasWithState(run, schema, STATE, "append", timeout)


def encode_lines(lines: DataFrame, tokenizer: Tokenizer, path: str, checkpoint: str):
    """A streaming query that encodes JSON lines batch by batch; a batch with a bad record writes nothing and stops it.

    A batch that is tried again after a failure takes the place of what it had written."""
    from lexloom.sources import jsonl

    def batch(df: DataFrame, number: int) -> None:
        held = df.select(F.col("value").alias("line"), F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")).persist()
        try:
            jsonl.write(jsonl.encode_batch(jsonl.check(jsonl.numbered(held), "encode"), tokenizer), f"{path}/batch={number:09d}", "overwrite")
        finally:
            held.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
