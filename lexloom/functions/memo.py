"""Lists of ids by string, for many strings at once: Arrow tells equal strings apart, Python sees each new one once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Strings whose ids are kept, some 50 bytes each; those of more than `LONG` bytes are not.
MEMO = 500_000
LONG = 256
#: Bytes of text that are worked on at once.
PORTION = 16 << 20


class Memo:
    """Ids of strings, held in Arrow arrays. Beyond `limit` entries three quarters stay, those asked for most."""

    def __init__(self, make: Callable[[pa.StringArray], pa.ListArray], limit: int = MEMO, long: int = LONG) -> None:
        self.make, self.limit, self.long = make, limit, long
        self.keys, self.lists, self.counts = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32())), np.zeros(0, np.int64)

    def take(self, strings: pa.StringArray) -> pa.ListArray:
        """The ids of each string; those of strings that are not known are made by one call."""
        found = pc.index_in(strings, value_set=self.keys)
        at, known = pc.fill_null(found, -1).to_numpy(zero_copy_only=False), len(self.keys)
        if found.null_count:
            new = strings.filter(pc.is_null(found)).dictionary_encode()
            at = at.copy()
            at[at < 0] = new.indices.to_numpy() + known
            self.keys = pa.concat_arrays([self.keys, new.dictionary])
            self.lists = pa.concat_arrays([self.lists, self.make(new.dictionary)])
        out = self.lists.take(pa.array(at))
        counts = np.bincount(at, minlength=len(self.keys))
        counts[:known] += self.counts // 2
        short = pc.binary_length(self.keys.slice(known)).to_numpy(zero_copy_only=False) <= self.long
        if len(self.keys) > self.limit or not short.all():
            keep = np.concatenate((np.ones(known, bool), short))
            if len(self.keys) > self.limit:
                top = np.argpartition(-counts, self.limit * 3 // 4)[: self.limit * 3 // 4]
                keep &= np.isin(np.arange(len(keep)), top)
            mask = pa.array(keep)
            self.keys, self.lists, counts = self.keys.filter(mask), self.lists.filter(mask), counts[keep]
        self.counts = counts
        return out


def lists_of(lists: Sequence[Sequence[int]]) -> pa.ListArray:
    """Lists of ids as an Arrow array."""
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1]))))


def joined(parts: pa.Array, ids: np.ndarray, ends: np.ndarray, between: bytes = b" ") -> pa.Array:
    """The binary parts that ids name, joined for each range between two ends."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts.take(pa.array(ids))), pa.scalar(between))


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string, binary or list column; of numbers in a list eight each."""
    if pa.types.is_list(column.type):
        flat, ends = column.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        each = _sizes(flat) + 8 if pa.types.is_string(flat.type) or pa.types.is_binary(flat.type) else np.full(len(flat), 8)
        return np.diff(np.concatenate(([0], np.cumsum(each)))[ends])
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def portions(batch: pa.RecordBatch, column: str | list[str], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, about equal, with at most `most` bytes in the columns named each, or one row."""
    sizes = sum(_sizes(batch.column(batch.schema.get_field_index(c))) for c in ([column] if isinstance(column, str) else column))
    ends, first = np.cumsum(sizes), 0
    total = int(ends[-1]) if len(ends) else 0
    share = -(-total // max(1, -(-total // most)))
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(ends, share + (ends[first - 1] if first else 0), "right")))
        yield batch.slice(first, stop - first)
        first = stop
