"""A tokenizer as an immutable-by-convention configuration: load, encode, decode, save.

Everything here runs on the driver or inside a task on single texts; `lexloom.plans.frame`
applies it to DataFrames."""

from __future__ import annotations

import copy
import json
import os
import stat
import tempfile
from collections.abc import Iterable
from dataclasses import asdict, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from lexloom.errors import ConfigError, LexloomError, RecordError, TruncationError, UnknownIdError
from lexloom.functions import plain
from lexloom.functions.align import Aligned, byte_starts
from lexloom.functions.chars import char_bytes
from lexloom.functions.memo import Memo, joined, lists_of
from lexloom.functions.patterns import compiled
from lexloom.operators import decoders, models, normalizers, pretokenizers, processors
from lexloom.operators.added import AddedToken, AddedVocabulary
from lexloom.operators.encoding import COLUMNS, Encoding, Padding, Truncation, pad_all, truncate


Part = dict | object | None
#: What a tokenizer makes of itself on first use; copies make their own.
_DERIVED = ("_plan", "_normal", "_shown", "_arrays", "_inner", "_before")


def _made(build, part: Part) -> object:
    return build(part) if part is None or isinstance(part, dict) else part


class Tokenizer:
    """A model and the components around it: specifications as in the file format, or objects as in `lexloom.operators.custom`."""

    def __init__(self, model: models.Model, normalizer: Part = None, pre_tokenizer: Part = None, post_processor: Part = None, decoder: Part = None) -> None:
        self.model = model
        self.specs = {"normalizer": normalizer, "pre_tokenizer": pre_tokenizer, "post_processor": post_processor, "decoder": decoder}
        self.added = AddedVocabulary()
        self.truncation: Truncation | None = None
        self.padding: Padding | None = None
        self._build()

    def _build(self) -> None:
        self.normalizer = _made(normalizers.build, self.specs["normalizer"])
        self.pre_tokenizer = _made(pretokenizers.build, self.specs["pre_tokenizer"])
        self.processor = _made(processors.build, self.specs["post_processor"])
        self.decoder = _made(decoders.build, self.specs["decoder"])
        self.added.refresh(self.normalizer)

    def __getstate__(self) -> dict:
        gone = dict.fromkeys(("normalizer", "pre_tokenizer", "processor", "decoder"))
        kept = {k: v for k, v in self.__dict__.items() if k not in _DERIVED}
        # by value, so that components of one's own reach workers that don't have their modules
        return kept | gone | {"specs": cloudpickle.dumps(self.specs), "model": cloudpickle.dumps(self.model)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {k: cloudpickle.loads(state[k]) for k in ("specs", "model")})
        self._build()

    # Load and save.

    @classmethod
    def from_json(cls, text: str | bytes) -> Tokenizer:
        try:
            spec = json.loads(text)
        except ValueError as e:
            raise ConfigError(f"no JSON: {e}") from e
        if not isinstance(spec, dict) or "model" not in spec:
            raise ConfigError("the file has no model")
        if spec.get("version", "1.0") != "1.0":
            raise ConfigError(f"unknown version {spec['version']!r}")
        try:
            out = cls(models.build(spec["model"]), *(spec.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor", "decoder")))
            flags = ("single_word", "lstrip", "rstrip", "normalized", "special")
            tokens = [(t["id"], AddedToken(t["content"], **{f: t[f] for f in flags if f in t})) for t in spec.get("added_tokens") or []]
        except KeyError as e:
            raise ConfigError(f"the field {e} is missing") from e
        out.added.load(tokens, out.model, out.normalizer)
        if (t := spec.get("truncation")) is not None:
            out.truncation = Truncation(t.get("max_length", 512), t.get("strategy", "LongestFirst"), t.get("stride", 0), t.get("direction", "Right"))
        if (p := spec.get("padding")) is not None:
            out.padding = Padding(p.get("strategy", "BatchLongest"), p.get("direction", "Right"), p.get("pad_to_multiple_of"), p.get("pad_id", 0), p.get("pad_type_id", 0), p.get("pad_token", "[PAD]"))
        return out

    from_bytes = from_json

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls.from_json(f.read())

    def spec(self) -> dict:
        own = [k for k, v in self.specs.items() if v is not None and not isinstance(v, dict)]
        if own or not isinstance(self.model, models.Model):
            raise ConfigError(f"components of one's own can't be stored: {', '.join(own or ['model'])}")
        t, p = self.truncation, self.padding
        return {
            "version": "1.0",
            "truncation": t and {"direction": t.direction, "max_length": t.max_length, "strategy": t.strategy, "stride": t.stride},
            "padding": p and asdict(p),
            "added_tokens": self.added.spec(),
            **self.specs,
            "model": self.model.spec(),
        }

    def to_json(self, pretty: bool = False) -> str:
        return json.dumps(self.spec(), ensure_ascii=False, **({"indent": 2} if pretty else {"separators": (",", ":")}))

    def save(self, path: str, pretty: bool = True) -> None:
        """Replace the file at once: a reader sees the old or the new one. Permissions stay; new files get 0644."""
        mode = stat.S_IMODE(os.stat(path).st_mode) if os.path.isfile(path) and not os.path.islink(path) else 0o644
        handle, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".lexloom-")
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(self.to_json(pretty))
                f.flush()
                os.fsync(f.fileno())
            os.chmod(temp, mode)
            os.replace(temp, path)
        except BaseException:
            os.unlink(temp)
            raise

    # Changed copies.

    def _copy(self) -> Tokenizer:
        out = copy.copy(self)
        for name in _DERIVED:
            out.__dict__.pop(name, None)
        out.specs, out.added = dict(self.specs), copy.deepcopy(self.added)
        return out

    def with_part(self, **parts: dict | None) -> Tokenizer:
        """A copy with another normalizer, pre_tokenizer, post_processor or decoder."""
        if parts.keys() - self.specs.keys():
            raise ConfigError(f"no such parts: {sorted(parts.keys() - self.specs.keys())}")
        out = self._copy()
        out.specs |= parts
        out._build()
        return out

    def with_model(self, model: models.Model) -> Tokenizer:
        """A copy with another model; ids that the post-processor and padding name are looked up anew by their text."""
        out = self._copy()
        out.model = model
        tokens = [t for _, t in sorted(self.added.by_id.items())]
        out.added = AddedVocabulary()
        out.added.add(tokens, model, out.normalizer)
        out.specs["post_processor"] = out._rebound(out.specs["post_processor"])
        if out.padding is not None:
            out.padding = replace(out.padding, pad_id=out._needed(out.padding.pad_token))
        out._build()
        return out

    def _needed(self, token: str) -> int:
        i = self.token_to_id(token)
        if i is None:
            raise ConfigError(f"{token!r} is set up but has no id")
        return i

    def _rebound(self, spec: dict | None) -> dict | None:
        if not isinstance(spec, dict):
            return spec
        spec = copy.deepcopy(spec)
        if spec["type"] == "Sequence":
            spec["processors"] = [self._rebound(s) for s in spec["processors"]]
        for key in ("sep", "cls"):
            if key in spec:
                spec[key] = [spec[key][0], self._needed(spec[key][0])]
        for token in spec.get("special_tokens", {}).values():
            token["ids"] = [self._needed(t) for t in token["tokens"]]
        return spec

    def with_truncation(self, how: Truncation | None) -> Tokenizer:
        if how is not None:
            room = how.max_length - (self.processor.added(False) if self.processor else 0)
            if room > 0 and how.stride >= room:
                raise TruncationError("the stride must be less than what special tokens leave")
        out = self._copy()
        out.truncation = how
        return out

    def with_padding(self, how: Padding | None) -> Tokenizer:
        out = self._copy()
        out.padding = how
        return out

    def with_tokens(self, tokens: Iterable[AddedToken | str], special: bool = False) -> Tokenizer:
        out = self._copy()
        out.added.add([AddedToken.plain(t, special) if isinstance(t, str) else t for t in tokens], out.model, out.normalizer)
        return out

    def encoding_specials(self, on: bool = True) -> Tokenizer:
        """A copy that takes special tokens in a text as plain text."""
        out = self._copy()
        out.added.encode_special_tokens = on
        return out

    def bare(self) -> Tokenizer:
        """A copy without truncation and padding."""
        return self.with_truncation(None).with_padding(None)

    # Lookups.

    def token_to_id(self, token: str) -> int | None:
        i = self.added.ids.get(token)
        return self.model.vocab.get(token) if i is None else i

    def id_to_token(self, i: int) -> str | None:
        shown = self.added.shown(i)
        return self.model.reverse.get(i) if shown is None else shown

    def vocab(self, with_added: bool = True) -> dict[str, int]:
        return self.model.vocab | (self.added.ids if with_added else {})

    def vocab_size(self, with_added: bool = True) -> int:
        return len(self.model.vocab) + (sum(t not in self.model.vocab for t in self.added.ids) if with_added else 0)

    # Encode.

    def normalize(self, text: str) -> str:
        t = Aligned(text)
        if self.normalizer:
            self.normalizer(t)
        return t.text

    def pieces(self, text: str) -> list[tuple[int | None, Aligned]]:
        out = []
        for i, part in self.added.extract(text, self.normalizer):
            if i is not None:
                out.append((i, part))
            else:
                out += [(None, p) for p in (self.pre_tokenizer(part) if self.pre_tokenizer else [part]) if p.text]
        return out

    def _sequence(self, text: str, type_id: int, byte_offsets: bool, word: int | None = None) -> Encoding:
        out = Encoding()
        starts = byte_starts(text) if byte_offsets and not text.isascii() else None
        for k, (i, part) in enumerate(self.pieces(text)):
            number = k if word is None else word
            spans = part.at
            if i is not None:
                found = [(i, self.added.by_id[i].content, 0, len(part))]
            else:
                found = self.model.tokenize(part.text)
            for token, value, a, b in found:
                if a == b:
                    offset = (a, b)
                else:
                    offset = spans[a][0], spans[b - 1][1]
                    if starts:
                        offset = _byte_span(part, a, b, starts)
                out.push(token, value, offset, number, type_id)
        return out

    def _input(self, text: str | list[str], type_id: int, byte_offsets: bool) -> Encoding:
        if isinstance(text, str):
            return self._sequence(text, type_id, byte_offsets)
        out = Encoding()
        for k, word in enumerate(text):
            own = self._sequence(word, type_id, byte_offsets, k)
            for c in COLUMNS:
                getattr(out, c).extend(getattr(own, c))
        return out

    def encode(self, text: str | list[str], pair: str | list[str] | None = None, add_special_tokens: bool = True, offsets: str = "byte") -> Encoding:
        first = self._input(text, 0, offsets == "byte")
        second = None if pair is None else self._input(pair, 1, offsets == "byte")
        return self.post_process(first, second, add_special_tokens)

    def ids(self, text: str, add_special_tokens: bool = True) -> list[int]:
        """The ids of `encode`, without keeping track of where they come from wherever the set-up allows that."""
        if self._fast() is None:
            return self.encode(text, None, add_special_tokens, "char").ids
        return self.ids_batch([text], add_special_tokens)[0].tolist()

    def ids_batch(self, texts: list[str], add_special_tokens: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and the places where texts start and the last ends."""
        fast = self._fast()
        if fast is None:
            lists = [self.encode(t, None, add_special_tokens, "char").ids for t in texts]
            ends = np.cumsum([0, *map(len, lists)])
            return np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1])), ends
        words_of, (head, tail), memo = fast
        added = [m for m in (self.added._raw, self.added._norm) if m is not None]
        head, tail = (list(head), list(tail)) if add_special_tokens else ([], [])
        words: list[str] = []
        bounds, places, put = [0], [], []  # ids that come from no word, and before which word they stand
        for text in texts:
            places += [len(words)] * len(head)
            put += head
            if added and text and any(m[0].search(text) for m in added):
                for i, part in self._parts(text):
                    if i is None:
                        words += words_of(part)
                    else:
                        places.append(len(words))
                        put.append(i)
            elif text:
                words += words_of(text)
            places += [len(words)] * len(tail)
            put += tail
            bounds.append((len(words), len(put)))
        lists = memo.take(pa.array(words, pa.string()))
        starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy().astype(np.int64)
        if put:
            flat = np.insert(flat, starts[np.array(places)], put)
        ends = np.array([0, *(starts[w] + k for w, k in bounds[1:])], np.int64)
        return flat, ends

    def _parts(self, text: str) -> list[tuple[int | None, str]]:
        """A text around its added tokens, as `AddedVocabulary.extract` does it; parts are normalized when they are split."""
        out = []
        for i, a, b in self.added.matches(text, self.added._raw):
            if i is not None:
                out.append((i, ""))
                continue
            part = self._normal(text[a:b])
            out += [(j, "") if j is not None else (None, _Done(part[c:d])) for j, c, d in self.added.matches(part, self.added._norm)]
        return out

    def _fast(self):
        """What a text's words are as plain strings, the special ids around them and the ids of words; None where offsets steer the result."""
        if not hasattr(self, "_plan"):
            self._plan = self._fast_plan()
        return self._plan

    def _fast_plan(self):
        around = processors.around(self.processor)
        normal, split = plain.normalizer(self.specs["normalizer"]), plain.splitter(self.specs["pre_tokenizer"])
        if around is None or self.truncation or self.padding or normal is None or split is None or self.model.random:
            return None
        if self.specs["pre_tokenizer"] is None:
            split = self._whole_words() or split
        self._normal = normal

        def words_of(text: str) -> list[str]:
            return [w for w in split(text if isinstance(text, _Done) else normal(text)) if w]

        ids = self.model.ids
        return words_of, around, Memo(lambda words: lists_of([ids(w) for w in words.to_numpy(zero_copy_only=False)]))

    def _whole_words(self):
        """Without a splitter a model gets a whole text. Where no token goes on across the start of a run of `▁`, merging
        cannot either, so a text may be cut there; not so where unknown characters drop out and bring others together."""
        model, mark = self.model, "▁"
        if model.kind != "BPE" or not model.unk_token or model.prefix or model.suffix or model.ignore_merges or mark not in model.vocab:
            return None
        return None if any(inside.search(t) for inside in [compiled(f"[^{mark}]{mark}")] for t in model.vocab) else compiled(f"{mark}+[^{mark}]*|[^{mark}]+").findall

    def arrays(self):
        """The way of `lexloom.plans.flat` to encode many texts at once; None where the kernel is needed."""
        if not hasattr(self, "_arrays"):
            from lexloom.plans import flat

            self._arrays = flat.of(self)
        return self._arrays

    def encode_batch(self, texts: Iterable, add_special_tokens: bool = True, offsets: str = "byte") -> list[Encoding]:
        """Encodings of texts or (text, pair) tuples; padded to one length, if padding is on."""
        bare = self.with_padding(None) if self.padding else self
        out = [bare.encode(*(t if isinstance(t, tuple) else (t, None)), add_special_tokens, offsets) for t in texts]
        if self.padding:
            pad_all(out, self.padding)
        return out

    def post_process(self, first: Encoding, second: Encoding | None, special: bool = True) -> Encoding:
        how = self.truncation
        if how is not None:
            n = self.processor.added(second is not None) if special and self.processor else 0
            if n and (how.max_length < n or how.max_length == n and len(first) + len(second or ())):
                raise TruncationError(f"special tokens need {n} places of {how.max_length}")
            truncate(first, second, how, how.max_length - n)
        parts = [first] if second is None else [first, second]
        processor = self.processor or processors.Processor()
        out = processors.join(processor.process(parts, special))
        if self.padding:
            pad_all([out], self.padding)
        return out

    def count(self, text: str, pair: str | None = None, add_special_tokens: bool = True, settings: bool = False) -> int:
        """Number of tokens, without truncation and padding unless `settings` asks for them."""
        return len((self if settings else self.bare()).encode(text, pair, add_special_tokens))

    # Decode.

    def tokens_of(self, ids: Iterable[int], skip_special_tokens: bool = True, strict: bool = False) -> list[str]:
        specials, out = self.added.specials() if skip_special_tokens else (), []
        for i in ids:
            token = self.id_to_token(i)
            if token is None:
                if strict:
                    raise UnknownIdError(f"no token has the id {i}")
            elif token not in specials:
                out.append(token)
        return out

    def decode(self, ids: Iterable[int], skip_special_tokens: bool = True, strict: bool = False) -> str:
        tokens = self.tokens_of(ids, skip_special_tokens, strict)
        return "".join(self.decoder(tokens)) if self.decoder else " ".join(tokens)

    def decode_batch(self, batch: Iterable[Iterable[int]], skip_special_tokens: bool = True) -> list[str]:
        return [self.decode(ids, skip_special_tokens) for ids in batch]

    def decode_lists(self, ids: np.ndarray, ends: np.ndarray, skip_special_tokens: bool = True) -> pa.Array | None:
        """Texts of many lists of ids, one after the other, from tables of what each token shows; None where a decoder needs whole lists."""
        key = bool(skip_special_tokens)
        if not hasattr(self, "_shown"):
            self._shown = {}
        if key not in self._shown:
            self._shown[key] = self._tables(key)
        if self._shown[key] is None:
            return None
        first, rest, last, between, known = self._shown[key]
        good = (ids >= 0) & (ids < len(known))
        good &= known[np.where(good, ids, 0)]
        if not good.all():
            ends = np.concatenate(([0], np.cumsum(good)))[ends]
            ids = ids[good]
        n, full = len(known), ends[:-1] < ends[1:]
        at = ids.copy()
        if first is not None:
            at[ends[:-1][full]] += n
        if last is not None:
            at[ends[1:][full] - 1] += n
        found = joined(rest if first is None and last is None else pa.concat_arrays([rest, last if first is None else first]), at, ends, between)
        try:
            text = found.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())
        return text

    def decode_fused(self, ids: np.ndarray, ends: np.ndarray, skip_special_tokens: bool = True) -> pa.Array | None:
        """As `decode_lists`, for a sequence of decoders that joins the tokens on its way; None for any other decoder."""
        steps = self._fused()
        if steps is None:
            return None
        if not hasattr(self, "_inner"):
            self._inner = self.with_part(decoder={"type": "Fuse"})
            self._inner._before = steps[0]
        text = self._inner.decode_lists(ids, ends, skip_special_tokens)
        return None if text is None else pa.array(["".join(steps[1]([x])) for x in text.to_pylist()], pa.string())

    def _fused(self):
        """Of a sequence of decoders that joins its tokens: what is done to each token before, and to the whole text after; else None."""
        spec = self.specs["decoder"]
        if not isinstance(spec, dict) or decoders.untagged(spec)["type"] != "Sequence":
            return None
        steps = [decoders.untagged(s) for s in spec["decoders"]]
        kinds = [s["type"] for s in steps]
        if "Fuse" not in kinds or not set(kinds) <= {"Replace", "Strip", "Fuse"}:
            return None
        at = kinds.index("Fuse")
        return tuple(decoders.build({"type": "Sequence", "decoders": part}) for part in (steps[:at], steps[at + 1 :]))

    def _tables(self, skip: bool):
        """What each id shows at the first place of a text, elsewhere and at the last, what stands between tokens, and which ids show."""
        spec = self.specs["decoder"]
        kind = None if spec is None else decoders.untagged(spec)["type"] if isinstance(spec, dict) else ""
        if kind not in (None, "ByteLevel", "WordPiece", "Metaspace", "BPEDecoder", "Fuse"):
            return None
        top = max([*self.model.reverse, *self.added.by_id, -1]) + 1
        if top > 4 * self.vocab_size() + 1000:
            return None
        hidden = self.added.specials() if skip else ()
        tokens = [self.id_to_token(i) for i in range(top)]
        known = np.array([t is not None and t not in hidden for t in tokens], bool)
        tokens = ["" if t is None else t for t in tokens]
        made = lambda each: pa.array([x if isinstance(x, bytes) else x.encode() for x in map(each, tokens)], pa.binary())
        if kind is None:
            return None, made(str), None, b" ", known
        if before := getattr(self, "_before", None):  # what `decode_fused` does to each token
            return None, made(lambda t: "".join(before([t]))), None, b"", known
        if kind == "ByteLevel":
            codes = char_bytes()
            shown = lambda t: t.encode() if any(c not in codes for c in t) else bytes(map(codes.__getitem__, t))
            return None, made(shown), None, b"", known
        alone, second = (lambda t: self.decoder([t])[0]), (lambda t: self.decoder(["", t])[1])
        if kind == "BPEDecoder":  # a token is shown otherwise at the end
            return None, made(lambda t: self.decoder([t, ""])[0]), made(alone), b"", known
        return (None, made(str), None, b"", known) if kind == "Fuse" else (made(alone), made(second), None, b"", known)

    def inspect(self) -> dict:
        name = lambda s: type(s).__name__ if s is not None and not isinstance(s, dict) else s and (f"Sequence[{', '.join(map(name, _parts(s)))}]" if s.get("type") == "Sequence" else s.get("type"))
        return {
            "schema_version": 1, "model": self.model.kind, "model_vocab_size": len(self.model.vocab), "vocab_size": self.vocab_size(),
            **{k: name(v) for k, v in self.specs.items()}, "added_tokens": self.added.spec(),
            "truncation": self.truncation and asdict(self.truncation), "padding": self.padding and asdict(self.padding),
        }


class _Done(str):
    """A text that is normalized already."""


def _parts(spec: dict) -> list[dict]:
    return next(v for v in spec.values() if isinstance(v, list))


def _byte_span(part: Aligned, a: int, b: int, starts: list[int]) -> tuple[int, int]:
    """Bytes of the original that characters [a, b) stand for. Characters that each show one byte of a longer one
    (byte-level text) have that character's whole range."""
    return starts[part.at[a][0]], starts[part.at[b - 1][1]]


def row_error(key: object, e: Exception) -> LexloomError:
    return RecordError(f"record {key}: {e}")
