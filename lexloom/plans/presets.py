"""Ready-made pipelines for training: byte-level, bert, sentencepiece and whitespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.errors import ConfigError
from lexloom.functions.chars import byte_alphabet
from lexloom.operators.models import WordLevel
from lexloom.operators.processors import Template
from lexloom.operators.trainers import special_tokens, trainer_of
from lexloom.plans import frame
from lexloom.plans.tokenizer import Tokenizer
from lexloom.sources.files import lines_kept

PRESETS = ("byte-level", "bert", "sentencepiece", "whitespace")
#: The preset that goes with a model.
DEFAULTS = {"BPE": "byte-level", "WordPiece": "bert", "Unigram": "sentencepiece", "WordLevel": "whitespace"}
#: Special tokens in the order of their ids, and the unknown token.
SPECIALS = {
    "byte-level": ("<|endoftext|>",),
    "bert": ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"),
    "sentencepiece": ("<unk>", "<s>", "</s>", "<pad>"),
    "whitespace": ("[UNK]", "[PAD]"),
}
UNKNOWN = {"byte-level": None, "bert": "[UNK]", "sentencepiece": "<unk>", "whitespace": "[UNK]"}
_PARTS = {
    "byte-level": {
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "post_processor": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
    },
    "bert": {
        "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True},
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
    },
    "sentencepiece": {
        "normalizer": {"type": "NFKC"},
        "pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True},
        "decoder": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True},
    },
    "whitespace": {"pre_tokenizer": {"type": "Whitespace"}},
}


def unknown_token(kind: str, preset: str, specials: list[str]) -> str | None:
    """The unknown token of a model: WordPiece and WordLevel need one among the special tokens, BPE and Unigram use it if it is there."""
    wanted = UNKNOWN[preset]
    if kind in ("WordPiece", "WordLevel"):
        wanted = wanted or "[UNK]"
        if wanted not in specials:
            raise ConfigError(f"{kind} needs the special token {wanted!r} for words that it doesn't know")
    return wanted if wanted in specials else None


def train(df: DataFrame, kind: str = "BPE", preset: str | None = None, vocab_size: int = 30_000, min_frequency: int = 0, specials: list[str] | None = None, text: str = "text") -> Tokenizer:
    """A tokenizer trained on a column of texts; what a preset can't work with is an error before any training."""
    if kind not in DEFAULTS:
        raise ConfigError(f"no trainer for {kind!r}")
    preset = preset or DEFAULTS[kind]
    if preset not in PRESETS:
        raise ConfigError(f"no preset {preset!r}")
    specials = list(specials or SPECIALS[preset])
    unk = unknown_token(kind, preset, specials)
    missing = [t for t in ("[CLS]", "[SEP]") if preset == "bert" and t not in specials]
    if missing:
        raise ConfigError(f"the bert preset needs the special token {missing[0]!r} for its post-processor")
    options: dict = {"vocab_size": vocab_size, "special_tokens": special_tokens(specials)}
    if kind == "Unigram":
        options |= {"unk_token": unk} if unk else {}
    else:
        options |= {"min_frequency": min_frequency}
        if kind in ("WordLevel", "WordPiece"):
            options |= {"unk_token": unk}
        if kind in ("BPE", "WordPiece") and preset == "byte-level":
            options |= {"initial_alphabet": frozenset(byte_alphabet())}
    base = Tokenizer(WordLevel({t: i for i, t in enumerate(specials)}, unk or specials[0]), **_PARTS[preset])
    t = frame.train(df, base, trainer_of(kind, **options), text)
    if kind == "BPE" and unk:
        t.model.unk_token = unk
    if preset == "bert":
        laid = Template.of("[CLS] $A [SEP]", "[CLS] $A [SEP] $B:1 [SEP]:1", [(x, t.token_to_id(x)) for x in ("[CLS]", "[SEP]")])
        t = t.with_part(post_processor={"type": "TemplateProcessing", "single": laid.single, "pair": laid.pair, "special_tokens": laid.tokens})
    return t


def train_from_files(spark: SparkSession, paths: str | list[str], tokenizer: Tokenizer, trainer: object) -> Tokenizer:
    """`frame.train` on the lines of text files, which keep their ends; a file that is missing or no UTF-8 is an error."""
    lines = lines_kept(spark, paths)
    if not lines.where(~F.is_valid_utf8("text")).isEmpty():
        raise ConfigError("a training file is no UTF-8")
    return frame.train(lines, tokenizer, trainer)
