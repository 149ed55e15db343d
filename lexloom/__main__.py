"""`python -m lexloom`: count, encode, decode, inspect, train, encode-batch, decode-batch."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Sequence

from lexloom.errors import LexloomError
from lexloom.plans.tokenizer import Tokenizer
from lexloom.sources import files

KINDS = {"bpe": "BPE", "wordpiece": "WordPiece", "unigram": "Unigram", "wordlevel": "WordLevel"}


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lexloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _load(args: argparse.Namespace) -> Tokenizer:
    return files.load(args.tokenizer, args.revision)


def _text(value: str) -> str:
    return sys.stdin.read() if value == "-" else value


def count(args: argparse.Namespace) -> None:
    n = _load(args).count(_text(args.text), args.pair, not args.no_special_tokens, args.use_tokenizer_settings)
    print(json.dumps({"count": n, "add_special_tokens": not args.no_special_tokens, "use_tokenizer_settings": args.use_tokenizer_settings}) if args.json else n)


def encode(args: argparse.Namespace) -> None:
    from lexloom.plans.frame import _row

    e = _load(args).encode(_text(args.text), args.pair, not args.no_special_tokens, "char" if args.char_offsets else "byte")
    if args.json:
        row = _row(e)
        print(json.dumps(row | {"offsets": [[o["start"], o["end"]] for o in row["offsets"]], "overflowing": len(e.overflowing)}, ensure_ascii=False))
    else:
        for i, token, (a, b) in zip(e.ids, e.tokens, e.offsets):
            print(i, token, f"{a}-{b}", sep="\t")


def decode(args: argparse.Namespace) -> None:
    parts = [p for x in args.ids for p in re.split(r"[\s,]+", x) if p]
    bad = [p for p in parts if not p.isdigit()]
    if bad:
        raise LexloomError(f"{bad[0]!r} is no id")
    print(_load(args).decode(map(int, parts), args.skip_special_tokens, strict=True))


def inspect(args: argparse.Namespace) -> None:
    found = _load(args).inspect()
    print(json.dumps(found, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v if isinstance(v, (str, int)) or v is None else json.dumps(v, ensure_ascii=False)}" for k, v in found.items()))


def train(args: argparse.Namespace) -> None:
    from lexloom.plans import presets

    spark = _spark()
    t = presets.train(files.lines_kept(spark, args.files), KINDS[args.model], args.preset, args.vocab_size, args.min_frequency, args.special_token)
    t.save(args.out)
    n = t.vocab_size()
    print(f"trained {KINDS[args.model]}: {n} tokens in {args.out}", file=sys.stderr)
    if n > args.vocab_size:
        print(f"the special tokens and the alphabet alone need more than {args.vocab_size} tokens; nothing was learned beyond them", file=sys.stderr)


def encode_batch(args: argparse.Namespace) -> None:
    from lexloom.sources import jsonl

    records = jsonl.read(_spark(), args.input, "encode", args.max_record_bytes)
    jsonl.write(jsonl.encode_batch(records, _load(args), not args.no_special_tokens, args.ignore_tokenizer_settings, args.char_offsets), args.output)


def decode_batch(args: argparse.Namespace) -> None:
    from lexloom.sources import jsonl

    records = jsonl.read(_spark(), args.input, "decode", args.max_record_bytes)
    jsonl.write(jsonl.decode_batch(records, _load(args), args.skip_special_tokens), args.output)


def parser() -> argparse.ArgumentParser:
    from lexloom.plans.presets import PRESETS
    from lexloom.sources.jsonl import MOST_BYTES

    out = argparse.ArgumentParser("lexloom", description="Subword tokenization on Spark.")
    commands = out.add_subparsers(required=True, dest="command")

    def command(name: str, fn, about: str, source: bool = True, flags: Sequence[str] = ()) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.set_defaults(run=fn)
        if source:
            p.add_argument("-t", "--tokenizer", required=True, help="a tokenizer.json, a folder that holds one, or a repository in the cache")
            p.add_argument("--revision", help="of a repository")
        for flag in flags:
            p.add_argument(f"--{flag}", action="store_true")
        return p

    for name, fn, about, flags in (
        ("count", count, "count the tokens of a text", ("no-special-tokens", "use-tokenizer-settings", "json")),
        ("encode", encode, "ids, tokens and offsets of a text", ("no-special-tokens", "char-offsets", "json")),
    ):
        p = command(name, fn, about, flags=flags)
        p.add_argument("--pair", help="a second text")
        p.add_argument("text", help="- reads standard input")
    command("decode", decode, "the text of ids", flags=("skip-special-tokens",)).add_argument("ids", nargs="+", help="apart by spaces or commas")
    command("inspect", inspect, "what a tokenizer is made of", flags=("json",))
    p = command("train", train, "a tokenizer from text files", source=False)
    p.add_argument("-m", "--model", choices=KINDS, default="bpe")
    p.add_argument("-p", "--preset", choices=PRESETS)
    p.add_argument("--vocab-size", type=int, default=30_000)
    p.add_argument("--min-frequency", type=int, default=0)
    p.add_argument("--special-token", action="append", help="in the order of ids, in place of the preset's")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("files", nargs="+")
    for name, fn, about, flags in (
        ("encode-batch", encode_batch, "encode JSON lines", ("no-special-tokens", "char-offsets", "ignore-tokenizer-settings")),
        ("decode-batch", decode_batch, "decode JSON lines", ("skip-special-tokens",)),
    ):
        p = command(name, fn, about, flags=flags)
        p.add_argument("--max-record-bytes", type=int, default=MOST_BYTES)
        p.add_argument("input")
        p.add_argument("output", help="a folder that doesn't exist yet")
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except (LexloomError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
