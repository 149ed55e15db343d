"""What a component of one's own looks like. Any object with these methods may stand in a `Tokenizer` where a specification
stands; it travels to the workers by value, and a tokenizer that holds one can't be stored as a file."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from lexloom.functions.align import Aligned
from lexloom.operators.added import AddedToken
from lexloom.operators.encoding import Encoding


@runtime_checkable
class Normalizer(Protocol):
    def __call__(self, text: Aligned) -> None:
        """Rewrite the text in place."""


@runtime_checkable
class PreTokenizer(Protocol):
    def __call__(self, text: Aligned) -> list[Aligned]:
        """Pieces of the text; empty ones are dropped."""


@runtime_checkable
class Pattern(Protocol):
    def spans(self, text: str) -> list[tuple[int, int]]:
        """Matches in ascending order that don't overlap; for the splitter `Split`."""


@runtime_checkable
class Model(Protocol):
    kind: str
    random: bool
    vocab: dict[str, int]
    reverse: dict[int, str]

    def tokenize(self, word: str) -> list[tuple[int, str, int, int]]:
        """(id, text, first character, end) of each token of a word."""

    def ids(self, word: str) -> list[int]:
        """The ids alone."""

    def spec(self) -> dict: ...


@runtime_checkable
class PostProcessor(Protocol):
    def added(self, pair: bool) -> int:
        """How many special tokens come to one sequence or two."""

    def process(self, parts: list[Encoding], special: bool) -> list[Encoding]: ...


@runtime_checkable
class Decoder(Protocol):
    def __call__(self, tokens: list[str]) -> list[str]:
        """Texts that are joined without anything between."""


@runtime_checkable
class Trainer(Protocol):
    special_tokens: list[AddedToken]

    def train(self, counts: dict[str, int]) -> Model:
        """A model from words and how often they occur."""
