"""What the byte-pair operators share: vocabularies, pre-tokens and bounded memos of repeated units.

A text is cut into units, each a run of white space with the run of other characters after it. The
pre-tokenizer's pattern never matches across a unit's start: only a space can lead a pre-token, and white
space matches stop where other characters begin. Units therefore encode alone, and one that occurs again
costs a look-up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

#: Code points of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_UNSAFE_SPACE = re.compile(f"[{WHITE}] ")
#: The pre-token pattern for characters below U+0250, where all classes are stable.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_BEYOND = re.compile("[ɐ-\U0010ffff]")


def units(text: str) -> list[str]:
    """The text's units, in order; joined they are the text."""
    if _UNSAFE_SPACE.search(text) or text.endswith(" "):
        return _UNIT.findall(text)
    first, *rest = text.split(" ")
    return [u for u in (first, *(" " + r for r in rest)) if u]


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


@dataclass(frozen=True)
class ByteVocabulary:
    """A byte-level vocabulary: ids of bytes, pair merges, bytes of ids, special strings."""

    byte_ids: list[int]
    ranks: dict[int, int]  # left id << 32 | right id -> rank
    pairs: list[int]  # the same keys by rank
    merged: list[int]  # id of the merged symbol by rank
    pieces: list[bytes]
    special: dict[str, int]


def load_vocabulary(path: str) -> ByteVocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    symbols = byte_symbols()
    back = {c: b for b, c in symbols.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode("utf-8")
    pairs, merged = [], []
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs.append(vocab[a] << 32 | vocab[b])
        merged.append(vocab[a + b])
    ranks = {p: r for r, p in enumerate(pairs)}
    return ByteVocabulary([vocab[symbols[b]] for b in range(256)], ranks, pairs, merged, pieces, special)


class Pretokens:
    """Splits units into pre-tokens as the library does, special strings apart."""

    def __init__(self, path: str, special: Iterable[str]) -> None:
        self.path = path
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.library = None

    def plain(self, part: str) -> list[str]:
        """Pre-tokens of a part without special strings."""
        if not _BEYOND.search(part):
            return _PRETOKEN.findall(part)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]

    def parts(self, text: str) -> list[str]:
        """The text cut at its special strings; those have the odd places."""
        return self.special.split(text) if self.special else [text]


class Memo:
    """Results by unit, for about ``most`` units in two generations.

    What is asked for moves to the younger one; when that has half of ``most`` it becomes the older one, whose
    units nobody asked for meanwhile are forgotten. Forgetting costs time only.
    """

    def __init__(self, make: Callable[[list[str]], list], most: int = 250_000) -> None:
        self.make, self.most = make, most
        self.known: dict = {}
        self.older: dict = {}

    def learn(self, found: set[str]) -> dict:
        """A dict that has all of found."""
        known = self.known
        missing = [u for u in found if u not in known]
        if missing:
            if 2 * (len(known) + len(missing)) > self.most:
                self.older, self.known = known, {}
                known, missing = self.known, list(found)
            older = self.older
            known.update((u, older[u]) for u in missing if u in older)
            new = [u for u in missing if u not in known]
            known.update(zip(new, self.make(new), strict=True))
        return known


def groups(texts: list[str], most: int = 2_000_000) -> Iterable[list[str]]:
    """Neighbouring texts together, of about ``most`` characters a group (a longer text alone)."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
