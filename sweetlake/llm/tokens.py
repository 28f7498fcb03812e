"""Token ids of whole texts by the tokenizers library, with repeated pieces merged once.

Most of the library's time goes on pieces it has met before.  So texts are cut by the
vocabulary's own pattern and each distinct piece goes to the library's merge model once; a
bounded memo per Python worker holds the ids.  This holds for texts of characters that every
Unicode version classes, lowers and composes alike (COMMON) and that hold no string of an added
token; any other text takes the library's whole pipeline.  Either way the ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``, so an added token's string is that token.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator

#: Ranges of characters, assigned since early Unicode versions, that compose with no other of them.
#: Latin; Cyrillic; kana; Han; Hangul syllables.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ȹȻ-Ƚȿ-ˁˆ-ˑˠ-ˤˬˮ" + "Ѐ-ҁ" + "ぁ-ゔァ-ヺ" + "一-龥" + "가-힣"
NUMBERS = "0-9²³¹¼-¾"
#: ASCII and Latin signs; general punctuation without its spaces; currency; CJK punctuation.
SIGNS = "!-/:-@[-`{-~¡-©«-±´¶-¸»¿×÷˂-˅˒-˟˥-˫˭˯-˿" + "‐-‧‰-⁞₠-⃀" + "、-〃〈-】"
#: A character for which a text goes through the library's whole pipeline.
UNCOMMON = re.compile(f"[^\\t\\n\\r {LETTERS}{NUMBERS}{SIGNS.replace('[', chr(92) + '[').replace(']', chr(92) + ']')}]")
#: Pieces of more characters are not remembered.
LONG = 64
#: Entries of a memo's newer half; the older half has as many at most.  With LONG it bounds a worker's memo to some 80 MB.
MEMO = 200_000
#: How the two kinds of vocabulary cut a normalised text of common characters into pieces; the first is
#: BYTE_PATTERN, of any characters, with classes spelled out and letters first.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_PIECES = rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
WORD_PIECES = rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"


def byte_letters() -> dict[int, str]:
    """Code of each byte -> the letter that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Halves(dict):
    """A bounded memo: when it is full it becomes the older half, from which entries move
    back when they are met again, so that only rare ones are lost."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
        return value


class Memo:
    """Packs ids of texts, as little-endian unsigned 32-bit integers, for one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None  # word-level vocabularies have lower case
        self.cut = re.compile(WORD_PIECES if self.lower else BYTE_PIECES).findall
        self.letters = byte_letters()
        self.known = Halves(self.piece)

    def piece(self, piece: str) -> bytes:
        word = piece[piece[0] == " " :]
        if word.isascii() and word.isalpha():
            letters = piece if word is piece else self.letters[32] + word
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array.array("I", [x.id for x in self.tokenize(letters)]).tobytes()

    def pack(self, text: str) -> bytes:
        """Packed ids of a text."""
        low = text.lower() if self.lower else text
        if UNCOMMON.search(text) or any(a in text or a in low for a in self.added):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self.known.turn()
        return b"".join(map(self.known.__getitem__, self.cut(low)))


def widest(path: str) -> int:
    """The largest id of a vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


MEMOS: dict[str, Memo] = {}


def packed_ids(path: str, texts: list[str], end: int | None) -> Iterator[bytes]:
    """Packed ids of each text with the end id, by the memo of this worker."""
    if path not in MEMOS:
        MEMOS[path] = Memo(path)
    tail = b"" if end is None else array.array("I", [end]).tobytes()
    for t in texts:
        yield MEMOS[path].pack(t) + tail
