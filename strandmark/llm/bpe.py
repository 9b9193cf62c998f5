"""Exact token ids of the word-level BPE vocabulary, piece by piece.

A *piece* is a maximal run of bytes without ASCII white space. The vocabulary's normaliser and splitter never
join characters across white space, so the ids of a text are those of its pieces in order. Each worker compiles
pieces on first sight and remembers a bounded number of them.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import regex

#: The splitter of the vocabulary file.
SPLITTER = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters for which NFC is the identity and lower-casing is the same in every library.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xffĀ-įı-ſ]*")
#: Pieces, and words in them, that a worker remembers.
MOST = 500_000


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class PieceIds(dict):
    """piece (bytes) -> its token ids as unsigned 32-bit bytes, little-endian on every machine that Spark supports."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        self.tokens: dict[str, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MOST:
            self.clear()
        value = self[piece] = self.compiled(piece.decode())
        return value

    def compiled(self, piece: str) -> bytes:
        if "<|" in piece or not (piece.isascii() and piece.isprintable()) and PLAIN.fullmatch(piece) is None:  # special strings, rare scripts: the library's whole path
            return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        known, low = self.tokens, piece.lower()
        if low.isalpha():  # what the splitter finds, for the commonest shapes
            words = (low,)
        elif low[:-1].isalpha():
            words = (low[:-1], low[-1])
        else:
            words = SPLITTER.findall(low)
        out = b""
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= MOST:
                    known.clear()
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = known[word] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            out += ids
        return out

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    """One table for each worker process and vocabulary."""
    return PieceIds(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine; every executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)
