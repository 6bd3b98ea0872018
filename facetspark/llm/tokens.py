"""Tokenizing whole texts with the tokenizers library, a bounded memo of chunks in front of it."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Entries of each of the memo's two generations, and the longest chunk that is remembered: together its bound in bytes.
MEMO_ENTRIES = 200_000
MEMO_CHARS = 48
#: Characters of a very long text that are split into chunks at once.
SLICE_CHARS = 1 << 20
#: Characters that str.split() takes for white space but the tokenizers' patterns do not.
_CONTROL = re.compile("[\x1c-\x1f]")

#: Latin-1 letters (lower case) and digits as the tokenizers' patterns see them.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The settings under which the library lower-cases and splits a chunk of Latin-1
#: characters as ``_PIECE`` does, so that its model can be given the pieces directly.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_PLAIN = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memo(dict):
    """Ids of chunks; what is missing is taken from the older generation or encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk, self)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A tokenizer whose normalizer maps white space to a space and whose pre-tokenizer
    never joins across it encodes a text as the concatenation of its white-space
    separated chunks.  Each distinct chunk is encoded once by the library and kept in
    a memo; when a generation of it is full it becomes the older one and the older one
    goes, so common chunks stay.  ``whole=True`` (any other tokenizer) encodes each
    text at once.
    """

    def __init__(self, path: str, whole: bool = False, memo_entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._model = Tokenizer.from_file(path)
        self._model.encode_special_tokens = True
        self._whole, self._most = whole, memo_entries
        config = json.loads(self._model.to_str())
        plain = [config.get(k) for k in ("normalizer", "pre_tokenizer")] == _PLAIN
        self._bpe = self._model.model.tokenize
        self._letters = _byte_letters()
        self._memo = _Memo(self._pieces if plain else self._chunk, {})

    def _text(self, text: str) -> bytes:
        return _packed(self._model.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _chunk(self, chunk: str, memo: _Memo) -> bytes:
        return self._text(chunk)

    def _pieces(self, chunk: str, memo: _Memo) -> bytes:
        """Ids of a chunk from those of its pieces; one beyond Latin-1 is left to the library as a whole."""
        low = chunk.lower()
        if not low.isascii():
            try:
                low.encode("latin-1")
            except UnicodeEncodeError:
                return self._text(chunk)
        if low.isalpha():
            return self._letter_ids(low) if low == chunk else memo[low]
        pieces = _PIECE.findall(low)
        if len(pieces) == 1:
            return self._letter_ids(low) if low == chunk else memo[low]
        return b"".join([memo[p] for p in pieces])

    def _letter_ids(self, piece: str) -> bytes:
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode().decode("latin-1").translate(self._letters)
        return _packed([t.id for t in self._bpe(piece)])

    def ids(self, text: str | None) -> bytes:
        """Ids of a text; null counts as empty."""
        if not text:
            return b""
        if self._whole or _CONTROL.search(text):
            return self._text(text)
        out, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + SLICE_CHARS)
            cut = len(text) if cut < 0 else cut
            if len(self._memo) > self._most:
                self._memo.older = {}
                self._memo = _Memo(self._memo.encode, self._memo)
            out.append(b"".join(map(self._memo.__getitem__, text[at:cut].split())))
            at = cut
        return out[0] if len(out) == 1 else b"".join(out)


_held: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, whole: bool = False) -> WordTokenizer:
    """This worker's tokenizer for ``path``, loaded once."""
    key = (path, whole)
    if key not in _held:
        _held[key] = WordTokenizer(path, whole)
    return _held[key]


def forget() -> None:
    """Drops this worker's tokenizers and their memos."""
    _held.clear()
