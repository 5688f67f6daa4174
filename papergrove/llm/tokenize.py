"""Token ids of whole texts by the tokenizers library, remembered by white-space piece.

The vocabulary's pipeline composes characters, turns white space into one space, lower-cases character by
character and cuts words from everything else, so no step looks across a space or a newline: the ids of a text
are those of its pieces in order. A piece is encoded by the library once per worker.
"""

from __future__ import annotations

import json
from array import array

#: The end of a document.
END_ID = 1
#: Pieces remembered by a worker; beyond it the memory starts anew.
MOST = 600_000
#: ASCII punctuation that the fast path may find after a word (none opens a special token or a contraction).
TAIL = ".,!?;:%$&*#()-\""


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Memo(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            self.fast = self._is_word_bpe(json.load(f))
        self.word = {}

    @staticmethod
    def _is_word_bpe(spec: dict) -> bool:
        """Whether the normaliser and pre-tokenizer are those the fast path reproduces for Latin-1 words."""
        parts = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return parts == ["NFC", "Replace", "Lowercase"] and cut == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>"

    def _pre_token(self, word: str) -> bytes:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = self.word[word] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        word = self.word
        if len(self) >= MOST or len(word) >= MOST:
            self.clear()
            word.clear()
        ids = None
        if self.fast:
            core = piece if piece.isalpha() else piece.rstrip(TAIL)
            if core.isascii() and core.isalpha() or core.isalpha() and max(core) < "\u0100":
                low = core.lower()
                ids = word.get(low) or self._pre_token(low)
                if len(core) < len(piece):
                    tail = piece[len(core):]
                    ids += word.get(tail) or self._pre_token(tail)
        if ids is None:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids

    def ids(self, text: str | None, end: int | None = END_ID) -> bytes:
        """All ids of a whole text (null: empty) and then the end id, four bytes each."""
        if not text:
            return b"" if end is None else end.to_bytes(4, "little")
        if self.fast:
            out = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        else:
            out = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return out if end is None else out + end.to_bytes(4, "little")


_MEMOS: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]


def resolve(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies, on each machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

