"""Token ids by the tokenizers library, with its work remembered per piece of text.

Pre-tokenizers of two families never let a token cross certain places: byte-level ones cut before a space that a
word follows and at the start of a run of white space, word ones cut at all white space and drop it; both cut
between a run of letters and an ASCII character that is none, and between a run of ASCII punctuation (without the
apostrophe, which starts contractions) and a letter, a digit or white space. A text is split at such places alone,
every distinct piece is encoded by the library, many in one call with a separator between them whose id occurs in
no other piece, and a text's ids are the pieces' ids in order, the same as for the whole text (tests compare them).
A text that holds the spelling of a special token, and any text under another tokenizer, goes to the library
whole."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

# Unicode White_Space, which differs from Python's \s; as a character class, and as the characters.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_BLANK = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_WS}]", chr(c)))
# Letters that are one letter in lower case too, which U+0130 is not.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"!-&(-/:-@\[-`{-~"
# A run of letters, if what follows is ASCII and no letter, or the end; the same for punctuation.
_AFTER_LETTERS, _AFTER_MARKS = r"(?![^\x00-@\[-`{-\x7f])", f"(?![^A-Za-z0-9{_WS}])"
SPLITS = {
    "byte": re.compile(f" ?[{_LETTERS}]+{_AFTER_LETTERS}| ?[{_MARKS}]+{_AFTER_MARKS}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),
    "word": re.compile(f"[{_LETTERS}]+{_AFTER_LETTERS}|[{_MARKS}]+{_AFTER_MARKS}|[^{_WS}]+"),
    "whole": None,
}
#: What stands between pieces in one call, and what a piece must not hold to be in one.
SEPARATORS = {"byte": ("\n", "\n"), "word": (" ~ ", "~")}
#: Pieces (some 200 bytes each) in a generation of a worker's memory, of which it has two, unless a caller with less
#: memory to spare asks for fewer; and the longest piece that is remembered.
REMEMBERED, LONGEST = 800_000, 48

_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    def __init__(self, path: str, split: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = SPLITS[split]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.separator, self.apart = SEPARATORS.get(split, ("", ""))
        ids = self._library([self.separator])[0] if self.separator else b""
        self.separator_id = int.from_bytes(ids, "little") if len(ids) == 4 else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> dict[str, bytes]:
        """The library's ids of pieces."""
        if self.separator_id is None:
            return dict(zip(new, self._library(new), strict=True))
        joined = [p for p in new if self.apart not in p and p[-1] not in _BLANK]
        alone = [p for p in new if self.apart in p or p[-1] in _BLANK]
        found = dict(zip(alone, self._library(alone), strict=True))
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([self.separator.join(joined)], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw = np.flatnonzero(ids == self.separator_id), ids.tobytes()
            if len(cuts) != len(joined) - 1:  # the separator was no boundary
                return dict(zip(new, self._library(new), strict=True))
            starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
            found.update(zip(joined, (raw[a:b] for a, b in zip(starts, ends, strict=True)), strict=True))
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.pattern is None or any(s in text for s in self.special):
            return self._library([text])[0]
        pieces, known, older = self.pattern.findall(text), self.known, self.older
        got = list(map(known.get, pieces))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            absent = {pieces[i] for i in missing}
            known.update((p, older[p]) for p in absent if p in older)
            new = [p for p in absent if p not in older]
            if new:
                known.update(self._pieces(new))
            for i in missing:
                got[i] = known[pieces[i]]
            for piece in new:
                if len(piece) > LONGEST:
                    del known[piece]
            if len(known) > self.remembered:
                self.known, self.older = {}, known
        return b"".join(got)


def encoder(path: str, split: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for each worker process."""
    found = _encoders.get((path, split)) or Encoder(path, split)
    found.remembered = remembered
    _encoders[path, split] = found
    return found
