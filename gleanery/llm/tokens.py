"""Token ids by the tokenizers library, one encoding for each distinct piece of text.

Both vocabularies split a text into pieces by a fixed pattern before they merge bytes, and a piece's ids
depend on nothing around it. `Encoder` therefore splits plain texts itself, lets the library's model merge
each distinct piece once, and joins the ids. Texts with characters outside a plain set (ASCII, Latin letters) go
to the library whole, so the ids never rest on a second reading of Unicode tables.
"""

from __future__ import annotations

import os
import re

import numpy as np

from gleanery.llm.common import remembered

#: Pieces of each pre-tokenizer, written for the plain characters only (fixed values).
PIECES = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+",
}
#: Letters beyond U+017E, the dotted capital I, and signs with numeric values stay with the library.
PLAIN = re.compile("[\t\n\r -~¡«»¿À-ÖØ-öø-įı-ž]*")
#: Distinct pieces remembered by a worker before it starts anew, and the longest piece worth remembering.
PIECES_KEPT, LONGEST = 200_000, 64


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Ids of pieces; the library's model merges a piece not seen before, which is kept unless it is very long."""

    def __init__(self, library) -> None:  # noqa: ANN001
        from tokenizers import pre_tokenizers

        self.model = library.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        plain = [chr(c) for c in range(0x180) if PLAIN.fullmatch(chr(c))]
        self.spelled = {ord(c): "".join(part for part, _ in as_bytes(c)) for c in plain}

    def __missing__(self, piece: str) -> bytes:
        merged = self.model.tokenize(piece.translate(self.spelled))
        ids = b"".join([t.id.to_bytes(4, "little") for t in merged])
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.folds = self.library.normalizer is not None
        self.split = re.compile(PIECES["word" if self.folds else "byte"]).findall
        self.known = Pieces(self.library)

    def _library(self, texts: list[str]) -> list[bytes]:
        made = []
        for start in range(0, len(texts), 4096):
            made += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts[start : start + 4096], add_special_tokens=False)]
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        out: list[bytes] = [b""] * len(texts)
        odd = []
        for i, text in enumerate(texts):
            if PLAIN.fullmatch(text):
                out[i] = b"".join(map(self.known.__getitem__, self.split(text.lower() if self.folds else text)))
            else:
                odd.append(i)
        for i, ids in zip(odd, self._library([texts[i] for i in odd])):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}
remembered("pieces", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; what it remembers serves its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
