"""Token ids by the tokenizers library, with distinct pre-tokens encoded once per worker.

The file's pre-tokenizer cuts a text by a pattern, and its merges never cross such a cut. So a text of plain characters, on which the pattern means the same in
``re`` as in the library, is cut here and each distinct piece is encoded by the library once; any other text, and any that holds a special token's string, goes
to the library whole. The ids are the library's for the whole text either way.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Pieces that a worker remembers before it starts anew.
CACHED = 1_000_000
# Printable ASCII, line feed, tab, and letters of Latin-1 and Latin Extended-A are plain: no Unicode version disputes their classes. On them this is the file's pattern.
_PLAIN = bytes([9, 10, *range(32, 127)])
_LATIN = "À-ÖØ-öø-ſ"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\sA-Za-z{_LATIN}0-9]+|\s+(?!\S)|\s+"
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """texts_only: the strings of special tokens are ordinary text, so that no text has a special id."""

    def __init__(self, path: str, texts_only: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = re.compile(_PIECE).findall
        self.odd = re.compile(rf"[^\n\t\x20-\x7e{_LATIN}]").search
        self.library.encode_special_tokens = texts_only
        self.special = [] if texts_only else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self)
        self.kind = np.uint32 if self.library.get_vocab_size() > 1 << 16 else np.uint16
        self.code = "I" if self.kind is np.uint32 else "H"
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + hidden.index(b) for b in hidden}
        self.blank, self.feed, self.tab = (chr(self.alphabet[b]) for b in b" \n\t")
        sample = ["e", "\n", "\t", " größer", "ſ", " Àÿ", "à", " ~~", " 12", "ňŉŒ", " '", "Iı"]
        self.by_model = True
        self.by_model = [self._piece(x) for x in sample] == self._whole(sample)

    @staticmethod
    def of(path: str, texts_only: bool = False) -> Encoder:
        if (path, texts_only) not in _ENCODERS:
            _ENCODERS[path, texts_only] = Encoder(path, texts_only)
        return _ENCODERS[path, texts_only]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """A single piece goes straight to the library's model, in its byte alphabet."""
        if not self.by_model:
            return self._whole([piece])[0]
        shown = piece.replace(" ", self.blank).replace("\n", self.feed).replace("\t", self.tab) if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def plain(self, text: str) -> bool:
        """Only characters on which the pattern is sure, and no special token's string."""
        sure = not text.encode().translate(None, _PLAIN) if text.isascii() else not self.odd(text)
        return sure and not any(s in text for s in self.special)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text, as unsigned 16-bit integers (32-bit for large vocabularies)."""
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        known, cut, plain = self.pieces.__getitem__, self.cut, [bool(x) and self.plain(x) for x in texts]
        odd = iter(self._whole([x or "" for x, p in zip(texts, plain) if not p]))
        return [np.frombuffer(b"".join(map(known, cut(x))) if p else next(odd), self.kind) for x, p in zip(texts, plain)]


class _Pieces(dict):
    """Ids of pieces as bytes; what is missing is encoded and kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.encoder._piece(piece)
        return found
