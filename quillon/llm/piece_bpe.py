"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For a merge vocabulary, the encoding of every prefix of a word has one last token, and the encoding of the prefix before that token is the table's entry there. So
an Aho-Corasick automaton gives all pieces that end at each position, and the piece that is compatible with the last token of what stands before it
is the entry: two tokens are compatible if their joined text encodes to just these two. Ids are then read backwards.

Text is cut where no piece reaches across: before a space that follows a non-space, around line feeds where no piece holds one, and between
words and marks that no piece joins. Pieces of spaces
only have one shared lowest score, so runs of spaces are merged last, by plain merging, and memoised by length. Distinct words are encoded once per worker
as long as a bounded cache holds them.

Defined cases: a null text counts as empty and has the end id only; unknown characters become their UTF-8 byte pieces; rows that repeat get equal rows; a null
doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, forgetful

SPACE = "▁"
#: Words, and pairs of tokens, that a worker remembers before it starts anew.
CACHED = 200_000
_MODELS: dict[str, PieceBpe] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceBpe:
    """Encoder and decoder for one model file. of() gives a worker's own."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.end = sp.eos_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) for p in long):
            raise ValueError("pieces that hold a space inside a word are not supported")
        self.cut_lines = not any("\n" in p for p in long)
        # Marks: punctuation and what pieces hold beside it, unless that reaches letters. No piece crosses from marks to other characters.
        beside: dict[str, set[str]] = {}
        for p in long:
            for x, y in zip(p, p[1:]):
                beside.setdefault(x, set()).add(y)
                beside.setdefault(y, set()).add(x)
        marks, grown = set(), set(string.punctuation)
        while grown != marks:
            marks, grown = grown, grown | {y for x in grown for y in beside.get(x, ())} - {SPACE}
        if any(c.isascii() and c.isalnum() for c in marks):
            marks = set()
        m = "".join(re.escape(c) for c in sorted(marks))
        self.units = re.compile(f"{SPACE}*[^{SPACE}{m}]+|{SPACE}*[{m}]+|{SPACE}+" if marks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        #: Of each piece the pieces that merge into it last, and when: the worst (negated) score on the way there.
        self.split: dict[str, tuple[str, str]] = {}
        self.when: dict[str, float] = {}
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if piece.strip(SPACE) or piece == SPACE:
                if self.merged(piece, self.split) == [i]:
                    self.automaton.add_word(piece, (len(piece), i))
                    if len(piece) > 1:
                        a, b = self.split[piece]
                        self.when[piece] = max(self.when.get(a, -inf), self.when.get(b, -inf), -self.score[piece])
        self.automaton.make_automaton()
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[str, float]]] = {}
        self.runs: dict[int, tuple[tuple[int, ...], str]] = {}

    @staticmethod
    def of(path: str) -> PieceBpe:
        if path not in _MODELS:
            _MODELS[path] = PieceBpe(path)
        return _MODELS[path]

    def unknown(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]

    def merged(self, text: str, split: dict | None = None) -> list[int]:
        """By merging the best-scored neighbours, the leftmost first: for single pieces, doubtful pairs and runs of spaces."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))

        def offer(i: int) -> tuple | None:
            j = after[i]
            return (-self.score[p], i, p) if j < len(parts) and (p := parts[i] + parts[j]) in self.score else None

        agenda = [x for i in range(len(parts)) if (x := offer(i))]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            if not parts[i] or (j := after[i]) >= len(parts) or parts[i] + parts[j] != piece:
                continue
            if split is not None:
                split[piece] = (parts[i], parts[j])
            parts[i], parts[j] = piece, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := offer(k)):
                    heappush(agenda, x)
        return list(chain.from_iterable([self.ids[p]] if p in self.ids else self.unknown(p) for p in parts if p))

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= 2 * CACHED:
            self.pairs.clear()
        ok = self.pairs[left << 32 | right] = self._apart(left, right)
        return ok

    def _apart(self, left: int, right: int) -> bool:
        """Follows both sides of the border from characters to whole tokens: does anything merge across before a side grows?"""
        a, b = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            grow_a, grow_b = (a[i + 1][1] if i + 1 < len(a) else inf), (b[j + 1][1] if j + 1 < len(b) else inf)
            across = self.score.get(a[i][0] + b[j][0])
            if across is not None:
                at = max(-across, a[i][1], b[j][1])
                if at < grow_a and at < grow_b:
                    return False
                if at == grow_a or at == grow_b:  # the order within one moment is the plain merger's to say
                    return self.merged(self.text[left] + self.text[right]) == [left, right]
            if grow_a == grow_b == inf:
                return True
            if grow_a <= grow_b:
                i += 1
            if grow_b <= grow_a:
                j += 1

    def edge(self, i: int, side: int) -> list[tuple[str, float]]:
        """What stands at a token's left (0) or right (1) border from its character to the whole, and when it came to be."""
        if (found := self.edges.get((i, side))) is None:
            piece, found = self.text[i], []
            while piece in self.when:
                found.append((piece, self.when[piece]))
                piece = self.split[piece][side]
            found = self.edges[i, side] = [(piece, -inf), *reversed(found)]
        return found

    def last_tokens(self, word: str) -> list[int]:
        """For each prefix the id of its last token; -1 where that is an unknown character."""
        last = [-1] * len(word)
        known, compatible = self.pairs.get, self.compatible
        for end, (size, i) in self.automaton.iter(word):
            if last[end] < 0:  # what stands at earlier ends is settled, as matches come by their end
                start = end - size
                if start < 0 or (left := last[start]) < 0:
                    last[end] = i
                elif (ok := known(left << 32 | i)) or ok is None and compatible(left, i):
                    last[end] = i
        return last

    def word(self, word: str) -> list[int]:
        """Ids of a text that holds a space at its start at most."""
        last, at, back = self.last_tokens(word), len(word) - 1, []
        while at >= 0:
            if (i := last[at]) < 0:
                back.extend(reversed(self.unknown(word[at])))
                at -= 1
            else:
                back.append(i)
                at -= len(self.text[i])
        return back[::-1]

    def unit(self, unit: str) -> tuple[tuple[int, ...], str]:
        """Ids and their decimal text of spaces and the word behind them."""
        found = self.words.get(unit)
        if found is None:
            word = unit.lstrip(SPACE)
            spaces = len(unit) - len(word)
            if word and spaces:
                ids = self.word(SPACE + word)
                if spaces > 1:  # the last space is the word's unless nothing merged with it
                    own = ids[0] == self.ids.get(SPACE)
                    ids = [*self.run(spaces if own else spaces - 1), *(ids[1:] if own else ids)]
            else:
                ids = self.word(word) if word else list(self.run(spaces))
            found = (tuple(ids), " ".join(map(str, ids)))
            if len(self.words) >= CACHED:
                self.words.clear()
            self.words[unit] = found
        return found

    def run(self, spaces: int) -> tuple[int, ...]:
        if spaces not in self.runs:
            self.runs[spaces] = tuple(self.merged(SPACE * spaces))
        return self.runs[spaces]

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """Ids with the end id, and their decimal text joined by spaces."""
        found: list[tuple[tuple[int, ...], str]] = []
        if text:
            known, unit = self.words.get, self.unit
            lines = (SPACE + text.replace(" ", SPACE)).split("\n") if self.cut_lines else [SPACE + text.replace(" ", SPACE)]
            feed = self.unit("\n") if len(lines) > 1 else None
            for n, line in enumerate(lines):
                if n:
                    found.append(feed)
                found.extend([known(u) or unit(u) for u in self.units.findall(line)])
        ids = list(chain.from_iterable([f[0] for f in found]))
        ids.append(self.end)
        return ids, " ".join([*(f[1] for f in found), str(self.end)])

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids."""
        return self.library.decode(ids)


def forget() -> None:
    for m in _MODELS.values():
        for known in (m.words, m.pairs, m.edges, m.runs):
            known.clear()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (with the end id), decoded text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(path)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids = [bpe.encode(x)[0] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, without moving the ids out of the task."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.of(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in (x for i in range(0, b.num_rows, 500) for x in b.column(1).slice(i, 500).to_pylist()):
                ids, decimal = bpe.encode(x)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(forgetful(run, forget), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir))


SQL: dict[str, str] = {}
QUERIES = {"op6_sentencepiece": op6_sentencepiece}
