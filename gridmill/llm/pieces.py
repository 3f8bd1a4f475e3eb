"""Encoding into, and decoding from, the pieces of a SentencePiece merge-type (BPE) model.

Merging always joins the adjacent pair whose union has the best score, the leftmost among
equals. A split of a text into pieces is what merging yields if and only if it is so for each
two neighbours alone: merges that stay inside the pieces run in the same order with or without
the rest of the text, so the first merge over a border would also happen among the two pieces
at that border. Hence no merge queue is needed. The text is read left to right, the longest
piece first; a piece stays if merging it with its left neighbour gives the two back; where
nothing fits, one piece is taken back and its start is marked as failed. A prefix of a text has
one valid split, so a failed position fails for good.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridmill.functions.semantics import require
from gridmill.llm.common import without

SPACE = "▁"  # how the models write a space
MEMO_STRINGS = 100_000  # words, and chunks, whose ids a worker remembers; later ones are encoded anew
MEMO_LENGTH = 48
MEMO_PAIRS = 1_000_000

_LOADED: dict[bytes, PieceEncoder] = {}


class PieceEncoder:
    """Encodes text with the pieces and scores of a SentencePiece BPE model.

    ``model`` is the content of the model file. Models with unused pieces or without byte
    pieces are refused, as they need more than merging.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.library
        count = sp.vocab_size()
        if any(sp.is_unused(i) for i in range(count)):
            raise ValueError("models with unused pieces are not supported")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("models without byte pieces are not supported")
        plain = [i for i in range(count) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.finder = ahocorasick.Automaton()
        for p in self.ids:
            self.finder.add_word(p, (len(p) - 1, p))
        self.finder.make_automaton()
        self.shorter = {p: self._next_shorter(p) for p in self.ids}
        self.chunks = self._chunk_pattern()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunk_memo, self.word_memo = _Memo(self.chunk_ids), _Memo(self.word_ids)

    def _next_shorter(self, piece: str) -> str | None:
        """The longest piece, or else the single character, that ``piece`` starts with."""
        for n in range(len(piece) - 1, 0, -1):
            if n == 1 or piece[:n] in self.ids:
                return piece[:n]
        return None

    def _chunk_pattern(self) -> re.Pattern | None:
        """Cuts a text where no piece can reach over: before a space, around characters of no longer piece,
        and between a letter and what is none, if no piece has that either.

        None if the model has pieces with a space after another character.
        """
        longer = [p for p in self.ids if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            return None
        joins = set("".join(longer)) - {SPACE}
        some = lambda chars: "".join(map(re.escape, sorted(chars)))
        alone = f"{SPACE}+|[^{SPACE}{some(joins)}]"
        letters = {c for c in joins if c.isalpha()}
        if any(a in letters and b not in letters for p in longer for a, b in zip(p, p[1:], strict=False)):
            return re.compile(f"{SPACE}*[{some(joins)}]+|{alone}", re.DOTALL)
        other = some(joins - letters)
        return re.compile(f"{SPACE}*[{other}]*[{some(letters)}]+|{SPACE}*[{other}]+|{alone}", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """The split of a short text by merging."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text; a character of no piece stands alone."""
        longest = list(text)
        for last, (before, piece) in self.finder.iter(text):  # by rising end, so the longest comes last
            longest[last - before] = piece
        failed = 0 if len(text) < 512 else _Bits(len(text) + 1)  # a bit for each position
        stack: list[str] = []
        pairs, shorter = self.pairs, self.shorter
        at, size = 0, len(text)
        piece = longest[0] if text else ""
        while at < size:
            end = at + len(piece)
            if not (failed and failed >> end & 1):
                if not stack:
                    fits = True
                else:
                    fits = pairs.get((stack[-1], piece))
                    if fits is None:
                        fits = self.compatible(stack[-1], piece)
                if fits:
                    stack.append(piece)
                    at = end
                    if at < size:
                        piece = longest[at]
                    continue
            piece = shorter.get(piece)
            if piece is None:
                failed |= 1 << at if size < 512 else at
                piece = stack.pop()
                at -= len(piece)
        return stack

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit numbers."""
        found: list[int] = []
        for piece in self.split(chunk):
            number = self.ids.get(piece)
            if number is None:
                found.extend(self.byte_ids[b] for b in piece.encode())
            else:
                found.append(number)
        return array("i", found).tobytes()

    def word_ids(self, word: str) -> bytes:
        return b"".join(map(self.chunk_memo.__getitem__, self.chunks.findall(SPACE + word)))

    def encoded(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        normal = self.library.normalize(text)
        if not normal:
            return b""
        if not self.chunks:
            return self.chunk_ids(normal)
        if normal[0] == SPACE and normal[-1] != SPACE and SPACE * 2 not in normal:  # single spaces only
            return b"".join(map(self.word_memo.__getitem__, normal[1:].split(SPACE)))
        return b"".join(map(self.chunk_memo.__getitem__, self.chunks.findall(normal)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


class _Bits:
    """A bitfield for long texts, with the operators of an int; ``|= n`` sets bit n."""

    def __init__(self, size: int):
        self.held = bytearray(size // 8 + 1)

    def __rshift__(self, at: int) -> int:
        return self.held[at >> 3] >> (at & 7)

    def __ior__(self, at: int) -> _Bits:
        self.held[at >> 3] |= 1 << (at & 7)
        return self


class _Memo(dict):
    """Ids by string, for a fixed number of short strings; the others are encoded each time."""

    def __init__(self, made: Callable[[str], bytes]):
        super().__init__()
        self.made = made

    def __missing__(self, text: str) -> bytes:
        ids = self.made(text)
        if len(text) <= MEMO_LENGTH and len(self) < MEMO_STRINGS:
            self[text] = ids
        return ids


def loaded(model: bytes) -> PieceEncoder:
    """One encoder for each model and worker process."""
    if model not in _LOADED:
        _LOADED[model] = PieceEncoder(model)
    return _LOADED[model]


def read_model(path: str) -> bytes:
    """A model file from the driver's disk; it goes to the executors with the tasks (a model is under a few MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the piece ids (array of int, no begin or end ids) of each text, and the text that they decode to.

    Whole texts, row by row, without a shuffle. A null or empty text has no ids and decodes to the
    empty text. Very long texts are encoded whole; memory follows the longest text. Repeated rows
    fare alike, an empty table gives an empty result, and a column already named ``ids`` or
    ``decoded`` is replaced. Ids outside the vocabulary do not occur.
    """
    require(docs, text)
    kept = docs.select(*without(docs, [ids, decoded]))
    require(kept, text)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                found = [np.frombuffer(encoder.encoded(t or ""), np.int32) for t in part.column(text).to_pylist()]
                back = [encoder.decode(x.tolist()) for x in found]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(found))
                arrays = [*part.columns, lists, pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, ids, decoded])

    return kept.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, so that results stay small."""
    start, held = 0, 0
    column = batch.column(text)
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """The ids alone; see ``encode_decode``."""
    return encode_decode(docs, model, text, ids, "_decoded_").drop("_decoded_")


def decode(rows: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that an array of ids decodes to; null ids give the empty text."""
    require(rows, ids)
    kept = rows.select(*without(rows, [decoded]))
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(shared.value)
        for batch in batches:
            back = [encoder.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema)
