"""SentencePiece encoding and decoding for byte-pair models, without a merge queue.

In byte-pair encoding the last piece of each prefix of a text is unique. A table holds it: where the encoding of the text up
to i ends in a piece, that piece is the one among all pieces that end at i (an automaton finds them) which stands beside the
last piece before it as it would if the two were encoded by themselves. Such pairs are tried by plain merging once each and
kept. The pieces are then read off backwards, from the table's last entry.

Why this is exact: merges go by score, then from the left, so whatever happens inside a stretch of pieces that no merge
crosses happens in the same order without the rest of the text. So each neighbouring pair of an encoding is by itself
encoded as that pair; and if all neighbouring pairs are, the first merge that crossed a border of them in the whole would
have crossed it in the pair as well.

Texts fall apart around ASCII characters that no longer piece has and, where no piece has a space mark behind another character,
before such marks; equal parts are encoded once for each worker (a table of bounded size; what is not in it is encoded again).

Defined cases: null and empty texts have the ids of begin and end alone and decode to an empty text; control pieces' names
inside texts are plain characters; characters without a piece become bytes; ids out of range are refused, and bytes that
are no UTF-8 are decoded one by one as U+FFFD. Repeated rows and rows without an id each have a result, an empty table has
none. A very long text is taken whole, in time that grows with its length; one without spaces takes memory for its table.
Further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import once_a_worker, tidy

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The mark that stands for a space, and what stands for a byte that is no character.
SPACE, LOST = "▁", "�".encode()
#: Encoded parts, and tried pairs, that a worker keeps.
KEPT, KEPT_PAIRS = 600_000, 1_000_000
#: Characters of the longest part that is kept.
LONGEST = 64
#: Characters of texts that are held at once.
HELD = 4 << 20


class Known(dict):
    """Texts and what `of` gives for them, for up to KEPT of them: those asked for lately stay."""

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__()
        self.of, self.before = of, {}

    def __missing__(self, text: str) -> bytes:
        found = self.before.get(text)
        if found is None:
            found = self.of(text)
        if len(text) <= LONGEST:
            if len(self) >= KEPT // 2:
                self.before = dict(self)
                self.clear()
            self[text] = found
        return found


class Numbers(dict):
    """Characters by number: first those that are pieces, others as they come."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, character: str) -> int:
        number = self[character] = self.pieces.add(character)
        return number


class Pieces:
    """A model's pieces, how texts are encoded into their ids, and back."""

    def __init__(self, path: str):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(own.get_piece_size())
        plain = [i for i in every if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
        bytes_of = {int(own.id_to_piece(i)[3:5], 16): i for i in every if own.is_byte(i)}
        if any(own.is_unused(i) for i in every) or len(bytes_of) != 256:
            raise ValueError(f"{path}: pieces are unused, or not all bytes have one")
        self.normal = own.normalize
        self.ids = {own.id_to_piece(i): i for i in plain}
        self.scores = {p: own.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = [bytes_of[b] for b in range(256)]
        self.begin, self.end = own.bos_id(), own.eos_id()
        # what an id says: nothing if it is a control piece; a negative number is a byte
        self.said: list[bytes | int] = [b""] * len(every)
        for p, i in self.ids.items():
            self.said[i] = p.replace(SPACE, " ").encode()
        for b, i in bytes_of.items():
            self.said[i] = ~b
        self.said[own.unk_id()] = own.decode([own.unk_id()]).encode()
        self.control = np.array([own.is_control(i) for i in every])
        self.opening = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.single = [x if isinstance(x, bytes) else bytes([~x]) for x in self.said]
        # no merge crosses the border of a character that is in no longer piece, or of a space mark behind another character
        alone = re.escape("".join(sorted(set(map(chr, range(128))) - set("".join(self.scores)))))
        before = f"{SPACE}*" if not any(SPACE in p.lstrip(SPACE) for p in self.ids) else ""
        self.parts = re.compile(f"[{alone}]|{before}[^{alone}{SPACE if before else ''}]+|{SPACE}+")
        self.neighbours = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        # pieces and characters by number: as text, and as ids; number 0 is none
        self.names, self.words = [""], [b""]
        self.characters, self.beside = Numbers(self), {}
        self.automaton = ahocorasick.Automaton()
        for p in self.scores:
            if self.merged(p) == [p]:  # others never come about
                self.automaton.add_word(p, (len(p), self.add(p)))
        self.automaton.make_automaton()
        self.known = Known(self._ids_of)

    def add(self, text: str) -> int:
        i = self.ids.get(text)
        self.names.append(text)
        self.words.append(array("I", [i] if i is not None else [self.bytes[b] for b in text.encode()]).tobytes())
        return len(self.names) - 1

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by plain merging: of neighbours that make a piece, those of the best score, from the left."""
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

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether two pieces next to one another stay as they are: tried once, and kept."""
        a, b = self.names[left], self.names[right]
        found = a[-1] + b[0] not in self.neighbours or self.merged(a + b) == [a, b]
        if len(self.beside) >= KEPT_PAIRS:
            self.beside.clear()
        self.beside[left << 32 | right] = found
        return found

    def split(self, text: str) -> list[int]:
        """The numbers of the pieces of a normalised text, by the last piece of each of its prefixes."""
        n, done = len(text), 0
        last, beside, characters, names = [0] * (n + 1), self.beside, self.characters, self.names  # 0: the last character
        for end, (length, piece) in self.automaton.iter(text):
            if end < done:  # the last piece of this prefix is found
                continue
            start = end + 1 - length
            if start:
                left = last[start] or characters[text[start - 1]]
                good = beside.get(left << 32 | piece)
                if good is None:
                    good = self.side_by_side(left, piece)
                if not good:
                    continue
            done = end + 1
            last[done] = piece
        out = []
        while n:
            piece = last[n] or characters[text[n - 1]]
            out.append(piece)
            n -= len(names[piece])
        return out[::-1]

    def _ids_of(self, part: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(part)))

    def encoded(self, text: str, ends: bool = True) -> bytes:
        """The ids of a text as little-endian 32-bit words."""
        begin, end = (array("I", [i]).tobytes() if ends else b"" for i in (self.begin, self.end))
        return b"".join([begin, *map(self.known.__getitem__, self.parts.findall(self.normal(text))), end])

    def decoded(self, ids: bytes) -> str:
        """The text of ids: the space that encoding puts before a text is taken away."""
        numbers = np.frombuffer(ids, "<u4")
        listed = numbers.tolist()
        try:
            if self.control[numbers[1:-1]].any():  # bytes on both sides of one are no character
                raise ValueError
            text = b"".join(map(self.single.__getitem__, listed)).decode()
        except ValueError:
            text = self._mended(listed)
        first = next((i for i in listed if self.said[i] != b""), None)
        return text[1:] if first in self.opening else text

    def _mended(self, numbers: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in range(1, 5):  # the shortest character that begins here
                    try:
                        out.append(run[at : at + n].decode().encode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(LOST)
                    at += 1
            run.clear()

        for i in numbers:
            if isinstance(self.said[i], int):
                run.append(~self.said[i])
            else:
                flush()
                out.append(self.said[i])
        flush()
        return b"".join(out).decode()


def pieces_of(path: str) -> Pieces:
    """One for each process and model: tasks of a worker use it one after another."""
    return once_a_worker(Pieces, path)


def _flushed(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about HELD bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _rows(docs: DataFrame, id_col: str, value_col: str, out: list[tuple[str, str, pa.DataType]], of, model: str) -> DataFrame:
    """(id, ...) with what `of` makes of each value by a model's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        rows = ((i, *of(pieces, value.as_py())) for b in batches for i, value in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        yield from _flushed(rows, [pa.int64(), *(t for _, _, t in out)], [id_col, *(n for n, _, _ in out)])

    schema = ", ".join([f"`{id_col}` long", *(f"{n} {kind}" for n, kind, _ in out)])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("value")).mapInArrow(tidy(run), schema)


IDS, TEXT, COUNT = ("ids", "binary", pa.binary()), ("decoded", "string", pa.string()), ("n_tokens", "long", pa.int64())


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_tokens, ids): each text's ids with those of begin and end, as little-endian unsigned 32-bit words."""

    def of(pieces: Pieces, text: str | None) -> tuple:
        ids = pieces.encoded(text or "")
        return len(ids) // 4, ids

    return _rows(docs, id_col, text_col, [COUNT, IDS], of, model)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, decoded): the text of each row's ids (null: empty)."""
    return _rows(rows, id_col, ids_col, [TEXT], lambda pieces, ids: (pieces.decoded(ids or b""),), model)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_tokens, ids, decoded): texts encoded, and their ids decoded again."""

    def of(pieces: Pieces, text: str | None) -> tuple:
        ids = pieces.encoded(text or "")
        return len(ids) // 4, ids, pieces.decoded(ids)

    return _rows(docs, id_col, text_col, [COUNT, IDS, TEXT], of, model)
