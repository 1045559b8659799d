"""BPE encoding by a table of each prefix's last token, and decoding.

In byte-pair encoding every prefix of a text has one encoding, and that of a
longer prefix is the encoding of a shorter one plus one token.  So it is enough
to store, for each prefix, its last token: an automaton gives the pieces that
end there, and the one piece whose boundary to the last token of the remaining
prefix survives all merges is the answer.  The ids are then read backwards.  The
work is linear in the text, whatever its length.

Whether a boundary survives depends on the two tokens alone: their last merges
are undone, latest first, and the boundary falls as soon as the two symbols that
touch it at that time would themselves have merged earlier.

Pieces never hold a space mark after another character, so a text is cut before
each run of marks; equal chunks are encoded once while they stay in a bounded
cache.  A null text counts as empty and has no ids; the text that ``decode``
gives back is that of the library (a text's own "▁" becomes a blank).
Repeated rows are encoded each for itself; columns that are not named are not
read, so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Entries of a worker's caches: chunks, and pairs of tokens.
CHUNKS, PAIRS = 300_000, 500_000
#: Mark of a prefix whose last token isn't known yet.
UNSET = -(1 << 40)
#: Characters of texts that are encoded before their rows are handed on.
FLUSH_CHARS = 4_000_000


class MergeTable:
    """Encoder and decoder of one model file (merge type, identity normaliser, byte fallback)."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        special = self.byte_of.keys() | self.silent | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark behind another character")
        self.characters = {p for p in self.ids if len(p) == 1}
        self.score = [model.get_score(i) for i in range(size)]
        self.lengths = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.runs = {i for p, i in self.ids.items() if len(p) > 1 and not p.strip(MARK)}
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        #: Chunks: a run of marks and what follows it; line feeds stand alone where no piece has one.
        self.chunk = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + "|\n" * bool(alone))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[array, str]] = {}
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        #: What an id always gives, wherever it stands; None where neighbours or the place count.
        self.plain: list[str | None] = list(self.surface)
        for i in special:
            self.plain[i] = chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else None

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The symbols after all merges of a short text, and the two that merged last: the rule itself."""
        symbols, last = list(text), None
        while True:
            at = max(
                (k for k in range(len(symbols) - 1) if symbols[k] + symbols[k + 1] in self.ids),
                key=lambda k: (self.score[self.ids[symbols[k] + symbols[k + 1]]], -k),
                default=None,
            )
            if at is None:
                return symbols, last
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = ["".join(last)]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single character or one that no merges reach."""
        if token not in self.halves:
            whole, last = self.merges(self.pieces[token])
            ok = len(whole) == 1 and last and all(x in self.ids for x in last)
            self.halves[token] = (self.ids[last[0]], self.ids[last[1]]) if ok else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return self.lengths[token] == 1 or self.split(token) is not None

    def touching(self, a: int, b: int) -> bool:
        """Whether token b can follow token a in an encoding."""
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._touching(a, b)
        return found

    def _touching(self, a: int, b: int) -> bool:
        pieces, ids, score = self.pieces, self.ids, self.score
        if not self.reachable(b):
            return False
        if a in self.runs or b in self.runs:  # runs of marks share one score, so only the rule itself orders their merges
            return self.merges(pieces[a] + pieces[b])[0] == [pieces[a], pieces[b]]
        before, ties = float("-inf"), False  # a merge across the boundary counts if its score is above this (or equal, with ties)
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and (score[joined] > before or ties and score[joined] == before):
                return False
            left, right = self.split(a), self.split(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and score[a] < score[b]:
                before, ties, a = score[a], False, left[1]  # of equal merges the left one comes first
            else:
                before, ties, b = score[b], True, right[0]

    def table(self, text: str) -> list[int]:
        """Each prefix's last token, by length; characters that no piece has are -1 minus their code."""
        last = [UNSET] * (len(text) + 1)
        if not self.characters.issuperset(text):
            # a character without a piece is a token by itself, and nothing merges across it
            for end, c in enumerate(text, 1):
                if c not in self.characters:
                    last[end] = -1 - ord(c)
        lengths, fits, touching = self.lengths, self.fits.get, self.touching
        for at, token in self.automaton.iter(text):
            if last[at + 1] != UNSET:
                continue
            start = at + 1 - lengths[token]
            before = last[start]
            if not start:
                if not self.reachable(token):
                    continue
            elif before >= 0:
                fit = fits(before << 20 | token)
                if not (touching(before, token) if fit is None else fit):
                    continue
            elif before == UNSET or not self.reachable(token):
                continue
            last[at + 1] = token
        if UNSET in last[1:]:
            raise ValueError("no token ends a prefix: the model's merges are not consistent")
        return last

    def chunk_ids(self, text: str) -> array:
        last, end, back = self.table(text), len(text), []
        while end:
            token = last[end]
            if token >= 0:
                back.append(token)
                end -= self.lengths[token]
            else:
                back.extend(self.bytes[x] for x in reversed(chr(-1 - token).encode()))
                end -= 1
        return array("i", reversed(back))

    def longer(self, chunk: str) -> array | None:
        """A chunk's ids from those of all but its last character, if that stays a token of its own there."""
        before, token = self.known.get(chunk[:-1]), self.ids.get(chunk[-1])
        if before and token is not None and before[-1] not in self.byte_of and self.touching(before[-1], token):
            out = array("i", before)
            out.append(token)
            return out
        return None

    def encode(self, text: str) -> array:
        ids = array("i")
        if not text:
            return ids
        known = self.known
        for chunk in self.chunk.findall(MARK + text.replace(" ", MARK)):
            found = known.get(chunk)
            if found is None:
                found = self.longer(chunk) or self.chunk_ids(chunk)
                if len(chunk) <= 64:
                    if len(known) >= CHUNKS:
                        known.clear()
                    known[chunk] = found
            ids.extend(found)
        return ids

    def decode(self, ids) -> str:
        if len(ids) and ids[0] not in self.byte_of:
            try:
                text = "".join([self.plain[i] for i in ids])
            except TypeError:
                return self._decode(ids)
            return text[1:] if text.startswith(" ") else text
        return self._decode(ids)

    def _decode(self, ids) -> str:
        out: list[str] = []
        raw = bytearray()
        first = True
        surface, byte_of = self.surface, self.byte_of
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                first = False
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i in self.silent:
                continue
            part = " ⁇ " if i == self.unknown else surface[i]
            if first and i != self.unknown and part.startswith(" "):
                part = part[1:]
            first = False
            out.append(part)
        if raw:
            out.append(_utf8(raw))
        return "".join(out)


def _utf8(raw: bytearray) -> str:
    """UTF-8 decoding in which each byte that starts no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, rest = [], bytes(raw)
        while rest:
            try:
                out.append(rest.decode())
                break
            except UnicodeDecodeError as e:
                out.append(rest[: e.start].decode() + "�")
                rest = rest[e.start + 1 :]
        return "".join(out)


_tables: dict[str, MergeTable] = {}


def table_of(model_path: str) -> MergeTable:
    """The worker's encoder for a model file, made once."""
    if model_path not in _tables:
        _tables[model_path] = MergeTable(model_path)
    return _tables[model_path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """Returns id, ids (array of int), decoded (the text that the ids give back) and the columns ``also``, a row for each row of ``docs``."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *also)
    schema = T.StructType([given.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), *given.schema[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = table_of(model_path)
        for batch in batches:
            texts = batch.column(1)
            start, chars, ids, ends, decoded = 0, 0, array("i"), [0], []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                own = coder.encode(text)
                ids.extend(own)
                ends.append(len(ids))
                decoded.append(coder.decode(own))
                chars += len(text)
                if chars >= FLUSH_CHARS or k == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(ids) if len(ids) else [], pa.int32()))
                    own = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([own.column(0), lists, pa.array(decoded, pa.string()), *own.columns[2:]], schema.names)
                    start, chars, ids, ends, decoded = k + 1, 0, array("i"), [0], []

    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
