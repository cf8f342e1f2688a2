"""SentencePiece encoding and decoding of whole texts through a merge-type prefix table.

A prefix of a text has one encoding, so it has one last token. The table stores it for each prefix: an automaton names the pieces that end
there, and the one that goes with the last token of what precedes it is the one, as a sequence is an encoding just if each pair of its
neighbours is. A pair is tested by replaying both pieces' merges up to the first that would cross their border. The ids are then recovered
from the table backwards. No queue of merges is kept, and the work grows with the text's length.

A text is first cut where no piece can span, before a white-space mark that follows another symbol; words met before are looked up.

Defined results: a null or empty text has only the begin and end ids; a symbol that the vocabulary lacks becomes its bytes, or the unknown
id where the model has no byte pieces; repeated rows and null ids are encoded one by one; extra columns pass through the operator's frame
only if named in keep; an empty table gives no row.
"""

from __future__ import annotations

import re
from array import array
from pathlib import Path
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what the library shows for the unknown id
NEVER = 1 << 40
WORDS, WORD_CHARS, PAIRS = 300_000, 48, 500_000  # bounds of what a worker remembers
PART = 1 << 18  # characters that are cut into words at once


class Codec:
    """One model's vocabulary with its prefix-table encoder and its decoder."""

    def __init__(self, model: bytes):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces aren't supported")
        self.pieces = [sp.id_to_piece(i) for i in ids]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in ids]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}  # low ones merge first
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = np.full(len(self.pieces), -1, np.int16)
        for b, i in self.bytes.items():
            self.byte_of[i] = b
        self.shown = ["" if sp.is_control(i) else UNKNOWN_SURFACE if sp.is_unknown(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        raw = [x.encode() for x in self.shown]
        self.shown_sizes = np.array([len(x) for x in raw])
        self.shown_at = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown_raw = np.frombuffer(b"".join(raw), np.uint8)
        self.skips_space = sp.normalize("x")[:1] == SPACE  # a mark is put before the text, so the decoder takes one away
        spans = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.word = re.compile("(?s).+" if spans else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.cut = None if spans else re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
        self.found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.found.add_word(p, (i, len(p)))
        self.found.make_automaton()
        self.sizes = list(map(len, self.pieces))
        self.steps: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # words met lately
        self.older: dict[str, bytes] = {}  # those met before them

    def merges(self, piece: int) -> tuple | None:
        """The merges that build a piece, as (rank, first symbol, last symbol) after each; None if its symbols don't merge into it."""
        if piece not in self.steps:
            parts, out = list(self.pieces[piece]), []
            first, last = parts[0], parts[-1]
            while len(parts) > 1:
                r, k = min((self.rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if r == NEVER:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                out.append((r, parts[0], parts[-1]))
            self.steps[piece] = (first, last, out) if len(parts) == 1 else None
        return self.steps[piece]

    def goes_with(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are: no symbol pair across their border merges before its symbols are used up.

        left: -1 for the start of a word or a symbol that no piece has; then it matters only that right's symbols merge into it.
        """
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if left < 0 or not self.merges(right):
                self.pairs[key] = bool(self.merges(right))
                return self.pairs[key]
            _, a, before = self.merges(left)
            b, _, after = self.merges(right)
            i = j = 0
            while True:
                x = before[i][0] if i < len(before) else NEVER
                y = after[j][0] if j < len(after) else NEVER
                across = self.rank.get(a + b, NEVER)
                if across < x and across <= y and across < NEVER:  # of equal ranks the leftmost merges first
                    known = False
                    break
                if x == y == NEVER:
                    known = True
                    break
                if x <= y:
                    a, i = before[i][2], i + 1
                else:
                    b, j = after[j][1], j + 1
            self.pairs[key] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word by its prefix table."""
        n, pairs = len(word), self.pairs
        last = [-1] * (n + 1) if n < PART else array("i", [-1]) * (n + 1)  # last token of each prefix; -1: a symbol of its own that no piece has
        for end, (piece, size) in self.found.iter(word):
            end += 1
            if last[end] < 0:
                left = last[end - size] if size <= end - 1 else -1
                known = pairs.get(left << 24 | piece)
                if self.goes_with(left, piece) if known is None else known:
                    last[end] = piece
        out, at = [], n
        while at:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= self.sizes[piece]
            else:
                at -= 1
                raw = word[at].encode()
                out += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.library.unk_id()]
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            ids = self.word_ids(word)
            out = pack(f"<{len(ids)}I", *ids) if len(ids) < PART else np.array(ids, "<u4").tobytes()
        if len(word) <= WORD_CHARS:
            if len(self.words) >= WORDS:
                self.words, self.older = {}, self.words
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        text = self.library.normalize(text) if text else ""
        out, lo = [], 0
        while lo < len(text):
            hi = len(text)
            if self.cut and hi - lo > PART:
                edge = self.cut.search(text, lo + PART)
                hi = edge.start() if edge else hi
            out.append(b"".join([self.words.get(w) or self._word(w) for w in self.word.findall(text, lo, hi)]))
            lo = hi
        ends = [np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (self.library.bos_id(), self.library.eos_id())]
        return b"".join([ends[0], *out, ends[1]])

    def joined(self, ids: np.ndarray) -> str:
        """The shown forms of ids one after the other, gathered from one buffer of them all."""
        sizes = self.shown_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.shown_at[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.shown_raw[at].tobytes().decode()

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, marks as spaces, byte pieces as UTF-8 with one replacement mark for each byte that isn't."""
        a = np.frombuffer(ids, "<u4")
        raw = self.byte_of[a]
        edges = np.flatnonzero(np.diff(raw >= 0)) + 1
        out, fresh = [], self.skips_space  # fresh: nothing shown yet, the mark before the text is still to be taken away
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(a)]):
            if hi > lo and raw[lo] >= 0:
                out.append(shown_bytes(raw[lo:hi].astype(np.uint8).tobytes()))
                fresh = False
                continue
            while fresh and lo < hi:
                piece = self.shown[a[lo]]
                if piece:
                    out.append(piece[1:] if self.pieces[a[lo]][:1] == SPACE else piece)
                    fresh = False
                lo += 1
            out += [self.joined(a[k : min(k + PART, hi)]) for k in range(lo, hi, PART)]
        return "".join(out)


def shown_bytes(raw: bytes) -> str:
    """UTF-8 text; each byte that isn't part of a whole character becomes one replacement mark."""
    out, lo = [], 0
    while lo < len(raw):
        try:
            out.append(raw[lo:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[lo : lo + e.start].decode() + "�")
            lo += e.start + 1
    return "".join(out)


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """The worker's codec of a model; the last one is kept."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def model_bytes(path: str) -> bytes:
    """A model file (half a megabyte or so) that travels with the tasks, as executors may not see the driver's folders."""
    return Path(path).read_bytes()


def encoded(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each row: ids as little-endian unsigned 32-bit integers, begin and end ids included. One pass, nothing is shuffled."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            ids = [c.encode(batch.column(1)[i].as_py() or "") for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and the text of each row's ids (null: no text). Ids beyond the vocabulary are an error."""
    kept = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids_col}`").cast("binary").alias("__ids"))

    def run(batches):
        c = codec(model)
        for batch in batches:
            ids = batch.column(len(keep))
            text = pa.array([None if (x := ids[i].as_py()) is None else c.decode(x) for i in range(len(batch))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], text], names=[*keep, out_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(keep)]) + f"`{out_col}` string"
    return bounded_batches(kept).mapInArrow(run, schema)
