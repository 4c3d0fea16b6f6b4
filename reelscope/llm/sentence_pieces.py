"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled once per worker: a normaliser (white space to its symbol, a symbol in front), the pieces as arcs
from text to ids, and byte arcs for characters that no piece has.  Composed with an input, this is an acyclic graph over the
positions of the input, and the encoding is its shortest path in the tropical semiring (weights add along a
path, the least path wins).

For a unigram model the weight of an arc is minus its piece's score.  For a merge (BPE) model, the sum of scores is not what
merging maximises.  There the graph is composed with one more machine that remembers the last piece and gives a pair
of neighbours the weight infinity unless merging their joined text gives back exactly these two.  A sequence whose
neighbouring pairs all pass is the one that merging yields, so the finite path is unique, and one state per position is enough.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import table

SYMBOL = "▁"
MEMORY_SEGMENTS = 500_000
MEMORY_PAIRS = 1_000_000
INFINITY = float("inf")
UNIGRAM, MERGES = 1, 2
#: Weight of leaving the pieces for one character: worse than any piece.
_UNKNOWN = 1e6

_worker: dict = {}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised protocol-buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at: at + size]
            at += size


class Transducer:
    """A compiled model: ``encode`` and ``decode`` agree with the library's for models without a character map."""

    def __init__(self, model: bytes) -> None:
        self.pieces: dict[str, int] = {}
        self.scores: list[float] = []
        self.texts: list[bytes] = []
        self.bytes_: dict[int, int] = {}
        self.unknown, self.kind, prefix, fallback = 0, UNIGRAM, True, False
        names = []
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                i = len(names)
                names.append(piece)
                self.scores.append(score)
                self.texts.append(piece.encode() if kind in (1, 4, 5) else b"")
                if kind == 1:
                    self.pieces[piece] = i
                elif kind == 2:
                    self.unknown = i
                    self.texts[i] = " ⁇ ".encode()
                elif kind == 6:
                    self.bytes_[int(piece[1:-1], 16)] = i
                    self.texts[i] = bytes([int(piece[1:-1], 16)])
                elif kind == 4:
                    raise ValueError("models with user-defined pieces are not supported")
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("models whose normaliser maps characters or drops white space are not supported")
                prefix = bool(spec.get(3, 1))
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("neither a unigram nor a merge model")
        if any(SYMBOL in x.lstrip(SYMBOL) for x in self.pieces):
            raise ValueError("pieces reach across white space")
        self.prefix = SYMBOL if prefix else ""
        self.byte_fallback = fallback and len(self.bytes_) == 256
        self.begun = {x[:k]: -1 for x in self.pieces for k in range(1, len(x))} | self.pieces
        self.names = names
        self.cuts_lines = not any("\n" in x for x in self.pieces)
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """A short text after all merges: always the best-scored neighbours, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                piece = self.pieces.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """The pair machine: whether merging the joined text leaves these two; ``left`` -1 is the start."""
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        pair = [self.names[left], self.names[right]] if left >= 0 else [self.names[right]]
        known = self.pairs[left << 32 | right] = self.merged("".join(pair)) == pair
        return known

    def _by_score(self, segment: str) -> tuple[list[int], list[int]]:
        """Pieces and where they end on the best path; weights are minus the scores."""
        n = len(segment)
        far, last, back = [0.0] + [INFINITY] * n, [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            here = far[start]
            if self.begun.get(segment[start], -1) < 0:
                far[start + 1], last[start + 1], back[start + 1] = min(
                    (far[start + 1], last[start + 1], back[start + 1]), (here + _UNKNOWN, -2, start)
                )
            for end in range(start + 1, n + 1):
                piece = self.begun.get(segment[start:end])
                if piece is None:
                    break
                if piece >= 0 and here - self.scores[piece] < far[end]:
                    far[end], last[end], back[end] = here - self.scores[piece], piece, start
        pieces, ends, at = [], [], n
        while at:
            pieces.append(last[at])
            ends.append(at)
            at = back[at]
        return pieces[::-1], ends[::-1]

    def _by_merges(self, segment: str) -> tuple[list[int], list[int]]:
        """Pieces and where they end on the finite path under the pair machine: weights are 0 or infinity.

        Searched depth first, longest pieces first.  What is finite up to a position is the one encoding of the text before it,
        so a position from which the end can't be reached is never tried again.
        """
        n, pairs = len(segment), self.pairs.get
        pieces, ends, ways, dead, left = [], [], [], set(), -1
        arcs = self._arcs(segment, 0)
        while True:
            if arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                if left != -2 and piece != -2:
                    allowed = pairs(left << 32 | piece)
                    if not (self.may_follow(left, piece) if allowed is None else allowed):
                        continue
                pieces.append(piece)
                ends.append(end)
                if end == n:
                    return pieces, ends
                ways.append(arcs)
                left, arcs = piece, self._arcs(segment, end)
            else:
                dead.add(ends.pop())
                pieces.pop()
                left, arcs = pieces[-1] if pieces else -1, ways.pop()

    def _arcs(self, segment: str, start: int) -> list[tuple[int, int]]:
        """Arcs from ``start``, the longest piece last."""
        begun, found, end, n = self.begun.get, [], start + 1, len(segment)
        piece = begun(segment[start:end])
        if piece is None or piece < 0:
            found.append((end, -2))
        while piece is not None:
            if piece >= 0:
                found.append((end, piece))
            if end == n:
                break
            end += 1
            piece = begun(segment[start:end])
        return found

    def shortest_path(self, segment: str) -> list[int]:
        """Ids along the shortest path of the composed graph; -2 stands for a character without a piece meanwhile.

        Arcs are composed as they are needed: from each position, pieces are followed while some piece begins with the text.
        """
        if not segment:
            return []
        pieces, ends = self._by_merges(segment) if self.kind == MERGES else self._by_score(segment)
        if -2 not in pieces:
            return pieces
        ids: list[int] = []
        for piece, start, end in zip(pieces, [0, *ends], ends):
            if piece != -2:
                ids.append(piece)
            elif self.byte_fallback:
                ids.extend(self.bytes_[x] for x in segment[start:end].encode())
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknown characters are one
                ids.append(self.unknown)
        return ids

    def cut(self, text: str) -> list[str]:
        """Segments of the normalised text: no piece reaches from one into the next."""
        if not text:
            return []
        found, lead = [], self.prefix
        for line in text.split("\n") if self.cuts_lines else [text]:
            if found:
                found.append("\n")
            if "  " in line or SYMBOL in line or line[:1] == " " or line[-1:] == " ":
                found += re.findall(f"{SYMBOL}*[^{SYMBOL}]+|{SYMBOL}+", lead + line.replace(" ", SYMBOL))
            elif line or lead:
                words = line.split(" ")
                found.append(lead + words[0])
                found += [SYMBOL + x for x in words[1:]]
            if not found:
                found.append("")
            lead = ""
        return found

    def encode(self, text: str) -> np.ndarray:
        found = self.cut(text)
        young, old = self.segments, self.older
        try:
            return np.frombuffer(b"".join([young[x] for x in found]), np.uint32)
        except KeyError:
            pass
        for x in found:
            if x not in young:
                ids = old.get(x)
                young[x] = np.array(self.shortest_path(x), np.uint32).tobytes() if ids is None else ids
        ids = np.frombuffer(b"".join([young[x] for x in found]), np.uint32)
        if len(young) >= MEMORY_SEGMENTS:  # what isn't asked for again goes with the older half
            self.older, self.segments = young, {}
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(self.prefix).replace(SYMBOL, " ")


def transducer(path: str) -> Transducer:
    """The model at ``path``, compiled once per worker process."""
    if path not in _worker:
        with open(path, "rb") as file:
            _worker[path] = Transducer(file.read())
    return _worker[path]


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` of every whole text (null: empty, no ids)."""

    def run(batches):
        machine = transducer(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([machine.encode(x.as_py() or "").tolist() for x in batch.column(1)],
                                           pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_texts(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give a null text."""

    def run(batches):
        machine = transducer(model_path)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_ids, n_byte_ids, ids_crc32, round_trip`` of every whole text, ids and texts staying in the task.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers; ``n_byte_ids`` counts ids of byte fallback.
    ``round_trip`` says whether decoding gives the text back, which it does unless the text itself contains the
    white-space symbol.  A null text is empty and has no ids.  Repeated rows are encoded row by row; an empty
    table gives an empty result; only the id and the text are read.
    """

    def run(batches):
        machine = transducer(model_path)
        fallback = np.zeros(len(machine.names), bool)
        fallback[list(machine.bytes_.values())] = True
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = machine.encode(text)
                rows.append((len(ids), int(fallback[ids].sum()), zlib.crc32(ids.astype("<u4")),
                             machine.decode(ids.tolist()) == text))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.bool_())],
                names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
