"""SentencePiece vocabularies: streaming Viterbi encoding, and decoding."""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aircapture.llm.common import kept_in_worker

SPACE = "▁"
#: Weight of a byte piece: worse than any piece of the vocabulary.
BYTE_SCORE = -20.0
#: Remembered segments of a worker; it starts anew when full.
MEMORY = 350_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces, their ids and weights.

    The file holds merge ranks, not probabilities, so a piece of rank r weighs
    -log(r), as frequencies that fall with the rank would have it.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids, self.bytes_of, self.longest = [0] * 256, [b""] * model.get_piece_size(), 1
        self.trie = ({}, [])  # (next by character, [(id, weight)] if a piece ends here)
        first = None
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:-1], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
                continue
            first = i if first is None else first
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
            self.longest = max(self.longest, len(piece))
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, ({}, []))
            node[1].append((i, -math.log(i - first + 2)))
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece goes over a space")


def advance(v: Vocabulary, text: str, score: list[float], back: list, lo: int, hi: int) -> None:
    """Extend the best paths by all pieces that start at boundaries from ``lo`` to before ``hi``."""
    n, root = len(text), v.trie[0]
    for i in range(lo, hi):
        here, children, single = score[i], root, False
        for j in range(i, n):
            node = children.get(text[j])
            if node is None:
                break
            children, piece = node
            if piece:
                single = single or j == i
                p = piece[0]
                s = here + p[1]
                if s > score[j + 1]:
                    score[j + 1] = s
                    back[j + 1] = (i, p[0])
        if not single:
            s = here + BYTE_SCORE * len(text[i].encode("utf-8", "surrogatepass"))
            if s > score[i + 1]:
                score[i + 1] = s
                back[i + 1] = (i, -1)


def path_to(v: Vocabulary, text: str, back: list, at: int) -> list[int]:
    """The ids of the best path to a boundary."""
    path: list[int] = []
    while at > 0:
        start, piece = back[at]
        if piece >= 0:
            path.append(piece)
        else:
            path.extend(v.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass")))
        at = start
    path.reverse()
    return path


class StreamingViterbi:
    """Best segmentation of a stream of characters, committed as soon as it is certain.

    Keeps the characters and backpointers behind the last committed boundary.
    Every path to a later boundary passes one of the last ``longest``
    boundaries; once the backpointers of all of those lead through one common
    boundary, the pieces before it are final: they are emitted and forgotten.
    Of paths of equal weight the one with the longest last piece wins.
    """

    def __init__(self, vocabulary: Vocabulary, every: int = 64) -> None:
        self.v, self.every = vocabulary, every
        self.out = array("i")
        self.held = 0  # most characters held at once, for tests
        self._reset()

    def _reset(self) -> None:
        self.text, self.score, self.back, self.done = "", [0.0], [None], 0

    def feed(self, chars: str) -> None:
        """More characters of the stream."""
        for at in range(0, len(chars), self.every):
            self.text += chars[at : at + self.every]
            self.score += [-math.inf] * (len(self.text) + 1 - len(self.score))
            self.back += [None] * (len(self.text) + 1 - len(self.back))
            # pieces that start where every possible piece is already in the window
            self._extend(len(self.text) - self.v.longest)
            self.held = max(self.held, len(self.text))
            self._commit()

    def finish(self) -> array:
        """No more characters: the ids of what was held, after all committed before."""
        self._extend(len(self.text))
        self._emit(len(self.text))
        self._reset()
        out, self.out = self.out, array("i")
        return out

    def _extend(self, upto: int) -> None:
        advance(self.v, self.text, self.score, self.back, self.done, upto)
        self.done = max(self.done, upto)

    def _commit(self) -> None:
        if self.done <= 0:
            return
        reached = {j for j in range(self.done, len(self.text) + 1) if self.back[j] or j == self.done}
        while len(reached) > 1:
            last = max(reached)
            reached.discard(last)
            reached.add(self.back[last][0] if self.back[last] else 0)
        (at,) = reached
        if at:
            self._emit(at)
            self.text = self.text[at:]
            base = self.score[at]
            self.score = [s - base for s in self.score[at:]]
            self.back = [b and (b[0] - at, b[1]) for b in self.back[at:]]
            self.back[0] = None
            self.done -= at

    def _emit(self, at: int) -> None:
        self.out.extend(path_to(self.v, self.text, self.back, at))


class Encoder:
    """Ids of whole texts. All paths meet before each space, since no piece goes over one,
    so what lies between two such boundaries is encoded on its own and remembered."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.known: dict[str, bytes] = {}

    def _segment(self, segment: str) -> bytes:
        n = len(segment)
        if n <= 64:  # no longer than the window
            score, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
            advance(self.v, segment, score, back, 0, n)
            return array("i", path_to(self.v, segment, back, n)).tobytes()
        s = StreamingViterbi(self.v)
        s.feed(segment)
        return s.finish().tobytes()

    def encode(self, text: str) -> bytes:
        """int32 ids, as bytes."""
        if not text:
            return b""
        segments = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
        if "" in segments:  # runs of spaces belong to one segment
            merged, run = [], ""
            for s in segments:
                run += SPACE + s
                if s:
                    merged.append(run)
                    run = ""
            segments = [*merged, run] if run else merged
        else:
            segments = [SPACE + s for s in segments]
        known = self.known
        try:
            return b"".join([known[s] for s in segments])
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for s in segments:
                if s not in known:
                    known[s] = self._segment(s)
            return b"".join([known[s] for s in segments])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for, without the space put before it."""
        return b"".join(map(self.v.bytes_of.__getitem__, memoryview(ids).cast("i")))[1:]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ``ids``, ``n_ids``, ``ids_crc32`` (of little-endian int32) and ``round_trip``.

    ``round_trip`` says that the ids decode to the text again; a text with the
    character U+2581 decodes it as a space and so has false. Null counts as
    empty, and an empty text has no ids. One row per input row.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("pieces", path, Encoder)
        for b in batches:
            texts = b.column("text")
            for at in range(0, len(texts), 500):
                part = texts.slice(at, 500).to_pylist()
                found = [encoder.encode(t or "") for t in part]
                same = [encoder.decode(i) == (t or "").encode() for i, t in zip(found, part, strict=True)]
                n = np.array([len(i) // 4 for i in found], np.int64)
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                crc = pa.array([zlib.crc32(i) for i in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, 500), ids, pa.array(n), crc, pa.array(same)],
                    ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"],
                )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` of rows with ``ids``; null ids give a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("pieces", path, Encoder)
        for b in batches:
            texts = [
                None if i is None else encoder.decode(np.array(i, np.int32).tobytes()).decode("utf-8", "replace")
                for i in b.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")
