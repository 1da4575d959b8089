"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``WIDTHS`` bits, lowest first. Level k holds the
k-th chunk of every id that has one, one byte each, with a bitmap that says
which of them go on in level k + 1 and a directory of the set bits before each
64-bit word. The place of an id in level k + 1 is the rank of its bit in level
k, so any id is read by a few look-ups, without decoding those around it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aircapture.llm.common import kept_in_worker, shared_folder

LEVELS = 4  # 8 bits each: any unsigned 32-bit id
SEGMENT = 1 << 19  # ids of a row of the file, but for longer documents
#: Pieces that a worker remembers, and characters of the longest one it does.
MEMORY, LONG = 700_000, 64


def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, bitmap, directory) of each level."""
    out, rest = [], ids.astype(np.uint32)
    for _ in range(LEVELS):
        more = rest >= 256
        words = np.zeros((len(rest) + 63) // 64 * 64, np.uint8)
        words[: len(rest)] = more
        bits = np.packbits(words, bitorder="little")
        ones = np.bitwise_count(bits.view(np.uint64)).astype(np.uint32)
        directory = np.cumsum(ones, dtype=np.uint32) - ones
        out.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    return out


class Codes:
    """Reads ids out of packed levels."""

    def __init__(self, levels: list[tuple[bytes, bytes, bytes]]) -> None:
        self.levels = [
            (np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint64), np.frombuffer(d, "<u4")) for c, b, d in levels
        ]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        out = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << 8 * k
            word, bit = int(bits[i >> 6]), i & 63
            if not word >> bit & 1:
                break
            i = int(directory[i >> 6]) + (word & ((1 << bit) - 1)).bit_count()
        return out

    def all(self) -> np.ndarray:
        above = None
        for chunks, bits, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            if above is not None:
                more = np.unpackbits(bits.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)
                ids[more] |= above << np.uint32(8)
            above = ids
        return above


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space of any tokenizer's reading but the space and the line feed.
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + ("\u180e", "\u200b", "\ufeff")
_INK = f"[^\\s{''.join(_OTHER_SPACE[-3:])}]"
#: A space between two characters that are no white space, and the place before a line feed between two such:
#: the byte-level pre-tokenizer always starts a new token there.
_BETWEEN = re.compile(f"(?<={_INK}) (?={_INK})|(?<={_INK})(?=\n{_INK})")


def cut_text(text: str) -> list[str]:
    """The text in pieces: those after the first have a space before them in the text, unless they begin with a line feed."""
    if text[-1:] == " " or any(c in text for c in ("  ", " \n", "\n ", "\n\n", *_OTHER_SPACE)):
        return _BETWEEN.split(text)
    return text.replace("\n", " \n").split(" ")  # only single spaces and line feeds


class TextEncoder:
    """Ids of whole texts by the tokenizers library, remembering the pieces between single spaces and line feeds.

    Pieces of more than ``LONG`` characters are not remembered, so what is
    remembered is bounded in bytes, too. Where the vocabulary file does not say
    that texts are cut as :data:`_BETWEEN` takes for granted, whole texts are
    encoded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        self.in_pieces = (
            told["model"].get("type") == "BPE"
            and not told["model"].get("dropout")
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and told.get("normalizer") is None
            and not any(
                t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                for t in told.get("added_tokens") or []
            )
        )
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.starts = np.array([t.startswith(("Ġ", "Ċ")) for t in tokens])
        self.known: dict[str, bytes] = {}
        if not self.in_pieces:
            return
        # how the byte-level vocabulary shows the bytes of Latin letters outside ASCII
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.shown = {b: 256 + i for i, b in enumerate(hidden)}
        self.ends = {c: self._ids([c])[0].tobytes() for c in ".,"}
        self.line = self._ids(["\n"])[0].tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _merged(self, letters: str, before: str) -> bytes:
        """Ids of letters, with a space before them or not: one pre-token, so the merges alone decide."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(before + shown)]).tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        """Words of Latin letters, also with a full stop or comma behind, are pre-tokens whose merges are asked
        for directly; what begins a line comes after the line feed's own token. Other pieces without white
        space inside are encoded side by side: of their tokens just the first ones begin with white space."""
        known, ends = self.known, self.ends
        plain, odd = [], []
        for p in pieces:
            end = ends.get(p[-1:])
            word = p[:-1] if end else p
            begins = word[:1] == "\n"
            if begins:
                word = word[1:]
            if word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                if begins:
                    known[p] = self.line + self._merged(word, "") + (end or b"")
                else:
                    same = known.get(word) if end else None
                    known[p] = (same or self._merged(word, "Ġ")) + (end or b"")
            elif len(p.split()) == 1:
                plain.append(p if begins else f" {p}")
            else:
                odd.append(p if begins else f" {p}")
        for at in range(0, len(plain), 500):
            mine = plain[at : at + 500]
            ids = self._ids(["".join(mine)])[0]
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(mine):
                data, ends_at = ids.tobytes(), [*(first * 4).tolist(), len(ids) * 4]
                parts = [data[a:b] for a, b in zip(ends_at, ends_at[1:], strict=False)]
            else:
                parts = [i.tobytes() for i in self._ids(mine)]
            known.update(zip((p.removeprefix(" ") for p in mine), parts, strict=True))
        known.update(zip((p.removeprefix(" ") for p in odd), (i.tobytes() for i in self._ids(odd)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.in_pieces:
            return [i.tobytes() for i in self._ids(texts)]
        split = [cut_text(t) for t in texts]
        heads = self._ids([s[0] for s in split])
        tails = [s[1:] for s in split]
        known = self.known
        wanted = set().union(*tails)
        new = wanted.difference(known)
        if len(new) + len(known) > MEMORY:  # what these texts use stays
            known = self.known = {p: known[p] for p in wanted.difference(new)}
        if new:
            self._learn(new)
        out = [h.tobytes() + b"".join(map(known.__getitem__, s)) for h, s in zip(heads, tails, strict=True)]
        for p in new:
            if len(p) > LONG:
                del known[p]
        return out


_LEVEL = "struct<chunks: binary, bits: binary, ranks: binary>"
_FILE = f"shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, levels array<{_LEVEL}>"


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 0) -> None:
    """Write the ids of all documents, in ascending order of doc_id (null first, then text), to ``folder``.

    A row of the file is a segment: some whole documents of one range of
    doc_id, their lengths, and the packed levels of their ids. ``end_id`` ends
    each document. A null text counts as empty.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = kept_in_worker("addressable", path, TextEncoder)
        shard, segment = TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.uint32(end_id).tobytes()
        names, parts, held = [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), np.uint32)
            levels = [dict(zip(("chunks", "bits", "ranks"), level, strict=True)) for level in pack(ids)]
            record = {
                "shard": shard, "segment": segment, "doc_ids": list(names),
                "lengths": [len(p) // 4 for p in parts], "n_ids": len(ids), "levels": levels,
            }
            return pa.RecordBatch.from_pylist([record], schema=_arrow())

        for b in batches:
            for at in range(0, b.num_rows, 300):
                part = b.slice(at, 300)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    names.append(doc_id)
                    parts.append(ids + end)
                    held += len(parts[-1]) // 4
                    if held >= SEGMENT:
                        yield row()
                        segment, held = segment + 1, 0
                        names.clear()
                        parts.clear()
        if names:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _FILE).write.option("compression", "none").parquet(folder)


def _arrow() -> pa.Schema:
    level = pa.struct([("chunks", pa.binary()), ("bits", pa.binary()), ("ranks", pa.binary())])
    longs = pa.list_(pa.int64())
    return pa.schema(
        [("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", longs), ("lengths", longs), ("n_ids", pa.int64()), ("levels", pa.list_(level))]
    )


def read(spark, folder: str) -> DataFrame:
    """doc_id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, from the files.

    Places come from running sums over the segments' sizes: within a shard,
    and over one row per shard.
    """
    files = spark.read.parquet(folder)
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("offset", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard")
    places = places.select("shard", "segment", (F.col("base") + F.col("offset")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                ids = Codes([(x["chunks"], x["bits"], x["ranks"]) for x in row["levels"]]).all().astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                crc = [zlib.crc32(d) for d in (ids[e - n : e].tobytes() for e, n in zip(ends, row["lengths"], strict=True))]
                n = pa.array(row["lengths"], pa.int64())
                at = pa.array(ends - np.array(row["lengths"], np.int64))
                same = lambda c: pa.array([row[c]] * len(n), pa.int32())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same("shard"), same("segment"), pa.array(row["doc_ids"], pa.int64()), at, n, pa.array(crc, pa.int64())],
                    ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = files.select("shard", "segment", "doc_ids", "lengths", "levels").mapInArrow(
        run, "shard int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return decoded.join(places, ["shard", "segment"]).select(
        "doc_id", (F.col("place") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the ids to a fresh folder below the shared one and read the digest of each document back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return read(spark, folder)
