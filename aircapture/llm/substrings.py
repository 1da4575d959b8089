"""Removal of word passages that occur before, by FM-indexes over shards of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from aircapture.llm.common import cut, mix, release, rolling, word_numbers
from aircapture.llm.fmindex import FmIndex

WINDOW = 20
ANCHOR = 6  # a window of 20 has 15 runs of 6, at most 16 for four bits
#: Words of a shard that are indexed at a time.
INDEXED = 600_000
#: Occurrences of an anchor above which its windows are dealt out one by one.
HOT = 20_000
#: Texts and bytes of text whose anchors are sent together.
CHUNK, CHUNK_BYTES = 2000, 8_000_000
#: Anchors that one task counts together.
COUNTED = 500_000
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(2**63)


def anchors(text: bytes, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, first window, windows, whether the number comes again in the text) of the anchors of a text.

    The anchor of a window is that of its k-word runs with the least number, so
    equal windows have anchors of the same number wherever they stand, and
    neighbouring windows mostly share theirs. A number's last four bits give
    way to those of its place, which the least of a window then tells.
    """
    g = rolling(word_numbers(text), k)
    n, span = len(g) - (window - k), window - k + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    low = np.uint64(15)
    least, width = (g & ~low) | (np.arange(len(g)).astype(np.uint64) & low), 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[span - width : span - width + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    numbers, at = least[first] & ~low, np.sort(g & ~low)
    again = np.searchsorted(at, numbers, "right") - np.searchsorted(at, numbers) > 1
    return numbers.view(np.int64), first, np.diff(np.append(first, n)), again


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"), "text")


def _chunks(docs: DataFrame, window: int) -> DataFrame:
    """Some documents a row: digests, compressed texts and anchors, which are computed here and nowhere else.

    ``found`` is how many anchors each text has; ``a`` and ``n`` are their
    scrambled numbers and how many windows each stands for (15 at most, and the
    next begins where one ends), and ``twice`` the numbers that their text has
    again, since one snippet may hold both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=3).compress
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            ids = [b.column(c).to_pylist() for c in ("d", "h")]
            bytes_before, at = np.cumsum([0] + [len(t) for t in texts]), 0
            while at < len(texts):
                full = int(np.searchsorted(bytes_before, bytes_before[at] + CHUNK_BYTES, "right")) - 1
                part = slice(at, max(at + 1, min(at + CHUNK, full)))
                told = [anchors(t, window) for t in texts[part]]
                split = [t.split() for t in texts[part]]
                numbers, _, sizes, again = (np.concatenate(x) for x in zip(*told, strict=True))
                numbers = mix(numbers.view(np.uint64))
                row = {
                    "chunk": chunk, "d": ids[0][part], "h": ids[1][part], "n_words": [len(w) for w in split],
                    "sha": [hashlib.sha256(b" ".join(w)).digest() for w in split],
                    "packed": [squeeze(t) for t in texts[part]], "found": [len(x[0]) for x in told],
                    "a": numbers.tobytes(), "n": sizes.astype(np.uint8).tobytes(),
                    "twice": numbers[again].tobytes(), "total": len(numbers) + int(again.sum()),
                }
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in _CHUNK], [c for c, _ in _CHUNK])
                chunk, at = chunk + 1, part.stop

    kinds = "chunk long, d array<long>, h array<long>, n_words array<long>, sha array<binary>, packed array<binary>, found array<int>"
    return _keyed(docs).mapInArrow(run, f"{kinds}, a binary, n binary, twice binary, total long")


_CHUNK = (
    ("chunk", pa.int64()), ("d", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
    ("sha", pa.list_(pa.binary())), ("packed", pa.list_(pa.binary())), ("found", pa.list_(pa.int32())), ("a", pa.binary()),
    ("n", pa.binary()), ("twice", pa.binary()), ("total", pa.int64()),
)


def _ranges(a: bytes, twice: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct anchors of a chunk in order, how often each occurs, and where each of the 2^bits ranges begins."""
    numbers, counts = np.unique(np.frombuffer(a + twice, np.uint64), return_counts=True)
    return numbers, counts, np.searchsorted(numbers >> np.uint64(64 - bits), np.arange((1 << bits) + 1))


def _repeated(chunks: DataFrame, bits: int) -> DataFrame:
    """For each chunk, (p, again, hot) of each range of numbers: bitmaps of its anchors that come again anywhere.

    A chunk sends each of its anchors once, with its count, so a frequent one
    is added up before the exchange, and gets one bit back for it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, a, twice in zip(*(b.column(c).to_pylist() for c in ("chunk", "a", "twice")), strict=True):
                numbers, counts, borders = _ranges(a, twice, bits)
                ps = np.flatnonzero(np.diff(borders))
                parts = [slice(borders[p], borders[p + 1]) for p in ps]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ps, pa.int64()),
                        pa.array([chunk] * len(ps), pa.int64()),
                        pa.array([numbers[x].tobytes() for x in parts], pa.binary()),
                        pa.array([counts[x].astype(np.uint32).tobytes() for x in parts], pa.binary()),
                    ],
                    ["p", "chunk", "numbers", "counts"],
                )

    def add_up(rows: pa.Table) -> pa.Table:
        parts = rows.column("numbers").to_pylist()
        numbers = np.frombuffer(b"".join(parts), np.uint64)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32)
        order = np.argsort(numbers, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(numbers[order]) != 0]))
        totals = np.empty(len(numbers), np.int64)
        totals[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), first), np.diff(np.append(first, len(numbers))))
        split = np.split(totals, np.cumsum([len(x) // 8 for x in parts])[:-1])
        return pa.table(
            {
                "chunk": rows.column("chunk"),
                "p": rows.column("p"),
                "again": pa.array([np.packbits(t > 1).tobytes() for t in split], pa.binary()),
                "hot": pa.array([np.packbits(t > HOT).tobytes() for t in split], pa.binary()),
            }
        )

    sent = chunks.select("chunk", "a", "twice").mapInArrow(send, "p long, chunk long, numbers binary, counts binary")
    told = sent.groupBy("p").applyInArrow(add_up, "chunk long, p long, again binary, hot binary")
    return told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("p", "again", "hot"))).alias("told"))


def _index(snippets: DataFrame, window: int) -> DataFrame:
    """For each distinct snippet (a, sid, text, first place d, h, s): the first place of each of its n windows.

    ``firsts`` is null where that is the snippet's own first place ``p`` throughout.
    Snippets are dealt out by their anchor, so all that have a window in common
    are in one shard. A task indexes a shard in parts of whole anchors, of which
    none has more than ``HOT`` snippets, and streams the snippets through it:
    where the matching statistics reach a whole window, the least place in its
    suffix interval is the window's first.
    """

    def first_places(rows: list[tuple]) -> pa.RecordBatch:
        a, sid, d, h, s, texts = zip(*rows, strict=True)
        words, symbols = {}, [np.zeros(1, np.int64)]
        for t in texts:
            symbols.append(np.array([words.setdefault(w, len(words) + 1) for w in t.split()] + [0], np.int64))
        lengths = np.array([len(x) for x in symbols[1:]]) - 1
        begins = np.cumsum(np.concatenate([[1], lengths[:-1] + 1]))
        symbols = np.concatenate(symbols)
        index = FmIndex(symbols, len(words) + 1, window)
        matched, lo, hi = index.statistics(symbols, begins, lengths, window)
        n = lengths - window + 1  # windows of each passage
        of = np.repeat(np.arange(len(rows)), n)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = begins[of] + offset
        # first place of all, as one number that orders by document, then by start
        d, h, start = np.array(d, np.int64), np.array(h, np.int64), np.array(s, np.int64)
        order = np.lexsort((h, d))
        new = np.concatenate([[True], (np.diff(d[order]) != 0) | (np.diff(h[order]) != 0)])
        doc = np.empty(len(rows), np.int64)
        doc[order] = np.cumsum(new) - 1
        place = np.full(len(symbols), np.iinfo(np.int64).max)
        place[at] = (doc[of] << 32) + start[of] + offset
        ordered = np.append(place[index.suffixes], np.iinfo(np.int64).max)
        # intervals of whole windows are equal or disjoint
        first = place[at]
        whole = np.flatnonzero(matched[at] >= window)
        begin, where, which = np.unique(lo[at[whole]], return_index=True, return_inverse=True)
        end = hi[at[whole]][where]
        if len(whole):
            first[whole] = np.minimum.reduceat(ordered, np.stack([begin, end], 1).ravel())[::2][which]
        own = np.logical_and.reduceat(first == place[at], np.cumsum(n) - n)
        keep = np.repeat(~own, n)
        first = first[keep]
        names = order[new]
        places = pa.StructArray.from_arrays(
            [pa.array(d[names][first >> 32]), pa.array(h[names][first >> 32]), pa.array((first & 0xFFFFFFFF).astype(np.int32))],
            ["d", "h", "s"],
        )
        offsets = pa.array(np.cumsum(np.concatenate([[0], np.where(own, 0, n)])), pa.int32())
        mine = pa.StructArray.from_arrays([pa.array(d), pa.array(h), pa.array(start.astype(np.int32))], ["d", "h", "s"])
        # null where every window is first at the snippet's own first place
        listed = pa.ListArray.from_arrays(offsets, places, mask=pa.array(own))
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(sid, pa.int64()), mine, pa.array(n, pa.int32()), listed],
            ["a", "sid", "p", "n", "firsts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("a", "sid", "d", "h", "s", "text")), strict=True):
                if held and r[:2] == held[-1][:2]:
                    continue  # a repeated row of its document sent it too
                if size >= INDEXED and r[0] != held[-1][0]:
                    yield first_places(held)
                    held, size = [], 0
                held.append(r)
                size += 30
        if held:
            yield first_places(held)

    return (
        snippets.repartition("a").sortWithinPartitions("a", "sid")
        .mapInArrow(run, "a long, sid long, p struct<d: long, h: long, s: int>, n int, firsts array<struct<d: long, h: long, s: int>>")
    )


def _prepared(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document: d, h, n_words and digest, and its text and anchors that occur more than once if it has such.

    ``a``, ``s`` and ``n`` are their numbers, first windows and windows, and
    ``hot`` tells those that occur more than ``HOT`` times.
    """
    chunks = cut(_chunks(docs, window))
    total = chunks.agg(F.sum("total")).first()[0] or 0
    bits = max(4, (total // COUNTED).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                a, twice = row["a"].as_py(), row["twice"].as_py()
                numbers, _, borders = _ranges(a, twice, bits)
                flags = {c: np.zeros(len(numbers), bool) for c in ("again", "hot")}
                for x in row["told"].as_py() or []:
                    part = slice(borders[x["p"]], borders[x["p"] + 1])
                    for c, flag in flags.items():
                        flag[part] = np.unpackbits(np.frombuffer(x[c], np.uint8), count=part.stop - part.start)
                a = np.frombuffer(a, np.uint64)
                which = np.searchsorted(numbers, a)
                again = flags["again"][which]
                found = np.array(row["found"].as_py())
                n = np.frombuffer(row["n"].as_py(), np.uint8)
                before = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                first = before[:-1] - np.repeat(before[_begins(found)], found)
                kept = [a[again], first[again].astype(np.int32), n[again], flags["hot"][which][again]]
                counts = np.diff(np.concatenate([[0], np.cumsum(again)])[np.append(_begins(found), len(a))])
                ends = np.cumsum(counts)
                parts = [[x[e - k : e].tobytes() if k else None for e, k in zip(ends, counts, strict=True)] for x in kept]
                packed = [t if k else None for t, k in zip(row["packed"].as_py(), counts, strict=True)]
                same = [row[c].values for c in ("d", "h", "n_words", "sha")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(packed, pa.binary()), *(pa.array(x, pa.binary()) for x in parts)],
                    ["d", "h", "n_words", "sha", "packed", "a", "s", "n", "hot"],
                )

    joined = chunks.drop("total").join(_repeated(chunks, bits), "chunk", "left")
    return cut(joined.mapInArrow(run, "d long, h long, n_words long, sha binary, packed binary, a binary, s binary, n binary, hot binary"))


def _begins(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _snippets(prepared: DataFrame, window: int, texts: bool) -> DataFrame:
    """The passages around repeated anchors: (a, sid, d, h, s), with their text or without.

    Those of a hot anchor come window by window, each under the number of the
    whole window instead of the anchor's. Equal windows agree in both, so they
    still meet, but the many different ones do not have to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for part in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                columns = (part.column(c).to_pylist() for c in ("d", "h", "packed", "a", "s", "n", "hot", "at"))
                for d, h, packed, *told, at in zip(*columns, strict=True):
                    found, wanted = unpack(packed).split(), set(at or ())
                    told = [np.frombuffer(x, k).tolist() for x, k in zip(told, (np.int64, np.int32, np.uint8, bool), strict=True)]
                    for a, s, n, dealt in zip(*told, strict=True):
                        pieces = [(o, 1) for o in range(s, s + n)] if dealt else [(s, n)]
                        if texts:  # of the pieces that this document has first
                            pieces = [x for x in pieces if x[0] in wanted]
                        for start, length in pieces:
                            snippet = b" ".join(found[start : start + length + window - 1])
                            sid = xxh3_64_intdigest(snippet) - 2**63
                            key = xxh3_64_intdigest(snippet, seed=1) - 2**63 if dealt else a
                            for held, v in zip(out, (key, sid, d, h, start, snippet), strict=True):
                                held.append(v)
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.binary())
                arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    names = ["a", "sid", "d", "h", "s", *(["text"] if texts else [])]
    affected = prepared.where("a is not null")
    if not texts:
        affected = affected.withColumn("at", F.lit(None).cast("array<int>"))
    affected = affected.select("d", "h", "packed", "a", "s", "n", "hot", "at")
    return affected.mapInArrow(run, "a long, sid long, d long, h long, s int" + ", text binary" * texts)


def _first_places(prepared: DataFrame, window: int) -> DataFrame:
    """What :func:`_index` tells of all snippets."""
    least = F.min(F.struct("d", "h", "s")).alias("p")
    distinct = _snippets(prepared, window, texts=False).groupBy("a", "sid").agg(least)
    # the text of a snippet is sent once, by the document that has it first
    owners = distinct.groupBy("p.d", "p.h").agg(F.collect_set("p.s").alias("at"))
    owners = prepared.where("a is not null").select("d", "h", "packed", "a", "s", "n", "hot").join(owners, ["d", "h"])
    return cut(_index(_snippets(owners, window, texts=True), window))


def _repeats(prepared: DataFrame, window: int) -> DataFrame:
    """d, h and ``again``: of each of a document's anchors (first window, whether each window occurs before)."""
    firsts = _first_places(prepared, window)
    release(prepared.sparkSession, wait=2)
    # a snippet's own first place is the first of all its windows unless the index knows an earlier one
    told = _snippets(prepared, window, texts=False).join(firsts, ["a", "sid"]).select(
        "d", "h", "s",
        F.when(F.col("firsts").isNull(), F.array(F.struct("d", "h", "s") > F.col("p")))
        .otherwise(
            F.transform("firsts", lambda f, o: f < F.struct(F.col("d"), F.col("h"), (F.col("s") + o).alias("s")))
        )
        .alias("before"),
        "n",
    )
    told = told.where(F.exists("before", lambda x: x))
    # one flag stands for all windows of a snippet without variants
    whole = F.when(F.size("before") < F.col("n"), F.array_repeat(F.get("before", F.lit(0)), F.col("n"))).otherwise(F.col("before"))
    return told.groupBy("d", "h").agg(F.collect_set(F.struct("s", whole.alias("before"))).alias("again"))


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_words, n_removed, kept_sha256, kept_text, spans.

    A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one
    document. It repeats if its words also start before: in a document of a
    smaller doc_id (null is smallest; of equal doc_ids, in the order of a hash
    of the text), or earlier in the same one. Each word in a repeating window
    is removed, judged on the input. ``spans`` are the removed (start, end)
    word ranges; ``kept_text`` is null if nothing is removed and else the kept
    words joined by one space, as whose digest ``kept_sha256`` is given in
    either case. A null text has no words. Rows equal in doc_id and text are
    one document, and -2^63 stands for a null doc_id.

    Only documents that share an anchor (see :func:`anchors`) reach the index:
    a window that occurs twice has the same anchor twice.
    """
    if not ANCHOR <= window <= ANCHOR + 15:
        raise ValueError(f"a window has {ANCHOR} to {ANCHOR + 15} words, whose places four bits can tell")
    prepared = _prepared(docs, window)
    release(docs.sparkSession, wait=2)
    repeats = _repeats(prepared, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            removed, sha, texts, ranges = [], [], [], []
            for packed, digest, again in zip(*(b.column(c).to_pylist() for c in ("packed", "sha", "again")), strict=True):
                if not again:
                    removed.append(0)
                    sha.append(digest.hex())
                    texts.append(None)
                    ranges.append([])
                    continue
                found = unpack(packed).split()
                cover = np.zeros(len(found) + 1, np.int64)
                for x in again:
                    at = x["s"] + np.flatnonzero(x["before"])
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                kept = b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
                ranges.append([{"start": int(a), "end": int(e)} for a, e in edge.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("h"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string()), pa.array(ranges, kind)],
                ["d", "h", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"],
            )

    joined = prepared.select("d", "h", "n_words", "sha", "packed").join(repeats, ["d", "h"], "left")
    out = joined.mapInArrow(
        run,
        "d long, h long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start: int, end: int>>",
    )
    doc_id = F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id")
    return out.select(doc_id, F.col("h").alias("text_hash"), "n_words", "n_removed", "kept_sha256", "kept_text", "spans")


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their repeating passages removed; columns as given, ``n_chars`` of the new text.

    Texts without one stay as they are, null and empty ones too, and each
    repeated row stays a row. Other columns may have any names.
    """
    told = spans(docs, window).where("n_removed > 0").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), F.col("kept_text").alias("kept")
    ).dropDuplicates(["id", "h"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("row_hash"))
    same = F.col("row")["doc_id"].eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("h"))
    both = rows.join(told, same, "left")
    given = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    given["text"] = F.coalesce("kept", F.col("row")["text"]).alias("text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        given["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row")["n_chars"]).cast(kind).alias("n_chars")
    return both.select(*(given[c] for c in docs.columns))
