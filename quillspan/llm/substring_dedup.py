"""Exact repeated substrings: content-cut blocks, two-stage suffix sorting, common prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialize, row_key, scratch

#: Bytes of the grams whose smallest hash anchors a window.
GRAM = 32
#: Window starts of one text, and bytes of many texts, that are hashed as one array.
PIECE, BLOCK = 1 << 20, 1 << 21
POSITION = np.uint64((1 << 24) - 1)
#: Odd multipliers of the mixing steps.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return (x ^ (x >> np.uint64(29))) * M2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from every place, by doubling; shorter at the end."""
    h = _mix(data.astype(np.uint64) + np.uint64(1))
    n = 1
    while n < GRAM:
        # Order matters: the left half is multiplied before the right half is added.
        h = _mix(h[:-n] * M2 + h[n:])
        n *= 2
    return h


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


def segments(pieces: list[np.ndarray], size: int):
    """Runs of windows with a common anchor in every piece.

    Each window of ``size`` bytes is anchored at the smallest gram hash within it (the last,
    if several), which depends on its bytes alone; neighbouring windows with the same anchor
    form a segment. Returns arrays: piece, first window, windows, anchor's offset from the
    first window, anchor hash h, and hash s of all bytes the segment's windows cover. Equal
    windows have equal h; equal segments have equal (h, s).
    """
    lengths = np.array([len(p) for p in pieces])
    starts = np.cumsum(lengths) - lengths
    data = np.concatenate(pieces)
    grams = gram_hashes(data)
    v = (grams & ~POSITION) | (POSITION - np.arange(len(grams), dtype=np.uint64))
    low = _sliding_min(v, size - GRAM + 1)
    anchor = (POSITION - (low & POSITION)).astype(np.int64)
    windows = np.maximum(lengths - size + 1, 0)
    total = int(windows.sum())
    piece_of = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + starts[piece_of]
    a = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (piece_of[1:] != piece_of[:-1])]))
    n = np.diff(np.append(new, total))
    first, a, piece = at[new], a[new], piece_of[new]
    last = first + n - 1 + size - GRAM  # place of the last gram that the segment covers
    s = n.astype(np.uint64)
    for k in range(0, int((last - first).max(initial=0)) + GRAM, GRAM):
        s = _mix(s * M2 + grams[np.minimum(first + k, last)])
    return piece, first - starts[piece], n, a - first, grams[a], s


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text``, right to ``depth`` bytes, by two-stage sorting.

    Only suffixes smaller than their successor are sorted directly. The others follow from
    one scan of the first-byte buckets in ascending order: such a suffix of bucket c ranks by
    its successor, which lies in a smaller bucket or, in a run of c, was placed just before.
    """
    n = len(text)
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    decided = np.ones(n, bool)
    decided[:-1] = text[:-1] != text[1:]
    # A run of equal bytes is of the kind of its last place.
    nearest = np.minimum.accumulate(np.where(decided, np.arange(n), n)[::-1])[::-1]
    small = rises[nearest]
    direct = np.flatnonzero(small)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    if len(direct):
        rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
        direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")]
    by_byte = np.argsort(text, kind="stable")
    bounds = np.searchsorted(text[by_byte], np.arange(257))
    direct_bounds = np.searchsorted(text[direct], np.arange(257))
    rank = np.full(n + 1, -1, np.int64)  # rank[n]: the empty suffix, before all others
    order = np.empty(n, np.int64)
    filled = 0
    for c in np.flatnonzero(np.diff(bounds)):
        members = by_byte[bounds[c] : bounds[c + 1]]
        induced = members[~small[members]]
        after = induced + 1
        wave = induced[(after == n) | (text[np.minimum(after, n - 1)] != c)]
        wave = wave[np.argsort(rank[wave + 1], kind="stable")]
        while len(wave):
            order[filled : filled + len(wave)] = wave
            rank[wave] = np.arange(filled, filled + len(wave))
            filled += len(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & ~small[wave]]
        own = direct[direct_bounds[c] : direct_bounds[c + 1]]
        order[filled : filled + len(own)] = own
        rank[own] = np.arange(filled, filled + len(own))
        filled += len(own)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``depth``."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 15):
        part = slice(i, min(len(order), i + (1 << 15)))
        same = rows[order[part]] == rows[order[part.start - 1 : part.stop - 1]]
        out[part] = np.where(same.all(1), depth, same.argmin(1))
    return out


def repeated_windows(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For every text, which of its windows of ``size`` bytes starts elsewhere, too."""
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    valid = np.zeros(len(data), bool)
    for s, n in zip(starts, lengths, strict=True):
        valid[s : s + max(0, n - size + 1)] = True
    order = suffix_order(data, size)
    order = order[valid[order]]
    equal = common_prefixes(data, order, size) >= size
    hit = np.zeros(len(data), bool)
    hit[order[1:][equal[1:]]] = True
    hit[order[:-1][equal[1:]]] = True
    return [hit[s : s + max(0, n - size + 1)] for s, n in zip(starts, lengths, strict=True)]


#: Offsets that a piece's windows span, bytes sorted at once, and bytes of a group beyond which its windows are counted instead.
SPAN, SORT_BYTES, GROUP_BYTES = 64, 1 << 18, 1 << 23
#: Bytes that a held piece takes beside its text.
PIECE_OVERHEAD = 256


def _core_key(h: int, offset: int, core: bytes) -> int:
    """Group of windows: those that can be equal share anchor, offset bucket and core bytes."""
    digest = hashlib.blake2b(core, digest_size=8, key=h.to_bytes(8, "little", signed=True) + offset.to_bytes(4, "little", signed=True)).digest()
    return int.from_bytes(digest, "little", signed=True)


def cut_pieces(text: bytes, j0: int, n: int, d: int, h: int, size: int, span: int):
    """(group, first window, offset of its anchor, bytes) of a segment's pieces.

    Windows are split by the anchor's offset into buckets of ``span``; all windows of a bucket
    contain the same core of size - span + 1 bytes around the anchor.
    """
    done = 0
    while done < n:
        offset = d - done
        bucket = offset // span
        count = min(n - done, offset - bucket * span + 1)
        anchor = j0 + d
        core = text[anchor - bucket * span : anchor - bucket * span + size - span + 1]
        begin = j0 + done
        yield _core_key(h, bucket, core), begin, offset, text[begin : begin + count - 1 + size]
        done += count


def _sorted_hits(pieces: list[tuple], size: int):
    if len({p[5] for p in pieces}) == 1 and len(pieces) > 1:  # one text many times over
        hits = [np.ones(len(p[5]) - size + 1, bool) for p in pieces]
    else:
        hits = repeated_windows([p[5] for p in pieces], size)
    for (key, begin, _, _, single, _), hit in zip(pieces, hits, strict=True):
        if single and hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                yield key, begin + int(a), begin + int(b) - 1 + size


def _segment_rows(size: int):
    """Arrow function (key, text) -> one row per segment."""

    def run(batches):
        keys: list[bytes] = []
        offsets: list[int] = []
        pieces: list[np.ndarray] = []
        held = 0

        def flush():
            piece, first, n, d, h, s = segments(pieces, size)
            j0 = first + np.array(offsets)[piece]
            cols = [pa.array(keys, pa.binary()).take(pa.array(piece)), j0.astype(np.int32), n.astype(np.int32), d.astype(np.int32), h.view(np.int64), s.view(np.int64)]
            return pa.RecordBatch.from_arrays([cols[0], *map(pa.array, cols[1:])], names=["key", "j0", "n", "d", "h", "s"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                for at in range(0, max(0, len(data) - size + 1), PIECE):
                    pieces.append(data[at : at + PIECE + size - 1])
                    keys.append(key)
                    offsets.append(at)
                    held += len(pieces[-1])
                    if held >= BLOCK:
                        yield flush()
                        keys, offsets, pieces, held = [], [], [], 0
        if pieces:
            yield flush()

    return run


def _cut_rows(size: int):
    """Arrow function (key, text, reps) -> pieces of the representatives."""

    def run(batches):
        names = ["group", "key", "begin", "offset", "h", "single", "bytes"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for key, text, reps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                for r in reps.as_py():
                    for g, begin, offset, part in cut_pieces(data, r["j0"], r["n"], r["d"], r["h"], size, SPAN):
                        out.append((g, key, begin, offset, r["h"], r["c"] == 1, part))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _sort_rows(size: int):
    """Arrow function over pieces sorted by group -> (key, begin, end) of repeated bytes."""

    def run(batches):
        held: list[tuple] = []
        held_bytes = 0
        group: list[tuple] = []
        current = None

        def pack(rows):
            rows = list(rows)
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["key", "begin", "end"])

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield (None,) * 7

        started = False
        for g, *piece in rows():
            if started and g == current and piece[0] is not None:
                group.append(tuple(piece))
                continue
            if len(group) > 1:  # a piece alone in its group has no equal
                held += group
                held_bytes += sum(len(p[5]) for p in group)
                if held_bytes >= SORT_BYTES:
                    yield pack(_sorted_hits(held, size))
                    held, held_bytes = [], 0
            group, current, started = [tuple(piece)], g, True
        if held:
            yield pack(_sorted_hits(held, size))

    return run


def _window_rows(size: int):
    """Arrow function (key, begin, single, bytes) -> (w1, w2, key, begin, single) for every window of the pieces.

    (w1, w2) is the 128-bit hash of the window's bytes.
    """

    def run(batches):
        names = ["w1", "w2", "key", "begin", "single"]
        for batch in batches:
            for key, begin, single, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(value) - size + 1
                digests = b"".join(hashlib.blake2b(value[i : i + size], digest_size=16).digest() for i in range(n))
                w = np.frombuffer(digests, "<i8").reshape(n, 2)
                cols = [w[:, 0].copy(), w[:, 1].copy(), pa.repeat(pa.scalar(key, pa.binary()), n), np.arange(begin, begin + n, dtype=np.int32), np.full(n, single)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return run


def _counted_hits(pieces: DataFrame, size: int) -> DataFrame:
    """(key, begin, end) of repeated windows of pieces whose groups are too large for one task.

    Every window is dealt by its own hash; equal ones are counted, never gathered.
    """
    windows = pieces.select("key", "begin", "single", "bytes").mapInArrow(_window_rows(size), "w1 long, w2 long, key binary, begin int, single boolean")
    windows = materialize(windows, "windows")
    several = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    hits = windows.where("single").join(several, ["w1", "w2"], "left_semi")
    return hits.select("key", "begin", (F.col("begin") + size).alias("end"))


def _kept_rows(size: int):
    """Arrow function (row, text, runs) -> counts, spans and what stays."""

    def run(batches):
        for batch in batches:
            k = batch.num_columns
            sizes, removed, spans, kept = [], [], [], []
            for value, runs in zip(batch.column(k - 2), batch.column(k - 1), strict=True):
                data = (value.as_py() or "").encode()
                merged: list[list[int]] = []
                for r in sorted((r["begin"], r["end"]) for r in runs.as_py() or []):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                spans.append([{"begin": a, "end": b} for a, b in merged])
                ends = [0, *(b for _, b in merged)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(data)], strict=True)))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            cols = [*batch.columns[: k - 2], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[: k - 2], "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, spans and kept (binary) for every row.

    Every byte that a string of ``min_bytes`` bytes covers which also starts elsewhere, in
    another row or the same, is removed; strings are judged on the input. The text of each
    row is cut into segments of windows with a common content-chosen anchor. Anchors that
    occur once, and segments that are equal throughout, are settled by their hashes alone;
    one representative of every other segment is cut into pieces, which meet those that share
    their core bytes, and there the pieces' suffixes are sorted in two stages and windows
    whose neighbours share ``min_bytes`` are marked. Groups of more than GROUP_BYTES are never
    gathered: their windows are dealt and counted by 128-bit hash. Null texts count as empty,
    null ids come back null; rows that repeat id and text are copies of each other; texts
    under ``min_bytes`` lose nothing, texts of any length are read whole; an empty table gives
    no rows; other columns are not read. What hashes settle, rows' names too, is settled by 128
    bits of them.
    """
    size = min_bytes
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_key"))
    texts = base.where(F.octet_length("_text") >= size).select(F.col("_key").alias("key"), F.col("_text").alias("text"))
    with scratch(docs.sparkSession) as keep:
        by_row = keep(materialize(_repeated_runs(texts, size), "runs"))
    out = base.join(by_row, "_key", "left").select("_id", "_text", "runs")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = out.mapInArrow(_kept_rows(size), f"_id {kind}, n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def _repeated_runs(texts: DataFrame, size: int) -> DataFrame:
    """_key and the runs (begin, end) of its text's bytes that windows of ``size`` repeat, not yet merged."""
    segs = texts.mapInArrow(_segment_rows(size), "key binary, j0 int, n int, d int, h long, s long")
    anchors = segs.groupBy("h").agg(F.count("*").alias("m"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("m > 1")
    anchors = materialize(anchors.select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    shared = materialize(segs.join(anchors, "h"), "segments")
    reps = shared.where("mixed").groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("key", "j0", "n", "d")).alias("r"))
    reps = materialize(reps.select("h", "s", "c", "r.*"), "representatives")
    by_doc = reps.groupBy("key").agg(F.collect_list(F.struct("j0", "n", "d", "h", "c")).alias("reps"))
    pieces = texts.join(by_doc, "key").select("key", "text", "reps").mapInArrow(_cut_rows(size), "group long, key binary, begin int, offset int, h long, single boolean, bytes binary")
    pieces = materialize(pieces, "pieces")
    weight = F.sum(F.length("bytes") + PIECE_OVERHEAD)
    heavy = materialize(pieces.groupBy("group").agg(weight.alias("weight")).where(F.col("weight") > GROUP_BYTES).select("group"), "heavy")
    counted = None
    if not heavy.isEmpty():
        # There is at most one heavy group to GROUP_BYTES of pieces; the table's size picks the join.
        counted = _counted_hits(pieces.join(heavy, "group", "left_semi"), size)
        pieces = pieces.join(heavy, "group", "left_anti").select(pieces.columns)
    partial = pieces.repartition("group").sortWithinPartitions("group").mapInArrow(_sort_rows(size), "key binary, begin int, end int")
    partial = materialize(partial if counted is None else partial.unionByName(counted), "partial")
    run = lambda df: df.select("key", F.col("j0").alias("begin"), (F.col("j0") + F.col("n") + (size - 1)).alias("end"))
    copies = shared.where("mixed").join(reps.where("c > 1").select("h", "s"), ["h", "s"])
    runs = run(shared.where("not mixed")).unionByName(run(copies)).unionByName(partial)
    # Rows that repeat id and text have one key and the same runs; a set of them is no longer than the text.
    return runs.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("runs")).withColumnRenamed("key", "_key")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what stays, for every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
