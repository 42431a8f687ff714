"""SimHash near-duplicates by anchor-point covering with a product of two Golay codes; exact shingle-set near-duplicates."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import connected_components, discard, lacking, matching, materialize, scratch

#: Length, covering radius and generator polynomial of the perfect binary Golay code.
CODE_BITS, RADIUS, GENERATOR = 23, 3, 0b101011100011
HALF = (1 << CODE_BITS) - 1
#: Shingles that are hashed and counted at a time.
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """64-bit SimHash over the word shingles of a text.

    Words are separated by ASCII white space and lower-cased in A-Z; a text of fewer words
    than ``width`` is one shingle, one without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    n, ones, digest = max(1, len(words) - width + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for s in range(0, n, SHINGLE_BLOCK):
        part = words[s : s + SHINGLE_BLOCK + width - 1]
        rows = zip(*[part[i:] for i in range(width)], strict=False) if len(words) >= width else [part]
        hashes = np.array([digest(b" ".join(r), seed) for r in rows], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial: which coset of the code each word is in."""
    out = words.astype(np.uint32)
    for bit in range(CODE_BITS - 1, 10, -1):
        out = np.where(out >> np.uint32(bit) & 1, out ^ np.uint32(GENERATOR << (bit - 11)), out)
    return out


@lru_cache(maxsize=4)
def cosets(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All error patterns of weight up to radius + threshold, ordered by coset.

    Returns (patterns, excess weight over the radius, start of each coset). Adding a pattern
    of a word's coset to the word gives a code word, that is an anchor.
    """
    patterns = np.array([0], np.uint32)
    weights = np.array([0])
    level = patterns
    for w in range(1, RADIUS + threshold + 1):
        # Extend by a bit above the highest set one, so that each pattern comes once.
        top = np.array([int(x).bit_length() for x in level])
        level = np.concatenate([level[top <= b] | np.uint32(1 << b) for b in range(CODE_BITS)])
        patterns, weights = np.concatenate([patterns, level]), np.concatenate([weights, np.full(len(level), w)])
    coset = _syndrome(patterns)
    order = np.lexsort((weights, coset))
    return patterns[order], np.maximum(weights[order] - RADIUS, 0), np.searchsorted(coset[order], np.arange(2049))


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into prints, anchor, home) for every anchor in reach of every fingerprint.

    The two 23-bit halves below bit 46 are covered by a perfect code each, so a fingerprint
    has one home anchor, within the radius in both halves; one that differs in at most
    ``threshold`` bits reaches that anchor with at most ``threshold`` excess over the radius.
    """
    patterns, excess, start = cosets(threshold)
    lo, hi = (prints & np.uint64(HALF)).astype(np.uint32), (prints >> np.uint64(CODE_BITS) & np.uint64(HALF)).astype(np.uint32)
    sl, sh = _syndrome(lo), _syndrome(hi)
    counts = (start[1:] - start[:-1]).astype(np.int64)
    nl, nh = counts[sl], counts[sh]
    total = nl * nh
    row = np.repeat(np.arange(len(prints)), total)
    k = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    i, j = start[sl][row] + k // nh[row], start[sh][row] + k % nh[row]
    over = excess[i] + excess[j]
    near = over <= threshold
    row, i, j = row[near], i[near], j[near]
    anchor = (lo[row] ^ patterns[i]).astype(np.int64) << CODE_BITS | (hi[row] ^ patterns[j]).astype(np.int64)
    return row, anchor, over[near] == 0


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most ``threshold`` bits.

    ``distinct``: long columns ``node`` and ``print``, each fingerprint once. Every
    fingerprint goes to all anchors in reach and meets there those that are at home; they are
    compared per anchor, inside the join. Both sides are dealt: Spark sizes them by the few
    bytes of the fingerprints, not by the tens of anchors that each becomes, so it would send
    them through the driver.
    """

    def run(batches):
        for batch in batches:
            nodes, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for s in range(0, len(nodes), 4096):
                row, anchor, home = anchors(prints[s : s + 4096].view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[row + s], anchor * 2 + home, prints[row + s])], names=["node", "anchor", "print"])

    spread = distinct.select("node", "print").mapInArrow(run, "node long, anchor long, print long")
    # The lowest bit of the anchor says whether it is the fingerprint's home.
    home, probe = spread.where("anchor & 1 = 1").withColumn("anchor", F.expr("anchor >> 1")), spread.withColumn("anchor", F.expr("anchor >> 1"))
    near = F.bit_count(F.expr("h.print ^ p.print")) <= threshold
    return home.alias("h").join(probe.alias("p").hint("merge"), (F.col("h.anchor") == F.col("p.anchor")) & (F.col("h.node") != F.col("p.node")) & near).select(F.col("h.node").alias("a"), F.col("p.node").alias("b"))


def print_classes(prints: DataFrame, threshold: int) -> DataFrame:
    """print, component_id of fingerprints (id, print): the smallest id that links of ``threshold`` bits reach."""
    with scratch(prints.sparkSession) as keep:
        folded = materialize(prints.groupBy("print").agg(F.min("id").cast("long").alias("node")), "simhash-nodes")
        found = connected_components(links(folded.where("node is not null"), threshold))
        classes = folded.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
        return keep(materialize(classes, "simhash-classes"))


def simhash_groups(docs: DataFrame, *, width: int = 3, threshold: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``print`` (signed long) and ``component_id`` for every row of ``docs``.

    Equal fingerprints are folded into one node (its smallest id) before anything is
    compared; nodes link as in :func:`links`; a component's id is the smallest id that can be
    reached. Null texts count as empty, and texts without words share fingerprint zero; texts
    of any length are read whole. Null ids keep their row, with a null component if no id
    shares the fingerprint; repeated rows all come back; an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint((t.as_py() or "").encode(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])

    kind = rows.schema[0].dataType.simpleString()
    prints = materialize(rows.mapInArrow(run, f"id {kind}, print long"), "simhash")
    return prints.join(print_classes(prints, threshold), "print", "left").select(F.col("id").alias(id_col), "print", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """3-word SimHash classes of all documents at two differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


#: Odd multipliers of the mixing steps.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Counters of the sketch that orders shingles by how common they are.
SKETCH = 1 << 20
#: Parts of the shingles that are dealt one after the other, so that no more lies on disk at once.
PARTS = 4


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, words as in :func:`fingerprint`."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * M2 + each[i : i + n]
        out = (out ^ (out >> np.uint64(31))) * M1
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _sketch_rows(width: int):
    """Arrow function (text) -> (slot, n): how many shingles each counter of the sketch has seen."""

    def run(batches):
        seen = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for value in batch.column(0):
                np.add.at(seen, (shingle_set(value.as_py() or "", width) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        slot = np.flatnonzero(seen)
        for s in range(0, len(slot), 1 << 16):
            part = slot[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], names=["slot", "n"])

    return run


def _prefix_rows(width: int, similarity: float, common):
    """Arrow function (id, text) -> id, 128-bit hash of the shingle set, its size, its rarest shingles in order, and the SimHash.

    A set of n shares at least similarity * n shingles with any set as similar, so the first
    shingle that both have, in one order for all sets, is among the n - ceil(similarity * n) + 1
    that come first.
    """

    def run(batches):
        counts = common.value
        for batch in batches:
            first, second, sizes, prefixes, prints = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                hashes = shingle_set(text, width)
                prints.append(fingerprint(text.encode(), width))
                n, whole = len(hashes), xxhash.xxh3_128_intdigest(hashes.tobytes())
                order = np.lexsort((hashes, counts[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]))
                first.append(whole >> 64)
                second.append(whole & (1 << 64) - 1)
                sizes.append(n)
                prefixes.append(hashes[order[: n - int(np.ceil(similarity * n - 1e-9)) + 1]].view(np.int64))
            cols = [batch.column(0), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (first, second)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "k1", "k2", "n", "prefix", "print"])

    return run


def _meet(x: DataFrame, y: DataFrame, similarity: float, also=None) -> DataFrame:
    """Pairs (a, b) of nodes of two tables of prefix rows that share a shingle and may be similar.

    Behind the first shingle that two sets share there must be enough left of both.
    """
    need = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") != F.col("y.node"))
    met &= F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need
    return x.alias("x").join(y.alias("y"), met if also is None else met & also).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))


def _leader_pairs(alive: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of every node and the leaders (lo, hi, mid) of its shingles that may be similar.

    Leaders come with each row, so that nothing is joined; a node names a leader once, however
    many shingles they share.
    """

    def may(x):
        left = F.least(F.col("n") - F.col("pos"), x["n"] - x["pos"])
        return (x["node"] != F.col("node")) & (left >= (F.col("n") + x["n"]) * (similarity / (1 + similarity)) - 1e-6)

    named = F.transform(F.filter(F.array("lo", "hi", "mid"), may), lambda x: x["node"])
    mine = alive.select("node", F.array_distinct(named).alias("leaders")).where(F.size("leaders") > 0)
    mine = mine.groupBy("node").agg(F.collect_set("leaders").alias("leaders"))
    each = mine.select("node", F.explode(F.array_distinct(F.flatten("leaders"))).alias("other"))
    return each.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))


def _similar_pairs(pairs: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts have an exact shingle Jaccard of ``similarity`` or more."""

    def run(batches):
        for batch in batches:
            last, other, kept = None, None, []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if (right := y.as_py()) != last:
                    last, other = right, shingle_set(right, width)
                own = shingle_set(x.as_py(), width)
                if similarity * max(len(own), len(other)) - 1e-9 > min(len(own), len(other)):
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], names=["a", "b"])

    pairs = materialize(pairs.distinct(), "pairs")
    involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    texts = materialize(matching(rows, involved, "id").select("id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "pair-texts")
    x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb")
    # Dealt anew by pair, with a fixed number of tasks: a node of many pairs is no task of its own.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(met.repartition(tasks, "a", "b").mapInArrow(run, "a long, b long"), "similar")


def similar_groups(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``component_id`` of every row: classes of shingle Jaccard ``similarity`` or more.

    Exact: texts of equal shingle sets are one node, and nodes link if the sets of their
    ``width``-word shingles have that Jaccard similarity. SimHash classes of the same shingles
    (:func:`print_classes`) come first: each member is compared with its class's smallest
    id. As fingerprints of 64 bits can't tell 0.8 from less, a second pass finds all other
    links: shingles are ordered from rare to common by a sketch of fixed size (any order is
    right, this one is fast), and every node goes to the first of its shingles, one of which
    any two similar nodes share. There nodes meet three leaders first; then all others that
    meet and are not yet in one class are compared, so that large groups of copies do not all
    meet each other. Pairs are screened in the join by size and place and confirmed on their
    texts. Null texts count as empty, and texts without words are one class; texts of any
    length are read whole; rows without id are left out; rows that repeat an id share a class
    if their texts do; an empty table gives no rows; other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(materialize(_similar_groups(docs, width, similarity, id_col, text_col), "similar-groups"))


def _similar_groups(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    spark = docs.sparkSession
    seen = rows.select("text").mapInArrow(_sketch_rows(width), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    common = spark.sparkContext.broadcast(counts)
    prints = materialize(rows.mapInArrow(_prefix_rows(width, similarity, common), "id long, k1 long, k2 long, n int, prefix array<long>, print long"), "prefixes")
    nodes = prints.groupBy("k1", "k2").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "prefix", "print")])
    nodes = materialize(nodes, "prefix-nodes")
    # Prefixes are by far the most of both tables, and are given up as soon as they are read.
    ids = materialize(prints.select("id", "k1", "k2"), "prefix-ids")
    discard(prints)
    spread = nodes.where("n > 0").select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    # A shared shingle counts if it is early enough in the smaller set of some pair.
    early = F.col("n") - F.col("pos") >= F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6
    one = F.struct("node", "n", "pos")
    # A window deals the shingles once, where a group and a join would deal them twice, leaders and all.
    w = Window.partitionBy("shingle")
    lead = {"lo": F.min(one).over(w), "hi": F.max(one).over(w), "mid": F.min_by(one, F.xxhash64("node")).over(w), "any": F.max(early).over(w)}
    parts = [spread.where(F.pmod("shingle", F.lit(PARTS)) == k).withColumns(lead).where("lo.node < hi.node and any").drop("any") for k in range(PARTS)]
    alive = reduce(DataFrame.unionByName, [materialize(part, "meetings") for part in parts])
    kept = materialize(nodes.select("k1", "k2", "node", "print"), "node-ids")
    discard(nodes)
    nodes = kept
    hashed = nodes.join(print_classes(nodes.select(F.col("node").alias("id"), "print"), 2), "print")
    hashed = hashed.where("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    near = _similar_pairs(hashed.unionByName(_leader_pairs(alive, similarity)), rows, width, similarity)
    placed = alive.drop("lo", "hi", "mid").join(connected_components(near), "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    placed = materialize(placed, "meeting-classes")
    # Pairs of different classes have one outside the largest class that meets at the shingle.
    main = placed.groupBy("shingle", "class").count().groupBy("shingle").agg(F.max_by("class", "count").alias("main"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    open_ = materialize(placed.join(main.where("lo < hi").select("shingle", "main"), "shingle"), "open-meetings")
    own, minor = open_.where(early), open_.where("class <> main")
    apart = (F.col("x.class") != F.col("y.class")) & (F.col("x.n") <= F.col("y.n"))
    rest = _meet(own.where("class <> main"), open_, similarity, apart).unionByName(_meet(own.where("class = main"), minor, similarity, apart))
    found = near.unionByName(_similar_pairs(rest, rows, width, similarity))
    classes = nodes.join(connected_components(found), "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    return ids.join(classes, ["k1", "k2"]).select(F.col("id").alias(id_col), "component_id")


def near_duplicates_removed(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the rows of smallest id of every class of :func:`similar_groups`, with all their columns.

    Rows that repeat an id stand or fall together; rows without id are kept.
    """
    groups = similar_groups(docs, width=width, similarity=similarity, id_col=id_col, text_col=text_col)
    # Written, so that its size is known when the join is planned.
    gone = materialize(groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "near-duplicates")
    return lacking(docs, gone, id_col).select(docs.columns)
