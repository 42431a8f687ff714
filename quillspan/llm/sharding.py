"""Balanced shards by sampled splitters over a content-ordered key."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import discard, materialize

#: Hexadecimal digits of the key that equal texts share.
GROUP_DIGITS = 24
#: Splitter samples drawn for each range.
SAMPLES_PER_RANGE = 12


def ordering_key(text: Column, doc_id: Column) -> Column:
    """Fixed-width key: checksum and hash of the text, then the id, so that copies adjoin."""
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    sign = F.lit(-(2**63)).cast("bigint")  # flips the sign bit, so that ids sort as numbers
    return F.concat(hexed(F.crc32(text), 8), hexed(F.xxhash64(text), 16), F.coalesce(hexed(doc_id.cast("bigint").bitwiseXOR(sign), 16), F.lit("")))


def _strings(values: list[str]) -> Column:
    """One folded array literal, however many values; they hold no comma."""
    return F.split(F.lit(",".join(values)), ",")


def locate(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below the key, by a two-level search of sorted literals."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    table = F.transform(F.split(F.lit(";".join(",".join(b) for b in blocks)), ";"), lambda b: F.split(b, ","))
    at = F.size(F.filter(_strings([b[0] for b in blocks]), lambda s: s <= key))
    inner = F.size(F.filter(F.get(table, at - 1), lambda s: s <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + inner)


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Keys that cut a weighted sample into equal parts."""
    sample = sorted(sample)
    total, acc, cuts = sum(w for _, w in sample), [], []
    run = 0.0
    for _, w in sample:
        acc.append(run := run + w)
    for p in range(1, parts):
        cuts.append(sample[min(len(sample) - 1, bisect_left(acc, total * p / parts))][0])
    return cuts


def _draw(rows: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[str, float]]:
    """About ``wanted`` keys, drawn with probability by size; the weight makes up for large rows."""
    p = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(1, total)))
    u = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return [tuple(r) for r in rows.where(u < p).select("key", F.col("size") / p).collect()]


def _place_heavy(heavy: dict[str, tuple[int, int]], total: int, shards: int) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """(group, piece, rows, shard) of the heavy groups' pieces, and the load of each shard.

    Largest first, each to the shard with the least so far; only a group larger than a
    shard's share of ``total`` is in more than one piece, which are equal but for a row.
    """
    loads, out = [0] * shards, []
    for g, (n, size) in sorted(heavy.items(), key=lambda kv: (-kv[1][1], kv[0])):
        k = min(n, max(1, -(-size * shards // total)))
        for piece in range(k):
            rows = (piece + 1) * n // k - piece * n // k
            to = loads.index(min(loads))
            loads[to] += size // n * rows  # equal texts have equal sizes
            out.append((g, piece, rows, to))
    return out, loads


def _fill(loads: list[int], rest: int) -> list[int]:
    """How much of ``rest`` each load takes so that all end up as level as can be."""
    level, low = 0.0, sorted(loads)
    for i in range(1, len(low) + 1):
        level = (rest + sum(low[:i])) / i
        if i == len(low) or level <= low[i]:
            break
    return [max(0, round(level - x)) for x in loads]


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, rows_per_range: int = 500_000, ranges_per_shard: int = 32, heavy_share: float = 0.01) -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard and group_cut for every row.

    Law ``bytes``. Equal texts form a group, and a group is never divided unless it is larger
    than a shard's share of all bytes (``group_cut`` says so). Groups of more than
    ``heavy_share`` of a share in bytes or rows, of which there can be few, are placed first,
    the largest first. All other rows are ordered by :func:`ordering_key` and fill the shards
    up evenly at group borders. Splitters are quantiles of a size-weighted key sample;
    ranges that turn out overfull are divided again. Exact counts of the ranges then place
    every range, and rows are sorted only within their range. ``slot`` numbers the rows of a
    shard from 0. Null texts have no bytes and group with empty ones; null ids are allowed;
    repeated rows get slots of their own; texts of any length stay one row; an empty table
    gives none. The number of ranges grows with the rows; the driver holds a few numbers for
    each.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), ordering_key(F.coalesce(text, F.lit("")), F.col(id_col)).alias("key"),
        ).withColumn("group", F.substring("key", 1, GROUP_DIGITS)), "shard-rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    counted = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    # At most 2 * shards / heavy_share groups can pass either test.
    big = counted.where((F.col("b") > heavy_share * total / shards) | (F.col("n") > heavy_share * n / shards)).where("n > 1")
    heavy = {r["group"]: (r["n"], r["b"]) for r in big.collect()}
    light = ~F.col("group").isin(list(heavy)) if heavy else F.lit(True)
    parts = max(shards * ranges_per_shard, -(-n // rows_per_range))
    sample = _draw(rows, total, parts * SAMPLES_PER_RANGE, 1)
    # Only a heavy group may be cut by a splitter; all other splitters are group borders.
    border = lambda c: c if c[:GROUP_DIGITS] in heavy else c[:GROUP_DIGITS]
    cuts = sorted({border(c) for c in _quantiles(sample, parts)}) if sample else []
    seed = 1
    while True:
        ranged = rows.withColumn("range", locate(F.col("key"), cuts)).withColumn("light", light)
        sums = [F.count("*").alias("n"), F.sum("size").alias("b"), F.count_if("light").alias("nl"), F.coalesce(F.sum(F.when(F.col("light"), F.col("size"))), F.lit(0)).alias("bl")]
        sizes = {r["range"]: r for r in ranged.groupBy("range").agg(*sums).collect()}
        full = {k: max(r["b"] * parts / max(1, total), r["n"] * parts / max(1, n)) for k, r in sizes.items()}
        over = {k: x for k, x in full.items() if x > 4 and sizes[k]["n"] > 8}
        if not over:
            break
        seed += 1
        drawn = _draw(ranged.where(F.col("range").isin(list(over))), sum(sizes[k]["b"] for k in over), int(sum(over.values()) * SAMPLES_PER_RANGE) + 1, seed)
        by_range: dict[int, list] = {}
        for k, w in drawn:
            by_range.setdefault(bisect_right(cuts, k), []).append((k, w))
        more = {border(c) for at, s in by_range.items() for c in _quantiles(s, max(2, int(full.get(at, 2))))}
        if more <= set(cuts):
            break
        cuts = sorted(set(cuts) | more)
    order = range(len(cuts) + 1)
    before = {f: list(accumulate((sizes[r][f] if r in sizes else 0 for r in order), initial=0)) for f in ("n", "nl", "bl")}
    pick = lambda f: F.get(_strings([str(x) for x in before[f]]).cast("array<bigint>"), F.col("range"))
    by_key = Window.partitionBy("range").orderBy("key")
    up_to = by_key.rowsBetween(Window.unboundedPreceding, 0)
    mine = lambda c: F.sum(F.when(F.col("light"), c).otherwise(0)).over(up_to) - F.when(F.col("light"), c).otherwise(0)
    pieces, loads = _place_heavy(heavy, total, shards)
    ends = list(accumulate(_fill(loads, before["bl"][-1])))[:-1]
    spread = materialize(
        ranged.withColumn("rn", pick("n") + F.row_number().over(by_key) - 1)
        .withColumn("light_rn", pick("nl") + mine(F.lit(1))).withColumn("start", pick("bl") + mine(F.col("size")))
        .withColumn("fresh", ~F.col("group").eqNullSafe(F.lag("group").over(by_key)))
        .withColumn("from", F.last(F.when(F.col("fresh"), F.col("start")), ignorenulls=True).over(up_to))
        .withColumn("to", F.when(F.col("light"), F.size(F.filter(_strings([str(x) for x in ends]).cast("array<bigint>"), lambda e: e <= F.col("from")))) if ends else F.lit(0))
        .select("id", "size", "text_crc32", "group", "light", "rn", "light_rn", "to"), "shard-places",
    )
    discard(rows)
    sums = spread.where("light").groupBy("to").agg(F.min("light_rn").alias("first"), F.count("*").alias("n")).collect()
    first, held = {r["to"]: r["first"] for r in sums}, [0] * shards
    for r in sums:
        held[r["to"]] = r["n"]
    begin = {r["group"]: r["rn"] for r in spread.where("not light").groupBy("group").agg(F.min("rn").alias("rn")).collect()}
    table, at = [], dict(begin)
    for g, _, count, to in pieces:
        # (rows of the piece before it in the order, slot of its first row)
        table.append((g, at[g], at[g] + count, to, held[to], count < heavy[g][0]))
        at[g] += count
        held[to] += count
    spark = docs.sparkSession
    # One row for each piece of a heavy group: 2 * shards / heavy_share groups and ``shards`` cuts at most.
    place = F.broadcast(spark.createDataFrame(table, "group string, lo long, hi long, heavy_to int, base long, cut boolean"))
    joined = spread.join(place, (spread["group"] == place["group"]) & (F.col("rn") >= F.col("lo")) & (F.col("rn") < F.col("hi")), "left")
    starts = _strings([str(first.get(s, 0)) for s in range(shards)]).cast("array<bigint>")
    where = F.when(F.col("light"), F.col("to")).otherwise(F.col("heavy_to")).cast("int")
    slot = F.when(F.col("light"), F.col("light_rn") - F.get(starts, F.col("to"))).otherwise(F.col("rn") - F.col("lo") + F.col("base"))
    return joined.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), where.alias("shard"), slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.coalesce("cut", F.lit(False)).alias("group_cut"),
    )


def op4_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
