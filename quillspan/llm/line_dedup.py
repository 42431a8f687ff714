"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import connected_components, marked, matching, materialize, scratch

NEWLINE = "\n"


def exploded_lines(docs: DataFrame, text_col: str = "text", key: str = "row_key") -> DataFrame:
    """key, pos, line and the line's 128-bit hash as (h, h2), for every line that is not blank."""
    lines = docs.select(key, F.posexplode(F.split(text_col, NEWLINE)).alias("pos", "line")).where(F.btrim("line", F.lit(" \t\r\f\v")) != "")
    return lines.select(key, "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def allowed_edits(length: Column, max_edits: int, chars_per_edit: int) -> Column:
    """Edits within which a line of ``length`` characters and one no shorter count as alike."""
    return F.least(F.lit(max_edits), F.floor(length / chars_per_edit).cast("int"))


def segment_keys(lines: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """h, key, own, length of lines (h, line, n): their segments, and probes for shorter lines.

    A line of n characters that may differ by t edits is cut into t + 1 even segments. A line
    of n + d characters within t edits of it contains one of them unchanged, shifted by no
    more than both the edits to its left and those to its right allow; only those substrings
    are probed. Places are told first, as numbers, so that each key is one small expression.
    """
    probes = [
        F.struct(*[F.lit(v).alias(c) for c, v in (("t", t), ("d", d), ("i", i), ("shift", shift))])
        for t in range(1, max_edits + 1) for d in range(t + 1) for i in range(1, t + 2)
        for shift in range(max(-(i - 1), d - (t + 1 - i)), min(i - 1, d + (t + 1 - i)) + 1)
    ]
    each = lines.where(F.col("n") >= chars_per_edit).select("h", "line", "n", F.explode(F.array(*probes)).alias("k"))
    each = each.select("h", "line", "n", "k.*", (F.col("n") - F.col("k.d")).alias("length"))
    each = each.where(allowed_edits(F.col("length"), max_edits, chars_per_edit) == F.col("t")).withColumn("base", F.expr("length div (t + 1)").cast("int"))
    # So many first segments have the base size, and the others one character more.
    each = each.withColumn("short", F.expr("(base + 1) * (t + 1) - length"))
    at, size = F.expr("1 + (i - 1) * base + greatest(0, i - 1 - short) + shift"), F.expr("base + if(i > short, 1, 0)")
    placed = each.select("h", "line", "n", "i", "length", F.expr("d = 0 and shift = 0").alias("own"), at.alias("at"), size.alias("size"))
    placed = placed.where("at >= 1 and at + size - 1 <= n")
    return placed.select("h", F.xxhash64("i", "length", F.substring("line", F.col("at"), F.col("size"))).alias("key"), "own", "length")


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once for use in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """Edit distance of two arrays of characters, right where it is at most ``max_edits``.

    Bit-parallel over a band of 2 * max_edits + 1 cells that moves down with each character
    of ``b``; ``a`` must not be the shorter one. The score is followed along the diagonal
    that ends in the last cell.
    """
    t, width = max_edits, 2 * max_edits + 1
    mask = F.lit((1 << width) - 1).cast("bigint")
    d = F.size(a) - F.size(b)
    bits = lambda v: F.lit(v).cast("bigint")

    def equal(j: Column) -> Column:
        ch = F.get(b, j - 1)
        out = bits(0)
        for k in range(width):
            row = j - t + k
            same = (row >= 1) & F.coalesce(F.get(a, F.greatest(row - 1, F.lit(0))) == ch, F.lit(False))
            out = out + F.when(same, bits(1 << k)).otherwise(bits(0))
        return out

    def step(acc: Column, j: Column) -> Column:
        vp, vn, s = acc["vp"], acc["vn"], acc["s"]

        def with_x(x: Column) -> Column:
            d0 = ((((x.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(mask)
            return _bind(d0, lambda d0: _bind(
                F.struct(d0.alias("d0"), vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask).alias("hp"), d0.bitwiseAND(vp).alias("hn")),
                lambda h: F.struct(
                    h["hn"].bitwiseOR(F.bitwise_not(F.shiftright(h["d0"], 1).bitwiseOR(h["hp"])).bitwiseAND(mask)).alias("vp"),
                    F.shiftright(h["d0"], 1).bitwiseAND(h["hp"]).alias("vn"),
                    (s + 1 - F.call_function("shiftright", h["d0"], (d + t).cast("int")).bitwiseAND(bits(1)).cast("int")).alias("s"),
                ),
            ))

        return _bind(equal(j), with_x)

    # Deltas of column 0 in the frame of column 1: rows from 1 on rise by one.
    vp0 = bits(sum(1 << k for k in range(width) if 1 - t + k >= 1))
    start = F.struct(vp0.alias("vp"), bits(0).alias("vn"), d.cast("int").alias("s"))
    run = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda acc: acc["s"])
    return F.when(d > t, F.lit(t + 1)).when(F.size(b) == 0, d).otherwise(run)


def common_ends(a: Column, b: Column) -> Column:
    """(p, q): how many characters at the front of two strings are equal, and at the back of what is left of ``b``.

    ``a`` must not be the shorter one. Found by halving: each step compares one run of characters.
    """
    size = F.char_length(b)
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def longest(equal, most: Column) -> Column:
        fits = F.filter(steps, lambda k: k <= most)
        return F.aggregate(fits, F.lit(0), lambda n, k: F.when(n + k > most, n).when(equal(n, k), n + k).otherwise(n))

    front = longest(lambda n, k: F.substring(a, n + 1, k) == F.substring(b, n + 1, k), size)
    back = lambda p: longest(lambda n, k: F.substring(a, -(n + k), k) == F.substring(b, -(n + k), k), size - p)
    return _bind(front, lambda p: F.struct(p.alias("p"), back(p).alias("q")))


def edit_distance(left: Column, right: Column, max_edits: int) -> Column:
    """Edit distance of two strings, right where it is at most ``max_edits``, else one more.

    Decided on what lies between common ends, whose first characters differ, and whose last
    ones do: so one edit leaves at most one character on either side, and of two edits one
    stands at each end; :func:`banded_distance` counts more than two.
    """
    swap = F.char_length(left) < F.char_length(right)
    a, b = F.when(swap, right).otherwise(left), F.when(swap, left).otherwise(right)

    def middle(s: Column) -> Column:
        a, b, p, t = s["a"], s["b"], s["e"]["p"], max_edits
        m, n = F.char_length(a) - p - s["e"]["q"], F.char_length(b) - p - s["e"]["q"]
        out = F.when(m - n > t, t + 1).when(n == 0, m)
        if t <= 2:
            out = out.when(m == 1, 1)
        if t == 2:
            # An edit replaces a character (1, 1), or drops one of a (1, 0) or of b (0, 1).
            kinds = [(1, 1), (1, 0), (0, 1)]
            rest = lambda x, size, first, last: F.substring(x, p + 1 + first, F.greatest(size - first - last, F.lit(0)))
            fits = [
                (m - f[0] - l[0] == n - f[1] - l[1]) & (rest(a, m, f[0], l[0]) == rest(b, n, f[1], l[1]))
                for f in kinds for l in kinds
            ]
            out = out.when(reduce(lambda x, y: x | y, fits), 2)
        if t <= 2:
            return out.otherwise(t + 1)
        cut = lambda x, size: F.split(F.substring(x, p + 1, size), "")
        return out.otherwise(banded_distance(cut(a, m), cut(b, n), t))

    ended = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), common_ends(s["a"], s["b"]).alias("e"))
    return _bind(F.struct(a.alias("a"), b.alias("b")), lambda s: _bind(ended(s), middle))


def remainder_keys(line: Column, length: Column, group: Column, t: int) -> Column:
    """Keys of a line with ``t`` of several pieces left out, for lines at most ``t`` edits apart (1 or 2).

    The line of ``length`` characters that a key stands for is cut into more pieces the
    larger the ``group`` is. Each edit lies within one piece, so what is before the pieces
    left out, counted from the front, and what is behind them, counted from the end, are
    equal in both lines; what is between two of them is equal up to a shift by an edit.
    """
    chars = F.char_length(line)
    d = chars - length
    most = F.ceil(2 * F.sqrt(group)).cast("int")
    m = F.least(most if t == 1 else F.least(most, F.lit(12)), length)
    at = lambda j: F.floor(j * length / m).cast("int")
    head = lambda j: F.substring(line, F.lit(1), at(j))
    tail = lambda j: F.substring(line, chars - (length - at(j + 1)) + 1, length - at(j + 1))
    if t == 1:
        return F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.xxhash64(length, m, j, head(j), tail(j)))
    # Two pieces i < j: the middle of a line longer by d edits is shifted by s with |s| + |d - s| <= 2.
    shifts = F.filter(F.sequence(F.lit(-1), F.lit(1)), lambda s: (F.abs(s) <= 1) & (F.abs(d - s) <= 1))
    middle = lambda i, j, s: F.substring(line, at(i + 1) + 1 + s, at(j) - at(i + 1))
    pair = lambda i, j: F.transform(shifts, lambda s: F.xxhash64(length, m, i, j, head(i), middle(i, j, s), tail(j)))
    rows = F.transform(F.sequence(F.lit(0), m - 2), lambda i: F.flatten(F.transform(F.sequence(i + 1, m - 1), lambda j: pair(i, j))))
    return F.when(m >= 2, F.flatten(rows)).otherwise(F.array(F.xxhash64(length, m)))


#: Rows of a key from which on its lines are told apart by remainder keys; at two edits, where
#: a line has up to 198 of these, so many times more.
LARGE_GROUP, TWO_EDITS = 16, 8


#: Copies from which on a line is frequent, and how many of the most frequent are told apart:
#: any other line makes up no more than one in so many of all.
FREQUENT, MOST = 16, 10_000


def seldom_repeated(lines: DataFrame) -> DataFrame:
    """Lines (h, h2, line) with the most frequent ones once; the others come as often as they did.

    So no line's copies fill one task, though texts are not dealt, as taking each line once would do.
    """
    counts = lines.groupBy("h", "h2").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT)
    frequent = materialize(counts.orderBy(F.desc("n"), "h", "h2").limit(MOST).select("h", "h2"), "frequent-lines")
    few = F.broadcast(frequent)  # at most MOST rows of two numbers
    once = lines.join(few, ["h", "h2"], "left_semi").distinct()
    return lines.join(few, ["h", "h2"], "left_anti").unionByName(once)


def line_candidates(lines: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """(key, own, h, h2, line): lines under keys that at least two different ones share.

    Keys that many lines share are replaced by remainder keys, so that the many variants of
    one line do not all meet each other. ``lines`` (h, h2, line) may repeat.
    """
    lines = lines.select("h", "h2", "line").where(F.char_length("line") >= chars_per_edit)
    keys = segment_keys(seldom_repeated(lines).withColumn("n", F.char_length("line")), max_edits, chars_per_edit)
    # Only keys that different lines share matter; for a key, its lines' extremes tell. Keys
    # name lines by half their hash: should two lines agree in it, both are candidates.
    # A window deals the keys once, where a group and a join would deal them twice.
    w = Window.partitionBy("key")
    told = keys.withColumns({"lo": F.min("h").over(w), "hi": F.max("h").over(w)})
    alive = materialize(told.where("lo <> hi").drop("lo", "hi").distinct(), "line-keys")
    # Only the texts of lines with such keys are dealt; written, so that joins know how few they are.
    names = materialize(alive.select("h").distinct(), "line-names")
    distinct = materialize(matching(lines, names, "h").select("h", "h2", "line").distinct(), "live-texts")
    alive = alive.withColumn("group", F.count("*").over(w)).join(distinct, "h")
    edits = allowed_edits(F.col("length"), max_edits, chars_per_edit)
    many = F.col("group") > F.when(edits == 1, LARGE_GROUP).otherwise(LARGE_GROUP * TWO_EDITS)
    out = alive.where(~many).select("key", "own", "h", "h2", "line")
    for t in range(1, max_edits + 1):
        if t > 2:
            raise ValueError("max_edits must be 1 or 2")
        large = alive.where(many & (edits == t))
        finer = large.select("h", "h2", "own", F.explode(remainder_keys(F.col("line"), F.col("length"), F.col("group"), t)).alias("key")).distinct()
        several = finer.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
        out = out.unionByName(finer.join(several, "key", "left_semi").join(distinct, ["h", "h2"]).select("key", "own", "h", "h2", "line"))
    return out


def line_links(lines: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """(a, b, edits): 128-bit hashes, as hexadecimal strings, of different lines that are alike, and how far apart they are.

    ``lines``: h, h2, line; they may repeat. Lines of ``chars_per_edit`` characters or more
    are alike within :func:`allowed_edits` of the shorter. Each pair that meets under a key is
    decided inside the join, behind what tells the pair itself, so only links leave it.
    """
    found = line_candidates(lines, max_edits, chars_per_edit)
    node = F.concat(F.lpad(F.hex("h"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    found = materialize(found.select("key", "own", node.alias("node"), "line"), "line-candidates")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & ~(F.col("y.own") & (F.col("x.node") > F.col("y.node")))
    near = F.abs(F.char_length("x.line") - F.char_length("y.line")) <= max_edits
    limit = allowed_edits(F.least(F.char_length("x.line"), F.char_length("y.line")), max_edits, chars_per_edit)
    edits = edit_distance(F.col("x.line"), F.col("y.line"), max_edits)
    pairs = found.where("own").alias("x").join(found.alias("y"), met & near & (edits <= limit))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), edits.alias("edits")).distinct()


def line_classes(lines: DataFrame, levels: list[int], chars_per_edit: int) -> DataFrame:
    """h, h2, class_0, class_1 ...: the classes of lines with links, at each of ``levels`` edits, from one join."""
    links = materialize(line_links(lines, max(levels), chars_per_edit), "line-links")
    out = None
    for i, t in enumerate(levels):
        found = connected_components(links.where(F.col("edits") <= t)).withColumnRenamed("component", f"class_{i}")
        out = found if out is None else out.join(found, "node", "full")
    hashes = [F.conv(F.substring("node", at, 16), 16, -10).cast("bigint").alias(name) for at, name in ((1, "h"), (17, "h2"))]
    return out.select(*hashes, *[f"class_{i}" for i in range(len(levels))])


def dedup_lines(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_edits: int = 1, wider: int | None = None, chars_per_edit: int = 20
) -> DataFrame:
    """Replace every text by its lines without those seen before; adds n_lines and n_removed.

    Lines are classes: equal lines of any length, and lines that chains of small edits
    connect: at most one character edit for every ``chars_per_edit`` characters of the
    shorter line, and at most ``max_edits`` (1 or 2). Of each class the first line stays (by
    smallest id, then position) and the others go, in the whole corpus; blank lines always
    stay. With ``wider`` (1 or 2 too) the columns wider_text and wider_removed tell what stays
    and goes at that many edits; both come from the same join. Null texts stay null with no
    lines, empty ones are one blank line; lines and texts of any length are compared whole;
    rows that repeat an id and text are treated alike (the first of their lines stay in all of
    them); nulls sort before all ids; an empty table gives an empty result; other columns are
    kept, except those of the names that are added, in whatever case, which are replaced.
    """
    levels = [max_edits] if wider is None else [max_edits, wider]
    added = ["n_lines", "n_removed"] + ["wider_text", "wider_removed"] * (wider is not None)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("row_key"))
    with scratch(docs.sparkSession) as keep:
        classes = keep(materialize(line_classes(exploded_lines(slim), levels, chars_per_edit), "line-classes"))
    at = F.struct("id", "row_key", "pos").alias("at")
    places = exploded_lines(slim.select(F.struct("id", "row_key").alias("row_key"), "text"))
    places = places.select("h", "h2", F.col("row_key.id").alias("id"), F.col("row_key.row_key").alias("row_key"), "pos").select("h", "h2", at)
    groups = places.groupBy("h", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).join(classes, ["h", "h2"], "left")
    # Lines that occur once and have no links stay; all others are decided by their class.
    linked = F.coalesce(*[f"class_{i}" for i in range(len(levels))]).isNotNull()
    decided = several = materialize(groups.where((F.col("n") > 1) | linked), "line-groups")
    for i in range(len(levels)):
        # Written, so that its size is known when the join is planned: small, it isn't dealt by class.
        of = several.where(F.col(f"class_{i}").isNotNull()).groupBy(f"class_{i}").agg(F.min("first").alias(f"chain_{i}"))
        decided = decided.join(materialize(of, "line-chains"), f"class_{i}", "left")
    decided = decided.select("h", "h2", *[F.coalesce(f"chain_{i}", "first").alias(f"keep_{i}") for i in range(len(levels))])
    goes = [F.col("at") != F.col(f"keep_{i}") for i in range(len(levels))]
    sets = [F.collect_set(F.when(goes[i], F.col("at.pos"))).alias(f"gone_{i}") for i in range(len(levels))]
    gone = places.join(decided, ["h", "h2"]).where(reduce(lambda x, y: x | y, goes)).groupBy("at.row_key").agg(*sets)
    # Written, as it is read twice; texts that lose no line are mostly not dealt.
    gone = materialize(gone, "lines-gone")
    # The row travels as one struct, so that no column of it can clash with those used here.
    others = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != text_col])
    whole = marked(rows.select(others.alias("row"), F.col(text_col).alias("text"), key.alias("row_key")), gone, "row_key")
    unmet = [F.lit(None).cast(gone.schema[f"gone_{i}"].dataType).alias(f"gone_{i}") for i in range(len(levels))]
    lost = whole.where("_likely").drop("_likely").join(gone, "row_key", "left")
    out = lost.unionByName(whole.where("not _likely").drop("_likely").select("*", *unmet)).withColumn("lines", F.split("text", NEWLINE))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint")

    def told(i: int) -> tuple[Column, Column]:
        less = F.coalesce(F.size(f"gone_{i}") > 0, F.lit(False))
        left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col(f"gone_{i}"))
        kept = F.array_join(F.transform(left, lambda k: F.get(F.col("lines"), k)), NEWLINE)
        return F.when(less, kept).otherwise(F.col("text")), F.when(less, F.size(f"gone_{i}")).otherwise(0).cast("bigint")

    new, removed = told(0)
    more = [c.alias(name) for c, name in zip(told(1), added[2:], strict=True)] if wider is not None else []
    return out.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in rows.columns], n.alias("n_lines"), removed.alias("n_removed"), *more)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the digest of what stays, for every document: at one edit a line, and (wider) at two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, max_edits=1, wider=2)
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest("text").alias("kept_sha256"), "wider_removed", digest("wider_text").alias("wider_sha256"))
