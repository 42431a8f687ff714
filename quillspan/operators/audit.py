"""Audits of spans, snapshots, text quality and cost."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import fold


def sequence_audit(spans: DataFrame, key: str, index: str, begin: str, end: str, total: str) -> DataFrame:
    """Bytes covered by possibly overlapping spans, and holes, inversions and disorder.

    Coverage adds what each span, in order, reaches beyond all spans before it.
    """
    by_begin = Window.partitionBy(key).orderBy(begin, end)
    by_index = Window.partitionBy(key).orderBy(index)
    seen = F.coalesce(F.max(end).over(by_begin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = spans.withColumns({"_seen": seen, "_pi": F.lag(index).over(by_index), "_pa": F.lag(begin).over(by_index)})
    return x.groupBy(key).agg(
        F.sum(F.greatest(F.lit(0), F.col(end) - F.greatest(begin, "_seen"))).alias("covered"), F.max(total).cast("long").alias("total"),
        F.count_if(F.col(index) != F.col("_pi") + 1).alias("holes"), F.count_if(F.col(begin) > F.col(end)).alias("inverted"), F.count_if(F.col(begin) < F.col("_pa")).alias("disordered"),
    )


def anchors_in_spans(anchors: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, bin_size: int = 1024) -> DataFrame:
    """Point-in-interval join by equal key and bin, so that it shuffles as an equi-join."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(begin) / bin_size), F.floor((F.greatest(F.col(begin), F.col(end) - 1)) / bin_size))))
    points = anchors.withColumn("_bin", F.floor(F.col(at) / bin_size))
    return points.join(binned, [key, "_bin"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin")


def stale_diff(produced: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row: produced, in_store, converged, left_behind, missing, stale_share (null if empty)."""
    p, s = produced.select(key).distinct().withColumn("_p", F.lit(True)), present.select(key).distinct().withColumn("_s", F.lit(True))
    j = p.join(s, key, "full_outer")
    left = F.count_if(F.col("_p").isNull())
    return j.agg(
        F.count("_p").alias("produced"), F.count("_s").alias("in_store"), F.count_if(F.col("_p") & F.col("_s")).alias("converged"),
        left.alias("left_behind"), F.count_if(F.col("_s").isNull()).alias("missing"), F.round(F.when(F.count("_s") > 0, left / F.count("_s")), 6).alias("stale_share"),
    )


def reconcile(manifest: DataFrame, catalog: DataFrame, key: str, state: str, amount: str) -> DataFrame:
    """Full outer comparison of two records of the same things: what disagrees, and how."""
    m = manifest.select(key, F.col(state).alias("m_state"), F.col(amount).alias("m_amount"))
    c = catalog.select(key, F.col(state).alias("c_state"), F.col(amount).alias("c_amount"))
    verdict = (
        F.when(F.col("m_state").isNull(), "invented").when(F.col("c_state").isNull(), "absent")
        .when(F.col("m_state") != F.col("c_state"), "state").when(F.abs(F.col("m_amount") - F.col("c_amount")) > 1e-6, "cost").otherwise("agrees")
    )
    return m.join(c, key, "full_outer").select(key, verdict.alias("verdict"))


def correction_gate(original: Column, corrected: Column) -> Column:
    """First reason to refuse a correction, or the empty string.

    Too much longer or shorter, more than 20 characters lost, or numbers of two digits and
    more, chapter-and-verse references or names that are gone.
    """
    fixed = F.trim(corrected)
    n, m = F.char_length(original), F.char_length(fixed)
    lost = lambda rx, g=0: F.size(F.array_except(F.regexp_extract_all(original, F.lit(rx), g), F.regexp_extract_all(fixed, F.lit(rx), g))) > 0
    body = F.regexp_replace(original, r"(^|[.!?¿¡]\s+)[A-ZÁÉÍÓÚÑ]", "$1")
    names = F.regexp_extract_all(body, F.lit(r"\b([A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,})"), 1)
    gone = F.exists(names, lambda w: ~F.contains(fold(fixed), fold(w)))
    return (
        F.when(m == 0, "empty").when(F.abs(m - n) / F.greatest(F.lit(1), n) > 0.25, "length").when(n - m > 20, "deleted")
        .when(lost(r"(\d{1,3}:\d{1,3})", 1), "scripture").when(lost(r"(\d{2,})", 1), "numbers").when(gone, "proper_noun").otherwise("")
    )


def repeated_lines(docs: DataFrame, group: str, text: str, least: int = 3, longest: int = 120, top: int = 40) -> DataFrame:
    """Most frequent short lines of every group (a top-k report)."""
    lines = docs.select(group, F.explode(F.split(text, "\n")).alias("line")).select(group, F.trim("line").alias("line")).where((F.col("line") != "") & (F.char_length("line") < longest))
    counted = lines.groupBy(group, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(group).orderBy(F.desc("n"), "line")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def stage_durations(events: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Events with the microseconds until the next one of their key; null for the last."""
    w = Window.partitionBy(key).orderBy(at, seq)
    return events.withColumn("duration_us", F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)).withColumn("first_of_stage", F.row_number().over(Window.partitionBy(key, "stage").orderBy(at, seq)) == 1)


def availability(name: str, value: Column) -> Column:
    """Envelope that keeps 'could not be asked' apart from zero."""
    return F.struct(F.lit(name).alias("leg"), value.isNotNull().alias("available"), value.alias("data"))


def choose_stream(spans: DataFrame, streams: DataFrame) -> DataFrame:
    """id, chosen, verified, unanimous: the text that each document's spans really index.

    ``spans``: id, begin, end, text; ``streams``: id, label, content. Every stream is
    measured; the one with most verified spans wins, the earlier label on a tie.
    """
    raw = streams.select("id", "label", F.encode("content", "UTF-8").alias("_raw"))
    piece = F.try_validate_utf8(F.expr("substring(_raw, begin + 1, end - begin)").cast("string"))
    scored = spans.join(raw, "id").groupBy("id", "label").agg(F.count_if(piece == F.col("text")).alias("verified"), F.count("*").alias("n"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("verified")).alias("v"), "label", "n")).alias("b"))
    return best.select("id", F.col("b.label").alias("chosen"), (-F.col("b.v")).alias("verified"), (F.col("b.n") == -F.col("b.v")).alias("unanimous"))


def shared_ranges(chunks: DataFrame, key: str) -> DataFrame:
    """Paragraph ranges (first, last) that several chunks of a key report."""
    return chunks.groupBy(key, "para_from", "para_to").agg(F.count("*").alias("chunks")).where("chunks > 1")


def chunk_times(chunks: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Chunks (key, index, para_from, para_to) with start_s, end_s and ``fault``.

    Times are the start of the first and the end of the last paragraph of ``table`` (key,
    idx, start_s, end_s). A range outside the table is a fault, never clamped.
    """
    first = table.select(key, F.col("idx").alias("para_from"), "start_s")
    last = table.select(key, F.col("idx").alias("para_to"), "end_s")
    j = chunks.join(first, [key, "para_from"], "left").join(last, [key, "para_to"], "left")
    fault = F.when(F.col("para_to") < F.col("para_from"), "backwards").when(F.col("start_s").isNull() | F.col("end_s").isNull(), "outside")
    return j.withColumn("fault", fault).withColumns({c: F.when(F.col("fault").isNull(), F.col(c)) for c in ("start_s", "end_s")})


def time_report(timed: DataFrame, duration: DataFrame, key: str) -> DataFrame:
    """Per key: chunks, faults, starts that go back, starts behind ends, and ends past the duration (reported only)."""
    w = Window.partitionBy(key).orderBy("index")
    back = F.col("start_s") < F.lag("start_s").over(w)
    return timed.withColumn("_back", back).join(duration, key, "left").groupBy(key).agg(
        F.count("*").alias("chunks"), F.count("fault").alias("faults"), F.count_if("_back").alias("back"),
        F.count_if(F.col("start_s") > F.col("end_s")).alias("inverted"), F.count_if(F.col("end_s") > F.col("duration_s")).alias("past_duration"),
    )


def uncovered(chunks: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Paragraphs (key, idx) of ``table`` that no chunk covers."""
    seen = chunks.where("para_to >= para_from").select(key, F.explode(F.sequence("para_from", "para_to")).alias("idx")).distinct()
    return table.select(key, "idx").join(seen, [key, "idx"], "left_anti")


def alignment(paragraphs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Per key: paragraphs, timed groups, blank paragraphs, and whether indices still carry the times."""
    p = paragraphs.groupBy(key).agg(F.count("*").alias("paragraphs"), F.count_if(F.trim(F.regexp_replace("text", r"\s+", " ")) == "").alias("blank"))
    j = p.join(table.groupBy(key).agg(F.count("*").alias("timed")), key, "full").fillna(0)
    return j.withColumn("aligned", (F.col("blank") == 0) & (F.col("paragraphs") == F.col("timed")))


def status_fold(rows: DataFrame, key: str) -> DataFrame:
    """Claims and quoted claims per status and, with a null status, in all; what has no status stays apart."""
    named = rows.withColumn("status", F.coalesce("status", F.lit("sin_estado")))
    each = named.rollup(key, "status").agg(F.sum("claims").alias("claims"), F.sum("with_quote").alias("with_quote"))
    return each.where(F.col(key).isNotNull())


def ledger(calls: DataFrame) -> DataFrame:
    """Per stage: calls, retries, failures, cache hits, tokens, usd (null where nothing is priced) and unpriced calls."""
    sums = [F.sum(c).alias(c) for c in ("retries", "failures", "cache_hits", "tokens")]
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), *sums, F.round(F.sum("usd"), 2).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced"))


def heading_disagreement(chunks: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Distinct chapters of every key under several rule sets, and whether they disagree."""
    counts = [F.countDistinct(F.nullif(c, F.lit(""))).alias(n) for n, c in rules.items()]
    return chunks.groupBy(key).agg(*counts).withColumn("disagree", F.greatest(*rules) != F.least(*rules))


def semantic_diff(produced: dict[str, DataFrame], held: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for claims, concepts and mentions each: the set differences of a run and the graph."""
    parts = [stale_diff(produced[k].select(key).distinct(), held[k].select(key).distinct(), key).withColumn("what", F.lit(k)) for k in produced]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Words of the inner run by which a quote is looked up, and short quotes that one pass over the documents searches for.
QUOTE_GRAM, QUOTES_PER_PASS = 4, 50_000


def quoted_in(docs: DataFrame, quotes: DataFrame, key: str, text: str, quote: str) -> DataFrame:
    """Documents (``key`` names them) with each quote they hold verbatim; null and empty quotes are held by none.

    A quote of six words or more is found by the hash of its second to fifth word, which any
    text that holds it must have between blanks: only keys and hashes are exploded and met,
    and texts are fetched once for each pair that met, to be verified. Shorter quotes, which
    have no such run, are searched by an automaton in one pass for QUOTES_PER_PASS of them.
    """
    run = lambda words, i: F.xxhash64(*[F.get(words, i + k) for k in range(QUOTE_GRAM)])
    distinct = quotes.where(F.col(quote) != "").select(F.col(quote).alias("_quote")).distinct()
    size = F.size(F.split("_quote", " "))
    long = distinct.where(size >= QUOTE_GRAM + 2).withColumn("_key", run(F.split("_quote", " "), F.lit(1)))
    words = docs.select(F.col(key).alias("_id"), F.split(text, " ").alias("_words")).where(F.size("_words") >= QUOTE_GRAM)
    keys = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_words") - QUOTE_GRAM), lambda i: run(F.col("_words"), i)))
    met = words.select("_id", F.explode(keys).alias("_key")).join(long, "_key").select("_id", "_quote").distinct()
    for asked in _passes(distinct.where(size < QUOTE_GRAM + 2), "_quote", QUOTES_PER_PASS):
        met = met.unionByName(_short_hits(docs, key, text, asked))
    found = docs.join(met, F.col(key).eqNullSafe(F.col("_id"))).where(F.contains(text, F.col("_quote")))
    return found.join(quotes, F.col("_quote") == F.col(quote)).select(*docs.columns, *quotes.columns)


def _passes(rows: DataFrame, column: str, most: int):
    """The column's values as lists of up to ``most``."""
    held: list[str] = []
    for row in rows.select(column).toLocalIterator():
        held.append(row[0])
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _short_hits(docs: DataFrame, key: str, text: str, asked: list[str]) -> DataFrame:
    """_id, _quote: which of the strings each document holds, by one automaton over all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # QUOTES_PER_PASS strings of under six words

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for q in shared.value:
            automaton.add_word(q, q)
        automaton.make_automaton()
        for batch in batches:
            places, quotes = [], []
            for i, value in enumerate(batch.column(1)):
                hits = {q for _, q in automaton.iter(value.as_py() or "")}
                places += [i] * len(hits)
                quotes += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(quotes, pa.string())], names=["_id", "_quote"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"_id {kind}, _quote string")
