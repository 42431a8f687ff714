"""Conversation structure repair by error-correcting Earley parsing of a weighted role grammar."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import materialize, row_key, scratch

#: Costs and letters of the edits: keep, rerole, delete, insert; and what a truncated row adds unless deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = (0, "K"), (3, "R"), (4, "D"), (3, "I"), 3
#: What has been said so far, and whether a conversation may end there.
STATES = {"open": True, "system": False, "asked": False, "answered": True}
#: The role grammar: (left, right, cost, letter). A terminal is a test of one row, in quotes; an
#: empty right side inserts. Sides are left-recursive, so that a chart column holds few items.
GRAMMAR = [
    *((state, (state, "Gone"), 0, "") for state in STATES),
    ("system", ("open", "System"), 0, ""),
    ("asked", ("open", "User"), 0, ""),
    ("asked", ("system", "User"), 0, ""),
    ("asked", ("answered", "User"), 0, ""),
    ("answered", ("asked", "Assistant"), 0, ""),
    ("System", ("'s'",), *KEEP),
    ("User", ("'u'",), *KEEP),
    ("Assistant", ("'a'",), *KEEP),
    ("User", ("'any'",), *REROLE),
    ("Assistant", ("'any'",), *REROLE),
    ("User", (), *INSERT),
    ("Assistant", (), *INSERT),
    ("Gone", ("'row'",), *DELETE),
]
PRODUCTIONS = defaultdict(list)
for _at, _production in enumerate(GRAMMAR):
    PRODUCTIONS[_production[0]].append(_at)
#: Rows of a conversation that one chart covers; longer ones are parsed in segments.
SEGMENT = 256


def admitted(terminal: str, initial: str, fault: str) -> int | None:
    """Cost that a terminal adds for a row, or None where it does not fit.

    ``fault``: '.' none, 'x' blank or duplicate, 't' truncated. Faulty rows but truncated ones
    can only be deleted.
    """
    if terminal == "'row'":
        return 0
    if fault == "x" or terminal not in ("'any'", f"'{initial}'"):
        return None
    return TRUNCATED if fault == "t" else 0


@lru_cache(maxsize=20_000)
def parse(initials: str, faults: str, start: str) -> dict[str, tuple[int, str]]:
    """Cheapest (cost, audit) that leads from ``start`` over these rows to each state.

    An Earley chart: items are (production, dot, origin) and hold the least (cost, audit) of
    what they cover. Error productions delete, rerole and insert. Since edits cost more than
    nothing and insertions come at a cost, of two audits of one item and cost none is the
    beginning of the other, so the least stays least whatever follows.
    """
    chart: list[dict] = [{} for _ in range(len(initials) + 1)]
    waiting: list[dict] = [defaultdict(set) for _ in chart]  # symbol -> items of the column that expect it
    complete: list[dict] = [{} for _ in chart]  # (symbol, origin) -> (cost, audit)

    def put(j: int, item: tuple[int, int, int], value: tuple[int, str], todo: list) -> None:
        if item not in chart[j] or value < chart[j][item]:
            chart[j][item] = value
            todo.append(item)

    for j in range(len(chart)):
        todo = list(chart[j])
        if j == 0:
            complete[0][start, 0] = (0, "")
            for state in STATES:
                for p in PRODUCTIONS[state]:
                    put(0, (p, 0, 0), (0, ""), todo)
        while todo:
            item = todo.pop()
            p, dot, origin = item
            value = chart[j][item]
            left, right, cost, letter = GRAMMAR[p]
            if dot < len(right):
                symbol = right[dot]
                if symbol[0] == "'":  # scan
                    extra = admitted(symbol, initials[j], faults[j]) if j < len(initials) else None
                    if extra is not None:
                        put(j + 1, (p, dot + 1, origin), (value[0] + extra, value[1]), [])
                    continue
                waiting[j][symbol].add(item)
                for q in PRODUCTIONS[symbol]:  # predict
                    put(j, (q, 0, j), (0, ""), todo)
                done = complete[j].get((symbol, j))
                if done is not None:  # completed before it was expected
                    put(j, (p, dot + 1, origin), (value[0] + done[0], value[1] + done[1]), todo)
                continue
            found = (value[0] + cost, value[1] + letter)
            before = complete[j].get((left, origin))
            if before is not None and before <= found:
                continue
            complete[j][left, origin] = found
            for q, at, start_of in list(waiting[origin][left]):  # complete
                held = chart[origin][q, at, start_of]
                put(j, (q, at + 1, start_of), (held[0] + found[0], held[1] + found[1]), todo)
    return {state: complete[-1][state, 0] for state in STATES if (state, 0) in complete[-1]}


def joined(segments: list[dict[str, dict[str, tuple[int, str]]]]) -> tuple[int, str]:
    """Cheapest (cost, audit) of a conversation from its segments' moves {start: {end: (cost, audit)}}."""
    best = {"open": (0, "")}
    for moves in segments:
        after: dict[str, tuple[int, str]] = {}
        for state, (cost, audit) in best.items():
            for end, (more, letters) in moves[state].items():
                found = (cost + more, audit + letters)
                if end not in after or found < after[end]:
                    after[end] = found
        best = after
    return min(value for state, value in best.items() if STATES[state])


def fault_columns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (written, with a number ``rid`` of their own) and each one's first ``fault``.

    ``turns``: conv, turn, role, text, without null roles and texts. A row is a duplicate
    unless it is the first, by turn, of its role and text: firsts are found by a grouping
    that is combined before the shuffle and come back by row number, so that no key is hot.
    """
    rows = turns.withColumn("digest", row_key("role", "text")).withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "turns")
    firsts = rows.groupBy("conv", "digest").agg(F.min(F.struct("turn", "rid")).alias("first")).select(F.col("first.rid").alias("rid"), F.lit(True).alias("is_first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = rows.select("rid", "conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"), last.alias("last")).join(firsts, "rid", "left")
    fault = (
        F.when(F.col("last") == "", "blank").when(F.col("is_first").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    )
    return rows, slim.select("rid", "conv", "turn", "digest", "initial", fault.alias("fault"))


#: Order of a conversation's turns, nulls first.
ORDER = ["turn", "digest", "rid"]
MOVES = "array<struct<start:string,end:string,cost:long,audit:string>>"
SEGMENT_SCHEMA = f"part int, at long, gap_low long, gap_high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, moves {MOVES}"
LEGAL = {"su", "ua", "au"}


def _segments(names: list[str]):
    """Arrow function over sorted (conv, turn, initial, fault): one row a segment of up to SEGMENT rows.

    A segment that may continue a conversation of the task before is parsed from every state.
    """

    def run(batches):
        part, at, out = TaskContext.get().partitionId(), 0, []
        conv = object()
        rows: list[tuple] = []
        begun = False  # whether the open segment begins its conversation

        def close():
            initials = "".join(r[1] if r[1] in ("s", "u", "a") else "o" for r in rows)
            faults = "".join({"": ".", "truncated": "t"}.get(r[2], "x") for r in rows)
            known = [r[0] for r in rows if r[0] is not None]
            starts = ["open"] if begun else list(STATES)
            moves = [{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, (c, a) in parse(initials, faults, s).items()]
            count = lambda kind: sum(r[2] == kind for r in rows)
            illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(rows) - 1))
            return (conv, part, at, min(known, default=None), max(known, default=None), len(set(known)), count("blank"), count("duplicate"), count("truncated"), illegal, initials[0], initials[-1], moves)

        def batch(schema):
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        schema = None
        for incoming in batches:
            if schema is None:
                moves = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
                kinds = [incoming.schema.field(0).type, pa.int32(), *[pa.int64()] * 8, pa.string(), pa.string(), moves]
                schema = pa.schema(list(zip(names, kinds, strict=True)))
            for c, turn, initial, fault in zip(*(x.to_pylist() for x in incoming.columns), strict=True):
                if rows and (c != conv or len(rows) == SEGMENT):
                    out.append(close())
                    at += 1
                    begun = c != conv
                    rows = []
                conv = c
                rows.append((turn, initial, fault))
            if len(out) >= 2000:
                yield batch(schema)
                out = []
        if rows:
            out.append(close())
        if out:
            yield batch(schema)

    return run


def _composed(names: list[str]):
    """Arrow function (conv, segments in order) -> the conversation's figures, cost and audit."""

    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                charts = []
                for p in parts:
                    moves: dict = defaultdict(dict)
                    for m in p["moves"]:
                        moves[m["start"]][m["end"]] = (m["cost"], m["audit"])
                    charts.append(moves)
                cost, audit = joined(charts)
                lows = [p["gap_low"] for p in parts if p["gap_low"] is not None]
                highs = [p["gap_high"] for p in parts if p["gap_high"] is not None]
                met = sum(a["gap_high"] is not None and a["gap_high"] == b["gap_low"] for a, b in zip(parts, parts[1:], strict=False))
                gaps = max(highs) - min(lows) + 1 - (sum(p["turns"] for p in parts) - met) if lows else 0
                edges = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
                total = lambda k, parts=parts: sum(p[k] for p in parts)
                out.append((gaps, total("blank"), total("duplicate"), total("truncated"), total("illegal") + edges, cost, audit))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.string())], names=names)

    return run


def _repaired(batches):
    """Arrow function over rows sorted by conversation, its audit first, then its turns -> repaired rows.

    Holds one audit and the open batch, never the texts of a conversation.
    """
    roles = {"u": "user", "a": "assistant"}
    audit, edit, seq, expected = "", 0, 0, "u"

    def inserted(out, conv):
        nonlocal edit, seq, expected
        while edit < len(audit) and audit[edit] == "I":
            out.append((conv, seq, "insert", roles[expected], ""))
            edit, seq, expected = edit + 1, seq + 1, "a" if expected == "u" else "u"

    for batch in batches:
        out: list[tuple] = []
        for conv, letters, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if letters is not None:
                audit, edit, seq, expected = letters, 0, 0, "u"
            else:
                letter = audit[edit]
                edit += 1
                if letter != "D":
                    if letter == "R":
                        role = roles[expected]
                    if not (seq == 0 and letter == "K" and role[:1] == "s"):
                        expected = "a" if expected == "u" else "u"
                    out.append((conv, seq, "rerole" if letter == "R" else "keep", role, text))
                    seq += 1
            inserted(out, conv)
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "seq", "edit", "role", "text"])


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of conversations given as rows; null roles and texts are one space.

    audits: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost and audit, one row a
    conversation. Repaired turns: ``conv_col``, seq (gapless from 0), edit (keep, rerole or
    insert), role and text, each conversation whole and in order within one partition. Turns go
    by number, nulls first; those of equal number by a hash of role and text, so that equal
    rows are neighbours. Rows without conversation form one; an empty table gives empty
    results; texts of any length are kept whole; other columns are not read.

    Rows are sorted and dealt by conversation and turn, not by conversation alone, and parsed
    in segments of SEGMENT rows wherever they lie; per conversation only the segments' moves
    and figures are gathered, about as many bytes as the audit that its one row must hold.
    Texts are streamed in order past the audit.
    """
    spark = turns.sparkSession
    kind = turns.select(conv_col).schema[0].dataType.simpleString()
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"))
    with scratch(spark) as keep:
        rows, slim = fault_columns(named)
        rows = keep(rows)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["conv", *ORDER]
        dealt = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "turn", "initial", "fault")
        names = ["conv", *[f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]]
        segments = dealt.mapInArrow(_segments(names), f"conv {kind}, {SEGMENT_SCHEMA}")
        gathered = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*names[1:]))).alias("parts"))
        told_names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        audits = gathered.mapInArrow(_composed(told_names), f"conv {kind}, " + ", ".join(f"{n} long" for n in told_names[1:7]) + ", audit string")
        audits = keep(materialize(audits, "audits"))
    null = lambda t: F.lit(None).cast(t)
    lead = audits.select("conv", "audit", null("string").alias("role"), null("string").alias("text"), F.lit(False).alias("row"), null("long").alias("turn"), null("binary").alias("digest"), null("long").alias("rid"))
    told_rows = rows.select("conv", null("string").alias("audit"), "role", "text", F.lit(True).alias("row"), "turn", "digest", "rid")
    stream = lead.unionByName(told_rows).repartition("conv").sortWithinPartitions("conv", "row", *ORDER)
    repaired = stream.select("conv", "audit", "role", "text").mapInArrow(_repaired, f"conv {kind}, seq long, edit string, role string, text string")
    return audits.withColumnRenamed("conv", conv_col), repaired.withColumnRenamed("conv", conv_col)


def digests(repaired: DataFrame) -> DataFrame:
    """conversation, repaired_sha256 of repaired turns that lie in order: ``role:text`` joined by line feeds."""

    def run(batches):
        conv, state = None, None
        kind = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for c, seq, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if seq == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], names=["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    name = repaired.columns[0]
    kind = repaired.schema[0].dataType.simpleString()
    return repaired.select(name, "seq", "role", "text").mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The registered query's damage, decided by crc32(``conv_id:turn``) mod 20; nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"))
    way: Column = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(way == 4, "user").otherwise(F.col("role"))
    copies = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def op13_repair_conversations(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and the digest of the repaired turns, for every conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    audits, repaired = repair(damaged(turns))
    texts = digests(repaired)
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    # One row a conversation on each side; rows without conversation meet, too.
    out = every.join(audits, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(texts, F.col("id").eqNullSafe(F.col("conv")), "left")
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
