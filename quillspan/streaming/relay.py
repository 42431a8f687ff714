"""Keyed streams: a micro-batching relay, buffered early events, a resumable tail, JSON fields as they arrive.

All are ``transformWithState`` processors: state lives in the RocksDB store, by key, and is
checkpointed with the query, so that a restart goes on where it stopped. Rows of one key may
arrive in any order and more than once; they take effect in the order of their number. Early
ones wait in state, a row at a time, and no key's rows are gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Characters and seconds after which pending text is flushed, and characters of an answer held back.
FLUSH_CHARS, FLUSH_SECONDS, HOLD_BACK = 40, 0.25, 60
#: Milliseconds that the state of a finished or silent key is kept for, to know late repeats.
KEEP_MS = 24 * 3600 * 1000


def _stateful(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, ROCKS)


class InOrder(StatefulProcessor):
    """Gives each key's rows to :meth:`take` by their ``seq``, gapless from ``first``, each once."""

    first = 0
    row_schema = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long", self.keep_ms)
        self.early = handle.getMapState("early", "seq long", self.row_schema, self.keep_ms)
        self.open()

    keep_ms = KEEP_MS

    def open(self) -> None:
        """Further state of the processor."""

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def in_order(self, key: tuple, rows: Iterator[Row]) -> Iterator[Row]:
        due = self.next.get()[0] if self.next.exists() else self.first
        for row in rows:
            row = tuple(row[c.split()[0]] for c in self.row_schema.split(", "))
            if row[0] is None or row[0] < due:
                continue  # a repeat
            if row[0] > due:
                self.early.updateValue((row[0],), row)
                continue
            yield from self.take(key, row)
            due += 1
            while self.early.containsKey((due,)):
                row = tuple(self.early.getValue((due,)))
                self.early.removeKey((due,))
                yield from self.take(key, row)
                due += 1
        self.next.update((due,))

    def close(self) -> None:
        pass


class Relay(InOrder):
    """Pieces of prose joined to chunks, stages passed on at once, in one sequence."""

    row_schema = "seq long, at long, kind string, text string"

    def __init__(self, chars: int, seconds: float, idle: bool):
        self.chars, self.seconds, self.idle = chars, seconds, idle

    def open(self) -> None:
        self.pending = self.handle.getValueState("pending", "text string, last long, out long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.in_order(key, rows)
        if self.idle and self.pending.exists() and self.pending.get()[0]:
            # What is pending does not wait for a piece that may never come.
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        text, last, out = self.pending.get() if self.pending.exists() else ("", None, 0)
        if text:
            self.pending.update(("", last, out + 1))
            yield Row(conv_id=key[0], turn=key[1], chunk_seq=out + 1, kind="token", text=text)

    def take(self, key, row):
        _, at, kind, text = row
        held, last, out = self.pending.get() if self.pending.exists() else ("", at, 0)
        told = lambda n, k, x: Row(conv_id=key[0], turn=key[1], chunk_seq=n, kind=k, text=x)
        if kind == "token":
            held += text or ""
            if text and (len(held) >= self.chars or at - last >= self.seconds * 1e6):
                out += 1
                yield told(out, "token", held)
                held, last = "", at
        else:
            if held:
                out += 1
                yield told(out, "token", held)
                held, last = "", at
            out += 1
            yield told(out, kind, text or "")
        self.pending.update((held, last, out))


def relay(pieces: DataFrame, *, chars: int = FLUSH_CHARS, seconds: float = FLUSH_SECONDS, idle: bool = True) -> DataFrame:
    """conv_id, turn, chunk_seq (from 1), kind, text: a turn's pieces as fewer, larger chunks.

    ``pieces``: conv_id, turn, seq (gapless from 0), at, kind (``token`` or a stage) and text.
    Prose is flushed once ``chars`` characters are pending or ``seconds`` have passed, by
    ``at``, since the last flush; a stage flushes first and is passed on at once. With
    ``idle`` a processing-time timer flushes what is left when no more arrives. Empty and null
    pieces add nothing.
    """
    _stateful(pieces.sparkSession)
    processor = Relay(chars, seconds, idle)
    schema = "conv_id long, turn long, chunk_seq long, kind string, text string"
    timed = pieces.withColumn("at", F.unix_micros("at"))  # state keeps numbers, not times
    return timed.groupBy("conv_id", "turn").transformWithState(processor, schema, "append", "ProcessingTime")


class EarlyEvents(StatefulProcessor):
    """Events wait for the row of their run; see :func:`attach_early`."""

    event = "seq long, at long, stage string"

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "tenant_id string, dropped boolean", KEEP_MS)
        self.waiting = handle.getMapState("waiting", "seq long", self.event, KEEP_MS)
        self.seen = handle.getMapState("seen", "seq long", "yes boolean", KEEP_MS)

    def _out(self, key, row, tenant, verdict) -> Row:
        return Row(run_id=key[0], seq=row[0], at=row[1], stage=row[2], tenant_id=tenant, verdict=verdict)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tenant = self.run.get()[0] if self.run.exists() else None
        known = self.run.exists() and not self.run.get()[1]
        held = False
        for row in rows:
            if row["is_run"]:
                if not known:
                    tenant, known = row["tenant_id"], True
                    self.run.update((tenant, False))
                    for event in sorted((tuple(v) for v in self.waiting.values()), key=lambda e: e[0]):
                        yield self._out(key, event, tenant, "recorded")
                    self.waiting.clear()
                continue
            event = (row["seq"], row["at"], row["stage"])
            if self.seen.containsKey((event[0],)):
                continue  # the first of a number counts
            self.seen.updateValue((event[0],), (True,))
            if known:
                yield self._out(key, event, tenant, "recorded")
            else:
                self.waiting.updateValue((event[0],), event)
                held = True
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        if not self.run.exists():
            for event in sorted((tuple(v) for v in self.waiting.values()), key=lambda e: e[0]):
                yield self._out(key, event, None, "dropped")
            self.waiting.clear()

    def close(self) -> None:
        pass


def attach_early(events: DataFrame, runs: DataFrame, *, patience_ms: int = KEEP_MS) -> DataFrame:
    """run_id, seq, at, stage, tenant_id, verdict: events once their run's row is known, each number once.

    ``events``: run_id, seq, at, stage; ``runs``: run_id, tenant_id; both streams. Events that
    come before their run are held in state and released, in order, when it comes; those that
    have waited for ``patience_ms`` of processing time come out as ``dropped``. Events without
    run or number are dropped at once.
    """
    _stateful(events.sparkSession)
    none = lambda t: F.lit(None).cast(t)
    both = events.where("run_id is not null and seq is not null").select(F.col("run_id").cast("long"), F.lit(False).alias("is_run"), F.col("seq").cast("long"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "stage", none("string").alias("tenant_id"))
    named = runs.where("run_id is not null").select(F.col("run_id").cast("long"), F.lit(True).alias("is_run"), none("long").alias("seq"), none("long").alias("at"), none("string").alias("stage"), F.col("tenant_id").cast("string"))
    schema = "run_id long, seq long, at long, stage string, tenant_id string, verdict string"
    out = both.unionByName(named).groupBy("run_id").transformWithState(EarlyEvents(patience_ms), schema, "append", "ProcessingTime")
    return out.withColumn("at", F.timestamp_micros("at"))


class Tail(InOrder):
    """A turn's chunks in order, then its end; see :func:`tail_turns`."""

    row_schema = "seq long, kind string, text string"

    def __init__(self, since: int):
        self.since = since
        self.first = since + 1

    def open(self) -> None:
        self.settled = self.handle.getValueState("settled", "state string, chunks long", self.keep_ms)
        self.done = self.handle.getValueState("done", "yes boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        def chunks():
            for row in rows:
                if row["state"] is None:
                    yield row
                elif not self.settled.exists():
                    self.settled.update((row["state"], row["chunks"]))

        yield from self.in_order(key, chunks())
        if self.settled.exists() and not self.done.exists():
            state, total = self.settled.get()
            if self.next.get()[0] > total:
                self.done.update((True,))
                yield Row(conv_id=key[0], turn=key[1], seq=max(total, self.since), type="done", text=state)

    def take(self, key, row):
        seq, kind, text = row
        yield Row(conv_id=key[0], turn=key[1], seq=seq, type="token" if kind == "token" else "stage", text=text if kind == "token" else kind)


def tail_turns(chunks: DataFrame, settled: DataFrame, *, since: int = 0) -> DataFrame:
    """conv_id, turn, seq, type, text: what follows ``since`` of every turn, in order, up to its end.

    ``chunks``: conv_id, turn, chunk_seq (gapless from 1), kind, text, as :func:`relay` gives
    them; ``settled``: conv_id, turn, state, chunks (how many were published); both streams. A
    turn ends with one ``done`` row that bears its state, and only after its last chunk, though
    the news of its end may come first. Restarted from its checkpoint the tail repeats nothing.
    """
    _stateful(chunks.sparkSession)
    none = lambda t: F.lit(None).cast(t)
    a = chunks.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("chunk_seq").cast("long").alias("seq"), "kind", "text", none("string").alias("state"), none("long").alias("chunks"))
    b = settled.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), none("long").alias("seq"), none("string").alias("kind"), none("string").alias("text"), F.coalesce("state", F.lit("")).alias("state"), F.coalesce(F.col("chunks").cast("long"), F.lit(0)).alias("chunks"))
    schema = "conv_id long, turn long, seq long, type string, text string"
    return a.unionByName(b).groupBy("conv_id", "turn").transformWithState(Tail(since), schema, "append", "ProcessingTime")


ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class FieldScanner:
    """Reads one top-level string field out of a JSON object that arrives in pieces.

    Every character is looked at once. What it remembers between pieces is of fixed size, but
    for the name of the key that is being read.
    """

    def __init__(self, field: str, memory: tuple | None = None):
        self.field = field
        self.depth, self.inside, self.is_key, self.key, self.escape, self.high, self.capture, self.ended = memory or (0, False, False, "", "", 0, False, False)

    def memory(self) -> tuple:
        return self.depth, self.inside, self.is_key, self.key, self.escape, self.high, self.capture, self.ended

    def _character(self, c: str) -> str:
        """What a character of a string stands for; '' while an escape or a pair is incomplete."""
        if self.escape or c == "\\":
            self.escape += c
            if len(self.escape) == 1 or (self.escape[1] == "u" and len(self.escape) < 6):
                return ""
            body, self.escape = self.escape, ""
            if body[1] != "u":
                return self._paired(ESCAPES.get(body[1], body[1]))
            try:
                code = int(body[2:], 16)
            except ValueError:
                return self._paired("�")
            if 0xD800 <= code < 0xDC00:
                lost = "�" if self.high else ""
                self.high = code
                return lost
            if 0xDC00 <= code < 0xE000:
                high, self.high = self.high, 0
                return chr(0x10000 + (high - 0xD800) * 1024 + code - 0xDC00) if high else "�"
            return self._paired(chr(code))
        return self._paired(c)

    def _paired(self, c: str) -> str:
        lost, self.high = "�" if self.high else "", 0
        return lost + c

    def feed(self, piece: str) -> str:
        """The field's newly readable characters."""
        out = []
        for c in piece:
            if self.ended:
                break
            if self.inside:
                if c == '"' and not self.escape:
                    if self.capture:
                        out.append(self._paired(""))
                        self.ended = True
                    self.inside, self.high = False, 0
                else:
                    read = self._character(c)
                    if self.capture:
                        out.append(read)
                    elif self.is_key:
                        self.key += read
            elif c == '"':
                self.inside = True
                self.capture = self.depth == 1 and not self.is_key and self.key == self.field
                self.key = "" if self.is_key else self.key
            elif c in "{[":
                self.depth += 1
                self.is_key = c == "{" and self.depth == 1
            elif c in "}]":
                self.depth -= 1
            elif self.depth == 1 and c in ":,":
                self.is_key = c == ","
        return "".join(out)


class FieldReader(InOrder):
    """Applies a :class:`FieldScanner` to each key's deltas."""

    row_schema = "seq long, delta string, done boolean"

    def __init__(self, field: str, hold_back: int, keep_ms: int):
        self.field, self.hold_back, self.keep_ms = field, hold_back, keep_ms

    def open(self) -> None:
        schema = "depth int, inside boolean, is_key boolean, name string, escape string, high int, capture boolean, ended boolean, held string"
        self.memory = self.handle.getValueState("memory", schema, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.in_order(key, rows)

    def take(self, key, row):
        _, delta, done = row
        *memory, held = self.memory.get() if self.memory.exists() else (None, "")
        scanner = FieldScanner(self.field, tuple(memory) if memory != [None] else None)
        held += scanner.feed(delta or "")
        ready = held if done else held[: max(0, len(held) - self.hold_back)]
        if ready:
            yield Row(key=key[0], text=ready)
        self.memory.clear() if done else self.memory.update((*scanner.memory(), held[len(ready) :]))


def incremental_field(deltas: DataFrame, field: str, hold_back: int = HOLD_BACK, *, keep_ms: int = 3600 * 1000) -> DataFrame:
    """key, text: newly readable characters of one top-level JSON string field as its deltas arrive.

    ``deltas``: key string, seq long (gapless from 0), delta string, done boolean. The last
    ``hold_back`` characters wait for what follows until the stream is done. State is the
    scanner's place and what is held back, not the text; keys that stay unfinished are given
    up after ``keep_ms``. Half a surrogate pair and unreadable escapes become U+FFFD.
    """
    _stateful(deltas.sparkSession)
    return deltas.groupBy("key").transformWithState(FieldReader(field, hold_back, keep_ms), "key string, text string", "append", "ProcessingTime")
