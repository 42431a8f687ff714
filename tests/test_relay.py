import datetime
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.streaming import relay as Y

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
BEGIN = datetime.datetime(2026, 1, 1)


def put(spark, rows, schema, folder, n, seed=None):
    """Rows as ``n`` files, in the order given or shuffled."""
    rows = list(rows)
    if seed is not None:
        random.Random(seed).shuffle(rows)
    size = max(1, -(-len(rows) // n))
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, df, folder):
    """What a query has written once its input is used up; timers alone would keep it running."""
    spark.conf.set(NO_DATA, "false")
    q = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    ended = q.awaitTermination(60)
    q.stop()
    spark.conf.unset(NO_DATA)
    assert ended
    return spark.read.schema(df.schema).parquet(f"{folder}/out").collect()


PIECES = "conv_id long, turn long, seq long, at timestamp, kind string, text string"


def pieces(seed=1):
    rnd = random.Random(seed)
    out = []
    for conv in range(3):
        at = BEGIN
        for seq in range(40):
            at += datetime.timedelta(milliseconds=rnd.choice([5, 20, 300]))
            stage = rnd.random() < 0.15
            out.append((conv, 0, seq, at, rnd.choice(["plan", "search"]) if stage else "token", None if stage else rnd.choice(["", None, "pal ", "más largo ", "x" * 50])))
        out.append((conv, 0, 40, at, "end", None))
    return out


def folded(rows, chars=40, seconds=0.25):
    """The relay by definition, over one turn's pieces in order."""
    out, held, last = [], "", rows[0][3]
    for *_, at, kind, text in rows:
        if kind == "token":
            if not text:
                continue
            held += text
            if len(held) >= chars or (at - last).total_seconds() >= seconds:
                out.append(("token", held))
                held, last = "", at
        else:
            if held:
                out.append(("token", held))
                held, last = "", at
            out.append((kind, ""))
    return out


@pytest.mark.parametrize("seed", [None, 4])
def test_relay_equals_a_fold_by_the_pieces_clock(spark, tmp_path, seed):
    rows = pieces()
    stream = put(spark, rows + rows[5:20], PIECES, str(tmp_path / "in"), 4, seed)
    got = run(spark, Y.relay(stream, idle=False), str(tmp_path))
    for conv in range(3):
        mine = sorted((r.chunk_seq, r.kind, r.text) for r in got if r.conv_id == conv)
        want = folded([r for r in rows if r[0] == conv])
        assert mine == [(i, *w) for i, w in enumerate(want, 1)]


def test_idle_text_is_flushed_by_a_timer(spark, tmp_path):
    rows = [(1, 0, 0, BEGIN, "token", "a few words")]
    stream = put(spark, rows, PIECES, str(tmp_path / "in"), 1)
    q = Y.relay(stream, seconds=0.2).writeStream.format("memory").queryName("idle").start()
    until = time.time() + 60
    while time.time() < until and not spark.table("idle").count():
        time.sleep(0.3)
    q.stop()
    assert [(r.chunk_seq, r.kind, r.text) for r in spark.table("idle").collect()] == [(1, "token", "a few words")]


@pytest.mark.parametrize("seed", [1, 2])
def test_early_events_wait_for_their_run(spark, tmp_path, seed):
    events = [(run_id, seq, BEGIN, f"s{seq}") for run_id in range(6) for seq in range(1, 8)]
    runs = [(run_id, f"t{run_id % 2}") for run_id in range(5)]
    e = put(spark, events + events[::3], "run_id long, seq long, at timestamp, stage string", str(tmp_path / "e"), 4, seed)
    r = put(spark, runs, "run_id long, tenant_id string", str(tmp_path / "r"), 3, seed)
    got = run(spark, Y.attach_early(e, r), str(tmp_path))
    want = sorted((i, seq, f"t{i % 2}", "recorded") for i, seq, *_ in events if i < 5)
    assert sorted((x.run_id, x.seq, x.tenant_id, x.verdict) for x in got) == want


def test_events_of_a_run_that_never_comes_are_dropped(spark, tmp_path):
    e = put(spark, [(9, 2, BEGIN, "b"), (9, 1, BEGIN, "a"), (None, 1, BEGIN, "a")], "run_id long, seq long, at timestamp, stage string", str(tmp_path / "e"), 1)
    r = put(spark, [(1, "t")], "run_id long, tenant_id string", str(tmp_path / "r"), 1)
    q = Y.attach_early(e, r, patience_ms=200).writeStream.format("memory").queryName("never").start()
    until = time.time() + 60
    while time.time() < until and spark.table("never").count() < 2:
        time.sleep(0.3)
    q.stop()
    assert sorted((x.run_id, x.seq, x.verdict) for x in spark.table("never").collect()) == [(9, 1, "dropped"), (9, 2, "dropped")]


CHUNKS, SETTLED = "conv_id long, turn long, chunk_seq long, kind string, text string", "conv_id long, turn long, state string, chunks long"


def test_tail_goes_on_after_a_restart_without_repeats(spark, tmp_path):
    chunks = [(c, 0, s, "plan" if s % 4 == 0 else "token", f"w{s}") for c in range(3) for s in range(1, 11)]
    at, out = str(tmp_path / "c"), str(tmp_path / "t")
    head, rest = [x for x in chunks if x[2] in (1, 2, 3, 7)], [x for x in chunks if x[2] not in (1, 2, 3, 7)]
    s = put(spark, [(0, 0, "answered", 10), (1, 0, "failed", 10)], SETTLED, str(tmp_path / "s"), 1)
    first = run(spark, Y.tail_turns(put(spark, head, CHUNKS, at, 2, 1), s, since=2), out)
    assert sorted((r.conv_id, r.seq) for r in first) == [(c, 3) for c in range(3)]
    both = run(spark, Y.tail_turns(put(spark, rest + head, CHUNKS, at, 3, 2), s, since=2), out)
    for c in range(3):
        mine = [(r.seq, r.type, r.text) for r in sorted((r for r in both if r.conv_id == c), key=lambda r: (r.seq, r.type == "done"))]
        want = [(q, "stage" if q % 4 == 0 else "token", "plan" if q % 4 == 0 else f"w{q}") for q in range(3, 11)]
        assert mine == want + [(10, "done", {0: "answered", 1: "failed"}.get(c))] * (c < 2)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.integers(1, 9), st.booleans())
def test_scanner_reads_any_text(text, size, ascii_only):
    raw = json.dumps({"a": {"answer": "inner", "x": ["answer", {"answer": 1}]}, 'answer"': "no", "answer": text, "z": "answer"}, ensure_ascii=ascii_only, indent=1)
    memory, out = None, ""
    for i in range(0, len(raw), size):
        scanner = Y.FieldScanner("answer", memory)
        out += scanner.feed(raw[i : i + size])
        memory = scanner.memory()
    assert out == text


def test_fields_in_any_order_of_arrival(spark, tmp_path):
    text = 'línea "uno"\ny 😀 dos ' * 10
    raw = json.dumps({"other": "x", "answer": text})
    parts = [raw[i : i + 7] for i in range(0, len(raw), 7)]
    rows = [(k, i, p, i == len(parts) - 1) for k in ("k", "m") for i, p in enumerate(parts)] + [("open", 0, '{"answer": "' + "y" * 100, False), ("null", 0, None, True)]
    stream = put(spark, rows + rows[:9], "key string, seq long, delta string, done boolean", str(tmp_path / "d"), 4, 7)
    got = run(spark, Y.incremental_field(stream, "answer"), str(tmp_path))
    assert {k: sum(len(r.text) for r in got if r.key == k) for k in ("k", "m", "open", "null")} == {"k": len(text), "m": len(text), "open": 40, "null": 0}
