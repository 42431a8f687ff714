import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillspan.llm import conversations as C
from quillspan.llm import queries

BLANKS = " \t\n\x0b\x0c\r"
RIGHT = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit, repaired) of rows (role, text, fault), by trying every sequence of edits."""
    best = None
    insert = [()] + [p for n in range(1, 4) for p in itertools.product(("user", "assistant"), repeat=n)]

    def step(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for extra in insert:
            c, a, o = cost + 3 * len(extra), audit + "I" * len(extra), out + [(r, "") for r in extra]
            if best is not None and c > best[0]:
                continue
            if i == len(rows):
                if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text, fault = rows[i]
            step(i + 1, c + 4, a + "D", o)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                step(i + 1, c + more, a + "K", o + [(role, text)])
                for new in ("user", "assistant"):
                    step(i + 1, c + more + 3, a + "R", o + [(new, text)])

    step(0, 0, "", [])
    return best


def shortest(rows):
    """The same by dynamic programming from the end, over what has been said: for longer conversations."""
    expects = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}
    names, end = {"u": "user", "a": "assistant"}, len(rows)
    best = {}
    for i in range(end, -1, -1):
        for _ in range(3):  # insertions lead around at most two states
            for said in expects:
                found = [best[i, said]] if (i, said) in best else []
                if i == end and said in ("", "a"):
                    found.append((0, "", []))
                for nxt in expects[said]:
                    if nxt != "s" and (i, nxt) in best:
                        c, a, o = best[i, nxt]
                        found.append((c + 3, "I" + a, [(names[nxt], ""), *o]))
                if i < end:
                    role, text, fault = rows[i]
                    c, a, o = best[i + 1, said] if (i + 1, said) in best else (1 << 40, "", [])
                    found.append((c + 4, "D" + a, o))
                    if fault not in ("blank", "duplicate"):
                        more = 3 if fault == "truncated" else 0
                        for nxt in expects[said]:
                            if (i + 1, nxt) in best:
                                c, a, o = best[i + 1, nxt]
                                if role[:1] == nxt:
                                    found.append((c + more, "K" + a, [(role, text), *o]))
                                if nxt != "s":
                                    found.append((c + more + 3, "R" + a, [(names[nxt], text), *o]))
                if found:
                    best[i, said] = min(found, key=lambda f: f[:2])
    return best[0, ""]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def figures(turned, solve=shortest):
    """The contract's columns of one conversation's (turn, role, text) rows in order."""
    kinds = faults([(r, x) for _, r, x in turned])
    known = [t for t, *_ in turned if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in turned]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = solve([(r, x, k) for (_, r, x), k in zip(turned, kinds)])
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda v: " " if v is None else str(v)
        way = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def expected(rows, solve=shortest):
    damaged, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in damaged if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        out.append((conv, *(figures(mine, solve) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))))
    return sorted(out, key=repr)


def test_the_two_brute_forces_agree():
    rnd = random.Random(2)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), "x", rnd.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rnd.randint(0, 3))]
        assert cheapest(rows) == shortest(rows)


@pytest.mark.parametrize("cut", [1, 2, 5, 300])
def test_chart_equals_brute_force(cut):
    rnd = random.Random(cut)
    for k in range(250):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), "x", rnd.choice(["", "", "truncated", "blank"])) for _ in range(rnd.randint(0, 12 if k else 90))]
        initials = "".join(r[0] if r[0] in "sua" else "o" for r, *_ in rows)
        marks = "".join({"": ".", "truncated": "t", "blank": "x"}[f] for *_, f in rows)
        segments = [{s: C.parse(initials[i : i + cut], marks[i : i + cut], s) for s in C.STATES} for i in range(0, len(rows), cut)]
        segments = segments or [{s: C.parse("", "", s) for s in C.STATES}]
        assert C.joined(segments) == shortest(rows)[:2]


def conversations(seed=3):
    rnd = random.Random(seed)
    rows = []
    for conv in range(80):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = "system" if turn == 0 and rnd.random() < 0.3 else rnd.choice([None, "", "tool"]) if rnd.random() < 0.04 else role
            text = rnd.choice(["a.", "b? ", "same!", f"t{turn} é.\n", f"cut {turn}", None, " \t", "no  "])
            if rnd.random() < 0.9:
                rows.append((conv, turn, role, text))
    rows += [(None, None, "user", "x."), (None, 2, "assistant", "y."), (None, 9, "user", "z."), (500, None, None, None)]
    rows += [(600, t, ("user", "assistant")[t % 2], rnd.choice(["q.", f"r{t}.", f"s{t}"])) for t in range(700)]
    return rows


@pytest.mark.parametrize("segment", [3, 256])
def test_query_equals_brute_force(spark, tmp_path, segment, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = conversations()
    spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_repair_conversations"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_supplied_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_repair_conversations"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_repaired_turns_and_empty_table(spark):
    schema = "c string, n int, who string, said string, seq string"
    rows = [("a", 1, "system", "be nice.", "-"), ("a", 2, "assistant", "hello.", "-"), ("a", 3, "assistant", "hello.", "-"), ("a", 4, "user", "x" * 300_000, "-"), ("b", 1, "tool", " ", "-")]
    names = {"conv_col": "c", "turn_col": "n", "role_col": "who", "text_col": "said"}
    audits, repaired = C.repair(spark.createDataFrame(rows, schema), **names)
    assert {r.c: (r.cost, r.audit) for r in audits.collect()} == {"a": (11, "KIKDD"), "b": (4, "D")}
    assert [(r.seq, r.edit, r.role, r.text) for r in repaired.orderBy("seq").collect()] == [(0, "keep", "system", "be nice."), (1, "insert", "user", ""), (2, "keep", "assistant", "hello.")]
    audits, repaired = C.repair(spark.createDataFrame([], schema), **names)
    assert audits.count() == 0 and repaired.count() == 0 and C.digests(repaired).count() == 0


def test_equal_rows_of_one_conversation(spark):
    rows = [(7, 1, "user", "hi.")] * 3000 + [(7, 2, "assistant", "yes.")]
    audits, _ = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert tuple(audits.first()) == (7, 0, 0, 2999, 0, 2999, 4 * 2999, "D" * 0 + "K" + "D" * 2999 + "K")
