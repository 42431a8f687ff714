"""Benchmark passages in documents, by random-walk embedding and bit-sampling LSH."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = "\"'()[]{}<>,;:.!?*#$%&-_/\\|«»„“”’‘…¿¡"
#: Words of documents that are processed as one array.
BLOCK_WORDS = 1 << 18
CACHE_ENTRIES = 300_000
#: Buckets of the random walk's coin table.
COINS = 1024
#: Longest item of a size class over the shortest.
CLASS_RATIO = 1.15
#: Least words of a piece of an item of more than twice as many.
PIECE_WORDS = 16
DOC_END, ITEM_END = 1, 2


class Vocabulary(dict):
    """White-space token -> number of its word in the items, or 0; filled as tokens occur."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        found = self.words.get(token)
        if found is None:
            found = self.words.get(token.lower().strip(STRIP) or token, 0)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = found
        return found


def normal_words(text: str) -> list[str]:
    """Lower-case words without surrounding punctuation; a token of punctuation stays itself."""
    return [w.lower().strip(STRIP) or w for w in text.split()]


def piece_bounds(n: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces that an item of ``n`` words is looked up by.

    Items under 2 * PIECE_WORDS words are one piece; longer ones are cut evenly. If a passage
    has at most a share of the item's words edited, so has one of its pieces.
    """
    k = max(1, n // PIECE_WORDS)
    cuts = [i * n // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


class ItemIndex:
    """LSH tables of a block of benchmark items.

    The word sequence of each piece of an item is embedded by a random walk: at step j the
    current word is emitted and a coin, fixed for (step, word), decides whether to advance;
    edits of the sequence turn into few differing places. Per repeat and size class a key is
    made of ``samples`` places within the steps that a piece of that size needs. Items of
    fewer than ``min_words`` words are matched exactly, by an automaton over normal text.
    """

    def __init__(self, items: list[tuple[int, str]], share: float, repeats: int, samples: int, min_words: int, seed: int = 5):
        split = [(i, normal_words(t)) for i, t in items if t is not None]
        self.short: dict[str, list] = {}
        for i, w in split:
            if w and len(w) < min_words:
                self.short.setdefault(" ".join(w), []).append((i, len(w)))
        self.automaton = ahocorasick.Automaton()
        for text in self.short:
            self.automaton.add_word(text, text)
        if self.short:
            self.automaton.make_automaton()
        split = [(i, w) for i, w in split if len(w) >= min_words]
        words: dict[str, int] = {}
        self.ids = [i for i, _ in split]
        self.items = [np.array([words.setdefault(x, len(words) + 3) for x in w], np.int32) for _, w in split]
        self.words = words
        self.edits = [int(share * len(w)) for w in self.items]
        self.pieces = [(i, a, self.items[i][a:b]) for i in range(len(split)) for a, b in piece_bounds(len(self.items[i]))]
        rng = np.random.default_rng(seed)
        order = sorted(range(len(self.pieces)), key=lambda p: len(self.pieces[p][2]))
        self.classes: list[dict] = []
        for p in order:
            n = len(self.pieces[p][2])
            if not self.classes or n > CLASS_RATIO * self.classes[-1]["shortest"]:
                self.classes.append({"shortest": n, "members": []})
            self.classes[-1]["members"].append(p)
        self.steps = max([int(1.5 * c["shortest"]) for c in self.classes], default=0)
        self.walks = []
        for _ in range(repeats):
            coins = rng.integers(0, 2, (self.steps, COINS)).astype(np.intp)
            mults = rng.integers(1, 1 << 62, samples, dtype=np.uint64) | np.uint64(1)
            places = [np.sort(rng.choice(int(1.5 * c["shortest"]), samples, replace=False)) for c in self.classes]
            tables = []
            for c, at in zip(self.classes, places, strict=True):
                table: dict[int, list[int]] = {}
                for p in c["members"]:
                    table.setdefault(int(self._key(coins, mults, at, self.pieces[p][2])), []).append(p)
                tables.append((table, np.fromiter(table, np.uint64, len(table))))
            self.walks.append((coins, mults, places, tables))
        for c in self.classes:
            c["edits"] = max(int(share * len(self.pieces[p][2])) for p in c["members"])

    def _key(self, coins, mults, at, seq) -> np.uint64:
        padded = np.concatenate([seq, np.full(self.steps + 1, ITEM_END, np.int32)])
        out = self._emit(coins, padded, np.zeros(1, np.int64), set(at.tolist()))
        with np.errstate(over="ignore"):
            return sum((out[j][0].astype(np.uint64) * m for j, m in zip(at.tolist(), mults, strict=True)), np.uint64(0))

    def _emit(self, coins, seq, starts, wanted: set[int], active: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """Words emitted at the wanted steps of the walks from every start.

        ``active``: how many of the starts, from the first, still matter at each step.
        """
        at, out, low = starts.astype(np.intp), {}, (seq & (COINS - 1)).astype(np.intp)
        for j in range(max(wanted, default=-1) + 1):
            if active is not None:
                at = at[: active[j]]
            if j in wanted:
                out[j] = seq.take(at, mode="clip")
            at = at + coins[j].take(low.take(at, mode="clip"), mode="clip")
        return out

    def candidates(self, seq: np.ndarray) -> set[tuple[int, int]]:
        """(start, piece) of windows whose key meets a piece's in some repeat.

        A window is passed over only where too few of its words occur in any item for it to
        be within the allowed edits.
        """
        known = np.concatenate([[0], np.cumsum(seq > ITEM_END)])
        n = len(seq) - self.steps - 1
        masks = []
        for c in self.classes:
            w = c["shortest"] - c["edits"]
            masks.append((known[w : w + n] - known[:n] >= w - c["edits"]) & (seq[:n] != DOC_END))
        starts = np.flatnonzero(np.logical_or.reduce(masks))
        if not len(starts):
            return set()
        # Walks that only short items need end early; the longest come first.
        need = np.zeros(len(starts), np.int64)
        for c, m in zip(self.classes, masks, strict=True):
            need[m[starts]] = int(1.5 * c["shortest"])  # classes ascend
        order = np.argsort(-need, kind="stable")
        starts, need = starts[order], need[order]
        active = len(need) - np.searchsorted(need[::-1], np.arange(self.steps), "right")
        inside = [np.flatnonzero(m[starts]) for m in masks]
        found: set[tuple[int, int]] = set()
        for coins, mults, places, tables in self.walks:
            wanted = {int(j) for at, s in zip(places, inside, strict=True) if len(s) for j in at}
            out = self._emit(coins, seq, starts, wanted, active)
            for at, (table, held), s in zip(places, tables, inside, strict=True):
                if not len(s):
                    continue
                with np.errstate(over="ignore"):
                    key = sum((out[int(j)][s].astype(np.uint64) * m for j, m in zip(at, mults, strict=True)), np.zeros(len(s), np.uint64))
                hit = np.flatnonzero(np.isin(key, held))
                for h in hit:
                    found.update((int(starts[s[h]]), i) for i in table[int(key[h])])
        return found

    def verify(self, seq: np.ndarray, low: int, high: int, start: int, piece: int) -> tuple[int, int, int] | None:
        """(edits, first word, end word) of the best match of a piece's whole item in seq[low:high].

        Of several stretches with equally few edits the one that ends first counts.
        """
        item, offset, _ = self.pieces[piece]
        q, k = self.items[item], self.edits[item]
        a, b = max(low, start - offset - k), min(high, start - offset + len(q) + k)
        text = seq[a:b]
        if len(set(q.tolist()) - set(text.tolist())) > k:
            return None
        ends = infix_distances(q, text)
        e = int(np.argmin(ends))
        if ends[e] > k:
            return None
        back = infix_distances(q[::-1], text[:e][::-1], anchored=True)
        return int(ends[e]), a + e - int(np.argmin(back)), a + e


@lru_cache(maxsize=2)
def item_index(items: tuple, share: float, repeats: int, samples: int, min_words: int) -> ItemIndex:
    """The index of a block of items, built once in each worker."""
    index = ItemIndex(list(items), share, repeats, samples, min_words)
    index.vocabulary = Vocabulary(index.words)
    return index


def infix_distances(q: np.ndarray, text: np.ndarray, anchored: bool = False) -> np.ndarray:
    """Edit distance of q to the best stretch of text that ends at each place.

    ``anchored``: the stretch starts at the beginning.
    """
    steps = np.arange(len(text) + 1)
    row = steps.copy() if anchored else np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(q, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != x))
        row = np.minimum.accumulate(new - steps) + steps
    return row


#: Scripts written without blanks: a match may begin and end inside a token of them.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def _short_matches(index: ItemIndex, text: str):
    """(item id, words, begin and end in characters) of the first exact match of each short item."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    joined = " ".join(normal_words(text))
    open_at = lambda i, c: not 0 <= i < len(joined) or joined[i] == " " or UNSPACED.match(c)
    seen = set()
    for last, found in index.automaton.iter(joined):
        first = last + 1 - len(found)
        if found not in seen and open_at(first - 1, found[0]) and open_at(last + 1, found[-1]):
            seen.add(found)
            a, b = joined.count(" ", 0, first), joined.count(" ", 0, last)
            for i, n in index.short[found]:
                yield i, n, spans[a][0], spans[b][1]


def _scan(index: ItemIndex, keys, texts):
    """Matches (key, item id, edits, item words, begin and end in characters) of one batch."""
    vocabulary = index.vocabulary
    if index.short:
        keys, texts = list(keys), list(texts)
        for key, text in zip(keys, texts, strict=True):
            for item, n, begin, end in _short_matches(index, text):
                yield key, item, 0, n, begin, end
    if not index.items:
        return
    rows = iter(zip(keys, texts, strict=True))
    gap = np.full(index.steps + 2, DOC_END, np.int32)
    while True:
        parts, owners, bounds, at = [], [], [], 0
        for key, text in rows:
            seq = np.fromiter(map(vocabulary.__getitem__, text.split()), np.int32)
            parts += [seq, gap]
            owners.append((key, text))
            bounds.append((at, at + len(seq)))
            at += len(seq) + len(gap)
            if at >= BLOCK_WORDS:
                break
        if not owners:
            return
        seq = np.concatenate(parts)
        begins = np.array([b for b, _ in bounds])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for start, piece in sorted(index.candidates(seq)):
            item, d = index.pieces[piece][0], int(np.searchsorted(begins, start, "right")) - 1
            old = best.get((d, item))
            if old and (old[0] == 0 or old[1] <= start < old[2]):
                continue
            hit = index.verify(seq, *bounds[d], start, piece)
            if hit and (old is None or hit < old):
                best[d, item] = hit
        for (d, item), (edits, a, b) in best.items():
            key, text = owners[d]
            spans = list(islice((m.span() for m in re.finditer(r"\S+", text)), a - bounds[d][0], b - bounds[d][0]))
            yield key, index.ids[item], edits, len(index.items[item]), spans[0][0] if spans else 0, spans[-1][1] if spans else 0


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    max_edit_share: float = 0.2, repeats: int = 10, samples: int = 3, min_words: int = 5, items_per_pass: int = 20_000, bytes_per_pass: int = 8 << 20,
) -> DataFrame:
    """``id_col``, ``item_col``, edits, item_words, begin_char, end_char: a row for each document
    and item of which the document holds a passage within ``max_edit_share`` word edits.

    Words are compared in lower case without surrounding punctuation. Documents are scanned
    where they lie, without a shuffle; items go to the tasks in passes of about
    ``items_per_pass`` items or ``bytes_per_pass`` bytes, each pass another scan of all
    documents, so that what is sent stays bounded however many items there are. Every window
    of a document that could match is embedded and looked up; candidates are verified by exact
    word edit distance, so matches are right, and recall is set by ``repeats`` and ``samples``
    (unedited passages are always found). Items of fewer than ``min_words`` words are matched
    exactly, as whole words, or anywhere in scripts that are written without blanks.

    One row a document and item: the first match of fewest edits. Null and empty texts hold
    nothing, null and blank items match nothing, texts of any length are scanned whole;
    repeated rows each report, as do items that repeat a text; null ids come back null;
    empty tables give an empty result; other columns are not read.
    """
    if id_col == item_col:
        raise ValueError("id_col and item_col name the same output column")
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    passes = max(1, -(-n // items_per_pass), -(-size // bytes_per_pass))
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits int, item_words int, begin_char int, end_char int"
    names = [id_col, item_col, "edits", "item_words", "begin_char", "end_char"]
    out = None
    for p in range(passes):
        block = listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p).collect()
        shared = spark.sparkContext.broadcast(tuple((r["i"], r["t"]) for r in sorted(block, key=lambda r: (str(r["i"]), r["t"]))))

        def run(batches, shared=shared):
            index = item_index(shared.value, max_edit_share, repeats, samples, min_words)
            if not index.items and not index.short:
                return
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))
                found = list(zip(*_scan(index, keys, texts), strict=True))
                if found:
                    cols = [pa.array(found[0], batch.column(0).type), pa.array(found[1])] + [pa.array(c, pa.int32()) for c in found[2:]]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
