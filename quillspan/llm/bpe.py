"""Byte-pair encoding: tables, backtracking encoder, offset-table decoder, heap counter."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the Unicode property White_Space, which the vocabularies' patterns mean by \s.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The splitting patterns of the two public vocabularies.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

#: Entries that a worker's cache of split results holds before it is emptied.
CACHE_ENTRIES = 700_000
#: Longest piece, in characters, that a cache takes up.
CACHE_CHARS = 64


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


def splitter(specials) -> re.Pattern | None:
    """Pattern that cuts special strings out of a text (longest first), or None."""
    found = sorted(specials, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


class ByteBpe:
    """Exact byte-level BPE in linear time, from a vocabulary file in JSON form.

    One scan of an Aho-Corasick automaton gives the longest vocabulary entry at each place;
    encoding walks along these and backs off to shorter entries whenever two neighbours
    could not both survive the merges; that pair test is answered from a table that fills as
    pairs occur. Decoding copies byte ranges named by an offset table.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        raw: list[bytes] = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(to_byte[c] for c in token)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.special.items():
            raw[i] = text.encode()
        self.raw = raw
        ids = {raw[i].decode("latin-1"): i for i in vocab.values()}
        # Order of merging; single bytes come before all merges.
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[z], self.left[z], self.right[z] = rank, x, y
            self.merge[x, y] = z
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.ids = ids
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        lengths = np.fromiter(map(len, raw), np.int64, size)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.pattern, self.cut = regex.compile(BYTE_PATTERN), splitter(self.special)
        self.sizes, self.numerals = lengths.tolist(), [str(i) for i in range(size)]
        # Ids of split pieces, and of words with the blank before them: a word that is one
        # piece has the same ids as both.
        self.pieces: dict[str, bytes] = {}

    def _longest(self, text: str) -> list[int]:
        """Longest entry that begins at every place of ``text``, by one scan of the automaton."""
        found, lengths = [-1] * len(text), self.sizes
        # Matches come by ascending end, so the last one with a given start is the longest.
        for end, token in self.automaton.iter(text):
            found[end + 1 - lengths[token]] = token
        return found

    def _prefix(self, token: int) -> int:
        """Longest entry that is a proper prefix of ``token``; -1 for a single byte."""
        found = self.shorter.get(token)
        if found is None:
            raw = self.raw[token].decode("latin-1")
            found = next((self.ids[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ids), -1)
            self.shorter[token] = found
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the text of a followed by b leaves exactly these two tokens.

        Undo the merges of both sides latest first: a merge across the boundary that ranks
        before the merge just undone would have happened, so the pair can't stand.
        """
        key = a, b
        found = self.compatible.get(key)
        if found is None:
            rank, limit, found = self.rank, len(self.rank) + 1, True
            while True:
                made = self.merge.get((a, b))
                if made is not None and rank[made] < limit:
                    found = False
                    break
                ra, rb = rank[a], rank[b]
                if ra < 0 and rb < 0:
                    break
                # The later merge is undone first; at equal ranks the left one was made first.
                if ra > rb:
                    a, limit = self.right[a], ra
                else:
                    b, limit = self.left[b], rb + 1
            if len(self.compatible) >= CACHE_ENTRIES:
                self.compatible.clear()
            self.compatible[key] = found
        return found

    def encode_piece(self, raw: bytes) -> list[int]:
        """Token ids of one split piece."""
        text, n = raw.decode("latin-1"), len(raw)
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        longest, compatible, fits, lengths = self._longest(text), self.compatible.get, self._fits, self.sizes
        dead, out, at = set(), [], 0
        token = longest[0]
        while at < n:
            last = out[-1] if out else -1
            # Give up the token for its shorter prefixes until it fits behind the last one.
            while token >= 0:
                end = at + lengths[token]
                if end not in dead and (last < 0 or (fits(last, token) if (ok := compatible((last, token))) is None else ok)):
                    break
                token = self._prefix(token)
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:
                # Nothing fits here: this place is closed, and the last token is shortened.
                dead.add(at)
                last = out.pop()
                at -= lengths[last]
                token = self._prefix(last)
        return out

    def _split(self, text: str) -> list[bytes]:
        out, get = [], self.pieces.get
        for piece in self.pattern.findall(text):
            found = get(piece)
            if found is None:
                found = array("I", self.encode_piece(piece.encode())).tobytes()
                if len(piece) <= CACHE_CHARS:
                    if len(self.pieces) >= CACHE_ENTRIES:
                        self.pieces.clear()
                    self.pieces[piece] = found
            out.append(found)
        return out

    def _chunk(self, chunk: str) -> bytes:
        found = b"".join(self._split(chunk))
        if len(chunk) <= CACHE_CHARS and "\n" not in chunk:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as packed 32-bit numbers."""
        parts: list[bytes] = []
        for section in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
            if section in self.special:
                parts.append(array("I", [self.special[section]]).tobytes())
            elif "  " in section or section[-1:] == " ":
                parts += self._split(section)
            elif section:
                # A single blank always belongs to the word behind it, so blanks cut freely.
                words, get, add = section.split(" "), self.pieces.get, self._chunk
                if words[0]:
                    parts.append(get(words[0]) or add(words[0]))
                parts += [get(w) or add(w) for w in [" " + w for w in words[1:]]]
        return b"".join(parts)

    def decimals(self, packed: bytes) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(map(self.numerals.__getitem__, array("I", packed)))

    def decode(self, packed: bytes) -> bytes:
        """Bytes of a token sequence, copied by the offset table."""
        ids = np.frombuffer(packed, np.uint32)
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            at = np.repeat(self.offsets[part] - (ends - lengths), lengths) + np.arange(ends[-1])
            out.append(self.pool[at].tobytes())
        return b"".join(out)


class WordBpeCounter(dict):
    """Token counts by word-end BPE, merged with a heap over a linked list of symbols.

    A dict from white-space-free chunks to counts, filled on demand; ids are never built.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rank = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[a, b] = i
        self.end = spec["model"]["end_of_word_suffix"]
        self.known = set(spec["model"]["vocab"])
        self.symbols = byte_symbols()
        self.special = {a["content"] for a in spec["added_tokens"]}
        self.cut, self.pattern = splitter(self.special), regex.compile(WORD_PATTERN)
        self.words: dict[str, int] = {}
        self.controls, self.blanks = re.compile("[\x1c-\x1f]"), re.compile(f"[{SPACE}]+")

    def merged(self, word: str) -> int:
        """Number of tokens of one word: its symbols less the merges made."""
        syms = [self.symbols[b] for b in word.encode()]
        if not syms:
            return 0
        syms[-1] += self.end
        n = len(syms)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := rank.get((syms[i], syms[i + 1]))) is not None]
        heapq.heapify(heap)
        merges, gone = 0, [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if not gone[i] else n
            if j >= n or syms[i] != a or syms[j] != b:
                continue  # one of the two has been merged meanwhile
            syms[i], gone[j] = a + b, True
            k = nxt[i] = nxt[j]
            merges += 1
            if k < n:
                prv[k] = i
                if (r := rank.get((syms[i], syms[k]))) is not None:
                    heapq.heappush(heap, (r, i, syms[i], syms[k]))
            if (p := prv[i]) >= 0 and (r := rank.get((syms[p], syms[i]))) is not None:
                heapq.heappush(heap, (r, p, syms[p], syms[i]))
        # A symbol that the vocabulary lacks has no token.
        left = n - merges
        at = 0
        while at < n:
            left -= syms[at] not in self.known
            at = nxt[at]
        return left

    def __missing__(self, chunk: str) -> int:
        total = 0
        for section in self.cut.split(chunk) if self.cut and "<|" in chunk else [chunk]:
            if section in self.special:
                total += 1
                continue
            # Lower-casing letter by letter: no special form for a final sigma.
            text = unicodedata.normalize("NFC", section).replace("Σ", "σ").lower()
            for word in self.pattern.findall(text):
                n = self.words.get(word)
                if n is None:
                    if len(self.words) >= CACHE_ENTRIES:
                        self.words.clear()
                    n = self.merged(word)
                    if len(word) <= CACHE_CHARS:
                        self.words[word] = n
                total += n
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = total
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; no token spans white space."""
        if self.controls.search(text):  # str.split would cut at these, too
            return sum(map(self.__getitem__, self.blanks.split(text)))
        return sum(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def byte_bpe(name: str) -> ByteBpe:
    """The encoder of this worker."""
    return ByteBpe(vocabulary_path(name))


@lru_cache(maxsize=2)
def word_counter(name: str) -> WordBpeCounter:
    """The counter of this worker."""
    return WordBpeCounter(vocabulary_path(name))


def encode_texts(docs: DataFrame, *, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Append ``ids`` (array of int), ``n_tokens`` and ``decoded`` to the rows.

    Runs batch by batch inside the tasks, without a shuffle. Null and empty texts give no
    tokens and an empty decoded text; a text of any length is encoded whole, in time linear in
    it; repeated rows are encoded each for itself; an empty table gives an empty result.
    Existing columns of the new names, in whatever case, are replaced.
    """
    return _encode(docs, text_col, vocabulary, digests=False)


def encode_digests(docs: DataFrame, *, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """As :func:`encode_texts`, in every case too, with SHA-256 of ids and decoded text in
    place of them and without the text column."""
    return _encode(docs, text_col, vocabulary, digests=True)


def _encode(docs: DataFrame, text_col: str, vocabulary: str, digests: bool) -> DataFrame:
    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    names = [c.split(" ")[0] for c in new.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in names and c != text_col]
    extra = [] if digests else [text_col]
    rows = docs.select(*kept, text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept + extra] + [new])

    def run(batches):
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column(batch.schema.get_field_index(text_col)):
                packed = bpe.encode(value.as_py() or "")
                decoded = bpe.decode(packed)
                counts.append(len(packed) // 4)
                first.append(hashlib.sha256(bpe.decimals(packed).encode()).hexdigest() if digests else np.frombuffer(packed, np.int32))
                second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept + extra]
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=[*kept, *extra, *names])

    return rows.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, *, text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Append ``n_bytes`` and ``n_tokens`` to the rows' other columns (the text is dropped).

    Null and empty texts count zero; a text of any length is counted whole; repeated rows
    are counted each for itself; an empty table gives an empty result. Existing columns of
    the new names, in whatever case, are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens") and c != text_col]
    rows = docs.select(*kept, text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept] + ["n_bytes long, n_tokens long"])

    def run(batches):
        counter = word_counter(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(batch.schema.get_field_index(text_col)):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(counter.count(text))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema)


def op6_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs)


def op8_token_counts(spark, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Token count of every document and whether it exceeds the limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > limit)
