"""Byte-level BPE with a minimal acyclic transducer of frequent words.

The words of the whole corpus are counted, the most frequent ones encoded once and compiled into an automaton
that shares prefixes and suffixes. Numbers on its edges add up to a word's row in a table of ids, so one walk
gives the ids. The automaton is a flat file that each task maps into memory; words outside it are merged
exactly, pair by pair in order of rank. The lexicon saves time and never changes a result.

Texts are cut and encoded a slice at a time: the slice's different words walk the automaton together, and those
outside it are merged together, in NumPy arrays.

Defined results: a null or empty text has no ids and decodes to an empty text; the vocabulary's added tokens
are matched in texts as whole tokens, as the tokenizers library does by default; texts and words of any length
take time n log n in the longest word; repeated rows give repeated results; other columns are dropped unless
kept by name; an empty table gives no rows and an empty lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import small_batches, tables

LEXICON_WORDS = 1 << 17  # most frequent words that are compiled
AT_ONCE = 1 << 21  # characters cut and encoded together
MEMO = 200_000  # distinct pieces after a space, and as many others, ``Codec.encode`` remembers at once
SHORT = 32  # bytes of words whose pairs are simply searched for each merge
NEW, NEVER = (1 << 24) - 1, 1 << 50  # a merge is its rank and, in the low bits, the id it makes
COUNTED = 1_000_000  # distinct words of slices a task counts before it hands them on
LEAST = 4  # counts below this within one such hand-over can't make a word frequent

#: how the vocabulary cuts text into words (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# a space next to other white space or at the end: then cutting at spaces would differ from the pattern
_ODD = re.compile(r" (?:\s|\Z)|\s |[\x1c-\x1f]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")  # a text cut here has the same words


def kinds_of_points() -> np.ndarray:
    """What the pattern takes each code point for: 1 letter, 2 number, 3 white space, 0 other."""
    points = "".join(map(chr, range(0x110000)))
    kinds = np.zeros(len(points), np.uint8)
    for kind, one in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(one, points):
            kinds[m.start() : m.end()] = kind
    return kinds


class Cut(NamedTuple):
    """Words of texts in order: word i is data[off[i]:off[i + 1]], text j has the words first[j] to first[j + 1]."""

    data: np.ndarray
    off: np.ndarray
    first: np.ndarray

    @property
    def words(self) -> pa.Array:
        buffers = [None, pa.py_buffer(self.off), pa.py_buffer(self.data)]
        return pa.Array.from_buffers(pa.large_binary(), len(self.off) - 1, buffers)


def cut(texts: list[str], kinds: np.ndarray) -> Cut:
    """The words of the texts as ``PATTERN`` finds them in each; ``kinds`` is that of all code points."""
    whole = "".join(texts)
    data = np.frombuffer(whole.encode(), np.uint8)
    point = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(point)
    rows = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=rows[1:])
    head = np.zeros(n + 4, bool)  # where a text begins, and beyond the last
    head[rows] = head[n:] = True
    kind = kinds[point]
    white = kind == 3
    begins = head[:n].copy()
    # a change of kind begins a word, but a space belongs to what follows
    begins[1:] |= (kind[1:] != kind[:-1]) & ((point[:-1] != 32) | head[1:n])
    # of white space before a word, the last character stands apart
    begins[1:-1] |= white[:-2] & white[1:-1] & ~white[2:] & ~head[2:n]
    quote = np.flatnonzero(begins & (point == 39))
    if len(quote):
        after = np.append(point, [0, 0, 0])
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        short &= ~head[quote + 1]
        long &= ~head[quote + 1] & ~head[quote + 2]
        begins[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        begins[ends[ends < n]] = True
    begin = np.flatnonzero(begins)
    at = begin if len(data) == n else np.flatnonzero((data & 0xC0) != 0x80)[begin]
    return Cut(data, np.append(at, len(data)), np.searchsorted(begin, rows))


def grouped(texts: Iterable[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Numbered texts in lists of about ``most`` characters; a longer text comes in parts that share no word."""
    held, size = [], 0
    for number, text in texts:
        lo = 0
        while lo < len(text):
            found = _CUT.search(text, lo + most) if len(text) - lo > most else None
            hi = found.start() if found else len(text)
            held.append((number, text[lo:hi]))
            size += hi - lo
            lo = hi
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then the same from start[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Lexicon:
    """A minimal acyclic automaton over bytes. ``find`` gives a word's row, or -1."""

    @staticmethod
    def compile(words: Iterable[bytes], ids: dict[bytes, list[int]]) -> bytes:
        """The flat form for distinct non-empty words; ``ids`` has the output of each."""
        words = sorted(words)
        # states on the path of the last word: [edges {byte: state}, final]; a finished state is shared by its form
        known: dict[tuple, int] = {}
        states: list[tuple[list[tuple[int, int]], bool]] = []

        def settle(state: list) -> int:
            form = (tuple(state[0].items()), state[1])
            if form not in known:
                known[form] = len(states)
                states.append((list(form[0]), form[1]))
            return known[form]

        path: list[list] = [[{}, False]]
        last = b""
        for w in words:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            for i in range(len(last), common, -1):
                done = path.pop()
                path[-1][0][last[i - 1]] = settle(done)
            for b in w[common:]:
                path[-1][0][b] = -1
                path.append([{}, False])
            path[-1][1] = True
            last = w
        for i in range(len(last), 0, -1):
            done = path.pop()
            path[-1][0][last[i - 1]] = settle(done)
        root = settle(path[0])
        # words below each state; targets come before the states that lead to them
        below: list[int] = []
        for edges, final in states:
            below.append(final + sum(below[t] for _, t in edges))
        first, labels, targets, adds, finals = [0], bytearray(), [], [], bytearray()
        for edges, final in states:
            n = int(final)
            for b, t in edges:
                labels.append(b)
                targets.append(t)
                adds.append(n)
                n += below[t]
            first.append(len(labels))
            finals.append(final)
        starts, flat = [0], []
        for w in words:
            flat += ids[w]
            starts.append(len(flat))
        numbers = [first, targets, adds, starts, flat]
        head = [root, len(words), len(labels), len(finals), *map(len, numbers)]
        return b"".join(
            [struct.pack("<9i", *head), *(struct.pack(f"<{len(x)}i", *x) for x in numbers), bytes(finals), bytes(labels)]
        )

    def __init__(self, flat: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing is left behind
            f.write(flat)
            f.flush()
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, self.words, n_labels, n_states, *sizes = struct.unpack_from("<9i", self.file)
        at, numbers = 36, []
        for n in sizes:
            numbers.append(memoryview(self.file)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.targets, self.adds, self.starts, self.flat = numbers
        self.final = memoryview(self.file)[at : at + n_states]
        self.labels = memoryview(self.file)[at + n_states :]
        self.met: list[dict[int, tuple[int, int]] | None] = [None] * n_states
        states = np.repeat(np.arange(n_states), np.diff(self.first))
        self.keys = np.append(states << 8 | np.asarray(self.labels), 1 << 62)  # ascending, as the edges stand

    def edges(self, state: int) -> dict[int, tuple[int, int]]:
        """Byte: target and number of a state's edges, read from the file when first met."""
        span = range(self.first[state], self.first[state + 1])
        found = self.met[state] = {self.labels[e]: (self.targets[e], self.adds[e]) for e in span}
        return found

    def find(self, word: bytes) -> int:
        state, row, met = self.root, 0, self.met
        for b in word:
            edge = (met[state] or self.edges(state)).get(b)
            if edge is None:
                return -1
            state = edge[0]
            row += edge[1]
        return row if self.final[state] else -1

    def find_all(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """``find`` for the words data[off[i]:off[i + 1]], all a byte further at each step."""
        targets, adds, length = np.asarray(self.targets), np.asarray(self.adds), np.diff(off)
        state, row = np.full(len(length), self.root), np.zeros(len(length), np.int64)
        at, step = np.arange(len(length)), 0
        while len(at := at[length[at] > step]):
            key = state[at] << 8 | data[off[at] + step]
            edge = np.searchsorted(self.keys, key)
            there = self.keys[edge] == key
            state[at[~there]], row[at[~there]] = 0, -1
            at, edge = at[there], edge[there]
            state[at] = targets[edge]
            row[at] += adds[edge]
            step += 1
        return np.where(np.asarray(self.final)[state] > 0, row, -1)

    def ids(self, row: int) -> list[int]:
        return self.flat[self.starts[row] : self.starts[row + 1]].tolist()


class Codec:
    """Encodes and decodes with one vocabulary file's content and a compiled lexicon."""

    def __init__(self, vocabulary: bytes, lexicon: bytes | None = None):
        spec = json.loads(vocabulary)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank + 1 << 24 | vocab[a + b]
        code = {c: i for i, c in enumerate(letters)}
        self.bytes_of = {str(i): bytes(code[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {str(i): t.encode() for t, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(PATTERN)
        self.kinds = kinds_of_points()
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.names = {i: str(i) for i in [*vocab.values(), *self.added.values()]}
        pairs = sorted((a << 24 | b, code) for (a, b), code in self.merges.items())
        self.pairs = np.array([*(p for p, _ in pairs), NEVER])
        self.codes = np.array([*(c for _, c in pairs), NEVER])
        tokens = [self.bytes_of.get(str(i), b"") for i in range(max(self.names) + 1)]
        self.token_len = np.array([len(t) for t in tokens])
        self.token_at, self.token_bytes = np.cumsum(self.token_len) - self.token_len, np.frombuffer(b"".join(tokens), np.uint8)
        self.first, self.later = Memo(self, ""), Memo(self, " ")

    def merge(self, word: bytes) -> list[int]:
        """Ids by joining the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        n, merges = len(ids), self.merges
        if n <= SHORT:
            codes = [merges.get(pair, NEVER) for pair in zip(ids, ids[1:])]
            while codes:
                best = min(codes)
                if best == NEVER:
                    break
                at = codes.index(best)
                ids[at : at + 2] = (best & NEW,)
                del codes[at]
                if at < len(codes):
                    codes[at] = merges.get((ids[at], ids[at + 1]), NEVER)
                if at:
                    codes[at - 1] = merges.get((ids[at - 1], ids[at]), NEVER)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            code, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != code:
                continue
            ids[i], ids[j] = code & NEW, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]

    def merge_all(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``merge`` for the words data[off[i]:off[i + 1]]: numbers of words, how many ids each has, and these ids.

        Words stand in columns, between rows without a token; at each step, every word joins its first pair of lowest
        rank. A place takes eight bits, so words may have 250 bytes.
        """
        length = np.diff(off)
        at, place = np.arange(len(length)), np.arange(length.max(initial=0) + 2)[:, None]
        inside = (place > 0) & (place <= length)
        ids = np.full(inside.shape, NEW)
        ids.T[inside.T] = np.array(self.byte_id)[data[off[0] : off[-1]]]
        order = self._codes(ids[:-1], ids[1:]) << 8 | place[:-1]  # between equal pairs, the first
        while len(at):
            first = order.min(0)
            ends = first >= NEVER << 8
            if ends.any():
                done = ids[:, ends].T
                yield at[ends], (done != NEW).sum(1), done[done != NEW]
                at, ids, order, first = at[~ends], ids[:, ~ends], order[:, ~ends], first[~ends]
            column, row = np.arange(len(at)), first & 255
            later = place[:-1] > row
            np.copyto(ids[:-1], ids[1:], where=later)
            np.copyto(order[:-1], order[1:] - 1, where=later[:-1])
            ids[row, column] = first >> 8 & NEW
            for here in (row - 1, row):
                order[here, column] = self._codes(ids[here, column], ids[here + 1, column]) << 8 | here

    def _codes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 24 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.codes[at], NEVER)

    def _slice_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a word is worked out once."""
        words = cut(texts, self.kinds)
        coded = words.words.dictionary_encode()
        _, off, data = coded.dictionary.buffers()
        n, number = len(coded.dictionary), coded.indices.to_numpy()
        off = np.frombuffer(off, np.int64)[: n + 1]
        data = np.frombuffer(data, np.uint8)
        start, count, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.diff(off)
        pool, held = [], 0
        found = self.lexicon.find_all(data, off) if self.lexicon else np.full(n, -1)
        if self.lexicon:
            starts, known = np.asarray(self.lexicon.starts), found >= 0
            start[known], count[known] = starts[found[known]], np.diff(starts)[found[known]]
            pool, held = [np.asarray(self.lexicon.flat)], len(self.lexicon.flat)
        left = np.flatnonzero(found < 0)
        groups = [left[(length[left] > lo) & (length[left] <= hi)] for lo, hi in ((0, 8), (8, 16), (16, SHORT))]
        for group in groups:
            ends = np.concatenate([[0], np.cumsum(length[group])])
            for some, counts, ids in self.merge_all(data[_spans(off[group], length[group])], ends):
                some = group[some]
                start[some], count[some] = held + np.cumsum(counts) - counts, counts
                pool.append(ids)
                held += len(ids)
        for i in left[length[left] > SHORT].tolist():
            ids = self.merge(data[off[i] : off[i + 1]].tobytes())
            start[i], count[i] = held, len(ids)
            pool.append(np.array(ids))
            held += len(ids)
        every = count[number]
        flat = np.concatenate(pool)[_spans(start[number], every)].astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(every)])[words.first].tolist()
        return [flat[lo:hi] for lo, hi in zip(bounds, bounds[1:])]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cuts = [self.special.split(t) if self.added else [t] for t in texts]
        parts = list(chain.from_iterable(cuts))
        ids = [[np.array([self.added[p]], np.int32)] if p in self.added else [] for p in parts]
        plain = ((i, p) for i, p in enumerate(parts) if p not in self.added)
        for held in grouped(plain, AT_ONCE):
            for (i, _), found in zip(held, self._slice_ids([p for _, p in held])):
                ids[i].append(found)
        rest = iter(ids)
        rows = (list(chain.from_iterable(islice(rest, len(c)))) for c in cuts)
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, np.int32)]) for x in rows]

    def word_ids(self, word: str) -> str:
        """Ids of one word in decimal, joined by commas."""
        raw = word.encode()
        row = self.lexicon.find(raw) if self.lexicon else -1
        return ",".join(map(self.names.__getitem__, self.merge(raw) if row < 0 else self.lexicon.ids(row)))

    def encode(self, text: str) -> str:
        """Ids of a single text in decimal, joined by commas; pieces met lately are remembered."""
        out = []
        for part in self.special.split(text) if self.added else (text,):
            if part in self.added:
                out.append(str(self.added[part]))
            elif part:
                out += self._plain(part)
        return ",".join(out)

    def _plain(self, text: str) -> list[str]:
        if _ODD.search(text):
            return list(map(self.first.__getitem__, self.pattern.findall(text)))
        head, *rest = text.split(" ")
        return ([self.first[head]] if head else []) + list(map(self.later.__getitem__, rest))

    def text_ids(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for lo in range(0, len(ids), AT_ONCE):
            some = ids[lo : lo + AT_ONCE]
            parts.append(self.token_bytes[_spans(self.token_at[some], self.token_len[some])].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


class Memo(dict):
    """Ids of pieces met lately, as text; a piece is a word or several with nothing between them.

    ``lead`` is the space, if any, that comes before the piece. Once half of ``MEMO`` pieces are in, they become the
    older half and the one before is forgotten, but for the pieces met again meanwhile.
    """

    def __init__(self, codec: Codec, lead: str):
        self.codec, self.lead, self.older = codec, lead, {}

    def __missing__(self, piece: str) -> str:
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        if (ids := self.older.pop(piece, None)) is not None:
            self[piece] = ids
            return ids
        words = self.codec.pattern.findall(self.lead + piece)
        if len(words) == 1:
            ids = self.codec.word_ids(words[0])
        else:
            # the first word is a piece with the same lead, the others are pieces without one
            ids = ",".join([self[words[0][len(self.lead) :]], *map(self.codec.first.__getitem__, words[1:])])
        if len(piece) < 100:
            self[piece] = ids
        return ids


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed() -> pa.RecordBatch:
        counts = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        counts = counts.filter(pc.greater_equal(counts["n_sum"], LEAST))
        words, n = counts["word"].cast(pa.string()).combine_chunks(), counts["n_sum"].combine_chunks()
        short = pc.less(pc.utf8_length(words), 100)
        return pa.RecordBatch.from_arrays([words.filter(short), n.filter(short)], ["word", "n"])

    kinds = tables(b"kinds", kinds_of_points)
    held: list[pa.Table] = []
    for batch in batches:
        for texts in grouped(enumerate(x or "" for x in batch.column(0).to_pylist()), AT_ONCE):
            counts = cut([text for _, text in texts], kinds).words.value_counts()
            held.append(pa.table([counts.field(0), counts.field(1)], ["word", "n"]))
            if sum(map(len, held)) > COUNTED:
                yield handed()
                held.clear()
    if held:
        yield handed()


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The ``most`` most frequent words (a top-k) of all texts, ties by the word."""
    counted = small_batches(docs).select("text").mapInArrow(_count_words, "word string, n long").where("word <> ''")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def lexicon_of(docs: DataFrame, vocabulary: bytes, most: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon; the driver holds ``most`` words."""
    codec = Codec(vocabulary)
    words = [r.word.encode() for r in frequent_words(docs, most).collect()]
    return Lexicon.compile(words, {w: codec.merge(w) for w in words})


def vocabulary_of(path: str | None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


def codec_of(vocabulary: bytes, lexicon: bytes | None) -> Codec:
    """The codec of these tables; a Python worker keeps the one made last from task to task."""
    name = hashlib.sha256(vocabulary + (lexicon or b"")).digest()
    return tables(name, lambda: Codec(vocabulary, lexicon))


def _with_codec(docs: DataFrame, path: str | None, fields: str, names: list[str], row) -> DataFrame:
    """Rows of ``row(codec, texts)`` beside doc_id. Vocabulary and lexicon are broadcast; both have a fixed bound."""
    vocabulary = vocabulary_of(path)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((vocabulary, lexicon_of(docs, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*shared.value)
        for batch in batches:
            columns = row(codec, [x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def _ids(codec: Codec, texts: list[str]) -> list[pa.Array]:
    ids = codec.encode_all(texts)
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return _with_codec(docs, path, "n_tokens long, ids array<int>", ["n_tokens", "ids"], _ids)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [codec.decode(np.array(x or (), np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return small_batches(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _digests(codec: Codec, texts: list[str]) -> list[pa.Array]:
    ids = codec.encode_all(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha(codec.text_ids(x)) for x in ids]),
        pa.array([sha(codec.decode(x)) for x in ids]),
    ]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _with_codec(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", names, _digests)
