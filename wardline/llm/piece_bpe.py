"""SentencePiece BPE by a table of each prefix's last token.

Encoding never merges anything. The last token of a text's encoding is unique for every prefix of it, so a table
with one token for each prefix holds all encodings at once. Position by position, an automaton over the pieces
gives the tokens that end there, longest first; the right one is that which is compatible with the token before
it, i.e. the pair encodes to itself. Ids are recovered from the end of the table backwards.

Compatibility needs no merging either. The tokens that stand at a border while merges run are the last parts of
the left token and the first parts of the right one, each from its own merge to the next. The pair is incompatible
if some such part on the left and some on the right, both there at one time, make a piece whose turn comes before
either goes on. Turns go by score, and by place from the left among equal ones.

A text is cut where two characters meet that no piece has side by side; no token crosses such a place. Distinct
strings between cuts are encoded once a slice, all of them together, a position at a time in vectors; the last few
long ones go on one by one. A string of any length takes time linear in it. A character outside the vocabulary is a string of its own and becomes its bytes.

Defined results: a null text is an empty one, which has the end id only and decodes to an empty text; repeated
rows give repeated results; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.common import tables

SLICE_CHARS = 4 << 20  # characters handled at once; a longer text makes a slice of its own
FEW = 64  # strings; fewer go on one by one
REMEMBERED = 1 << 20  # steps and pairs remembered for those
SPACE = "▁"  # what stands for a space (fixed value)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file (fixed values)
NEVER = np.iinfo(np.int64).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Tables of a model: pieces, turns of their merges, the automaton, and what decodes each id."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave texts as they are can be used")
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and plain pieces can be used")
        self.prefix = norm.add_dummy_prefix
        self.end = proto.trainer_spec.eos_id
        self.byte_id = np.zeros(256, np.int32)
        self.raw: list[bytes] = []  # what an id decodes to, the prefix not yet removed
        self.is_byte = np.zeros(len(proto.pieces), bool)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                b = int(p.piece[1:-1], 16)
                self.byte_id[b], self.is_byte[i] = i, True
                self.raw.append(bytes([b]))
            elif p.type == NORMAL:
                self.raw.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.raw.append(proto.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        turns = {s: k for k, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.turn = np.zeros(len(proto.pieces), np.int64)
        for i in normal.values():
            self.turn[i] = turns[proto.pieces[i].score] + 1
        self._characters(normal)
        self._parts(normal)
        self._automaton(normal)
        self.decimal = pa.array([f"{i} ".encode() for i in range(len(proto.pieces))], pa.large_binary())
        self.decoded = pa.array(self.raw, pa.large_binary())

    def _characters(self, normal: dict[str, int]) -> None:
        """Classes of characters (0: in no piece), and pairs that some piece has side by side."""
        known = sorted({c for p in normal for c in p})
        self.n_classes = len(known) + 1
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in known]] = np.arange(1, self.n_classes)
        self.inside = np.zeros(self.n_classes * self.n_classes, bool)
        for p in normal:
            c = self.class_of[[ord(x) for x in p]].astype(np.int64)
            self.inside[c[:-1] * self.n_classes + c[1:]] = True

    def _parts(self, normal: dict[str, int]) -> None:
        """The two parts of each piece's last merge, and the merge of each pair of ids.

        A character has no parts; nor is a piece used whose own string does not merge to it.
        """
        n = len(self.raw)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.single = np.zeros(n, bool)
        self.usable = np.zeros(n, bool)
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        for piece, i in normal.items():
            now = [normal.get(c, -1) for c in piece]
            self.single[i] = len(now) == 1
            last = (-1, -1)
            while len(now) > 1:
                found = [(self.turn[m], k, m) for k in range(len(now) - 1) if (m := pairs.get(now[k] * n + now[k + 1])) is not None]
                if not found:
                    break
                _, k, m = min(found)
                last = now[k], now[k + 1]
                now[k : k + 2] = [m]
            self.usable[i] = now == [i]
            self.left[i], self.right[i] = last
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_made = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        # a character is there from the start
        self.since = np.where(self.single, 0, self.turn)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that ids side by side make, or -1."""
        key = a * len(self.raw) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of ids encodes to itself."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            made = self.merged(x, y)
            when = np.maximum(np.where(made >= 0, self.turn[made], NEVER), np.maximum(self.since[x], self.since[y]))
            # a merge further left has the first turn among equals, one further right the last
            meet = (made >= 0) & (when < x_until) & (when <= y_until)
            ok[at[meet]] = False
            # step back to what stood there before the later of the two merges; the right one is later among equals
            x_back = (self.since[x] > self.since[y]) & ~self.single[x]
            y_back = ~x_back & ~self.single[y]
            x_back |= ~y_back & ~self.single[x]
            go = ~meet & (x_back | y_back)
            x_until, y_until = np.where(x_back, self.since[x], x_until), np.where(y_back, self.since[y], y_until)
            x, y = np.where(x_back, self.right[x], x), np.where(y_back, self.left[y], y)
            at, x, y, x_until, y_until = at[go], x[go], y[go], x_until[go], y_until[go]
        return ok

    def _automaton(self, normal: dict[str, int]) -> None:
        """States are prefixes of pieces. Edges are sorted keys; ``fall`` leads to the longest proper suffix.

        ``ends`` is the longest usable piece that ends in a state; ``shorter`` the next one that ends in a piece.
        """
        states = {"": 0}
        for piece, i in normal.items():
            if self.usable[i]:
                for k in range(1, len(piece) + 1):
                    states.setdefault(piece[:k], len(states))
        order = sorted(states, key=len)
        fall, ends = np.zeros(len(states), np.int64), np.full(len(states), -1, np.int64)
        self.shorter = np.full(len(self.raw), -1, np.int64)
        self.length = np.zeros(len(self.raw), np.int64)
        edges = {}
        for s in order[1:]:
            here = states[s]
            edges[states[s[:-1]] * self.n_classes + int(self.class_of[ord(s[-1])])] = here
            suffix = next(k for k in range(1, len(s) + 1) if s[k:] in states)
            fall[here] = states[s[suffix:]]
            i = normal.get(s, -1)
            if i >= 0 and self.usable[i]:
                ends[here], self.shorter[i], self.length[i] = i, ends[fall[here]], len(s)
            else:
                ends[here] = ends[fall[here]]
        keys = np.array(sorted(edges), np.int64)
        self.edge_keys, self.edge_to = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.fall, self.ends = fall, ends
        self.steps: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.n_pieces = len(self.raw)
        self.ends_list, self.shorter_list, self.length_list = ends.tolist(), self.shorter.tolist(), self.length.tolist()

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after characters of classes ``c``."""
        out = np.zeros(len(state), np.int64)
        at, state = np.arange(len(state)), state.copy()
        while len(at):
            key = state * self.n_classes + c[at]
            place = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[place] == key
            out[at[hit]] = self.edge_to[place[hit]]
            more = ~hit & (state > 0)
            at, state = at[more], self.fall[state[more]]
        return out

    def last_tokens(self, classes: np.ndarray, head: np.ndarray) -> np.ndarray:
        """For each prefix of each string, the last token of its encoding.

        String ``u`` has the characters classes[head[u]:head[u + 1]]; the table lies at the same places.
        """
        length = np.diff(head)
        order = np.argsort(-length, kind="stable")
        start, length = head[:-1][order], length[order]
        table = np.zeros(len(classes), np.int32)
        state = np.zeros(len(start), np.int64)
        for p in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -p, side="left"))  # strings longer than p come first
            if n < FEW:
                for u in range(n):
                    self._rest_of(classes, table, int(start[u]), p, int(length[u]), int(state[u]))
                break
            at = start[:n] + p
            state = self.follow(state[:n], classes[at])
            left, token = np.arange(n), self.ends[state]
            while len(left):
                before = p - self.length[token]
                ok = before < 0  # the token is the whole prefix
                inner = np.flatnonzero(~ok)
                ok[inner] = self.compatible(table[start[left[inner]] + before[inner]].astype(np.int64), token[inner])
                table[at[left[ok]]] = token[ok]
                left, token = left[~ok], self.shorter[token[~ok]]
        return table

    def _rest_of(self, classes: np.ndarray, table: np.ndarray, start: int, p: int, length: int, state: int) -> None:
        """The table of one string from place ``p`` on; steps and pairs met before are remembered."""
        tokens = table[start : start + p].tolist()
        if len(self.steps) + len(self.pairs) > REMEMBERED:
            self.steps.clear()
            self.pairs.clear()
        for c in classes[start + p : start + length].tolist():
            key = state * self.n_classes + c
            state = self.steps.get(key, -1)
            if state < 0:
                state = self.steps[key] = int(self.follow(np.array([key // self.n_classes]), np.array([c]))[0])
            token = self.ends_list[state]
            while (before := p - self.length_list[token]) >= 0:
                pair = tokens[before] * self.n_pieces + token
                ok = self.pairs.get(pair)
                if ok is None:
                    ok = self.pairs[pair] = bool(self.compatible(np.array([tokens[before]]), np.array([token]))[0])
                if ok:
                    break
                token = self.shorter_list[token]
            tokens.append(token)
            p += 1
        table[start : start + length] = tokens

    def token_ends(self, table: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Which places of the table are ends of tokens, found from the last character of each string backwards."""
        marks = np.zeros(len(table), bool)
        start, at = head[:-1], head[1:] - 1
        while len(at):
            marks[at] = True
            at = at - self.length[table[at]]
            more = at >= start
            start, at = start[more], at[more]
        return marks

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the end id after each, and where each text's ids begin."""
        lead = SPACE if self.prefix else ""
        normal = [lead + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(normal)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, normal), np.int64, len(normal))
        first = np.concatenate([[0], np.cumsum(size)])
        if not len(points):
            return np.full(len(texts), self.end, np.int32), np.arange(len(texts) + 1)
        classes = self.class_of[points].astype(np.int64)
        begins = np.ones(len(points), bool)
        begins[1:] = ~self.inside[classes[:-1] * self.n_classes + classes[1:]]
        begins[first[:-1][size > 0]] = True
        begin = np.flatnonzero(begins)
        # strings between cuts, as bytes of their code points, each distinct one once
        off = np.append(begin, len(points)) * 4
        data = pa.py_buffer(points)
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(off), data])
        coded = strings.dictionary_encode()
        ids, bounds = self._distinct(coded.dictionary)
        used = coded.indices.to_numpy()
        # all strings' ids in order, and an end after each text
        count = np.diff(bounds)[used]
        total = np.concatenate([[0], np.cumsum(count)])
        row_ends = total[np.searchsorted(begin, first)]
        flat = ids[np.repeat(bounds[used] - total[:-1], count) + np.arange(total[-1])]
        return np.insert(flat, row_ends[1:], self.end), row_ends + np.arange(len(row_ends))

    def _distinct(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = strings.buffers()
        head = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] // 4
        points = np.frombuffer(data, np.uint32)[head[0] : head[-1]]
        head = head - head[0]
        classes = self.class_of[points].astype(np.int64)
        other = classes[head[:-1]] == 0  # a character without a piece is alone in its string
        known = np.flatnonzero(~other)
        length = np.diff(head)[known]
        own = np.concatenate([[0], np.cumsum(length)])
        table = self.last_tokens(classes[np.repeat(head[:-1][known] - own[:-1], length) + np.arange(own[-1])], own)
        marks = self.token_ends(table, own)
        ids = table[marks]
        made = np.zeros(len(strings), np.int64)
        made[known] = np.add.reduceat(marks, own[:-1], dtype=np.int64) if len(known) else 0
        spare = [self.byte_id[list(chr(c).encode())] for c in points[head[:-1][other]].tolist()]
        made[other] = [len(s) for s in spare]
        bounds = np.concatenate([[0], np.cumsum(made)])
        out = np.zeros(bounds[-1], np.int32)
        from_table = np.repeat(~other, made)
        out[from_table] = ids
        if spare:
            out[~from_table] = np.concatenate(spare)
        return out, bounds

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, in UTF-8: run ``i`` is ids[first[i]:first[i + 1]]."""
        raw = self.decoded.take(pa.array(ids))
        _, offsets, data = raw.buffers()
        off = np.frombuffer(offsets, np.int64)[raw.offset :]
        view = memoryview(data) if data is not None else memoryview(b"")
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            text = bytes(view[off[lo] : off[hi]])
            if self.prefix and text.startswith(b" "):
                lead = next((i for i in ids[lo:hi].tolist() if self.raw[i]), None)
                text = text[1:] if lead is not None and not self.is_byte[lead] else text
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._mended(text)
            out.append(text)
        return out

    @staticmethod
    def _mended(text: bytes) -> bytes:
        """Each byte that is no part of a character becomes a replacement character."""
        good = []
        while text:
            try:
                good.append(text.decode())
                break
            except UnicodeDecodeError as e:
                good.append(text[: e.start].decode() + "�")
                text = text[e.start + 1 :]
        return "".join(good).encode()


def pieces_of(model: bytes) -> Pieces:
    """The tables of a model; a Python worker keeps those made last from task to task."""
    return tables(hashlib.sha256(model).digest(), lambda: Pieces(model))


def model_of(path: str | None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column with the place of the first, in runs of at most SLICE_CHARS or one text."""
    texts, lo, held = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and held + len(text) > SLICE_CHARS:
            yield lo, texts
            texts, lo, held = [], i, 0
        texts.append(text)
        held += len(text)
    if texts:
        yield lo, texts


def _mapped(docs: DataFrame, path: str | None, fields: str, row) -> DataFrame:
    """Rows of ``row(pieces, texts)`` beside doc_id; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value)
        for batch in batches:
            for lo, texts in _parts(batch.column(1)):
                columns = row(pieces, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *columns.values()], ["doc_id", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (with the end id) of each document."""

    def row(pieces: Pieces, texts: list[str]) -> dict:
        ids, first = pieces.encode(texts)
        return {"n_tokens": pa.array(np.diff(first)), "ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))}

    return _mapped(docs, path, "n_tokens long, ids array<int>", row)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row with ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value)
        for batch in batches:
            for value, key in zip(batch.column(1), range(batch.num_rows)):
                ids = np.array(value.as_py() or [], np.int32)
                text = pieces.decode(ids, np.array([0, len(ids)]))[0].decode()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(key, 1), pa.array([text], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""

    def row(pieces: Pieces, texts: list[str]) -> dict:
        ids, first = pieces.encode(texts)
        spelled = pieces.decimal.take(pa.array(ids))
        _, offsets, data = spelled.buffers()
        off = np.frombuffer(offsets, np.int64)[spelled.offset :]
        view = memoryview(data)
        digests = [hashlib.sha256(view[off[a] : off[b] - 1]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        decoded = [hashlib.sha256(t).hexdigest() for t in pieces.decode(ids, first)]
        return {"n_tokens": pa.array(np.diff(first)), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
