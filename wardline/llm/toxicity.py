"""Toxicity by a lexicon trie met with Levenshtein automata, and by the words around each hit.

Terms (whole words, and stems that begin words) are learned from a bounded sample of labelled texts by how
much more often they occur in toxic ones. All terms form one trie; reading a word's letters moves a set of
(trie node, edits so far), which is the product of the trie with every term's Levenshtein automaton, made
deterministic as it is used. Swapped neighbours are one edit; look-alike digits and drawn-out letters are free.
White space divides a text into tokens. A token is read as one word of any length, then, if that is no term, as
the words between its marks; in scripts without spaces runs of two and three characters are the words. A whole
word inside a longer run of letters is no hit, as it would be in many innocent words. Whole words of 40 letters
or more are not learned, their stems are.
A hit inside quotation marks or next to words of reporting counts less, one next to a form of address more.
The hits of a text give a logistic score.

Texts are independent once the model is there, so nothing is shuffled; the model has at most ``TERMS`` terms
and is broadcast. Memory of a task is bounded by one batch and two bounded tables.

Defined results: a null or empty text has no hits and gets the score of the intercept; texts of any length are
read whole; repeated rows give repeated results; a document with several labels is toxic if any says so; null
labels are left out; without labels, or without toxic ones, there are no terms and every score is the prior's;
other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import hashed_words, odd_numbers, slices, windows_of
from wardline.session import materialize

TRAIN_ROWS = 10_000  # labelled rows that the model is fitted on, by hash of the id
TERMS = 500
CANDIDATES = 20_000
STEMS = (4, 5, 6, 7)
LEAST, SHARE = 4, 0.01  # toxic texts with a term: at least so many, and at least this part of them
RATIO = 8.0  # of its rates in toxic and other texts
G2 = 15.0  # log-likelihood ratio of the two rates
SKETCH = 4  # MinHash values by which near copies in the sample are known
_SKETCHED = [f"sketch{k}" for k in range(SKETCH)]
WINDOW = 6  # words of context on either side
FUZZY_ODDS, FUZZY_NOISE = 1.0, 0.0005  # misspellings clearly above this share of other texts need these log odds
FUZZY_WORTH, FUZZY_ROWS = 2.0, 4  # log odds of misspellings before any is seen, and the texts that this is worth
COMMON = 0.0001  # a word in so many of the texts without a term is a word of its own and no misspelling
MEMO, STATES = 200_000, 20_000
THRESHOLD = 0.3
PRIOR = np.array([-3.0, 4.0, 3.5])  # intercept, exact hits, misspelled hits
FLOOR = -4.0  # of the intercept, so that two misspelled terms reach the threshold however clean most texts are
PULL = np.array([0.1, 0.5, 0.5])  # weight of the prior

#: where a token is cut, first at marks that stand for no letter, then at those too
_CUTS = (regex.compile(r"(?V1)[[\p{P}\p{S}\p{Z}\p{Cc}]--[@$!*]]+"), regex.compile(r"[@$!*]+"))
#: scripts written without spaces; their words are runs of so many characters
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{2,}")
GRAMS = (2, 3)
QUOTES = frozenset("\"“”„«»‘’")
REPORTING = frozenset("said says called quote quoted word term wrote sagte wort dit mot dijo palabra".split())
ADDRESS = frozenset("you your you're youre du dich ihr tu toi vous usted eres".split())
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}


def strip(token: str) -> str:
    if token.isalpha():
        return token
    lo, hi = 0, len(token)
    while lo < hi and not token[lo].isalnum():
        lo += 1
    while lo < hi and not token[hi - 1].isalnum():
        hi -= 1
    return token[lo:hi]


def grams(word: str) -> Iterator[str]:
    """Runs of two and three characters of scripts without spaces."""
    if not word.isascii():
        for run in _UNSPACED.findall(word):
            for k in GRAMS:
                for i in range(len(run) - k + 1):
                    yield run[i : i + k]


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Hit(NamedTuple):
    term: int
    edits: int


class Product:
    """Trie of terms and the deterministic product with their automata; ``hit`` reads one word.

    Terms numbered in ``exact`` are met without edits only. A stem is met by what begins a word, with the edits of
    its own length; of a stem and a longer term at as many edits the stem is the hit.
    """

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[int] = frozenset()):
        self.allowed = [0 if t in exact else edits_for(w) for t, (w, _) in enumerate(terms)]
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.most = [0]  # edits allowed below a node
        for t, (term, is_stem) in enumerate(terms):
            node, allowed = 0, self.allowed[t]
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed)
            (self.stem if is_stem else self.whole)[node] = t
        self._reset()

    def _reset(self) -> None:
        # a member is (node, edits, letter still due after a swap, last letter read along the trie)
        self.start = frozenset(self._skips({(0, 0, "", "")}))
        self.moves: dict[frozenset, dict[str, frozenset]] = {}

    def _skips(self, state: set) -> set:
        """Adds letters of terms that the word leaves out."""
        todo = list(state)
        while todo:
            node, e, due, last = todo.pop()
            if due:
                continue
            for c, child in self.next[node].items():
                member = (child, e + 1, "", c)
                if e < self.most[child] and member not in state:
                    state.add(member)
                    todo.append(member)
        return state

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        looks = LOOKS.get(c, "")
        for node, e, due, last in state:
            if due:
                if c == due:
                    out.add((node, e, "", c))
                continue
            if self._begun(node, e):
                out.add((node, e, "", ""))
                continue
            if c == last:
                out.add((node, e, "", last))  # drawn out
            if e < self.most[node]:
                out.add((node, e + 1, "", last))
            for d, child in self.next[node].items():
                if d == c or d in looks:
                    out.add((child, e, "", d))
                elif e < self.most[child]:
                    out.add((child, e + 1, "", d))
                    if (after := self.next[child].get(c)) is not None and e < self.most[after]:
                        out.add((after, e + 1, d, ""))
        # of members that differ in edits alone the cheapest says all
        best: dict[tuple, int] = {}
        for node, e, due, last in self._skips(out):
            if best.get((node, due, last), 9) > e:
                best[node, due, last] = e
        met = min(((e, self.stem[n], n) for (n, d, _), e in best.items() if not d and self._begun(n, e)), default=None)
        if met:  # whatever follows, this stem is met; only fewer edits are better
            return frozenset([(met[2], met[0], "", ""), *((n, e, d, x) for (n, d, x), e in best.items() if e < met[0])])
        return frozenset((n, e, d, x) for (n, d, x), e in best.items())

    def _begun(self, node: int, e: int) -> bool:
        return node in self.stem and e <= self.allowed[self.stem[node]]

    def hit(self, word: str) -> Hit | None:
        state = self.start
        for c in word:
            moves = self.moves.get(state)
            if moves is None:
                if len(self.moves) > STATES:
                    self._reset()
                moves = self.moves[state] = {}
            following = moves.get(c)
            if following is None:
                following = moves[c] = self._step(state, c)
            state = following
            if not state:
                return None
        found = [Hit(self.stem[n], e) for n, e, due, _ in state if not due and self._begun(n, e)]
        for n, e, due, _ in state:
            if not due and n in self.whole and e <= self.allowed[self.whole[n]]:
                found.append(Hit(self.whole[n], e))
        return min(found, key=lambda h: (h.edits, h.term)) if found else None


class Verdicts(dict):
    """Hits of tokens met lately; words of ``common`` are no misspellings."""

    def __init__(self, product: Product, common: frozenset[str] = frozenset()):
        self.product, self.common = product, common

    def __missing__(self, token: str) -> tuple[tuple[str, Hit], ...]:
        if len(self) >= MEMO:
            self.clear()
        found = tuple(self.read(token))
        if len(token) < 60:
            self[token] = found
        return found

    def read(self, token: str, cuts: tuple = _CUTS) -> list[tuple[str, Hit]]:
        """The token as one word, as marks inside may stand for letters; else the words between the marks."""
        word = strip(token)  # marks around it are punctuation
        whole = self.product.hit(word) if len(word) > 1 else None
        if whole and whole.edits and word in self.common:
            whole = None
        inner = []
        if not (whole and not whole.edits) and not (word.isascii() and word.isalpha()):
            inner = self._inside(word, cuts)
        if inner and (not whole or any(not h.edits for _, h in inner)):
            return inner
        return [(word, whole)] if whole else []

    def _inside(self, word: str, cuts: tuple) -> list[tuple[str, Hit]]:
        for k, cut in enumerate(cuts):
            parts = cut.split(word)
            if len(parts) > 1:
                return [x for p in parts if p for x in self.read(p, cuts[k + 1 :])]
        return [(g, h) for g in grams(word) if (h := self.product.hit(g)) and not h.edits]


def context(tokens: list[str], at: int) -> float:
    """How much a hit counts, by the words around it."""
    before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
    opened = any(t[0] in QUOTES for t in before)
    closed = any(t[-1] in QUOTES or t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
    near = {strip(t) for t in before + after}
    value = 0.3 if opened and closed else 1.0
    if near & REPORTING:
        value *= 0.6
    if near & ADDRESS:
        value = min(1.5, value * 1.3)
    return value


class Model(NamedTuple):
    terms: list[tuple[str, bool]]  # term, is it a stem
    exact: list[float]  # worth of a hit by term
    fuzzy: list[float]
    weights: np.ndarray
    common: frozenset[str] = frozenset()  # words of their own that resemble a term

    def product(self) -> Product:
        """Misspellings that speak for nothing are not looked for."""
        return Product(self.terms, frozenset(t for t, v in enumerate(self.fuzzy) if not v))

    def hits(self, verdicts: Verdicts, text: str) -> list[tuple[Hit, float]]:
        tokens = text.lower().split()
        found = {t: h for t in set(tokens) if (h := verdicts[t])}
        if not found:
            return []
        at = [(found[t], context(tokens, i)) for i, t in enumerate(tokens) if t in found]
        return [(h, c) for hits, c in at for _, h in hits]

    def features(self, hits: list[tuple[Hit, float]]) -> tuple[float, float]:
        exact = sum(self.exact[h.term] * c for h, c in hits if not h.edits)
        near: dict[int, float] = {}  # a word may resemble a term by chance and be repeated: each term counts once
        for h, c in hits:
            if h.edits:
                near[h.term] = max(near.get(h.term, 0.0), self.fuzzy[h.term] * c)
        return min(exact, 4.0), min(sum(near.values()), 4.0)

    def score(self, hits: list[tuple[Hit, float]]) -> float:
        z = float(self.weights @ np.array([1.0, *self.features(hits)]))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def words_of(token: str) -> Iterator[str]:
    """The token without the marks around it, and what ``Verdicts`` may find inside."""
    word = strip(token)
    yield word
    if not (word.isascii() and word.isalpha()):
        for p in _CUTS[0].split(word):
            yield strip(p)
            yield from map(strip, _CUTS[1].split(p))


def terms_of(text: str) -> set[tuple[str, bool]]:
    tokens = set(text.lower().split())
    words = {w for t in tokens for w in words_of(t) if len(w) >= 4}
    runs = {(g, False) for t in tokens for g in grams(t)}
    return runs | {(w, False) for w in words if len(w) < 40} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def _counted(wanted: set | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def handed() -> pa.RecordBatch:
            terms, stems = [t for t, _ in counts], [s for _, s in counts]
            out = [pa.array(terms, pa.string()), pa.array(stems, pa.bool_()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["term", "stem", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = terms_of(text.as_py() or "")
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > MEMO:
                    yield handed()
        yield handed()

    return run


def document_counts(texts: DataFrame, wanted: set | None = None) -> DataFrame:
    """In how many texts each term or stem occurs."""
    counted = texts.select("text").mapInArrow(_counted(wanted), "term string, stem boolean, n long")
    return counted.groupBy("term", "stem").agg(F.sum("n").alias("n"))


def choose_terms(toxic: dict, clean: dict, n_toxic: int, n_clean: int) -> list[tuple[str, bool, int]]:
    """Terms whose rates differ clearly, each with its toxic count; of terms that begin one another the clearest."""
    scored = []
    for term, a in toxic.items():
        b = clean.get(term, 0)
        p = (a + b) / (n_toxic + n_clean)
        g = sum(o * math.log(o / e) for o, e in ((a, p * n_toxic), (b, p * n_clean)) if o)
        # numbers of absence
        for o, n in ((n_toxic - a, n_toxic), (n_clean - b, n_clean)):
            if o > 0:
                g += o * math.log(o / (n * (1 - p)))
        if a >= max(LEAST, SHARE * n_toxic) and 2 * g >= G2 and a / n_toxic >= RATIO * b / n_clean:
            scored.append((-round(2 * g, 6), -len(term[0]), term, a))
    kept: list[tuple[str, bool, int]] = []
    for _, _, (term, stem), a in sorted(scored):
        if len(kept) < TERMS and not any(term.startswith(t) or t.startswith(term) for t, _, _ in kept):
            # a stem that is nearly always the same word is that word
            words = [(n, w) for (w, s), n in toxic.items() if not s and w.startswith(term)] if stem else []
            top = max(words, default=(0, ""))
            kept.append((top[1], False, a) if top[0] >= 0.9 * a else (term, stem, a))
    return kept


def log_odds(a: float, n_a: float, b: float, n_b: float) -> float:
    return math.log((a + 0.5) / (n_a + 1) * (n_b + 1) / (b + 0.5))


def _occurrences(model: Model):
    """Per text: label, and its hits as term, edits, context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Verdicts(model.product(), model.common)
        for batch in batches:
            label, term, edits, weight = [], [], [], []
            for text, toxic in zip(batch.column(0), batch.column(1)):
                hits = model.hits(verdicts, text.as_py() or "")[:64]
                label.append(toxic.as_py())
                term.append([h.term for h, _ in hits])
                edits.append([h.edits for h, _ in hits])
                weight.append([c for _, c in hits])
            lists = [pa.array(term, pa.list_(pa.int32())), pa.array(edits, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), *lists], ["toxic", "term", "edits", "weight"])

    return run


def common_words(docs: DataFrame, model: Model) -> frozenset[str]:
    """Words that resemble a term and are words of their own, counted over all documents.

    They are in at least ``LEAST`` texts without any term and in a share ``COMMON`` of them, and less than ``RATIO``
    times as frequent beside a term; the share bounds their number whatever the size of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts, counts = Verdicts(model.product()), (Counter(), Counter())

        def handed() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "without", "beside"])

        for batch in batches:
            for text in batch.column(0):
                found = [x for t in set((text.as_py() or "").lower().split()) for x in verdicts[t]]
                beside = any(not h.edits for _, h in found)
                counts[beside].update({"", *(w for w, h in found if h.edits)})  # "" counts the texts
                if len(counts[0]) + len(counts[1]) > MEMO:
                    yield handed()
        yield handed()

    counted = docs.select("text").mapInArrow(run, "word string, without long, beside long")
    counted = materialize(counted.groupBy("word").agg(F.sum("without").alias("without"), F.sum("beside").alias("beside")), "toxicity_words")
    whole = counted.where("word = ''").first()
    if not whole or not whole.without:
        return frozenset()
    often = F.col("without") >= max(LEAST, COMMON * whole.without)
    own = F.col("beside") * whole.without < RATIO * F.col("without") * whole.beside if whole.beside else F.lit(True)
    return frozenset(r.word for r in counted.where(F.col("word") != "").where(often & own).select("word").collect())


def fuzzy_log_odds(a: int, n_a: int, b: int, n_b: int) -> float:
    """Of a term's misspellings, in ``a`` of the toxic and ``b`` of the other texts of the sample.

    A few chance words do not count against a term: up to what ``FUZZY_NOISE`` allows, and three standard
    deviations, it keeps the worth of one not seen yet. Above, it must make up for them or is worth nothing.
    """
    share = n_a * math.exp(FUZZY_WORTH) / (n_a * math.exp(FUZZY_WORTH) + n_b)
    value = math.log((a + FUZZY_ROWS * share) / n_a * n_b / (b + FUZZY_ROWS * (1 - share)))
    usual = FUZZY_NOISE * n_b
    if b <= max(LEAST, usual + 3 * math.sqrt(usual)):
        return max(value, FUZZY_WORTH)
    return value if value >= FUZZY_ODDS else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a normal prior; hits never speak against toxicity."""
    x, w = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (y - p) - PULL * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(PULL), gradient)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return np.array([max(w[0], FLOOR), max(w[1], 0.0), max(w[2], 0.0)])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most ``TRAIN_ROWS`` labelled documents outside the held-out quarter."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return thinned(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = odd_numbers(31, SKETCH)
    for batch in batches:
        for t in slices(batch.column(0)):
            w = hashed_words(t)
            every = windows_of(w.hash, 5)
            mins = np.zeros((t.hi - t.lo, SKETCH), np.uint64)
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                own = every[a : b - 4] if b - a >= 5 else w.hash[a:b]
                if len(own):
                    mins[i] = (own[:, None] * factors).min(axis=0)
            part = batch.slice(t.lo, t.hi - t.lo)
            values = [pa.array(mins[:, k].astype(np.int64)) for k in range(SKETCH)]
            yield pa.RecordBatch.from_arrays([*part.columns, *values], ["text", "toxic", *_SKETCHED])


def thinned(rows: DataFrame) -> DataFrame:
    """One text of those that share a MinHash value of their five-word shingles: near copies are one observation."""
    fields = "text string, toxic int, " + ", ".join(f"{k} long" for k in _SKETCHED)
    rows = rows.mapInArrow(_sketched, fields)
    for k in _SKETCHED:
        whole = F.struct(F.xxhash64("text").alias("h"), "text", "toxic", *_SKETCHED)
        rows = rows.groupBy(k).agg(F.min(whole).alias("x")).select("x.text", "x.toxic", *(f"x.{c}" for c in _SKETCHED))
    return rows.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Terms, their worth, and the logistic weights; the driver holds candidates and the sample's hits only."""
    rows = materialize(training_rows(docs, labels), "toxicity_sample")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], [], [], PRIOR.copy())
    seen = document_counts(rows.where("toxic = 1")).where(F.col("n") >= LEAST)
    toxic = {(r.term, r.stem): r.n for r in seen.orderBy(F.desc("n"), "term", "stem").limit(CANDIDATES).collect()}
    clean = {(r.term, r.stem): r.n for r in document_counts(rows.where("toxic = 0"), set(toxic)).collect()}
    chosen = choose_terms(toxic, clean, n_toxic, n_clean)
    terms = [(t, s) for t, s, _ in chosen]
    flat = Model(terms, [1.0] * len(terms), [1.0] * len(terms), PRIOR)
    flat = flat._replace(common=common_words(docs, flat))
    hits = rows.mapInArrow(_occurrences(flat), "toxic int, term array<int>, edits array<int>, weight array<double>")
    hits = [(r.toxic, [(Hit(t, e), w) for t, e, w in zip(r.term, r.edits, r.weight)]) for r in hits.collect()]

    def worth(exact: bool) -> list[float]:
        a, b = Counter(), Counter()
        for toxic, found in hits:
            (a if toxic else b).update({h.term for h, _ in found if (h.edits == 0) == exact})
        odds = log_odds if exact else fuzzy_log_odds
        values = [odds(a[t], n_toxic, b[t], n_clean) for t in range(len(terms))]
        return [min(max(v, 0.0), 4.0) / 4 for v in values]

    model = Model(terms, worth(True), worth(False), PRIOR, flat.common)
    x = np.array([model.features(found) for _, found in hits])
    return model._replace(weights=fit_logistic(x, np.array([t for t, _ in hits], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_hits and n_misspelled of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Verdicts(model.product(), model.common)
        for batch in batches:
            hits = [model.hits(verdicts, x.as_py() or "") for x in batch.column(1)]
            columns = [
                pa.array([model.score(h) for h in hits], pa.float64()),
                pa.array([len(h) for h in hits], pa.int64()),
                pa.array([sum(x.edits > 0 for x, _ in h) for h in hits], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "n_hits", "n_misspelled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, score double, n_hits long, n_misspelled long"
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_hits",
        "n_misspelled",
    )
