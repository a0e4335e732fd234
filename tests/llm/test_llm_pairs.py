"""Operators over pairs of texts, against brute force, and the pipeline."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import decontaminate as dec, jaccard, suffix_dedup as sd
from wardline.llm.common import table, words_of
from wardline.llm.components import components
from wardline.llm.suffix_sort import suffix_order
from wardline.session import materialize

SMALL = "/root/testdata/sf0.001"
KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def frame(spark, rows):
    """Rows written once, so that a rerun sees the same; with columns named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_h", "_text_hash", "_known", "_row", "_spans", "node"):
        df = df.withColumn(c, F.lit(1))
    return materialize(df.withColumn("n_chars", F.char_length("text")), "rows")


def test_masks_meet_every_run():
    """Whichever words of a run differ within the tolerance, a mask fits between them."""
    for lost in itertools.combinations(range(dec.WINDOW), dec.WINDOW - dec.AGREE):
        assert any(
            all(o + k not in lost for k in taken)
            for m, taken in zip(dec.MASKS, dec._TAKEN)
            for o in range(dec.WINDOW - len(m) + 1)
        )


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(3)
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    items += [(900, "one two three four five six seven eight nine")] * 2 + [(901, "alpha beta gamma delta"), (902, "a b"), (903, None), (None, "")]
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents", "doc_id", "text").collect()]
    for k in range(150):
        words = words_of(rnd.choice(items[:10])[1])
        n = rnd.randrange(5, 30)
        at = rnd.randrange(max(1, len(words) - n + 1))
        words = ["x%d" % rnd.randrange(9) if rnd.random() < 0.12 else w for w in words[at : at + n]]
        docs.append((10**6 + k, " ".join(["foo"] * rnd.randrange(4) + words + ["baz"] * rnd.randrange(4))))
    docs += [(1, "zz one two three FOUR x six seven eight nine yy"), (None, items[0][1]), (None, items[0][1]), (2, None), (2, "")]
    docs += [(3, "alpha beta, gamma delta"), (4, "alpha beta gamma epsilon a b")]
    return docs, items


def test_overlaps(spark, planted):
    docs, items = planted
    numbers: dict = {}
    ids = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int64)
    want = {}
    coded = [(i, ids(t)) for i, t in items]
    for d, text in docs:
        w = ids(text)
        for i, b in coded:
            size = min(dec.WINDOW, len(b))
            need = dec.AGREE if size == dec.WINDOW else size - (size >= 8)
            if size >= dec.SHORT and len(w) >= size and len(set(w) & set(b)) >= min(4, need):
                equal = w[:, None] == b[None]
                n, m = len(w) - size + 1, len(b) - size + 1
                best = int(sum(equal[z : n + z, z : m + z].astype(int) for z in range(size)).max())
                if best >= need:
                    want[d, i] = max(best, want.get((d, i), 0))
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.n_equal for r in dec.overlaps(df, bench).collect()} == want
    bad = {d for d, _ in want if d is not None}
    kept = dec.clean(df, bench)
    assert kept.columns == df.columns
    left = Counter(r.doc_id for r in kept.collect())
    assert not set(left) & (bad - {1, 2, 3, 4}) and left[None] == 0 and left[2] >= 2
    assert dec.clean(df, bench.limit(0)).count() == len(docs)
    assert dec.clean(df.limit(0), bench).collect() == []


def brute_classes(docs):
    sets = []
    for _, text in docs:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[s].append(i)
    nodes, holders, links = list(groups), defaultdict(list), Counter()
    for k, s in enumerate(nodes):
        for x in s:
            holders[x].append(k)
    root = list(range(len(nodes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(nodes):
        shared = Counter(o for x in s for o in holders[x] if o > k)
        for o, n in shared.items():
            if n >= 0.8 * (len(s) + len(nodes[o]) - n) - 1e-9:
                links[k] += len(groups[nodes[o]])
                links[o] += len(groups[s])
                root[top(k)] = top(o)
    least = {}
    for k, s in enumerate(nodes):
        known = [docs[i][0] for i in groups[s] if docs[i][0] is not None]
        least.setdefault(top(k), []).extend(known)
    return [
        (docs[i][0], min(least[top(k)], default=None), links[k] + len(groups[s]) - 1)
        for k, s in enumerate(nodes)
        for i in groups[s]
    ], len({top(k) for k in range(len(nodes))})


@pytest.fixture(scope="module")
def near(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(400)}" for _ in range(250)]
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents", "doc_id", "text").collect()]
    for k in range(250):
        words = list(base)
        for _ in range(rnd.randrange(8)):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(50)}"
        docs.append((10**6 + k, " ".join(words)))
    docs += [(2, None), (3, ""), (4, "one two"), (5, "One, two!"), (None, "a text of some words without id"), (6, "twice the same id here")]
    return docs + [(6, "twice the same id here"), (6, "but with another text too"), (7, "long " + " ".join(f"v{i}" for i in range(30_000)))]


@pytest.mark.parametrize("nodes, shingles", [(512, 250_000), (16, 3_000)])
def test_near_duplicates(spark, near, monkeypatch, nodes, shingles):
    """Links and classes equal brute force, with few and with many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", nodes)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    want, n_classes = brute_classes(near)
    df = frame(spark, near)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=KEY)
    assert got == sorted(want, key=KEY)
    if nodes == 512:
        kept = jaccard.keep_first(df)
        rows = kept.collect()
        assert kept.columns == df.columns and len(rows) == n_classes
        assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_pruning_bound():
    """Pairs at the threshold are dropped rarely: the chance of too few equal values at any step."""
    rnd = np.random.default_rng(1)
    equal = rnd.random((200_000, jaccard.VALUES)) < jaccard.THRESHOLD
    assert all((equal[:, :n].sum(axis=1) >= least).all() for n, least in jaccard.STEPS)
    assert jaccard.STEPS[-1][1] > 0.4 * jaccard.VALUES  # and unlike pairs do go


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in root if any(top(y) == top(x) for y in root if y != x)}


def test_suffix_order():
    rnd = random.Random(5)
    for _ in range(3000):
        text = [rnd.randrange(rnd.choice([1, 2, 3, 30])) for _ in range(rnd.randrange(25))] * rnd.randrange(1, 4)
        assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    shared = [some(300), some(250), some(199), some(210), "ab" * 200, "x" * 300]
    docs = [(k, some(rnd.randrange(260)) + rnd.choice(shared) + some(rnd.randrange(260))) for k in range(120)]
    original = some(1500)
    for k in range(40):
        text = list(original)
        for _ in range(rnd.randrange(1, 9)):
            text[rnd.randrange(len(text))] = rnd.choice("ZYX")
        docs.append((1000 + k, "".join(text)))
    docs += [(None, original[:400])] * 2 + [(2000, None), (2001, ""), (2002, "y" * 200), (2003, "q" * 201), (2004, "ü" * 100), (5, some(300)), (5, some(300))]
    return docs


def covered(docs):
    data = [(t or "").encode() for _, t in docs]
    count = Counter(b[i : i + sd.LENGTH] for b in data for i in range(len(b) - sd.LENGTH + 1))
    out = []
    for b in data:
        steps = np.zeros(len(b) + 1, int)
        for i in range(len(b) - sd.LENGTH + 1):
            if count[b[i : i + sd.LENGTH]] > 1:
                steps[i] += 1
                steps[i + sd.LENGTH] -= 1
        out.append(np.cumsum(steps)[: len(b)] > 0)
    return data, out


@pytest.mark.parametrize("large", [4096, 3])
def test_repeats(spark, passages, monkeypatch, large):
    """Every byte, with whole buckets and with buckets split down to single windows."""
    monkeypatch.setattr(sd, "LARGE", large)
    df = frame(spark, passages)
    data, gone = covered(passages)
    want = []
    for (i, _), b, g in zip(passages, data, gone):
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        runs = int((np.diff(g.astype(int), prepend=0) == 1).sum()) if len(b) else 0
        want.append((i, len(b), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r) for r in sd.removed(df).collect()), key=KEY) == sorted(want, key=KEY)
    if large == 4096:
        left = sd.without_repeats(df)
        texts = [None if t is None else np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore") for (_, t), b, g in zip(passages, data, gone)]
        assert left.columns == df.columns
        rows = left.collect()
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((i, t) for (i, _), t in zip(passages, texts)), key=repr)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        assert sd.removed(df.limit(0)).collect() == []


def test_long_text_in_stretches(monkeypatch):
    """Anchors of a text that is read in several stretches are those of the whole."""
    rnd = random.Random(8)
    data = np.frombuffer("".join(rnd.choice("abcd") for _ in range(9000)).encode(), np.uint8)
    texts = sd.Texts(0, 3, data, np.array([0, 150, 5000, 9000]))
    whole = [x.tolist() for x in sd.anchors(texts)]
    monkeypatch.setattr(sd, "STRETCH", 700)
    assert [x.tolist() for x in sd.anchors(texts)] == whole


def test_pipeline(spark):
    """Every stage returns what its operator decides on the rows before it."""
    docs = table(spark, SMALL, "documents")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(materialize(stage(spark, states[-1], SMALL), name))
        if name != "tokens":
            assert states[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in s.collect()] for s in states[:-1]]
    raw, good, single, cut, clean = rows
    assert set(good) <= set(raw) and set(single) <= set(good) and set(clean) <= set(cut)
    assert len(single) == brute_classes(good)[1]
    data, gone = covered(single)
    assert sorted(cut) == sorted((i, np.frombuffer(b, np.uint8)[~g].tobytes().decode("utf-8", "ignore")) for (i, _), b, g in zip(single, data, gone))
    found = {r.doc_id for r in dec.overlaps(states[3], table(spark, SMALL, "benchmark")).collect()}
    assert {i for i, _ in cut} - {i for i, _ in clean} == found
    assert sorted(r.doc_id for r in states[-1].collect()) == sorted(i for i, _ in clean)
    assert corpus_pipeline.run(spark, SMALL).count() == len(clean)
