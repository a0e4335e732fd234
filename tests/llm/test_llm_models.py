"""Operators that learn from labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import quality_crf as crf, toxicity as tox
from wardline.llm.common import table

DIR = "/root/testdata/sf0.01"


def area(scores, labels):
    good, bad = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_quality_held_out(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    rows = crf.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert area([r.score for r in rows], [r.quality for r in rows]) > 0.98
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.98 and all(r.predicted == (r.score >= 0.3) for r in rows)


def test_messages_against_all_labellings():
    rnd = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 8])
    e, t = rnd.normal(size=8), rnd.normal(size=(2, 2))
    a, b = crf.messages(e, first, t)
    for lo, hi in zip(first[:-1], first[1:]):
        n, total, marked = hi - lo, 0.0, np.zeros(hi - lo)
        for code in range(2**n if n else 0):
            y = [code >> k & 1 for k in range(n)]
            w = math.exp(sum(e[lo + k] * y[k] for k in range(n)) + sum(t[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            marked += w * np.array(y)
        if n:
            assert np.allclose(crf.logistic(a[lo:hi] + b[lo:hi]), marked / total)


def test_field_gradient_learns_transitions():
    rnd = np.random.default_rng(2)
    first = np.arange(0, 401, 8)
    bins = rnd.integers(0, 7, (400, crf.N_OWN)).astype(np.uint8)
    label = np.repeat(rnd.integers(0, 2, 50), 8)
    bins[:, 0] = np.where(rnd.random(400) < 0.6, label, 1 - label)
    x = crf.Lines(bins, np.full(400, 50), first)
    model = crf.fit_field(x, label, np.ones(400))
    assert ((model.marginals(x) > 0.5) == label).mean() > 0.95


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, 1), (1, "", 2), (2, " \n\n ", 3), (3, "!!" * 50_000 + "\n" + "Plain line of words.\n" * 3000, 4), (None, "Plain line.", 5)]
    return spark.createDataFrame(rows * 2, "doc_id long, text string, score int").withColumn("quality", F.lit("q"))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 1), (4, 1, 1)]])
def test_odd_rows(spark, odd, rows):
    labels = labels_of(spark, rows)
    for got in (crf.classify(odd, labels), tox.classify(spark, odd, labels)):
        got = got.collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = crf.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= 10
    assert crf.classify(odd.limit(0), labels).collect() == []
    assert tox.classify(spark, odd.limit(0), labels).collect() == []


def distance(a, b):
    """Edits with swapped neighbours, no part edited twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_product_against_distances():
    rnd = random.Random(4)
    terms = [("abcde", False), ("abdcea", False), ("ceabdabc", False), ("bad", False), ("dcb", True)]
    product = tox.Product(terms)
    for _ in range(4000):
        word = "".join(rnd.choice("abcde") for _ in range(rnd.randrange(3, 10)))
        if any(x == y for x, y in zip(word, word[1:])):
            continue  # drawn-out letters are free
        near = [(distance(t, word), i) for i, (t, s) in enumerate(terms) if not s and distance(t, word) <= tox.edits_for(t)]
        near += [(0, i) for i, (t, s) in enumerate(terms) if s and word.startswith(t)]
        found = product.hit(word)
        assert (found and (found.edits, found.term)) == min(near, default=None)


def test_disguises_and_context():
    product = tox.Product([("idiot", False)])
    assert [bool(product.hit(w)) for w in ("idiot", "1d10t", "idiooot", "idoit", "idot", "iddddot", "idxxt")] == [True] * 6 + [False]
    plain = "well the idiot went home".split()
    quoted = "well “the idiot” went home".split()
    told = "she said the word idiot once".split()
    meant = "you are an idiot now".split()
    at = lambda t: tox.context(t, next(i for i, x in enumerate(t) if "idiot" in x))
    assert at(quoted) < at(told) < at(plain) < at(meant)


def test_toxic_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = tox.classify(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(caught) > 0.85
    assert sum(r.predicted for r in rows if r.toxic == 0) < 0.01 * len(rows)


def test_misspelled_document(spark):
    """Terms that were learned are caught when misspelled."""
    rnd = random.Random(6)
    words = ["w%s%s" % (a, b) for a in "abcdefgh" for b in "klmnopq"]
    text = lambda bad: " ".join(rnd.choice(words) for _ in range(60)) + (" horrible vermin " + rnd.choice(words) if bad else "")
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, text(False) + " horible verrmn"), (9001, text(False))], "doc_id long, text string")
    labels = labels_of(spark, [(i, 1, y) for i, _, y in rows])
    got = {r.doc_id: r.predicted for r in tox.classify(spark, docs, labels).collect()}
    assert got[9000] == 1 and got[9001] == 0


def test_misspelled_stems_and_short_terms():
    product = tox.Product([("vermin", True), ("scum", False)])
    found = [product.hit(w) for w in ("verminous", "vermniously", "vremin", "scmu", "scu", "sxxm", "verxxx")]
    assert [h and tuple(h) for h in found] == [(0, 0), (0, 1), (0, 1), (1, 1), (1, 1), None, None]


def test_chance_words_leave_the_term(spark):
    """One chance word in few clean texts does not end the search for a term's misspellings, a frequent word is no hit."""
    rnd = random.Random(7)
    words = ["w%s%s" % (a, b) for a in "abcdefgh" for b in "klmnopq"]
    text = lambda more: " ".join(rnd.choice(words) for _ in range(60)) + more
    end = lambda i: " horrible vermin" if i % 5 == 0 else " horible vermim" if i in (1, 6) else " venmin" if i % 5 == 2 else ""
    rows = [(i, text(end(i))) for i in range(400)]
    docs = spark.createDataFrame(rows + [(9000, text(" horrble vermln")), (9001, text(" venmin")), (9002, text(""))], "doc_id long, text string")
    labels = labels_of(spark, [(i, 1, int(i % 5 == 0)) for i, _ in rows])
    got = {r.doc_id: r for r in tox.classify(spark, docs, labels).collect()}
    assert got[9000].predicted == 1 and got[9000].n_misspelled == 2
    assert got[9001].predicted == got[9001].n_misspelled == got[9002].predicted == 0


def test_words_inside_tokens():
    terms = [("idiot", False), ("clown", False), ("马鹿", False)]
    model = tox.Model(terms, [1.0] * 3, [1.0] * 3, tox.PRIOR)
    found = lambda text: [terms[h.term][0] for h, _ in model.hits(tox.Verdicts(model.product()), text)]
    assert found("idiot/clown") == found("x=idiot;y('clown')") == found("an idiot!clown") == ["idiot", "clown"]
    assert found("idiot,you") == found("idiot\u2014everyone") == found("Word.Idiot") == found("idi" + "o" * 70 + "t") == found("1d!ot") == ["idiot"]
    assert found("あの马鹿野郎です") == ["马鹿"] and found("idiots-folly bestidiotever") == ["idiot"]
    assert len(found("a=" + ";".join(["idiot", "fine"] * 20_000))) == 20_000
    assert found("." * 100_000 + "a" + "." * 100_000 + "idiot") == ["idiot"]
    learned = tox.terms_of("all/idiot:clown あの马鹿野郎")
    assert {("idiot", False), ("clown", False), ("马鹿", False), ("idio", True)} <= learned
