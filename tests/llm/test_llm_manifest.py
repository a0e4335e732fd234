"""Tokens by prefix table, Merkle manifest and source divergence, against the library or brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracles import compare, connect
from wardline.llm import divergence, merkle, piece_bpe
from wardline.llm.common import table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, k string, hash string, rank int, term string, path int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    pieces = piece_bpe.Pieces(piece_bpe.model_of(None))
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    return pieces, library


def agree(codec, texts):
    pieces, library = codec
    ids, first = pieces.encode(texts)
    want = library.encode(texts, add_eos=True, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
    assert [t.decode() for t in pieces.decode(ids, first)] == library.decode(want)


def test_tokens_equal_the_library(codec):
    rnd = random.Random(5)
    names = [p for i in range(codec[1].get_piece_size()) if not (p := codec[1].id_to_piece(i)).startswith("<")]
    letters = sorted({c for p in names for c in p})
    agree(codec, ["", " ", "  ", "\n", "a\nb", "▁", "▁▁a", "   x ", "\0", "é😀", "<s>", "</s>x", "<unk><0x0A>", "a" * 300, " " * 300])
    agree(codec, names)
    agree(codec, ["".join(rnd.choices(names, k=rnd.randint(1, 6))) for _ in range(5000)])
    agree(codec, ["".join(rnd.choices(letters, k=rnd.randint(1, 20))) for _ in range(3000)])
    for alphabet in (" a", " \t\n", "=-", "ab", "aeth ", "0 1", "▁ t"):
        agree(codec, ["".join(rnd.choices(alphabet, k=rnd.randint(1, 70))) for _ in range(1500)])
    agree(codec, [chr(c) for c in range(0, 0x110000, 53) if not 0xD800 <= c < 0xE000])


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_tokens_of_any_text(codec, texts):
    agree(codec, texts)


def test_one_by_one_equals_together(codec, monkeypatch):
    """The last few strings go on one by one; with all or none of them the table is the same."""
    texts = ["thequickbrownfoxjumps" * 9 + "overthelazydog" * k for k in range(9)]
    for few in (0, 5, 1000):
        monkeypatch.setattr(piece_bpe, "FEW", few)
        agree(codec, texts)


def test_ids_that_no_text_gives(codec):
    """Bytes that are no characters, and ids of control pieces."""
    pieces, library = codec
    for run in ([130, 200, 300], [259, 260], [1, 2], [2], [], [228, 186, 2], [131, 131, 13]):
        got = pieces.decode(np.array(run, np.int32), np.array([0, len(run)]))[0].decode()
        assert got == library.decode(run), run


def test_token_rows(spark, codec):
    long = "word " * 50_000 + "x" * 30_000
    rows = [(0, None), (0, ""), (1, "same text"), (1, "same text"), (None, "é\n\n  A"), (2, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = Counter(map(tuple, piece_bpe.round_trip(docs).collect()))
    want = Counter()
    for i, t in rows:
        ids = codec[1].encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(codec[1].decode(ids))] += 1
    assert got == want
    encoded = piece_bpe.encode(docs)
    assert Counter(r.text for r in piece_bpe.decode(encoded).collect()) == Counter(t or "" for _, t in rows)
    assert piece_bpe.round_trip(docs.limit(0)).collect() == []


# --- manifest ------------------------------------------------------------------------------


def brute_manifest(rows):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        """The root of a tree and each leaf's steps (before, after)."""
        steps, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, over = [], []
            for lo in range(0, len(nodes), 3):
                run = nodes[lo : lo + 3]
                for k in range(len(run)):
                    for i in under[lo + k]:
                        steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(sha("".join(run)))
                over.append([i for k in range(len(run)) for i in under[lo + k]])
            nodes, under = up, over
        return nodes[0], steps

    by_source = defaultdict(list)
    for row in rows:
        i, source, lang, n, text = row
        now = text if text is None or i is None or zlib.crc32(str(i).encode()) % 2 else text.replace("\n", "")
        by_source[source].append((i, leaf(row), leaf((i, source, lang, n, now))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in by_source[s]])
    root, above = climb([trees[s][0] for s in order])
    out = Counter()
    for s, more in zip(order, above):
        for (i, own, now), steps in zip(by_source[s], trees[s][1]):
            for before, after in steps + more:
                now = sha(before + now + after)
            proof = sha("".join(b + a for b, a in steps + more))
            out[i, own, trees[s][0], root, proof, now, now == root] += 1
    return out


def some_rows():
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", "ü", "b"]), "en", 3, rnd.choice(["x\ny", "plain", "\n"])) for i in range(60)]
    rows += [(i, "hot", None, None, f"{i}\n") for i in range(40)]
    rows += [(7, "a", "en", 3, "x\ny")] * 4 + [(None, "a", "de", 1, "n\n"), (None, None, None, None, None), (3, None, "", 0, ""), (5, "", "fr", 2, "long " * 50_000)]
    return rows


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest_equals_brute_force(spark, digits):
    """One leaf a source, lone last runs, several tiers, repeated rows, nulls, clashing names."""
    rows = some_rows()
    if digits == 1:
        rows = rows[::4] + rows[-8:]
    docs = spark.createDataFrame([(*r, "k", "h", 1, "t", 2) for r in rows], DOCS)
    got = merkle.audit(docs, merkle.without_newlines(), digits)
    assert Counter(map(tuple, got.collect())) == brute_manifest(rows)


def test_small_manifests(spark):
    for rows in ([], [(1, "a", "en", 1, "x\n")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y")]):
        docs = spark.createDataFrame([(*r, "k", "h", 1, "t", 2) for r in rows], DOCS)
        want = brute_manifest(rows) if rows else Counter()
        assert Counter(map(tuple, merkle.audit(docs, merkle.without_newlines()).collect())) == want


# --- divergence ----------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    found = divergence._IS_TERM
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, words, word = lang or "", source or "", [], bytearray()
        for b in (text or "").encode() + b" ":
            if found[b]:
                word.append(b + 32 if 65 <= b <= 90 else b)
            elif word:
                words.append(bytes(word).decode())
                word = bytearray()
        groups[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        mine = {s: groups[x, s] for x, s in groups if x == lang}
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        q, p = share(sum(mine.values(), Counter())), {s: share(c) for s, c in mine.items()}
        for s in mine:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if mine[s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(items) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("tile, block", [(256, 4096), (2, 3)])
def test_divergence_equals_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rnd = random.Random(4)
    words = ["a", "ab", "abc", "abcd", "ABCDE", "abcdefgh", "abcdefghijklmnop", "é", "éé", "über", "x" * 400, "x" * 400 + "y", "日本語", "tést"]
    rows = []
    for _ in range(150):
        text = rnd.choice([" ", "\n", "9"]).join(rnd.choices(words, k=rnd.randrange(9)))
        rows.append((rnd.choice(["en", "en", "de", None]), rnd.choice(["s1", "s2", "s3", "s4", "s5", None]), rnd.choice([text, text, text, None])))
    rows += [("en", "none", ""), ("xx", "one", "rare"), ("xx", "two", None), ("yy", "alone", "a")] + [("en", "s1", "abc " * 9000 + "z" * 20_000)] * 3
    docs = spark.createDataFrame([(1, *r, 1, "t", 2) for r in rows], "doc_id long, lang string, source string, text string, docs int, prefix string, value int")
    for least in (1, 4):
        got = divergence.audit(docs, min_docs=least, top=5)
        want = brute_divergence(rows, least, 5)
        assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    assert divergence.audit(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_source_divergence"])
def test_new_oracles(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), entry.oracle_sql()[name]) == ""


def test_prefixes_are_discarded_level_by_level(spark):
    """Rare prefixes are not counted again: each level has only what lives on."""
    docs = table(spark, SMALL, "documents")
    kept = divergence.kept_terms(docs, 30)
    short = divergence.kept_terms(docs, 30, first=1)
    assert kept.exceptAll(short).count() == 0 == short.exceptAll(kept).count()
