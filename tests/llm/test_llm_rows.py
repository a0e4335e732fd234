"""Operators that treat each row alone: licences, pages, chats, tokens, quality rules."""

import hashlib
import html
import random
import re
import string

import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from check_oracles import compare, connect
from wardline.llm import bpe, chat, html_text, licence, quality_rules
from wardline.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, words string, score double, spans int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null, empty and long texts, repeated rows, and columns named like an operator's own."""
    long = " ".join(["word%d" % (i % 977) for i in range(60_000)]) + " all rights reserved"
    texts = [None, "", "   \n\t", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", long, "a\0b \x85 ué"]
    rows = [(i // 2, t, "x", 1.0, 1) for i, t in enumerate(texts)] + [(None, "General Public License, cc by", "x", None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_licence_base(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text"))
    got = sorted((tuple(r)[:6] for r in licence.scan(docs).collect()), key=repr)
    want = []
    for i, text in docs.collect():
        words = WORD.findall(lower(text or ""))
        places = [
            (k, label)
            for phrase, label in licence.PHRASES.items()
            for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        starts = [k for k, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), labels))
    assert got == sorted(want, key=repr)


def test_licence_statistics():
    """Matching statistics of the automaton against all substrings."""
    rnd = random.Random(1)
    for _ in range(200):
        templates = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 9))] for _ in range(3)]
        parts = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        automaton = licence.Automaton(templates)
        text = [rnd.randrange(5) for _ in range(30)]
        for i, (v, n) in enumerate(automaton.statistics(text)):
            assert n == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in parts), default=0)
            places = {(t, e) for t, x in enumerate(templates) for e in range(n - 1, len(x)) if x[e - n + 1 : e + 1] == text[i + 1 - n : i + 1]}
            assert not n or set(automaton.ends[v]) == places


def test_licence_spans():
    s = licence.Scanner()
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this code and associated documentation files"
    runs = [(r[1], r[2]) for r in s.runs(next(licence.slices(licence.pa.array([text]))))[1]]
    assert max(s.scan(runs)[1], key=lambda x: x.fraction).label == "mit"


def test_pages(spark):
    """On pages of the usual form the text is that of the article element."""
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", body).replace("<", " <")).split())
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?b>", "", body).replace("<", " <"))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_page_parts():
    page = """<!doctype html><html><body class="has-sidebar"><header>Top <h2>Site</h2></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies on this site, please accept all of them now.</div>
    <div id=main><h1>The title</h1><p>First paragraph with quite some words &amp; an <a href=y>inner link</a>.
    <p>Second<br>one, of text that goes on for a while.<ul><li>a point<li>another point</ul>
    <form><p>Sign up here <input></form><table><tr><td>one<td>two</table></div>
    <div class="comments"><p>A reader says something long here, which is no part of the article at all.</p></div>
    <aside>Related</aside><script>if (a < b) document.write("<p>no</p>")</script><footer>&copy; 2024</footer>"""
    want = "The title First paragraph with quite some words & an inner link. Second one, of text that goes on for a while. a point another point one two"
    assert html_text.main_text(page) == want
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<!-- never ends", "plain words", "<b <p>x")] == ["", "", "", "", "plain words", "x"]
    assert html_text.main_text("<div>" * 20_000 + "deep text") == "deep text"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "no-sidebar", "has-banner", "menuOpen", "search-results", "sidebar", "notice"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_page_names(name, tag):
    """A name on a wrapper does not take the article away, nor does one on a block that only sounds alike."""
    own = "The first paragraph of the article has quite some words. A notice of the author. Work that is related to this one."
    inner = own.replace(". A", ".</p><p class='notice-text'>A").replace(". W", ".</p><p class=related-work>W")
    page = f"""<body><ul class=nav><li><a href=x>Home</a></ul><div class="page {name}"><{tag}><p>{inner}</p></{tag}>
    <div class="sidebar"><p>Some more to read</div></div><div id=cookie-banner><p>We use cookies.</div>"""
    assert html_text.main_text(page) == own
    assert html_text.main_text("<div class=menu><p>one two three</div><div class=sidebar><p>four five six</div>") == "one two three four five six"
    comments = f"<main><p>{own}</main><div id=comments><article><p>A reader.</article></div>"
    assert html_text.main_text(comments) == own


def test_pages_odd(spark):
    rows = [(1, "u", None, 5), (1, "u", "", 5), (None, None, "<p>t</p>", 5), (None, None, "<p>t</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0)] * 2 + [(None, None, "t", 1)] * 2, key=repr)
    assert html_text.extract(pages.limit(0)).collect() == []


@given(st.text(alphabet="\\#</turn>: \nab", max_size=40), st.text(alphabet="\\#:</turn> u", max_size=12))
@settings(max_examples=300, deadline=None)
def test_chat_escapes(text, role):
    written = "".join(s["text"] for s in chat.format_turn(role, text))
    assert chat.read_turn(written) == (role, text)


def test_chats(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "### x: </turn>"), (1, 1, "assistant", "### x: </turn>"), (2, 5, None, None)]
    rows += [(2, None, "alien", "t"), (None, 0, "user", "n"), (3, 0, "system", "s"), (3, 1, "user", ""), (3, 2, "assistant", "é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.with_probe(spark, turns))).collect()}
    by = {c: [(r or "", t or "") for cc, _, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")) if cc == c] for c in (None, 1, 2, 3)}
    by[-7] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    assert got.keys() == by.keys()
    for c, all_turns in by.items():
        loss = "".join(t for r, t in all_turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in all_turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(all_turns), len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: got[c].valid for c in by} == {None: True, 1: False, 2: False, 3: True, -7: True}
    assert chat.read_back(chat.format_chats(turns.limit(0))).collect() == []


def test_tokens(spark, odd_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rnd = random.Random(3)
    letters = [" ", "  ", "\n", "a", "é", "漢", "😀", "<|endoftext|>", "'s", "1", "\x1c", "\u0301", "..", "th", "\xa0"]
    texts = [("".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))) for _ in range(500)]
    texts += ["".join(rnd.choice("abcdeth") for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows = [(i, t or "") for i, t in docs.collect()]
    want = sorted(((i, library.encode(t, add_special_tokens=False).ids) for i, t in rows), key=repr)
    encoded = bpe.encode(docs)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    assert sorted((tuple(r) for r in bpe.decode(encoded).collect()), key=repr) == sorted(rows, key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, ids in want]
    assert sorted((tuple(r) for r in bpe.round_trip(docs).collect()), key=repr) == sorted(digests, key=repr)
    assert bpe.round_trip(docs.limit(0)).collect() == []


def test_memo_keeps_frequent_pieces(monkeypatch):
    """Pieces met again and again are worked out once, however many others pass; ids stay the same."""
    monkeypatch.setattr(bpe, "MEMO", 40)
    codec, whole = bpe.Codec(bpe.vocabulary_of(None)), bpe.Codec(bpe.vocabulary_of(None))
    worked, merge = [], codec.merge
    monkeypatch.setattr(codec, "merge", lambda word: worked.append(word) or merge(word))
    for i in range(300):
        text = f"z the x{''.join(string.ascii_lowercase[int(c)] for c in str(i))}"
        monkeypatch.setattr(bpe, "MEMO", 10**6)
        want = whole.encode(text)
        monkeypatch.setattr(bpe, "MEMO", 40)
        assert codec.encode(text) == want
        assert len(codec.later) + len(codec.later.older) <= 40
    assert worked.count(b" the") == 1


def odd_texts(n: int, most: int) -> list[str]:
    rnd = random.Random(7)
    parts = [" ", "  ", "\n", "a", "é", "漢", "😀", "'", "'s", "'re", "l", "ve", "s", "1", "٣", "\x1c", "\u0301", "..", "-", "\xa0", "\u2028"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_words_of_many_texts():
    import regex

    texts = odd_texts(20_000, 14)
    found = bpe.cut(texts, bpe.kinds_of_points())
    words = [w.decode() for w in found.words.to_pylist()]
    first = found.first.tolist()
    assert [words[lo:hi] for lo, hi in zip(first, first[1:])] == [regex.findall(bpe.PATTERN, t) for t in texts]


def test_new_words_are_merged_together(monkeypatch):
    """New words, however many, cost no merges one by one; only words beyond ``SHORT`` bytes do."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdehinorstu\u00e9") for _ in range(n))
    texts = ["", *(" ".join(word(rnd.randrange(1, 15)) for _ in range(200)) for _ in range(40)), word(60) + " the", "<|endoftext|>" * 2 + "a"]
    texts += odd_texts(200, 30)
    known = sorted({w.encode() for w in texts[1].split(" ")})
    plain = bpe.Codec(bpe.vocabulary_of(None))
    for lexicon in (None, bpe.Lexicon.compile(known, {w: plain.merge(w) for w in known})):
        codec = bpe.Codec(bpe.vocabulary_of(None), lexicon)
        worked, merge = [], codec.merge
        monkeypatch.setattr(codec, "merge", lambda w: worked.append(w) or merge(w))
        got = codec.encode_all(texts)
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [codec.decode(x) for x in got] == texts
        assert all(len(w) > bpe.SHORT for w in worked) and len(worked) < 5
        assert [codec.text_ids(x) for x in got] == [codec.encode(t) for t in texts]


def test_long_texts_in_parts(monkeypatch):
    texts = odd_texts(300, 400)
    codec = bpe.Codec(bpe.vocabulary_of(None))
    whole = [x.tolist() for x in codec.encode_all(texts)]
    monkeypatch.setattr(bpe, "AT_ONCE", 20)
    assert max(sum(len(t) for _, t in held) for held in bpe.grouped(enumerate(["a b\n" * 99]), 20)) < 25
    assert [x.tolist() for x in codec.encode_all(texts)] == whole
    assert [codec.decode(codec.encode_all([t])[0]) for t in texts] == texts


def test_lexicon():
    rnd = random.Random(5)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 9))) for _ in range(800)})
    ids = {w: list(w) for w in words}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words, ids))
    assert [lexicon.ids(lexicon.find(w)) for w in words] == [ids[w] for w in words]
    other = {bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(9))) for _ in range(500)} - set(words)
    assert all(lexicon.find(w) == -1 for w in other)
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert lexicon.words == len(words) and len(lexicon.final) < len(prefixes)  # ends are shared


def test_rules(spark, odd_docs, tmp_path):
    prose = "".join(f"Line {w}a of {w}b has {w}c words {w}d, {w}e and {w}f.\n" for w in string.ascii_lowercase)
    menu = "Home | About | News | Shop\n" * 9
    more = [(50, prose), (51, menu + menu), (52, prose + menu[:50]), (53, "same words here " * 40), (54, "###&& " * 80)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    judged = quality_rules.judge(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert compare(judged, con, quality_rules.ORACLE) == ""
    assert {r.doc_id: r.kept for r in judged.collect() if (r.doc_id or 0) >= 50} == {50: True, 51: False, 52: True, 53: False, 54: False}
    assert quality_rules.judge(docs.limit(0)).collect() == []
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_registered_rules(spark, small):
    assert compare(entry.queries()["op8_quality_rules"](spark, small), connect(small), entry.oracle_sql()["op8_quality_rules"]) == ""
