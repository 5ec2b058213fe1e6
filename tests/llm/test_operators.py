"""Every operator against a brute-force version on small tables, with nulls, empty and long texts, repeats and odd columns."""

import hashlib
import math
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwood.llm import common, decontaminate, html_text, licences, neardup, packing, quality, repeats, topk, toxicity, urls
from driftwood.llm.common import chunks, shingle_sets, utf8

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, label string, th string, spans string, a int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "an", "Ou", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_documents():
    """Copies, near copies, repeated rows and ids, nulls, empty, blank, short and long texts; other columns clash with names inside."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper(), t + " " + base[-1]]
    texts += [None, "", "  \n\t", "one", "one two three", "x" * 3000, "ab" * 2000, prose(rng, 6000), "é" * 900]
    rows = [(i, t, "en", "x", "y", "z", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], (1, "another text under a known id", None, None, None, None, None), (None, base[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_sets_have_the_right_sizes():
    texts = [r[1] for r in odd_documents()]
    raw, off = utf8(pa.array(texts, pa.string()))
    got = [len(s) for i, j in chunks(off, 5000) for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i])]
    assert got == [len(shingles(t)) for t in texts]


def test_long_documents_go_in_pieces(monkeypatch):
    """The same hashes and fragments' windows, and nearly the same scores, however long the pieces are."""
    rng = random.Random(12)
    text = prose(rng, 4000) + " idiot " + prose(rng, 500) + " " + "x" * 3000
    raw, off = utf8(pa.array([text]))
    weight = rng.random() * np.ones(toxicity.BUCKETS, np.float32)
    weight[: toxicity.BUCKETS // 2] = -1
    net = quality.train([prose(rng, 80) if i % 2 else "again " * 150 for i in range(60)], [i % 2 for i in range(60)], 0.5, epochs=5)

    def all_of():
        found = [(f + a, last + a) for i, j, a, b in repeats._pieces(off, 100) for f, last in zip(*repeats.fragments(raw[a:b], np.array([0, b - a]), 100)[1:3])]
        return shingle_sets(raw, off)[0], sorted(w for f, last in found for w in range(f, last + 1)), toxicity.score(raw, off, weight, 0.0)[0], quality.score(raw, off, net)[0]

    one = all_of()
    monkeypatch.setattr(common, "PIECE_BYTES", 3000)
    monkeypatch.setattr(repeats, "chunks", lambda off: [(0, 1)])
    two = all_of()
    assert (one[0] == two[0]).all() and one[1] == two[1] == list(range(len(raw) - 99))
    assert abs(one[2] - two[2]) < 1e-9 and abs(one[3] - two[3]) < 0.02


def components(rows, percent):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return top, dict(sets)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_near_duplicates(spark, docs, percent):
    rows = [r for r in odd_documents() if r[0] != 1]  # an id with two texts is looked at below
    top, _ = components(rows, percent)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.doc_id is None or (r.component_id == top(r.doc_id) and r.kept == (r.doc_id == r.component_id))
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(r[1])) for r in rows)


def test_an_id_with_two_texts_has_two_sets(docs):
    got = neardup.near_duplicates(docs.where("doc_id = 1")).collect()
    assert len(got) == 2 and {r.component_id for r in got} == {1} and all(r.kept for r in got)


def test_many_near_copies_in_one_bucket(spark, monkeypatch):
    """A star and chains of near copies, with blocks so small that buckets are cut."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(5)
    words = prose(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(words)
        for _ in range(i % 4):
            w[rng.randrange(60)] = f"w{rng.randrange(5)}"
        rows.append((100 - i, " ".join(w), *[None] * 5))
    top, _ = components(rows, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {r[0]: top(r[0]) for r in rows}


def test_one_row_of_each_component_stays(spark):
    """Repeated and null ids take part; two texts under one id are two documents; rows without words stay."""
    rng = random.Random(31)
    a, b, c, d = (prose(rng, 90) for _ in range(4))
    rows = [(1, a), (1, a), (None, a), (2, b), (2, a + " more"), (3, c), (None, d), (None, d), (4, ""), (4, ""), (None, None), (None, "  ")]
    got = neardup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (2, b), (3, c), (None, d), (4, ""), (4, ""), (None, None), (None, "  ")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    for share in (0.2, 0.5, 0.9):
        b = np.unique(np.r_[a[: int(len(a) * share)], rng.integers(0, 1 << 63, int(len(a) * (1 - share))).astype(np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = neardup.sketch([a, b, a[:1]], 2000)
        assert abs((s[0] == s[1]).mean() - true) < 0.06


def spans(texts, length):
    """(bytes, removed, runs, kept) of each text by looking at every window."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for x in raw:
        for i in range(len(x) - length + 1):
            count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot", [(60, 8192), (60, 2), (400, 8192)])
def test_repeats(docs, length, hot):
    rows = docs.collect()
    got = repeats.removal_digest(docs, length=length, hot=hot).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(spans([r.text for r in rows], length))


def passages(texts, length, words):
    """How many runs of `words` words each text has that are covered by repeated strings, by looking at every window."""
    raw, count = [(t or "").encode() for t in texts], {}
    for x in raw:
        for i in range(len(x) - length + 1):
            count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(sum(len(x[m.start() : m.end()].split()) >= words for m in re.finditer(rb"\x01+", bytes(gone))))
    return out


@pytest.mark.parametrize("passage,words,hot", [(200, 51, 8192), (90, 12, 2)])
def test_passages(docs, passage, words, hot):
    texts = [r.text for r in docs.collect()]
    got = repeats.removal_digest(docs, hot=hot, passage=passage, words=words).select("kept_sha256", "n_passages").collect()
    want = sorted(zip((x[3] for x in spans(texts, 400)), passages(texts, passage, words)))
    assert sorted(map(tuple, got)) == want
    assert {n > 0 for _, n in want} == {True, False}


def test_anchors_of_two_lengths(monkeypatch):
    """Each window of either length is in one fragment, in long documents cut in pieces too, and is the one that a search for that length alone finds."""
    monkeypatch.setattr(common, "PIECE_BYTES", 1000)
    rng = random.Random(35)
    texts = ["", "x", prose(rng, 900), "short " * 20, prose(rng, 30), "ab" * 100, "x" * 1250, prose(rng, 2000)]
    monkeypatch.setattr(repeats, "chunks", lambda off: chunks(off, 2000))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "th": [0] * len(texts), "text": texts})
    both = [r for b in repeats._anchored((90, 200))([batch]) for r in b.to_pylist()]
    for n in (90, 200):
        places = lambda rows: sorted((r["doc_id"], r[f"first{n}"], r[f"last{n}"], r["at"], r["anchor"], r[f"digest{n}"]) for r in rows if r[f"digest{n}"] is not None)  # noqa: B023, E731
        got = places(both)
        assert got == places(r for b in repeats._anchored((n,))([batch]) for r in b.to_pylist())
        starts = sorted((d, i) for d, a, z, *_ in got for i in range(a, z + 1))
        assert starts == [(d, i) for d, t in enumerate(texts) for i in range(len(t.encode()) - n + 1)]


def test_passages_shorter_than_what_goes(spark):
    """51 words in 305 bytes that two documents share are counted and stay; 48 words are not counted."""
    rng = random.Random(34)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    enough, fewer = " ".join(word(5) for _ in range(51)), " ".join(word(5) for _ in range(48))
    rows = [(2 * k + i, f"{word(40)} {p} {word(40)}") for k, p in enumerate((enough, fewer)) for i in range(2)]
    got = {r.doc_id: r for r in repeats.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_passages for i, _ in rows] == [1, 1, 0, 0]
    assert all((got[i].n_removed, got[i].kept_sha256) == (0, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)


def test_repeats_leave_whole_characters(docs):
    rows = docs.collect()
    raw, count = [(r.text or "").encode() for r in rows], {}
    for x in raw:
        for i in range(len(x) - 60):
            count[x[i : i + 61]] = count.get(x[i : i + 61], 0) + 1
    want = []
    for r, x in zip(rows, raw):
        gone, at, out = bytearray(len(x)), 0, ""
        for i in range(len(x) - 60):
            if count[x[i : i + 61]] > 1:
                gone[i : i + 61] = b"\1" * 61
        for c in r.text or "":
            n = len(c.encode())
            out += "" if all(gone[at : at + n]) else c
            at += n
        if out or not r.text:
            want.append(repr((r.doc_id, r.text and out, r.a)))
    assert sorted(repr((r.doc_id, r.text, r.a)) for r in repeats.remove_repeats(docs, length=61).collect()) == sorted(want)


def test_repeats_by_words(spark):
    """51 words in under 400 bytes go with `words`; 50 words, or few long ones, stay."""
    rng = random.Random(32)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, fewer, long_ = " ".join(word(5) for _ in range(51)), " ".join(word(5) for _ in range(48)), " ".join(word(12) for _ in range(25))
    rows = [(2 * k + i, f"{word(40)} {p} {word(40)}") for k, p in enumerate((short, fewer, long_)) for i in range(2)]
    got = {r.doc_id: r.text for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=200, words=51).collect()}
    assert [got[i] == t for i, t in rows] == [False, False, True, True, True, True]
    assert all(short not in got[i] and len(got[i]) < 90 for i in (0, 1))


def contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for k in range(max(1, len(b) - 9) if b else 0):
            win = b[k : k + 10]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bound", [1 << 24, -1])
def test_contamination(spark, docs, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    rows = docs.collect()
    t = [r.text for r in rows if r.text and len(r.text.split()) > 30]
    items = [(1, " ".join(t[0].split()[3:20])), (10, t[1].upper()), (2, "one two"), (3, None), (4, " ,. "), (None, " ".join(t[2].split()[:12])), (5, "no such words anywhere"), (6, "THREE"), (7, " ".join(t[0].split()[3:15]))]
    got = decontaminate.contamination(docs, spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, win string")).collect()
    assert sorted(map(repr, (tuple(r)[1:] for r in got))) == sorted(repr(contamination(r.text, items)) for r in rows)
    clean = decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert sorted(repr(r.text) for r in clean.collect()) == sorted(repr(r.text) for r in rows if not contamination(r.text, items)[4])


@pytest.mark.parametrize("size", [16, 4096])
def test_packing_is_a_round_trip(docs, size):
    from tokenizers import Tokenizer
    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(model.encode(r.text or "", add_special_tokens=False).ids + [2])
    got = packing.pack(docs.withColumn("length", F.lit("x")), size=size).collect()
    fill = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert fill.get(p.sequence_id, 0) == p.offset
        fill[p.sequence_id] = p.offset + p.length
    assert all(n == size or (n < size and n & (n - 1) == 0) for n in fill.values())
    for i, texts in want.items():
        pieces = [p for p in got if p.doc_id == i]
        assert sum(p.length for p in pieces) == sum(map(len, texts))
        for p in pieces:
            assert any(len(t) == p.doc_tokens and zlib.crc32(np.array(t[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for t in texts)


def test_encoding_word_by_word_is_the_tokenizer(monkeypatch):
    """Odd texts: case beyond Latin-1, special tokens in either case, runs of punctuation, control and Unicode blanks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, encode, rng = Tokenizer.from_file(path), packing.Encoder(path, 2), random.Random(8)
    odd = ["it's Don't WE'LL. ａＢ x,y. z., a!!, b.", "<|endoftext|>. <|ENDOFTEXT|>, <|startoftext|>x", "ΣΑΣ. ΣΑΣ İI", "a\x1cb\x85c\xa0d. e\u2003f", "½. ²,3. 12. é. e\u0301.", "", None, " ", ".", "a.\nb,\tc", "_. a_. _a,", "ß. ẞ µ. ÀÉ,"]
    odd += ["".join(rng.choice("ab.,!' \nÉé<|>0_") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    monkeypatch.setattr(packing, "RUN", 15)
    for t, ids in zip(odd, encode(odd)):
        assert ids.tolist() == model.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


def test_a_point_after_a_mark_stays_with_it():
    """Marks, circled letters, and letters that the tokenizer itself turns into a letter and a mark."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, encode = Tokenizer.from_file(path), packing.Encoder(path, 2)
    odd = ["यह है, और", "यह हिन्दी.", "ตัวที่.", "வணக்கம்.", "Ⓐ.", "q\u0301.", "İ.", "\u0958,", "слово, é. 7,"]
    for t, ids in zip(odd, encode(odd)):
        assert ids.tolist() == model.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_sum_of_squares_choice():
    """Each placement makes the sum of squared counts smallest, over all levels."""
    rng = random.Random(4)
    pack = packing.Packer(50)
    for k in range(3000):
        s, before = rng.randint(1, 49), pack.count.copy()
        best = None
        for h in [0, *(h for h in range(1, 51 - s) if before[h])]:
            after = before.copy()
            after[h] -= bool(h)
            after[h + s] += h + s < 50
            best = min(x for x in (best, int((after[1:50] ** 2).sum())) if x is not None)
        pack.place((k, 0, s))
        assert int((pack.count[1:50] ** 2).sum()) == best


def test_open_windows_are_bounded():
    pack, done = packing.Packer(100, most_open=5), []
    for k in range(200):
        done += pack.place((k, 0, 51 + k % 9))
    done += pack.pour(end=True)
    assert sum(n for w in done for _, _, n in w) == sum(51 + k % 9 for k in range(200))


@pytest.mark.parametrize("n,dims", [(700, 8), (12, 3), (0, 2)])
def test_top_k(spark, n, dims, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.choice([rng.uniform(-1, 1), 0.5]))) for _ in range(dims)], "x") for i in range(n)]
    rows += [(900, None, "x"), (901, [None] * dims, "x"), (902, [float("nan")] * dims, "x"), (903, [float("inf")] * dims, "x"), (None, [0.5] * dims, "x"), (904, [], "x"), (800, [0.25], "x")]
    rows += rows[:3]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 100 == 0).collect()
    known = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in known if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><header><h1>Head &amp; tail</h1></header><p>First  para\n with <b>bold</b><br>break<p>Second<script>x('</p>')</script> one &copy; &#233;</p><div class='advert'>Buy</div><ul><li>a<li>b</ul><p>.</p>"
        "<form><input value=1>Send</form><section id='comments'><p>Nice text, dear author, thank you very much for it!</p></section></article><aside>Side</aside><div id=sidebar>More</div><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == "Head & tail\n\nFirst para with bold break\n\nSecond one © é\n\na\n\nb\n\n."
    for odd in (None, "", "<", "<>", "<a", "</p></p>", "<!--", "<script>", "<p title='>", "<b>" * 3000, "&", "<html></html>"):
        assert isinstance(html_text.main_text(odd), str)


def test_main_text_without_an_article():
    body = "".join(f"<p>{'long sentence number %d, with many words. ' % i * 5}</p>" for i in range(4))
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><div>{body}</div></div><div><a href=4>more links here</a></div></body>"
    assert html_text.main_text(page).split("\n\n") == [" ".join(("long sentence number %d, with many words. " % i * 5).split()) for i in range(4)]


@pytest.mark.parametrize("names", ["content has-sidebar", "no-sidebar", "ad-free", "search-results", "social-science"])
def test_names_do_not_drop_the_article(names):
    text = "A long sentence of the article, with many words in it. " * 5
    for tag in ("article", "div"):
        page = f"<body><div class='{names}'><{tag}><p>{text}</p><p>{text}</p></{tag}></div><div class='ad'>Buy</div><div class='comments'><p>{text * 9}</p></div></body>"
        assert html_text.main_text(page) == "\n\n".join([text.strip()] * 2)


def test_all_articles_of_a_page():
    texts = [f"Sentence {i} of this part, with a good number of words. " * 6 for i in range(6)]
    page = "<body><main>" + "".join(f"<article><p>{texts[i]}</p><p>{texts[i + 1]}</p></article>" for i in (0, 2, 4)) + "</main></body>"
    assert html_text.main_text(page).split("\n\n") == [t.strip() for t in texts]


def test_extract_text_over_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "v", "", "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)]))


def test_url_rules_and_model(spark):
    rows = [("http://www.example.com/en/1?x", "www.example.com/en/", "allow"), ("HTTPS://A.Example.COM/en/x#y", "example.com/en/", "block"), ("http://example.com/de/", "com/", "allow"), ("x://b.net/es/1", "net/es/", "block"), ("x://bnet/es/1", None, "allow"), ("http://com?/en/", None, "allow"), ("http://a.com", None, "allow"), (None, None, "allow"), ("no scheme /en/", None, "allow"), ("", None, "allow"), ("https://best-casino-bets.example.org/en/1", None, "block"), ("https://museum-library.example.org/en/1", None, "allow"), ("a://b://c.net/fr/", None, "allow")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(i, u, "x", "y") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, host string, x string")).collect()}
    for i, (_, rule, verdict) in enumerate(rows):
        assert got[i].rule == rule, rows[i]
        if rule or i >= 10 and i != 12:
            assert got[i].verdict == verdict, rows[i]
    assert (got[1].host, got[1].path, got[5].host, got[5].path, got[7].host, got[12].host) == ("a.example.com", "/en/x", "com", "", "", "b:")


def test_url_scores_are_the_model(spark):
    """Scores against the same features counted in plain Python from Spark's hash of each n-gram."""
    pages = spark.createDataFrame([(1, "http://casino.example.com/a1"), (2, None)], "page_id long, url string")
    labelled = spark.createDataFrame([("http://casino.com/", 1), ("http://news.org/", 0), ("http://bad.org/", None)], "url string, blocked int")
    weights, bias = urls.train(labelled)
    got = {r.page_id: r.score for r in urls.judge(pages, labelled=labelled).collect()}
    for i, (host, path) in {1: ("casino.example.com", "/a0"), 2: ("", "")}.items():
        grams = [(k, t[j : j + n]) for k, (t, n) in enumerate((t, n) for t in (f".{host}.", f"/{path}/") for n in urls.SIZES) for j in range(max(len(t) - n, 0) + 1)]
        hashed = spark.createDataFrame(grams, "k int, g string").selectExpr(f"pmod(xxhash64(k, g), {urls.BUCKETS}) b").distinct().collect()
        z = bias + sum(weights[r.b] for r in hashed)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_licences(spark):
    mit = dict(licences.TEXTS)["MIT"]
    texts = ["MIT Licence\n\nCopyright (c) 2020 A. Body\n\n" + licences.TEXTS[0][1].upper().replace(",", ""), licences.TEXTS[3][1], "a " + mit, None, "", "Copyright 2020 Foo", "Words.\nReleased under the MIT Licence!\n(Licensed under CC BY-NC 4.0)\nmore"]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")).collect()}
    assert [got[i].license for i in range(7)] == ["MIT", "BSD-2-Clause", None, None, None, None, None]
    assert (got[6].n_notices, got[6].notices, got[3].digest) == (2, "CC-BY-NC-4.0,MIT", hashlib.sha256(b"").hexdigest())
    assert got[3].digest == got[4].digest == got[5].digest


def words_of(rng, bad):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(60)]
    if bad:
        words[rng.randrange(60)] = rng.choice(["idiotic", "idiots", "idiot", "moronic", "moron"])
    return " ".join(words)


def test_toxicity_learns_subwords():
    rng = random.Random(2)
    y = [i % 4 == 0 for i in range(200)]
    weight, bias = toxicity.train([words_of(rng, b) for b in y], [int(b) for b in y], 0.25)
    raw, off = utf8(pa.array(["alpha beta idiotz gamma delta", "alpha beta gamma delta sigma", "", "alpha " * 3000 + "m0ron moron"]))
    p = toxicity.score(raw, off, weight, bias)
    assert p[0] > 0.5 > p[1] and 0 <= p[2] <= 1 and p[3] > 0.5


def test_toxicity_scores_by_brute_force():
    """The worst window's mean over its subwords, each hashed by itself."""
    rng = np.random.default_rng(3)
    weight = rng.normal(0, 1, toxicity.BUCKETS)
    texts = ["", "a", "ab cd", "Some WORDS, and 3 more; é words!", "x" * 100, " ".join(["tiny", "longer", "words"] * 40), " " * 50, None]

    def one(text):
        low, means = [int(toxicity._PLAIN[c]) for c in (text or "").encode()], []
        for k in range(max(1, -(-(len(low) - 12) // 12)) if low else 0):
            found = []
            for n in toxicity.SIZES:
                for i in range(12 * k, min(12 * k + 24, len(low))):
                    if i + n <= len(low) and 32 not in low[i + 1 : i + n - 1]:
                        h = n
                        for c in low[i : i + n]:
                            h = ((h ^ c) * 16777619) % (1 << 32)
                            h ^= h >> 15
                        found.append(weight[h % toxicity.BUCKETS])
            means.append(sum(found) / max(len(found), 1))
        return 1 / (1 + math.exp(-(max(means, default=0.0) - 0.25)))

    assert toxicity.WINDOW == 24
    assert np.allclose(toxicity.score(*utf8(pa.array(texts)), weight, -0.25), [one(t) for t in texts])


def test_quality_scores_by_brute_force():
    """Passage by passage: shares of byte kinds counted one by one, then the gated attention's weighted mean."""
    rng = random.Random(14)
    texts = [prose(rng, n) for n in (3, 150, 700)] + ["", None, "again " * 300]
    net = quality.train([prose(rng, 80) if i % 2 else "again " * 150 for i in range(40)], [i % 2 for i in range(40)], 0.5, epochs=3)
    got = quality.score(*utf8(pa.array(texts)), net)
    for text, p in zip(texts, got):
        raw = (text or "").encode()
        bag, feats = quality.passages(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        above = below = 0.0
        assert len(feats) == max(1, -(-len(raw) // quality.PASSAGE))
        for k, f in enumerate(feats):
            piece = raw[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
            kinds = [sum(int(quality._KIND[c]) == x for c in piece) / max(len(piece), 1) * 10 for x in range(quality.KINDS)]
            assert np.allclose(f[: quality.KINDS], kinds, atol=1e-5)
            h = [math.tanh(sum(f[i] * net["A"][i, j] for i in range(quality.FEATURES)) + net["a"][j]) for j in range(quality.HIDDEN)]
            dot = lambda m, j: sum(h[i] * m[i, j] for i in range(quality.HIDDEN))
            e = math.exp(sum(math.tanh(dot(net["V"], j)) / (1 + math.exp(-dot(net["U"], j))) * net["w"][j] for j in range(quality.GATE)))
            above, below = above + e * sum(x * c for x, c in zip(h, net["c"])), below + e
        assert abs(p - 1 / (1 + math.exp(-(above / below + net["b"][0])))) < 1e-4


def test_quality_finds_the_bad_passage():
    rng = random.Random(6)
    texts = [prose(rng, 80) if i % 2 else " ".join(["again"] * 150) for i in range(120)]
    net = quality.train(texts, [i % 2 for i in range(120)], 0.5)
    raw, off = utf8(pa.array([prose(rng, 90), "again " * 200, "", None]))
    p = quality.score(raw, off, net)
    assert p[0] > 0.5 > p[1] and np.isfinite(p).all()


@pytest.mark.parametrize("score,column", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_over_rows(spark, docs, score, column):
    """All rows are scored, odd ones too; labels of the held-out fold, null labels and clashing columns change nothing."""
    fold = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60) if i not in fold] + [(None, 1, "x"), (3, None, "x")], f"doc_id long, {column} int, score string")
    more = labels.unionByName(spark.createDataFrame([(i, 1, "x") for i in fold], labels.schema))
    one, two = (sorted(map(repr, score(docs, t, per_class=20).collect())) for t in (labels, more))
    assert one == two and len(one) == docs.count()
    r = score(docs, labels, per_class=20).where("doc_id = 7").first()
    assert r.held_out == (zlib.crc32(b"7") % 5 == 0) and 0 <= r.score <= 1


def test_classifiers_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.toxicity(docs, none).collect()}) == 1
    assert len({r.score for r in quality.quality(docs, none).collect()}) == 1


@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: neardup.near_duplicates(d), lambda d, s: neardup.keep_one_of_each(d), lambda d, s: repeats.removal_digest(d), lambda d, s: repeats.remove_repeats(d), lambda d, s: packing.pack(d), lambda d, s: licences.licence_scan(d),
        lambda d, s: decontaminate.contamination(d, s.createDataFrame([], "item_id long, text string")), lambda d, s: decontaminate.keep_clean(d, s.createDataFrame([(1, "a b")], "item_id long, text string")),
        lambda d, s: toxicity.toxicity(d, s.createDataFrame([(1, 1)], "doc_id long, toxic int")), lambda d, s: quality.keep_good(d, s.createDataFrame([(1, 1)], "doc_id long, quality int")),
        lambda d, s: topk.top_k(s.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0),
        lambda d, s: html_text.extract_text(s.createDataFrame([], "page_id long, url string, html string")), lambda d, s: urls.judge(s.createDataFrame([], "page_id long, url string")),
    ],
)
def test_empty_tables(spark, nothing, run):
    assert run(nothing, spark).collect() == []


def test_parts_of_names_are_judged_by_density():
    page = "<body><article><h1>T</h1><p>A long paragraph of text with many words in it.</p><div class='share-price'><p>Prices rose by ten percent in the last quarter.</p></div><div class='share-tools'><a href=x>Send this on</a></div><div class='ad-slot-2'>Buy now, and buy a lot of it.</div></article></body>"
    assert html_text.main_text(page) == "T\n\nA long paragraph of text with many words in it.\n\nPrices rose by ten percent in the last quarter."


@pytest.mark.parametrize("page", ["<b>" * 20000 + "x</i>" * 20000, "<b>" * 20000 + "<hr>" * 20000, "<b>" * 20000 + "<li>" * 20000, "<svg>" * 20000, "<b><article>" + "<i>" * 20000 + "</b>" * 20000, "<div>" * 20000 + "x"])
def test_odd_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_densities(tmp_path):
    rng = random.Random(11)

    def grow(depth):
        return "".join(f"<{t}>{grow(depth - 1)}</{t}>" if depth and (t := rng.choice(["div", "a", "span", "b", ""])) else "word " * rng.randrange(9) for _ in range(rng.randrange(1, 5)))

    for _ in range(30):
        tags, parent, last, out, noise, runs = html_text._tree(f"<body>{grow(4)}</body>")
        density, summed, _ = html_text.densities(tags, parent, out, runs)

        def numbers(i):
            links = [any(tags[k] == "a" and k <= j <= last[k] for k in range(len(tags))) for j in range(len(tags))]
            size = [(j, len(t.strip())) for j, t in runs if t and i <= j <= last[i]]
            return sum(n for _, n in size), sum(n for j, n in size if links[j]), last[i] - i, sum(tags[j] == "a" for j in range(i + 1, last[i] + 1))

        body = next((i for i in range(len(tags)) if tags[i] == "body"), 0)
        c, lc, _, _ = numbers(body)
        share, want = lc / max(c, 1), []
        for i in range(len(tags)):
            c, lc, t, lt = numbers(i)
            if not c:
                want.append(0.0)
                continue
            t, lt = max(t, 1), max(lt, 1)
            want.append(c / t * max(math.log(max(c / max(lc, 1) * t / lt, 1)), 0) / math.log(c / max(c - lc, 1) * lc + share * c + math.e))
        children = [[j for j in range(1, len(tags)) if parent[j] == i and j != i] for i in range(len(tags))]
        assert np.allclose(density, want)
        assert np.allclose(summed, [sum(want[j] for j in children[i]) if children[i] else want[i] for i in range(len(tags))])


@pytest.mark.parametrize("name,license", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_long_licences_are_known(spark, name, license):
    path = pathlib.Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence texts on this machine")
    text = path.read_text()
    rows = [(1, text), (2, text.upper().replace("license", "licence")), (3, "Copyright 2001 Somebody\n\n" + re.sub("[ ]+", "  ", text)), (4, text + " and more")]
    got = {r.doc_id: r.license for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: license, 2: license, 3: license, 4: None}
