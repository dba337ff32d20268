"""The ten training-data operators against brute force, on a real small table and on one of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import html_extract, media, minhash, packing, quality_rules, queries, sentencepiece_scan, substring_dedup, token_counts, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 5000} tail{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
EDGE = [
    (5, None, "en", "a", 0),
    (None, "a row without an id", None, None, None),
    (1, "", "en", "a", 0),
    (2, " \t\n\r\x0b ", "en", "a", 6),
    (3, "same words again and again here now", "en", "a", 30),
    (3, "same words again and again here now", "en", "a", 30),
    (4, "SAME words again and again here NOW", "de", "b", 30),
    (7, PASSAGE, "en", "a", 1),
    (8, "before " + PASSAGE + " after", "en", "a", 1),
    (9, PASSAGE + " " + PASSAGE, "en", "a", 1),
    (10, LONG, "en", "a", len(LONG)),
    (11, "a b", "en", "a", 3),
    (12, "a <|endoftext|> b<|endoftext|>c  two   spaces\n\nlines é 日本語 😀 İstanbul nbsp here", "en", "a", 3),
    (13, "#tag $5 % & | <x> * don't they've x's 12345 3.14", "en", "a", 3),
    (14, "x" * 3000, "en", "a", 3000),
    (15, "one line of text\n" * 30, "en", "a", 3),
]
EXTRA = ["n_words", "kept", "_rk", "key", "score", "length", "rank", "rk", "spans", "comp", "n", "h", "_t", "_w", "host"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def unique(spark):
    rows = {r[0]: r for r in EDGE if r[0] is not None}
    return spark.createDataFrame(list(rows.values()), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_brute(by_id, k):
    sets = {}
    for d, t in by_id.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((d, len(sets[d]), find(d), find(d) == d) for d in ids), key=repr)


def substring_brute(by_id):
    first, out = {}, []
    for d in sorted(by_id):
        w = words(by_id[d])
        gone = set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in first:
                gone.update(range(i, i + 20))
            first.setdefault(tuple(w[i : i + 20]), 1)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def quality_brute(by_id):
    out = []
    for d, t in by_id.items():
        t = t or ""
        w = words(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed))
    return sorted(out, key=repr)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(name))


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["docs", "unique"])
def test_near_duplicates(table, request):
    df = request.getfixturevalue(table)
    got = minhash.near_duplicates(df, shingle=4).drop("_rk")
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows(got) == near_brute(texts(df), 4)


def test_near_duplicates_chain_and_large_group(spark):
    """A chain whose ends aren't similar, and a group of copies that meet in all buckets: no link is lost."""
    base = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(base[: 200 - 12 * i])) for i in range(8)]
    group = [(100 + i, " ".join([f"g{j}" for j in range(60)] + [f"end{i}"])) for i in range(120)]
    passage = [f"p{j}" for j in range(80)]
    mixed = [(300 + i, " ".join([*passage, *[f"own{i // (2 if i < 20 else 1)}x{j}" for j in range(30 + i % 2)]])) for i in range(60)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in chain + group + mixed], SCHEMA)
    assert rows(minhash.near_duplicates(df, shingle=4).drop("_rk")) == near_brute(texts(df), 4)


def test_rare_pairs_lose_no_link(spark, docs, tmp_path):
    """All pairs of similar sets, found without any bucket."""
    from skeinwork.llm.common import WordHashes

    keyed = docs.select(F.col("doc_id").alias("_rk"), "text")
    cache = WordHashes()
    sets = {d: set(minhash.shingle_set(t, 4, cache).tolist()) for d, t in texts(docs).items()}
    ids = spark.createDataFrame([(d, d, len(s)) for d, s in sets.items() if s], "rep long, comp long, n long")
    got = {tuple(r) for r in minhash.rare_pairs(ids, keyed, 4, 80, f"file://{tmp_path}").collect()}
    want = {(a, b) for a in sets for b in sets if a > b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_toxicity_is_calibrated_and_handles_any_text(spark, edge, empty):
    bad = ["you vile scum", "hateful trash people", "filthy vermin all"]
    good = ["a quiet river bank", "the old stone bridge", "bread and warm soup"]
    data = [(i, f"{(bad if i % 3 == 0 else good)[i % 3 if i % 3 else i // 3 % 3]} number n{i % 17}", None, None, None) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(400))
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.score(empty, model).count() == 0
    assert toxicity.clean_documents(df, model).columns == df.columns


def test_toxicity_without_labels(spark, edge, empty):
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in toxicity.score(edge, model).collect()} == {0}


def best_fit_count(lengths, capacity):
    import bisect

    free = []
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        room = free.pop(k) - x if k < len(free) else capacity - x
        bisect.insort(free, room)
    return len(free)


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_packing(table, request):
    df = request.getfixturevalue(table)
    tok, want = library("byte_bpe_50k.json"), Counter()
    for r in df.select("doc_id", "text").collect():
        ids = ids_of(tok, r.text) + [2]
        a, b, k = 0, len(ids) % 1024 or 1024, 0
        while a < len(ids):
            want[r.doc_id, k, a, b - a, crc(ids[a:b])] += 1
            a, b, k = b, b + 1024, k + 1
    got = packing.packed(df, queries.vocabulary("byte_bpe_50k.json")).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    place = defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for spans in place.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    best = best_fit_count([r.length for r in got], 1024)
    assert len(place) <= best + max(1, best // 50)


def test_hot_shingle_makes_no_pairs(spark, tmp_path):
    """Documents that share a passage but can't be similar: nothing is joined but what can pair."""
    data = [(i, " ".join([*[f"p{j}" for j in range(14)], f"own{i}", f"more{i}"])) for i in range(3000)]
    df = spark.createDataFrame(data, "_rk long, text string")
    ids = df.select(F.col("_rk").alias("rep"), F.col("_rk").alias("comp"), F.lit(13).cast("long").alias("n"))
    assert minhash.rare_pairs(ids, df, 4, 80, f"file://{tmp_path}").count() == 0


def test_packing_short(spark):
    """As few sequences as best-fit decreasing opens, where many short documents share a gap."""
    r = np.random.default_rng(1)
    for lengths in (r.exponential(60, 3000).clip(1, 1024), np.where(r.random(3000) < 0.03, r.integers(520, 1001, 3000), r.integers(10, 41, 3000))):
        lengths = lengths.astype(int).tolist()
        got = packing.pack(spark.createDataFrame([(k, 0, 0, x, k) for k, x in enumerate(lengths)], packing.PIECES)).collect()
        assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
        place = defaultdict(list)
        for row in got:
            place[row.sequence_id].append((row.offset, row.length))
        for spans in place.values():
            ends = [a + n for a, n in sorted(spans)]
            assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024
        assert len(place) == best_fit_count(lengths, 1024)


def test_packing_nothing(empty):
    assert packing.packed(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_sentencepiece(table, request):
    from sentencepiece import SentencePieceProcessor

    df, path = request.getfixturevalue(table), queries.vocabulary("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    got = sentencepiece_scan.encode(df, path, chunk=700)
    want = Counter((r.doc_id, np.asarray(model.encode(r.text or ""), "<u4").tobytes()) for r in df.select("doc_id", "text").collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got.collect()) == want
    assert got.agg(F.max("chunks")).first()[0] > 1
    assert all(r.round_trip for r in sentencepiece_scan.digest(got, path).collect())


def test_html(spark):
    def page(k, url="https://h.example/a"):
        return (k, url, f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class="wrap">
<div class="post-body"><h1>Title {k} &amp; more</h1><p>First <b>bold</b>\n  text&nbsp;{k}.<p>Second &lt;{k}&gt;</p><script>var a="<p>no</p>"</script></div>
<div class="fine">All pages say this.</div></div><footer>foot</footer><div class="comments">nice!</div></body></html>""")

    data = [page(k) for k in range(8)] + [(8, None, None), (9, "", ""), (None, "https://h.example/x", "plain words"), (10, "nonsense", "<p>un<closed")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("low", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for k in range(8):
        assert got[k].text == f"Title {k} & more\n\nFirst bold text {k}.\n\nSecond <{k}>" and got[k].n_chars == len(got[k].text)
    assert got[8].text == "" and got[9].text == "" and got[None].text == "plain words"
    assert len(got) == 12
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_article(spark):
    """The style tree decides inside an article and outside it; copies of a page are no evidence, shared passages stay."""

    def page(head, body, k):
        return f"""<html><body><div class="head">{head}</div><article><h2>Story {body}</h2><p>Text {body}.</p><p>A passage that all share.</p>
<div class="fine">All pages say this.</div></article><div class="long">A long text {body}.</div><footer>foot {k}</footer></body></html>"""

    data = [(k, "https://a.example/x", page(f"Headline {k}", k, k)) for k in range(8)] + [(k, "https://b.example/x", page("Same", "copied", k)) for k in range(8, 16)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"Headline {k}\n\nStory {k}\n\nText {k}.\n\nA passage that all share.\n\nA long text {k}."
        assert got[8 + k] == "Same\n\nStory copied\n\nText copied.\n\nA passage that all share.\n\nAll pages say this.\n\nA long text copied."


def test_html_names_are_evidence_only():
    """Parts of class names and words of an article's headings decide nothing; a named wrapper that holds the content stays, a named side branch goes."""
    text = lambda page: html_extract.main_text(page, {})
    for page, want in [
        ('<article><h2 id="search">Search trees</h2><p>Body one.</p><section id="legal"><h3>Law</h3><p>A real part.</p></section></article>', "Search trees|Body one.|Law|A real part."),
        ('<div class="content has-sidebar"><p>A long text of the page.</p><div class="sidebar">Side.</div></div><div class="ad">Buy.</div>', "A long text of the page."),
        ('<article><div class="article-header"><h1>The title</h1></div><p>Words.</p></article>', "The title|Words."),
        ('<article><h1 class="post-header">The title</h1><p>Words.</p></article>', "The title|Words."),
        ('<article><header class="header"><h1 class="header">The title</h1><p>By one.</p></header><p>Words.</p></article>', "The title|By one.|Words."),
        ('<article><p>Words.</p><section class="legal-history"><p>A part.</p></section></article>', "Words.|A part."),
        ('<article><p>Words and more.</p><div class="article-comments"><h2>Comments</h2><p>Nice!</p></div><aside>Side</aside><div class="ad-slot 1">Buy</div></article>', "Words and more."),
        ('<header><h1>Site</h1></header><main><p>Words.</p></main><div id="comments">Nice!</div><div role="contentinfo">Us</div><footer>Foot</footer>', "Words."),
        ('<form class="page"><article><p>Words in a page that is one form.</p></article></form><form>Name</form>', "Words in a page that is one form."),
        ('<div class="post with-related no-comments"><p>Words.</p></div><div class="related">More</div>', "Words."),
    ]:
        assert text(page) == want.replace("|", "\n\n"), page


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_html_entropy_against_names(spark, monkeypatch, limit):
    """A host's repeated blocks go whether named or not, varied ones stay though weakly named, within an article and outside; both joins agree."""
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limit)

    def page(k, note):
        return f"""<html><body><div class="head">{note}</div><article><header><h1>Story {k}</h1><p>By writer {k}</p></header><p>Text {k}.</p><div class="legal">Terms of case {k}.</div>
<div class="disclaimer">The same for all.</div><div class="fine">All pages say this.</div><div class="ad">Buy number {k}</div></article><div class="footer">Foot</div></body></html>"""

    data = [(k, "https://a.example/x", page(k, "Welcome here")) for k in range(9)] + [(k, f"https://b{k}.example/", page(k, "Welcome here")) for k in range(9, 12)] + [(12, "https://c.example/", None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(data + data[:1], "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k] == f"Story {k}\n\nBy writer {k}\n\nText {k}.\n\nTerms of case {k}."
    for k in range(9, 12):  # a single page tells nothing but its names
        assert got[k] == f"Welcome here\n\nStory {k}\n\nBy writer {k}\n\nText {k}.\n\nTerms of case {k}.\n\nThe same for all.\n\nAll pages say this."
    assert got[12] == "" and len(got) == 13


def test_html_own_class_names(spark):
    """Nodes that only a page or two have aren't listed by host: names decide in the page itself."""
    data = [(k, "https://a.example/x", f'<div class="sidebar-{chr(97 + k % 26)}x{k}"><p>t{k}</p></div><div class="q{chr(97 + k % 26)}{chr(97 + k // 26)} ad">Buy {k}</div><p>Words {k}</p>') for k in range(60)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    assert html_extract.verdicts(pages).count() == 0
    assert {r.text for r in html_extract.extract(pages).collect()} == {f"t{k}\n\nWords {k}" for k in range(60)}


def test_html_takes_linear_time():
    import time

    for page in ("<a " * 300_000, '<a "' * 200_000, '<a b="' * 100_000, "<div>" * 50_000 + "</span2>" * 50_000, '<p class="x' * 50_000):
        began = time.time()
        html_extract.parsed(page)
        assert time.time() - began < 20


def test_html_style_tree_by_brute_force(spark):
    """Importance of every node of a host's merged pages, by a parser of its own (the standard library's) over well-formed pages."""
    import math
    from html.parser import HTMLParser

    def page(k):
        return (f'<nav>Menu</nav><div class="x{k}"><p>Text {k % 5}</p><p>{"more" if k % 2 else "less"}</p></div><div class="legal">Law {k % 2}</div><div class="share">S</div>'
                f'<article>Words {k}<ul><li>one</li>{"<li>two</li>" if k % 3 else ""}</ul></article>')

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.children, self.texts, self.shows = [], defaultdict(list), defaultdict(list), []

        def handle_starttag(self, tag, attrs):
            label = (tag, re.sub("[0-9]+", "0", dict(attrs).get("class", "")))
            here = tuple(self.path)
            if not self.shows or self.children[id(self.path)][-1:] != [label]:
                pass
            self.shows.append(("child", here, label))
            self.path.append(label)

        def handle_endtag(self, tag):
            self.shows.append(("end", tuple(self.path), None))
            self.path.pop()

        def handle_data(self, data):
            self.shows.append(("text", tuple(self.path), data))

    def of(k):
        """Path to (texts, child sequences without repeats) of the nodes with text or a name."""
        t = Tree()
        t.feed(page(k))
        texts, kids = defaultdict(list), defaultdict(list)
        for what, path, x in t.shows:
            if what == "text":
                texts[path].append(x)
            elif what == "child" and kids[path][-1:] != [x]:
                kids[path].append(x)
        named = [p for what, p, _ in t.shows if what == "end" and (p[-1][0] == "nav" or p[-1][1] in ("legal", "share"))]
        return {p: (tuple(texts[p]), tuple(kids[p])) for p in {*texts, *named}}

    data = [(k, "https://h.example/a", page(k)) for k in range(12)] + [(20, "https://h.example/b", page(3))]
    rows = html_extract.style_nodes(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    nodes = defaultdict(list)
    for k in range(12):
        for path, seen in of(k).items():
            nodes[path].append(seen)

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n >= 4 else 1.0

    want = []
    for path, seen in nodes.items():
        x = 0.9 * entropy([c for c, _ in seen]) + 0.1 * entropy([p for _, p in seen]) + (0.15 if path[0][0] == "article" else 0)
        factor = 0.25 if path[-1][0] == "nav" or path[-1][1] == "share" else 0.5 if path[-1][1] == "legal" else 1
        want.append((len(seen), round(x * factor, 6)))
    assert sorted((r.pages, round(r.importance, 6)) for r in rows) == sorted(want)


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_token_files_and_counts(table, request):
    df, tok, path = request.getfixturevalue(table), library("word_bpe_49k.json"), queries.vocabulary("word_bpe_49k.json")
    source = df.select("doc_id", "text").collect()
    ids = [(r.doc_id, ids_of(tok, r.text) + [2]) for r in source]
    got = token_files.token_files(df, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), crc(x)) for d, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is None, d or 0))
    counts = Counter((r.doc_id, len((r.text or "").encode()), len(x) - 1, len(x) - 1 > 2048) for r, (_, x) in zip(source, ids, strict=True))
    assert Counter(map(tuple, token_counts.token_counts(df, path).collect())) == counts


def odd_texts(n, seed=3):
    """Random texts of pieces that tokenizers treat apart."""
    import random

    r = random.Random(seed)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "'", "é", "É", "1", "23", ".", "!?", "<|endoftext|>", "<|endof", "text|>", "<|", "日本", "😀", "\u0301", "\xa0", "İ", "\u2028",
             "\r\n", "don't", "_", "ſ", "Ⅷ", "\x1c", "\x85", "ß", "µ", "²", "ΑΣ", "the", "(word)", "DENİZCİ.", "GEZİ, ANKARA", "e\u0301"]
    return ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(n)]


def test_ids_are_the_library_s():
    """Every code point in two contexts by tens, and random texts."""
    import numpy

    from skeinwork.llm.units import ByteIds, WordIds

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 10 == 0)]
    texts = [f"a{chr(c)}b. {chr(c)} 1{chr(c)}A{chr(c)}." for c in points] + odd_texts(8000) + ["\n \t" * 400_000]
    for kind, name in ((ByteIds, "byte_bpe_50k.json"), (WordIds, "word_bpe_49k.json")):
        own, lib = kind(queries.vocabulary(name)), library(name)
        for a in range(0, len(texts), 1000):
            want = lib.encode_batch(texts[a : a + 1000], add_special_tokens=False)
            for t, w in zip(texts[a : a + 1000], want, strict=True):
                got = own.of(t)
                assert (got.tolist() if kind is ByteIds else numpy.frombuffer(got, own.dtype).tolist()) == w.ids, t


def test_counts_of_odd_texts():
    counter, lib = token_counts.Counts(queries.vocabulary("word_bpe_49k.json")), library("word_bpe_49k.json")
    for t in [*odd_texts(4000, 5), "DENİZCİ.", "İ?"]:
        assert counter.of(t) == len(ids_of(lib, t)), t
    assert counter.of("DENİZCİ.") == 8


def test_token_files_are_read_from_their_folder_alone(docs, spark, tmp_path):
    folder, path = f"file://{tmp_path}", queries.vocabulary("word_bpe_49k.json")
    token_files.write_token_files(docs, path, folder)
    lib = library("word_bpe_49k.json")
    want = {(r.doc_id, crc(ids_of(lib, r.text) + [2])) for r in docs.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.ids_crc32) for r in token_files.read_token_files(spark, folder).collect()} == want


def test_variable_length_coding():
    ranks = np.asarray([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(ranks) + 1):
        control, data = token_files.encode(ranks[:n])
        assert (token_files.decode(control, data, n) == ranks[:n]).all() and len(control) == -(-n // 4)


def test_nothing_in_nothing_out(empty):
    path = queries.vocabulary("word_bpe_49k.json")
    for out in (token_files.token_files(empty, path), token_counts.token_counts(empty, path), media.media_columns(empty), minhash.near_duplicates(empty),
                substring_dedup.substring_digest(empty), quality_rules.quality_table(empty), sentencepiece_scan.encode(empty, queries.vocabulary("piece_bpe_32k.model"))):
        assert out.count() == 0


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_quality_rules(table, request):
    df = request.getfixturevalue(table)
    got = quality_rules.quality_table(df)
    base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted((x for r in df.select("doc_id", "text").collect() for x in quality_brute({r.doc_id: r.text})), key=repr)
    assert rows(base) == want
    assert not got.where("kept AND base_failed").count()
    assert quality_rules.kept_documents(df).columns == df.columns


@pytest.mark.parametrize("table", ["docs", "unique"])
def test_substring_dedup(table, request):
    df = request.getfixturevalue(table)
    for batches in (1, 3):
        assert rows(substring_dedup.substring_digest(df, batches)) == substring_brute(texts(df))


def test_substring_dedup_keeps_columns(edge, docs):
    for df in (docs, edge):
        out = substring_dedup.deduplicated(df)
        assert out.columns == df.columns and out.count() == df.count()
    assert substring_dedup.substring_digest(edge).count() == len(EDGE)


def test_index_is_opened_again(spark, tmp_path):
    """Each batch by an index that is opened from the folder; runs are merged on the way."""
    data = [(i, " ".join(f"t{(i * 7 + j) % 40 if i % 3 else i * 1000 + j}" for j in range(50))) for i in range(20)]
    found, gone = set(), {}
    for a in range(0, 20, 5):
        index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index")
        assert index.step == a // 5 and len(index.files) == a // 5 and len(index.runs) <= substring_dedup.MAX_RUNS
        for r in index.add(spark.createDataFrame(data[a : a + 5], "_rk long, text string"), a).collect():
            found |= {(r.rk, r.pos + k) for k in range(substring_dedup.RUN) if r.bits >> k & 1}
    for d, t in data:
        w = words(t)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in gone:
                assert (d, i) in found
            else:
                assert (d, i) not in found
                gone[tuple(w[i : i + 20])] = 1


def test_index_levels(spark, tmp_path):
    """One run a level, as many as the number of batches has binary ones; old runs go, keys can't come twice, empty batches do no harm."""
    folder = f"file://{tmp_path}/levels"
    for k in range(9):
        index = substring_dedup.FingerprintIndex(spark, folder)
        text = " ".join(f"a{k}b{j}" for j in range(60))
        index.add(spark.createDataFrame([(10 * k, text)] if k != 4 else [], "_rk long, text string"), 10 * k)
        assert len(index.runs) == bin(k + 1).count("1") and len({r.split("-")[1] for r in index.runs}) == len(index.runs)
        left = {p.name for p in (tmp_path / "levels").iterdir() if p.name.startswith("run-")}
        assert left == set(index.runs)
        assert substring_dedup.FingerprintIndex(spark, folder).next == (10 * k + 1 if k != 4 else 40)
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, folder).add(spark.createDataFrame([(3, "x")], "_rk long, text string"), 3)


def by_place(spark, df):
    """Texts by place in the order of (id, nulls last, hash of the text), and each place's id."""
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    return dict(enumerate(r.text for r in rows)), [r.doc_id for r in rows]


def test_repeated_and_missing_ids(spark, edge):
    """Rows that repeat an id, or have none, are rows of their own, in a defined order."""
    texts_of, ids = by_place(spark, edge)
    near = Counter((ids[d], n, ids[c], kept) for d, n, c, kept in near_brute(texts_of, 4))
    assert Counter(tuple(r) for r in minhash.near_duplicates(edge, shingle=4).drop("_rk").collect()) == near
    assert Counter(tuple(r) for r in substring_dedup.substring_digest(edge).collect()) == Counter((ids[d], *x) for d, *x in substring_brute(texts_of))


def test_index_compaction(spark, tmp_path):
    """Many small batches, with compaction, find what one batch finds."""
    data = [(i, " ".join(f"t{(i * 7 + j) % 40 if i % 3 else i * 1000 + j}" for j in range(50)), None, None, None) for i in range(21)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(substring_dedup.substring_digest(df, 7)) == substring_brute(texts(df))


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_media(table, request):
    df = request.getfixturevalue(table)
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        want[r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    out = media.media_columns(df, with_media=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by_text = {}
    for r in out:
        assert len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.fingerprint) == r.n_pairs
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        assert list(r.fingerprint) == sorted(r.fingerprint)


def test_fingerprint_by_brute_force():
    """Peaks and pairs from the definition of the transform, for a few frames."""
    data = media.padded(("Some text, with words and signs! " * 60).encode())
    x = np.frombuffer(data, np.uint8).astype(float) - 128
    peaks = []
    for t in range(len(x) // 576):
        frame = x[t * 576 : (t + 1) * 576] * np.hanning(576).astype(np.float32)
        power = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576) @ frame)
        local = [(-power[b], b) for b in range(1, 288) if power[b] > power[b - 1] and power[b] >= power[b + 1]]
        peaks.append({b for _, b in sorted(local)[:3]})
    want = sorted(t << 22 | a << 12 | b << 2 | d for t in range(len(peaks)) for d in (1, 2) if t + d < len(peaks) for a in peaks[t] for b in peaks[t + d])
    assert media.fingerprint(data).tolist() == want


def test_toxicity_forward_pass_by_brute_force():
    """A score from embeddings of single words, every place and filter in turn; and what the sample is bounded by."""
    r = np.random.default_rng(5)
    width = sum(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Model(r.normal(0, 1, (toxicity.BUCKETS, width)).astype(np.float32), [r.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
                           r.normal(0, 1, 3 * toxicity.FILTERS).astype(np.float32), 0.1, np.full(5, toxicity.CUT))
    for text in (b"", b"one", b"two words", b"the man and the sea, of all that is old!"):
        w = toxicity.Words(model.project)
        hits = [w.subs[w[x]] for x in text.split()]
        maxima, col = [], 0
        for k, n in enumerate(toxicity.WIDTHS):
            at = [sum(model.project[b][col + j * toxicity.FILTERS : col + (j + 1) * toxicity.FILTERS] for j in range(n) for b in hits[p + j]) + model.bias[k] for p in range(len(hits) - n + 1)]
            maxima.append(np.max([np.zeros(toxicity.FILTERS), *at], 0))
            col += n * toxicity.FILTERS
        want = 1 / (1 + np.exp(-(np.concatenate(maxima) @ model.weights + 0.1)))
        assert model.scores(toxicity.Words(model.project), [text])[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((texts, y.tolist())))
    df = spark.createDataFrame([(i % 20, f"text {i % 40}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, int(i == 3)) for i in range(60)], "doc_id long, toxic int")
    toxicity.train(df, labels)
    toxicity.train(df, labels, max_train=5)
    toxicity.train(df, labels, max_bytes=20)
    out = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(seen[0][0]) == len(out) and sum(seen[0][1]) == int(3 in out) and len(seen[1][0]) == 5 and 0 < sum(map(len, seen[2][0])) <= 20


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_pipeline_stages_on_edge_cases(spark, edge, empty, sf_dir):
    import corpus_pipeline

    for df in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns and out.count() <= df.count()
        packed = corpus_pipeline.STAGES[4][1](spark, df, sf_dir)
        assert packed.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
        assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > 1024).count() == 0


def test_toxicity_across_chunks(monkeypatch):
    """A text cut into chunks scores as it does whole, wherever the cuts fall."""
    r = np.random.default_rng(8)
    words_ = [f"w{k}" for k in range(60)]
    rows_ = [(" ".join(r.choice(words_, 40)) + (" bad worse worst" if k % 4 == 0 else "")).encode() for k in range(200)]
    model = toxicity.fit(rows_, np.asarray([k % 4 == 0 for k in range(200)]).astype(int))
    texts_ = [b" ".join([*t.split()] * 9) for t in rows_[:20]] + [b"bad worse", b""]
    whole = model.scores(toxicity.Words(model.project), texts_)
    for chunk in (1, 2, 3, 40, 119, 120):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(model.scores(toxicity.Words(model.project), texts_), whole, atol=1e-6)


def test_pipeline(spark, sf_dir):
    """Stages take effect in order; the last one's pieces are those of all that stage 4 returns."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, ids = docs, texts(docs)
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns
        left = texts(now)
        assert set(left) <= set(ids)
        ids = left
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)
    tok = library("byte_bpe_50k.json")
    assert packed.agg(F.sum("length")).first()[0] == sum(len(ids_of(tok, t)) + 1 for t in ids.values())


def test_letters_are_one_part(monkeypatch):
    """A piece of letters alone is looked up as it is, without a search for parts; the ids are the library's."""
    from skeinwork.llm import queries as llm_queries
    from skeinwork.llm import units

    words = units.WordIds(llm_queries.vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(units, "_PARTS", None)  # before, every piece went through it
    for text in ("Theranble", "ÀÖØöøÿ straße", "BEGELICH und ndhath"):
        assert list(np.frombuffer(words.of(text), words.dtype)) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_merge_many_pieces_in_a_call():
    import sys
    from unittest.mock import MagicMock

    import pyarrow as pa

    frame = MagicMock()
    path = queries.vocabulary("word_bpe_49k.json")
    token_files.encode_texts(frame, path)
    task = frame.select.return_value.mapInArrow.call_args[0][0]
    rng = np.random.default_rng(5)
    new = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéß.,$1"), 9)) for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([" ".join(new), None])], names=["doc_id", "text"])
    list(task(iter([batch.slice(1)])))  # loads the file
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event.endswith("call") else None)
    try:
        (out,) = list(task(iter([batch])))
    finally:
        sys.setprofile(None)
    assert len(calls) < len(new)  # before, several for each new piece
    want = [*ids_of(library("word_bpe_49k.json"), " ".join(new)), 2]
    assert out.column("n").to_pylist() == [len(want), 1]
    assert np.frombuffer(out.column("ids")[0].as_py(), "<u2").tolist() == want and out.column("ids")[1].as_py() == b"\x02\x00"


def test_runs_are_the_library_s(monkeypatch):
    import pyarrow as pa

    from skeinwork.llm.units import WordRuns

    runs, tok = WordRuns(queries.vocabulary("word_bpe_49k.json")), library("word_bpe_49k.json")
    signs = "".join(map(chr, range(0x21, 0x180)))
    texts = [None, "", " \n ", *odd_texts(300), *signs, signs, "a\x00b \x00 \x01 a\x01", "a" * 64 + " " + "é" * 33, "L'ÉTÉ d'été 'tis it's", LONG, LONG.upper()]
    for ranks in (runs.ranks, {}):  # without ranks every piece is looked up
        monkeypatch.setattr(runs, "ranks", ranks)
        ids, n = runs.of(pa.array(texts))
        ends = np.cumsum(n)
        for t, a, b in zip(texts, ends - n, ends, strict=True):
            assert ids[a:b].tolist() == ids_of(tok, t or "")


def test_every_string_of_the_file_is_merged_as_by_the_library():
    import pyarrow as pa

    from skeinwork.llm.units import WordRuns, word_ranks

    runs, tok = WordRuns(queries.vocabulary("word_bpe_49k.json")), library("word_bpe_49k.json")
    words = [w.decode(errors="ignore").strip("\x00") for w in word_ranks(tok)]
    words = [w for w in words if w and not set(w) & set(" \n\x00\x01")]
    rng = np.random.default_rng(6)
    words += ["".join(words[k] for k in rng.integers(0, len(words), 3)) for _ in range(20_000)]
    ids, n = runs.of(pa.array([" ".join(words)]))
    assert n.tolist() == [len(ids)] and ids.tolist() == ids_of(tok, " ".join(words))


def test_no_ranks_where_they_don_t_say_what_is_merged():
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    from skeinwork.llm.units import byte_alphabet, word_ranks

    alphabet = byte_alphabet()
    vocab = {w: k for k, w in enumerate([*alphabet, *[c + "</w>" for c in alphabet], "ab", "bc", "abc"])}
    merges = [("a", "b"), ("b", "c"), ("a", "bc")]  # in a-b-c the first comes first, so abc never comes up
    ranks = word_ranks(Tokenizer(BPE(vocab, merges, end_of_word_suffix="</w>")))
    assert b"ab" in ranks and b"bc" in ranks and b"abc" not in ranks
    assert word_ranks(Tokenizer(BPE(vocab, [*merges[::-1]], end_of_word_suffix="</w>"))) is None  # ids in another order
    assert word_ranks(Tokenizer(BPE(vocab, [*merges, ("ab", "c")], end_of_word_suffix="</w>"))) is None  # two ways
    assert word_ranks(Tokenizer(BPE(vocab, merges))) is None


def test_variable_length_coding_of_many_documents():
    n = np.asarray([1, 4, 5, 1, 7, 300])
    ranks = np.random.default_rng(7).choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n.sum()).astype(np.uint32)
    control, data, size = token_files.encode_all(ranks, n)
    c, d, a = 0, 0, 0
    for k, s in zip(n.tolist(), size.tolist(), strict=True):
        one = control[c : c + -(-k // 4)].tobytes(), data[d : d + s].tobytes()
        assert one == token_files.encode(ranks[a : a + k]) and (token_files.decode(*one, k) == ranks[a : a + k]).all()
        c, d, a = c + -(-k // 4), d + s, a + k
    assert (c, d) == (len(control), len(data))
    assert (token_files.decode_all(control.tobytes(), data.tobytes(), n) == ranks).all()


def test_batches_by_bytes():
    import pyarrow as pa

    from skeinwork.llm.common import few_bytes

    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 9, "c", "", "dd", "ee"])], names=["t"])
    got = [x.column(0).to_pylist() for x in few_bytes([batch.slice(0, 0), batch], 0, 4)]
    assert got == [["aa", None], ["b" * 9], ["c", "", "dd"], ["ee"]]
