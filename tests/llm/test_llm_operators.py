"""Each operator against a brute-force version on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, mixing, ngrams, pages, pieces, queries, sharding, substrings, toxicity, urls, vectors

WORDS = [w + e for w in "alder birch cedar elm fir hazel larch maple oak pine rowan willow".split() for e in ("", "s", ".", "-a", "é")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, bundle string, `a.b` int"


def make_docs(seed=3, n=70):
    """Random texts with copies, near copies, shared passages, nulls, blanks and one long text; clashing extra columns."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(k)]
    base, passage = words(160), words(70)
    texts = [None, "", " \n\t ", "one two", "one two", "One TWO", "x y z q", " ".join(words(6000))]
    for i in range(n):
        kind, own = i % 7, words(rng.randint(5, 150))
        if kind == 0:
            own = base
        elif kind == 1:
            own = [w if rng.random() > 0.02 else "edit" + str(rng.randint(0, 999)) for w in base]
        elif kind == 2:
            own = own[:60] + passage + own[60:]
        elif kind == 3:
            own = own + passage[:rng.randint(48, 52)] + own
        texts.append(rng.choice([" ", "  ", "\n", "\x0b"]).join(own))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    sources = [rng.choice(["a", "b", "B", "hot", "hot", "hot", None]) for _ in texts]
    return [(i, t, "en", s, len(t or ""), "k", 1, "b", 2) for i, t, s in zip(ids, texts, sources)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = make_docs()
    rows.append(rows[10])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def listed(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def words_of(text):
    return (text or "").encode().split()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(1, None), (7, 7)]
    u = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    got = dict(listed(common.components(spark.createDataFrame(edges, "a int, b int")), "node", "component"))
    assert got == {x: u.find(x) for x in list(u.up)}
    assert common.components(spark.createDataFrame([], "a int, b int")).count() == 0


def shares(sizes, weights=(5, 2, 1), most=3):
    """Water filling in exact fractions, capping round by round."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), Fraction(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        if not over:
            return target | {s: level * w[s] for s in open_}
        open_ -= over
    return target


def test_mixing(docs, empty):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words_of(r.text))
    want = shares(sizes)
    out = mixing.op1(docs).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in rows}
    taken = defaultdict(int)
    for r in out:
        d = by_id[r.doc_id]
        assert r["size"] == len(words_of(d.text)) and r.source_size == sizes[d.source]
        assert r.target == pytest.approx(float(want[d.source]), rel=1e-12)
        assert r.taken in [r["size"] * k for k in range(4)]
        rate = float(want[d.source] / sizes[d.source]) if sizes[d.source] else 0
        assert not r["size"] or int(rate) <= r.taken // r["size"] <= int(rate) + 1
        taken[d.source] += r.taken
    assert listed(mixing.op1(docs.repartition(7)).orderBy("doc_id"), "doc_id", "taken") == sorted((r.doc_id, r.taken) for r in out)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.op1(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_draws_are_fair(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = mixing.op1(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.03 * r.g for r in got)


def test_sharding(docs, empty):
    out = sharding.op2(docs).collect()
    rows = docs.collect()
    by_id = {r.doc_id: r.text for r in rows}
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows)
    bytes_, slots = defaultdict(int), defaultdict(list)
    for r in out:
        raw = (by_id[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    total, largest = sum(bytes_.values()), max(r["size"] for r in out)
    assert all(0 <= s < 40 and abs(b - total / 40) <= largest for s, b in bytes_.items())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.op2(empty).count() == 0


def test_shards_of_one_key_spread(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    n = [r["count"] for r in sharding.op2(rows).groupBy("shard").count().collect()]
    assert len(n) == 40 and max(n) - min(n) <= 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">{0}</a></li><li>b</li></ul></nav><!-- ad --><div class="ad">{1} ad</div>{2}<footer>&copy; x &middot; {1}</footer></body></html>"""


def test_html_articles():
    article = "<article><h1>Head {0} &amp; more</h1><p><b>First\n  {0}.<br><p>Second &lt;{0}&gt; <i>in</i>line.</p><form><input>name</form><ul><li>item<li>{0}</ul><div class='comments'><p>nice</p></div></article>"
    texts = pages.extract_group([PAGE.format(f"m{i}", f"v{i}", article.format(i)) for i in range(5)])
    assert texts == [f"Head {i} & more\n\nFirst {i}.\n\nSecond <{i}> inline.\n\nitem\n\n{i}" for i in range(5)]


def test_html_without_marks_uses_the_template():
    body = "<div id='top'>Site name</div><div><h2>Story {0}</h2><p>Text of {0} that varies, {0} {0} and goes on for a while</p><p>Read all our terms</p></div>"
    texts = pages.extract_group([PAGE.format("m", "v", body.format(f"w{i}")) for i in range(6)])
    assert texts == [f"Story w{i}\n\nText of w{i} that varies, w{i} w{i} and goes on for a while" for i in range(6)]


def test_html_copies_keep_their_text():
    one = PAGE.format("m", "v", "<article><h1>Same</h1><p>Copied text.</p></article>")
    assert pages.extract_group([one] * 6) == ["Same\n\nCopied text."] * 6


def test_html_bad_markup():
    odd = [None, "", "plain &am", "<p>cut <b", "</div></p>x</nav>y", "<div>" * 3000 + "deep", "a < b && c > d", "<article>t", "<script>never closed", "<p>a&nbsp;b\t\tc</p>d"]
    got = pages.extract_group(odd)
    assert got[0] == got[1] == "" and got[2] == "plain &am" and got[3] == "cut" and got[7] == "t" and got[8] == "" and got[9] == "a b c\n\nd"


def test_html_template_text_in_articles():
    """A call to action in every article goes; articles of other lengths and copies of one article keep all their text."""
    say = lambda i: "".join(f"<p>Line {i} {k} of its own story {i * k}</p>" for k in range(2 + i % 3))
    page = "<body><article><h1>Head {0}</h1>{1}<p>Please support our free work today</p></article></body>"
    want = lambda i: "\n\n".join([f"Head {i}", *[f"Line {i} {k} of its own story {i * k}" for k in range(2 + i % 3)]])
    assert pages.extract_group([page.format(i, say(i)) for i in range(6)]) == [want(i) for i in range(6)]
    near = [page.format(0, say(4)) + f"<p>{i}" for i in range(6)]
    assert all("Please support" in t and "Line 4 2" in t for t in pages.extract_group(near))


def test_html_long_lists_and_deep_trees_align():
    rows = lambda i, more: "<ul><li>new</ul>" * more + "".join(f"<p>Words {i} {k}</p>" if k % 2 else f"<pre>Code {i} {k}</pre>" for k in range(400))
    body = "<body><div>Top of the site</div><div>{0}<h4>All rights are kept here</h4></div></body>"
    texts = pages.extract_group([body.format(rows(i, i % 2)) for i in range(5)])
    assert not any("rights" in t or "Top" in t for t in texts) and all(f"Words {i} 399" in t and f"Code {i} 0" in t for i, t in enumerate(texts))
    deep = "<body>" + "<div>" * 600 + "<h2>Tale {0}</h2><p>Long tale of {0} {0} {0} {0}</p><p>Our terms for all readers</p>"
    assert pages.extract_group([deep.format(f"x{i}") for i in range(5)]) == [f"Tale x{i}\n\nLong tale of x{i} x{i} x{i} x{i}" for i in range(5)]


def test_html_matching_is_exact(monkeypatch):
    """Halved lists give the size of the whole table, which is the longest common one of equal-named leaves."""
    rng = np.random.default_rng(5)
    for cells in (1_000_000, 4):
        monkeypatch.setattr(pages, "TABLE_CELLS", cells)
        for _ in range(20):
            a, b = [[str(t) for t in rng.choice(["i", "b", "u"], rng.integers(0, 12))] for _ in range(2)]
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (x == y))
            trees = [pages.parse("".join(f"<{t}></{t}>" for t in x)) for x in (a, b)]
            aligner = pages.Aligner()
            for t in trees:
                aligner.number(t)
            assert len(aligner.pairs(*trees)) == aligner.size(trees[0].shape, trees[1].shape) == 1 + table[-1][-1]


def test_html_all_articles_and_named_sections():
    two = "<main><h1>Title</h1><p>Lead.</p><article>One.</article><article>Two.</article></main>"
    assert pages.extract_group([two, "<article>A</article><div>b</div><article>C</article>"]) == ["Title\n\nLead.\n\nOne.\n\nTwo.", "A\n\nC"]
    named = "<article><h2 id='discussion'>Discussion</h2><section class='related-work'><p>Others did so.</p></section><div class='share'><a>Share</a></div></article>"
    assert pages.extract_group([named]) == ["Discussion\n\nOthers did so."]


def built_page(rng, host, i, kind):
    """A page whose article is known by construction, and that article: comments, adverts, related links, notices around and inside it."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "light", "paper", "glass", "field", "north", "quiet"]) + str(rng.randint(0, 99)) for _ in range(n))
    title, parts = f"Title {host} {i} {words(3)}", []
    for k in range(rng.randint(2, 5)):
        parts.append(("p", f"Story {host} {i} {k} {words(rng.randint(8, 30))}"))
        if k == 1:
            parts += [("h2", "References and further reading"), ("p", f"Sources {host} {i} {words(9)}")]
    article = f"<h1>{title}</h1>" + "".join(f"<{t}>{x}</{t}>" + ("<div class='advert'><p>Buy our best goods now</p></div>" if k == 0 else "") for k, (t, x) in enumerate(parts))
    thread = "".join(f"<div class='comment'><p>Reader {words(3)} says {words(6)}</p></div>" for _ in range(rng.randint(1, 4)))
    comments = {0: f"<section class='comments'><h3>Comments</h3>{thread}</section>", 1: f"<div id='disqus_thread'>{thread}</div>", 2: f"<section id='discussion'><h3>Replies</h3>{thread}</section>"}[i % 3]
    related = f"<div class='related'><h3>More to read</h3><ul><li><a>{words(4)}</a></li><li><a>{words(5)}</a></li></ul></div>"
    cookie = "<div class='cookie-consent'><p>We use cookies to make things better.</p></div>"
    top = f"<header><h2>Site Name Of {host}</h2><nav><a>Home</a></nav></header>{cookie}"
    inner = {"article": f"<article>{article}{related}{comments}</article>", "main": f"<main>{article}</main>{related}{comments}", "bare": f"<div class='with-sidebar'><div class='text'>{article}</div><div class='sidebar'><p>{words(6)}</p></div></div>{comments}"}[kind]
    return f"<html><body class='has-sidebar no-comments'>{top}{inner}<footer><p>All rights {host}</p></footer></body></html>", "\n\n".join([title, *[x for _, x in parts]])


@pytest.mark.parametrize("kind", ["article", "main", "bare"])
@pytest.mark.parametrize("pages_of_host", [1, 6])
def test_html_pages_of_known_articles(kind, pages_of_host):
    """Dozens of generated pages, alone and by host: all text of the article, its recurring headings too, and nothing else."""
    rng = random.Random(f"{kind}{pages_of_host}")
    for host in range(8):
        html, want = zip(*[built_page(rng, f"h{host}", i, kind) for i in range(pages_of_host)])
        got = pages.extract_group(list(html))
        if kind == "bare" and pages_of_host > 1:  # without marks, text at the same place of most pages is template by the method
            want = [w.replace("References and further reading\n\n", "") for w in want]
            got = [g.replace("References and further reading\n\n", "") for g in got]
        assert got == list(want)


def test_html_of_millions_of_characters():
    body = "".join(f"<p>Line {k} of a very long page, with some more words</p>" for k in range(60_000))
    text = pages.extract_group([f"<body><header>Top</header><article><h1>Long</h1>{body}</article></body>"])[0]
    assert len(text) > 2_500_000 and text.startswith("Long\n\nLine 0 of") and text.count("\n\n") == 60_000


def test_html_groups_of_a_host_share_one_verdict(spark):
    """However a host is cut, its pages' texts are those of one group; copies that fill whole groups are no template."""
    say = lambda i: "".join(f"<p>Line {i} {k} of its own story {i * k}</p>" for k in range(2 + i % 3))
    marked = "<body><div>Top of the site</div><article><h1>Head {0}</h1>{1}<p>Please support our free work today</p></article></body>"
    bare = "<body><div>Top of the site</div><div>{1}<h4>All rights are kept here</h4></div></body>"
    rows = [(i, f"http://{h}.org/{i}", form.format(i, say(i))) for h, form in (("marked", marked), ("bare", bare)) for i in range(60)]
    rows += [(i, f"http://same.org/{i}", marked.format(1, say(1))) for i in range(30)] + [(0, "http://few.org/", bare.format(1, "")), (None, None, None), (1, "http://marked.org/1", rows[1][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole, cut = [sorted(map(str, listed(pages.extract(table, n), "page_id", "url", "text"))) for n in (1000, 7)]
    assert cut == whole and len(whole) == len(rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in pages.extract(table, 7).collect()}
    for i in range(60):
        story = "\n\n".join(f"Line {i} {k} of its own story {i * k}" for k in range(2 + i % 3))
        assert texts[i, f"http://marked.org/{i}"] == f"Head {i}\n\n{story}" and texts[i, f"http://bare.org/{i}"] == story
    assert "Please support" in texts[3, "http://same.org/3"]


def test_html_query(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format("m", f"v{i}", f"<article><p>t {i}</p></article>"), 1) for i in range(9)] + [(9, None, None, 1), (9, None, None, 1)]
    got = pages.op3(spark.createDataFrame(rows, "page_id long, url string, html string, host int"))
    assert sorted(listed(got, "page_id", "text", "n_chars")) == sorted([(i, f"t {i}", 3) for i in range(9)] + [(9, "", 0)] * 2)
    assert pages.op3(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_words_that_agree_in_48_bits_do_not_link(spark):
    """Five of seven shingles are no link; the two that differ begin with words whose hashes agree in 48 bits."""
    rows = [(1, "eyxif c1 c2 c3 c4 c5 c6 c7 c8 c9"), (2, "a0gsa c1 c2 c3 c4 c5 c6 c7 c8 c9")]
    got = ngrams.op8(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(listed(got, "doc_id", "n_shingles", "component_id")) == [(1, 6, 1), (2, 6, 2)]


def test_shingles_that_share_one_hash_differ_by_the_other():
    x = np.array([[1, 2, 3, 3], [5, 6, 7, 8]], np.uint64)
    y = np.array([[1, 2, 3, 4], [5, 9, 8, 1]], np.uint64)
    assert ngrams._shared(x, y) == 2
    assert ngrams._intersections([x, y], [y, x]).tolist() == [[2, 4], [4, 2]]


def make_vectors():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 8))
    x = [rng.normal(size=8) for _ in range(150)] + [centre[i % 4] + 0.12 * rng.normal(size=8) for i in range(120)] + [centre[0]] * 30 + [2 * centre[0], -centre[1], np.zeros(8)]
    rows = [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)]
    bad = [None, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [], [1.0, 2.0], [2.0, 4.0]]
    return rows + [(400 + i, b, None) for i, b in enumerate(bad)]


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame(make_vectors(), "vec_id long, embedding array<double>, label int").repartition(3)


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 37])
def test_top_k(embeddings, block):
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, _ in make_vectors() if good(v)]
    want = []
    for q, x in rows:
        if q % 100 == 0:
            scored = sorted((-int(x @ y), i) for i, y in rows if i != q and len(y) == len(x))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    v = embeddings.select("vec_id", "embedding")
    got = vectors.op4(embeddings) if block == 4096 else vectors.top_k(v, v.where("vec_id % 100 = 0"), block_rows=block, block_queries=2)
    assert sorted(listed(got, "query_id", "rank", "vec_id", "score")) == sorted(want)


def test_threshold_search_stops_early():
    rng = np.random.default_rng(0)
    x = np.rint(rng.normal(size=(3000, 3)) * 1000)  # few dimensions: the bound bites
    lists = vectors.SortedLists(np.arange(3000), x)
    q = np.array([900.0, -700.0, 3.0])
    ids, scores, read = lists.top(q, -1, 5)
    assert read < 1500
    order = np.lexsort((np.arange(3000), -(x @ q)))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist()


@pytest.mark.parametrize("limits", [None, (40, 30, 50), (8, 100, 70), (10_000, 400, 400)])
def test_near_vectors(embeddings, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(vectors, "CELL_ROWS", limits[0])
        monkeypatch.setattr(vectors, "HOME_ROWS", limits[1])
        monkeypatch.setattr(vectors, "OTHER_ROWS", limits[2])
    rows = {i: np.array(v, float) for i, v, _ in make_vectors() if good(v) and any(v)}
    u, n = Union(), defaultdict(int)
    for a, b in combinations(rows, 2):
        x, y = rows[a], rows[b]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            u.join(a, b)
            n[a] += 1
            n[b] += 1
    want = sorted((i, n[i], u.find(i), u.find(i) == i) for i, _, _ in make_vectors())
    assert sorted(listed(vectors.op6(embeddings), "vec_id", "n_links", "component_id", "kept")) == want


def test_vectors_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert vectors.op4(none).count() == 0 and vectors.op6(none).count() == 0


TEXTS = [None, "", " ", "   ", "  a  b ", "a\n\nb\t c <s> </s> <0x41> 😀 \x00x", "①" * 9, "a" * 700, "the " * 40, "▁x ▁ ▁▁y", "é　x", "人間" * 200, "x\n y \n\nz", "\n", "\nab"]


def test_pieces_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdefe  \n.,éß人1230<>▁") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = []
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(listed(pieces.op5(rows), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want
    got = pieces.encode(rows).where("doc_id = 4").first()
    assert got.ids == sp.encode(TEXTS[4], add_bos=True, add_eos=True) and got.decoded == TEXTS[4]
    assert pieces.op5(rows.limit(0)).count() == 0


def test_long_words_match_the_library():
    """Words far beyond reach, of all kinds: the same ids as the library's one merge at a time."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    c = pieces.PieceCoder(pieces.model_path())
    rng = random.Random(7)
    english = "thequickbrownfoxjumpsoverthelazydoginternationalizationtheretheatinge"
    kinds = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ab", "the", "aeiou人間①é", english, "ACGT", "0123456789abcdef", "-=*/"]
    texts = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (60, 66, 67, 68, 130, 300, 2500)]
    texts += ["a" * n for n in (66, 67, 68, 1000, 5001)] + [("the" * 700), " " * 900 + "x" + " " * 70, english * 40, "▁" * 333]
    texts += ["".join(rng.choice(["the", "ing", "tion", "ther", "ation", "x", "str", "ere"]) for _ in range(800)) for _ in range(20)]
    for t, ids in zip(texts, c.encode_batch(texts)):
        assert ids.tolist() == sp.encode(t, add_bos=True, add_eos=True), t[:40]


def test_word_hashes_depend_on_the_word_alone():
    from quillon.llm.words import Words
    import pyarrow as pa

    words = ["a", "ab", "a\0", "\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "x" * 64, "x" * 65, "x" * 66, "é" * 40, "b" * 16, "b" * 17, "b" * 63]
    a, b = Words(pa.array([" ".join(words)])), Words(pa.array([f"zz {w}\n" for w in words]))
    for k in (0, 1):
        assert len(set(a.hashes[k].tolist())) == len(words) and a.hashes[k].tolist() == b.hashes[k][1::2].tolist()


def test_piece_cache_restarts(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 5)
    c = pieces.PieceCoder(pieces.model_path())
    a = [x.tolist() for t in ("one two three", "four five six seven", "one two") for x in c.encode_batch([t])]
    monkeypatch.setattr(pieces, "CACHE_WORDS", 1000)
    assert a == [x.tolist() for x in pieces.PieceCoder(pieces.model_path()).encode_batch(["one two three", "four five six seven", "one two"])]


def test_cover_has_every_difference():
    d = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert d == set(range(substrings.PERIOD))


def repeated(rows, window=50):
    """(doc_id, text) -> kept words, by all windows."""
    low = {}
    for i, t in rows:
        ws = words_of(t)
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k:k + window])
            low[w] = min(low.get(w, i), i)
    out = []
    for i, t in rows:
        ws = words_of(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if low[tuple(ws[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, ws, gone))
    return out


@pytest.mark.parametrize("size", [4 << 20, 3000])
def test_substrings(docs, empty, size, monkeypatch):
    monkeypatch.setattr(substrings.B.pack, "__defaults__", (size,))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest()) for i, ws, gone in repeated(rows)]
    assert sum(w[2] for w in want) > 1000
    assert sorted(listed(substrings.op7(docs), "doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(want)
    kept = substrings.dedup_substrings(docs)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id, words_of(r.text)) for r in kept.collect())
    assert texts == sorted((i, [w for w, g in zip(ws, gone) if not g]) for i, ws, gone in repeated(rows) if not ws or not all(gone))
    assert substrings.op7(empty).count() == 0


def test_substrings_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = substrings.op7(spark.createDataFrame([(None, text), (None, text), (5, text)], "doc_id long, text string"))
    assert sorted(listed(got, "n_removed")) == [(0,), (60,), (60,)]


def linked(rows, size=5):
    sets = {}
    for k, (_, t) in enumerate(rows):
        ws = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words_of(t)]
        sets[k] = {tuple(ws)} if 0 < len(ws) < size else {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)}
    u = Union()
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            u.join(a, b)
    low = {}
    for k in sets:
        if rows[k][0] is not None:
            low[u.find(k)] = min(low.get(u.find(k), rows[k][0]), rows[k][0])
    return [(rows[k][0], len(sets[k]), low.get(u.find(k))) for k in sets]


@pytest.mark.parametrize("crowd", [48, 3])
def test_ngram_join(docs, empty, crowd, monkeypatch):
    monkeypatch.setattr(ngrams, "CROWD", crowd)
    monkeypatch.setattr(ngrams, "BLOCK", 8)
    monkeypatch.setattr(ngrams.B.pack, "__defaults__", (2000,))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = linked(rows)
    assert sorted(listed(ngrams.op8(docs), "doc_id", "n_shingles", "component_id")) == sorted(want)
    kept = ngrams.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    assert ngrams.op8(empty).count() == 0


def test_ngram_chains(spark):
    """Links in chains, whose ends are not alike, make one component."""
    rng = random.Random(9)
    text = [f"t{rng.randint(0, 10 ** 6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rng.randint(0, 199)] = f"n{i}"
    want = linked(rows)
    got = ngrams.op8(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(listed(got, "doc_id", "n_shingles", "component_id")) == sorted(want)


def judge(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_url_rules(spark):
    found = ["http://a.ORG/x", "https://example.org/es/1?q", "https://b.example.org/en/12#t", "http://x.com/fr/9", "http://x.com/de/9", "http://norg/x", "http://org", "x.org/y", None, "",
             "http://a.net/p?u=http://b.org/", "ftp://Q.org/", "http://a.org?x=/es/", "http://é.org/ñ", "http://my.example.org/es", "http://a.b/c\nd"]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(found)], "page_id long, url string, html string")
    for r in urls.op9(rows).collect():
        host, path = judge(found[r.page_id])
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))
    assert urls.op9(rows.limit(0)).count() == 0


def test_distrust_goes_against_links(spark):
    link = lambda h: f"<a class='x' href='http://{h}/'>t</a>"
    rows = [(1, "http://x.com/de/1", ""), (2, "http://feeder.net/", link("x.com") + link("other.net")), (3, "http://good.org/", link("friend.net") + link("x.com")),
            (4, "http://friend.net/", "<a href='/own'>"), (5, "http://lonely.net/", None), (6, "http://second.net/", link("feeder.net"))]
    got = {r.page_id: r for r in urls.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "block"]
    edges = [("good.org", "friend.net"), ("good.org", "x.com"), ("feeder.net", "x.com"), ("feeder.net", "other.net"), ("second.net", "feeder.net")]
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rank = start = {"good.org": 0.15}
    for _ in range(urls.ROUNDS):
        new = defaultdict(float, start)
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * rank.get(a, 0) / len(bs)
        rank = new
    assert all(got[i].trust == pytest.approx(rank.get(h, 0.0)) for i, h in ((2, "feeder.net"), (4, "friend.net"), (3, "good.org")))


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [(0, "http://x.com/de/1", "")] + [(i, f"http://h{i}.net/", f"<a href='http://{f'h{i - 1}.net' if i > 1 else 'x.com'}/'>t</a>") for i in range(1, 14)]
    got = {r.page_id: r for r in urls.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" and got[i].distrust == pytest.approx(0.15 * 0.85 ** i) for i in range(1, 14))
    loop = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    rank = {r.host: r.rank for r in urls.personalised_rank(loop, spark.createDataFrame([("a", 1.0)], "host string, weight double"), tolerance=1e-3).collect()}
    assert rank == {"a": pytest.approx(0.15 / (1 - 0.85 ** 2), abs=6e-3), "b": pytest.approx(0.15 * 0.85 / (1 - 0.85 ** 2), abs=6e-3)}


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(4)
    bad, stems = ["vilewort", "scumbag", "dimwit"], ["zorp"]
    rows, labels = [], []
    for i in range(1500):
        ws = [rng.choice(WORDS) for _ in range(30)]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                ws[rng.randint(0, 29)] = rng.choice(bad) if rng.random() < 0.6 else stems[0] + rng.choice(["ing", "ed", "a", "ous", "ify"])
        rows.append((i, " ".join(ws), i % 9))
        if i % 10 < 9:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, None, 0), (9001, "", 0), (None, "x", 0)], "doc_id long, text string, toxic int")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (77777, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op10(docs, lab).collect()}
    truth = {i: t for i, _, t in labels}
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert got[9000].score == got[9001].score and got[9000].predicted == 0
    kept = toxicity.reject_toxic(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_reads_no_held_out_label(spark):
    rows = [(i, "vilewort " * (i % 2) + f"plain text {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    right = [(i, 1, i % 2) for i in range(300)]
    spoilt = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in right]
    a, b = (sorted(listed(toxicity.op10(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")), "doc_id", "score")) for x in (right, spoilt))
    assert a == b


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = toxicity.op10(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 2 and all(r.predicted == 0 for r in got)


def test_queries_are_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    rows = [r[:5] for r in make_docs(seed=8, n=120)]
    rows = [(i, (t + " vilewort" if t and i % 9 == 0 else t), a, s, n) for i, t, a, s, n in rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, ddl)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(bool(t) and "vilewort" in t)) for i, t, *_ in rows if rng.random() < 0.9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # brute force, stage by stage on each stage's own input
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        got = out.collect()
        if name == "toxicity":
            gone = {i for i, _, _ in before} - {r.doc_id for r in got}
            assert gone == {i for i, t, _ in before if t and "vilewort" in t}
        elif name == "ngram_join":
            assert {r.doc_id for r in got} == {c for _, _, c in linked([(i, t) for i, t, _ in before])}
        elif name == "substring_dedup":
            want = [(i, [w for w, g in zip(ws, gone) if not g]) for i, ws, gone in repeated([(i, t) for i, t, _ in before]) if not ws or not all(gone)]
            assert sorted((r.doc_id, words_of(r.text)) for r in got) == sorted(want)
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.op1(now).collect()}
            total = defaultdict(int)
            for r in got:
                total[r.doc_id] += len(words_of(r.text))
            assert {i: n for i, n in taken.items() if n} == {i: n for i, n in total.items() if n}
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    final = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert final == sorted(map(tuple, now.collect())) and final


def test_top_k_of_large_components(spark):
    """Products beyond the whole numbers that doubles hold stay exact."""
    rows = [(0, [2e6, 1.0])] + [(i, [2e6, i / 1024]) for i in range(1, 30)]
    got = vectors.op4(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    big = 2 * 10 ** 6 * 1024
    assert [(r.vec_id, r.score) for r in got] == [(29 - k, big * big + 1024 * (29 - k)) for k in range(10)]


def thue_morse(n, a="a", b="b"):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_repeating_patterns_do_not_meet(spark):
    """Words, and runs of words, that a polynomial modulo a power of two would take for one another."""
    one = "".join(thue_morse(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    got = ngrams.op8(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"))
    assert sorted(listed(got, "doc_id", "n_shingles", "component_id")) == [(1, 1, 1), (2, 1, 2)]
    shared = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*shared, one])), (2, " ".join([*shared, two])), (3, " ".join(thue_morse(2048))), (4, " ".join(thue_morse(2048, "b", "a")))]
    want = sorted((i, len(ws), sum(gone)) for i, ws, gone in repeated(rows))
    assert sorted(listed(substrings.op7(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_words", "n_removed")) == want and want[1] == (2, 50, 0)


def test_run_hashes():
    from quillon.llm.words import run_hashes

    h = np.random.default_rng(1).integers(0, 2 ** 63, 40).astype(np.uint64)
    for size in (1, 2, 3, 5, 20, 40, 41):
        got = run_hashes(h, size)
        assert len(got) == max(0, 41 - size) and len(set(got.tolist())) == len(got)
        assert all(run_hashes(h[i:i + size], size)[0] == got[i] for i in range(len(got)))


def test_empty_tables_through_every_stage(spark, empty, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for out in (toxicity.reject_toxic(empty, labels), ngrams.keep_one(empty), substrings.dedup_substrings(empty), mixing.mix(empty)):
        assert out.columns == empty.columns and out.count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


KNOWN = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2)  # an id outside the held-out fold


def test_toxicity_sample_has_a_row_an_id(spark):
    docs = spark.range(5000).select(F.lit(KNOWN).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(KNOWN, 1, 1), (KNOWN + 1, 1, 0)], "doc_id long, quality int, toxic int")
    assert listed(toxicity.training_sample(docs, labels, 10), "_toxic", "text") == [(1, "t0")]


def test_threshold_search_reads_few_rows_of_one_direction(spark):
    """Vectors along one direction: the bound ends the search, whatever the block's size."""
    rows = [(i, [float(i % 977), 0.01 * (i % 7), -0.02 * (i % 5)]) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4096, 500):
        got = vectors.top_k(v, v.where("vec_id = 976"), k=3, block_rows=block, reads=True).collect()
        score = lambda i: sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(rows[976][1], rows[i][1]))
        want = sorted(((-score(i), i) for i in range(3000) if i != 976))[:3]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
        assert all(r.rows_read < 1500 for r in got)


def test_top_k_of_repeated_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 1.0])] + [(i, [i / 64, 1.0]) for i in range(1, 15)]
    got = defaultdict(list)
    for r in vectors.op4(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    top = [100] + list(range(14, 5, -1))
    assert sorted(got[0]) == sorted(2 * [(k + 1, i) for k, i in enumerate(top)])
    assert len(got[100]) == 20 and not any(i == 100 for _, i in got[100])


def test_near_vectors_of_one_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (9, [1.0, 0.1])]
    got = vectors.op6(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(listed(got, "vec_id", "n_links", "component_id")) == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 1, 5)]


def test_near_vectors_at_the_limit(spark):
    """3-4-5 triangles: a cosine of exactly 0.8 links at 0.8, and its neighbour below does not."""
    rows = [(1, [1.0, 0.0]), (2, [4.0, 3.0]), (3, [3.999, 3.001]), (4, [-1.0, 0.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.8)
    assert sorted(listed(got, "vec_id", "n_links")) == [(1, 1), (2, 2), (3, 1), (4, 0)]


def test_buckets_and_bundles_are_dealt_evenly(spark):
    from quillon.llm import bundles as B

    for n in (1, 7, 50):
        keys = B.labels(n).tolist()
        got = spark.createDataFrame([(k,) for k in keys], "k int").repartition(n, "k").select(F.spark_partition_id().alias("p")).distinct().count()
        assert got == n and len(set(keys)) == n
    numbers = [B.bundle_number(t, i, 13) for t in (0, 3) for i in range(26)]
    rows = spark.createDataFrame([(k,) for k in numbers], "k long").repartition(13, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(set(numbers)) == 52 and [r["count"] for r in rows] == [4] * 13


def test_sharding_is_the_exact_cut(docs):
    """Rows in order of doc_id, text_crc32 and size; a row's shard holds the middle of its bytes."""
    rows = sorted((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.collect())
    total, seen, want, used = sum(r[2] for r in rows), 0, [], defaultdict(int)
    for i, crc, size in rows:
        shard = min(39, (2 * seen + size) * 40 // (2 * total))
        want.append((i, crc, size, shard, used[shard]))
        used[shard] += 1
        seen += size
    assert sorted(listed(sharding.op2(docs), "doc_id", "text_crc32", "size", "shard", "slot")) == sorted(want)


def test_tree_matching_by_brute_force():
    """Sizes of matchings of random trees against the recurrence over all pairs of children."""
    rng = random.Random(12)

    def grow(depth):
        tag = rng.choice(["div", "b", "i"])
        return (tag, tuple(grow(depth - 1) for _ in range(rng.randint(0, 3)))) if depth else (tag, ())

    def size(x, y):
        if x[0] != y[0]:
            return 0
        table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, c in enumerate(x[1]):
            for j, d in enumerate(y[1]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + size(c, d))
        return 1 + table[-1][-1]

    html = lambda t: f"<{t[0]}>{''.join(map(html, t[1]))}</{t[0]}>"
    for _ in range(60):
        a, b = ("html", tuple(grow(4) for _ in range(2))), ("html", tuple(grow(4) for _ in range(3)))
        trees = [pages.parse("".join(map(html, t[1]))) for t in (a, b)]
        aligner = pages.Aligner()
        for t in trees:
            aligner.number(t)
        pairs = aligner.pairs(*trees)
        assert aligner.size(trees[0].shape, trees[1].shape) == len(pairs) == size(a, b)
        assert all(x.tag == y.tag for x, y in pairs)


def test_distrust_ranks(spark):
    """Distrust against the links, in a graph with a loop and unequal numbers of links, by plain iteration."""
    link = lambda *hs: "".join(f"<a href='http://{h}/'>t</a>" for h in hs)
    pages_ = {"x.com": "", "a.net": link("x.com", "b.net"), "b.net": link("a.net", "c.net"), "c.net": link("x.com"), "d.net": link("a.net", "good.org"), "good.org": link("d.net")}
    rows = [(i, f"http://{hst}/{'de/' if hst == 'x.com' else ''}1", body) for i, (hst, body) in enumerate(pages_.items())]
    got = {r.host: r for r in urls.op9(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")).collect()}
    import re

    out = {hst: re.findall("http://([^/]+)/", body) for hst, body in pages_.items()}
    into = {hst: [s for s in out if hst in out[s]] for hst in out}

    def rank(edges, seed):
        r = {}
        for _ in range(400):
            new = defaultdict(float, {seed: 0.15})
            for s, ts in edges.items():
                for t in ts:
                    new[t] += 0.85 * r.get(s, 0.0) / len(ts)
            r = new
        return r

    distrust, trust = rank(into, "x.com"), rank(out, "good.org")
    for hst, r in got.items():
        assert r.distrust == pytest.approx(distrust[hst], abs=1e-7) and r.trust == pytest.approx(trust[hst], abs=1e-7)
        assert r.verdict == ("block" if hst == "x.com" else "allow" if hst == "good.org" or distrust[hst] <= trust[hst] else "block")


def test_label_model_counts_repeated_votes_once():
    """Three voters that repeat one another weigh like one; a lone vote counts in full; accuracies follow the votes."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    cast = lambda right, share: (rng.random(4000) < share) & np.where(truth, rng.random(4000) < right, rng.random(4000) > right)
    one = cast(0.9, 0.6)
    votes = np.stack([one, one, one, cast(0.85, 0.6), ~truth & (rng.random(4000) < 0.5)], 1).astype(np.float32)
    side = np.array([True, True, True, True, False])
    p, right, alike = toxicity.label_model(votes, side, np.full(5, 0.8), 0.4)
    assert (alike[:3, :3] > 0.99).all() and alike[0, 3] == 0 and alike[0, 4] == 0
    only = (votes[:, 0] == 1) & (votes[:, 3:] == 0).all(1)
    assert np.allclose(p[only], right[0], atol=0.01)
    voted = votes.any(1)
    assert np.mean((p > 0.5)[voted] == truth[voted]) > 0.85
