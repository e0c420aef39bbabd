"""Toxicity, page text, licenses and the pipeline."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tally.llm import html_text, licenses, toxicity
from tally.llm.html_text import Tree, main_text
from tally.llm.licenses import license_of_files
from tally.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    calm = ["the", "river", "stone", "cloud", "walking", "paper", "garden", "idea", "idle", "iota", "stud", "cup"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(calm) for _ in range(r.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "stupid"]))
        rows.append((i, " ".join(words), "clash", 9))
        labels.append((i, int(toxic)))
    rows += [(900, None, "clash", 9), (901, "", "clash", 9), (902, "1d10t and stuuupid", "clash", 9), (903, "i d i o t , s.t.u.p.i.d", "clash", 9),
             (None, "river stone", "clash", 9), (904, "word " * 60_000, "clash", 9)]
    labels += [(0, 0), (None, 1), (5000, 1), (3, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string, y long"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.col("id") % 5 != 0)
    assert toxicity.restore("1d10t", model.logp) == "idiot" and toxicity.restore("s.t.u.p.i.d", model.logp) == "stupid"
    assert toxicity.restore("stuuupid", model.logp) == "stupid"
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "y", "score"]
    got = {x.doc_id: x.score for x in scored.collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(0, 400, 5)]
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert got[902] >= 0.5 and got[903] >= 0.5 and got[900] == got[901] < 0.5 and got[None] < 0.5 and got[904] < 0.5


def test_toxicity_without_labels_or_documents(spark, corpus):
    docs, labels = corpus
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.lit(True))).count() == 0


def test_restore_equals_trying_all_readings():
    """Viterbi against every path of small lattices."""
    r = np.random.default_rng(0)
    logp = np.log(r.dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS,) * 2))

    def every(token, i=0, a=0, b=0):
        if i == len(token):
            yield (logp[a, b, 0] if b else 0.0), ""
            return
        for letters, to, cost in toxicity._readings(token, i):
            score, x, y = -cost, a, b
            for s in map(toxicity._symbol, letters):
                if s or y:
                    score += logp[x, y, s]
                    x, y = y, s
            for rest, text in every(token, to, x, y):
                yield score + rest, letters + text

    for token in ["1d10t", "a.b.c", "heeey", "$0$", "l1f3", "x-1-y", "b@@d", "0", "!!!a"]:
        assert toxicity.restore(token, logp) == max(every(token))[1]


def test_trigram_counts(spark):
    docs = spark.createDataFrame([("Ab",), (None,), ("",)], "text string")
    counts = toxicity.trigram_counts(docs)
    assert counts[0, 0, 1] == 1 and counts[0, 1, 2] == 1 and counts[1, 2, 0] == 1


PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href="/">menu</a></nav>'
        '<div class="cookie-notice">ok?</div><article><header><h1>Title</h1><p>by me</p></header><p><b>A&nbsp;b  c<br>d <i>e</i>f &amp;lt; &eacute;'
        '<p>second<ul><li>one<li>two</ul><aside>side</aside><form>f</form><div class="ad">buy</div><section id="comments"><p>hi</p></section>'
        '%s</article><footer>foot</footer>')


def test_page_text():
    assert Tree(PAGE % "").text(set()) == "Title\n\nA b c d ef &lt; é\n\nsecond\n\none\n\ntwo"
    assert Tree("plain").text(set()) == "plain" and Tree("<div>" * 5000 + "deep").text(set()) == "deep"
    assert Tree("<body><div>a</div>b<div hidden>c</div></body>").text(set()) == "a\n\nb"


def test_site_templates_are_removed(spark):
    """A box that a site repeats goes, though nothing marks it; repeated prose of articles stays."""
    box = "<div><span>Our other offers of this week</span></div>"
    own = "<p>common line</p><p>own %d and more words to read here</p>"
    rows = [(i, "http://a.example/%d" % i, (PAGE % (own % i + box)).replace("Title", f"Title {i}").replace("two", f"two {i}")) for i in range(8)]
    rows += [(20 + i, "http://b.example/%d" % i, "<body><div>Site name</div><p>text %d</p></body>" % i) for i in range(5)]
    rows += [(40, None, None), (41, "x", ""), (42, "http://c.example", "<p>alone</p>"), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {x.page_id: x for x in main_text(pages).collect()}
    assert got[0].text.endswith("two 0\n\ncommon line\n\nown 0 and more words to read here")
    assert got[21].text == "text 1" and got[40].text == got[41].text == "" and got[42].text == "alone"
    assert all(x.n_chars == len(x.text) for x in got.values()) and main_text(pages).count() == len(rows)
    assert main_text(pages.limit(0)).count() == 0


def test_menu_variants_of_a_large_host_go(spark):
    """50 unmarked menus on a host of 2000 pages, none on a tenth of them; and a box shared by two pages stays."""
    rows = [(i, "http://big.example/%d" % i, f"<body><div><a>Home {i % 50}</a><a>About</a></div><div><p>own <b>text</b> of page {i}</p></div>"
             + "<div>pair</div>" * (i < 2)) for i in range(2000)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text of page {i}" + "\n\npair" * (i < 2) for i in range(2000)}


def test_repeated_prose_in_articles_goes(spark):
    """A paragraph and a list on every page of a host go, in the article too; what a few pages quote stays, and copies of a page keep their text."""
    tail = "<p>Write to us and read our news every week.</p><ul><li>More news</li><li>Archive</li></ul>"
    quote = "<p>A passage that some pages quote, word for word and at some length.</p>"
    body = "<article><h1>Title %d</h1><p>own words of page %d, which stand here only</p>%s%s</article>"
    rows = [(i, "http://n.example/%d" % i, body % (i, i, quote if i < 5 else "", tail)) for i in range(40)]
    rows += [(100 + i, "http://m.example/%d" % i, body % (0, 0, quote, f"<p>seen {i}</p>")) for i in range(30)]
    cards = "".join(f"<article><a>Teaser {k} of %d</a></article>" for k in range(2))
    rows.append((200, "http://t.example", "<body>" + (cards % (1, 2)) + "<div><p>" + "the long text of this page " * 9 + "</p></div>"))
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    passage = "\n\nA passage that some pages quote, word for word and at some length."
    assert all(got[i] == f"Title {i}\n\nown words of page {i}, which stand here only" + passage * (i < 5) for i in range(40))
    assert all(got[100 + i] == "Title 0\n\nown words of page 0, which stand here only" + passage + f"\n\nseen {i}" for i in range(30))
    assert "the long text of this page the long" in got[200]


def test_packed_pages_read_alike():
    """What travels in place of a page gives its text, whichever subtrees are template."""
    r = random.Random(3)
    html = (PAGE % "<nav>home</nav>") + "".join(f"<div class='{c}'><p>{i} <b>bold</b>&nbsp;x</p><br><ul><li>{i}</ul></div>" for i, c in enumerate(["", "ad", "x"] * 5))
    for page in [html, "plain", "<div>" * 5000 + "deep", "<div role=main>a<img>b <i> c</i></div><p>d" * 3, *(html[:a] + html[a + 40:] for a in range(0, 300, 7))]:
        tree = Tree(page)
        packed = html_text.Page(tree.packed())
        for share in (0, 0.3, 1):
            gone = {i for i in range(len(tree.kinds())) if r.random() < share}
            assert packed.text(gone) == tree.text(gone)


def test_counts_meet_by_broadcast_and_by_shuffle_alike(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", f"<div>menu {i % 6}</div><p>{i} {'words ' * 30}</p>") for i in range(60)], "page_id long, url string, html string")
    got = []
    for keys in (50_000, 4, 1):  # all by broadcast, some, none
        monkeypatch.setattr(html_text, "BROADCAST_KEYS", keys)
        got.append(sorted(tuple(x) for x in main_text(pages).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 60 and not any("menu" in x[2] for x in got[0])


def test_what_is_joined_with_templates_is_smaller_than_the_pages(spark):
    """Of a page travel neither its markup nor its marked parts."""
    html = "<html><body><nav>" + "".join(f"<a href='/{random.Random(1).random()}/{i}'>link {i}</a>" for i in range(300)) + "</nav><article><p>text</p></article></body></html>"
    batch = next(html_text._packed_pages(iter([spark.createDataFrame([(1, "u", 2, html)], "id long, url string, page long, html string").toArrow().to_batches()[0]])))
    assert len(batch.column(3)[0].as_py()) < 300 and html_text.Page(Tree(html).packed()).text(set()) == "text"


def test_host():
    assert html_text.host("HTTPS://User@A.Example:80/x") == "a.example" and html_text.host(None) == html_text.host("nonsense") == ""


def test_licenses(spark):
    notice = "# Licensed under the Apache License, Version 2.0."
    rows = [(1, "p/LICENSE", "MIT License\n\n" + licenses.TEMPLATES["MIT"][4]), (2, "p/a/x.py", notice + "\ncode = 1"), (3, "p/a/y.py", "code"),
            (4, "q/z.py", "nothing about rights"), (5, "p/a/COPYING", licenses.TEMPLATES["GPL-3.0"][0]), (6, "p/b/c/w.py", None), (7, None, ""),
            (8, "v.txt", "word " * 50_000 + "\nReleased under the MIT License."), (None, "p/u.py", ""), (3, "p/a/y.py", "code")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string")
    got = {(x.doc_id, x.path): (x.license, x.origin, x.license_path) for x in license_of_files(docs).collect()}
    assert got == {(1, "p/LICENSE"): ("MIT", "stated", "p/LICENSE"), (2, "p/a/x.py"): ("Apache-2.0", "stated", "p/a/x.py"),
                   (3, "p/a/y.py"): ("GPL-3.0", "inherited", "p/a/COPYING"), (4, "q/z.py"): (None, None, None),
                   (5, "p/a/COPYING"): ("GPL-3.0", "stated", "p/a/COPYING"), (6, "p/b/c/w.py"): ("MIT", "inherited", "p/LICENSE"),
                   (7, None): (None, None, None), (8, "v.txt"): ("MIT", "stated", "v.txt"), (None, "p/u.py"): ("MIT", "inherited", "p/LICENSE")}
    assert license_of_files(docs).count() == len(rows) and license_of_files(docs.limit(0)).count() == 0


def test_licenses_without_a_template_are_not_siblings(spark):
    """Names, versions and clauses decide; what no template has is unknown, and nothing of it is inherited."""
    bsd = licenses.TEMPLATES["BSD-3-Clause"][2] + ":\n\n1. Redistributions in binary form must reproduce the above copyright notice.\n\n"
    texts = {"Licensed under the ISC License.": "ISC", "BSD 2-Clause License": "BSD-2-Clause", "Eclipse Public License, Version 2.0": "EPL-2.0",
             licenses.TEMPLATES["GPL-3.0"][2].replace("GNU", "GNU Affero"): "AGPL-3.0", licenses.TEMPLATES["GPL-3.0"][2]: "GPL-3.0",
             licenses.TEMPLATES["LGPL-3.0"][0].replace("3", "2.1"): "LGPL-2.1", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
             "Licensed under CC BY 3.0.": None, "Licensed under the Artistic License.": None, "Apache License Version 1.1": None,
             licenses.TEMPLATES["GPL-3.0"][0].replace("3", "1"): None, bsd: "BSD-2-Clause",
             bsd + "Neither the name may be used to endorse or promote products.": "BSD-3-Clause", licenses.TEMPLATES["ISC"][3]: "ISC",
             licenses.TEMPLATES["MIT"][4]: "MIT", "BSD 3-Clause License": "BSD-3-Clause"}
    rows = [(2 * i, f"d{i}/LICENSE", t) for i, t in enumerate(texts)] + [(2 * i + 1, f"d{i}/x.py", "code") for i in range(len(texts))]
    docs = spark.createDataFrame(rows + [(99, "z", "prose\nProprietary material of Acme")], "doc_id long, path string, text string")
    got = {x.doc_id: x.license for x in license_of_files(docs).collect()}
    assert [got[2 * i] for i in range(len(texts))] == list(texts.values()) == [got[2 * i + 1] for i in range(len(texts))]
    own = {x.doc_id: x.license for x in license_of_files(docs, templates={"Acme": ["Proprietary material of Acme"]}).collect()}
    assert own[99] == own[0] == "Acme"  # a licence file at the root


def test_cosine_by_hand():
    c = licenses.Cosine({"A": ["red fox"], "B": ["blue fox"]}, {"red": 2.0, "blue": 2.0, "fox": 1.0}, 3.0)
    score, name = c.nearest(licenses.Counter(["red", "fox", "runs"]))
    assert name == "A" and abs(score - 5 / (5 ** 0.5 * 14 ** 0.5)) < 1e-12


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_against_its_definitions(spark):
    """Each stage's rows by plain Python on the small tables, and extra columns that clash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
    text = {r.doc_id: r.text for r in kept["toxicity"]}
    best = {}
    for i, t in text.items():
        k = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    assert {r.doc_id for r in kept["exact dedup"]} == {i for _, i in best.values()}
    sets = {r.doc_id: H.shingles(r.text) for r in kept["exact dedup"]}
    near = H.components(sets)
    assert {r.doc_id for r in kept["n-gram Jaccard join"]} == {i for i in sets if near[i] == i}
    items = [H.shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept["n-gram Jaccard join"] if not any(100 * len(s & sets[r.doc_id]) >= 80 * len(s) for s in items)}
    assert {r.doc_id for r in kept["benchmark decontamination"]} == clean
    assert {r.doc_id for r in kept["best-fit packing"]} == clean
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select("doc_id").distinct().count() > 0


@pytest.mark.parametrize("html", [
    "<html><head><title>t</title><body><p>text",
    "<html><head><title>t</title><p>text",
    "<html><head><meta charset=x>text",
    '<body><div class="page with-sidebar"><article><p>text</p></article><div class="sidebar">no</div></div>',
    '<body><form id="aspnetForm"><input type=hidden value=x><div><p>text</p></div><button>no</button></form>',
    '<body><form id="search-form"><article><p>text</p></article></form><form><p>no</p></form>',
    '<body><main class="search-results"><p>text</p></main>',
    '<body><article class="post comments-open"><p>text</p><div class="comments">no</div></article>',
    '<body><article class="widget-review"><p>text</p></article>',
    '<body><div id="share-price-report"><p>text</p></div><div class="share-buttons">no</div>',
])
def test_names_and_omitted_tags_do_not_lose_the_text(html):
    assert Tree(html).text(set()) == "text"


def test_marked_parts_still_go():
    html = ('<body><main><p>text of the page that is long enough to be most of it</p></main><div class="post-comments"><article class="comment">no'
            '</article></div><div class="cookie-bar">no</div><form><p>no</p></form><div class="banner"><article>no</article></div>')
    assert Tree(html).text(set()) == "text of the page that is long enough to be most of it"


def test_pipeline_decides_repeated_and_null_ids_by_row(spark):
    """Rows that share an id, or have none, with different texts: only copies and contaminated ones go."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, words("a", 60)), (1, words("b", 60)), (2, words("a", 60) + " more"), (None, words("c", 60)), (None, words("c", 61)),
            (None, words("d", 60)), (None, words("a", 61)), (3, words("e", 30) + " " + item), (3, words("e", 30)),
            (None, words("f", 30) + " " + item), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    near = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    gone = {words("a", 60) + " more", words("a", 61)}
    assert {(r.doc_id, r.text) for r in near if r.doc_id is not None} == {(i, t) for i, t in rows if i is not None and t not in gone}
    nulls = [r.text for r in near if r.doc_id is None]
    assert len(nulls) == 3 and words("d", 60) in nulls and sum(t.startswith("c0 ") for t in nulls) == 1
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in clean) == sorted((str(i), str(t)) for i, t in rows if item not in (t or ""))
