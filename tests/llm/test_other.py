"""Vector search, pages, URL filters, the pipeline, and that the library stands without this subpackage."""

import re
import subprocess
import sys
from datetime import date
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import html_text, near_copies, queries, retrieval, url_filter
from skein.llm.html_text import main_text

ROOT = Path(__file__).resolve().parents[2]


def best(rows, asked, k=20):
    ids = np.array([i for i, _ in rows])
    m = np.zeros((len(rows), max((len(v) for _, v in rows), default=0)), np.int64)
    for r, (_, v) in enumerate(rows):
        m[r, : len(v)] = np.floor(64 * np.array(v, float))
    out = []
    for q in np.flatnonzero(asked(ids)):
        s = m @ m[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), int(s[i])) for r, i in enumerate(order)]
    return sorted(out)


def test_top_k_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op2_top_k(spark, sf_dir).collect())) == best(rows, lambda i: i % 20 == 0)


@pytest.mark.parametrize("bucket, block", [(4096, 512), (16, 3)])
def test_top_k(spark, bucket, block):
    rnd = np.random.default_rng(bucket)
    rows = [(i, (rnd.normal(0, rnd.choice([0.1, 1, 5]), 8)).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)] + [(300, []), (301, [1.0]), (302, [0.0] * 8)]
    odd = [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit(2))
    got = retrieval.top_k(df, F.col("vec_id") % 7 == 0, k=5, bucket=bucket, block=block)
    assert sorted(map(tuple, got.collect())) == best(rows, lambda i: i % 7 == 0, 5)


def test_top_k_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert retrieval.top_k(none, F.col("vec_id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in retrieval.top_k(two, F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1, 8192)]


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.9, 0.99])
def test_pruning_keeps_all_that_qualify(threshold):
    rnd = np.random.default_rng(7)
    v = rnd.integers(-40, 40, (800, 12))
    b = retrieval.Bucket(np.arange(800), v)
    for q in rnd.integers(-40, 40, (20, 12)):
        scores = b.vectors @ q
        bound = threshold * np.linalg.norm(q) * b.norms[0]
        left = set(np.arange(800)[b.candidates(q, float(np.linalg.norm(q)), bound)].tolist())
        assert set(np.flatnonzero(scores >= bound)) <= left


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no, no, no, not this one at all</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div id="sidebar"><p>A sidebar paragraph, long enough, with commas, to score well on its own merits.</p></div>
<div class="cookie-notice">We use cookies, as everybody, to do things that you, the reader, should accept.</div>
<div class="wrap"><h1>Title &amp; more</h1><div class="post"><p>First   paragraph, with <b>bold</b> and
a <a href="#">link</a>, long enough to earn points.<p>Second paragraph, unclosed, also long enough &mdash; indeed it is.<ul><li>item one</li><li>item two</ul>
<blockquote>Quoted text, which is kept, being part of it all.</blockquote><table><tr><td>a</td><td>b</td></tr></table><div class="advert">Buy, buy, buy, this is an advert that is long.</div>
<form><p>Your name, please, and all of your other details, too.</p></form></div>
<div id="comments"><p>A reader's comment, long, with commas, that is not part of the article.</p></div></div>
<footer><p>Footer, with an address, a phone number, and much else besides.</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n\n") == [
        "Title & more", "First paragraph, with bold and a link, long enough to earn points.", "Second paragraph, unclosed, also long enough — indeed it is.", "item one", "item two",
        "Quoted text, which is kept, being part of it all.", "a b",
    ]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain words only", "plain words only"), ("<p>one<p>two", "one\n\ntwo"), ("<article><p>short</article>", "short"),
        ("<article><p>text</p><!-- <p>no</p> --><p>more<br>lines</p>", "text\n\nmore lines"), ("<article><p>a &lt;b&gt; &#233;&nbsp;x</p><p", "a <b> é x"), ("<nav><p>only a menu, long enough, with commas, to score</p></nav>", ""),
        ("<article><p>x</p><script>if (a < b) { '</p>' }", "x"), ("</p></div><article>stray</b> end", "stray end"),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


PROSE = "<p>" + "Some words, quite a lot of them, in a sentence that goes on. " * 4 + "</p>"
WORDS = re.sub("</?p>", "", PROSE).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="post has-sidebar">{PROSE}{PROSE}</div><div class="sidebar">{PROSE}</div></body>', [WORDS, WORDS]),
        (f'<body><div class="share-container"><article>{PROSE}</article></div></body>', [WORDS]),
        (f'<article><p class="byline">By A. Writer</p>{PROSE}</article>', ["By A. Writer", WORDS]),
        (f'<article>{PROSE}<section id="related-work"><h2>Related work</h2>{PROSE}</section></article>', [WORDS, "Related work", WORDS]),
        (f'<article>{PROSE}<div class="search-results">{PROSE}</div></article>', [WORDS, WORDS]),
        (f'<article>{PROSE}<div class="related-stories"><a href=/1>One</a> <a href=/2>Two</a></div></article>', [WORDS]),
        (f"<article>{PROSE}<p>Then <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> holds.</p></article>", [WORDS, "Then x=1 holds."]),
        (f"<article><p title=don't>First, a paragraph.</p>{PROSE}</article>", ["First, a paragraph.", WORDS]),
        (f"<article><p title='a>b' data-x=\"c>d\">First, a paragraph.</p>{PROSE}</article>", ["First, a paragraph.", WORDS]),
        ("<body><ul>" + "".join(f"<li><a href=/{i}/>Link {i}</a></li>" for i in range(9)) + "</ul></body>", []),
        (f"<body><div><p>See <a href=/x/>the page</a> for more, which is a long enough text.</p>{PROSE}</div></body>", ["See the page for more, which is a long enough text.", WORDS]),
        (f'<article>{PROSE}<div class="comment-list">{PROSE}</div><div id="site-footer">{PROSE}</div></article>', [WORDS]),
    ],
)
def test_names_drop_only_what_they_name(page, want):
    assert main_text(page) == "\n\n".join(want)


class Plain(HTMLParser):
    """The blocks of the article element, for pages that have one and nothing else in it."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in html_text.BLOCK:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_equal_a_plain_reading(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op3_main_text(spark, sf_dir).collect():
        plain = Plain()
        plain.feed(pages[r.page_id])
        assert r.text == "\n\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b)


def test_deep_and_long_pages():
    assert main_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert len(main_text("<article>" + "<p>word, word</p>" * 20000)) == 20000 * 12 - 2
    assert main_text('<div class="x-sidebar">' * 20000 + "x" + "</div>" * 20000) == "x"


def test_pages_table(spark, sf_dir):
    got = queries.op3_main_text(spark, sf_dir).collect()
    assert len(got) == 50 and all(r.text and r.n_chars == len(r.text) and "&copy;" not in r.text for r in got)
    odd = spark.createDataFrame([(1, None), (None, "<p>x")], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted(r.text for r in html_text.extract(odd).collect()) == ["", "x"] and html_text.extract(odd.limit(0)).count() == 0


def test_url_filters_equal_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = queries.op7_url_filters(spark, sf_dir)
    want = c.sql(queries.oracle_sql()["op7_url_filters"])
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_url_filters(spark):
    e = [
        ("Example.com", "a", "block", "add", date(2024, 1, 10)), ("example.com", "a", "block", "remove", date(2024, 2, 10)), ("example.com", "a", "block", "add", date(2024, 3, 1)),
        ("www.example.com", "b", "allow", "add", date(2024, 1, 1)), ("www.example.com/Bad", "c", "block", "add", date(2024, 1, 20)), ("tie.org", "x", "allow", "add", date(2024, 1, 1)),
        ("tie.org", "y", "block", "add", date(2024, 1, 1)), ("both.org", "z", "block", "add", date(2024, 1, 5)), ("both.org", "z", "block", "remove", date(2024, 1, 5)), (None, "z", "block", "add", date(2024, 1, 5)),
    ]
    entries = spark.createDataFrame(e, "key string, list_name string, verdict string, action string, dated date")
    cases = [
        ("http://example.com/x", date(2024, 1, 9), "none"), ("http://example.com/x", date(2024, 1, 10), "block"), ("http://Sub.EXAMPLE.com:80/x", date(2024, 2, 9), "block"), ("http://example.com/x", date(2024, 2, 10), "none"),
        ("http://example.com/x", date(2030, 1, 1), "block"), ("http://www.example.com/ok?q=1", date(2024, 1, 15), "allow"), ("http://www.example.com/Bad/y#f", date(2024, 1, 25), "block"), ("http://www.example.com/Badly", date(2024, 1, 25), "allow"),
        ("http://notexample.com/", date(2024, 1, 15), "none"), ("https://u:p@tie.org", date(2024, 5, 1), "block"), ("http://both.org", date(2024, 1, 6), "none"), (None, date(2024, 1, 6), "none"), ("nonsense", date(2024, 1, 6), "none"), ("http://tie.org", None, "none"),
    ]
    rows = [(i, u, d) for i, (u, d, _) in enumerate(cases)] + [(0, *cases[0][:2])]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").withColumn("key", F.lit("clash"))
    got = [(r.page_id, r.verdict) for r in url_filter.evaluate(captures, entries, carry=("page_id",)).collect()]
    assert sorted(got) == sorted([(i, v) for i, (_, _, v) in enumerate(cases)] + [(0, "none")])
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.evaluate(captures, entries.limit(0)).collect()} == {"none"}


def test_a_far_off_date_adds_one_slot(spark):
    entries = spark.createDataFrame([("a.org", "x", "block", "add", date(2024, 1, 1))], "key string, list_name string, verdict string, action string, dated date")
    rows = [("http://a.org/", date(2024, 2, 1)), ("http://a.org/", date(9999, 12, 31)), ("http://a.org/", date(1, 1, 1))]
    got = url_filter.evaluate(spark.createDataFrame(rows, "url string, fetched_on date"), entries)
    assert sorted((r.fetched_on.year, r.verdict) for r in got.collect()) == [(1, "none"), (2024, "block"), (9999, "block")]
    assert url_filter.evaluate(spark.createDataFrame([("http://a.org/", None)], "url string, fetched_on date"), entries).first().verdict == "none"


def test_products_beyond_a_long_are_an_error(spark):
    v = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        retrieval.top_k(v, F.lit(True))
    v = spark.createDataFrame([(1, [2.0**24, 1.0]), (2, [2.0**24, 2.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in retrieval.top_k(v, F.lit(True)).orderBy("query_id").collect()] == [2**60 + 64 * 128] * 2


def test_native_operators_have_no_python(spark, sf_dir):
    for q in (queries.op4_decontamination, queries.op7_url_filters):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        assert 0 < docs.count() <= before
        before = docs.count()
        if name == "simhash":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "secrets":
            assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    want = {r.doc_id for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    assert corpus_pipeline.ORACLE_SQL is None


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("copies", [3, 60])
def test_near_duplicate_stage_takes_near_copies(spark, sf_dir, copies):
    """Copies that share four fifths of their five-word runs go, whatever their fingerprints; others stay."""
    rnd = np.random.default_rng(5)
    words = [" ".join(f"w{k}" for k in rnd.integers(0, 5000, 200)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(words)]
    for k in range(copies):  # another word at three places of the first; half of another text
        w = words[0].split()
        for at in (30, 90 + k, 170):
            w[at] = f"new{k}"
        rows.append((100 + k, " ".join(w)))
    rows.append((500, " ".join(words[1].split()[:100] + words[2].split()[100:])))
    rows.append((501, None))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    text = dict(rows)
    assert all(len(shingles(text[0]) & shingles(text[i])) >= 0.8 * len(shingles(text[0]) | shingles(text[i])) for i in range(100, 100 + copies))
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).select("doc_id").collect()}
    assert got == {*range(8), 500, 501}


def test_crowded_keys_are_compared_in_full(spark):
    """Texts of one template, none of them near to another, and near copies of some: one of each component stays."""
    rnd = np.random.default_rng(12)
    base, rows = [f"b{k}" for k in range(300)], []
    for i in range(60):
        w = list(base)
        for at in rnd.choice(300, 9, replace=False):
            w[at] = f"x{i}"
        rows.append((1000 - i, " ".join(w)))
        if i % 3 == 0:
            w[rnd.integers(300)] = "y"
            rows.append((2000 - i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    want = {root(i) for i in sets}
    assert 40 < len(want) < 80
    for whole, part in ((4, 16), (1, 1000), (32, 8)):
        assert {r.doc_id for r in near_copies.keep_first(docs, whole=whole, part=part).collect()} == want


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """What each stage keeps of null, empty, repeated and very long rows, with columns that bear the stages' own names."""
    long = " ".join(f"plain{i}" for i in range(30000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a password=abcdef1234", "en", "s", 3), (3, None, "en", "s", 0), (4, long, "en", "s", 9), (4, long, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("toxicity", "fp", "component_id", "node", "id", "key", "row", "w", "hash", "secret_spans"):
        docs = docs.withColumn(name, F.lit("clash"))
    kept = {"toxicity": [None, 1, 1, 2, 3, 4, 4], "simhash": [None, 1, 1, 2, 4, 4], "decontamination": [None, 1, 1, 2, 4, 4], "secrets": [None, 1, 1, 2, 4, 4]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
        assert sorted((i for i, _, _ in got), key=str) == sorted(kept[name], key=str)
        if name == "secrets":
            assert (2, "a [secret]", 10) in got and (None, None, None) in got and (4, long, len(long)) in got
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = out
    ends = corpus_pipeline.pack(spark, docs, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    sizes = {r.doc_id: (r.n, r.of) for r in ends}
    assert sizes[None] == (1, 1) and sizes[1] == (2, 1) and sizes[4][0] == 2 * sizes[4][1]
    assert corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0


def test_library_stands_alone(tmp_path):
    """Without this subpackage and the pipeline, the entry module imports and lists the other queries."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'skein.llm' or name.startswith('skein.llm.') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())\n"
        "assert 'skein.llm' not in sys.modules\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
