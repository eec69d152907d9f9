"""Secret scans, page extraction and nearest neighbours, and the pipeline as a whole."""

import hashlib
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vocatio.llm import ann, linededup, pages, secrets, simhash
from vocatio.llm.common import table
from vocatio.session import written

HEX = hashlib.sha1(b"a key").hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    return written(secrets.planted_findings(table(spark, "/root/testdata/sf0.01", "documents")), "test-labelled")


def test_planted_findings_have_both_classes(labelled):
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    assert set(counts) == {0.0, 1.0} and sum(counts.values()) <= 20 * secrets.LABELLED_DOCS


def test_held_out_accuracy(labelled):
    fold = F.pmod("h", F.lit(4)) == 0
    forest = secrets.train(labelled.filter(~fold))
    rows = secrets.judged(labelled.filter(fold), forest).select("label", "is_secret").collect()
    right = sum(bool(r.label) == r.is_secret for r in rows)
    assert len(rows) > 300 and right >= 0.97 * len(rows)


def test_same_findings_same_forest(labelled):
    a, b = (secrets.train(df) for df in (labelled, labelled.repartition(3)))
    assert a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1]


TEXTS = [
    (1, f'some words token = "{HEX}" and more words'), (2, f"see commit {HEX} of the tree"), (3, "write to the.12@mail7.example.com today"),
    (4, None), (5, ""), (6, "x" * 50_000 + f' api_key = "{HEX}"'), (7, f'password: "{HEX}" then secret = "{HEX}"'), (7, f'password: "{HEX}" then secret = "{HEX}"'),
    (None, f'token = "{HEX}"'), (8, "no candidates here."), (9, f'checksum: "{HEX}" of the file, token = "{HEX}" of the user'),
]


def plain_candidates(text):
    pattern = re.compile(secrets.CANDIDATE)
    return [(m.start(), m[0]) for m in pattern.finditer(text or "")]


def test_scan_finds_all_candidates_and_drops_harmless_ones(docs_of, labelled):
    docs = docs_of(TEXTS)
    rows = secrets.scan(docs, labelled).collect()
    assert Counter((r.id, r.start, r.value) for r in rows) == Counter((i, s, v) for i, t in TEXTS for s, v in plain_candidates(t))
    verdict = Counter((r.id, r.is_secret) for r in rows)
    assert verdict[1, True] == 1 and verdict[2, False] == 1 and verdict[3, False] == 1 and verdict[6, True] == 1
    assert verdict[7, True] == 4 and verdict[None, True] == 1 and verdict[9, True] == 1 and verdict[9, False] == 1
    assert secrets.scan(docs.limit(0)).count() == 0


def test_redact(docs_of, labelled):
    docs = docs_of(TEXTS)
    out = secrets.redact(docs, labelled)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[1].text == 'some words token = "[REDACTED]" and more words' and texts[1].n_chars == len(texts[1].text)
    assert texts[2].text == TEXTS[1][1] and texts[4].text is None and texts[5].text == ""
    assert texts[9].text == f'checksum: "{HEX}" of the file, token = "[REDACTED]" of the user'
    assert texts[7].text == 'password: "[REDACTED]" then secret = "[REDACTED]"'
    assert secrets.redact(docs.limit(0)).count() == 0


def test_rows_that_differ_in_source_are_redacted_alike(docs_of, labelled):
    text = f'words token = "{HEX}" then secret = "{HEX}" and more'
    docs = docs_of([(1, text)] * 3 + [(2, text)])
    docs = docs.withColumn("source", F.when(F.rand(3) < 0.5, "src0").otherwise("tests/fixture")).unionByName(docs.withColumn("source", F.lit("docs/example")))
    docs = written(docs.unionByName(docs_of([(1, text)])), "test-sources")
    assert docs.select("source").distinct().count() == 3
    assert {r.text for r in secrets.redact(docs, labelled).collect()} == {'words token = "[REDACTED]" then secret = "[REDACTED]" and more'}


KEYS = [HEX, "AKIA" + HEX[:16].upper(), "ghp_" + HEX[:36], "eyJhbGciOi1.eyJzdWIiOj2.c2lnbmF0dXJl", "c2VjcmV0IGtleSBvZiBhIHVzZXI0NQ=="]


def test_candidates_end_before_punctuation(docs_of):
    marks = [".", "...", ",", ".\n", ". Next", ";", ")", "!", ""]
    rows = [(i, f"key {key}{mark}", key) for i, (key, mark) in enumerate((k, m) for k in KEYS for m in marks)]
    rows += [(100, f'token = "{HEX}."', HEX + "."), (101, f"'{HEX}'.", HEX), (102, "a1" + "." * 50_000 + f" {HEX}.", HEX)]
    found = secrets.candidates(docs_of([r[:2] for r in rows])).collect()
    assert Counter((r.id, r.value) for r in found) == Counter((i, v) for i, _, v in rows)


def test_env_lines(docs_of, labelled):
    names = ["api_key", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "AUTH_TOKEN_FOR_SERVICE_V2"]
    rows = [(i, f"# settings\nDEBUG=on\n{n}={k}\nPORT=80\n", n, k) for i, (n, k) in enumerate((n, k) for n in names for k in (HEX, HEX[:32], KEYS[4]))]
    found = [r for r in secrets.scan(docs_of([r[:2] for r in rows]), labelled).collect() if not r.value.startswith("AUTH")]
    assert Counter((r.id, r.value) for r in found) == Counter((i, k) for i, _, _, k in rows)
    assert all(r.before.endswith(f"{rows[r.id][2]}=") for r in found) and all(r.is_secret for r in found if r.value != KEYS[4])
    harmless = docs_of([(0, f"see checksum={HEX} of it"), (1, f"page sha1={HEX}\n"), (2, "title=mountains of words")])
    assert [(r.id, r.value, r.is_secret) for r in secrets.scan(harmless, labelled).orderBy("id").collect()] == [(0, HEX, False), (1, HEX, False), (2, "mountains", False)]
    short = docs_of([(0, "DB_PASSWORD=abc12 x"), (1, "a token=123456789012 b"), (2, "abcdefghij0123456789=x"), (3, f"={HEX}.")])
    assert [r.value for r in secrets.candidates(short).orderBy("id").collect()] == ["abc12", "123456789012", "abcdefghij0123456789", HEX]
    assert secrets.candidates(short).filter("before IS NULL OR after IS NULL").count() == 0


def test_scan_runs_no_python(docs_of, labelled):
    plan = secrets.scan(docs_of(TEXTS), labelled)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header id=top><h1>Site name</h1><nav><a href=/>Home</a></nav></header>
<div class="wrap"><div class="post-%d entry"><header><h2>A title &amp; more</h2><span>by someone</span></header>
<p>One <b>bold</b>&nbsp;word,<br>  three &lt; four.<p>Second &#8220;block&#8221; ends here.</p><ul><li>First item, long enough.<li>Second item</ul>
<div class="ad">Buy now, it is cheap today.</div><form><p>Mail us, please, as soon as you can.</p></form>
<!-- <p>hidden</p> --><table><tr><td>cell a<td>cell b</table></div>
<div id="comments"><p>Very nice article, I liked it a lot.</p></div></div>
<aside><p>Something beside the text, which is long enough to count.</p></aside>
<div role="alert">This site has a notice.</div><footer>&copy; me</footer></body></html>"""
TEXT = "A title & more\n\nOne bold word, three < four.\n\nSecond “block” ends here.\n\nFirst item, long enough.\n\nSecond item\n\ncell a\n\ncell b"


def test_page_text():
    page = pages.Page(PAGE % 12)
    assert page.path(page.best()) == ">html>body.has-sidebar>div.wrap>div.entry.post-#"
    assert page.text([]) == TEXT


def test_winning_path_without_blocks():
    page = pages.Page('<body><article></article><div class="c"><p>The article stands here, at some length.</p></div><section><p>Beside.</p></section></body>')
    article, section = (page.path(page.steps.index(tag)) for tag in ("article", "section"))
    assert page.text([article]) == page.text([]) != "" and page.text([article, section]) == "Beside."


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain text, no markup.", "plain text, no markup."), ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("<p>a<p>b", "a\n\nb"), ("<b>a</i></b>c", "ac"),
    ("<script>never ends <p>x</p>", ""), ("<div><p>x &amp y &am</div>", "x & y &am"), ("</p></div>x", "x"), ('<p class="a>b">x</p>', "x"),
    ("<p>" * 2000 + "deep</p>", "deep"), ("<div>" * 500 + "deep", "deep"), ("x " * 100_000, ("x " * 100_000).strip()),
])
def test_odd_pages(html, text):
    assert pages.Page(html).text([]) == text


PROSE = "A long sentence that is part of the main text of this page, in every way."


@pytest.mark.parametrize("html, text", [
    (f'<p>{PROSE} <a href="/the-hidden-valley">A valley</a> ends.</p>', f"{PROSE} A valley ends."),
    (f'<p>{PROSE} <a href="/x?id=comments">A link</a> ends.</p>', f"{PROSE} A link ends."),
    (f'<p title="hidden gems">{PROSE}</p><p title=\'a hidden "gem"\'>{PROSE}</p>', f"{PROSE}\n\n{PROSE}"),
    (f'<p data-role="dialog">{PROSE}</p><p data-id="promo-7">{PROSE}</p>', f"{PROSE}\n\n{PROSE}"),
    (f'<div class="post-content ad-free"><p>{PROSE}</p></div>', PROSE),
    (f'<article><p>{PROSE}</p><p class="social-history">{PROSE}</p></article>', f"{PROSE}\n\n{PROSE}"),
    (f'<article><p>{PROSE}</p></article><article class="comment"><p>{PROSE} {PROSE} {PROSE}</p></article>', PROSE),
    (f"<title>Not ended<body><div><p>{PROSE}</p></div>", PROSE),
    (f'<div><p>{PROSE}</p><div class="ad-300x250"><p>Buy.</p></div><div class="social-links">Share it.</div><div id="related-posts">More.</div></div>', PROSE),
    (f'<main><div class="notice-board"><p>{PROSE}</p></div></main>', PROSE), (f'<div class="widget"><p>{PROSE}</p></div><p>Short.</p>', f"{PROSE}\n\nShort."),
    (f'<div hidden><p>{PROSE}</p></div><p>{PROSE}</p>', PROSE), (f'<div class="sidebar"><p>{PROSE}</p></div><p>{PROSE}</p>', PROSE),
])
def test_articles_keep_their_words(html, text):
    assert pages.Page(html).text([]) == text


@pytest.mark.parametrize("html", [
    '<div class="a">' * 50_000 + f"<p>{PROSE}</p>", '<div class="a">' * 1000 + "</b></li></table><li></li>" * 20_000 + f"<p>{PROSE}</p>",
])
def test_deep_pages_are_small_and_quick(html):
    tracemalloc.start()
    began = time.process_time()
    page = pages.Page(html)
    path = page.path(page.best())
    assert page.text([path]) == page.text([]) == PROSE
    assert time.process_time() - began < 15 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_hosts(spark):
    urls = ["http://User@Www.Example.com:80/a?b#c", "//x.org", "https://x.org", "mailto:a@b.c", "", None, "ht!tp://?"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.h for r in df.select(pages.host_of(F.col("url")).alias("h")).collect()] == ["www.example.com", "x.org", "x.org", None, None, None, None]


def test_consensus_of_a_host(spark):
    prose = "A long sentence that is part of the main text of this page, in every way. "
    short = '<body><div class="story-1"><p>Tiny.</p></div><div class="other"><p>%s</p></div></body>' % (prose * 3)
    long = '<body><div class="story-%d"><p>%s</p></div><div class="other"><p>Short remark beside.</p></div></body>'
    rows = [(i, "http://a.org/x", long % (i, prose * 5)) for i in range(8)] + [(8, "http://a.org/y", short), (9, None, short), (10, "http://b.org", None)]
    rows += [(11, "http://b.org", ""), (0, "http://a.org/x", long % (0, prose * 5)), (None, "http://a.org/z", long % (3, prose * 5)), (12, "bad url", "<p>x y z.</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = pages.extract(df).collect()
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in rows)
    by_id = {r.page_id: r for r in found}
    assert by_id[8].text == "Tiny." and by_id[9].text == "Tiny.\n\n" + (prose * 3).strip()  # the host's path wins, a page without a host decides alone
    assert by_id[0].text == (prose * 5).strip() and by_id[10].text == "" and by_id[11].n_chars == 0 and by_id[12].text == "x y z."
    assert all(r.n_chars == len(r.text) for r in found)
    assert pages.extract(df.limit(0)).count() == 0


def plain_nearest(rows, k, every):
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in usable:
        if q % every == 0 and q not in out:
            near = sorted((float(np.sqrt(np.einsum("i,i->", v - x, v - x))), i) for i, v in usable if i != q and len(v) == len(x))
            out[q] = near[:k]
    return out


def recall(found, expected):
    hits = sum(len({i for _, i in near} & {r.vec_id for r in found if r.query_id == q}) for q, near in expected.items())
    return hits / max(1, sum(map(len, expected.values())))


@pytest.mark.parametrize("how", [{}, {"cell_rows": 100, "block": 60, "query_chunk": 7}])
def test_nearest(spark, how):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=32)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[10][1]) for i in range(200)]  # a large group of copies
    rows += [(3000, None), (3100, [0.0] * 32), (3200, [1.0, None] * 16), (3300, [float("nan")] * 32), (3400, [float("inf")] * 32), (None, rows[3][1])]
    rows += [(3500, [1.0, 2.0]), (3600, [1.0, 2.5]), (3700, []), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("p", F.lit(1))
    found = ann.nearest(df, k=10, every=20, **how).collect()
    expected = plain_nearest(rows, 10, 20)
    assert recall(found, expected) >= 0.9 and {r.query_id for r in found} == {q for q, near in expected.items() if near}
    exact = {(q, i): d for q, near in plain_nearest(rows, 10**9, 20).items() for d, i in near}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], rel=1e-12) for r in found)
    for q in expected:
        own = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: (x[1], x[2]))
    copies = [r.vec_id for r in sorted((r for r in found if r.query_id == 2000), key=lambda r: r.rank)]
    assert copies == [10, *range(2001, 2010)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(ann.nearest(df).collect(), plain_nearest(rows, 10, 100)) >= 0.9


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3) and ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_pipeline(spark, sf):
    docs, columns = table(spark, sf, "documents"), table(spark, sf, "documents").columns
    sizes, stages = [docs.count()], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns, name
        sizes.append(docs.count())
        stages.append(docs)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    # No later stage's work is left undone in what the pipeline keeps.
    kept = dict(zip((n for n, _ in corpus_pipeline.STAGES), stages))
    assert simhash.components(kept["near_dedup"]).groupBy("component_id").count().filter("count > 1").count() == 0
    assert linededup.report(kept["line_dedup"]).filter("n_dropped > 0").count() == 0
    assert secrets.scan(kept["secret_scan"], written(secrets.planted_findings(kept["near_dedup"]), "test-planted")).filter("is_secret").count() == 0
    labels = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    assert docs.join(labels, "doc_id").count() <= 0.1 * labels.count()
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.select("sequence_id").distinct().count() == packed.count()


def test_stages_take_odd_documents(spark, docs_of, odd_pairs):
    for pairs in (odd_pairs, []):
        docs = docs_of(pairs)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            out.collect()
            if name != "pack_sequences":
                assert out.columns == docs.columns, name
