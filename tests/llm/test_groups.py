"""Quality, page text, model scoring, vector and text duplicates and the pipeline, against brute force."""

import collections
import hashlib
import html
import math
import pathlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, decontaminate, html_text, jaccard_join, lm_score, near_vectors, quality, secrets, substring_dedup

DOCS = "doc_id long, text string, class long, n int, set string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], DOCS)


def groups(ids, linked):
    """The smallest id reachable, by repeated minima."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, linked = collections.defaultdict(list), []
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in where[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                linked.append((i, j))
        for x in s:
            where[x].append(i)
    label = groups(sets, linked)
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard(spark, sf):
    base = [f"w{k}" for k in range(60)]
    crowd = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 60, 2)]
    chain = [" ".join(f"c{k}" for k in range(s, s + 80)) for s in range(0, 60, 6)]
    texts = [None, "", " \n", "One two", "one TWO", "one  two ", "a b c d e", "A B C D E f", " ".join(base), " ".join(base) + "\n", *crowd, *chain, "z " * 4000, "z " * 4100, "é É x y z"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs(spark, texts)).collect()}
    assert got == brute_jaccard(enumerate(texts))
    assert jaccard_join.jaccard_groups(docs(spark, ["x"]).limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (0, "A  b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(twice).where("doc_id is not null").collect()) == [(False, 0, 0), (False, 1, 0), (False, 1, 0)]
    # a crowd of near copies round a text that need not be among them, some too far from all
    rng = random.Random(5)
    for centre in (True, False):
        crowd = [base * centre] if centre else []
        for _ in range(150):
            crowd.append([f"x{rng.random()}" if rng.random() < rng.choice((0.01, 0.02, 0.08)) else w for w in base])
        crowd = [" ".join(c) for c in crowd]
        groups_ = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs(spark, crowd)).collect()}
        assert groups_ == brute_jaccard(enumerate(crowd))
        left = sorted(r.doc_id for r in jaccard_join.first_of_each(docs(spark, crowd)).collect())
        assert left == sorted({c for _, c in groups_.values()})
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op2_jaccard(spark, sf).collect()} == brute_jaccard(rows)


def test_quality(spark, sf):
    scored = quality.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.9
    texts = docs(spark, [None, "", "a", "word " * 9000, "Fine text here.", "Fine text here."])
    labels = spark.createDataFrame([(3, 0), (4, 1), (5, None), (None, 1), (99, 1), (4, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        out = [r.s for r in texts.select(quality.score(spark, F.col("text"), quality.fit(texts, known)).alias("s")).collect()]
        assert all(0 <= s <= 1 for s in out) and out[0] == out[1] and out[4] == out[5]


def test_quality_votes_are_exact():
    rng = np.random.default_rng(3)
    x, y = rng.poisson(0.05, (80, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 80)
    m = quality.Model(x, y)
    new = rng.poisson(0.05, (30, quality.TERMS)).astype(np.float32)
    for row, s in zip(m.latent(new), m.scores(new)):
        near = sorted(((float(v @ row), l) for v, l in zip(m.vectors, y)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.POWER, l) for c, l in near]
        assert abs(s - sum(v * l for v, l in votes) / sum(v for v, _ in votes)) < 1e-4


PAGES = [
    ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Top</header><nav>Menu</nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1>"
     "<p class=x>One\n two<br>three <b>bo</b>ld<p>Four &eacute;&#8364;<div class='comments'>Nice!</div><form>Mail <input></form><!-- gone --></article><aside>Side</aside><footer>&copy; us</footer></body></html>",
     "Head & tail One two three bold Four é€"),
    ("<body class='with-sidebar'><div id=header>Top</div><p>Plain body</p><div class='cookie notice'><p>We use</p></div><div hidden>no</div><table><tr><td>a</td><td>b</td></tr></table>", "Plain body a b"),
    ("<main>Kept<article class='comment'>Reply</article><p>a < b & c</p>cut off <a href=\"x", "Kept a < b & c cut off"),
    (None, ""), ("", ""), ("<nav>only</nav>", ""), ("<p>" + "x" * 100000, "x" * 100000), ("<script>never closed <p>a</p>", ""),
]


def test_pages(spark, sf):
    rows = [(i, f"http://h{i}.org/p", h, 1, "clash") for i, (h, _) in enumerate(PAGES)] + [(90 + k, "http://same.org/a", "<p>menu</p><p>own %d</p><p>foot</p>" % k, 1, "x") for k in range(5)] + [(99, None, "<p>q</p>", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, k0 long, text string")
    got = {r.page_id: r.text for r in html_text.extract(df, keep=("page_id", "url", "k0")).collect()}
    assert len(got) == len(rows)
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == want
    assert [got[90 + k] for k in range(5)] == [f"own {k}" for k in range(5)] and got[99] == "q"
    assert html_text.extract(df.limit(0)).count() == 0
    for r in html_text.op5_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        article = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        assert r.text == " ".join(html.unescape(article).split()) and r.n_chars == len(r.text)


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(500):
        a, b = (["abcdef"[k] for k in rng.integers(0, 5, rng.integers(0, 14))] for _ in range(2))
        shared = sorted(html_text.shared_lines(a, b))
        rest = iter(b)
        assert len(shared) == longest(a, b) and all(a[i] in rest for i in shared)


def test_scores(spark):
    texts = [None, "", "The cat sat", "the cat  ran", "xx yy", "b " * 3000, "the cat sat", "É é the"]
    df = docs(spark, texts).withColumn("target", F.col("doc_id").isin(2, 3))
    m = lm_score.fit(df.select("text", "target"))
    got = [r.s for r in df.orderBy("doc_id").select(lm_score.score(spark, F.col("text"), m).alias("s")).collect()]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    sides = []
    for part in (texts, [texts[2], texts[3]]):
        one, pair, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for t in part:
            w = ["", *cut(t)]
            one.update(w[1:])
            ctx.update(w[:-1])
            pair.update(zip(w, w[1:]))
        sides.append((one, pair, ctx, sum(one.values())))
    for t, s in zip(texts, got):
        w, gain = ["", *cut(t)], 0.0
        for h, x in zip(w, w[1:]):
            for sign, (one, pair, ctx, n) in zip((1, -1), sides):
                p = (one[x] + lm_score.UNIFORM) / (n + lm_score.UNIFORM * (1 << m.bits))
                gain += sign * math.log((pair[h, x] + lm_score.WORD * p) / (ctx[h] + lm_score.WORD))
        assert abs(s - gain / max(1, len(w) - 1)) < 1e-4
    assert got[2] == got[6] < got[4] and got[0] == got[1] == 0
    empty = lm_score.fit(df.select("text", "target").limit(0))
    assert df.select(lm_score.score(spark, F.col("text"), empty).alias("s")).where("s <> 0").count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors(spark, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:140] = x[100] + 0.12 * rng.standard_normal((40, 16))
    x[200:210] = x[200]
    x[210] = x[200] * 3
    x[220] = 0
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)]
    rows += [(300, None, 1, "x"), (301, [], 1, "x"), (302, [None] * 16, 1, "x"), (303, [float("nan")] * 16, 1, "x"), (304, [1.0, 2.0], 1, "x"), (305, [1.0, 2.0], 1, "x"), (None, rows[0][1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links long, key string")
    got = {r.vec_id: tuple(r)[1:] for r in near_vectors.near_vectors(df, block=block).collect()}
    with np.errstate(all="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.nan_to_num(u @ u.T) >= 0.95
    np.fill_diagonal(same, False)
    label = groups(range(300), list(zip(*np.nonzero(same))))
    found = sum(got[i][0] for i in range(300)) / same.sum()
    assert 0.97 <= found <= 1 and all(got[i][0] <= same[i].sum() for i in range(300))
    assert sum(got[i][1] == label[i] for i in range(300)) >= 297 and all(got[i][2] == (got[i][1] == i) for i in range(300))
    assert [got[i][:2] for i in (300, 301, 302, 303)] == [(0, i) for i in (300, 301, 302, 303)] and got[305][:2] == (1, 304) and got[None] == (0, None, True)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b, hit = (t or "").encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit.update(range(p, p + 100))
            seen.add(b[p : p + 100])
        kept = bytes(x for k, x in enumerate(b) if k not in hit)
        out[i] = (len(b), len(hit), sum(k - 1 not in hit for k in hit), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark, sf, tmp_path):
    rng = np.random.default_rng(6)
    some = lambda n: "".join("abcdefgé \0"[k] for k in rng.integers(0, 10, n))
    long, mid = some(700), some(160)
    texts = [None, "", "x" * 99, "y" * 100, "y" * 101, long, some(50) + long[100:300] + some(60) + mid, mid + long[:150], "ab" * 2000, "ab" * 100 + mid[:99], long, some(30) + mid[20:130] + mid[30:150], *(some(40) + mid + some(40) for _ in range(30)), "y" * 100]
    for at in range(40):
        texts.append(some(20) + long[at * 10 : at * 10 + 90 + int(rng.integers(0, 60))] + some(25))
    path = str(tmp_path)
    docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    want = brute_repeats(enumerate(texts))
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.op10_substring_dedup(spark, path).collect()} == want
    for hot in (0, 3):  # buckets beyond so many surroundings are grouped string by string
        cut = substring_dedup.remove_repeats(docs(spark, texts), hot=hot).collect()
        assert {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in cut} == {i: x[3] for i, x in want.items()}
    same = spark.createDataFrame([(None, long), (1, long), (1, long), (1, mid), (0, mid)], "doc_id long, text string")
    left = sorted((-1 if r.doc_id is None else r.doc_id, len(r.kept)) for r in substring_dedup.remove_repeats(same).collect())
    assert left == [(-1, len(long.encode())), (0, len(mid.encode())), (1, 0), (1, 0), (1, 0)]
    assert substring_dedup.remove_repeats(same.limit(0)).count() == 0
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.op10_substring_dedup(spark, sf).collect()} == brute_repeats(rows)


def test_pipeline(spark, sf):
    from test_scans import brute_contamination
    from tokenizers import Tokenizer

    from tidewatch.llm import bpe, pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in table.orderBy("doc_id").collect()]
    scores = model.scores(np.stack([quality.terms_of(r.text) for r in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= 0.3]
    group = brute_jaccard([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if group[r.doc_id][1] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if not brute_contamination(r.text, items)[-1]]
    lib = Tokenizer.from_file(bpe.default_path())
    want = {r.doc_id: lib.encode(secrets.redacted(r.text) or "", add_special_tokens=False).ids for r in rows}
    got = {r.doc_id: list(r.ids) for r in pipeline.run(spark, sf).collect()}
    assert got == want and len(want) < table.count()
    assert decontaminate.SIZE == 13


def brute_scores(texts, target, some=None):
    """Each text under bigram models of the other texts, counted anew for it."""
    cut = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) for t in texts]
    sides = []
    for of in (range(len(texts)), sorted(target)):
        one, pair, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for i in of:
            w = ["", *cut[i]]
            one.update(w[1:])
            ctx.update(w[:-1])
            pair.update(zip(w, w[1:]))
        sides.append((one, pair, ctx, sum(one.values()), sum(bool(cut[i]) for i in of), set(of)))
    out = {}
    for i in range(len(texts)) if some is None else some:
        w, gain = ["", *cut[i]], 0.0
        own, owns, ctxs = collections.Counter(w[1:]), collections.Counter(zip(w, w[1:])), collections.Counter(w[1:-1])
        for h, x in zip(w, w[1:]):
            for sign, (one, pair, ctx, n, texts_, of) in zip((1, -1), sides):
                k = i in of
                p = (one[x] - k * own[x] + lm_score.UNIFORM) / (n - k * (len(w) - 1) + lm_score.UNIFORM * (1 << lm_score.BITS))
                context = texts_ - k if h == "" else ctx[h] - k * ctxs[h]
                gain += sign * math.log((pair[h, x] - k * owns[h, x] + lm_score.WORD * p) / (context + lm_score.WORD))
        out[i] = gain / max(1, len(w) - 1)
    return out


def test_scores_of_many_pairs(spark):
    """Each n-gram is counted for itself, however many there are: 1.2 million distinct pairs, and one that stands out."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(200_000)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 60_000)) for _ in range(20)] + ["left right"] * 40 + ["left wrong"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r.id: r.score for r in lm_score.scored(df, spark.range(20, 61)).collect()}
    want = brute_scores(texts, range(20, 61), (0, 7, 19, 20, 59, 60))
    assert len(got) == len(texts) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_scores_leave_the_text_out(spark, tmp_path):
    texts = [None, "", "...", "One one two", "a b c", "a b c", "a b a b a", "x", "x y", "é x", "b " * 300, "only here words"]
    df = docs(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(3, 1), (5, 1), (6, 1), (7, 0), (8, None), (9, 1), (9, 1), (77, 1), (None, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.ce_diff for r in lm_score.op6_lm_score(spark, str(tmp_path)).collect()}
    want = brute_scores(texts, {3, 5, 6, 9})
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    none = {r.id: r.score for r in lm_score.scored(df.selectExpr("doc_id as id", "text"), spark.range(0)).collect()}
    want = brute_scores(texts, set())
    assert all(abs(none[i] - want[i]) < 1e-9 for i in want)
    assert lm_score.scored(df.selectExpr("doc_id as id", "text").limit(0), spark.range(1)).count() == 0


def test_vectors_of_all_lengths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n, count in ((16, 60), (24, 40), (5, 2)):
        x = rng.standard_normal((count, n))
        x[1] = x[0] * 3 + 0.01
        rows += [(len(rows) + k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == got[i + 1] == (1, i) for i in (0, 60, 100)) and len(got) == 102


def test_hidden_is_an_attribute_name():
    page = "<article><p>a <a href='/x' title='A hidden gem'>b</a></p><p class=\"lg hidden md\">c</p><p hidden>d</p><p class='x'hidden>e</p><p hidden='until-found'>f</p><p title=hidden>g</p></article>"
    assert " ".join(t for t, s in html_text.lines_of(page) if s == html_text.HELD) == "a b c g"


def page_texts(spark, pages, partitions="4"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_differencing_beside_an_article_and_copies(spark):
    page = "<p>Menu</p><div>Body %d</div><article>Teaser</article><p>Foot</p>"
    pages = [(k, f"http://h.org/a/{k // 3}", page % (k // 3)) for k in range(9)]
    assert page_texts(spark, pages) == {k: f"Body {k // 3} Teaser" for k in range(9)}


def test_differencing_across_partitions(spark):
    pages = [(k, f"http://h.org/{k:03d}", f"<p>Menu {k // 4 % 2}</p><p>Own {k // 2}</p><p>Foot</p>") for k in range(60)]
    want = page_texts(spark, pages, "1")
    assert all(f"Own {k // 2}" in t and "Foot" not in t for k, t in want.items())
    assert page_texts(spark, pages, "7") == page_texts(spark, pages, "40") == want


def test_pages_are_dealt_once(spark):
    """Both passes read the files of one shuffle, without a copy beside it."""
    pages = [(k // 2, f"http://h.org/{k // 4:03d}", f"<p>Menu {k % 2}</p><p>Own {k}</p><p>Foot</p>") for k in range(60)]
    folder = pathlib.Path(common.shared_folder(spark).removeprefix("file:"))
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda h: read.add(1) or h, "string")
    copies = set(folder.rglob("*"))
    texts = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("html", seen("html")))
    assert sorted(r.text.split()[-1] for r in texts.collect()) == sorted(str(k) for k in range(60))
    # pages are read for the ranges and for the shuffle
    assert read.value == 2 * len(pages) and set(folder.rglob("*")) <= copies


def test_pipeline_edges(spark, sf, tmp_path):
    """Nulls, empty and long texts, repeated rows, ids with several texts and extra columns, stage by stage."""
    from tidewatch.llm import pipeline

    path, fine = str(tmp_path), "The river bent south here, and the old mill stood by it for years. Nobody came. "
    words = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n)) + "."
    texts = [(0, "A " + words(0)), (1, "A " + words(0)), (1, "B " + words(1)), (1, "B " + words(1)), (2, None), (2, None), (3, ""), (3, ""), (None, "C " + words(2)), (None, "C " + words(2)), (4, fine * 3000), (5, "D " + words(3) + " password=abcdef!SuperSecret#99xyz"), (6, "D " + words(3))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, class string, ids string, first string, found int, _id int"
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", 1, 2) for i, t in texts]
    docs_ = spark.createDataFrame(rows, kind).repartition(3)
    left = pipeline.distinct(spark, docs_, sf)
    assert left.columns == list(pipeline.COLUMNS)
    of = lambda df: sorted(((-1 if r.doc_id is None else r.doc_id, "-" if r.text is None else r.text[:1] or "e") for r in df.collect()))
    assert of(left) == [(-1, "C"), (-1, "C"), (0, "A"), (1, "B"), (2, "-"), (2, "-"), (3, "e"), (3, "e"), (4, "T"), (5, "D")]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs_, sf)
        assert name == "tokens" or out.columns == list(pipeline.COLUMNS)
        assert name in ("quality", "near_duplicates") or out.count() == len(rows)
        assert stage(spark, docs_.limit(0), sf).count() == 0
    clear = {r.doc_id: r.text for r in pipeline.redacted(spark, docs_, sf).collect()}
    assert "Secret" not in clear[5] and "99xyz" not in clear[5] and clear[2] is None and clear[3] == "" and clear[4] == fine * 3000
    docs_.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    # without labels all score alike, and stay
    assert pipeline.run(spark, path).count() == 10


def test_components_of_few_and_of_many_edges(spark):
    """One task and rounds give the same, of numbers and of bytes, with loops, nulls, repeated and reversed edges."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (130, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)]
    edges += [(b, a) for a, b in edges[:40]] + [(5000, 5000), (None, 1), (1, None)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in up and b in up and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for few in (0, common.FEW):
        assert {r.node: r.component for r in common.components(df, few=few).collect()} == up
    as_bytes = lambda x: None if x is None else (x + 200 << 50).to_bytes(8)
    df = spark.createDataFrame([(as_bytes(a), as_bytes(b)) for a, b in edges], "a binary, b binary")
    for few in (0, common.FEW):
        got = common.components(df, few=few).collect()
        assert {bytes(r.node): bytes(r.component) for r in got} == {as_bytes(a): as_bytes(b) for a, b in up.items()} and len(got) == len(up)
    assert common.components(df.limit(0)).count() == 0


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_jobs_do_not_grow_with_partitions(spark):
    """A job for each partition, or rounds over a few edges, would make hundreds of short jobs."""
    df = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found, jobs = jobs_of(spark, lambda: common.components(df))
    assert {r.component for r in found.collect()} == {0} and jobs <= 8
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        bits, jobs = jobs_of(spark, lambda: jaccard_join._id_bits(df.select(F.col("a").alias("id"))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert np.unpackbits(bits).sum() == 400 and jobs <= 10
