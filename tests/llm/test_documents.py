"""Dedup, language, toxicity, extraction and URL operators on small tables, with nulls, repeats, ties and empty input."""

import html as entities
import re
import time
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from treeweave.llm import html, langid, neardup, queries, substrings, toxicity, urls
from treeweave.llm.components import components

DOCS = "doc_id long, text string, score string"


def words(rng, n, lo=0, hi=5000):
    return [f"w{rng.integers(lo, hi)}" for _ in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 3), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_fixture():
    rng = np.random.default_rng(3)
    texts = [" ".join(words(rng, 200)) for _ in range(40)]
    for base in range(6):  # chains of edits: each like the one before
        now = texts[base].split()
        for _ in range(5):
            now = list(now)
            now[rng.integers(0, len(now))] = "edited" + str(rng.integers(1000))
            texts.append(" ".join(now))
    shared = " ".join(words(rng, 60))
    texts += [shared + " " + " ".join(words(rng, 60)) for _ in range(30)]
    return texts + [texts[0], texts[0].upper(), "", None, "  ", "one two", "one two"]


def test_near_duplicates_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = near_fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")], DOCS)
    got = {(r["_id"], r["class_id"], r["copies"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    sets = [neardup.shingles(t) for t in texts]
    counts = np.zeros(1 << neardup.COUNTER_BITS)
    for i in [*range(len(texts)), 2]:
        counts += np.bincount(np.unique(sets[i][1]) >> np.uint32(12), minlength=len(counts))
    idf = neardup.shingle_weights(counts, len(texts) + 1.0)
    root = [*range(len(texts))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i][0] == sets[j][0] or neardup.similarity(sets[i][1], sets[j][1], idf) >= neardup.SIMILAR:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    classes = {i: find(i) for i in range(len(texts))}
    assert {(i, c) for i, c, _, _ in got} == {*classes.items()}
    assert {i for i, _, _, kept in got if kept} == {*classes.values()}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**32, 300, dtype=np.uint32)
    a, b = np.unique(pool[:250]), np.unique(pool[50:])
    w = dict(zip(pool.tolist(), rng.uniform(0.5, 5, 300)))
    true = sum(w[x] for x in np.intersect1d(a, b).tolist()) / sum(w[x] for x in np.union1d(a, b).tolist())
    logs = np.log([w[x] for x in np.concatenate([a, b]).tolist()]).astype(np.float32)
    s = neardup.consistent_samples(np.concatenate([a, b]), logs, np.array([0, len(a)]), 1000)
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_substrings_as_brute_force(spark):
    rng = np.random.default_rng(4)
    sentence = lambda: " ".join(words(rng, rng.integers(3, 12))).capitalize() + ". "
    passage = "".join(sentence() for _ in range(9))
    run_on = " ".join(words(rng, 80)) + " "
    texts = ["".join(sentence() for _ in range(12)) + (passage if i % 3 == 0 else "") + "".join(sentence() for _ in range(5)) + (run_on if i % 4 == 0 else "") for i in range(24)]
    texts += [None, "", "short.", texts[1], passage + passage, " \n lead " + texts[2]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, texts[7], "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", n_removed int")
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    first = {}
    order = sorted({(-(2**63) if i is None else i, t) for i, t, _ in rows if t})
    for i, t in order:
        for at, n, h in zip(*substrings.spans(*substrings.sentences(t)[1:])):
            first.setdefault(h, (i, at))
    want = set()
    for i, t, _ in rows:
        if not t:
            want.add((i, t, 0))
            continue
        head, parts, sizes = substrings.sentences(t)
        assert head + "".join(parts) == t
        gone = set()
        for at, n, h in zip(*substrings.spans(parts, sizes)):
            if first[h] != (-(2**63) if i is None else i, at):
                gone |= {*range(at, at + n)}
        left = [p for k, p in enumerate(parts) if k not in gone]
        want.add((i, t if not gone else (head + "".join(left)).rstrip() if left else "", len(gone)))
    assert got == want
    holding = [r for r in got if r[1] and passage.strip()[20:120] in r[1]]
    assert len(holding) == 1
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def labelled(rng):
    syllables = {"aa": ["ba", "lo", "mi", "ru"], "bb": ["kt", "zz", "pfe", "sch"]}
    return [(i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]


def test_language(spark):
    rows = labelled(np.random.default_rng(6))
    docs = spark.createDataFrame([(*r, 0.5) for r in rows] + [(None, "ba lo", None, 0.5)], "doc_id long, text string, lang string, score double")
    texts = langid.training_texts(docs, F.col("doc_id") % 4 != 2)
    assert {*texts} == {"aa", "bb"} and all(len(t) <= langid.PER_LANGUAGE for t in texts.values())
    more = docs.unionByName(spark.createDataFrame([(90, None, "aa", 0.1), (91, "", "aa", 0.1), (92, "12 !? 34", "bb", 0.1), (93, "балоба", "bb", 0.1), (94, "ba " * 30000, "aa", 0.1)], docs.schema))
    got = {r["doc_id"]: r for r in langid.identify(more, texts).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3 and got[90]["score"] == 0
    assert got[93]["lang_pred"] in ("aa", "bb") and got[94]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(more, {}).collect()} == {"und"}
    assert langid.training_texts(docs.limit(0), F.lit(True)) == {}


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(7)
    train = "".join(rng.choice(list("abc "), 300))
    p = langid.Parser({"x": train})
    norm = lambda t: "".join(chr(c) for c in p.codes(t))
    held = norm(train)
    for _ in range(30):
        text = norm("".join(rng.choice(list("abcd "), 80)))
        i = n = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in held:
                k += 1
            i, n = i + k, n + 1
        raw = text.translate({langid.BETWEEN: " ", langid.UNKNOWN: "д"} | {p.code[ord(c)].item(): c for c in "abc"})
        assert p.phrases([raw])[0][0, 0] == n


def test_phrases_of_long_texts_are_those_of_one_reading(monkeypatch):
    rng = np.random.default_rng(8)
    texts = {"x": "".join(rng.choice(list("abc "), 400)), "y": "".join(rng.choice(list("abdé "), 900))}
    read = ["".join(rng.choice(list("abcdéf "), int(rng.integers(0, 400)))) for _ in range(60)]

    def longest_matches(train, text):
        i = n = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in train:
                k += 1
            i, n = i + k, n + 1
        return n

    for run, dense in ((5, 1 << 24), (64, 0), (2048, 1 << 24)):
        monkeypatch.setattr(langid, "RUN", run)
        monkeypatch.setattr(langid, "DENSE", dense)
        p = langid.Parser(texts)
        plain = lambda t: "".join(map(chr, p.codes(t)))
        assert p.phrases(read)[0].tolist() == [[longest_matches(plain(texts[k]), plain(t)) for k in p.languages] for t in read]


def test_language_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op6_cross_parsing(spark, "/root/testdata/sf0.01").collect()}
    unseen = [r for r in docs.collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[r["doc_id"]] == r["lang"] for r in unseen]) > 0.98


def test_toxicity_on_the_given_documents(spark):
    d = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r["doc_id"]: r["predicted"] for r in queries.op9_gated_recurrent(spark, d).collect()}
    unseen = [i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2]
    clean = [got[i] for i in unseen if not toxic[i]]
    assert np.mean(clean) < 0.03 and np.mean([got[i] for i in unseen if toxic[i]]) > 0.5  # some labels say toxic of texts that have nothing of it


def test_main_text_of_the_given_pages_and_what_the_cut_overrules(spark):
    """A page's article, block by block, as a plain reading of its markup gives it; and blocks that the cut labels against the classifier."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()

    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [re.sub(r"</?b>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", inner)]
        return " ".join(" ".join(entities.unescape(p).split()) for p in parts if p.strip())

    want = {r["page_id"]: article(r["html"]) for r in pages}
    got = queries.op5_minimum_cut(spark, "/root/testdata/sf0.01").collect()
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(want)
    overruled = 0
    for r in pages:
        _, x, edges = html.graph(r["html"])
        content = html.labelled(x, edges, html.PRIOR)
        alone = (x @ html.PRIOR > 0).tolist()
        overruled += sum(a != b for a, b in zip(content, alone, strict=True))
        assert " ".join(t for t, c in zip(html.graph(r["html"])[0], content, strict=True) if c) == want[r["page_id"]]
    assert overruled > 0


def test_short_lines_follow_their_neighbours():
    story = "<p>The first paragraph, which is long enough to be told from a menu, ends here.</p>"
    listed = f"<body><div class=post>{story}<ul><li>One</li><li>Two</li></ul>{story}</div></body>"
    _, x, edges = html.graph(listed)
    alone, content = x @ html.PRIOR, html.labelled(x, edges, html.PRIOR)
    assert (alone[1:3] < 0.5).all() and all(content)


def test_many_blocks_and_deep_pages_take_linear_time():
    flat = lambda n: "<body>" + "".join(f"<p>Paragraph {i}, with words.</p>" + "<div class=ad>ad</div>" * (i % 7 == 0) for i in range(n)) + "</body>"

    def seconds(page):
        start = time.process_time()
        html.main_text(page, html.PRIOR)
        return time.process_time() - start

    assert seconds(flat(20_000)) < 8 * seconds(flat(5_000)) + 0.5
    assert seconds("<div>" * 20_000 + "deep text" + "</div>" * 20_000) < 5


def test_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ws = ["alpha", "beta", "gamma", "de"]
    index = np.array([[0, 1], [2, 3], [1, 0], [3, 3]])
    mask = np.array([[1, 1], [1, 1], [1, 0], [0, 0]], bool)
    y = np.array([1.0, 0.0])

    def loss():
        x, _ = net.inputs(ws)
        z = net.logits(tuple(x @ net.p[f"W{s}"] + net.p[f"b{s}"] for s in "fb"), index, mask)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g = net.step(ws, index, mask, y)
    for k, v in g.items():
        at = np.unravel_index(np.argmax(np.abs(v)), v.shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-3 - v[at]) < 0.05 * abs(v[at]) + 1e-4, k


def test_windows_cover_every_word():
    for n in range(0, 200):
        seen = {w for s in toxicity.window_starts(n) for w in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == {*range(n)}


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    bad = ["grumblewort", "snarlfish", "grumbleton"]
    texts, labels = [], []
    for i in range(300):
        w = words(rng, 60, 0, 400)
        if i % 3 == 0:
            w[rng.integers(60)] = bad[i % 2]
            w[rng.integers(60)] = bad[(i + 1) % 2]
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (902, "... !", "s"), (903, "w1 " * 20000 + bad[0] + " " + bad[1], "s"), (904, " ".join(words(rng, 50, 0, 400) + bad[2:] * 2), "s")], DOCS)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, marks, F.col("doc_id") % 4 != 2)
    assert len(sample[0]) == sum(1 for i in range(300) if i % 4 != 2 and i != 5)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(*sample)).collect()}
    held = [i for i in range(300) if i % 4 == 2]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert got[903]["predicted"] == 1 and got[904]["score"] > np.median([got[i]["score"] for i in held if not labels[i]])
    assert all(got[i]["score"] < 1e-20 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.train([], []) == 0.0 and toxicity.train(["a"], [1]) == 1.0
    assert toxicity.score(docs.limit(0), 0.0).count() == 0


SOUP = """<html><body class="home has-sidebar"><form action=x><div id="top-nav"><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></div>
<div class="wrapper"><div class="cookie-notice">We use cookies. <button>OK</button></div><div class="post"><h2>A title &amp; more</h2><div>First long paragraph of the story,
with some commas, and an end. It goes on for a while.</div><div class="ad-slot">Buy now! Cheap, cheap.</div><div>Second paragraph x &lt; y with a <a href=q>link inside</a> and more words to read here.</div></div>
<div id="comments"><h3>Comments</h3><div class="comment"><p>Nice article, I liked it a lot, thanks for writing it.</p></div></div><div class="sidebar"><p>Popular posts this week, see them all, they are nice.</p></div></div>
<div class="footer">Copyright 2020. All rights reserved.</div></form><script>if(a<b){document.write("<p>x</p>")}</script></body>"""
ARTICLE = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/">x</a></nav><!-- ad --><div class="ad">Ad text.</div>
<article><h1>Head  line</h1><p><b>First &eacute;<br>part<p>Second.</p><aside>Not this.</aside><ul><li>One</li><li>Two</li></ul><section class="comments"><article><p>Reader says, hello there.</p></article></section></article><footer>&copy; me</footer>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", ARTICLE, "t"), (2, "u", SOUP, "t"), (3, None, None, None), (4, "u", "", "t"), (5, "u", "<div>", "t"), (6, "u", "<p>a" * 3000, "t"), (1, "u", ARTICLE, "t"), (7, "u", "<" * 500 + '<a "' * 50, "t")], "page_id long, url string, html string, text string")
    got = {}
    for r in html.extract_text(pages).collect():
        got[r["page_id"]] = r["text"]
    assert got[1] == "Head line First é part Second. One Two"
    assert got[2] == "A title & more First long paragraph of the story, with some commas, and an end. It goes on for a while. Second paragraph x < y with a link inside and more words to read here."
    assert [got[i] for i in (3, 4, 5)] == [""] * 3
    assert html.main_text("only  text, no &amp; markup", html.PRIOR) == "only text, no & markup"
    assert html.extract_text(pages.limit(0)).count() == 0


def test_minimum_cut_as_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        score = rng.normal(0, 2, n).tolist()
        edges = [(i, i + 1, float(rng.uniform(0, 2))) for i in range(n - 1)] + [(0, n - 1, 0.7)]
        cost = lambda side: sum(s for s, x in zip(score, side) if s > 0 and not x) - sum(s for s, x in zip(score, side) if s < 0 and x) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.minimum_cut(score, edges)) - best) < 1e-6


def test_urls(spark):
    rows = {
        "http://a.example.ORG/en/1?x": ("a.example.org", "/en/1", "example.org/en/1", "block"),
        "https://example.org/en/2#t": ("example.org", "/en/2", "org/", "allow"),
        "ftp://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr": ("x.com", "/fr", None, "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "x.com/de/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://x.com/de/1": ("b:", "//x.com/de/1", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(rows)] + [(0, [*rows][0], "old")], "page_id long, url string, verdict string")
    got = urls.judge_urls(pages, ["org/", "com/fr/"], ["example.org/es/", "example.org/en/1", "com/de/"]).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == rows[r["url"]], r["url"]
    assert urls.judge_urls(pages.limit(0), ["org/"], ["com/"]).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, [], []).collect()} == {"allow"}


def test_cascade_is_exact(spark, monkeypatch):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = [f"k{i}" for i in range(0, 4000, 100)]
    monkeypatch.setattr(urls, "PROBES", 1)  # many false positives, so several levels
    levels = urls.build_cascade(listed, keys, 4)
    assert len(levels) >= 3
    found = keys.filter(urls.listed_in(F.col("key"), levels)).collect()
    assert {r["key"] for r in found} == {*listed}


def test_parts_depend_on_nearby_words_only():
    rng = np.random.default_rng(12)
    run_on = words(rng, 400, 0, 60)
    for n in (*range(1, 40), 400):
        text = " ".join(run_on[:n]) + ". "
        head, parts, sizes = substrings.sentences(text)
        assert head + "".join(parts) == text and sum(sizes) == n and max(sizes) <= substrings.WINDOW

    def share_found(passage):  # of the passage's words, in a second document
        first, second = (" ".join([*words(rng, 50), *passage, *words(rng, 50)]) for _ in range(2))
        known = {*substrings.spans(*substrings.sentences(first)[1:])[2]}
        _, parts, sizes = substrings.sentences(second)
        gone = np.zeros(len(parts), bool)
        for at, n, h in zip(*substrings.spans(parts, sizes), strict=True):
            gone[at : at + n] |= h in known
        return np.repeat(gone, sizes)[50 : 50 + len(passage)].mean()

    shares = [share_found(words(rng, 51)) for _ in range(300)]
    assert min(shares) > 0 and np.mean(shares) > 0.8
    assert share_found(["again"] * 51) > 0.8


def test_the_24_word_limit_does_not_matter(spark):
    rng = np.random.default_rng(13)
    body = words(rng, 24)
    docs = spark.createDataFrame([(1, " ".join(body) + ". ", "x"), (2, "more " + " ".join(body) + ". ", "x")], DOCS)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 0 and len(got[2]["text"].split()) < 15


def test_texts_of_one_id_with_one_32_bit_hash_are_different_documents(spark):
    digests = [F.md5(F.concat_ws(" ", "id", F.lit(k))) for k in range(20)]
    texts = spark.range(300000).select(F.concat_ws(" ", *digests).alias("text"))
    a, b = texts.groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("t")).filter("size(t) > 1").first()["t"][:2]
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (1, a, "x")], DOCS)
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    assert (1, a, 0) in got and (5, b, 0) in got and len(got) == 3
    nulls = spark.createDataFrame([(None, a, "x"), (None, b, "x")], DOCS)
    assert {r["text"] for r in corpus_pipeline.near_dedup(spark, nulls, "").collect()} == {a, b}


def test_comments_that_outweigh_the_article():
    readers = "".join(f"<p>Reader {i} says, quite plainly, that this was a good thing to read, and more.</p>" for i in range(40))
    story = "<p>The story, in short, is told here in one paragraph, with commas, and it ends.</p>"
    text = "The story, in short, is told here in one paragraph, with commas, and it ends."
    for beside in ('<section class="comments">', '<div id="comments">', '<div class="cookie-notice">', '<div class="ad-slot">', '<div class="sidebar">'):
        end = "</section>" if "section" in beside else "</div>"
        for page in (f"<article>{story}</article>", f"<main>{story}</main>", f'<div class="post">{story}</div>'):
            assert html.main_text(f"<body>{page}{beside}{readers}{end}</body>", html.PRIOR) == text, (beside, page)
            around = f'<body><form><div class="page sidebar-right">{page}{beside}{readers}{end}</div></form></body>'
            assert html.main_text(around, html.PRIOR) == text, (beside, page, "around")
        if "sidebar" not in beside:
            assert "Reader" not in html.main_text(f"<body>{story}{beside}{readers}{end}</body>", html.PRIOR)


def test_null_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(20)
    passage = words(rng, 60)
    texts = [" ".join([*words(rng, 40), *passage, *words(rng, 40)]) for _ in range(3)]
    rows = [(None, texts[0], 7, "a"), (None, texts[1], 8, "b"), (-(2**63), texts[2], 9, "c"), (None, texts[0], 7, "a"), (None, None, 1, "d"), (None, "", 2, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _spans string").withColumns({"_t1": F.lit(1), "_several": F.lit(2), "h": F.lit(3), "place": F.lit(4)})
    out = substrings.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    got = {(r["doc_id"], r["_id"]): r for r in out.collect()}
    assert len(got) == 5 and out.count() == 6
    whole = [r for r in got.values() if r["text"] in texts]
    assert len(whole) == 1 and whole[0]["doc_id"] is None and whole[0]["n_removed"] == 0  # null comes first; of two null ids the smaller hash
    assert got[None, 1]["text"] is None and got[None, 2]["text"] == ""
    near = {(r["_id"], r["class_id"], r["copies"]) for r in neardup.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert (-(2**63), -(2**63), 1) in near and (None, None, 2) in near


def test_ids_with_several_texts_stay_apart_however_many(spark, monkeypatch):
    rng = np.random.default_rng(21)
    passage = " ".join(words(rng, 70))
    rows = [(i // 2, passage + " " + " ".join(words(rng, 30)), "x") for i in range(20)] + [(50, passage, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    found = lambda: sorted((r["doc_id"], r["text"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect())
    few = found()
    monkeypatch.setattr(substrings, "SHARED_IDS", 3)
    assert found() == few and sum(n == 0 for _, _, n in few) == 1


def test_languages_are_learned_from_whole_texts(spark):
    """Bounds choose documents; none is cut, not even one that alone is longer than a language's share."""
    long = "".join(chr(97 + i * i % 23) for i in range(3 * langid.PER_LANGUAGE))
    rows = [(i, f"word{i} " * (400 + 300 * (i % 5)), "xx") for i in range(30)] + [(100, long, "yy"), (101, long + "more", "yy"), (102, None, "zz"), (103, "", "zz")]
    learned = langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert learned["yy"] == "\n" + long and learned["zz"] == "\n"
    assert {*learned["xx"].split("\n")[1:]} <= {t for _, t, _ in rows} and len(learned["xx"]) <= langid.PER_LANGUAGE
