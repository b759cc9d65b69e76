"""Clustering, the filter audit and HTML extraction against brute force, and their odd rows."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from bindery.llm import audit, clusters, htmltext

# ---- clustering


def brute_lloyd(rows, k, rounds, width):
    """rows: (vec_id, components). Plain Lloyd in whole numbers."""
    kept = [(i, [min(max(math.floor(1024 * float(c)), -(2**62)), 2**62) for c in v], v) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, q) for i, q, v in kept if i is not None)
    centre = [q for _, _, q in named[:k]] or [[0] * width]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centre))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q, _ in kept]
        for n in range(len(centre)):
            if mine := [q for (_, q, _), o in zip(kept, own, strict=True) if o == n]:
                centre[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(q)) for i, q, _ in kept]
    most = 2**63 - 1
    every = min(most, sum(min(d, most) for _, d, _ in found))
    out = []
    for i, d, n in found:
        out.append((i, n, min(d, most), min(most, sum(min(e, most) for _, e, m in found if m == n)), every, hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()))
    return sorted(out, key=repr)


def lloyd(spark, rows, k=8, rounds=10, width=64, kind="double"):
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance double").repartition(3)
    return sorted((tuple(r) for r in clusters.cluster(table, k=k, rounds=rounds, width=width).collect()), key=repr)


def grouped(n, width, spread, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, width))
    return [(i, (centre[i % 5] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "spread", "k", "tree"), [(600, 64, 0.05, 8, 2048), (400, 64, 1.0, 8, 100), (500, 3, 0.3, 20, 64), (300, 1, 0.0, 4, 2048)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, n, width, spread, k, tree):
    monkeypatch.setattr(clusters, "TREE", tree)
    rows = grouped(n, width, spread)
    assert lloyd(spark, rows, k=k, width=width) == brute_lloyd(rows, k, 10, width)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]  # many ties
    odd = [(None, [1.0, 2.0, 3.0, 4.0]), (100, None), (101, [1.0, 2.0]), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf")] * 4), (105, [])]
    rows = base + odd + base[:10] + [(7, [9.0, 9.0, 9.0, 9.0])]
    assert lloyd(spark, rows, k=6, width=4) == brute_lloyd(rows, 6, 10, 4)
    assert lloyd(spark, base[:3], k=6, width=4) == brute_lloyd(base[:3], 6, 10, 4)
    assert lloyd(spark, odd, k=6, width=4) == brute_lloyd(odd, 6, 10, 4)
    assert lloyd(spark, [], k=6, width=4) == []
    same = [(i, [0.5] * 4) for i in range(50)]
    assert lloyd(spark, same, k=6, width=4) == brute_lloyd(same, 6, 10, 4)
    large = base + [(200, [1e12, -1e12, 5.0, 0.0]), (201, [3e17, 1e300, 0.0, 0.0]), (202, [4000.0, 0.0, 0.0, 0.0])]
    assert lloyd(spark, large, k=6, width=4) == brute_lloyd(large, 6, 10, 4)


def test_cover_trees_nest_cover_and_separate():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(-50, 50, (300, 3)), rng.integers(900, 950, (300, 3))])
    tree, order = clusters.cover_tree(rows, leaf=4)
    assert (tree.rows == rows[order]).all() and sorted(order) == list(range(600))
    pruned = 0
    for k in range(len(tree.begin)):
        own = tree.rows[tree.begin[k] : tree.end[k]]
        assert tree.begin[k] <= tree.centre[k] < tree.end[k]
        assert np.sqrt(((own - tree.rows[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        below = range(tree.first[k], tree.first[k] + tree.children[k])
        if below:
            assert [tree.begin[below[0]], tree.end[below[-1]]] == [tree.begin[k], tree.end[k]]
            assert tree.centre[k] in tree.centre[list(below)]
            for a, b in itertools.combinations(below, 2):
                assert tree.end[a] <= tree.begin[b] or b > a + 1
                assert np.sqrt(((tree.rows[tree.centre[a]] - tree.rows[tree.centre[b]]) ** 2).sum()) > tree.radius[k] / clusters.BASE
            assert all(tree.radius[c] <= tree.radius[k] / clusters.BASE + 1e-9 for c in below)
    begin, end, _ = clusters.Centroids([[0, 0, 0], [920, 920, 920]]).nearest(tree)
    pruned = len(begin)
    assert (end - begin).sum() == 600 and pruned < 10  # whole nodes, not vectors


# ---- the filter audit


def brute_audit(docs, labels):
    def failures(i, text):
        words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text).split(" ") if w]
        out = ""
        out += "A" * (len(words) < 200)
        out += "B" * (100 * len(set(words)) < 50 * len(words))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        out += "D" * any(c in "#$%&*|" for c in text)
        out += "E" * any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        return out

    facts = []
    for i, text, source in docs:
        good, toxic = (i is not None and any(j == i and row[k] == 1 for j, *row in labels) for k in (0, 1))
        facts.append((source or "", failures(i, text or ""), good, toxic))
    out = []
    for part in {f[0] for f in facts}:
        mine = [f[1:] for f in facts if f[0] == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed_of[x] += len(gone)
                rows.append((part, order, step, len(left), len(gone), sum(x in d[0] for d in mine) - len(gone), sum(d[0] == x for d in mine), sum(d[1] for d in gone), sum(d[2] for d in gone), x))
        out += [(*r[:-1], removed_of[r[-1]]) for r in rows]
    return sorted(out)


def run_audit(spark, docs, labels):
    left = spark.createDataFrame([(*d, "z", 0) for d in docs], "doc_id long, text string, source string, mask string, quality int")
    right = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    return sorted(map(tuple, audit.audit(left, right).collect()))


def test_audit_equals_running_every_order(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(150):
        n = rng.choice([3, 199, 200, 250])
        words = [rng.choice(["ab", "cd", "E" * rng.randint(1, 3)]) if rng.random() < 0.5 else f"w{k}" for k in range(n)] if rng.random() < 0.5 else [f"w{k}é" for k in range(n)]
        texts.append(rng.choice([" ", "\t", "\x0b", " \r\n"]).join(words) + rng.choice(["", " $", "|", " x"]))
    texts += rng.choices(texts, k=80) + ["", None, None, " \t", "é" * 300]
    docs = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += docs[3:6] + [(None, texts[0], "a"), (None, texts[0], "a"), (5, texts[0], "b"), (1000, " ".join(f"x{k}" for k in range(60_000)), "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(200)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    assert run_audit(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_few_rows(spark):
    assert run_audit(spark, [], [(1, 1, 1)]) == []
    docs = [(1, None, None)]
    got = run_audit(spark, docs, [])
    assert got == brute_audit(docs, []) and len(got) == 600


def test_parity_sums_invert(spark):
    rng = random.Random(3)
    rows = [("p", rng.random() < 0.3, rng.random() < 0.2, rng.randrange(32)) for _ in range(500)]
    sums = audit.parity_sums(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int"))
    for r in sums.collect():
        mine = [m for _, g, t, m in rows if (g, t) == (r.good, r.toxic)]
        assert list(r.parity) == [sum((-1) ** (m & s).bit_count() for m in mine) for s in range(32)]
    found = audit.cells(sums).first()
    assert list(found.every_cells) == [sum(x[3] == m for x in rows) for m in range(32)]
    assert list(found.good_cells) == [sum(x[3] == m and x[1] for x in rows) for m in range(32)]


# ---- HTML


def sentence(rng, n):
    return " ".join(rng.choice(["river", "stone", "cloud", "paper", "green", "walk", "letter", "often"]) + str(rng.randrange(100)) for _ in range(n)) + "."


def article_page(rng):
    title, paras = sentence(rng, 5), [sentence(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    items = [sentence(rng, 6) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in paras) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    page = f"""<!doctype html><html><head><title>{title} - Site</title><style>p{{}}</style></head><body class="has-sidebar"><header><h2>Site name</h2></header>
    <nav><a href=/a>Home</a> <a href=/b>About</a></nav><div class="cookie-notice">{sentence(rng, 40)}</div>
    <article class="post post-{rng.randrange(999)}"><h1>{title}</h1>{body}<div class="share">Share this</div></article><aside>{sentence(rng, 30)}</aside>
    <section id="comments"><p>{sentence(rng, 200)}</p><form><textarea>say</textarea></form></section><footer><p>{sentence(rng, 20)}</footer></body></html>"""
    return page, " ".join([title, *paras, *items])


def plain_page(rng, remarks=0):
    """Containers without a telling name: readers' remarks stand in one such, too."""
    title, paras = sentence(rng, 5), [sentence(rng, rng.randint(30, 60)) for _ in range(rng.randint(4, 6))]
    said = "".join(f"<p>{sentence(rng, 60)}</p>" for _ in range(remarks))
    page = f"""<body><div class="x{rng.randrange(9)}"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>
    <div class="k1 w{rng.randrange(99)}"><h1>{title}</h1><div>{"".join(f"<p>{p}" for p in paras)}</div></div><div class="r{rng.randrange(9)}">{said}</div><div class="ad-{rng.randrange(9)}">{sentence(rng, 80)}</div></body>"""
    return page, " ".join([title, *paras])


@pytest.mark.parametrize("few", [50_000, 0])
def test_html_of_several_hosts(spark, few):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(60):
        page, text = article_page(rng)
        rows.append((k, f"https://a.example/{k}", page))
        want[k] = text
    for k in range(60, 120):
        # one page in ten has more remarks than article: its own best container is not the article
        page, text = plain_page(rng, remarks=20 if k % 10 == 0 else 0)
        rows.append((k, f"http://User@B.example:80/{k}?x=1", page))
        want[k] = text
    odd = {200: None, 201: "", 202: "just &lt;text&gt;  here", 203: "<nav>only menu</nav>", 204: "<body><p>cut <b>off &am", 205: "<script>x</script"}
    rows += [(k, None if k % 2 else "no url", page) for k, page in odd.items()] + [(None, "https://a.example/", rows[0][2]), rows[0]]
    want |= {200: "", 201: "", 202: "just <text> here", 203: "", 204: "cut off &am", 205: ""}
    table = spark.createDataFrame([(*r, "other", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(4)
    got = htmltext.extract(table, few=few, large=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id if r.page_id is not None else 0], r.page_id
        assert r.n_chars == len(r.text)
    own = [r for r in rows if r[0] is not None and r[0] % 10 == 0 and 60 <= r[0] < 120]
    assert any(htmltext.Page(r[2]).text(htmltext.Page(r[2]).best()) != want[r[0]] for r in own)  # the votes are needed
    paths = {(r.host, r.path): r.votes for r in htmltext.host_paths(table).collect()}
    assert paths[("a.example", "html>body.has-sidebar>article.post")] == 62
    assert ("b.example", "body>div.k#") in paths


def test_html_of_an_empty_table(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract(table).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<b>b</b>c<br>d&nbsp; &eacute;&#233;&copy;x</p><p>e", "abc d éé©x e"),
        ("<body><p title='a > b'>one</p><!-- <p>no</p> --><p>two<script>var t='</p>';</script></p><p hidden>three</p>", "one two"),
        ("<main><header><h1>T</h1><p>by x</p></header><p>text text text</p><footer>f</footer></main>", "T text text text"),
        ("<form id=aspnet><div><p>long text of the page</p><select><option>a</select></div></form>", "long text of the page"),
        ("<table><tr><td><a href=1>a</a><td><p>cell text one</p><p>cell two</table>", "cell text one cell two"),
        ("<article><p>one</p><ul><li><a href=1>x1</a><li><a href=2>x2</a><li><a href=3>x3</a></ul><p>two</p><article class=comment><p>c c c c</p></article></article>", "one two"),
        ("<div class=main-content><section><p>part one is here</p></section><section><p>part two is there</p></section></div>", "part one is here part two is there"),
        ("<p>x < y and a &lt b &am; </p></div></p><p>z</p></body></html><p>after", "x < y and a < b &am; z after"),
    ],
)
def test_html_small_pages(page, text):
    found = htmltext.Page(page)
    assert found.text(found.best()) == text


def test_html_of_the_tables(spark, sf_dir):
    import html
    import re

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = {r.page_id: r.html for r in table.collect()}
    got = htmltext.extract(table).collect()
    assert len(got) == len(pages)
    for r in got:
        own = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", own)).split())


def test_html_takes_linear_time():
    for page in ("<b>" * 50_000 + "x</b>" * 50_000, '<a href="' * 50_000, "<div>" * 50_000 + "x", "<" * 100_000, "<ul><li><a href=x>a</a>" * 20_000, "<!--" * 50_000, "<b>" * 20_000 + "<p>x</p>" * 20_000):
        found = htmltext.Page(page)
        found.text(found.best())
