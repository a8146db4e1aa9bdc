"""Operators 11 to 13 against brute force, on faulty and odd input, and on rows with nulls, repeats and clashing columns."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldstrata.llm import common, runs, spelling, styletree

SF = "/root/testdata/sf0.001"


# --- operator 11


def lyndon(w, i):
    return max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n)))


def brute_runs(w, least=6, exponent=4):
    out = []
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, exponent * p) and not any(all(w[i + k] == w[i + k + q] for k in range(n - q)) for q in range(1, p)):
                out.append((i, n, p))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(g):
    k, n = g.choice([1, 2, 3, 4]), g.randrange(40)
    w = [g.randrange(k) for _ in range(n)]
    if g.random() < 0.5 and n > 4:
        p, a = g.randrange(1, 6), g.randrange(n)
        w = w[:a] + [w[a + i % p] if a + i % p < n else 0 for i in range(40)]
    return w


def test_groups_are_lyndon_words():
    g = random.Random(1)
    for _ in range(300):
        w = random_words(g)
        length, group = runs.lyndon_groups(w)
        assert length == [lyndon(w, i) for i in range(len(w))]
        words = [tuple(w[i : i + n]) for i, n in enumerate(length)]
        assert all((group[i] == group[j]) == (words[i] == words[j]) for i in range(len(w)) for j in range(i))


def test_runs_equal_brute_force():
    g = random.Random(2)
    for _ in range(1500):
        w = random_words(g)
        assert runs.runs_of(w) == brute_runs(w) == runs.word_runs([str(x) for x in w], common.WordHashes())


def test_long_texts_take_linear_time():
    start = time.time()
    assert runs.runs_of([i % 7 for i in range(200_000)]) == [(0, 200_000, 7)]
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    assert runs.runs_of(b) == []  # no run of a Fibonacci word has four periods
    assert time.time() - start < 30


def test_op11_equals_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = runs.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(rows) and sum(r.n_runs for r in got) > 20
    for r in got:
        w = re.findall("[^\x20\x09-\x0d]+", rows[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1200:
            continue
        number = {}
        found = brute_runs([number.setdefault(x, len(number)) for x in w])
        gone = {i for s, m, p in found for i in range(s + p, s + m)}
        s, m, p = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(r)[1:] == (len(found), s, m, p, m and 1000 * m // p, sha(told), sha(text))


def clashing(df):
    for i, c in enumerate(["n", "h", "a", "p", "w", "g", "word", "runs", "page", "host", "low", "path", "role"]):
        df = df.withColumn(c, F.lit(i if i % 2 else "x"))
    return df


DOCS = [(None, "a b " * 9), (None, None), (1, None), (2, ""), (2, " \n\t"), (3, "x " * 50), (3, "x " * 50), (4, "one two three")]


def test_runs_of_odd_rows(spark):
    df = clashing(spark.createDataFrame(DOCS, "doc_id long, text string"))
    got = runs.periodic_runs(df).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(
        [(None, 18, [(0, 18, 2)], "a b"), (None, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (3, 50, [(0, 50, 1)], "x"), (3, 50, [(0, 50, 1)], "x"), (4, 3, [], "one two three")], key=repr
    )
    assert runs.with_repeats(df).count() == 8 and runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, exponent=2)


# --- operator 12


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    keys, near, form = defaultdict(set), defaultdict(set), {}
    for w in n:
        for i in range(len(w) + 1):
            keys[w[:i] + "*" + w[i:]].add(w)
            keys[w[:i] + "*" + w[i + 1 :]].add(w)
    for g in keys.values():
        for w in g if len(g) > 1 else ():
            near[w] |= g - {w}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_op12_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12_spelling_variants(spark, "/root/testdata/sf0.01").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows) and sum(r[1] is not None for r in got) > 100


def test_variants_of_like_words(spark):
    """Words over two letters: equal grams many times over, chains of forms, ties of n."""
    g = random.Random(3)
    words = sorted({"".join(g.choice("ab") for _ in range(g.randrange(6, 12))) for _ in range(400)} | {"à" + "a" * 6, "a" * 7, "a" * 8, "a" * 9})
    rows = [(None, " ".join([w] * g.choice([5, 6, 30, 200, 1100]))) for w in words]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_pivots_are_the_lightest_pair():
    g = random.Random(4)
    for _ in range(500):
        places = sorted(g.sample(range(9), 5))
        weight = [g.randrange(9) for _ in places]
        a, b = spelling.pivots([(i, 0) for i in places], weight)
        pairs = [weight[x] + weight[y] for x in range(5) for y in range(x) if places[x] - places[y] >= 2]
        assert places[b] - places[a] >= 2 and weight[a] + weight[b] == min(pairs)


def test_words_of_odd_rows(spark):
    rows = [(None, "Stone-stones " * 5), (None, None), (1, None), (2, ""), (3, "STONES stonesİstones " * 3), (3, "x" * 100_000)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in spelling.vocabulary(df).collect()} == {("stones", 14)}
    assert [tuple(r) for r in spelling.spelling_variants(df).collect()] == [("stones", None, "stones", 14, 0, None)]
    assert spelling.spelling_variants(df.limit(0)).count() == 0


# --- operator 13


def texts(spark, rows, **more):
    got = styletree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), **more)
    return sorted(((r.page_id, r.text) for r in got.collect()), key=repr)


def test_op13_gives_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = styletree.op13_html_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = (
    '<html><head><title>T</title><style>p{{}}</style></head><body class="page-with-sidebar"><div class="site-header">Site</div><ul class="menu"><li>Home</ul><div id="cookie-notice">We use cookies</div>'
    '<main><h1>Title {0}</h1><p>First &amp; <b>bold</b>&nbsp;text\n  of {0}<p>Second<br>line<script>if (a</b/.test(x)) "</p>"</script><div class="ad-slot">Buy</div>'
    "<form><p>Your mail</form><table><tr><td>cell {0}<td>next</table></main><aside>More</aside><section id=comments><article>Reader</article></section><footer>Bye</footer>"
)


def test_marked_articles(spark):
    want = "Title {0}\nFirst & bold text of {0}\nSecond line\ncell {0}\nnext"
    assert texts(spark, [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(3)]) == [(i, want.format(i)) for i in range(3)]


def bare(i, host_line):
    """No element says what it is; what stands on every page of the host is its own."""
    body = "".join(f"<p>{w} tells of spring {i * 31 + k}.</p>" for k, w in enumerate(["moss", "well", "stone", "river"][: 2 + i % 3]))
    return f"<body><div class=a><p>{host_line}</p><p>Call us</p></div><div class=b>{body}</div><div class=c><span>Visit {host_line} daily</span></div></body>"


def test_what_a_site_repeats_goes(spark):
    rows = [(i, f"https://{'one' if i < 20 else 'two'}.example/p{i}", bare(i, "Rocks" if i < 20 else "Water")) for i in range(40)]
    for i, text in texts(spark, rows):
        assert text == "\n".join(f"{w} tells of spring {i * 31 + k}." for k, w in enumerate(["moss", "well", "stone", "river"][: 2 + i % 3]))


def test_a_host_of_one_page_borrows_the_tree_of_all(spark):
    rows = [(i, f"https://h{i}.example/", bare(i, "Rocks")) for i in range(30)]
    assert dict(texts(spark, rows))[4] == "moss tells of spring 124.\nwell tells of spring 125.\nstone tells of spring 126."


def test_copies_of_a_page_count_once(spark):
    same = [(i, "http://a.example/", "<body><div><p>Only page of the site</p></div>") for i in range(50)]
    assert set(texts(spark, same)) == {(i, "Only page of the site") for i in range(50)}


def test_branches_over_the_limit_meet_by_shuffle(spark, monkeypatch):
    rows = [(i % 7 or None, f"http://{'ab'[i % 2]}.example/{i}", PAGE.format(i)) for i in range(30)]
    want = texts(spark, rows)
    monkeypatch.setattr(styletree, "SMALL", 0)
    assert texts(spark, rows) == want


def test_pages_of_odd_rows(spark):
    rows = [(None, None, None), (None, "http://a", "<p>x</p>"), (1, None, ""), (2, "no url", "plain &lt; text <"), (2, "no url", "plain &lt; text <"), (3, "http://a/", "<div>" * 3000 + "deep"), (4, "http://a/", "</b></p><p>stray<li>ends</div></article>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r.page_id, r.url, r.text) for r in styletree.main_texts(df).collect()), key=repr)
    assert got == sorted([(None, None, ""), (None, "http://a", "x"), (1, None, ""), (2, "no url", "plain < text <"), (2, "no url", "plain < text <"), (3, "http://a/", "deep"), (4, "http://a/", "stray\nends")], key=repr)
    assert styletree.main_texts(df.limit(0)).count() == 0


def test_faulty_pages_take_linear_time():
    start = time.time()
    for page in ("<p>a" * 50_000, '<a "' * 50_000, "<a '" * 20_000 + '<x "' * 20_001, "<b>" * 30_000 + "<p>" * 30_000, "<i>" * 30_000 + "</u>" * 30_000, "<!--" * 50_000, "<script>" * 50_000):
        root = styletree.parse(page)
        styletree.branches(root), styletree.blocks_of(root)
    assert time.time() - start < 30


def test_branches_are_judged_at_all_levels():
    from fieldstrata.llm import styletree as st

    deep = "<html><body>" + "<div>" * 30 + "<p>Words.</p><div class='share'>Share</div>" + "</div>" * 30
    found = {n.label: level for n, _, _, level in st.branches(st.parse(deep))}
    assert found["div.share"] > st.LEVELS and found["p"] > st.LEVELS
    start = time.time()
    st.branches(st.parse("<div>a" * 20_000))
    assert time.time() - start < 10


def test_noise_below_many_levels_goes(spark):
    from fieldstrata.llm import styletree as st

    page = lambda n: "<html><body>" + "<div>" * 20 + f"<p>Story {n} tells of {n * n} things.</p><div class='share'>Share this page</div>" + "</div>" * 20 + "</body></html>"
    pages = spark.createDataFrame([(n, "https://a.example/" + str(n), page(n)) for n in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in st.main_texts(pages).collect()}
    assert got == {n: f"Story {n} tells of {n * n} things." for n in range(8)}


def test_what_stands_in_lines_and_custom_elements_is_judged(spark):
    page = lambda n: f"<body><app-root><span><b><div class='menu'>Home</div></b><div class=x>Call us</div></span><div class=y><p>Story {n} tells of <b>{n * n}</b> <i>things</i>.</p><p>It ends <a href=/>here</a></p></div></app-root></body>"
    got = texts(spark, [(n, f"https://a.example/{n}", page(n)) for n in range(8)])
    assert got == [(n, f"Story {n} tells of {n * n} things.\nIt ends here") for n in range(8)]


def test_deep_branches_are_judged_by_all_their_blocks(spark):
    inner = "<div class=s><p>Story {0} of {1}</p></div><div class=t>" + "".join(f"<p>Room {k} has a view" for k in range(24)) + "<p class=e>Visit {0}</p></div>"
    for depth in (2, 20, 300):
        page = "<body>" + "<div>" * depth + inner + "</div>" * depth
        assert texts(spark, [(n, f"https://a.example/{n}", page.format(n, n * n)) for n in range(8)]) == [(n, f"Story {n} of {n * n}") for n in range(8)], depth


def test_marked_articles_stay_and_all_beside_them_goes(spark):
    # near copies of one page, an article in a form laid around all, bare text and lines beside it, a menu without an end
    page = "<body><form id=aspnet><input>Skip <b>to</b> <a href=#c>content</a><div class=w><span>Log in</span><article><h1>One title</h1><p>The same <b>story</b> on all pages.</p><p>{}</p></article></div>More</form></body>"
    assert texts(spark, [(n, f"https://a.example/{n}", page.format(n % 2)) for n in range(4)] + [(9, "https://a.example/9", page.format(5))]) == [(n, f"One title\nThe same story on all pages.\n{n % 2 if n < 9 else 5}") for n in (0, 1, 2, 3, 9)]
    page = "<body><nav><ul><li>Home<li>About</ul><div class='layout-with-sidebar'><main><p>Text {}</p><section id=comments><article>Reader</article></section></main><aside>More</aside></div></body>"
    assert texts(spark, [(n, f"https://b.example/{n}", page.format(n)) for n in range(3)]) == [(n, f"Text {n}") for n in range(3)]


def test_a_deep_page_is_given_out_in_parts():
    page = "".join(f"<div id=x{'abcdefgh'[i % 8]}>" + "".join(f"<p>{i} {k}" for k in range(10)) for i in range(500))
    rows = list(styletree._nodes(iter([pa.RecordBatch.from_pydict({"page": ["p"], "host": ["h"], "text": [page]})])))
    features = [f for b in rows for f in b.column(6).to_pylist()]
    assert len(rows) > 1 and sorted(map(len, features), reverse=True)[:3] == [5000, 4990, 4980]
    # beyond what browsers nest, one hash a branch below the first levels
    deep = list(styletree._nodes(iter([pa.RecordBatch.from_pydict({"page": ["p"], "host": ["h"], "text": ["<div>a" * 3000]})])))
    assert sum(b.num_rows for b in deep) == 3000
