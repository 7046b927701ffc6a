import re

from sondeline.llm import html_extraction as m

PAGE = """<html><head><title>t</title></head><body class="no-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">Cookies</div>
<form action="/"><input>Search</form><main><article class="post"><header><h1>Title &amp; more</h1></header><p>One<br>two <b>th</b>ree &eacute;&nbsp;x</p>
<!-- no --><ul><li>a</li><li>b</li></ul><aside>side</aside><div class="comments"><article>c1</article></div></article>
<article class="comment">hey</article></main><footer>f</footer><script>var a="</p>"</script></body></html>"""


def test_structure():
    assert [x for x, _ in m.lines_of(PAGE)] == ["Title & more", "One two three é x", "a", "b"]
    assert m.lines_of(None) == [] and m.lines_of("") == []
    assert [x for x, _ in m.lines_of("<p>a < b <div>x")] == ["a < b", "x"]
    assert [x for x, _ in m.lines_of('<form id=f><main><p>inside</main></form>')] == ["inside"]


def test_longest_common_subsequence():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(m.shared(a, b)) == table[-1][-1]


def test_differencing_by_nearest_path(spark):
    page = lambda body: f"<div><p>Welcome to us</p>{body}<p>Read on</p></div>"
    rows = [(k, f"http://h.example/news/{k}.html?x={k}", page(f"<p>Story number {k} with its own long words {k * 7}</p>")) for k in range(6)]
    rows += [(50, "http://alone.example/a", page("<p>Only</p>")), (51, None, page("<p>n</p>")), (52, "http://h.example/none", None)]
    rows += [(60, "http://c.example/a", page("<p>Same</p>")), (61, "http://c.example/a#x", page("<p>Same</p>"))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in m.extract(d).collect()}
    assert all(got[k] == f"Story number {k} with its own long words {k * 7}" for k in range(6))
    assert got[50] == "Welcome to us Only Read on" and got[51] == "Welcome to us n Read on" and got[52] == ""
    assert got[60] == got[61] == "Welcome to us Same Read on"  # a copy loses nothing
    assert m.extract(d.limit(0)).count() == 0


def test_partners_are_nearest_and_do_not_depend_on_partitions(spark):
    rows = [(f"h{k % 3}.example", f"/p/{k * k % 50}", k, -k) for k in range(80)]
    d = spark.createDataFrame(rows, "host string, path string, c1 long, c2 long")
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, block in (("1", 10_000), ("7", 10_000), ("3", 20)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, m.partners(d, block=block).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 80

    def away(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    path = {k: (h, p) for h, p, k, _ in rows}
    best = sum(away(path[c][1], path[o][1]) == min(away(path[c][1], p) for k, (h, p) in path.items() if k != c and h == path[c][0]) for _, c, _, o, _ in seen[0])
    assert best >= 72  # nine in ten have the nearest of all


def test_implied_end_tags():
    of = lambda x: [t for t, _ in m.lines_of(x)]
    assert of('<article><p class="ad">Buy<p>Real text one<p>two</article>') == ["Real text one", "two"]
    assert of('<ul><li class="share">a<li>b</ul><p>body') == ["b", "body"]
    assert of('<ul><li>x<li class="share">a<b>c</ul><p>body') == ["x", "body"]
    assert of('<table><tr><td class="ad">a<td>b<tr><td>c</table><p class="ad"><b>Buy<p>Text') == ["b", "c", "Text"]
    assert of('<div class="wide story-related"><p>kept</p></div><div class="has-sidebar"><p>too</p></div>') == ["kept", "too"]
    assert of('<div class="related-posts"><p>x</div><div id="ad_3">y</div><div class="article-comments">z</div>t') == ["t"]


def brute(pages):
    """The rules over lists, without Spark, partners by all pairs of neighbours in order."""
    from collections import Counter, defaultdict

    lines = {k: m.lines_of(h) for k, _, h in pages}
    where = {k: (re.match(r"\w+://([^/?#]*)([^?#]*)", u or "") or [None, "", ""]) for k, u, _ in pages}
    hosts = defaultdict(dict)
    for k, _, _ in pages:
        host, path = where[k][1], re.sub(r"(/|\.html?)$", "", where[k][2])
        if host and lines[k]:
            key = tuple(lines[k])
            hosts[host][key] = min(path, hosts[host].get(key, path))
    gone = {}
    for host, distinct in hosts.items():
        pairs, votes, common = 0, Counter(), {}
        for key in distinct:
            others = [o for o in distinct if o != key]
            if not others:
                continue
            a, table_of = [x for x, _ in key], {}
            for o in others:  # in these tests all pages of a host are equally near, or one template fits all
                table_of[o] = m.shared(list(map(hash, a)), [hash(x) for x, _ in o])
            places = table_of[others[0]]
            common[key] = places
            size = lambda page: sum(len(x) for x, _ in page)
            both, shorter = sum(len(key[i][0]) for i in places), min(size(key), size(others[0]))
            if 2 * both < shorter if key[0][1] else both <= 0.9 * shorter:
                pairs += 1
                votes.update({key[i] for i in places})
        gone |= {(host, key): {i for i in places if 2 * votes[key[i]] >= pairs and votes[key[i]] >= (m.LEAST_VOTES if key[i][1] else 1)} for key, places in common.items()}
    return {k: " ".join(x for i, (x, _) in enumerate(lines[k]) if i not in gone.get((where[k][1], tuple(lines[k])), ())) for k, _, _ in pages}


def test_template_inside_main_goes_and_shared_passages_stay(spark):
    page = lambda body: f"<main><p>Our newspaper</p>{body}<p>Send us a letter</p></main>"
    own = lambda k: "".join(f"<p>Paragraph {j} of story {k}</p>" for j in range(4))
    rows = [(k, f"http://t.example/n/{k}", page(own(k))) for k in range(7)]
    rows += [(10, "http://t.example/n/3?again", page(own(3)))]  # a copy
    rows += [(20 + k, f"http://s.example/n/{k}", f"<article><p>A quoted passage</p>{own(20 + k)}</article>") for k in range(3)]  # three pages prove no template
    rows += [(30 + k, f"http://near.example/n/{k}", f"<article>{own(5)}<p>Edition {k}</p></article>") for k in range(9)]  # near copies don't vote
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r for r in m.extract(d).collect()}
    want = brute(rows)
    assert {k: r.text for k, r in found.items()} == want
    assert [found[k].n_template for k in (0, 10, 20, 30)] == [2, 2, 0, 0]
    assert "Our newspaper" not in found[0].text and found[20].text.startswith("A quoted passage") and "Paragraph 3 of story 5" in found[31].text


def test_alignment_of_long_pages_is_quick_and_right():
    import random
    import time

    began = time.perf_counter()
    assert len(m.shared([1] * 20_000, [1] * 15_000 + [2])) == 15_000
    rng = random.Random(3)
    a, b = ([rng.randrange(9) for _ in range(n)] for n in (9_000, 7_000))
    places = sorted(m.shared(a, b))
    assert time.perf_counter() - began < 20
    at = -1
    for i in places:  # a subsequence of both
        at = b.index(a[i], at + 1)
    assert len(places) == int(m._lengths(a, b)[-1])


def test_a_template_may_be_most_of_a_page(spark):
    menu = [f"<div class='x{j}'>Entry number {j} of the menu</div>" for j in range(8)]
    own = lambda k: [f"<div>Page {k} says in line {j} what only it says</div>" for j in range(4)]
    rows = [(k, f"http://m.example/{k}", "".join(menu[:5] + own(k) + menu[5:])) for k in range(40)]
    heavy = [f"<p>Link {j}</p>" for j in range(60)]
    rows += [(100 + k, f"http://heavy.example/{k}", "".join(heavy + [f"<p>The only line of page {k} itself, long enough to be told from a copy of another page, one of {k * k} such lines</p>"])) for k in range(12)]
    copies = "".join(f"<p>Paragraph {j} that all the copies of this article have, word for word</p>" for j in range(9))
    rows += [(200 + k, f"http://copies.example/{k}", f"{copies}<p>Copy {k}</p>") for k in range(9)]
    found = {r.page_id: r for r in m.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(found[k].n_template == 8 and found[k].text == " ".join(f"Page {k} says in line {j} what only it says" for j in range(4)) for k in range(40))
    assert all(found[100 + k].n_template == 60 and found[100 + k].text.startswith("The only line") for k in range(12))
    assert all(found[200 + k].n_template == 0 for k in range(9))  # near copies tell nothing of each other


def test_a_teaser_is_not_the_page():
    body = "".join(f"<p>Paragraph {j} of the body of the page, which stands in no article</p>" for j in range(4))
    lines = m.lines_of(f"<div>{body}</div><article class='card'><p>Read this too</p></article>")
    assert [x for x, _ in lines][-1] == "Read this too" and len(lines) == 5 and not any(main for _, main in lines)
    lines = m.lines_of(f"<p>Up</p><main>{body}</main><p>Down</p>")
    assert len(lines) == 4 and all(main for _, main in lines)
