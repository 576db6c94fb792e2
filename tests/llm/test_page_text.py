import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import page_text

SCHEMA = "page_id long, url string, html string, host string, lines int"


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_is_a_longest_common_subsequence(a, b):
    found = page_text.common(a, b)
    assert found == sorted(set(found)) and len(found) == longest(a, b)
    other = iter(b)
    assert all(a[i] in other for i in found)


def kept(page):
    return [text for state, text in page_text.lines_of(page) if state != page_text.GONE]


@pytest.mark.parametrize("page,want", [
    ("", []),
    ("plain  text\n here", ["plain text here"]),
    ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<article><h1>T &amp; U</h1><p><b>x.<br><p>y&nbsp;&eacute;</p></article><footer>f</footer>", ["T & U", "x.", "y é"]),
    ("<nav><ul><li>n</ul></nav><div class='ad big'>ad</div><div class=header-x>h</div><div class='shade'>s</div>", ["s"]),
    ("<script>var a='<p>';</script><style>p{}</style>t<!-- <p>c</p> --><noscript>n</noscript>", ["t"]),
    ("<form><p>f</p></form><aside>a</aside><div id=comments><p>c</p></div><main><p>m</p><div class=share>s</div></main>", ["m"]),
    ("<ul><li>a<li>b <i>c</i></ul><table><tr><td>d<td>e</table>", ["a", "b c", "d", "e"]),
    ("<p>1 < 2 and <3</p><P CLASS=x>UP</P>", ["1 < 2 and <3", "UP"]),
    ("<div>a<div>b</div>c</div><p>cut off <b", ["a", "b", "c", "cut off <b"]),
    ("<div hidden>h</div><div role=navigation>r</div><div aria-hidden='true'>x</div><p>k", ["k"]),
    ("<header>h<article>inside</article></header><article>out</article>", ["out"]),
])
def test_lines(page, want):
    assert kept(page) == want


def page(*lines):
    return "<body>" + "".join(f"<div>{line}</div>" for line in lines) + "</body>"


def rows():
    return [
        (1, "http://a.example/x/1", page("Site name", "Menu", "Story one.", "It goes on.", "About us"), "h", 1),
        (2, "http://a.example/x/2?utm=1", page("Site name", "Menu", "Story two.", "About us"), "h", 1),
        (3, "https://a.example/y/9.html", page("Site name", "Other menu", "Story three."), "h", 1),
        (4, "http://b.example/x/1", page("Site name", "Alone here"), "h", 1),
        (5, "http://b.example/x/1/#top", page("Site name", "Alone here"), "h", 1),
        (6, "http://a.example/x/3", "<nav>Menu</nav><article><p>Story two.</p><p>Site name</p></article>", "h", 1),
        (7, None, page("no address"), "h", 1), (8, "http://c.example/", None, "h", 1), (9, "http://c.example/q", "", "h", 1),
        (10, "http://d.example/1", page("same"), "h", 1), (11, "http://d.example/2", page("same"), "h", 1),
        (None, "http://e.example/1", page("no id"), "h", 1),
    ]


def test_differencing(spark):
    data = rows() + [rows()[0]]
    got = page_text.extract(spark.createDataFrame(data, SCHEMA).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(data) and sum(r.page_id == 1 for r in found) == 2
    text = {r.page_id: r.text for r in found}
    assert text == {1: "Story one.\nIt goes on.", 2: "Story two.", 3: "Site name\nOther menu\nStory three.", 4: "Site name\nAlone here",
                    5: "Site name\nAlone here", 6: "Story two.\nSite name", 7: "no address", 8: "", 9: "", 10: "same", 11: "same",
                    None: "no id"}
    assert all(r.n_chars == len(r.text) for r in found)


def test_partner_is_the_nearest_path_of_the_host(spark):
    rng = random.Random(1)
    paths = sorted({(f"h{rng.randrange(3)}", "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(6)))) for _ in range(120)})
    table = spark.createDataFrame([(h, p, [n]) for n, (h, p) in enumerate(paths)], "host string, path string, hashes array<long>")
    got = {(r.host, r.path): r.partner_hashes[0] for r in page_text.partners(table).collect()}

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for n, (host, path) in enumerate(paths):
        there = [m for m in (n - 1, n + 1) if 0 <= m < len(paths) and paths[m][0] == host]
        if not there:
            assert (host, path) not in got
        else:
            best = max(shared(path, paths[m][1]) for m in there)
            assert shared(path, paths[got[host, path]][1]) == best
            every = max(shared(path, p) for m, (h, p) in enumerate(paths) if h == host and m != n)
            assert best == every


def test_long_page_and_empty_table(spark):
    long = page(*[f"line {i}" for i in range(20000)])
    data = [(1, "http://a.example/1", long, "h", 1), (2, "http://a.example/2", page("line 5", "line 9", "own"), "h", 1)]
    text = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(data, SCHEMA)).collect()}
    assert text[2] == "own" and text[1].count("\n") == 20000 - 3
    assert page_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def article(*lines):
    return "<nav>Menu</nav><article>" + "".join(f"<p>{line}</p>" for line in lines) + "</article>"


def test_repeated_lines_inside_articles_go_and_copies_stay(spark):
    story = {n: [f"Sentence {n}.{k} of a story that nobody else on this host has told so far." for k in range(4)] for n in range(20)}
    licence, passage = "All texts under the common licence.", "A passage that one more article quotes from its neighbour."
    data = [(n, f"http://a.example/x/{n:02}", article(*story[n], licence), "h", 1) for n in range(10)]
    data[4] = (4, data[4][1], article(*story[4][:2], passage, licence), "h", 1)
    data[5] = (5, data[5][1], article(passage, *story[5], licence), "h", 1)
    # Mirrors, three in a row, and a host of two pages: no evidence that a line is no article.
    data += [(10 + n, f"http://m.example/y/{n}", article(*story[10], licence), "h", 1) for n in range(3)]
    data += [(13 + n, f"http://t.example/z/{n}", article(*story[13 + n], licence), "h", 1) for n in range(2)]
    text = {r.page_id: r.text.split("\n") for r in page_text.extract(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()}
    for n in (0, 1, 2, 3, 6, 7, 8, 9):
        assert text[n] == story[n]
    assert text[4] == [*story[4][:2], passage] and text[5] == [passage, *story[5]]
    assert all(text[10 + n] == [*story[10], licence] for n in range(3))
    assert all(text[13 + n] == [*story[13 + n], licence] for n in range(2))


def test_neighbours_meet_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(page_text, "BUCKET", 4)
    table = spark.createDataFrame([("h", f"/{n:03}", [n, -1]) for n in range(30)], "host string, path string, hashes array<long>")
    got = {r.path: r for r in page_text.partners(table).collect()}
    for n in range(30):
        want = sorted(m for m in range(n - 2, n + 3) if 0 <= m < 30 and m != n)
        assert sorted(o[0] for o in got[f"/{n:03}"].other_hashes) == want
        assert got[f"/{n:03}"].partner_hashes[0] in (n - 1, n + 1)


@pytest.mark.parametrize("page,want", [
    ("<div class='layout has-sidebar'><p>o</p><article><p>a</p></article></div>", ["o", "a"]),
    ("<div id=page class='no-sidebar'><main>m</main><div class=sidebar>s</div></div>", ["m"]),
    ("<div class='modal-page'><p>o</p><article><p>a</p><div class=share>s</div></article></div>", ["a"]),
    ("<form action=x><nav>n</nav><div>o</div><main><h1>t</h1></main></form>", ["t"]),
    ("<form><div>only</div><div class=ad>ad</div></form>", ["only", "ad"]),
    ("<article><h1 class='article-header'>t</h1><p>a</p><div id=comments><article>c</article></div></article>", ["t", "a"]),
    ("<article>a</article><div class=related><article>teaser</article></div>", ["a"]),
])
def test_wrappers_do_not_remove_the_article(page, want):
    assert kept(page) == want


def test_article_lines_are_decided_alike_on_a_host(spark):
    story = {n: [f"Sentence {n}.{k} of a story that nobody else on this host has told so far." for k in range(4)] for n in range(12)}
    few, most = "Three neighbours quote this line.", "Seven of twelve pages end with this line."
    lines = {n: story[n] + [few] * (4 <= n <= 6) + [most] * (n % 5 < 3) for n in range(12)}
    data = [(n, f"http://a.example/x/{n:02}", article(*lines[n]), "h", 1) for n in range(12)]
    text = {r.page_id: r.text.split("\n") for r in page_text.extract(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()}
    assert text == {n: [line for line in lines[n] if line != most] for n in range(12)}


def plain(pages):
    """The whole query on (page_id, url, html) by direct comparison of every path with its host's others."""
    import difflib
    import os

    def split(url):
        bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "")
        host = re.sub(r"^[^/?#@]*@", "", re.match(r"[^/?#]*", bare)[0]).split(":")[0].lower()
        path = re.sub(r"[?#].*$", "", re.sub(r"^[^/?#]*", "", bare), flags=re.S)
        return host, re.sub(r"(?:/index)?(?:\.(?:html?|php|aspx?|jsp))?/*$", "", path)

    rows = [(i, split(u), [(k == page_text.KEPT, t) for k, t in page_text.lines_of(h or "") if k != page_text.GONE]) for i, u, h in pages]
    hosts = {}
    for i, (host, path), lines in sorted(rows, key=lambda r: r[0]):
        hosts.setdefault(host, {}).setdefault(path, lines)
    size = lambda ls: sum(map(len, ls))

    def both(a, b):
        return [a[m.a + k] for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]

    def alike(a, b):
        return 2 * size(both(a, b)) >= min(size(a), size(b))

    out = {}
    for host, by_path in hosts.items():
        order = sorted(by_path)
        kept = {p: [t for k, t in by_path[p] if k] for p in order}
        proposed = set()
        for n, p in enumerate(order):
            near = [kept[order[m]] for m in range(n - 2, n + 3) if 0 <= m < len(order) and m != n]
            near = [o for o in near if set(o) & set(kept[p]) and not alike(kept[p], o)]
            for x in range(len(near)):
                for y in range(x):
                    if not alike(near[x], near[y]):
                        proposed |= set(kept[p]) & set(near[x]) & set(near[y])
        site = {t for t in proposed if len(order) >= 3 and 2 * sum(t in kept[p] for p in order) >= len(order)}
        for i, (h, path), lines in rows:
            if h != host:
                continue
            n = order.index(path)
            there = [order[m] for m in (n - 1, n + 1) if 0 <= m < len(order)]
            partner = max(there, key=lambda q: len(os.path.commonprefix([path, q])), default=None)
            other = [t for k, t in by_path[partner] if not k] if partner is not None else []
            drop = both([t for k, t in lines if not k], other)
            text = []
            for k, t in lines:
                if k:
                    text += [] if t in site else [t]
                elif t in drop:
                    drop.remove(t)
                else:
                    text.append(t)
            out[i] = "\n".join(text or [t for _, t in lines])
    return out


def test_whole_query_against_direct_comparison(spark):
    rng = random.Random(11)
    data = []
    for i in range(90):
        host = f"h{i % 4}.example"
        site = [f"Every page of {host} says this.", "Share it."]
        own = [f"Words {i} {k} " + "x" * rng.randrange(30, 90) for k in range(rng.randrange(1, 6))]
        extra = [t for t in site if rng.random() < 0.8] + (["Said here and there."] if rng.random() < 0.2 else [])
        # lines of one page differ, so a common subsequence is told by its lines alone
        outside = [f"Site {host}", f"Page {i}"] if i % 3 else [f"Page {i}"]
        html = "".join(f"<div>{t}</div>" for t in outside) + article(*own, *extra)
        data.append((i, f"http://{host}/{rng.choice('abc')}/{i:03}", html))
    rows = [(*r, "h", 1) for r in data]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == plain(data)


def test_many_shuffle_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        test_differencing(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
