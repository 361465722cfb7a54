import random

from gridsense.llm import html


def page(body, host="h.example", path="/a/1"):
    return f"https://{host}{path}", f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def text(body):
    return "\n".join(t for t, state in html.lines(page(body)[1]) if state != html.MARKED)


def test_structure():
    body = """<nav><a>Home</a></nav><header>Site</header><aside>side</aside><div class="ad">buy</div><div id="cookie-notice">ok?</div>
    <article class="post"><h1>Title &amp; more</h1><p>One <b>two<br>three</b> &eacute;&#x41; <i>four</i></p><p>Five<p>six<script>var t="</p>";</script>
    <div class="comments"><p>reader</p></div><form><p>mail</p></form><ul><li>a<li>b</ul><!-- no <p>comment</p> --></article>
    <section class="comment-list"><p>me too</p></section><footer>&copy; foot</footer>"""
    assert text(body) == "Title & more\nOne two three éA four\nFive\nsix\na\nb"


def test_odd_markup():
    assert text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert text('<p title="x > y">kept</p><p hidden>gone</p><p style="display: none">gone</p>') == "kept"
    assert text("<article><p>open <b>never closed<p>next</article>") == "open never closed\nnext"
    assert html.lines("") == [] and html.lines("<script>only</script>") == []
    assert text("<p>  wide \t\n space 　</p>") == "wide space"


def test_vague_names_are_left_to_differencing():
    body = """<article><div class="entry-header"><h1>Headline</h1><span>By X</span></div><div class="social-policy"><p>Policy</p></div>
    <div class="social"><p>follow us</p></div><div class="ad-slot"><p>buy</p></div><button>go</button><p>text <label>mail</label> more</p></article><nav>Home</nav>"""
    names = {html.KEEP: "keep", html.OPEN: "open", html.MARKED: "marked"}
    assert [(t, names[s]) for t, s in html.lines(page(body)[1])] == [
        ("Headline", "keep"), ("By X", "open"), ("Policy", "open"), ("follow us", "marked"), ("buy", "marked"),
        ("go", "marked"), ("text", "keep"), ("mail", "marked"), ("more", "keep"), ("Home", "marked"),
    ]


def lcs(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    return size[0][0]


def test_alignment_is_a_longest_one():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        used = [x for x, u in zip(a, html.shared(a, b), strict=True) if u]
        rest = iter(b)
        assert all(x in rest for x in used) and len(used) == lcs(a, b)


def test_alignment_of_two_very_long_pages():
    rng = random.Random(4)
    a = list(range(20_000))
    b = sorted(a, key=lambda x: x + rng.randrange(40))
    used = html.shared(a, b)
    assert len(used) == 20_000 and 5_000 < sum(used) < 20_000


def test_brute_force(spark):
    """The whole operator against a plain one: pages with distinct lines on several hosts, null and equal URLs."""
    rng = random.Random(7)
    menu = [f"menu {k}" for k in range(12)]
    pages = []
    for k in range(300):
        host, path = rng.choice(["a.example", "b.example", "c.example"]), f"/{rng.choice('xy')}/{rng.randrange(40)}"
        parts = rng.sample(menu, rng.randrange(6)) + [f"story {rng.randrange(25)}"] * rng.randrange(2)
        rng.shuffle(parts)
        tags = [rng.choice(["<div>{}</div>", "<nav>{}</nav>", "<div class='ad'>{}</div>"]).format(x) for x in parts]
        if rng.random() < 0.5:
            tags.insert(rng.randrange(len(tags) + 1), f"<article><p>main {rng.randrange(9)}</p><div class='x-notice'>{rng.choice(menu)}!</div></article>")
        url, body = page("".join(tags), host, path)
        pages.append((rng.choice([url, url, url, None]) if k % 10 == 0 else url, body))
    order = sorted(range(len(pages)), key=lambda k: (*html.place(pages[k][0]), k))
    parsed = [html.lines(body) for _, body in pages]
    texts = [[t for t, _ in p] for p in parsed]
    want = {}
    for at, k in enumerate(order):
        host, path = html.place(pages[k][0])
        near = []
        for step in (-1, 1):
            j = at + step
            while 0 <= j < len(order) and html.place(pages[order[j]][0])[0] == host and texts[order[j]] == texts[k]:
                j += step
            if 0 <= j < len(order) and html.place(pages[order[j]][0])[0] == host:
                near.append(order[j])
        same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        used = [False] * len(texts[k])
        if near:
            best = max(near, key=lambda j: same(html.place(pages[j][0])[1], path))
            used = html.shared(texts[k], texts[best])
        kept = [t for (t, s), u in zip(parsed[k], used, strict=True) if s == html.KEEP or (s == html.OPEN and not u)]
        want[k] = ("\n".join(kept), len(texts[k]), sum(u and s != html.KEEP for (_, s), u in zip(parsed[k], used, strict=True)))
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    for ranges in (1, 9):
        got = {r.page_id: (r.text, r.n_lines, r.n_shared) for r in html.differences(df, ranges=ranges).collect()}
        assert got == want
    assert sum(n for _, _, n in want.values()) > 100


def run(spark, pages, **more):
    df = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in html.extract(df, **more).collect()}


def site(n, host="h.example"):
    return [page(f"<div>Welcome to us</div><div>Story {k} tells of {k * 17}</div><div>All rights reserved</div>", host, f"/a/{k:03}") for k in range(n)]


def test_lines_shared_with_the_nearest_page_go(spark):
    got = run(spark, site(9) + [page("<div>Welcome to us</div><div>alone</div>", "other.example")])
    assert got == {**{k: f"Story {k} tells of {k * 17}" for k in range(9)}, 9: "Welcome to us\nalone"}


def test_settled_lines_stay_though_shared(spark):
    both = "<article><p>Shared sentence.</p><p>{}</p></article>"
    assert run(spark, [page(both.format("x"), path="/1"), page(both.format("y"), path="/2")]) == {0: "Shared sentence.\nx", 1: "Shared sentence.\ny"}


def test_copies_are_differenced_against_the_nearest_other_page(spark):
    body = "<div>Welcome to us</div><div>{}</div><div>All rights reserved</div>"
    between = [page(body.format("first"), path="/a/0")] + [page(body.format("same"), path=f"/a/{k}") for k in range(1, 6)] + [page(body.format("last"), path="/a/6")]
    want = {0: "first", **{k: "same" for k in range(1, 6)}, 6: "last"}
    assert run(spark, between, ranges=1) == want
    # ranges that hold nothing but copies
    assert run(spark, between, ranges=7) == want


def test_ranges_change_nothing(spark):
    pages = site(40) + site(7, "z.example")
    assert run(spark, pages, ranges=1) == run(spark, pages, ranges=13)


def test_corner_cases(spark):
    u = page("<p>x</p>")[0]
    got = run(spark, [(u, None), (u, ""), (None, "<div>no url</div>"), ("http://[bad", "<p>bad</p>"), page("<div>same</div>"), page("<div>same</div>"), page("<article><p>" + "long " * 100_000 + "</p></article>", path="/z")])
    assert got[0] == got[1] == "" and got[2] == "no url" and got[3] == "bad" and got[4] == got[5] == "same" and len(got[6]) == 499_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_alignment():
    assert html.shared([1, 2, 3, 4, 9], [1, 7, 3, 4, 2, 9]) == [True, False, True, True, True]
    assert html.shared([], [1]) == [] and html.shared([5, 5], [5]) == [True, False]
