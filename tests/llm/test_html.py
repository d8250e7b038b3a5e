"""Wrapper induction: alignment against a plain recursion, main slots without any help from markup, and pages of any shape."""

import random
import re

import pyarrow.parquet as pq
import pytest

from veldspar.llm import html

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def plain_score(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.elements) + 1) for _ in range(len(a.elements) + 1)]
    for i, x in enumerate(a.elements):
        for j, y in enumerate(b.elements):
            best[i + 1][j + 1] = max(best[i][j] + plain_score(x, y), best[i][j + 1], best[i + 1][j])
    return 1 + best[-1][-1]


@pytest.mark.parametrize("cells", [html.CELLS, 3])
def test_alignment(monkeypatch, cells):
    monkeypatch.setattr(html, "CELLS", cells)
    rng = random.Random(8)

    def tree(depth):
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ''}</{tag}>"

    for _ in range(150):
        a, b = html.parse(tree(3)), html.parse(tree(3))
        pairs = html.align(a, b)
        assert html.score(a, b) == plain_score(a, b) == len(pairs)
        assert len({x.number for x, _ in pairs}) == len({y.number for _, y in pairs}) == len(pairs)
        places = sorted((x.number, y.number) for x, y in pairs)
        assert all(x.label == y.label for x, y in pairs) and [y for _, y in places] == sorted(y for _, y in places)  # preorder is kept


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def page(rng, title, paragraphs, name="x1"):
    menu = "".join(f'<li><a href="/{i}">{words(rng, 1)}</a></li>' for i in range(6))
    return f"<html><head><title>t</title></head><body><div><ul>{menu}</ul></div><div>{words(rng, 5)}</div><div class={name}><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>&copy; {words(rng, 4)}</div>"


def test_main_slot_without_markup(spark):
    """Menus, adverts and footers whose words vary from page to page, in elements that say nothing: only the wrapper tells them apart."""
    rng = random.Random(1)
    want, rows = {}, []
    for i in range(40):
        title, paragraphs = words(rng, 4), [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
        want[i] = " ".join([title, *paragraphs])
        rows.append((i, f"https://host/{i}", page(rng, title, paragraphs)))
    assert texts(spark, rows) == want


def test_driver_pages_without_markup(spark):
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    plain = {r["page_id"]: " ".join(html.entities.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<b>", "").replace("</b>", ""))).split()) for r in rows}
    given = texts(spark, [(r["page_id"], r["url"], r["html"]) for r in rows])
    assert given == plain
    renamed = [(r["page_id"], r["url"], re.sub(r"</?(nav|article|footer)>", lambda m: m[0].replace(m[1], "div"), r["html"]).replace('<div class="ad">', "<div>")) for r in rows]
    got = texts(spark, renamed)
    assert sum(got[i] == plain[i] for i in plain) >= 0.9 * len(plain)


def test_copies_are_no_template(spark):
    rng = random.Random(3)
    long = [words(rng, 30) for _ in range(20)]
    rows = [(i, "https://h/", page(rng, "first", [*long[:19], f"end {i}"])) for i in range(5)]
    rows += [(i, "https://h/", page(rng, f"t{i}", [words(rng, 30) for _ in range(5)])) for i in range(5, 60)]
    rows += [(100 + i, "https://copies/", page(rng, "same", long)) for i in range(30)]
    got = texts(spark, rows)
    assert all(got[i] == " ".join(["first", *long[:19], f"end {i}"]) for i in range(5))
    assert all(" ".join(["same", *long]) in got[100 + i] for i in range(30))


def test_small_hosts_and_layouts(spark):
    """Hosts with two pages each share a layout; a host has two layouts, each with a constant line of its own."""
    rng = random.Random(4)
    rows = [(i, f"https://small{i // 2}/", page(rng, f"t{i}", [words(rng, 30) for _ in range(rng.randint(2, 4))])) for i in range(40)]
    one, two = "<body><div class=a><p>always one</p><p>{}</p></div>", "<body><section class=b><p>always two</p><p>{}</p></section>"
    rows += [(100 + i, "https://two/", (one if i % 3 else two).format(words(rng, 20))) for i in range(60)]
    got = texts(spark, rows)
    for i, _, h in rows[:40]:
        assert got[i] == " ".join(re.findall(r"<(?:h1|p)>(.*?)</", h))
    assert not any("always" in got[100 + i] for i in range(60))


def test_any_shape(spark):
    deep = "<div>" * 3000 + "<nav>menu</nav><p>deep</p>" + "</div>" * 3000
    cases = {
        deep + "<p>after": "deep after",
        "<div class='post no-sidebar'><h1>T</h1><p>a b</p></div>": "T a b",
        "<div class='share'><p>most of the paragraphs</p></div><div class='ad-1'>x</div>": "most of the paragraphs",
        "<article><p>a</p><div id=comments><p>much longer than all of the article itself</p></div></article>": "a",
        "<form id=aspnet><article>in a form</article><input></form>": "in a form",
        "</div></p>x<b>y": "xy",
        "a <b title='x>y'>c</b> <i title=\"no end>d": "a c d",
        "<a " * 20000: "",
        '<a ">' * 5001 + "z": "z",
        "<p hidden>no</p><p style='display: none'>no</p>yes": "yes",
        "plain < text > 1 <2 &lt;b&gt; &amp; &#233;": "plain < text > 1 <2 <b> & é",
        "<!-- never ends <p>x": "",
        "<script>if (a < b) '</p>'": "",
    }
    rows = [(i, f"https://h{i}/", h) for i, h in enumerate(cases)]
    assert texts(spark, rows) == dict(enumerate(cases.values()))
    many = html.parse("<body>" + "".join(f"<p>{'<b>x</b>' * (i % 97)}{'<i>y</i>' * (i % 89)}</p>" for i in range(2000)))
    other = html.parse("<body>" + "".join(f"<p>{'<b>x</b>' * (i % 83)}{'<i>y</i>' * (i % 79)}</p>" for i in range(1000)))
    assert len(html.align(html.parse("<div>" * 5000 + "x"), html.parse("<div>" * 4000 + "y"))) == 4001
    assert many.size > 2000 and other.size > 1000
