from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.llm import html_template as h

SHELL = (
    "<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style></head><body class='with-sidebar'><header>Name</header><nav><ul><li>One<li>Two</ul></nav>"
    "<div class='cookie-notice'>We bake</div><div id='wrap'><div class='{c}'>{body}</div><div class='sidebar'>Side {t}</div></div>"
    "<div id='comments'><p>Nice {t}</p></div><form><p>Mail</p></form><footer>&copy; {t}</footer>{end}"
)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one <b>two</b>\n three<p>four<br>five<div class=ad>buy</div>six", "one two three\n\nfour five\n\nsix"),
        ("<article><h1>A&nbsp;b</h1><p><b>x.<br><p>y</article><p>z", "A b\n\nx.\n\ny"),
        ("<article><p>&lt;p&gt; &#233; &quot;</p><script>var t='</p>';</script><!-- no --> tail", "<p> é \"\n\ntail"),
        ("<body><article class='comment'>no</article><article>yes</article>", "yes"),
        ("<main><ul><li>a<li>b</ul><aside>c</aside><table><tr><td>d<td>e</table></main>", "a\n\nb\n\nd\n\ne"),
        ("<div>a <span class='ad'>x</span> b < c</div>", "a\n\nb < c"),
        ("<div role='navigation'>m</div><div class='post-content'>t</div><noscript>n</noscript>", "t"),
    ],
)
def test_single_pages(html, text):
    assert h.main_text(html, [], None) == text


def test_long_and_deep_pages():
    assert h.main_text("<div>" * 20_000 + "x", [], None) == "x"
    assert h.main_text("<p>" + "word " * 100_000, [], None) == " ".join(["word"] * 100_000)


def pages():
    rows = [(i, f"http://Big.example.org:80/{i}", SHELL.format(t=f"t{i}", c="article-text", body="".join(f"<p>Say {i} {k}<b>!" for k in range(1 + i % 4)), end="</body></html>" if i % 5 else "")) for i in range(40)]
    rows += [(100 + i, "https://u@other.net/x", f"<body><div>{'<p>head' if i else ''}</div><div class='story'><p>Text {i}</div>") for i in range(3)]
    return rows + [(200, None, "<p>alone</p>"), (201, "nonsense", None), (202, "http://big.example.org/odd", "<main>other layout</main>"), (None, "http://big.example.org/e", ""), (0, "http://big.example.org/0", rows[0][2])]


def test_templates_of_hosts(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, -1, "k") for r in rows], "page_id long, url string, html string, host int, token string").repartition(3)
    got = sorted(((r["page_id"], r["host"], r["main_text"]) for r in h.extract(df, ["page_id", "host"]).collect()), key=str)
    want = []
    for i, _, html in rows:
        if i is not None and i < 100:
            text = "\n\n".join(f"Say {i} {k}!" for k in range(1 + i % 4))
        elif i is not None and i < 200:
            text = f"Text {i - 100}"
        else:
            text = {200: "alone", 201: "", 202: "other layout", None: ""}[i]
        want.append((i, -1, text))
    assert got == sorted(want, key=str)
    assert h.extract(df.limit(0), ["page_id"]).count() == 0


def test_classes_share_occurrence_vectors(spark):
    """Classes by hashed sums are those of the vectors themselves; a class out of order in a page is not valid there."""
    rows = pages()[:40]
    df = spark.createDataFrame([(u, s) for _, u, s in rows], "host string, html string").withColumn("host", F.lit("x")).repartition(4)
    template = h.templates(h.token_vectors(df)).first()
    scanned = [h.scan(s).tokens for _, _, s in rows]
    tokens = {t for page in scanned for t in page}
    vectors = {t: tuple(page.count(t) for page in scanned) for t in tokens}
    often = {t for t in tokens if 2 * sum(n > 0 for n in vectors[t]) >= len(rows)}
    want = {frozenset(o for o in often if vectors[o] == vectors[t]) for t in often}
    classes = {}
    for t in template["template"]:
        classes.setdefault(t["class"], set()).add(t["token"])
    assert {frozenset(c) for c in classes.values()} == {c for c in want if len(c) >= 2}
    known = [t.asDict() for t in template["template"]]
    assert template["article"] in h._valid(scanned[1], known)
    root = max(classes.values(), key=len)
    swapped = [*reversed(scanned[1])]
    assert not h._valid(swapped, known) & root
