import hashlib
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from gradus.llm import language, pii, registry, wrappers
from tests.llm.helpers import BASE, PROSE, documents, table, texts

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        if place % 2:
            digit = 2 * digit - 9 * (digit > 4)
        total += digit
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE_PATTERNS.items()
        for m in re.finditer(pattern, text)
        if passes(kind, m.group())
    ]


PERSONAL = [
    "write to a@b.c_x@d.e or x.y+z@sub.host-name.org, not to @nobody or a@b",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.000255 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559, 12345678901234567890123",
    "call +49 (30) 123-4567 or +1.2.3 or +12345678901234567 or ++44 20 7946 0958.",
    "🎉🎉 é mail ü@x.de é@é.fr bob@host.io 10.0.0.1",
    "9" * 20_000 + " " + "1 " * 10_000,
    "a.b-" * 5_000 + "@x.y " + "+1" * 5_000 + "@" * 50,
]


@pytest.mark.parametrize("source", ["awkward", "documents", "personal"])
def test_base_spans(spark, source):
    if source == "personal":
        df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    else:
        df = table(spark) if source == "awkward" else documents(spark)
    rows = pii.digest_columns(pii.spans(df)).collect()
    assert len(rows) == df.count()
    known = texts(df)
    for r in rows:
        found = base_spans(known[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), known[r.doc_id][:80]
        counts = [sum(k == kind for k, _, _ in found) for kind in BASE_PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_candidates_like_confirmed_spans_are_added(spark):
    """Numbers without a country code, in the places where numbers with one stand."""
    rows = []
    for i in range(600):
        number = f"({100 + i % 800}) 555-{1000 + i:04d}"
        rows.append((i, f"please call me: +1 {number} or write, {i} times"))
        rows.append((10_000 + i, f"invoice no {1000000 + 37 * i} of page {i} and 12.5.{i % 9}.99999"))
    rows += [(20_000 + i, f"please call me: 1 (222) 555-{1000 + i} or write") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digest_columns(pii.spans(df)).collect()}
    added = sum("phone:" in found[20_000 + i] for i in range(20))
    wrong = sum("phone:" in found[10_000 + i] for i in range(600))
    assert added >= 18 and wrong == 0
    assert pii.redacted(df).where(F.size("spans") > 0).count() >= 618


def test_language(spark):
    docs = documents(spark).unionByName(table(spark).select(*documents(spark).columns))
    rows = registry.queries()["op4_language_id"](spark, BASE).collect()
    truth = {r.doc_id: r.lang for r in documents(spark).collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    allowed = F.coalesce(language.fold() != 2, F.lit(False))
    rows = language.identify(docs.where("lang IS NULL OR lang = 'en'"), allowed, max_rows=50).collect()
    assert {r.lang_pred for r in rows} <= {"en", "und"}
    assert all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in language.identify(table(spark), allowed, max_rows=50).collect()}
    assert by_id[4].lang_pred == by_id[5].lang_pred == by_id[6].lang_pred == "und"
    unlabelled = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled, allowed).collect()} == {"und"}
    assert language.identify(table(spark).limit(0), allowed).count() == 0


def article_text(page):
    """Blocks of the supplied pages, which mark their article."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", inside)
    plain = (unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))) for p in parts)
    return "\n".join(" ".join(p.split()) for p in plain if p.split())


def test_main_text_of_supplied_pages(spark):
    pages = spark.read.parquet(f"{BASE}/pages.parquet")
    known = {r.page_id: r.html for r in pages.collect()}
    rows = registry.queries()["op6_main_text"](spark, BASE).collect()
    assert len(rows) == len(known)
    for r in rows:
        assert r.text == article_text(known[r.page_id]) and r.n_chars == len(r.text)


def page(i):
    extra = "<div class='notice-box'>Offer!</div>" if i % 2 else ""
    rows = "".join(f"<p>Paragraph {k} of {i}: <i>{PROSE[k:]}</i>" for k in range(1 + i % 4))
    return (
        f"<html><head><title>t{i}</title></head><body><div id=topMenu><a href=x>Home</a></div>{extra}"
        f"<div class=wrap><div class='col left'>Welcome to this site<h1>Title {i} &amp; more</h1>{rows}"
        f"<ul><li>one {i}<li>two {i}</ul></div><div class=sidebar><p>Side {i}</p></div>"
        f"<form><p>mail {i}</form><div class=comments><p>comment {i}</p></div></div>"
        f"<script>if (a < b) document.write('<p>no</p>')</script><footer>f {i}</footer>"
    )


def test_wrapper_finds_the_content_without_an_article(spark):
    rows = [(i, f"http://x.org/{i}", page(i)) for i in range(12)]
    rows += [
        (100, None, None), (101, "http://y", ""), (102, "bad", "just < text &lt;b&gt;"), (103, "http://x.org/z",
        "<p>no  container</p><div class=ad>no</div><p hidden>no"), (0, "http://x.org/0", page(0)),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'h' AS host", "'t' AS told", "1 AS kept", "'x' AS text"
    )
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert wrappers.main_text(df).count() == len(rows)
    for i in range(12):
        paragraphs = [f"Paragraph {k} of {i}: {PROSE[k:].strip()}" for k in range(1 + i % 4)]
        paragraphs = [" ".join(p.split()) for p in paragraphs]
        assert got[i] == "\n".join([f"Title {i} & more", *paragraphs, f"one {i}", f"two {i}"])
    assert (got[100], got[101], got[102], got[103]) == ("", "", "just < text <b>", "no container")
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_alignment_is_union_free():
    pages = ["<ul><li>a<li>b</ul><p>x", "<ul><li>c</ul><h2>n</h2><p>y", "<p>z"]
    wrapper = None
    for text in pages:
        own = wrappers.folded(wrappers.parse(text)[0])
        wrapper = own if wrapper is None else wrappers.align(wrapper, own)
    assert wrappers.expression(wrapper) == (
        "<#page>(<ul>(<li>#PCDATA</li>)+</ul>)?(<h2>" + wrapper.children[1].children[0].const
        + "</h2>)?<p>#PCDATA</p></#page>"
    )
    packed = wrappers.Node.unpack(wrapper.pack())
    assert wrappers.expression(packed) == wrappers.expression(wrapper)


def test_copies_of_a_named_article_that_differ_in_a_date(spark):
    article = "<article><h1>One heading</h1><p>The same short paragraph on every page.</p></article>"
    forms = {
        "flat.org": "<html><body><div class=meta>Posted on day {i}</div>" + article + "</body></html>",
        "deep.org": "<html><body><div class=meta>Posted on day {i}</div><div class=wrap><div>" + article
        + "</div></div></body></html>",
    }
    rows = [
        (i, f"https://{host}/{i}", form.format(i=i)) for host, form in forms.items() for i in range(12)
    ]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 24
    text = "One heading\nThe same short paragraph on every page."
    assert {r.text for r in got if "flat" in r.url} == {text}
    # Deeper down the article holds less than DOMINANT of the text: the date stays, the article too.
    assert {r.text for r in got if "deep" in r.url} == {f"Posted on day {i}\n{text}" for i in range(12)}


def test_letters_of_texts():
    assert language.has_letter("12 é") and language.has_letter("日")
    assert not language.has_letter("²½Ⅷ 12_3 🎉") and not language.has_letter("")


def test_pages_nested_without_end(spark):
    """Elements beyond the levels of the tree keep their texts, in order; no depth fails."""
    deep = "<html><body>" + "<div>" * 100_000 + "first" + "</div>" * 50_000 + "second"
    flat = "<html><body><article><p>A text of its own.</p></article></body></html>"
    rows = [(1, "http://deep.example/a", deep), (2, "http://deep.example/b", flat), (3, "http://x.example/", deep)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert got == {1: "first\nsecond", 2: "A text of its own.", 3: "first\nsecond"}
    root, blocks = wrappers.parse(deep)
    assert [text for _, _, text in blocks] == ["first", "second"]
    assert {len(path) for path, _, _ in blocks} == {wrappers.LEVELS}
