import pytest

from ledgerline.llm.html_text import Page, labelled_pages, main_text, model

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy now</div><article><h1>Head &amp; line</h1><p><b>First\n para <i>with</i> markup.<br><p>Second&nbsp;one, caf&eacute; &lt;x&gt; R&D.</p><div class='comments'><p>I disagree with this.</p></div></article><aside>More</aside><footer>&copy; Site</footer></body></html>"


def test_article_without_the_rest():
    assert model().extract(PAGE) == "Head & line\nFirst para with markup.\nSecond one, café <x> R&D."


@pytest.mark.parametrize("source", [None, "", "   ", "<", "<p", "</p>", "<<<>>>", "<!-- never closed <p>x</p>", "<script>no end", "<a b='c><p>x", "a < b", "<div>" * 50_000 + "x", "<p>" * 20_000, "<a b=\"" * 20_000])
def test_broken_pages(source):
    assert isinstance(model().extract(source), str)


@pytest.mark.parametrize("value", ['""', '"12.5"', "abc", "'-3'"])
def test_label_attribute_of_other_pages_is_ignored(value):
    assert model().extract(PAGE.replace("<article>", f"<article data-y={value}>").replace("<h1>", f"<h1 data-y={value}>")) == model().extract(PAGE)


def test_marginals_equal_enumeration():
    """Sum-product against the sum over all states of a small tree."""
    from itertools import product

    m = model()
    page = Page("<body><article><p>some words of text here</p><div class=ad>x</div></article><nav><a href=x>y</a></nav></body>")
    features, n = page.features(), len(page.parents)
    total, content = 0.0, [0.0] * n
    for states in product((0, 1), repeat=n):
        if states[0]:
            continue
        w = 1.0
        for i in range(n):
            if i:
                for f in features[i]:
                    if f in m.node:
                        w *= m.node[f][states[i]]
                w *= m.pair.get(features[i][0], m.unseen)[states[page.parents[i]]][states[i]]
        total += w
        for i in range(n):
            content[i] += w * states[i]
    assert m.marginals(page)[1:] == pytest.approx([c / total for c in content[1:]], rel=1e-9)


def test_held_out_accuracy():
    hit = extra = missed = 0
    for source in labelled_pages(150, seed=1234):
        page = Page(source)
        keep = model().marginals(page)
        for e, text, _ in page.runs:
            if e >= 0 and (n := len(text.strip())):
                label, kept = page.labels[e], keep[e] >= 0.5
                hit, extra, missed = hit + n * (label and kept), extra + n * (kept and not label), missed + n * (label and not kept)
    assert hit / (hit + extra) > 0.99 and hit / (hit + missed) > 0.95


def other_pages(n, seed):
    """(page, its article's blocks): pages of other makers than those trained on, with other markup around and inside the article."""
    import random

    r = random.Random(seed)
    w = lambda a, b: " ".join("".join(r.choice("bcefghikmpqvw") for _ in range(r.randint(3, 9))) for _ in range(r.randint(a, b)))
    a = lambda: f"<a href='/{w(1, 1)}' class='link-item'>{w(1, 2)}</a>"
    menu = lambda: "<ul class='menu-list'>" + "".join(f"<li class=menu-item><span>{a()}</span></li>" for _ in range(r.randint(3, 9))) + "</ul>"
    for k in range(n):
        blocks, out = [], []

        def put(markup, *texts):
            out.append(markup)
            blocks.extend(texts)

        t = w(3, 9)
        put(f"<h1 class='entry-title' itemprop='headline'>{t}</h1>", t)
        for _ in range(r.randint(2, 9)):
            kind, x, y = r.randrange(9), w(12, 60), w(5, 25)
            if kind < 4:
                put(f"<p style='margin:0' data-y='{w(1, 1)}'>{x}</p>", x)
            elif kind == 4:
                put(f"<ol><li>{x}<li>{y}</ol>", x, y)
            elif kind == 5:
                put(f"<figure class='wide-{w(1, 1)}'><img src=x alt=y><figcaption>{y}</figcaption></figure>", y)
            elif kind == 6:
                put(f"<blockquote class='pull-{w(1, 1)}'><p>{x}</p><p>{y}</p></blockquote>", x, y)
            elif kind == 7:
                put(f"<section class='social-{w(1, 1)}'><h2>{y}</h2><p>{x}</p></section>", y, x)
            else:
                put(f"<table><tbody><tr><td>{x}</td><td>{y}</td></tr></tbody></table>", x, y)
        body = "".join(out)
        if k % 3 == 0:
            body += f"<div class='share-buttons'>{menu()}</div>"
        if k % 4 == 0:
            body += f"<section class='comments-list' id=comments><h3>{w(1, 3)}</h3><ol><li><p>{w(5, 30)}</p></ol></section>"
        wrap = r.choice(("<article itemscope>{}</article>", "<main role=main>{}</main>", "<div class='post-body entry'>{}</div>"))
        side = f"<aside class='widget-area'><h3>{w(1, 3)}</h3>{menu()}</aside>" if k % 2 else ""
        yield f"<!doctype html><html><head><title>{w(1, 4)}</title></head><body class=page-{k}><header class='site-header' role=banner><a href=/>{w(1, 2)}</a><nav>{menu()}</nav></header><div class='cookie-banner' role=alert><p>{w(6, 20)}</p><button>OK</button></div><div class=layout>{wrap.format(body)}{side}</div><form class=newsletter-signup><label>{w(1, 3)}</label><input></form><footer class=site-footer><div>{menu()}</div><p>&copy; {w(2, 6)}</p></footer></body></html>", blocks


def test_pages_of_other_makers():
    hit = extra = missed = 0
    for source, blocks in other_pages(120, 5):
        got, want = model().extract(source).split("\n"), set(blocks)
        hit += sum(len(b) for b in got if b in want)
        extra += sum(len(b) for b in got if b not in want)
        missed += sum(len(b) for b in blocks if b not in set(got))
    assert hit / (hit + extra) > 0.97 and hit / (hit + missed) > 0.97, (hit, extra, missed)


def test_whole_table_against_a_plain_parser():
    """The text of every page of the small table, by the standard library's parser and a rule for its markup."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    inline = ("a", "b", "i", "em", "span", "strong")

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.run, self.open = [], [], []

        def edge(self):
            if text := " ".join("".join(self.run).split()):
                self.blocks.append(text)
            self.run = []

        def handle_starttag(self, tag, attributes):
            if tag == "br":
                self.run.append(" ")
            elif tag != "meta":
                if tag == "p" and "p" in self.open:
                    self.handle_endtag("p")
                if tag not in inline:
                    self.edge()
                self.open.append(tag)

        def handle_endtag(self, tag):
            while tag in self.open and self.open.pop() != tag:
                pass
            if tag not in inline:
                self.edge()

        def handle_data(self, data):
            if "article" in self.open:
                self.run.append(data)

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    for source in pages:
        p = Plain()
        p.feed(source or "")
        p.close()
        p.edge()
        assert model().extract(source) == "\n".join(p.blocks)


def test_nothing_else_is_dropped_in_an_article():
    text = model().extract("<article><h1>A title of it</h1><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p><xmp><b> &amp; </xmp><noscript><p>Shown without scripts.</p></noscript><object><p>Shown without the object.</p></object><svg><text>label</text></svg><template>no</template></article>")
    assert text == "A title of it\nThe formula x=2 holds.\n<b> &amp;\nShown without scripts.\nShown without the object.\nlabel"
    for tag, name in (("section", "promoted-study"), ("figure", "related-figure"), ("div", "social-history")):
        assert "stands here in full length" in model().extract(f"<article><h1>Some title</h1><p>Some words before it.</p><{tag} class={name}><p>What stands here in full length is content.</p></{tag}></article>")


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (1, "u", PAGE, "x"), (3, "u", "<article>" + "<p>some words of it</p>" * 20_000, "y"), (4, "u", "", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, N_chars string")
    out = main_text(df).collect()
    assert [(r.page_id, r["N_chars_"]) for r in out] == [(r[0], r[3]) for r in rows] and out[3].text.count("\n") == 19_999 and out[4].text == ""
    assert [r.n_chars for r in out] == [len(r.text) for r in out] and out[1].text == "" and out[0] == out[2]
    assert main_text(df.limit(0)).collect() == []
