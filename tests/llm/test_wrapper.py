import time

import pytest

from shardweave.llm import wrapper

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{x}</style><script>var a='</p>';</script></head><body class='no-sidebar'>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>Menu %(k)s</a></ul></nav><div id='wrap'><div class='sidebar'>side %(k)s</div>"
    "<div class='content'><div class='line'>Always the same</div><h1>Title %(k)s</h1><p>a&nbsp;b <i>c</i><br>d %(k)s &lt; &eacute;&#8212;&copy %(long)s"
    "<p>shared words<div class='notice'>n</div><ul><li>x<li>y %(k)s</ul><form><p>f</form>"
    "<section class='comments'><article class='comment'>q %(k)s</article></section></div></div><!-- <p>no</p> --><footer>f %(k)s</footer>"
)


def page(k):
    return PAGE % {"k": k, "long": f"words of page {k} " * 20}


def body(k):
    return "\n".join([f"Title {k}", " ".join(f"a b c d {k} < é—© {f'words of page {k} ' * 20}".split()), "shared words", "x", f"y {k}"])


def test_wrapper_finds_the_slots():
    learned = wrapper.induce([page(k) for k in range(5)])
    assert learned["path"][-1] == "div.content"
    assert [wrapper.read(page(k), learned) for k in (1, 9)] == [body(1), body(9)]


def test_matching_is_the_largest():
    a = wrapper.fold([wrapper.parse("<div><h1>x</h1><p>1</p><ul><li>2</ul><p>3</p></div>")])
    b = wrapper.fold([wrapper.parse("<div><p>1</p><p>4</p><table></table><p>5</p></div>")])
    score, pairs = wrapper.tree_matching(a, b)
    assert score == len(pairs) == 4


def test_pages_of_odd_form():
    lone = {"path": [], "constant": []}
    for raw in ("", "plain text", "<p>open <b>x", "</div></p>", "<<<>>> & &amp &#xZZ;", "<article>", "<script>never closed", "<!-- open", "a<br/>b"):
        wrapper.read(raw, lone)
    assert wrapper.read("a <br/> b<p>c", lone) == "a b\nc"
    assert wrapper.read("<nav><ul><li>menu<article><p>kept</p></article>", lone) == "kept"
    assert wrapper.read("<div hidden>no</div><div style='display: none'>no</div><p>yes", lone) == "yes"


def test_text_beside_the_slots_stays():
    lead = "<body><div class='x'>top</div><article><h1>Title %(k)s</h1><p>lead %(k)s</p><div class='body'><p>%(long)s</p></div></article>"
    pages = [lead % {"k": k, "long": f"words {k} " * 99} for k in range(4)]
    assert wrapper.read(pages[2], wrapper.induce(pages)).split("\n")[:2] == ["Title 2", "lead 2"]
    same = [f"<body><article><h1>Title</h1><p>same words</p><div class='meta'>page {k}</div></article>" for k in range(4)]
    assert wrapper.read(same[3], wrapper.induce(same)) == "Title\nsame words\npage 3"
    bare = [f"<body><div class='w'><h1>Title</h1><p>same words</p><div class='meta'>page {k}</div></div>" for k in range(4)]
    assert wrapper.read(bare[3], wrapper.induce(bare)) == "Title\nsame words\npage 3"
    some = [f"<body><article>{'<p>lead</p>' * (k == 1)}<div class='body'><p>{f'words {k} ' * 99}</p></div></article>" for k in (1, 2, 333)]
    assert wrapper.read(some[0], wrapper.induce(some)).startswith("lead\nwords 1")


def test_pages_of_many_levels():
    for tag in ("div", "font"):
        deep = [f"<body><p>first {k}</p>" + f"<{tag}>" * 5000 + f"text {k}" for k in range(3)]
        assert wrapper.read(deep[1], wrapper.induce(deep)).split() == ["first", "1", "text", "1"]


def test_main_text(spark):
    rows = [(k, f"http://h.example/{k}", page(k), "x") for k in range(12)]
    rows += [(20, "http://h.example/n", None, "x"), (21, None, "<p>no host</p>", "x"), (22, "http://lone.example", "<body><p>one &amp; only</p></body>", "x"), (None, "http://h.example/e", "", "x"), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = wrapper.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == body(k) for k in range(12))
    assert text[20] == "" and text[None] == "" and text[21] == "no host" and text[22] == "one & only"
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrapper.main_text(pages.limit(0)).collect() == []


def test_copies_of_pages_do_not_hide_the_wrapper(spark):
    rows = [(k, f"http://h.example/{k}", page(k % 60), "x") for k in range(60 * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    (learned,) = wrapper.wrappers(pages).collect()
    (alone,) = wrapper.wrappers(pages.where("page_id < 60")).collect()
    assert learned == alone and "div.content" in learned.wrapper


NAMES = ["content", "content widget", "social-post", "post related-story", "alert story", "page-header body-text", "ad-free", "menu-item recipe", "login"]


def named(name, k):
    """A page whose article is named, beside parts that are what their names say, and what its text is."""
    paragraphs = [f"words {k} {i} " * 9 for i in range(4)]
    said = "<div class='comments'>" + f"<p>reader {k}</p>" * 99 + "</div>"
    page = (
        f"<body><nav>menu</nav><div class='promo'><p>buy {k}</p></div><div class='{name}'><h1>T{k}</h1>"
        + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div>{said}<div class='sidebar'><p>side {k}</p></div></body>"
    )
    return page, "\n".join([f"T{k}", *[" ".join(p.split()) for p in paragraphs]])


@pytest.mark.parametrize("name", NAMES)
def test_names_do_not_decide_alone(name):
    pages = [named(name, k) for k in range(5)]
    learned = wrapper.induce([p for p, _ in pages])
    assert [wrapper.read(p, learned) for p, _ in pages] == [text for _, text in pages]
    assert wrapper.read(pages[0][0], {"path": [], "constant": []}) == pages[0][1]  # a page of its own
    # a long part of the same name stays apart where there is an article beside it
    beside = [p.replace(f"class='{name}'", "class='x'").replace("class='promo'", f"class='{name} promo'") for p, _ in pages]
    assert [wrapper.read(p, wrapper.induce(beside)) for p in beside] == [text for _, text in pages]


def test_a_part_that_never_changes_keeps_its_name():
    pages = [f"<body><div class='notice'><p>{'the same on all pages ' * 20}</p></div><div><p>item {k}</p></div>" for k in range(4)]
    assert wrapper.read(pages[2], wrapper.induce(pages)) == "item 2"


def test_labels_in_paragraphs_stay():
    lone = {"path": [], "constant": []}
    assert wrapper.read("<body><p>a <label>b</label> c</p><label>form</label>", lone) == "a b c"


def test_wide_pages():
    for block in ("<h3>h {i} {k}</h3><p>text {i} {k}</p>", "<div class='q'>h {i} {k}</div><div class='a'>text {i} {k}</div>", "<p>text {i} {k}</p>"):
        pages = ["<body>" + "".join(block.format(i=i, k=k) for i in range(6000)) for k in (1, 2)]
        start = time.monotonic()
        lines = wrapper.read(pages[0], wrapper.induce(pages)).split("\n")
        assert time.monotonic() - start < 20
        assert lines == [f"{w} {i} 1" for i in range(6000) for w in ("h", "text") if w == "text" or "h {i}" in block]
