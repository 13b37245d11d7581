from citegrove.llm.html_extract import host_of, main_text, parse

ARTICLE = ("The ferry left the harbour at dawn number {0}.", "Nobody on deck {0} had seen the other ship; its lights were {0} miles away, "
           "and the fog of the {0} morning hid everything else that could have been of use to the {0} crew on its way.")


def page(i, extra=""):
    head, body = (x.format(i) for x in ARTICLE)
    return (f"<html><head><title>t {i}</title><style>p{{}}</style></head><body><nav><ul><li><a>Home</a><li><a>About</a></ul></nav>"
            f"<div class='x{i}'>Sign up for our paper today</div>{extra}<div class=story><h1>{head}</h1><p>{body}<p>A &amp; B&nbsp;{i} <b>b</b>old<br>x</div>"
            f"<div id=comments><p>I agree {i}</p></div><footer>&copy; us</footer><script>if (a < b) '</p>'</script></body></html>")


def want(i):
    head, body = (x.format(i) for x in ARTICLE)
    return f"{head} {body} A & B {i} bold x"


def test_repeated_branches_leave(spark):
    rows = [(i, f"http://www.site.example/{i}", page(i), "x") for i in range(40)] + [(40, "http://small.example/", page(40), "x"), (40, "http://small.example/", page(40), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for hosts in (100, 0):
        out = main_text(df, broadcast_hosts=hosts).collect()
        assert len(out) == 42 and {(r.page_id, r.text) for r in out} == {(i, want(i)) for i in range(41)}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no host", ""), (None, "http://a.b", "plain <text & 1 < 2"), (3, "http://a.b", "<p>open <article><li>one<li>two<scr"),
            (4, "http://a.b", "<div>" * 3000 + "deep"), (5, "http://c", "<p>" + "long text " * 50_000), (6, "http://c", "<script>var x")]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == out[2] == out[6] == "" and out[None] == "plain" and out[3] == "open one two" and out[4] == "deep" and len(out[5]) == 499_999
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_parts():
    assert host_of("https://u:p@WWW.Site.example:80/a") == "site.example" and host_of(None) == ""
    blocks, _ = parse("<article><header><h1>T</h1></header><p>a<!-- b --><i>c</i>\n d</p></article><header>top</header>")
    assert [(n, t) for _, n, t in blocks] == [(False, "T"), (False, "ac d"), (True, "top")]


def test_a_word_in_a_name_does_not_remove_the_article(spark):
    for place in ('section class="market-share"', 'div id="legal-text"', 'div class="widget-body"'):
        rows = [(i, f"http://{i % 2}.example/{i}", page(i).replace("<div class=story>", f"<{place}>")
                 .replace("x</div><div id=comments>", f"x</{place.split()[0]}><div id=comments>")) for i in range(30)]
        out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {(r.page_id, r.text) for r in out} == {(i, want(i)) for i in range(30)}
