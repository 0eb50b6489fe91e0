from cpelink.llm import styletree as S


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, host string, blocks int")


def texts(page):
    return [b[3] for b in S.blocks(page) if not b[2]]


def test_blocks():
    assert texts("<p>a &amp; b&#33; &copy;<br>c\n\n d<p>two <b>bo</b>ld <i>x<p>three</i> tail") == [
        "a & b! © c d", "two bold x", "three tail"]
    assert texts("<script>if (a<b) x('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><p>yes") == ["yes"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul></ul>after") == ["one", "two", "in", "after"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<div class='Cookie-Notice x'>no</div><div id=sidebar>no</div><div class=article>yes</div>") == ["yes"]
    assert texts("<header>no</header><article><header>Title</header>x<footer>no</footer></article>") == ["Title", "x"]
    assert texts("<form><input>no</form><p>1 < 2 and <3 <b\n>b</b></p>") == ["1 < 2 and <3 b"]
    assert texts("<p title=don't>x</p><p>it's</p>") == ["x", "it's"] and texts("<script>open <p>x") == []
    assert texts("<p title='a>b'>x</p") == ["x"] and texts("") == texts(None) == []
    assert texts("a</p></div>b<article>c</article></article>d") == ["ab", "c", "d"]


PAGE = ("<html><head><title>t{i}</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy {i}</div><article>"
        "<h1>Head {i}</h1><p>First &lt;{i}&gt; of <em>it</em></p>bare {i}<div class='comments'><p>reader {i}</p></div>"
        "</article><aside>Side {i}</aside><footer>&copy; f</footer></body></html>")


def test_report(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", PAGE.format(i=i)) for i in range(30)]
    rows += [(100, None, None), (101, "no host", ""), (102, "http://h0.example/x", "<nav>only</nav>"),
             (5, "http://h2.example/5", PAGE.format(i=5)), (103, "http://x", "<p>" + "long " * 100_000),
             (None, "http://x", "<p>no id")]
    got = [tuple(r) for r in S.extraction_report(table(spark, rows)).collect()]
    want = [(i, u, f"Head {i}\nFirst <{i}> of it\nbare {i}") for i, u, _ in rows[:30]]
    want += [(100, None, ""), (101, "no host", ""), (102, "http://h0.example/x", ""), want[5],
             (103, "http://x", ("long " * 100_000).strip()), (None, "http://x", "no id")]
    assert sorted(got, key=str) == sorted([(*w, len(w[2])) for w in want], key=str)


def test_entropy_removes_repeated_branches(spark):
    """No article element and no telling names: only the spread of the texts tells notices from content."""
    page = ("<body><div class=x1><p>Welcome to our site</p></div><div class=x2><p>Story {i} on its own</p><p>More {i}</p></div>"
            "<div class=x3><span>Read our terms {k}</span></div></body>")
    rows = [(i, f"https://one.example/{i}", page.format(i=i, k=i % 2)) for i in range(60)]
    rows += [(100 + i, f"https://small{i}.example/", page.format(i=100 + i, k=i % 2)) for i in range(6)]
    got = {r.page_id: r.text for r in S.extraction_report(table(spark, rows)).collect()}
    assert got == {i: f"Story {i} on its own\nMore {i}" for i in got} and len(got) == 66
    nodes = {(r.host, r.path): r.importance for r in S.importance(S.parse_pages(table(spark, rows))).collect()}
    assert nodes[("one.example", ">body>div.x1>p")] < 0.05 and nodes[("one.example", ">body>div.x2>p")] > 0.95


def test_copied_articles_stay(spark):
    same = "<body><article><p>The very same text</p></article><div>Notice</div></body>"
    rows = [(i, f"https://copies.example/{i}", same) for i in range(40)]
    assert {r.text for r in S.extraction_report(table(spark, rows)).collect()} == {"The very same text"}


def test_names_are_a_prior(spark):
    """Names that tell what a container has, or that stand on unique text, do not erase the main text."""
    story = "<h1>Head {i}</h1><p>Story {i} on its own and at some length</p>"
    pages = ["<body><div class='content has-sidebar'><article>" + story + "</article></div>",
             "<body><div class='layout sidebar'><article>" + story + "</article></div>",
             "<body><main class='with-sidebar'>" + story + "</main>", "<body><article class='has-comments'>" + story + "</article>",
             "<body><main class='sidebar-right'>" + story + "</main>",
             "<body><article><h1 class='page-header'>Head {i}</h1><p class=notice>Story {i} on its own and at some length</p>"
             "<div class=comments><p>reader {i}</p></div></article>"]
    rows = [(100 * k + i, f"https://h{k}.example/{i}", h.format(i=100 * k + i)) for k, h in enumerate(pages) for i in range(30)]
    got = {r.page_id: r.text for r in S.extraction_report(table(spark, rows)).collect()}
    assert got == {i: f"Head {i}\nStory {i} on its own and at some length" for i in got} and len(got) == len(rows)


def test_presentation_importance(spark):
    """Of two branches of the same name and with unique texts, the one of varied elements stays."""
    kinds = ["ul><li", "table><tr><td", "blockquote", "pre", "dl><dd", "section><h2", "h3", "div class=x1", "div class=x2", "p"]
    rows = [(i, f"https://a.example/{i}", f"<body><div class=widget><{kinds[i % 10]}>Varied {i}</div>") for i in range(40)]
    rows += [(100 + i, f"https://b.example/{i}", f"<body><div class=widget><p>Same {i}</p></div><p>Own {i}</p>") for i in range(40)]
    got = {r.page_id: r.text for r in S.extraction_report(table(spark, rows)).collect()}
    assert got == {i: f"Varied {i}" if i < 100 else f"Own {i - 100}" for i in got} and len(got) == 80


def test_repeated_notice_inside_the_article_goes(spark):
    page = "<body><article><p>Story {i} on its own and at some length</p><div class=x9>All rights are ours</div></article>"
    rows = [(i, f"https://n.example/{i}", page.format(i=i)) for i in range(30)]
    rows += [(100 + i, f"https://n.example/c{i}", page.format(i="copied")) for i in range(30)]
    got = {r.page_id: r.text for r in S.extraction_report(table(spark, rows)).collect()}
    assert got == {i: f"Story {i if i < 100 else 'copied'} on its own and at some length" for i in got} and len(got) == 60


def test_small_hosts_are_judged_by_their_own_pages(spark):
    page = "<body><div class=x1><p>Menu of host {h}</p></div><div class=x2><p>Story {i} on its own</p></div></body>"
    rows = [(10 * h + i, f"https://s{h}.example/{i}", page.format(h=h, i=10 * h + i)) for h in range(40) for i in range(4)]
    alone = [(1000 + i, "https://few.example/", f"<body><div class=y{{}}><p>Notice</p></div><b>Text {i}</b>") for i in range(3)]
    for table_rows in (rows, rows + alone, alone):
        got = {r.page_id: r.text for r in S.extraction_report(table(spark, table_rows)).collect()}
        assert got == {i: f"Story {i} on its own" if i < 1000 else f"Text {i - 1000}" for i in got}
        assert len(got) == len(table_rows)


def test_one_page_and_copies_stay_whole(spark):
    page = "<body><div class=x1><p>Menu</p></div><div class=x2><p>Story on its own</p></div></body>"
    rows = [(i, "https://one.example/", page) for i in range(5)]
    assert {r.text for r in S.extraction_report(table(spark, rows)).collect()} == {"Menu\nStory on its own"}


def test_empty(spark):
    assert S.extraction_report(table(spark, [])).collect() == []
