"""Gold pages of the HTML extraction, and the consensus of hosts against a plain count."""

from collections import Counter

import pytest

from stackplume.llm import html_extract

ARTICLE = "<h1>A title</h1><p>First, some words of the article.</p><p>Then, a few more of them.</p>"
TEXT = "A title First, some words of the article. Then, a few more of them."

GOLD = {
    "plain": (f"<html><body><nav>menu</nav><article>{ARTICLE}</article><footer>f</footer></body></html>", TEXT),
    "no body": (f"<title>t</title>{ARTICLE}", TEXT),
    "no body, one small div": (f"{ARTICLE}<div>small</div>", f"{TEXT} small"),
    "wrapper with an unwanted part": (f'<body><div class="content-sidebar-wrap"><main><article>{ARTICLE}</article></main></div></body>', TEXT),
    "class that denies": (f'<body><div class="no-header">{ARTICLE}</div><div class="ad">buy</div></body>', TEXT),
    "class that holds": (f'<body class="x"><div class="has-sidebar">{ARTICLE}</div><div id="sidebar">side</div></body>', TEXT),
    "marked wrapper of the article": (f'<body><div class="widget"><article>{ARTICLE}</article><nav>menu</nav></div></body>', TEXT),
    "marked wrapper of everything": (f'<body><div class="social">{ARTICLE}<div class="ad">buy</div></div></body>', TEXT),
    "page in a form": (f'<body><form action="/"><nav>menu</nav><div>{ARTICLE}</div><footer>f</footer></form></body>', TEXT),
    "form beside the article": (f"<body><div>{ARTICLE}</div><form><p>Your mail:</p><button>go</button></form></body>", TEXT),
    "comments as articles": (
        f'<body><article>{ARTICLE}</article><div id="comments"><article class="comment"><p>{"Nice. " * 99}</p></article></div></body>', TEXT,
    ),
    "comments as articles, none for the text": (
        f'<body><div class="text">{ARTICLE}</div><section class="comments"><article class="comment"><p>{"Nice. " * 99}</p></article></section></body>', TEXT,
    ),
    "teasers aside": (f'<body><main>{ARTICLE}</main><aside><article><h2>Another</h2></article></aside></body>', TEXT),
    "site footer, wrapped adverts": (f'<body><div>{ARTICLE}</div><div class="ad-container">buy</div><div class="site-footer">f</div></body>', TEXT),
    "references and white space": ("<body><p>a&nbsp;&amp;&#x41;\n\t b</p><p>c</p><script>x</script><!-- d --></body>", "a &A b c"),
    "inline closing across a menu": ("<body><div><b>one<nav>menu</b> two</div></body>", "one two"),
    "menus only": ("<body><nav>menu</nav><footer>f</footer></body>", ""),
    "bare text": ("just text <b", "just text"),
    "empty": ("", ""),
    "missing": (None, ""),
}


@pytest.mark.parametrize("case", GOLD)
def test_gold(case):
    page, text = GOLD[case]
    assert html_extract.page_text(page) == text


def pages_of_templates(templates: int, each: int) -> list[tuple]:
    """Pages of many templates on one host; on every third page a linkless box beside the article is longer than it."""
    rows = []
    for t in range(templates):
        for k in range(each):
            box = "Boxed words, many of them. " * (30 if k % 3 == 0 else 0)
            page = f'<body><div class="post-t{chr(97 + t)}">{ARTICLE}</div><div class="box">{box}</div></body>'
            rows.append((len(rows), "http://many.example/x", page))
    return rows


def plain_extract(rows: list[tuple]) -> dict:
    """The consensus counted page by page."""
    host = lambda u: u.split("/")[2] if u else ""
    having, votes = Counter(), Counter()
    scores = [html_extract.candidates(html_extract.read_page(p)[1]) for _, _, p in rows]
    for (_, url, _), found in zip(rows, scores):
        for path in found:
            having[host(url), path] += 1
        if found:
            votes[host(url), min(found, key=lambda p: (-found[p], p))] += 1
    texts = {}
    for (page_id, url, page), found in zip(rows, scores):
        won = [(votes[host(url), p], p) for p in found if votes[host(url), p] >= 2 and 2 * votes[host(url), p] >= having[host(url), p]]
        texts[page_id] = html_extract.page_text(page, max(won)[1] if won else None)
    return texts


def test_consensus_equals_a_plain_count(spark):
    rows = pages_of_templates(20, 3)
    rows += [(1000 + k, None, page) for k, (page, _) in enumerate(GOLD.values())]
    rows += [(2000 + k, f"https://h{k % 3}.example/p", f"<body><div class='c{k % 2}'>{ARTICLE}</div><p>loose</p></body>") for k in range(12)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == plain_extract(rows)


def test_every_template_of_a_host_votes(spark):
    """Twenty templates with one page in twenty each: all of their paths win, none is cut off."""
    page = '<body><div class="{0}">{1}</div><p>{2}</p></body>'
    rows = []
    for t in range(20):
        for k in range(5):
            # The text beside the article is what the page's own best container would add.
            loose = "More text outside, and more of it. " * (4 if k == 0 else 0)
            rows.append((len(rows), "http://many.example/x", page.format(f"kind{chr(97 + t)}", f"<section>{ARTICLE}</section>", loose)))
    read = html_extract.read_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    winners = html_extract.winning_paths(html_extract.shapes_of(read))
    assert {r["path"] for r in winners.collect()} == {f"/body/div.kind{chr(97 + t)}/section" for t in range(20)}
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in found.collect()} == {TEXT}
