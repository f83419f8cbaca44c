"""Blocks of pages, and what hosts repeat, against plain Python."""

import html
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loomgrid.llm import boilerplate as m
from loomgrid.llm.html_blocks import blocks, chosen


def text_of(page):
    found = blocks(page)
    where = chosen(found)
    return "\n\n".join(t for w, t in found if w == where)


CASES = [
    ("", ""),
    ("plain  text\n only", "plain text only"),
    ("<p>a<p>b &amp; c&nbsp;d<br>e</p>f", "a\n\nb & c d e\n\nf"),
    ("<nav>menu</nav><article><h1>T</h1><p>one <b>two</b>\n three</p></article><p>after</p><footer>foot</footer>", "T\n\none two three"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T\n\nx"),
    ("<header>top</header><div class='content'><p>x</p></div><div id=sidebar>s</div>", "x"),
    ("<body class='has-sidebar menu-open'><div class='with-sidebar'>kept</div></body>", "kept"),
    ("<div class='post'>x</div><section class='comments-area'><article class='comment'>c</article></section>", "x"),
    ("<article><p>x</p><article class='comment odd'><p>c</p></article></article>", "x"),
    ("<script>var t='</p><p>no</p>';</script><style>p{}</style><p>y</p><script>open", "y"),
    ("<!-- <p>no</p> --><p title='a>b'>z</p><!-- open", "z"),
    ("<main><p>m</p></main><p>o</p>", "m"),
    ("<div role=\"main\">m</div><div role='navigation'>n</div>", "m"),
    ("<nav>left open<main><p>m</p></main>", "m"),
    ("<head><title>t</title><body><p>b", "b"),
    ("<p hidden>h</p><p style='display: none'>n</p><span class=ad>a<span>b</span>c</span>d", "d"),
    ("<ul><li>a<li class=share>s<li>b</ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"),
    ("<p>1 < 2 and 3 > 2 &lt;b&gt;</p>", "1 < 2 and 3 > 2 <b>"),
    ("</p></div>x</article>y", "x\n\ny"),
    ("<form><p>f</p></form><aside>a</aside><figure><figcaption>c</figcaption></figure>", "c"),
    ("<ARTICLE><P CLASS=\"Cookie-Notice\">no</P><P>yes</P></ARTICLE>", "yes"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_blocks(page, want):
    assert text_of(page) == want


def test_long_and_broken_pages_take_linear_time():
    assert text_of("<div>" * 50_000 + "x" + "</p>" * 50_000) == "x"
    assert text_of('<a "' * 50_000 + "x").endswith("x")
    assert len(text_of("<p>word</p>" * 100_000)) == 6 * 100_000 - 2


def test_repeated_against_all_windows():
    rng = random.Random(5)
    shared = rng.choices(range(50), k=30)
    pages = [rng.choices(range(6), k=rng.randrange(0, 40)) + shared[: rng.randrange(31)] + rng.choices(range(6), k=9) for _ in range(30)]
    streams = [np.array(p, np.uint64) for p in pages]
    on = defaultdict(set)
    for k, p in enumerate(pages):
        for i in range(len(p) - m.LENGTH + 1):
            on[tuple(p[i : i + m.LENGTH])].add(k)
    text = [t for p in pages for t in p]
    for least in (1, 2, 7):
        places, n = m.repeated(streams, least)
        got = {tuple(text[p : p + m.LENGTH]): c for p, c in zip(places, n)}
        assert got == {w: len(s) for w, s in on.items() if len(s) >= least}
    assert len(m.repeated([np.zeros(3, np.uint64), np.zeros(0, np.uint64)], 1)[0]) == 0


def plain(pages):
    """(page_id, text) by the rule itself."""
    by_host = defaultdict(list)
    for k, (_, url, page) in enumerate(pages):
        host = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]+)", (url or "").lower())
        by_host[host and host.group(1)].append(k)
    out = []
    for host, rows in by_host.items():
        streams = {k: [w for _, t in blocks(pages[k][2] or "") for w in t.split(" ")] for k in rows}
        on = defaultdict(set)
        for k, s in streams.items():
            for i in range(len(s) - m.LENGTH + 1):
                on[tuple(s[i : i + m.LENGTH])].add(k)
        bad = {w for w, s in on.items() if host and len(s) >= m.LEAST_PAGES and len(s) >= m.SHARE * len(rows)}
        for k in rows:
            s, covered = streams[k], set()
            for i in range(len(s) - m.LENGTH + 1):
                if tuple(s[i : i + m.LENGTH]) in bad:
                    covered.update(range(i, i + m.LENGTH))
            found, at, texts, whole = blocks(pages[k][2] or ""), 0, [], []
            where = chosen(found)
            for w, t in found:
                words = t.split(" ")
                left = [x for i, x in enumerate(words, at) if i not in covered]
                at += len(words)
                if w == where:
                    whole.append(t)
                    texts += [" ".join(left)] if left else []
            out.append((pages[k][0], "\n\n".join(texts) or "\n\n".join(whole)))
    return sorted(out, key=repr)


def site(rng, host, n, start=0):
    words = [f"w{i}" for i in range(300)]
    some = lambda k: " ".join(rng.choices(words, k=k))
    menu, notice, half = some(12), some(20), some(15)
    rows = []
    for k in range(n):
        body = f"<div>{menu}</div><p>{some(30)}</p><p>{some(4)} {notice} {some(3)}</p>" + (f"<p>{half}</p>" if k % 2 else f"<div>{some(9)}</div>")
        rows.append((start + k, f"https://user@{host}:8080/{k}?x#y", f"<html><body>{body}</body>"))
    return rows


@pytest.mark.parametrize("shard", [m.SHARD, 2500])
def test_equal_to_plain_python(spark, monkeypatch, shard):
    monkeypatch.setattr(m, "SHARD", shard)
    rng = random.Random(3)
    pages = site(rng, "A.example.com", 40) + site(rng, "b.example.com", 5, 100) + site(rng, "c.example.com", 3, 200)
    copy = "<article>" + " ".join(f"x{i}" for i in range(50)) + "</article>"
    pages += [(300 + k, "http://mirror.example.com/", copy) for k in range(6)] + [(400, None, pages[0][2]), (401, "no url", pages[0][2]), (None, "http://b.example.com", None), (None, "http://b.example.com", ""), (7, "http://a.example.com/", pages[7][2])]
    df = spark.createDataFrame([(*p, "s", 1) for p in pages], "page_id long, url string, html string, strings string, shard int").repartition(6)
    got = m.extracted(df).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=repr) == plain(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    menus = [r for r in got if r["page_id"] is not None and r["page_id"] < 40]
    # the string of half the pages stays where it is on under half of them
    assert all(r["n_covered"] >= 32 for r in menus)


def test_empty_table(spark):
    df = m.extracted(spark.createDataFrame([], "page_id long, url string, html string"))
    assert df.collect() == [] and df.dtypes[:4] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]


def test_whole_table(spark, sf_dir):
    import __spark_entry__ as entry

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = entry.queries()["op12_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        # the pages of this table name their article
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        parts = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|b|br)>", article))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
