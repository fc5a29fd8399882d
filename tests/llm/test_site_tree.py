import math
import re
import time
from collections import Counter, defaultdict

import pytest

from skein.llm import site_style


def host_of(url):
    return re.sub(r":\d+$", "", re.match(r"[^/?#]*", (url or "").split("://")[-1])[0].split("@")[-1]).lower()


def plain_extract(pages):
    """The whole operator once more, page by page, from what ``parse`` sees."""
    by_host, out = defaultdict(list), {}
    for page, url, html in pages:
        by_host[host_of(url)].append((page, *site_style.parse(html or "")))
    for parsed in by_host.values():
        m, texts, layouts, levels, paths, shown = len(parsed), Counter(), defaultdict(Counter), defaultdict(Counter), {}, Counter()
        for _, blocks, nodes in parsed:
            inside = any(b.main for b in blocks)
            texts.update({(b.nodes[-1], b.content) for b in blocks if b.nodes})
            for node, layout in {(n.nodes[-1], n.layout) for n in nodes if n.nodes}:
                layouts[node][layout] += 1
            for node, level in {(n.nodes[-1], 2 if inside and not n.main else n.level) for n in nodes if n.nodes and not n.kept}:
                levels[node][level] += 1
            paths.update({n.nodes[-1]: n.nodes for n in nodes if n.nodes and not n.kept})
        low, stay, repeated = set(), set(), set()
        if m >= site_style.PAGES:
            repeated = {c for (_, c), n in texts.items() if n >= site_style.PAGES and 2 * n >= m and 1 - math.log(n) / math.log(m) < site_style.LOW}
            for node in paths:
                shown = sum(layouts[node].values())
                under = [n for (leaf, _), n in texts.items() if leaf in paths and node in paths[leaf]]
                if shown < site_style.PAGES or not under:
                    continue
                content = 1 - sum(map(math.log, under)) / len(under) / math.log(m)
                layout = -sum(c / shown * math.log(c / shown) for c in layouts[node].values()) / math.log(m)
                share = site_style.GAMMA ** len(layouts[node])
                level = max(levels[node], key=lambda k: (levels[node][k], k))
                if site_style.FACTORS[level] * ((1 - share) * layout + share * content) < site_style.LOW:
                    low.add(node)
                elif level:
                    stay.add(node)
        for page, blocks, _ in parsed:
            inside = any(b.main for b in blocks)
            plain = [b for b in blocks if not b.named and (b.main or not inside)]
            least = site_style.SOLID * sum(len(b.text) for b in plain)
            own = [b for b in blocks if (b.main or not inside) and not low & set(b.nodes) and set(b.named) <= stay and b.content not in repeated]
            fresh = [b for b in plain if b.content not in repeated]
            out[page] = "\n\n".join(b.text for b in next(x for x in (own, fresh, plain) if sum(len(b.text) for b in x) >= least))
    return out


def site(host, n, article, names=("related", "share", "cookie")):
    """Pages with related links and a teaser that differ, and a share line and a notice that don't, within their articles."""
    pages = []
    for i in range(n):
        own = f"<h1>Title {i}</h1><p>Story {i} tells of {i * 7 % 11}.</p><p>Its end is {i * i}.</p>"
        more = f"<div class={names[0]}><p>See also number {i * 3} on {i % 4}</p></div><div class={names[1]}>Send this to a friend</div><div class={names[2]}>We use crumbs</div><div class=teaser><p>Tomorrow: {i + 1000}</p></div>"
        body = f"<article>{own}{more}</article>" if article else own + more
        pages.append((f"{host}{i}", f"https://{host}/{i}", f"<body><nav>Home | {i}</nav>{body}<footer>All {i} of us</footer></body>"))
    return pages


def table():
    pages = site("named.example", 20, True) + site("bare.example", 20, False) + site("blank.example", 20, True, ("x1", "x2", "x3")) + site("few.example", 3, True)
    pages += [("none", None, None), ("none2", None, "<p>No host</p>"), ("dup", "https://named.example/0", site("named.example", 1, True)[0][2])]
    pages += [(f"rare{i}", f"https://named.example/r{i}", f"<article><p>Rare {i}</p><div class=widget>Only here {i}</div></article>") for i in range(2)]
    return pages + [("long", "https://long.example/", "<p>" + "word &amp; " * 200_000 + "</p>" + "<div class=ad>x" * 3000)]


def found(spark, pages):
    frame = spark.createDataFrame(pages, "page_id string, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in site_style.extract(frame).collect()}


def test_extract_equals_a_plain_version(spark):
    assert found(spark, table()) == plain_extract(table())


def test_the_tree_decides_and_names_only_multiply(spark):
    """What is called related stays, as its texts differ; what is called share and says the same goes; a cookie notice
    goes in any case. Without names the same lines go by their texts alone. A host with too few pages has names only."""
    text = found(spark, table())
    assert text["named.example3"] == "Title 3\n\nStory 3 tells of 10.\n\nIts end is 9.\n\nSee also number 9 on 3\n\nTomorrow: 1003"
    assert text["bare.example3"] == text["blank.example3"].replace("blank", "bare") == text["named.example3"]
    assert text["few.example1"] == "Title 1\n\nStory 1 tells of 7.\n\nIts end is 1.\n\nTomorrow: 1001"
    assert text["rare1"] == "Rare 1"  # a named node on too few pages
    page = next(p[2] for p in table() if p[0] == "named.example3")
    assert "See also" not in site_style.main_text(page) and site_style.main_text(page) != text["named.example3"]  # without the tree


def test_broken_markup_takes_time_by_its_length():
    for bad in ['<a x="', "<a ", "<b>", "<a x='\">", "<div>", "<!--", "<!", "<", "<p><b>", "<b>x</i>", "<li>", "</p>", "<td><tr>", "<script>", "<b><p>x", '<i class="a">x<div>', "&amp;<", "</b><a href='>"]:
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            site_style.main_text(bad * n + "<p>end")
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.5, (bad, took)


@pytest.mark.parametrize("page, text", [('<a x="1>2">link</a> text', "link text"), ("<p title='a>b'>one</p>", "one"), ('<p x="unclosed>two</p>', "two"), ("1 < 2 and 3 > 2 <b>yes</b>", "1 < 2 and 3 > 2 yes"), ("<p>a<!-- > <p>b --> c", "a c"), ("<p>x</p><!-- never closed <p>y", "x"), ("<", "<"), ("a <", "a <"), ("<p>a</p", "a</p"), ("<>x", "<>x"), ("<p>q\"uote <i>in</i> te'xt", "q\"uote in te'xt")])
def test_tags_are_read_as_browsers_do(page, text):
    assert site_style.main_text(page) == text
