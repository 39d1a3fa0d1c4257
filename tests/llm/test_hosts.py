"""Url filter: plain Python over a small web, odd rows."""

import random
import re
from fractions import Fraction

import pytest

from shardweave.llm import hosts
from shardweave.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, trust long, probe string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(str.maketrans(hosts.UPPER, hosts.UPPER.lower())), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=(None, "", ""))


def expected(pages):
    crawled, linked, edges = {}, {}, {}
    for _, url, html, *_ in pages:
        host, path = parts(url)
        if not host:
            continue
        crawled.setdefault(host, []).append(rule(host, path)[0])
        links = set()
        for href in re.findall(r'<a href="([^"]*)"', re.sub(r"(?s)<!--.*?-->|<script.*?</script", "", html or "")):
            target = parts("http:" + href if href.startswith("//") else href)
            if target[0] and target[0] != host:
                links.add((target[0], rule(*target)[0]))
        for name, said in links:
            linked.setdefault(name, []).append(said)
            edges[host, name] = edges.get((host, name), 0) + 1
    seen = linked | crawled
    seed = {k: {h: v.count(k) * hosts.SCALE // len(v) for h, v in seen.items()} for k in ("allow", "block")}
    out = lambda h, k: sum(w for e, w in edges.items() if e[k] == h)
    trust, distrust = dict(seed["allow"]), dict(seed["block"])
    for _ in range(hosts.ROUNDS if edges else 0):
        t, d = dict(seed["allow"]), dict(seed["block"])
        for (a, b), w in edges.items():
            t[b] += int(Fraction(trust[a] * w * hosts.DAMPING, out(a, 0) * 100))
            d[a] += int(Fraction(distrust[b] * w * hosts.DAMPING, out(b, 1) * 100))
        trust, distrust = t, d
    bad = {h for h in seen if distrust[h] > trust[h] and distrust[h] >= hosts.THRESHOLD}
    rows = []
    for page_id, url, *_ in pages:
        host, path = parts(url)
        kind, name, start = rule(host, path)
        rows.append((page_id, host, path, name + start or None, kind or ("block" if host in bad else "allow")))
    return rows, bad


def web(seed):
    draw = random.Random(seed)
    names = [f"h{k}.{z}" for k in range(14) for z in ("example.com", "example.org", "Example.net", "test")]
    heads = [n + tail for n in names for tail in ("/en/1", "/de/2", "/fr/3?x=http://a.net/", "")]
    pages = []
    for k in range(160):
        url = "http://" + draw.choice(heads)
        links = "".join(f'<a href="{draw.choice(("http:", "HTTPS:", ""))}//{draw.choice(heads)}">x</a>' for _ in range(draw.randrange(4)))
        pages.append((k, url, links + '<a href="/en/1">y</a><!-- <a href="http://hidden.net/">no</a> --><script><a href="//s.net/"></script>', "?", "?", 1, "?"))
    hub = "".join(f'<a href="//h{k}.example.com/x">x</a>' for k in range(14))
    pages += [(200 + k, "http://hub.test/", hub, None, None, None, None) for k in range(40)]
    odd = [None, "", "no scheme", "http://", "x://HOST.Org/fr/?q#f", "http://a.b/\n/c?x", "http://ü.example.net/en/", "://net/"]
    return pages + [(300 + k, u, h, None, None, None, None) for k, u in enumerate(odd) for h in (None, "", "<a href=")] + [(None, "http://h1.test/", None, None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_python(spark, seed, monkeypatch):
    monkeypatch.setattr(hosts, "SPLIT", 3)  # hosts with many links are in several parts
    pages = web(seed)
    want, bad = expected(pages)
    assert bad and any(r[3] is None and r[4] == "block" for r in want)
    got = hosts.judged(spark.createDataFrame(pages, SCHEMA).repartition(3), RULES)
    rows = got.select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_distrust_goes_against_the_links(spark):
    pages = [(1, "http://farm.test/", '<a href="http://bad.net/">a</a><a href="http://bad.net/2">b</a>'), (2, "http://fine.test/", '<a href="http://farm.test/">c</a>'), (3, "http://bad.net/", "")]
    rows = hosts.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "block", 3: "block"}
    trusted = pages + [(k, "http://good.org/fr/", '<a href="http://fine.test/">x</a>') for k in (4, 5)]
    rows = hosts.judged(spark.createDataFrame(trusted, "page_id long, url string, html string"), RULES).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_main_path_has_no_python(spark):
    plan = hosts.judged(spark.createDataFrame(web(1), SCHEMA), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_empty_table(spark):
    assert hosts.judged(spark.createDataFrame([], SCHEMA), RULES).count() == 0
