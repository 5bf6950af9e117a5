from __future__ import annotations

import random
import re

from hydrostar.llm import urls
from hydrostar.llm.queries import SITE_RULES

KIND = "page_id long, url string, id string, host string, verdict string"


def run(spark, rows, rules=SITE_RULES):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], KIND)
    out = urls.filter_urls(df, rules).collect()
    return sorted((tuple(r)[:5] for r in out), key=str)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, rules=SITE_RULES):
    out = []
    for i, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = lower(host)
        fits = [
            r
            for r in rules
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        ]
        best = max(fits, key=lambda r: (len(r.name), r.action == "block"), default=None)
        spam = any(
            re.search(rf"(?<![a-z0-9]){re.escape(p.phrase)}(?![a-z0-9])", lower(host + path))
            for p in urls.DEFAULT_PHRASES
        )
        verdict = best.action if best else "block" if spam else "allow"
        out.append((i, host, path, best.name if best else None, verdict))
    return sorted(out, key=str)


def test_longest_rule_and_subdomains(spark):
    rnd = random.Random(3)
    hosts = "example.net WWW.Example.NET net xnet example.com.net example.com a.org org spam-farm.io cheap-pillsx.io".split()
    tails = ["", "/", "/en/", "/en", "/en/x?y", "/de/1#t", "/fr/", "?q", "#f", "//en/", "/casino/online-casino/", "/Cheap-Pills", "/a/CHEAP-PILLS/", "/EN/"]
    rows = [(k, f"{rnd.choice(['http', 'x'])}://{rnd.choice(hosts)}{rnd.choice(tails)}") for k in range(400)]
    assert run(spark, rows) == brute(rows)


def test_awkward_urls(spark):
    rows = [
        (None, None),
        (1, ""),
        (2, "no scheme/en/"),
        (2, "no scheme/en/"),
        (3, "://"),
        (4, "a://b://net/x"),
        (5, "http://example.net/en/\nnext line"),
        (6, "http://" + "a." * 50_000 + "net/"),
        (7, "http://ÜNÏ.example.net/en/ß"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def fits(pattern, whole):
    """A pattern against a URL, by trying every split."""
    start, end = 0, pattern.endswith("|")
    body = lower(pattern[:-1] if end else pattern)
    starts = range(len(whole) + 1)
    if body.startswith("||"):
        body, host = body[2:], whole.split("/")[0]
        starts = [0] + [k + 1 for k, c in enumerate(host) if c == "."]
    elif body.startswith("|"):
        body, starts = body[1:], [0]
    here = set(starts)
    for c in body:
        if c == "*":
            here = set(range(min(here), len(whole) + 1)) if here else here
        elif c == "^":
            ends = {k for k in here if k == len(whole)}
            here = ends | {k + 1 for k in here if k < len(whole) and not re.match(r"[a-z0-9_.%-]", whole[k])}
        else:
            here = {k + 1 for k in here if whole[k : k + 1] == c}
    return any(k == len(whole) for k in here) if end else bool(here)


def test_patterns_against_brute_force(spark):
    rnd = random.Random(8)
    patterns = "||ads.example^ |www.x*ads/ /banner/*/img banner.gif| *track*id^ ||net/a*b| ^spam^ ads ||Example.Com/DE/*.PNG| * | %20"
    patterns = [p for p in patterns.split() if p not in ("*", "|")] + ["/ok/"]
    hosts = "ads.example a.ads.example ads.example.com www.xads example.com spam net track".split()
    paths = ["/", "/ads/", "/banner/1/img", "/x/Banner.GIF", "/de/a.png", "/de/a.pngx", "/atrackidx", "/trackid", "/a/b", "/ab", "/spam", "/ok/ads", "/a%20b", "/aspam-"]
    rows = [(k, f"http://{rnd.choice(hosts)}{rnd.choice(paths)}") for k in range(300)]
    rules = [urls.PatternRule(p, "allow" if p == "/ok/" else "block") for p in patterns]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, [], rules).collect()}
    for k, url in rows:
        whole = lower(url.split("://")[1])
        fit = {r.action for r in rules if fits(r.pattern, whole)}
        assert got[k] == ("block" if fit == {"block"} else "allow"), (url, fit)


def test_patterns_are_indexed_by_whole_tokens():
    assert urls.PatternRule("||ads.example^").tokens == ("ads", "example")
    assert urls.PatternRule("ads*banner/img").tokens == ()
    assert urls.PatternRule("/ads/x*banner|").tokens == ("ads",)


def test_columns_of_the_operators_own_names(spark):
    names = "id host path rule verdict n_candidates token row".split()
    rows = [(1, "http://example.net/en/x"), (2, None), (3, "http://spam-farm.io/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    df = df.selectExpr("*", *[f"CAST('x' AS STRING) AS `{c}`" for c in names])
    got = sorted((tuple(r)[:5] for r in urls.filter_urls(df, SITE_RULES).collect()), key=str)
    assert got == brute(rows)


def test_only_candidates_run(spark):
    rules = [urls.SiteRule("block", f"site{k}.example", "/") for k in range(300)]
    df = spark.createDataFrame([(1, "http://a.site7.example/x"), (2, "http://other.example/")], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(df, rules, phrases=()).collect()}
    assert got[1]["verdict"] == "block" and got[1]["n_candidates"] == 1
    assert got[2]["verdict"] == "allow" and got[2]["n_candidates"] == 0


def test_paths_that_may_go_on_are_not_indexed_by_their_last_run(spark):
    rules = [urls.SiteRule("block", "example.org", "/ads")]
    rows = [(1, "http://example.org/adserver"), (2, "http://example.org/x")]
    assert run(spark, rows, rules) == brute(rows, rules)
