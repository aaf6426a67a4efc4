import collections
import math
import random
import re
from itertools import combinations

import pytest

from lumenfold.llm.url_rules import RULES, filter_urls, match, mine, op6_url_rules


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_on_odd_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org", "http://org/x", "x://a.com/fr/", "http://xcom/de/", "http://É.COM/de/\n1", "a://b://c.org/p", "http://example.org/en/12?x=http://y.com/de/"] * 2
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: r for r in filter_urls(rows, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or (verdict is None and got[i].verdict in ("allow", "block"))
    assert filter_urls(rows.limit(0), RULES).collect() == []


def test_mined_rules_are_the_frequent_ones(spark):
    data = [(["a", "b"], "block")] * 8 + [(["a", "c"], "allow")] * 8 + [(["b", "c"], "allow")] * 3 + [(["d"], None), ([], "block")]
    got = {(tuple(r.tokens), r.verdict): round(r.confidence, 6) for r in mine(spark.createDataFrame(data, "tokens array<string>, label string"), 0.1, 0.6).collect()}
    want = {}
    rows = [(set(t), v) for t, v in data if v and t]
    for n in (1, 2):
        for tokens in combinations("abc", n):
            fit = [v for t, v in rows if set(tokens) <= t]
            for v in {"allow", "block"} & set(fit):
                if fit.count(v) >= 2 and fit.count(v) / len(fit) >= 0.6:
                    want[tokens, v] = round(fit.count(v) / len(fit), 6)
    pruned = {k: c for k, c in want.items() if not any(o[1] == k[1] and set(o[0]) < set(k[0]) and want[o] >= c for o in want)}
    assert got == pruned


def test_the_surest_rule_decides(spark):
    index = spark.createDataFrame([(["a"], "allow", 0.7, 0.2, "a"), (["a", "b"], "block", 0.9, 0.1, "b")], "tokens array<string>, verdict string, confidence double, support double, token string")
    urls = spark.createDataFrame([("u1", ["a"]), ("u2", ["a", "b"]), ("u2", ["a", "b"]), ("u3", ["b"]), ("u4", [])], "url string, tokens array<string>")
    for bound in (10, 0):
        assert {r.url: r.mined for r in match(urls, index, bound).collect()} == {"u1": "allow", "u2": "block"}


def brute_tokens(url):
    """The tokens of a URL, by regular expressions."""
    host, path, *_ = brute(url)
    labels = [x for x in host.split(".") if x]
    tail = re.search(r"[?#].*$", url)
    tail = tail[0] if tail else ""
    out = ["scheme:" + url.split("://")[0].lower(), *("host:" + x for x in labels), *("word:" + y for x in labels if "-" in x for y in x.split("-") if y)]
    out += ["path:" + re.sub("[0-9]+", "#", x.lower()) for x in path.split("/") if x]
    return {*out, *("query:" + x for x in re.findall("[?&]([^=&#]*)", tail)), *(["fragment"] if "#" in tail else [])}


def brute_rules(rows, min_support=0.01, min_confidence=0.6):
    """{(tokens, label): (confidence, support)} over all subsets of all baskets, pruned by one token at a time."""
    least = max(1, math.ceil(min_support * len(rows)))
    count, told = collections.Counter(), collections.Counter()
    for tokens, label in rows:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                count[c] += 1
                told[c, label] += 1
    found = {k: (n / count[k[0]], n / len(rows)) for k, n in told.items() if n >= least and n / count[k[0]] >= min_confidence}
    less = lambda k: [(tuple(x for x in k[0] if x != y), k[1]) for y in k[0]]
    return {k: v for k, v in found.items() if not any(o in found and found[o][0] >= v[0] for o in less(k))}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_verdicts_of_the_whole_query_as_brute_force(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").collect()}
    rules = brute_rules([(brute_tokens(u), brute(u)[3]) for u in pages.values() if brute(u)[3]])
    got = op6_url_rules(spark, f"/root/testdata/sf{sf}").collect()
    assert len(got) == len(pages)
    decided = 0
    for r in got:
        host, path, rule, verdict = brute(pages[r.page_id])
        if verdict is None:
            tokens = brute_tokens(pages[r.page_id])
            fits = [(c, s, len(t), v) for (t, v), (c, s) in rules.items() if tokens.issuperset(t)]
            verdict = max(fits)[3] if fits else "allow"
            decided += bool(fits)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert decided > len(got) / 10


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, host int, confidence int").write.parquet(f"{tmp_path}/pages.parquet")
    assert op6_url_rules(spark, str(tmp_path)).collect() == []


def test_long_urls_with_tokens_that_go_together(spark):
    """Twenty tokens a URL, of which groups always occur together: seconds, not hours."""
    r = random.Random(8)
    groups = [[f"g{k}{x}" for x in "abcde"] for k in range(10)]
    data = [([t for g in r.sample(groups, 4) for t in g], "block" if r.random() < 0.3 else "allow") for _ in range(500)]
    data += [([*groups[0], "bad", *groups[1], *groups[2]], "block")] * 30
    got = mined(spark, data, 0.04, 0.7)
    assert got[("bad",), "block"] == (1.0, round(30 / 530, 6)) and len(got) > 5
    assert all(len({t[:2] for t in tokens}) == len(tokens) for tokens, _ in got)  # one token of a group at most
    assert all((tuple(sorted(x[:2] + "c" if x != "bad" else x for x in tokens)), v) in got for tokens, v in got)  # and any of them


def mined(spark, data, *how):
    return {(tuple(r.tokens), r.verdict): (round(r.confidence, 6), round(r.support, 6)) for r in mine(spark.createDataFrame(data, "tokens array<string>, label string"), *how).collect()}


def test_rare_tokens_of_long_urls_are_mined(spark):
    common = [f"c{k}" for k in range(30)]
    data = [([*common, "good"], "allow")] * 5 + [([*common, "bad"], "block")] * 5
    assert mined(spark, data) == {(("good",), "allow"): (1.0, 0.5), (("bad",), "block"): (1.0, 0.5)}


def test_mined_rules_are_those_of_all_subsets(spark):
    r = random.Random(5)
    data = [([t for t in "abcdef" if r.random() < 0.6], r.choice(["allow", "block", "block", "ask"])) for _ in range(60)]
    rows = [(set(t), v) for t, v in data if t]
    want = {}
    for tokens in (c for n in range(1, 7) for c in combinations("abcdef", n)):
        fit = [v for t, v in rows if set(tokens) <= t]
        for v in set(fit):
            if fit.count(v) >= 2 and fit.count(v) / len(fit) >= 0.6:
                want[tokens, v] = fit.count(v) / len(fit), fit.count(v) / len(rows)
    fewer = lambda k: [(tuple(x for x in k[0] if x != y), k[1]) for y in k[0]]
    kept = {k: (round(c, 6), round(s, 6)) for k, (c, s) in want.items() if not any(o in want and want[o][0] >= c for o in fewer(k))}
    assert mined(spark, data, 0.03, 0.6) == kept and max(len(k[0]) for k in kept) > 2
