"""Hosts, paths, rules and the posterior against plain Python."""

import math

from keepwell.llm.url_reputation import Rule, judge, reputation

RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block")]


def judged(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_key long, url string, path string")
    known = spark.createDataFrame(list(outcomes), "page_key long, bad int")
    return {r.page_key: r for r in judge(pages, known, RULES, **kw).collect()}


def test_hosts_paths_and_longest_rule(spark):
    urls = ["http://A.Example.COM/en/1?q=/x", "https://www.example.com/en/", "http://example.com", "no url", None, "",
            "http://x.net/es/a#b", "http://x.net/fr/", "HTTP://y.com/a://z/b", "http://?a", "http://notexample.com/en/x",
            "http://ÉX.net/es/" + "a" * 100_000]
    got = judged(spark, urls)
    assert [(got[i].host, got[i].path[:9], got[i].rule) for i in range(len(urls))] == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"),
        ("example.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("x.net", "/es/a", "net/es/"),
        ("x.net", "/fr/", None), ("y.com", "/a://z/b", "com/"), ("", "", None),
        ("notexample.com", "/en/x", "com/"), ("Éx.net", "/es/aaaaa", "net/es/")]
    assert got[0].verdict == "block" and got[1].verdict == "allow" and got[3].verdict == "allow"


def test_empty_table_and_no_labels(spark):
    assert judged(spark, []) == {}
    got = judged(spark, ["http://a.org/x"] * 3)
    assert [got[i].verdict for i in got] == ["allow"] * 3 and abs(got[0].host_rate - 0.5) < 1e-12


def test_posterior_matches_python(spark):
    counts = {"a.x.org": (40, 38), "b.x.org": (2, 2), "c.y.org": (30, 0), "d.y.org": (0, 0), "e.co.uk": (5, 1)}
    rows = [(h, 1 if i < k else 0) for h, (n, k) in counts.items() for i in range(n)] + [("d.y.org", None)]
    got = {r.host: r for r in reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    domain = {"a.x.org": "x.org", "b.x.org": "x.org", "c.y.org": "y.org", "d.y.org": "y.org", "e.co.uk": "e.co.uk"}
    suffix = {"x.org": "org", "y.org": "org", "e.co.uk": "co.uk"}

    beta = lambda a, b: a * b / ((a + b) ** 2 * (a + b + 1))

    def level(children, parents):
        """(mean, variance) of every child under the (mean, variance) of its parent."""
        num = sum(n * (k / n - m) ** 2 - m * (1 - m) for (n, k), (m, _) in zip(children, parents) if n)
        den = sum((n - 1) * m * (1 - m) for (n, k), (m, _) in zip(children, parents) if n)
        m0 = 1 / min(max(num / den, 1 / 1001), 1 / 3) - 1
        return [((k + m0 * m) / (n + m0), beta(k + m0 * m, n - k + m0 * (1 - m)) + (m0 / (n + m0)) ** 2 * v)
                for (n, k), (m, v) in zip(children, parents)]

    up = lambda table, by: {p: tuple(sum(table[c][i] for c in table if by[c] == p) for i in (0, 1)) for p in set(by.values())}
    d = up(counts, domain)
    s = up(d, suffix)
    bad, good = sum(k for _, k in s.values()) + 0.5, sum(n - k for n, k in s.values()) + 0.5
    rs = dict(zip(s, level(list(s.values()), [(bad / (bad + good), beta(bad, good))] * len(s))))
    rd = dict(zip(d, level(list(d.values()), [rs[suffix[x]] for x in d])))
    for h, (mean, var) in zip(counts, level(list(counts.values()), [rd[domain[h]] for h in counts])):
        low = max(mean - 1.64 * math.sqrt(var), 0)
        assert math.isclose(got[h].mean, mean, rel_tol=1e-9) and math.isclose(got[h].bound, low, rel_tol=1e-9, abs_tol=1e-12)


def test_one_bad_label_does_not_block_the_others(spark):
    got = judged(spark, ["http://a.org/x", "http://b.net.nz/y", None, "http://c.org/z"], [(0, 1)])
    assert [got[i].verdict for i in (1, 2, 3)] == ["allow"] * 3
    many = judged(spark, ["http://a.org/x"] * 30 + ["http://b.org/y"] * 30 + [None], [(i, int(i < 30)) for i in range(60)])
    assert many[0].verdict == "block" and many[30].verdict == "allow" and many[60].verdict == "allow"
