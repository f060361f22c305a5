import random
import re

from ledgerlark.llm.url_filter import RULES, filter_pages, filter_urls, list_keys

SCHEMA = "page_id long, url string, host string, `a.b` int"


def parts(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def judged(url, listed, rules=RULES):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    labels = host.split(".")
    hit = bool(host) and (any(".".join(labels[i:]) in listed for i in range(len(labels))) or host + path in listed)
    rule, verdict = max(fits)[1:] if fits else (None, "block" if hit else "allow")
    return host, path, rule, verdict, hit


def test_cases(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/ES/x", "https://example.org/es/1", "https://a.example.org/en/15?x#y", "https://notexample.org/en/15", "http://x.com/fr/", "http://x.com/fr", "http://com/de/",
        "http://org", "http://org?/x", "http://org/", "http://a.cheap-pills.example.com/en/1", "http://CHEAP-PILLS.example.com?q", "http://xcheap-pills.example.com/", "http://pills.example.com#://b.org/", "http://İ.org/É", "ftp://a..b./x", "x" * 300_000 + "://e.net/" + "y" * 300_000,
    ]
    rows = [(i, u, "other", 1) for i, u in enumerate(urls)] + [(3, "http://x.com/fr/", None, None)] * 2 + [(None, "http://free-bets.example.net/a", None, None)]
    got = filter_pages(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    listed = {f"{n}.example.{e}" for n in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for e in ("com", "net", "org")}
    want = [(i, *judged(u, listed)) for i, u, *_ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert filter_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_large_list_is_exact(spark):
    """Many listed domains and pages among many others: every level is needed, in one cascade and in several."""
    rng = random.Random(5)
    names = [f"n{i}.{rng.choice('abcdefgh')}.net" for i in range(6000)]
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(names)}{rng.choice(['', '/', '/p', f'/q/{i % 50}'])}{rng.choice(['', '?a=b'])}" for i in range(9000)] + ["http://hot.net/same"] * 4000
    entries = rng.sample(names, 1500) + [f"https://{rng.choice(names)}/q/{i % 50}" for i in range(1500)] + ["b.net/", "hot.net/same", "", None, "B.net"]
    listed = {"".join(parts("x://" + re.sub("^https://", "", e))).rstrip("/") if e.rstrip("/").count("/") < 3 and "/" not in re.sub("^https://", "", e).rstrip("/") else "".join(parts("x://" + re.sub("^https://", "", e))) for e in entries if e}
    pages = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)], SCHEMA)
    frame = spark.createDataFrame([(e,) for e in entries], "entry string")
    want = {i: judged(u, listed) for i, u in enumerate(urls)}
    assert 0.2 < sum(w[4] for w in want.values()) / len(want) < 0.8
    for most in (1 << 25, 30_000):
        got = filter_urls(pages, frame, most_bits=most).collect()
        assert len(got) == len(urls) and all(tuple(r)[1:] == want[r.page_id] for r in got), most
    assert not any(r.listed for r in filter_urls(pages, frame.limit(0)).collect())


def test_plan(spark):
    """Pages meet no join, no shuffle and no Python on their way to the verdict, and only ids and urls are read."""
    pages = spark.createDataFrame([(1, "http://a.b/c", None, None)], SCHEMA)
    plan = filter_pages(pages)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subqueries")[0]
    assert not re.search("Join|Exchange|Python|Arrow", main)


def test_list_keys(spark):
    rows = list_keys(spark.createDataFrame([("A.com",), ("a.com/",), ("http://a.com/X?y",), ("",), (None,)], "entry string")).collect()
    assert sorted(map(tuple, rows)) == [("d:a.com", 2), ("p:a.com/X", 0)]
