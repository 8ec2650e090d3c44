from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from tempora.llm import queries, urls
from tests.llm import cases

SCHEMA = "page_id long, url string, html string"


def judged(spark, addresses, rules=queries.RULES):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(addresses)], SCHEMA).selectExpr("*", "'x' as host", "1 as score", "2 as rule", "3 as good")
    return {r["page_id"]: r for r in urls.judge(pages, rules).collect()}


def test_parts_and_rules(spark):
    expected = {
        "HTTP://WWW.Example.ORG/es/1?q": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/123#x": ("example.org", "/en/123", "example.org/en/1", "block"),
        "http://a.example.org/en/2": ("a.example.org", "/en/2", "org/", "allow"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "http://a.com/de/x?/fr/": ("a.com", "/de/x", "com/de/", "block"),
        "http://a.org?x": ("a.org", "", None, None),
        "http://a.net/": ("a.net", "/", None, None),
        "no scheme": ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "http://": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    got = judged(spark, list(expected))
    for i, (host, path, rule, verdict) in enumerate(expected.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_nothing_to_learn_from_allows(spark):
    assert {r["verdict"] for r in judged(spark, ["http://a.net/", None, "http://a.net/"]).values()} == {"allow"}
    assert judged(spark, []) == {}


def brute(addresses):
    """Log ratio per character of every distinct URL, out of plain counts."""
    import hashlib

    def padded(u):
        rest = u.split("://", 1)[1] if "://" in u else ""
        table = str.maketrans(urls.UPPER + "123456789", urls.LOWER + "0" * 9)
        return "^" * urls.ORDER + rest.translate(table) + "$"

    side = {}
    for u, (good, bad) in addresses.items():
        if int(hashlib.md5(u.encode()).hexdigest()[:4], 16) % 5:
            side[u] = "good" if good else "bad" if bad else None
    counts = {s: defaultdict(Counter) for s in ("good", "bad")}
    for u, s in side.items():
        if s:
            t = padded(u)
            for i in range(urls.ORDER, len(t)):
                for o in range(urls.ORDER + 1):
                    counts[s][t[i - o : i]][t[i]] += 1

    def p(s, context, x):
        below = p(s, context[1:], x) if context else 1 / urls.ALPHABET
        seen = counts[s][context]
        n = sum(seen.values())
        return (seen[x] + len(seen) * below) / (n + len(seen)) if n >= urls.MIN_SEEN else below

    out = {}
    for u in addresses:
        t = padded(u)
        ratios = [math.log(p("good", t[i - 3 : i], t[i])) - math.log(p("bad", t[i - 3 : i], t[i])) for i in range(3, len(t))]
        out[u] = sum(ratios) / len(ratios)
    return out


def test_scores_match_brute_force(spark):
    rnd = random.Random(3)
    made = []
    for _ in range(120):
        host = rnd.choice(["www.", "", "m."]) + "".join(rnd.choices("abcdé", k=4)) + rnd.choice([".org", ".com", ".net", ".casino.net"])
        made.append(f"http://{host}/{rnd.choice(['en', 'fr', 'de', 'ES'])}/{rnd.randrange(2000)}{rnd.choice(['', '?x=1', '#T'])}")
    made += made[:10] + ["", "x"]
    got = judged(spark, made)
    sides = {}
    for r in got.values():
        ruled = r["rule"] and r["verdict"]
        sides[r["url"]] = (ruled == "allow", ruled == "block")
    expected = brute(sides)
    for r in got.values():
        assert abs(r["score"] - expected[r["url"]]) < 1e-7
    open_ = [r for r in got.values() if r["rule"] is None]
    allowed, blocked = ([r["score"] for r in open_ if r["verdict"] == v] for v in ("allow", "block"))
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_unruled_urls_follow_what_they_look_like(spark):
    good = [f"http://library{i}.org/en/paper-{i}" for i in range(80)]
    bad = [f"http://win-casino{i}.com/de/slots/bonus-{i}" for i in range(80)]
    got = judged(spark, [*good, *bad, "http://library.net/en/paper-7", "http://supercasino.net/slots/bonus"])
    assert [got[i]["verdict"] for i in (160, 161)] == ["allow", "block"]
    assert {got[i]["verdict"] for i in range(80, 160)} == {"block"}


def test_long_urls_are_judged_whole(spark):
    long = "http://a.net/" + "ab" * 30_000
    assert judged(spark, [long, "http://b.org/", "http://c.com/de/"])[0]["path"] == long[12:]


def test_repeated_rows_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", ""), (1, "http://a.net/", ""), (None, None, None)], SCHEMA)
    assert len(cases.rows_of(urls.judge(pages, queries.RULES))) == 3


def test_columns_of_clashing_names(spark):
    addresses = ["http://a.org/x", "http://a.com/de/y", "http://b.net/z", None]
    names = ["id", "bad", "action", "verdict", "path", "text", "gram", "at", "ratio", "total", "n", "kept_out", "listed", "key", "context"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(addresses)], SCHEMA)
    plain = urls.judge(pages, queries.RULES).select("page_id", "verdict", "score")
    own = urls.judge(pages.selectExpr("*", *[f"'own' as {n}" for n in names]), queries.RULES).select("page_id", "verdict", "score")
    assert cases.rows_of(own) == cases.rows_of(plain)


def test_query_learns_from_rejected_hosts(spark, tmp_path):
    """No block rule decides any of these: only the words in their hosts tell what is rejected."""
    good = [f"http://library{i}.org/en/paper-{i}" for i in range(80)]
    bad = [f"http://win-casino{i}.{end}/slots/bonus-{i}" for i in range(80) for end in ("net", "org")]
    asked = ["http://library.net/en/paper-7", "http://supercasino.net/slots/bonus", "http://a.casino.net/slots/bonus"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*good, *bad, *asked])], SCHEMA)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in (240, 241, 242)] == ["allow", "block", "block"]
    assert {got[i] for i in range(80, 240, 2)} == {"block"}  # nothing but the model decides
    assert {got[i] for i in range(81, 240, 2)} == {"allow"}  # rejected examples, but a rule decides
