"""URL filter against plain regular expressions and the rules spelled out."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from wattle.llm import url_filter as U


def regex(glob):
    wild = {"*": "[^/]*", "**": ".*", "?": "[^/]"}
    return re.compile("".join(wild.get(p, re.escape(p[1:])) for p in U.parse(glob)), re.S)


def batch(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)


def first(globs, texts):
    rs = [regex(g) for g in globs]
    return [next((i for i, r in enumerate(rs) if r.fullmatch(t)), -1) for t in texts]


def test_automaton_equals_regular_expressions():
    r = random.Random(3)
    piece = lambda: r.choice(["a", "b", "ab", "/", ".", "é", "東", "?", "*", "**", "***", "\\*", "\\?", "\\\\", "a?b", "*/"])
    texts = ["".join(r.choice(["a", "b", "/", ".", "é", "東", "*", "?", "\\", "\n"]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    for _ in range(30):
        globs = ["".join(piece() for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 40))]
        assert U.Automaton(globs).first_match(*batch(texts)).tolist() == first(globs, texts)


def test_globs_longer_than_a_word_of_the_mask():
    globs = ["x" * 63 + "y", "x" * 64 + "*", "**" + "z" * 130 + "?", "x" * 200]
    texts = ["x" * 63 + "y", "x" * 64, "x" * 63, "x" * 200, "x" * 199 + "/", "q/" + "z" * 131, "z" * 130, ""]
    assert U.Automaton(globs).first_match(*batch(texts)).tolist() == first(globs, texts)
    assert U.Automaton([]).first_match(*batch(texts)).tolist() == [-1] * 8
    assert len(U.Automaton(globs).first_match(*batch([]))) == 0


def plain(url):
    """Host, path, rule and verdict as the contract words them."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        rest = rest[n:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    text = "." + host + path if host or path else ""
    hit = [g for g in U.GLOBS if regex(g.glob).fullmatch(text)]
    return host, path, None, max(hit, key=lambda g: U.plain_length(g.glob)).verdict if hit else "allow"


URLS = [None, "", "no scheme", "http://", "http:///x", "https://COM/", "https://com", "https://a.com?x=/en/", "https://x.com#/", "HTTP://Example.COM/en/1",
        "http://example.com/en", "http://example.com/En/1", "http://www.example.com/en/1", "http://a.www.example.com/en/1?q", "http://wwwexample.com/en/1",
        "http://www.example.com/fr/", "http://net/es/", "http://a.net/es/é", "http://a.net/fr", "http://a.b.net/fr/#x", "http://evil.org/net/es/",
        "http://evil.org/x.com/", "http://É.com/", "http://user@casino.org:80/en", "http://my-pills.org", "http://x.org/a.zip", "http://x.org/a.mp3?x",
        "http://x.org/LOGIN", "http://x.org/login", "http://x://y/z", "http://a\nb.org/\n.exe", "http://x.org/" + "a" * 30000 + ".png", "http://x.org/" + "é" * 50000]


def test_query_rules_and_cases(spark):
    df = spark.createDataFrame([(i, u, "h", 1, 2) for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, host string, k int, rule int").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS + URLS[:5])}
    kept = U.keep_allowed(df)
    assert kept.columns == df.columns
    assert sorted(r.page_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[3] == "allow")
    assert U.filter_urls(df.limit(0)).collect() == []
    assert {(r.rule, r.glob, r.verdict) for r in U.filter_urls(df, rules=(), globs=(), default="block").collect()} == {(None, None, "block")}


@pytest.mark.parametrize("order", [0, 1])
def test_longest_rule_wins_whatever_the_order(spark, order):
    rules = list(U.RULES)[::-1] if order else list(U.RULES)
    df = spark.createDataFrame([(1, "http://www.example.com/en/x"), (2, "http://b.example.com/en/x"), (3, "http://b.example.com/")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in U.filter_urls(df, rules=rules).collect()) == [(1, "allow"), (2, "block"), (3, "allow")]


def test_long_url_takes_linear_time():
    import time

    a = U.Automaton([t.glob for t in U.precedence(U.RULES, U.GLOBS)])
    t = time.perf_counter()
    assert a.first_match(*batch([".x.org/" + "a" * 300_000 + ".png"]))[0] >= 0
    assert time.perf_counter() - t < 20
