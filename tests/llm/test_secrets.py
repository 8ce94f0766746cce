"""Base spans against Python's regular expressions; models on labelled strings."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from wattle.llm import secrets as S

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def brute_random(ts):
    """Added spans by plain loops: pair counts, smoothed models, pieces of runs, ratios."""
    token = set(S.ALPHABET) - {"."}
    runs = lambda t: [(m.start(), m.end()) for m in re.finditer(f"[{re.escape(''.join(sorted(token)))}]+", t)]
    values, ordinary = set(), []
    for t in ts:
        t = t or ""
        base = brute(t)
        values |= {m[1] for m in ASSIGN.finditer(t) if len(m[1]) >= 6} | {t[a:b] for a, k, b in base if k > 0}
        if not (ASSIGN.search(t) or re.search(r"AKIA[A-Z0-9]{16}", t) or re.search("[0-9a-f]{24}", t)):
            ordinary += [t[a:b] for a, b in runs(t) if 6 <= b - a <= 19]
    size = len(S.ALPHABET) + 1
    pairs = lambda v: [(S.ALPHABET.find(a) + 1, S.ALPHABET.find(b) + 1) for a, b in zip(v, v[1:])]

    def model(strings):
        n, total = {}, [size] * size
        for v in strings:
            for a, b in pairs(v):
                n[a, b] = n.get((a, b), 0) + 1
                total[a] += 1
        return lambda a, b: math.log((n.get((a, b), 0) + 1) / total[a])
    hot, cold = model(values), model(ordinary)
    odd = lambda v: len(v) >= 20 or len(v) >= 8 and any(not "a" <= c <= "z" for c in v[1:])
    out = []
    for t in ts:
        t, found = t or "", []
        taken = {p for a, _, b in brute(t) for p in range(a, b)}
        for a, b in runs(t):
            if not odd(t[a:b]):
                continue
            p = a
            while p < b:
                if p in taken:
                    p += 1
                    continue
                q = p
                while q < b and q not in taken:
                    q += 1
                ratio = sum(hot(*x) - cold(*x) for x in pairs(t[p:q]))
                if odd(t[p:q]) and ratio >= S.MIN_RATIO and ratio >= S.MIN_MEAN * (q - p - 1):
                    found.append((p, q))
                p = q
        out.append(found)
    return out


def texts():
    r = random.Random(9)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["ta", "ri", "on", "es", "ing", "the", "é", "𝛼", "stro"]) for _ in range(r.randint(1, 9)))
    bits = [lambda: f'token = "{hexa(40)}"', lambda: f"password={hexa(18)}", lambda: "AKIA" + upper(16), lambda: "AKIA" + upper(9),
            lambda: hexa(30), lambda: hexa(23), lambda: "password=token: abcdefgh", lambda: "API_KEY':  'x.y", lambda: "PassWd==abcde",
            lambda: "secret : short", lambda: "tokenapikey=" + upper(8), lambda: "AKIAAKIA" + upper(20), lambda: "secret=" + hexa(50)]
    out = [None, "", " ", "𝛼" * 50 + "password=abcdef" + "𝛼", hexa(24), "x" + hexa(24) + "g" + hexa(24), "password=" * 30 + "z"]
    for _ in range(120):
        out.append(" ".join(r.choice(bits)() if r.random() < 0.2 else word() for _ in range(r.randint(1, 60))))
    out.append(" ".join(r.choice(bits)() for _ in range(2000)))
    return out


def test_base_spans_match_python(frame):
    ts = texts()
    got = S.scan(frame(ts)).collect()
    names = S.NAMES
    assert len(got) == len(ts)
    for r in got:
        want = brute(ts[r.doc_id])
        base = [(s.start, s.kind_no, s.end) for s in r.spans if s.kind_no < 3]
        assert base == want, ts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        extra = [(s.start, s.end) for s in r.spans if s.kind == "random"]
        assert all(e <= a or b <= s for s, e in extra for a, _, b in want)
        assert [s.kind for s in r.spans] == [names[s.kind_no] for s in r.spans]
        assert [tuple(s)[:3] for s in r.spans] == sorted(tuple(s)[:3] for s in r.spans)


def test_models_tell_random_strings_from_identifiers(frame):
    r = random.Random(1)
    plain = ["the station ingredients thereof answering " * 5 + "internationalisationofthestations" for _ in range(50)]
    known = [f"password={''.join(r.choice('0123456789abcdefGHJKLmnpqrSTUVWX') for _ in range(30))} and so on" for _ in range(50)]
    secret = ["see " + "".join(r.choice("0123456789abcdefGHJKLmnpqrSTUVWX") for _ in range(40)) + " here" for _ in range(40)]
    clean = ["see thestationingredientsansweringthereof here" for _ in range(40)]
    got = {x.doc_id: x.n_random for x in S.scan(frame(plain + known + secret + clean)).collect()}
    assert sum(got[100 + i] for i in range(40)) >= 36
    assert sum(got[i] for i in [*range(50), *range(140, 180)]) == 0


def test_added_spans_match_a_plain_computation(frame):
    r = random.Random(4)
    al = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789"
    key = lambda n: "".join(r.choice(al) for _ in range(n))
    word = lambda: r.choice(["station", "ingredients", "well-known", "camelCase", "2024", "snake_case_name", "answering"])
    ts = [f"set password={key(30)} now" for _ in range(80)] + [" ".join(word() for _ in range(30)) for _ in range(60)]
    for _ in range(60):
        bits = [key(8), key(14), key(24) + "." + key(9), key(12) + "AKIA" + "Q7" * 10, "0f" * 13 + key(15) + "e1" * 14 + "xyz", word(), word(), "secret:" + key(9)]
        ts.append(" ".join(r.choice(bits) for _ in range(12)))
    ts += [None, "", key(20_000) + " " + "token=abcdef " * 3000]
    want = brute_random(ts)
    got = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == "random"] for x in S.scan(frame(ts)).collect()}
    assert [got[i] for i in range(len(ts))] == want
    spans = [(i, a, b) for i, w in enumerate(want) for a, b in w]
    assert any(b - a < 20 for _, a, b in spans) and any(b - a == 20_000 for _, a, b in spans)
    assert any(a and ts[i][a - 1] in S.ALPHABET for i, a, b in spans)                # the rest of a run


def test_span_list_empty_table_and_nothing_to_learn(frame):
    df = frame(["password=abcdef", None]).selectExpr("*", "1 AS row", "2 AS t", "3 AS hex")
    rows = S.scan(df).select("doc_id", S.span_list(F.col("spans")).alias("s")).collect()
    assert sorted((r.doc_id, r.s) for r in rows) == [(0, "assign:0:15"), (1, "")]
    assert [r.n_random for r in S.scan(frame(["nothing here " + "Zq9" * 20])).collect()] == [0]
    assert S.scan(df.limit(0)).collect() == []
