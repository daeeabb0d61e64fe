"""Rules and models against a plain version, and against the SQL text."""

import math
import os
from collections import Counter

import duckdb
import pytest

from spanforge.llm import url_filter as F
from spanforge.llm.queries import URL_RULES

URLS = [
    "http://a.org/x", "https://Example.ORG/es/1?q=/de/", "http://x.example.org/en/12#t", "http://notexample.org/es/1", "http://org", "ftp://b.com/fr/1",
    "http://b.com/de/", "http://b.com/den", "nothing", "", None, "://", "http://?a", "http://b.net/en/1", "http://c.net/fr/22", "http://é.net/ü",
    "http://b.net/" + "long/" * 3000, "http://a.org/x", "x://y://z.org/a", "http://org/", "http://myorg/x",
]


def rule_of(host, path):
    fits = [(len(t), t, v) for v, t in URL_RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]


def brute(rows):
    """Verdicts from the definition, one character at a time."""
    judged = [(i, *split(u)) for i, u in rows]
    judged = [(i, h, p, *rule_of(h, p)) for i, h, p in judged]
    grams, followers = Counter(), {}
    for i, h, p, r, v in judged:
        if r and (i or 0) % 5 and i is not None:
            t = F.BEGIN * 3 + h + p + F.END
            for at in range(3, len(t)):
                for k in range(4):
                    grams[v, t[at - k : at + 1]] += 1
    total = {v: sum(n for (w, g), n in grams.items() if w == v and len(g) == 1) for v in ("allow", "block")}
    kinds = len({g for _, g in grams if len(g) == 1})
    for (v, g), n in grams.items():
        followers.setdefault((v, g[:-1]), []).append(n)
    seen = {g for _, g in grams}

    def prob(v, g):
        """As interpolated along kept sequences only."""
        c = grams[v, g]
        if len(g) == 1:
            return (c + 0.5) / (total[v] + 0.5 * (kinds + 1))
        after = followers.get((v, g[:-1]), [])
        low = prob(v, g[1:])
        return (c + len(after) * low) / (sum(after) + len(after)) if after else low

    def back(v, c):
        after = followers.get((v, c), [])
        return len(after) / (sum(after) + len(after)) if after else 1.0

    milli = lambda x: int(math.copysign(math.floor(abs(math.log(x) * 1000) + 0.5), math.log(x)))
    contexts = {g[:-1] for g in seen if len(g) > 1}

    def ratio(h, p):
        t, out = F.BEGIN * 3 + h + p + F.END, 0
        for at in range(3, len(t)):
            for k in range(3, -1, -1):
                g = t[at - k : at + 1]
                if g in seen:
                    out += milli(prob("allow", g) / prob("block", g))
                    break
                if k and g[:-1] in contexts:
                    out += milli(back("allow", g[:-1]) / back("block", g[:-1]))
            else:
                out += milli((0.5 / (total["allow"] + 0.5 * (kinds + 1))) / (0.5 / (total["block"] + 0.5 * (kinds + 1))))
        return math.floor(out / (len(t) - 3))

    scored = [(i, h, p, r, v, ratio(h, p)) for i, h, p, r, v in judged]
    tuned = [(x, v) for i, _, _, r, v, x in scored if r and (i is None or i % 5 == 0)]
    good, bad = sum(v == "allow" for _, v in tuned), sum(v == "block" for _, v in tuned)
    least = 0
    if good and bad:
        def value(cut):
            return sum(v == "allow" and x >= cut for x, v in tuned) * bad + sum(v == "block" and x < cut for x, v in tuned) * good

        least = min({x for x, _ in tuned}, key=lambda c: (-value(c), abs(c), c))
    return sorted(((i, h, p, r, v or ("allow" if x >= least else "block"), x) for i, h, p, r, v, x in scored), key=str)


@pytest.mark.parametrize("case", ["mixed", "one_class", "empty"])
def test_equals_plain_version(spark, case):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[0]), (3, URLS[0])]
    if case != "mixed":
        rows = [] if case == "empty" else [r for r in rows if rule_of(*split(r[1]))[1] != "block"]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in rows], "page_id long, url string, host string, rule string, id int")
    got = F.judge_urls(pages, URL_RULES).collect()
    if case == "one_class":
        assert len(got) == len(rows)
    else:
        assert sorted([tuple(r) for r in got], key=str) == brute(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="shared tables not present")
def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    want = con.execute(F.judge_sql(URL_RULES)).fetchall()
    got = F.judge_urls(spark.read.parquet(path), URL_RULES)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)


def test_sequences_below_the_share_are_left_out(spark):
    pages = spark.createDataFrame([(i, f"http://{'b.com/de' if i % 3 else 'a.org'}/{i}") for i in range(200)], "page_id long, url string")
    few = F.judge_urls(pages, URL_RULES, share=50)
    assert few.count() == 200


def test_no_python_on_executors(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    plan = F.judge_urls(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
