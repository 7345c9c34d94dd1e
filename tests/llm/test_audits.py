"""Periodic runs, source divergence and URL filters: brute force, SQL on odd tables, planted aliases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import periodic, queries, urlfilter
from lotlens.llm.divergence import source_divergence
from tests.conftest import DATA

# --- periodic runs ---


def plain_runs(w):
    n, out = len(w), set()
    for d in range(1, n // 3 + 1):
        i = 0
        while i + d < n:
            j = i
            while j + d < n and w[j] == w[j + d]:
                j += 1
            if (length := j - i + d) >= max(24, 3 * d):
                s = w[i : i + length]
                if next(q for q in range(1, d + 1) if s[q:] == s[: length - q]) == d:
                    out.add((i, length, d))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("section", [64, periodic.SECTION])
def test_runs_against_all_periods(monkeypatch, section):
    monkeypatch.setattr(periodic, "SECTION", section)
    rng, found = random.Random(section), 0
    for _ in range(400):
        n, k = rng.randrange(400), rng.choice([1, 2, 2, 3, 50])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 30 else 0):
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3 + 1))
            for i in range(a, rng.randrange(a, n + 1)):
                w[i] = w[a + (i - a) % p]
            w[rng.randrange(n)] = rng.randrange(k)
        got = periodic.periodic_runs(np.array(w, np.uint32))
        assert got == plain_runs(w)
        found += len(got)
    assert found > 100


def test_long_periodic_texts_take_linear_work():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert periodic.periodic_runs(np.zeros(50_000, np.uint32)) == [(0, 50_000, 1)]
    assert periodic.periodic_runs(np.arange(100_000, dtype=np.uint32) % 30_000) == [(0, 100_000, 30_000)]
    assert (0, 301, 100) in periodic.periodic_runs(np.array(([0] * 99 + [1]) * 3 + [0, 1] * 50, np.uint32))
    assert len(periodic.periodic_runs(np.array(b, np.uint32))) > 1000


def test_collapse_odd_tables(spark):
    words = " ".join(f"w{i % 9}" for i in range(40))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, words, "x"), (4, words, "x"), (5, "a " * 23, "x"), (6, "a\u00a0b " * 24, "x"), (None, "a " * 24, "x"), (7, "Wort ñ\n" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.collapse_runs(df).collect()), key=str)
    first = " ".join(f"w{i}" for i in range(9))
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 40, [(0, 40, 9)], first), (4, 40, [(0, 40, 9)], first), (5, 23, [], " ".join("a" * 23)),
        (6, 24, [(0, 24, 1)], "a\u00a0b"), (None, 24, [(0, 24, 1)], "a"), (7, 600_000, [(0, 600_000, 2)], "Wort ñ"),
    ], key=str)
    assert periodic.collapse_runs(df.limit(0)).count() == 0


def test_periodic_query_against_plain_python(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    assert set(rows) == set(docs)
    planted = 0
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        if n > 1500:
            continue  # all periods of a long text take too long here
        runs = plain_runs(w)
        kept = [x for j, x in enumerate(w) if not any(s + q <= j < s + length for s, length, q in runs)]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        r = rows[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        planted += bool(runs)
    assert planted >= 10


def test_strongest_compares_exactly(spark):
    runs = [{"start": s, "length": n, "period": p} for s, n, p in ((0, 30, 10), (40, 3_000_000_001, 1_000_000_000), (50, 60, 20), (60, 3_000_000_001, 1_000_000_000))]
    df = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and r[0]["start"] for r in df.select(periodic.strongest("runs")).collect()] == [40, None]


# --- source divergence ---


def divergence_by_sql(rows, keep=None):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    found = con.execute(queries.ORACLES["op12_source_divergence"]).fetchall()
    return sorted((tuple(r) for r in found), key=str)


def test_divergence_on_odd_documents(spark):
    rng = random.Random(7)
    words = ["the", "The", "THE", "ö", "Ö", "ñandú", "中文", "🙂", "a1b", "x-y", "\x00z\x7f", "''", "e\u0301"]
    rows = [(i % 90, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "en", "de", None]), rng.choice(["web", "books", "", None, "a|b"])) for i in range(400)]
    rows += [(1000 + i, None if i % 2 else "", "xx", f"s{i}") for i in range(3)] + [(None, "alone here", "yy", "one")] * 40 + [(2000, "the " * 200_000, "en", "web")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, term string")
    got = sorted((tuple(r) for r in source_divergence(df).collect()), key=str)
    assert got == divergence_by_sql(rows)
    assert {r[2] for r in got} == {"pair", "term"} and sum(r[0] == "xx" for r in got) == 6 and not any(r[0] == "yy" and r[2] == "pair" for r in got)
    assert source_divergence(df.limit(0)).count() == 0


def test_shares_beyond_a_long(spark):
    from lotlens.llm.divergence import share

    n, total, terms = 9_000_000_000_000_000, 9_100_000_000_000_007, 1_000_003
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# --- URL filters ---

HTML = '<html><head><link {}></head></html>'


def judged(spark, rows, redirects=None, schema="page_id long, url string, html string"):
    moved = spark.createDataFrame(redirects, "source string, target string") if redirects else None
    return {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, schema), moved).collect()}


def test_rules_and_addresses(spark):
    got = judged(spark, [
        (1, "http://A.Example.COM/en/1?x=/en/", None), (2, "https://www.example.com/en/", ""), (3, "https://m.www.example.com/en/a#b", ""), (4, "http://x.com", ""),
        (5, "https://a.net/es/q", ""), (6, "https://a.net/esq", ""), (7, "anet/fr/", ""), (8, None, None), (9, "https://notexample.com/en/", ""), (10, "x://b.net?u=http://c.net/fr/", ""), (11, "https://net/fr/\n1", ""),
    ])
    want = {1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
            4: ("x.com", "", None, "allow"), 5: ("a.net", "/es/q", "net/es/", "block"), 6: ("a.net", "/esq", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
            9: ("notexample.com", "/en/", "com/", "allow"), 10: ("b.net", "", None, "allow"), 11: ("net", "/fr/\n1", "net/fr/", "block")}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()} == want


def test_decisions_reach_aliases(spark):
    got = judged(spark, [
        (1, "https://a.net/es/1", ""), (2, "https://b.org/copy", HTML.format('rel="canonical" href="http://a.net/es/1?utm_source=x#top"')),
        (3, "https://c.org/x/", HTML.format("href=//b.org/copy rel='nofollow canonical'")), (4, "https://c.org/x?gclid=1", ""),
        (5, "https://d.org/", '<META HTTP-EQUIV=refresh CONTENT="0; URL=\'/go\'">'), (6, "https://d.org/go", ""), (7, "https://e.org/", ""),
        # an allowed member lifts the block from pages without a rule, a blocked one stays blocked
        (8, "https://f.net/fr/1", ""), (9, "https://ok.com/1", HTML.format('rel="canonical" href="https://f.net/fr/1"')), (10, "https://g.org/1", HTML.format('rel="canonical" href="https://ok.com/1"')),
        # links that don't count
        (11, "https://h.org/1", "<!-- " + HTML.format('rel="canonical" href="https://a.net/es/1"') + " --><script>'<link rel=canonical href=https://a.net/es/1>'</script><a rel=canonical href=https://a.net/es/1>x</a>"),
        (12, "https://i.org/1", HTML.format('rel="stylesheet" href="https://a.net/es/1"')), (13, "https://j.org/1", HTML.format('rel="canonical" href=""')),
    ], redirects=[("https://e.org/?utm_medium=m", "https://far.org/"), ("https://far.org", "https://d.org/go"), ("https://d.org/go", "https://a.net/es/1")])
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow"}


def test_long_chains_and_clashing_columns(spark):
    n = 40
    rows = [(i, f"https://s.org/{i}", HTML.format(f'rel="canonical" href="{i + 1}"'), "h", "v") for i in range(n)] + [(n, f"https://s.org/{n}", "x" * 2_000_000 + HTML.format('rel="canonical" href="https://a.net/fr/"'), "h", "v")] * 2
    got = judged(spark, [*rows, (n + 1, "https://a.net/fr/", None, "h", "v")], schema="page_id long, url string, html string, host string, node string")
    assert {r["verdict"] for r in got.values()} == {"block"} and got[3]["host"] == "s.org" and got[3]["node"] == "v" and "html" not in got[3]
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_query_with_planted_aliases(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    link = F.concat(F.lit('<link rel="canonical" href="https://other.example.net/es/'), (F.col("page_id") % 7).cast("string"), F.lit('">'))
    pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat(link, "html")).otherwise(F.col("html"))).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    planted = pages.select("page_id", F.lit("https://other.example.net/es/1").alias("url"), F.lit("").alias("html")).limit(1).withColumn("page_id", F.lit(-1).cast("long"))
    planted.write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op13_url_filters(spark, str(tmp_path)).select(*names).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op13_url_filters']})").fetchall(), key=str)
    assert any(r[3] is None and r[4] == "block" for r in got)
