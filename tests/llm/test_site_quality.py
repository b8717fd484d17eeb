import math
from collections import defaultdict
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import queries
from spanloom.llm.site_quality import host_of, path_of, site_quality, text_of


def shrunk(groups, above):
    """Posteriors of groups {site: [p, ...]}, pulled to what is above them, as written down."""
    n = sum(map(len, groups.values()))
    within = sum(np.var(v) * len(v) for v in groups.values())
    between = sum(len(v) * (np.mean(v) - above[g]) ** 2 for g, v in groups.items())
    spread = n - sum(len(v) ** 2 for v in groups.values()) / n
    strength = 10.0
    if n > len(groups) and spread:
        each = within / (n - len(groups))
        strength = min(max(each / max((between - (len(groups) - 1) * each) / spread, 1e-6), 1.0), 1e4)
    return {g: (strength * above[g] + sum(v)) / (strength + len(v)) for g, v in groups.items()}


def check(rows):
    """rows: (host, path, result row) of all documents."""
    p = [1 / (1 + math.exp(-r.evidence)) for _, _, r in rows]
    prior = float(np.mean(p))
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, q, _), x in zip(rows, p):
        hosts[h].append(x)
        paths[h, q].append(x)
    of_host = shrunk(hosts, dict.fromkeys(hosts, prior))
    of_path = shrunk(paths, {g: of_host[g[0]] for g in paths})
    logit = lambda x: math.log(x / (1 - x))
    for h, q, r in rows:
        want = 1 / (1 + math.exp(-(r.evidence + logit(of_path[h, q]) - logit(prior))))
        assert abs(r.host_prior - of_host[h]) < 1e-6 and abs(r.path_prior - of_path[h, q]) < 1e-6 and abs(r.posterior - want) < 1e-6
        assert r.kept == (r.posterior >= 0.5) or abs(r.posterior - 0.5) < 1e-6
    return hosts, of_host, prior


def test_pages_by_host_and_path_equal_brute_force(spark):
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = queries.op7_site_quality_of_pages(spark, path).collect()
    assert len(got) == len(pages)
    host = lambda u: urlsplit(u).hostname.removeprefix("www.")
    rows = [(host(pages[r.page_id].url), urlsplit(pages[r.page_id].url).path.split("/")[1], r) for r in got]
    hosts, of_host, prior = check(rows)
    # hosts of few pages lie nearer to the prior than their own mean, those of many hardly
    assert min(map(len, hosts.values())) <= 3 and all(abs(of_host[h] - prior) <= abs(np.mean(v) - prior) + 1e-9 for h, v in hosts.items())


def test_addresses_and_texts(spark):
    rows = [("http://www.A.example.com:80/en/x?y#z",), ("https://u:p@b.org",), ("nothing",), (None,), ("https://c.net?q=/d/e",), ("http://d.net/one",)]
    df = spark.createDataFrame(rows, "url string")
    assert [tuple(r) for r in df.select(host_of(F.col("url")), path_of(F.col("url"))).collect()] == [("a.example.com", "en"), ("b.org", ""), (None, ""), (None, ""), ("c.net", ""), ("d.net", "one")]
    html = "<html><script>var a='</p>';</script><!-- <b>no</b> --><p class='x'>One <b>two</b></p><STYLE>p{}</STYLE>three"
    assert spark.createDataFrame([(html,)], "h string").select(text_of(F.col("h"))).first()[0].split() == ["One", "two", "three"]


def test_sparse_hosts_and_very_long_texts_equal_brute_force(spark):
    good, bad = "plain words of a text that goes on for a while and ends. " * 6, "BUY!! ### $$$ NOW!! ### $$$ BUY!! " * 9
    rows = [(k, bad if k % 3 == 0 else good, f"h{int(k**0.5)}", f"p{k % 2}", k % 3 > 0) for k in range(150)]
    rows += [(200 + k, good, f"alone{k}", "", True) for k in range(20)] + [(300, good * 3000, "long", "p", True), (301, "", None, None, True), (302, None, None, "x", True)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(r[0], int(r[4])) for r in rows[:150]], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality(docs, labels, F.col("host"), F.col("path")).collect()}
    check([(r[2], r[3], got[r[0]]) for r in rows])
    assert got[300].kept


def test_posteriors(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = site_quality(docs, labels, F.col("source"), F.col("lang"))
    n = {(r.quality, r.kept): r["count"] for r in got.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0)) and n.get((1, False), 0) <= 0.02 * n[1, True]
    assert got.count() == docs.count()


def test_sparse_sites_shrink_and_odd_rows(spark):
    good, bad = "plain words of a text that goes on for a while and ends. " * 6, "BUY!! ### $$$ NOW!! ### $$$ BUY!! " * 9
    rows, labels = [], []
    for k in range(400):
        junk = k % 4 == 0 if k < 200 else k % 40 == 0
        rows.append((k, bad if junk else good, "h1" if k < 200 else "h2", "p"))
        labels.append((k, 0 if junk else 1))
    rows += [(900, good, "tiny", "p"), (901, None, None, None), (902, "", "h1", None), (900, good, "tiny", "p"), (None, good, "h1", "q")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, host string, path string, evidence double")
    labelled = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    got = site_quality(docs, labelled, F.col("host"), F.col("path")).collect()
    assert len(got) == len(rows)
    prior = {r.doc_id: r.host_prior for r in got}
    mean = sum(prior[k] for k in range(400)) / 400
    assert prior[0] < prior[399] and abs(prior[900] - mean) < 0.2
    assert all(r.kept == (labels[r.doc_id][1] == 1) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert site_quality(docs.limit(0), labelled, F.col("host"), F.col("path")).count() == 0
    assert {r.evidence for r in site_quality(docs, labelled.limit(0), F.col("host"), F.col("path")).collect()} == {0.0}
