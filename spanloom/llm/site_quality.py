"""Quality classifier with hierarchical empirical Bayes over sites (operator 7).

A logistic model of a text's statistics, trained on a bounded labelled sample, gives each
document evidence.  Its mean over a host, and over a path of the host, is shrunk to
the level above with a strength estimated from all documents (between-group against
within-group variance, by moments).  A document's posterior is its evidence, moved by how
far the site's posterior is from the global prior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.quality_rules import RATIOS, with_statistics
from spanloom.llm.shared import cut, join_same

FEATURES = (*RATIOS, "n_words")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (bias last) by Newton steps on the penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) / len(x) - penalty * w)
    return w


def _features() -> list[Column]:
    return [F.log1p(F.greatest(F.col(c), F.lit(0)).cast("double") * (1 if c in ("n_words", "mean_word", "line_words") else 20)) for c in FEATURES]


def evidence(docs: DataFrame, labels: DataFrame, most: int, key: str, text: str, label: str) -> Column:
    """The log-odds of a good text as an expression over its statistics; 0 without labels of both kinds."""
    chosen = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label")).orderBy(F.xxhash64("_key"), "_key").limit(most)
    rows = with_statistics(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key"))
    got = sorted(map(tuple, rows.select("_label", *_features()).collect()))
    y = np.array([r[0] for r in got], float)
    if len(set(y)) < 2:
        return F.lit(0.0)
    x = np.array([r[1:] for r in got], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, (y > 0).astype(float))
    out = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
    for c, k in zip(_features(), w[:-1] / scale):
        out = out + c * float(k)
    return F.greatest(F.least(out, F.lit(12.0)), F.lit(-12.0))


def _strength(groups: DataFrame, parent: str) -> float:
    """How many documents the level above weighs, by moments: within-group over between-group variance."""
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("within").alias("within"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col(parent), 2)).alias("between"), (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("spread")).first()
    if not r.n or r.n <= r.k or not r.spread:
        return 10.0
    within = r.within / (r.n - r.k)
    between = max((r.between - (r.k - 1) * within) / r.spread, 1e-6)
    return float(min(max(within / between, 1.0), 1e4))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def host_of(url: Column) -> Column:
    """The host of an address in small letters, without a leading www. and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The first part of an address's path; '' where it has none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def text_of(html: Column) -> Column:
    """What is outside tags, scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: DataFrame | None = None, label_key: str | None = None, label_text: str | None = None) -> DataFrame:
    """``key, evidence, host_prior, path_prior, posterior, kept`` for each row of docs.

    most: labelled documents that the evidence is fitted on, those with the least hashes of
    their keys.  labelled: the table that labels belong to, where that isn't docs itself, with its key and text columns.
    A null host or path is a site of its own.  A null text has the statistics of an empty
    one; a text of any length is read whole, and a posterior of just a half is kept.  Repeated rows each count and give a row; an empty table gives none; without labels of
    both kinds all evidence is even.
    """
    fitted = evidence(docs if labelled is None else labelled, labels, most, label_key or key, label_text or text, label)
    rows = with_statistics(docs.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(text).alias("text")))
    rows = cut(rows.select("key", "host", "path", fitted.cast("double").alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))))
    sums = lambda by: rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.avg("p").alias("mean"), (F.var_pop("p") * F.count("*")).alias("within"))
    prior = float(rows.agg(F.avg("p")).first()[0] or 0.5)
    hosts = cut(sums(["host"]).withColumn("prior", F.lit(prior)))
    a = _strength(hosts, "prior")
    hosts = hosts.select("host", ((a * prior + F.col("s")) / (a + F.col("n"))).alias("host_prior"))
    paths = sums(["host", "path"])
    paths = cut(join_same(paths, hosts, ["host"]))
    b = _strength(paths, "host_prior")
    paths = paths.select("host", "path", "host_prior", ((b * F.col("host_prior") + F.col("s")) / (b + F.col("n"))).alias("path_prior"))
    both = join_same(rows, paths, ["host", "path"])
    moved = F.col("evidence") + _logit(F.col("path_prior")) - _logit(F.lit(prior))
    out = both.select(F.col("key").alias(key), "evidence", "host_prior", "path_prior", (1 / (1 + F.exp(-moved))).alias("posterior"))
    return out.withColumn("kept", F.col("posterior") >= 0.5)
