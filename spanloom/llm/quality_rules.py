"""Quality rules as a learned decision list (operator 3); Spark expressions only.

The statistics of a text are built-in array and string expressions on one row.  Rules are
learned by sequential covering from the statistics of labelled texts: a rule is a conjunction
of thresholds, grown on one part of the rows until it holds no good text, pruned on the
other, kept if it is precise enough there; the rows it covers go and the next is learned.
The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: A rule: (statistic, above?, threshold) of each condition.
Rule = tuple[tuple[str, bool, float], ...]
RATIOS = ("symbol_share", "repeat_share", "dup_line_share", "mean_word", "upper_share", "distinct_share", "shout_share", "line_words")


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPACE_RUN), lambda w: w != "")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of RATIOS.

    A null text has no words: all counts are 0, and so are the ratios.  Columns of docs with these
    names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    three = F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumn("_three", three)
    # windows found again, in order of place; each covers what the next doesn't of its three words
    ordered = F.array_sort(F.transform("_three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.transform(F.array(ordered), lambda s: F.array_sort(F.transform(F.filter(s, lambda e, k: (e.h == F.get(s, k - 1).h) | (e.h == F.get(s, k + 1).h)), lambda e: e.i)))
    covered = F.transform(again, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_three")) == F.size("_three"), 0).otherwise(F.get(covered, F.lit(0))).cast("long"),
        "_n_lines": F.size("_lines"),
        "_distinct": F.size(F.array_distinct("_words")),
        "_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "_shout": F.regexp_count(t, F.lit("!!")),
    }
    # one row from one row: unlike a projection, filters on the counts aren't pushed through it,
    # which would put the splitting into the expressions over each word
    df = df.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*counts, *RATIOS)], F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in counts.items()]))))
    of = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    ratios = {
        "symbol_share": of("n_symbols", "n_words"), "repeat_share": of("n_repeat_words", "n_words"), "dup_line_share": of("n_dup_lines", "_n_lines"), "mean_word": of("word_chars", "n_words"),
        "upper_share": of("_upper", "word_chars"), "distinct_share": of("_distinct", "n_words"), "shout_share": of("_shout", "n_words"), "line_words": of("n_words", "_n_lines"),
    }
    return df.withColumns(ratios).drop("_n_lines", "_distinct", "_upper", "_shout")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _mask(x: np.ndarray, rule: Sequence[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def cover(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, names: Sequence[str], bins: int = 32, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.95, least: int = 4) -> list[Rule]:
    """Rules for the rows of x marked bad.  fold: rows to grow on (True) and to prune on (False)."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    alive, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules and (alive & bad & fold).sum() >= least:
        rows = alive & fold
        rule: list[tuple[int, bool, float]] = []
        while len(rule) < most_conditions:
            inside = rows & _mask(x, rule)
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            if not p or not n:
                break
            best = (0.0, None)
            for j, each in enumerate(cuts):
                pos, neg = np.sort(x[inside & bad, j]), np.sort(x[inside & ~bad, j])
                for above in (True, False):
                    a, b = np.searchsorted(pos, each, "right"), np.searchsorted(neg, each, "right")
                    a, b = (p - a, n - b) if above else (a, b)
                    gain = a * (np.log2((a + 1e-9) / (a + b + 1e-9)) - np.log2(p / (p + n)))
                    k = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (j, above, float(each[k])))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break

        def value(r: list[tuple[int, bool, float]]) -> float:
            m = alive & ~fold & _mask(x, r)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=value)
        held, grown = alive & ~fold & _mask(x, rule), rows & _mask(x, rule)
        p, n = (held & bad).sum() + (grown & bad).sum(), (held & ~bad).sum() + (grown & ~bad).sum()
        if p < least or p < precision * (p + n) or value(rule) < 2 * precision - 1 - 0.05:
            break
        rules.append(tuple((names[j], above, cut) for j, above, cut in rule))
        alive &= ~_mask(x, rule)
    return rules


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000, key: str = "doc_id", text: str = "text", quality: str = "quality") -> list[Rule]:
    """Rules from at most ``most`` labelled documents: those with the least hashes of their keys.
    Labels: key and quality, 0 for bad; the least label of a key counts, null labels don't."""
    chosen = labels.filter(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(quality).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key").limit(most)  # so few rows fit a broadcast
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    rows = with_statistics(rows).filter(~base_failed()).select("_key", "_label", (F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(3)) > 0).alias("fold"), *RATIOS)
    got = sorted(map(tuple, rows.collect()))
    x = np.array([r[3:] for r in got], float).reshape(len(got), len(RATIOS))
    return cover(x, np.array([r[1] == 0 for r in got], bool), np.array([r[2] for r in got], bool), RATIOS)


def verdict(rules: list[Rule]) -> Column:
    """The list as an expression: false by the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, above, cut in rule:
            test &= F.col(name) > cut if above else F.col(name) <= cut
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = 20_000) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row of docs.

    A null text has no words and fails the base.  Rows are independent: repeated rows and null
    keys each give a row, an empty table gives none.  With no labelled texts, or with labels of
    one kind, the list is empty and the base decides alone.  Conditions of equal gain are taken in the order of
    statistics and thresholds.  Texts of any length are read whole.  Other columns are not read.
    """
    rules = learn(docs, labels, most, key, text)
    rows = with_statistics(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")))
    kept = ~F.col("base_failed") & verdict(rules)
    return rows.withColumn("base_failed", base_failed()).select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = 20_000) -> DataFrame:
    """The rows of docs, with their columns, that neither the base nor the learned list rejects."""
    rules = learn(docs, labels, most, key, text)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = with_statistics(docs.select(whole, F.col(text).alias("text"))).filter(~base_failed() & verdict(rules))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
