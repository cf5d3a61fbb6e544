"""Quality classifier: evidence of the text, shrunk into what is known of its host and path.

1. Features of each text, in one row's SQL expressions.
2. Logistic regression on a bounded sample of labelled documents gives each document the odds its text alone speaks for.
3. Counts, sums and sums of squares of that evidence by path and by host, taken before anything is shuffled, give posteriors: a
   host's mean is shrunk towards the mean of all, a path's towards its host's. How hard is estimated from how far hosts (paths) differ
   beyond what the scatter of documents within them explains, so a site with few documents says little and a hot one speaks for itself.
4. A document's odds are its text's times what its path's posterior adds to the mean of all. Its own evidence is taken out of its path's
   and its host's sums first, so no document is its own witness.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, DIGITS, MARKS, SPACE, SYMBOLS, cut, held, whole_row

#: About so many labelled documents at most are gathered to fit the classifier: a bound on the driver's memory, not on what is scored.
TRAIN_ROWS = 20_000
RIDGE, ROUNDS, THRESHOLD, SITE_WEIGHT = 1e-3, 25, 0.5, 0.5
FEATURES = ["symbols", "capitals", "marks", "digits", "dup_lines", "stutter", "distinct", "log_words", "word_len", "distinct_by_length", "dup_lines_any"]
#: The prior's weight where there are too few groups or documents to estimate it from.
ALONE = 100.0
RESULT = ["p_text", "p_path", "p_quality", "accepted"]


def featured(docs: DataFrame, text: F.Column, keep: dict[str, F.Column]) -> DataFrame:
    """The columns `keep` and the features `f_*`, each finite and of the order of 1."""
    d = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.expr(r"transform(filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"))
    d = d.withColumn("_l", F.expr(r"filter(split(_t, '\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))"))
    d = d.select(
        *keep,
        F.size("_w").alias("_n"),
        F.greatest(F.length(F.regexp_replace("_t", SPACE, "")), F.lit(1)).alias("_c"),
        F.size(F.array_distinct("_w")).alias("_d"),
        F.expr("size(filter(_w, (x, k) -> k > 0 and x = _w[greatest(k - 1, 0)]))").alias("_s"),
        F.size("_l").alias("_nl"),
        F.size(F.array_distinct("_l")).alias("_dl"),
        held("_t", SYMBOLS).alias("_sym"),
        held("_t", CAPITALS).alias("_cap"),
        held("_t", MARKS).alias("_mark"),
        held("_t", DIGITS).alias("_dig"),
    )
    words = F.greatest("_n", F.lit(1))
    by = {
        "symbols": F.col("_sym") / F.col("_c"),
        "capitals": F.col("_cap") / F.col("_c"),
        "marks": F.col("_mark") / F.col("_c"),
        "digits": F.col("_dig") / F.col("_c"),
        "dup_lines": (F.col("_nl") - F.col("_dl")) / F.greatest("_nl", F.lit(1)),
        "stutter": F.col("_s") / words,
        "distinct": F.col("_d") / words,
        "log_words": F.log1p("_n") / 10,
        "word_len": F.least(F.col("_c") / words, F.lit(50)) / 10,
        "distinct_by_length": (F.col("_d") / words) * F.log1p("_n") / 10,
        "dup_lines_any": F.when(F.col("_nl") > F.col("_dl"), 1.0).otherwise(0.0),
    }
    return d.select(*keep, *[by[f].cast("double").alias(f"f_{f}") for f in FEATURES])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton's method on standardised features; given back for raw ones."""
    if not len(x):
        return np.zeros(len(FEATURES) + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], RIDGE * len(x))
    penalty[-1] = 1e-9 * len(x)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def train(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fit on about `rows` of the labelled documents, or all if there are fewer: those whose ids' hashes fall into the share that `rows` is of all labels."""
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    n = given.count()
    if n > rows:
        given = given.where(F.expr(f"pmod(xxhash64(_id), {1 << 30}) < {(rows << 30) // n}"))
    sample = (
        given.join(marked.select("_id", *[f"f_{f}" for f in FEATURES]), "_id")
        .select("_y", *[f"f_{f}" for f in FEATURES]).toPandas()
    )
    return fit(sample[[f"f_{f}" for f in FEATURES]].to_numpy(float), sample["_y"].to_numpy(float))


def strength(groups: DataFrame, towards: F.Column) -> float:
    """How many documents the prior counts for: variance within groups over variance between them (n, s, q: documents, their sum and sum of squares)."""
    m = groups.agg(
        F.sum("n"), F.count("*"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - towards) ** 2), F.sum(F.col("n") * F.col("n")),
    ).first()
    if not m[0] or m[1] < 2 or m[0] <= m[1]:
        return ALONE
    within, free = max(m[2], 0.0) / (m[0] - m[1]), m[0] - m[4] / m[0]
    between = (m[3] - (m[1] - 1) * within) / free if free > 0 else 0.0
    return min(max(within / between, 1.0), 1e6) if between > 0 else 1e6


def quality_classes(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    *, keep: list[str] | None = None, threshold: float = THRESHOLD, site_weight: float = SITE_WEIGHT, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """The columns `keep` of docs (all unless given) with p_text, p_path, p_quality (0 to 1) and accepted (p_quality >= threshold).

    A path is a pair of host_col and path_col; nulls are a host (path) of their own. p_path is the path's posterior without the document
    itself, so for a site's only document it is the mean of all; it enters the odds with the power site_weight.
    A null text is an empty one. Labels with nulls are left out; of several for an id the largest holds; without any, all texts have even odds.
    Repeated rows count, and come back, as often as they occur. Columns of docs named like a result are replaced. An empty table gives an empty result.
    """
    row = whole_row(docs, keep, RESULT)
    host, path = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in (host_col, path_col))
    marked = cut(featured(docs, F.col(f"`{text_col}`"), {"_row": row, "_id": F.col(f"`{id_col}`"), "_host": host, "_path": path}), "quality-model")
    w = train(marked, labels, id_col, rows=train_rows)
    logit = F.lit(float(w[-1]))
    for f, x in zip(FEATURES, w, strict=False):
        logit = logit + F.col(f"f_{f}") * F.lit(float(x))
    scored = marked.withColumn("p_text", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))))
    sums = lambda *more: [F.sum(c).alias(a) for c, a in more]
    paths = cut(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), *sums(("p_text", "s"), (F.col("p_text") * F.col("p_text"), "q"))), "paths")
    hosts = cut(paths.groupBy("_host").agg(*sums(("n", "n"), ("s", "s"), ("q", "q"))), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    share = min(max(total[1] / total[0], 1e-6), 1 - 1e-6) if total[0] else 0.5
    k_host = strength(hosts, F.lit(share))
    named = hosts.select("_host", F.col("n").alias("_hn"), F.col("s").alias("_hs"))
    both = paths.join(named, "_host")
    k_path = strength(both, (F.col("_hs") + F.lit(k_host * share)) / (F.col("_hn") + F.lit(k_host)))
    # Written, so its size is known: Spark broadcasts it below its threshold, and else splits a hot site's rows over tasks.
    known = cut(both.select("_host", "_path", F.col("n").alias("_pn"), F.col("s").alias("_ps"), "_hn", "_hs"), "posteriors")
    # Without the document's own evidence; rounding may leave a sum a little below zero.
    rest = lambda x: F.greatest(F.col(x) - F.col("p_text"), F.lit(0.0))
    p_host = (rest("_hs") + F.lit(k_host * share)) / (F.col("_hn") - 1 + F.lit(k_host))
    p_path = (rest("_ps") + F.lit(k_path) * p_host) / (F.col("_pn") - 1 + F.lit(k_path))
    safe = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = lambda c: F.log(safe(c) / (1 - safe(c)))
    total_logit = odds(F.col("p_text")) + F.lit(site_weight) * (odds(F.col("p_path")) - F.lit(float(np.log(share / (1 - share)))))
    return (
        scored.join(known, ["_host", "_path"], "left")
        .withColumn("p_path", p_path)
        .withColumn("p_quality", 1 / (1 + F.exp(-total_logit)))
        .withColumn("accepted", F.col("p_quality") >= threshold)
        .select("_row.*", *RESULT)
    )
