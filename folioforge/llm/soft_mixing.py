"""Mixing documents to target domain weights with soft memberships, in DataFrame functions only.

A table of labelled documents (doc_id, domain) trains the classifier: shrunken log odds of hashed words, counted over
labelled documents, tell each document's word evidence for every domain (its sum and its strongest word); with a few rates of
shape they go into a multinomial logistic regression, which gives every document posterior domain probabilities. The
regression is fitted on documents that did not count in the odds it is shown. Nonnegative rates are then fitted by
projected gradient steps on the least-squares distance between the expected domain token totals, sum of rate x tokens x
posterior, and the targets. The step's metric is the inverse Gram matrix of the documents with a positive rate (domains
x domains), so few rounds suffice. Each round is one aggregation over a narrow numeric table; only sums over all documents
come to the driver.

Bounds of the model, always of the smallest hashes of doc_id: ``ODDS_DOCS`` labelled documents for the odds, whose labels are
broadcast so that no text is shuffled; ``FIT_DOCS`` of them for the regression; and the ``WORDS`` words of the largest odds, 8 bytes
and two odds a domain each. Features, posteriors and rates cover all documents.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.storage import cut

#: Words of the model at most, the least number of labelled documents that hold one, and labelled documents for odds and regression, at most.
WORDS, LEAST_DOCS, ODDS_DOCS, FIT_DOCS = 1 << 16, 4, 1 << 18, 8_000
#: Weight of the prior share in a word's odds, in documents; odds nearer to 0 than ``STRONG`` tell nothing.
SHRINK, STRONG = 10.0, 0.5
#: Weight decay of the regression.
DECAY = 1e-4
ROUNDS, TOLERANCE = 50, 1e-4
SHAPE = ("s0", "s1", "s2", "s3")


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def _row_keys(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), F.struct(F.lit(0).alias("none_"), *keep).alias("kept"))


def word_odds(rows: DataFrame, known: DataFrame, domains: list[str]) -> DataFrame:
    """``word`` (64-bit hash) and odds ``w0, w1, ...`` of each domain from the rows of ``known`` documents (at most ``ODDS_DOCS``), ``h0, ...`` from one half of them.

    Odds of a word are log((n_d + SHRINK x prior_d) / (n + SHRINK) / prior_d), where n_d of the n labelled documents that hold it
    are of domain d; weak ones are 0. A row that repeats counts as often as it is there.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    held = rows.join(F.broadcast(known), "doc_id")
    count = lambda on: [F.count(F.when((F.col("domain") == d) & on, 1)) for d in domains]
    both = [c.alias(f"{k}{i}") for k, on in (("n", F.lit(True)), ("m", F.col("half") == 0)) for i, c in enumerate(count(on))]
    total = held.select("domain", half.alias("half")).agg(*both).first()
    held = held.select("domain", half.alias("half"), F.explode(_words(F.col("text"))).alias("word")).where("length(word) between 2 and 40")
    wide = held.groupBy(F.xxhash64("word").alias("word")).agg(*both).where(F.expr(" + ".join(f"n{i}" for i in range(len(domains)))) >= LEAST_DOCS)
    out = []
    for k, name in (("n", "w"), ("m", "h")):
        every = max(sum(total[f"{k}{i}"] for i in range(len(domains))), 1)
        here = sum((F.col(f"{k}{i}") for i in range(1, len(domains))), F.col(f"{k}0"))
        for i in range(len(domains)):
            prior = max(total[f"{k}{i}"], 0.5) / every
            odds = F.log((F.col(f"{k}{i}") + SHRINK * prior) / (here + SHRINK) / prior)
            out.append(F.when(F.abs(odds) >= STRONG, odds).otherwise(0.0).alias(f"{name}{i}"))
    top = F.greatest(*(F.abs(F.col(f"w{i}")) for i in range(len(domains))), F.lit(0.0))
    return wide.select("word", *out).withColumn("top", top).where("top > 0").orderBy(F.desc("top"), "word").limit(WORDS).drop("top")


def features(rows: DataFrame, odds: DataFrame, domains: int) -> DataFrame:
    """``doc_id, text_key, n_tokens``, shape rates and word evidence of every distinct (doc_id, text_key).

    Words meet the odds in a broadcast join of at most ``WORDS`` rows, and only hits go on. The empty word stands once in every row, so rows
    without hits stay and repeated rows are told by how often it is there.
    """
    chars = F.greatest(F.length("text"), F.lit(1))
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / chars
    tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    words = _words(F.col("text"))
    shape = [F.sqrt(share("[A-Z]")), F.sqrt(share(r"[#*$%&|!]")), F.size(words) / (tokens + 1), F.log1p(tokens)]
    base = rows.select("doc_id", "text_key", tokens.alias("n_tokens"), *(c.cast("double").alias(n) for c, n in zip(shape, SHAPE, strict=True)), words.alias("words"))
    # the empty word may already be there as what stands before the first letter
    every = base.withColumn("word", F.explode(F.array_append(F.array_remove("words", ""), ""))).drop("words")
    every = every.withColumn("word", F.when(F.col("word") != "", F.xxhash64("word")))
    hits = every.join(F.broadcast(odds), "word", "left").where("word is null or w0 is not null")
    one = F.count(F.when(F.col("word").isNull(), 1))
    evidence = []
    for k, name in (("w", "e"), ("h", "g")):
        for i in range(domains):
            evidence += [(F.coalesce(F.sum(f"{k}{i}"), F.lit(0.0)) / one).alias(f"{name}{i}s"), F.greatest(F.coalesce(F.max(f"{k}{i}"), F.lit(0.0)), F.lit(0.0)).alias(f"{name}{i}m")]
    return hits.groupBy("doc_id", "text_key").agg(F.first("n_tokens").alias("n_tokens"), *(F.first(c).alias(c) for c in SHAPE), *evidence)


def regression(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale, weights and offsets of a multinomial logistic regression with weight decay, by Newton's method with a step search."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, hot = np.zeros((z.shape[1], classes)), np.eye(classes)[y]

    def loss(w):
        s = z @ w
        s = s - s.max(axis=1, keepdims=True)
        return -((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) * hot).sum() / len(x) + DECAY * (w * w).sum()

    for _ in range(60):
        s = z @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = z.T @ (p - hot) / len(x) + 2 * DECAY * w
        h = np.zeros((w.size, w.size))
        for i in range(classes):
            for j in range(classes):
                v = p[:, i] * ((i == j) - p[:, j])
                h[i :: classes, j :: classes] = (z * v[:, None]).T @ z / len(x)
        step = np.linalg.solve(h + (2 * DECAY) * np.eye(w.size), g.reshape(-1)).reshape(w.shape)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return mean, scale, w[:-1], w[-1]


def posteriors(table: DataFrame, known: DataFrame, domains: list[str]) -> list[Column]:
    """Posterior probability columns, one for each domain, by a regression on labelled rows of the feature table."""
    labelled = table.join(known, "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)))
    got = []
    for half in (1, None):  # the half that did not count in the odds; all rows if it lacks a domain that has labels
        part = labelled if half is None else labelled.where(F.col("half") == half)
        got.append(part.orderBy(F.xxhash64("doc_id", "text_key"), "doc_id").limit(FIT_DOCS).collect())
        if half is None or {r["domain"] for r in got[0]} == {r[0] for r in known.join(table.select("doc_id"), "doc_id").select("domain").distinct().collect()}:
            break
    rows, name = got[-1], "g" if len(got) == 1 else "e"
    there = [d for d in domains if d in {r["domain"] for r in rows}]
    if not there:
        return [F.lit(1.0 / len(domains)) for _ in domains]
    inputs = [f"{i}{k}" for i in range(len(domains)) for k in "sm"]
    x = np.array([[*(r[c] for c in SHAPE), *(r[f"{name}{c}"] for c in inputs)] for r in rows])
    mean, scale, w, off = regression(x, np.array([there.index(r["domain"]) for r in rows]), len(there))
    logs = []
    for d in domains:
        if d not in there:
            logs.append(F.lit(-1e3))
            continue
        k, y = there.index(d), F.lit(float(off[there.index(d)]))
        for i, c in enumerate([*SHAPE, *(f"e{c}" for c in inputs)]):
            y = y + (F.col(c) - float(mean[i])) * float(w[i, k] / scale[i])
        logs.append(y)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(F.greatest(y - top, F.lit(-60.0))) for y in logs]
    return [w / sum(weights[1:], weights[0]) for w in weights]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], max_epochs: float | None = None, seed: int = 17, most_epochs: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, p_<domain>..., rate, copies``, then the columns ``keep`` of the input.

    ``weights`` are the wanted shares of tokens. The total is what makes the domain of the largest weight keep its tokens, so
    rates of scarce domains exceed 1; with ``max_epochs`` it is the largest total up to that for which no domain needs more than so
    many times the tokens that it is expected to hold (a domain of which the rows hold next to nothing, below a millionth of all
    tokens, can be met by no total and bounds none: a warning names it); all other shares are met either way. Only if asked for, a domain's target is at most ``most_epochs`` times the tokens that
    documents with a probability of half or more bring it, and once what others do; where that cuts a share, a
    warning tells the asked and the reached one, and the other domains' totals stay as they were. ``copies``
    rounds the rate up with a chance equal to its fraction, by a hash of doc_id and ``seed``.

    Null and empty texts have no tokens; they get a rate by their posterior and weigh nothing. A null doc_id is rounded
    by the hash of null. Repeated rows are mixed each; rows that share a doc_id are told apart by their texts. If the
    rounds end before the totals meet the targets, a warning tells asked and reached shares. Without labels all posteriors are equal. Labels of unknown
    domains, null labels and null doc_ids teach nothing; a doc_id labelled twice counts with its smallest domain.
    """
    domains = sorted(weights)
    known = labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    rows = _row_keys(docs, keep)
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ODDS_DOCS), "chosen")
    odds = cut(word_odds(rows.select("doc_id", "text"), chosen, domains), "odds")
    table = cut(features(rows, odds, len(domains)), "features")
    p = posteriors(table, known, domains)
    one = table.select("doc_id", "text_key", "n_tokens", *(x.alias(f"p_{d}") for x, d in zip(p, domains, strict=True)))
    mine = [rows[c].eqNullSafe(one[c]) for c in ("doc_id", "text_key")]
    soft = cut(rows.drop("text").join(one, mine[0] & mine[1]).select(rows["doc_id"], "n_tokens", *(f"p_{d}" for d in domains), "kept"), "posteriors")
    mass = [F.col("n_tokens") * F.col(f"p_{d}") for d in domains]
    likely = [F.sum(F.when(F.col(f"p_{d}") >= 0.5, m)) for d, m in zip(domains, mass, strict=True)]
    first = soft.agg(F.array(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in mass), *(F.coalesce(x, F.lit(0.0)) for x in likely)).alias("x")).first()["x"]
    held, sure = np.array(first[: len(domains)]), np.array(first[len(domains) :])
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    there = (share > 0) & (held > 1e-6 * held.sum())
    lead = np.where(there, share, 0.0).argmax()
    total = held[lead] / share[lead]
    if max_epochs is not None and there.any():
        total = min(total, (held[there] / share[there]).min() * max_epochs)
    for i in np.flatnonzero((share > 0) & ~there):
        logging.getLogger(__name__).warning("%s: asked a share of %.4g, but the rows hold nothing of it", domains[i], share[i])
    asked = np.where(there, share, 0.0) * total
    target = asked if most_epochs is None else np.minimum(asked, most_epochs * sure + held - sure)
    for i in np.flatnonzero(target < asked * (1 - TOLERANCE)):
        logging.getLogger(__name__).warning("%s: asked a share of %.4g, reached %.4g, as documents count %g times at most", domains[i], share[i], target[i] / max(target.sum(), 1.0), most_epochs)
    rate, scale = F.lit(1.0), max(float(held.sum()), 1.0)
    for turn in range(ROUNDS):
        live = F.when(rate > 0, 1.0).otherwise(0.0)
        sums = [F.sum(m * rate) for m in mass]
        gram = [F.sum(mass[i] * F.col(f"p_{domains[j]}") * live) for i in range(len(domains)) for j in range(i, len(domains))]
        got = soft.agg(F.array(*(F.coalesce(x, F.lit(0.0)) for x in sums + gram)).alias("x")).first()["x"]
        gap = (np.array(got[: len(domains)]) - target) / scale
        if np.abs(gap).max() < TOLERANCE:
            break
        if turn + 1 == ROUNDS:
            logging.getLogger(__name__).warning("targets not met after %d rounds: asked %s, reached %s", ROUNDS, dict(zip(domains, target, strict=True)), dict(zip(domains, got, strict=False)))
            break
        g, at = np.zeros((len(domains),) * 2), len(domains)
        for i in range(len(domains)):
            for j in range(i, len(domains)):
                g[i, j] = g[j, i] = got[at] / scale
                at += 1
        step = np.linalg.solve(g + 1e-9 * np.eye(len(domains)), gap)
        move = sum((F.col(f"p_{d}") * float(s) for d, s in zip(domains[1:], step[1:], strict=True)), F.col(f"p_{domains[0]}") * float(step[0]))
        rate = F.greatest(F.lit(0.0), rate - move)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    out = soft.withColumn("rate", rate)
    out = out.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
    return out.select(*(c for c in out.columns if c != "kept"), *(F.col("kept")[c].alias(c) for c in keep if c != "doc_id"))
