"""Toxicity by weak supervision.

1. Features of a text are its words and their prefixes of 4 to 8 bytes (lower-cased, punctuation stripped), hashed.  Their counts in toxic and clean
   rows are summed in Spark over all labelled rows that may be learned from.
2. Voters: the features that speak most for label 1 are dealt by strength into
   lexicons of words and of prefixes, those that speak for label 0 form clean lexicons, and
   pattern voters look at how many distinct toxic features a text holds.  Each
   voter says toxic, clean or abstains.
3. A generative label model is fitted to the votes of all rows (only the counts
   of vote patterns leave Spark: at most 3**voters): expectation maximisation
   estimates each voter's accuracy and the correlations of voters: given the label,
   each voter may depend on one other, along the tree of pairs that tell most about
   each other beyond what the label explains.
4. A linear classifier over the lexicon features is trained on the posterior
   labels of a bounded sample (``fit_rows``) and scores every whole text.  It is
   solved to convergence on rows in an order of their own, so the same table
   gives the same scores however it is partitioned.  Two numbers, a slope and a
   shift of the log odds, are then set by the labels of these rows, so that a
   score says how likely the label is.

Labels, lang, source and doc_id never enter a score.  Rows whose
crc32(doc_id as text) mod 4 is 2 are held out of everything learned from labels.

``lexicon_size`` bounds the features of each kind (words, prefixes, clean ones) that
voters and classifier know, as the classifier is solved on the driver; those that
speak most go in.  A text without any of them has the score of the bias.

Edge cases: null and empty texts are scored by the bias alone; no labels give
the prior 0.5 to no row (score 0); very long texts are read whole; ties between
features are broken by their hash; repeated rows are scored alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, narrow, table
from sparkloom.llm.text import PUNCT, Words, blocks, gather, hash_ranges, mix

PREFIXES = (4, 5, 6, 7, 8)
WORD_LEXICONS, PREFIX_LEXICONS, CLEAN_LEXICONS = 3, 3, 2
LEXICON_SIZE = 1500
FIT_ROWS = 40_000
THRESHOLD = 0.3
#: Weight of the squared weights in the classifier's loss per row.
L2 = 3e-4
#: Log odds from which a feature belongs to the first, second or else the last lexicon of its kind.
TIERS = (4.5, 2.5)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a block, ordered by row; bit 0 of a feature tells words from prefixes."""
    length = w.end - w.start
    one = np.uint64(1)
    rows, keys = [w.row], [w.key | one]
    for k in PREFIXES:
        own = length > k
        keys.append(mix(hash_ranges(w.data, w.start[own], w.start[own] + k) + np.uint64(k)) & ~one)
        rows.append(w.row[own])
    row, key = np.concatenate(rows), np.concatenate(keys)
    return row, key


@dataclass
class Model:
    """keys: sorted lexicon features; voter: of each; weight: of each, in the classifier; what the votes weigh."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    voter: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0
    posterior: dict[int, float] = field(default_factory=dict)


def _counts(batches):
    """Of (text, toxic): how many toxic and clean rows hold each feature."""
    held: dict[str, list] = {"k": [], "p": [], "n": []}

    def merged():
        k, inv = np.unique(np.concatenate(held["k"]), return_inverse=True)
        return {"k": [k], "p": [np.bincount(inv, np.concatenate(held["p"]), len(k))], "n": [np.bincount(inv, np.concatenate(held["n"]), len(k))]}

    size = 0
    for batch in batches:
        texts, toxic = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        for at, n in blocks(texts):
            row, key = features(Words(texts.slice(at, n), PUNCT, fold=True))
            _, first = np.unique(key ^ mix(row.astype(np.uint64) + np.uint64(11)), return_index=True)  # distinct by row
            y = toxic[at + row[first]]
            k, inv = np.unique(key[first], return_inverse=True)
            held["k"].append(k)
            held["p"].append(np.bincount(inv, y == 1, len(k)))
            held["n"].append(np.bincount(inv, y != 1, len(k)))
            size += len(k)
            if size > 800_000:
                held = merged()
                size = len(held["k"][0])
                if size > 400_000:
                    yield _batch(held)
                    held, size = {"k": [], "p": [], "n": []}, 0
    if held["k"]:
        yield _batch(merged())


def _batch(held):
    return pa.RecordBatch.from_arrays(
        [pa.array(held["k"][0].view(np.int64)), pa.array(held["p"][0].astype(np.int64)), pa.array(held["n"][0].astype(np.int64))], names=["k", "p", "n"]
    )


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def lexicons(labelled: DataFrame, size: int = LEXICON_SIZE) -> Model:
    """The voters' features, from the counts over all of labelled(text, toxic)."""
    rows = labelled.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    pos, neg = rows["p"] or 0, (rows["n"] or 0) - (rows["p"] or 0)
    if not pos or not neg:
        return Model()
    counts = labelled.mapInArrow(_counts, "k long, p long, n long").groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rate = lambda c, of: (F.col(c) + 0.5) / (of + 1.0)
    lift = F.log(rate("p", pos) / rate("n", neg))
    # how far above chance: a feature must both occur and lean
    z = (F.col("p") / pos - F.col("n") / neg) / F.sqrt((F.col("p") + F.col("n") + 1.0) / (pos + neg) * (1.0 / pos + 1.0 / neg))
    counts = materialize(counts.where("p + n >= 3").select("k", "p", "n", lift.alias("lift"), z.alias("z")).where("abs(z) > 4 AND (lift > 1.2 OR lift < -0.7)"))
    isword = F.col("k").bitwiseAND(F.lit(1)) == 1
    top = lambda cond, by, n: counts.where(cond).orderBy(by, "k").limit(n).select("k", "lift").toArrow()
    groups = (
        [(top(isword & (F.col("z") > 0), F.desc("z"), size), 0, WORD_LEXICONS)]
        + [(top(~isword & (F.col("z") > 0), F.desc("z"), size), WORD_LEXICONS, PREFIX_LEXICONS)]
        + [(top(F.col("z") < 0, F.asc("z"), size), WORD_LEXICONS + PREFIX_LEXICONS, CLEAN_LEXICONS)]
    )
    keys, voter = [], []
    for rows, first, many in groups:
        k = rows.column("k").to_numpy().view(np.uint64)
        keys.append(k)
        # the first lexicon of a kind holds the features that lean most
        voter.append(first + np.minimum(np.searchsorted(-np.array(TIERS), -np.abs(rows.column("lift").to_numpy())), many - 1))
    keys, voter = np.concatenate(keys), np.concatenate(voter)
    order = np.argsort(keys)
    return Model(keys[order], voter[order], np.zeros(len(keys)), -30.0)


VOTERS = WORD_LEXICONS + PREFIX_LEXICONS + CLEAN_LEXICONS + 2
_TOXIC = WORD_LEXICONS + PREFIX_LEXICONS


def found(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, index into keys) of the lexicon features in a block."""
    w = Words(column, PUNCT, fold=True)
    row, key = features(w)
    spot = np.searchsorted(keys, key)
    spot[spot == len(keys)] = 0
    hit = keys[spot] == key if len(keys) else np.zeros(len(key), bool)
    pair = np.unique(row[hit].astype(np.int64) << 20 | spot[hit])
    return pair >> 20, pair & ((1 << 20) - 1), len(w.first) - 1


def votes(row: np.ndarray, at: np.ndarray, n: int, voter: np.ndarray) -> np.ndarray:
    """n x VOTERS: 1 toxic, -1 clean, 0 abstains."""
    held = np.zeros((n, VOTERS), np.int64)
    if len(row):
        np.add.at(held, (row, voter[at]), 1)
    out = np.zeros((n, VOTERS), np.int8)
    toxic = held[:, :_TOXIC]
    out[:, :_TOXIC] = toxic > 0
    out[:, _TOXIC : VOTERS - 2] = -(held[:, _TOXIC : VOTERS - 2] > 1).astype(np.int8)
    total = toxic.sum(axis=1)
    out[:, VOTERS - 2] = np.where(total >= 3, 1, np.where(total == 0, -1, 0))  # pattern: density
    kinds = (toxic > 0).sum(axis=1)
    out[:, VOTERS - 1] = np.where(kinds >= 3, 1, np.where(kinds == 0, -1, 0))  # pattern: breadth
    return out


def _code(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(VOTERS)).sum(axis=1)


def _decode(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(VOTERS) % 3 - 1).astype(np.int8)


def _patterns(keys: np.ndarray, voter: np.ndarray):
    """Of (doc_id, text): the pattern of the row's votes."""

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(1)):
                row, spot, many = found(batch.column(1).slice(at, n), keys)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(_code(votes(row, spot, many, voter)))], names=["doc_id", "code"])

    return run


#: What a pair of voters must tell about each other, in nats a row, to count as dependent.
LEAST_SHARED = 1e-3


def _tree(joint: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each voter's parent, -1 for none: the largest spanning forest by what pairs tell about each other given the label.

    joint: class x voter x vote x voter x vote, the rows' mass.
    """
    many = joint.shape[1]
    p = (joint + 1e-3) / (joint + 1e-3).sum(axis=(2, 4), keepdims=True)
    told = (p * np.log(p / (p.sum(axis=4, keepdims=True) * p.sum(axis=2, keepdims=True)))).sum(axis=(2, 4))
    told = (told * (total / total.sum())[:, None, None]).sum(axis=0)
    parent, best, link = np.full(many, -1), np.full(many, -1.0), np.full(many, -1)
    left = set(range(many))
    while left:
        j = max(left, key=lambda i: (best[i], -i))
        left.remove(j)
        parent[j] = link[j] if best[j] > LEAST_SHARED else -1
        for i in left:
            if told[j, i] > best[i]:
                best[i], link[i] = told[j, i], j
    return parent


def label_model(v: np.ndarray, n: np.ndarray, rounds: int = 100, seen: np.ndarray | None = None) -> np.ndarray:
    """The posterior of label 1 for each vote pattern v (1 toxic, -1 clean, 0 abstains) with n rows.

    seen: per pattern the rows labelled 0 and 1 by hand, which anchor the
    classes.  Given the label, a voter depends on its parent in the tree alone.
    """
    seen = np.zeros((len(n), 2)) if seen is None else seen
    if not len(n):
        return np.zeros(0)
    # two starts: any toxic vote counts; or votes weigh less the more voters vote alike, so that copies of a voter don't outvote the rest
    mean = (n @ v) / n.sum()
    d = (v - mean) * np.sqrt(n)[:, None]
    size = np.sqrt((d * d).sum(axis=0)) + 1e-9
    weight = 1 / np.abs(d.T @ d / size[:, None] / size).sum(axis=0).clip(1)
    starts = 0.2 + (v > 0).sum(axis=1) * 0.4, 0.5 + 0.5 * (v @ weight) / np.maximum(np.abs(v) @ weight, 1e-9) * (v != 0).any(axis=1)
    return max((_fitted(v, n, seen, np.clip(x, 0.02, 0.98), rounds) for x in starts), key=lambda x: x[1])[0]


def _fitted(v: np.ndarray, n: np.ndarray, seen: np.ndarray, post: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation maximisation from a start: the posterior and the likelihood."""
    many = v.shape[1]
    free = n - seen.sum(axis=1)
    hot = (v[:, :, None] == np.array([-1, 0, 1])).astype(float)
    flat = hot.reshape(len(n), -1)
    at = v.astype(np.int64) + 1
    for r in range(rounds):
        mass = np.stack([free * (1 - post) + seen[:, 0], free * post + seen[:, 1]])
        total = mass.sum(axis=1)
        joint = np.stack([((flat * m[:, None]).T @ flat).reshape(many, 3, many, 3) for m in mass])
        logs = np.log((total + 1) / (total.sum() + 2))[:, None] + np.zeros((2, len(n)))
        for j, up in enumerate(_tree(joint, total).tolist()):
            own = np.einsum("cjkjk->cjk", joint)[:, j] + 0.5
            p = own / own.sum(axis=1, keepdims=True)
            if up < 0:
                logs += np.log(p[:, at[:, j]])
            else:  # drawn towards the voter's own rates where the parent's vote is rare
                both = joint[:, up, :, j, :] + p[:, None, :]
                logs += np.log(both / both.sum(axis=2, keepdims=True))[:, at[:, up], at[:, j]]
        new = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
        done = r and np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, float(free @ np.logaddexp(*logs) + (seen.T * logs).sum())


def accuracies(v: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
    """How often each voter that doesn't abstain is right, by the posterior."""
    right = np.where(v > 0, post[:, None], 1 - post[:, None]) * (v != 0)
    return (n @ right) / np.maximum(n @ (v != 0), 1e-9)


def _sampled(keys: np.ndarray):
    """Of (text, toxic): the places of a row's lexicon features, and its label."""

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(0)):
                row, spot, many = found(batch.column(0).slice(at, n), keys)
                cuts = np.searchsorted(row, np.arange(many + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(spot, pa.int32())), batch.column(1).slice(at, n)], names=["at", "toxic"])

    return run


def train(model: Model, rows, posterior_of, l2: float = L2, most_steps: int = 50) -> Model:
    """Logistic regression on posterior labels, by Newton steps to convergence.

    rows(at, n, pos): distinct feature lists, how many sampled rows have each, and
    how many of these are toxic by hand, by which the scores are calibrated.
    They are put into an order of their own first, so that the sums, and with
    them every score, do not depend on how Spark had partitioned the rows.
    """
    lists = rows.column("at").combine_chunks()
    cuts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy().astype(np.int64)
    m, k = len(cuts) - 1, len(model.keys)
    many = rows.column("n").to_numpy().astype(np.float64)
    order = sorted(range(m), key=lambda i: flat[cuts[i] : cuts[i + 1]].tobytes())
    length = np.diff(cuts)[order]
    flat = gather(flat, cuts[:-1][order], length)
    row, share = np.repeat(np.arange(m), length), many[order] / many.sum()
    target = posterior_of(row, flat, m)
    w, b = np.zeros(k), 0.0

    def parts(w, b):
        z = np.bincount(row, w[flat], m) + b
        loss = share @ (np.logaddexp(0, z) - target * z) + l2 / 2 * w @ w
        return loss, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    loss, prob = parts(w, b)
    for _ in range(most_steps):
        err = share * (prob - target)
        gw, gb = np.bincount(flat, err[row], k) + l2 * w, err.sum()
        if max(np.abs(gw).max(), abs(gb)) < 1e-9:
            break
        curve = share * prob * (1 - prob) + 1e-12

        def hessian(x, y):
            s = curve * (np.bincount(row, x[flat], m) + y)
            return np.bincount(flat, s[row], k) + l2 * x, s.sum()

        # conjugate gradients solve for the step
        dw, db, rw, rb = np.zeros(k), 0.0, -gw, -gb
        pw, pb, size = rw, rb, rw @ rw + rb * rb
        stop = size * 1e-8
        for _ in range(200):
            hw, hb = hessian(pw, pb)
            t = size / (pw @ hw + pb * hb)
            dw, db, rw, rb = dw + t * pw, db + t * pb, rw - t * hw, rb - t * hb
            was, size = size, rw @ rw + rb * rb
            if size < stop:
                break
            pw, pb = rw + size / was * pw, rb + size / was * pb
        slope, t = gw @ dw + gb * db, 1.0
        while t > 1e-6:
            new, at = parts(w + t * dw, b + t * db)
            if new <= loss + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        w, b, loss, prob = w + t * dw, b + t * db, new, at
    slope, shift = calibrated(np.bincount(row, w[flat], m) + b, many[order], rows.column("pos").to_numpy().astype(np.float64)[order])
    model.weight, model.bias = slope * w, float(slope * b + shift)
    return model


def calibrated(z: np.ndarray, n: np.ndarray, pos: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, shift) by which log odds z say how often rows are toxic by hand; n rows each, pos of them toxic."""
    x = np.stack([z, np.ones(len(z))])
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        # one row's worth of belief that the odds are right as they are
        grad = x @ (pos - n * p) - (at - (1.0, 0.0))
        step = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.eye(2), grad)
        at = at + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learns from docs(doc_id, text) and the labels(doc_id, toxic) that aren't held out.

    fit_rows bounds the sample the classifier is trained on, lexicon_size its
    features of a kind; everything else is gathered from all rows.
    """
    own = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = materialize(own.withColumn("toxic", F.col("toxic").cast("long")))
    labelled = narrow(docs.select("doc_id", "text"), own, "doc_id").select("text", "toxic")
    model = lexicons(labelled, lexicon_size)
    if not len(model.keys):
        return model
    # the labels meet the short vote patterns, not the texts
    code = docs.select("doc_id", "text").mapInArrow(_patterns(model.keys, model.voter), "doc_id long, code long")
    seen = code.join(own, "doc_id", "left").groupBy("code", F.coalesce("toxic", F.lit(2)).alias("y")).agg(F.count("*").alias("n")).collect()
    codes = np.array(sorted({r["code"] for r in seen}))
    n, by_hand = np.zeros(len(codes)), np.zeros((len(codes), 2))
    for r in seen:
        i = int(np.searchsorted(codes, r["code"]))
        n[i] += r["n"]
        if r["y"] < 2:
            by_hand[i, r["y"]] += r["n"]
    post = label_model(_decode(codes), n, seen=by_hand)

    def posterior_of(row, flat, m):
        own = _code(votes(row, flat, m, model.voter))
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        return np.where(codes[at] == own, post[at], 0.0)

    total = labelled.count()
    share = min(1.0, fit_rows / max(total, 1))
    sample = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # rows with the same features are one with a weight: copies count in full, yet about fit_rows rows at most reach the driver
    rows = sample.select("text", "toxic").mapInArrow(_sampled(model.keys), "at array<int>, toxic long").groupBy("at").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).toArrow()
    return train(model, rows, posterior_of)


def _scored(model: Model):
    keys, weight, bias = model.keys, model.weight, model.bias

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(1)):
                row, spot, many = found(batch.column(1).slice(at, n), keys)
                z = np.bincount(row, weight[spot], many) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs(doc_id, text): its score."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
