"""Toxicity: a linear-chain conditional random field over tokens.

Labels say which documents are toxic, not where. So Spark first counts, in a bounded sample of labelled
documents (about ``MOST_DOCS`` of each label, and ``MOST_BYTES`` of text), in how many toxic and other ones each
word, word beginning and word ending occurs; those whose log-likelihood ratio is beyond chance are cues. That
gives seeds, not features alone:

- tokens of other documents are plain;
- in toxic documents a token whose word or beginning is a cue is toxic, and one whose word is known from
  ``LEAST_PLAIN`` other documents is plain. All other tokens there are left open.

A chain of two states (plain, toxic) is fitted to these partly labelled tokens: the ascent moves from what the
chain expects to what it expects given the seeds, so open tokens count as their context says. A token's features are its
cues, the strength of the strongest, and the strength of the cues of the tokens before and after it. Every ``HIDDEN``th seed
hides its own cues in the fit, so that what stands around a token, and its ending, have to tell it too.

Scoring a text: forward-backward gives each token its marginal of being toxic. The document's score is a
logistic function of the largest marginal and of their sum, fitted to the same sample; tokens with a marginal
of 0.5 or more are the offending spans (code points), whether they hold a cue or not.

Defined cases: a null text is an empty one and has the score of a text without any cue; rows without a toxic
label are not learned from; without labelled rows, or with labels of one kind alone, the score is that kind's
share; words of any length are taken whole; equal texts get equal scores.
"""

from __future__ import annotations

import collections
import dataclasses
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hydrospark.llm.common import about, fold, in_lots, small_batches, tidy, whole_text
from hydrospark.plans.scratch import written

MOST_DOCS = 3_000  # of each label that is learned from
MOST_BYTES = 64 << 20  # of their texts; beyond it fewer documents are learned from
LEAST_TOXIC = 3  # documents that a cue must be seen in
LEAST_G2 = 20.0
LEAST_ODDS = 2.0  # log of how many times more often a cue is in toxic documents
BEGINNINGS = (4, 5, 6)  # code points
ENDING = 4
LEAST_PLAIN = 2  # documents that are not toxic in which a plain word is seen
HIDDEN = 4
STEPS, RATE, DECAY = 50, 0.3, 1e-3
STRENGTHS = 8
SEGMENT = 50  # tokens of a training sequence
KNOWN_WORDS = 100_000  # whose features a task keeps

_WORD = r"[^\x20\x09-\x0D.,!?;:\"()]+"  # what is between white space and points
_WORDS = re.compile(_WORD)


def cues(sample: DataFrame) -> dict[str, float]:
    """Log-odds of the words ('=word'), beginnings ('^begin') and endings ('$end') that tell toxic texts from others, of a ``sample`` (text, y).

    The sample bounds their number; the driver gets all of them.
    """
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return {}
    known = sample.select("y", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?U){_WORD}"), F.lit(0))).alias("words"))
    longer = lambda k: lambda w: F.char_length(w) > k
    begin = lambda k: lambda w: F.concat(F.lit("^"), F.substring(w, 1, k))
    begins = [F.transform(F.filter("words", longer(k)), begin(k)) for k in BEGINNINGS]
    ends = F.transform(F.filter("words", longer(ENDING)), lambda w: F.concat(F.lit("$"), F.right(w, F.lit(ENDING))))
    every = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("="), w)), *begins, ends))
    counted = known.select("y", F.explode(every).alias("cue")).groupBy("cue").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    part = lambda n, total, share: F.when(n > 0, n * F.log(n / (total * share))).otherwise(0.0)
    seen = (a + b) / (toxic + other)
    g2 = 2 * (part(a, toxic, seen) + part(b, other, seen) + part(toxic - a, toxic, 1 - seen) + part(other - b, other, 1 - seen))
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (other + 1.0))
    found = counted.where((a >= LEAST_TOXIC) & (a * other > b * toxic)).select("cue", odds.alias("odds"), g2.alias("g2")).where((F.col("g2") >= LEAST_G2) & (F.col("odds") >= LEAST_ODDS))
    return {r["cue"]: r["odds"] for r in found.collect()}


@dataclasses.dataclass
class Field:
    """The fitted chain. A token's features are the cues that it holds, the strength of the strongest, and the strengths before and after it."""

    cue_at: dict[str, int]
    odds: np.ndarray
    weights: np.ndarray  # of cues, strengths (own, before, after), and one that all tokens have: how much more toxic than plain
    steps: np.ndarray  # 2 x 2: from state, to state
    first: np.ndarray  # state of the first token
    link: np.ndarray  # constant, weight of the largest marginal's log-odds, weight of the log of their sum

    def cues_of(self, word: str) -> tuple[tuple[int, ...], int]:
        """Numbers of a word's cues, and its strength: of the words and beginnings among them, -1 without one. Nothing for most words."""
        low = word.lower()
        own = [self.cue_at[c] for c in (f"={low}", *(f"^{low[:k]}" for k in BEGINNINGS if len(low) > k)) if c in self.cue_at]
        strength = int(np.clip(max(self.odds[i] for i in own), 0, STRENGTHS - 1)) if own else -1
        ending = self.cue_at.get(f"${low[-ENDING:]}") if len(low) > ENDING else None
        return (tuple(own) if ending is None else (*own, ending)), strength


def tokens(text: str) -> list[str]:
    return _WORDS.findall(text)


def marginals(push: np.ndarray, sizes: np.ndarray, steps: np.ndarray, first: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``push`` holds, chain after chain (longest first), how much more toxic than plain each token is. Returns
    each token's marginal and, where it is told how many ``times`` each chain counts, the expected steps from
    state to state, summed: (2, 2).
    """
    n, total = len(sizes), len(push)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    longest = int(sizes[0]) if n else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains that have a token at each place
    emit = np.exp(np.clip(push, -30, 30))
    (stay, fall), (rise, last) = np.exp(steps).T  # from plain and from toxic to plain; the same to toxic
    # odds of toxic against plain: of what came up to a token, and of what comes after it
    forward, back = np.empty(total), np.empty(total)
    for t in range(longest):
        at = base[: alive[t]] + t
        if t:
            before = forward[at - 1]
            forward[at] = (rise + before * last) / (stay + before * fall) * emit[at]
        else:
            forward[at] = np.exp(first[1] - first[0]) * emit[at]
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        at = base[: alive[t]] + t
        back[at] = 1.0
        if t + 1 < longest:
            at = at[: alive[t + 1]]
            after = emit[at + 1] * back[at + 1]
            back[at] = (fall + last * after) / (stay + rise * after)
            if times is not None:
                here = forward[at]
                joint = np.stack((np.full(len(at), stay), rise * after, here * fall, here * last * after))
                pairs += (joint @ (times[: len(at)] / joint.sum(0))).reshape(2, 2)
    odds = forward * back
    return odds / (1 + odds), pairs


def _arranged(field: Field, texts: list[str], known: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the texts (longest first), their sizes, (token, feature) of all features in that order, and the tokens that are seeds.

    A feature of another token's strength is one of the last 2 * STRENGTHS before the common one.
    """
    lists = []
    at_own, at_before, at_after = (len(field.odds) + k * STRENGTHS for k in range(3))
    for text in texts:
        words, hits, seeds = tokens(text), [], []
        last = len(words) - 1
        for i, w in enumerate(words):
            found = known.get(w)
            if found is None:
                found = field.cues_of(w)
                if len(known) < KNOWN_WORDS:
                    known[w] = found
            if found[0]:
                cues, strength = found
                hits += [(i, f) for f in cues]
                if strength >= 0:
                    seeds.append(i)
                    hits.append((i, at_own + strength))
                    if i < last:
                        hits.append((i + 1, at_before + strength))
                    if i:
                        hits.append((i - 1, at_after + strength))
        lists.append((len(words), hits, seeds))
    sizes = np.array([n for n, *_ in lists], np.int64)
    order = np.argsort(-sizes, kind="stable")
    base = np.zeros(len(texts), np.int64)
    base[order] = np.concatenate(([0], np.cumsum(sizes[order])[:-1])) if len(texts) else 0
    pairs = [(base[k] + i, f) for k, (_, hits, _) in enumerate(lists) for i, f in hits]
    token, feature = np.array(pairs, np.int64).reshape(-1, 2).T
    seeds = np.array([base[k] + i for k, (*_, own) in enumerate(lists) for i in own], np.int64)
    return order, sizes[order], token, feature, seeds


def _pushes(field: Field, total: int, token: np.ndarray, feature: np.ndarray) -> np.ndarray:
    return field.weights[-1] + np.bincount(token, field.weights[feature], total)


def fit(texts: list[str], toxic: np.ndarray, odds: dict[str, float], scale: tuple[float, float] = (1.0, 1.0)) -> Field:
    """The chain and the document score from a sample of texts with their labels.

    ``scale`` tells how many rows a sampled one stands for, of label 0 and of label 1. The chain is fitted to
    segments of whole texts. Segments without a cue are alike if they are of one length: they are worked on
    once and counted as often as they occur.
    """
    names = sorted(odds)
    field = Field({c: i for i, c in enumerate(names)}, np.array([odds[c] for c in names]), np.zeros(len(names) + 3 * STRENGTHS + 1), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    rows = np.array(scale)[toxic] if len(toxic) else np.zeros(0)
    share = float(np.clip((toxic * rows).sum() / rows.sum(), 1e-3, 1 - 1e-3)) if len(toxic) else 0.5
    field.link[0] = np.log(share / (1 - share))
    if not names or not len(toxic) or toxic.min() == toxic.max():
        return field
    order, sizes, token, feature, seeds = _arranged(field, texts, {})
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bad = toxic[order] == 1
    # state of each token: 0, 1, or -1 for an open one
    state = np.where(bad[owner], _open_or_plain([texts[k] for k in order], bad), 0)
    state[seeds] = bad[owner[seeds]].astype(int)
    hidden = np.zeros(total, bool)
    hidden[seeds[::HIDDEN]] = True
    strong = len(names) + STRENGTHS  # features from here on are of other tokens
    ending = np.array([n[0] == "$" for n in names] + [False] * (3 * STRENGTHS + 1))
    shown = ~hidden[token] | (feature >= strong) | ending[feature]
    all_token, all_feature = token, feature
    token, feature = token[shown], feature[shown]
    # segments, and which of them hold a cue
    pieces = -(-sizes // SEGMENT)
    lengths = np.full(int(pieces.sum()), SEGMENT, np.int64)
    last = np.cumsum(pieces)[pieces > 0] - 1
    lengths[last] = (sizes - (pieces - 1) * SEGMENT)[pieces > 0]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    of_token = np.repeat(np.arange(len(lengths)), lengths)
    # a segment of plain tokens without any feature is like all others of its length
    apart = np.zeros(len(lengths), bool)
    apart[of_token[token]] = True
    apart[of_token[state != 0]] = True
    plain, plain_times = np.unique(lengths[~apart], return_counts=True)
    kept = np.flatnonzero(apart)
    new_lengths = np.concatenate((lengths[kept], plain))
    by_length = np.argsort(-new_lengths, kind="stable")
    times = np.concatenate((np.ones(len(kept)), plain_times))[by_length]
    new_starts = np.empty(len(new_lengths), np.int64)
    new_starts[by_length] = np.concatenate(([0], np.cumsum(new_lengths[by_length])[:-1]))
    shift = np.zeros(len(lengths), np.int64)
    shift[kept] = new_starts[: len(kept)] - starts[kept]
    at = token + shift[of_token[token]]
    n, chain_sizes = int(new_lengths.sum()), new_lengths[by_length]
    counts = np.repeat(times, chain_sizes)
    own = apart[of_token]
    seen = np.zeros(n, int)
    seen[(np.arange(total) + shift[of_token])[own]] = state[own]
    # what is known pushes a token as far as marginals goes; an open token is pushed by its features alone
    given = np.where(seen == 1, 60.0, np.where(seen == 0, -60.0, 0.0))
    base = np.concatenate(([0], np.cumsum(chain_sizes)[:-1]))
    inner = np.ones(n, bool)
    inner[base] = False
    sure = inner[1:] & (seen[:-1] >= 0) & (seen[1:] >= 0)
    steps = np.zeros((2, 2))
    np.add.at(steps, (seen[:-1][sure], seen[1:][sure]), counts[1:][sure])
    begun = np.bincount(np.maximum(seen[base], 0), times, minlength=2)
    # the chance of a step is near what is counted: a good start for the ascent
    field.steps[:] = np.log((steps + 1) / (steps + 1).sum(1, keepdims=True))
    field.first[:] = np.log((begun + 1) / (begun + 1).sum())
    moved = [np.full(field.weights.shape, 1e-6), np.full((2, 2), 1e-6)]
    for _ in range(STEPS):
        push = _pushes(field, n, at, feature)
        m, pairs = marginals(push, chain_sizes, field.steps, field.first, times)
        real, real_pairs = marginals(np.where(given == 0, push, given), chain_sizes, field.steps, field.first, times)
        gain = np.bincount(feature, (real - m)[at], len(field.weights))
        gain[-1] = ((real - m) * counts).sum()
        for k, (value, grad) in enumerate(((field.weights, gain - DECAY * field.weights), (field.steps, real_pairs - pairs - DECAY * field.steps))):
            moved[k] += grad**2
            value += RATE * grad / np.sqrt(moved[k])
    # the score is fitted to the marginals of whole texts, as it is used
    m, _ = marginals(_pushes(field, total, all_token, all_feature), sizes, field.steps, field.first)
    field.link[:] = _logistic(_summary(m, owner, len(sizes)), toxic[order].astype(float), rows[order])
    return field


def _open_or_plain(texts: list[str], bad: np.ndarray) -> np.ndarray:
    """For each token of the texts 0 if its word is in LEAST_PLAIN texts or more that are not ``bad``, else -1."""
    seen: collections.Counter = collections.Counter()
    for text, toxic in zip(texts, bad):
        if not toxic:
            seen.update({w.lower() for w in tokens(text)})
    found = [-(seen[w.lower()] < LEAST_PLAIN) if toxic else 0 for text, toxic in zip(texts, bad) for w in tokens(text)]
    return np.array(found, np.int64)


def _summary(m: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each text: 1, log-odds of its largest marginal, log of one plus their sum."""
    top, total = np.full(n, 1e-4), np.bincount(owner, m, n)
    np.maximum.at(top, owner, m)
    top = np.minimum(top, 1 - 1e-4)
    return np.stack((np.ones(n), np.log(top / (1 - top)), np.log1p(np.where(total < 0.01, 0, total))), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, slightly ridged; each row counts so many times."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (times * (y - p)) - 0.1 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> Field:
    """Cues and chain from about ``most_docs`` labelled documents of each label and ``most_bytes`` of text, or all if there is no more."""
    rows = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).distinct()
    counted = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # which ones is decided without their texts
    picked = None
    for y in (0, 1):
        some = about(rows.where(F.col("y") == y), "l_id", counted.get(y, 0), most_docs)
        picked = some if picked is None else picked.union(some)
    # about 2 * most_docs ids at most, so they may be broadcast; the sample's texts are written once and read twice
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    sample = written(sample.select("text", "y", F.md5(F.col("doc_id").cast("string")).alias("h")), "toxicity-sample")
    size = sample.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    sample = about(sample, "h", size, most_bytes)
    most_docs = most_docs * min(1.0, most_bytes / max(1, size))
    odds = cues(sample)
    scale = tuple(max(1.0, counted.get(y, 0) / most_docs) for y in (0, 1))

    # the fit is one task over a bounded sample, on an executor; repartition keeps the reading of the sample apart
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((h, t, y) for b in batches for t, y, h in zip(*(c.to_pylist() for c in b.columns)))
        field = fit([t for _, t, _ in found], np.array([y for *_, y in found], int), odds, scale)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], ["field"])

    with small_batches(docs.sparkSession):
        found = sample.repartition(1).mapInArrow(tidy(work), "field binary").first()
    return pickle.loads(found["field"]) if found else fit([], np.zeros(0, int), {})


def score(docs: DataFrame, field: Field, text: str = "text", keep: bool = False) -> DataFrame:
    """``docs``, without the text unless ``keep``, with ``score`` and ``spans`` (array of start, end in code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    others = [c for c in docs.columns if c not in ("score", "spans") and (keep or c != text)]
    sent = [*[c for c in others if c != text], text]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        for batch in batches:
            for lot in in_lots(batch, pc.binary_length(batch.column(len(sent) - 1))):
                scores, spans = scored(own, [t or "" for t in lot.column(len(sent) - 1).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([*[lot.column(sent.index(c)) for c in others], pa.array(scores), pa.array(spans, span)], [*others, "score", "spans"])

    plain = docs.select(*sent)
    example = plain.select(*others, F.lit(0.0).alias("score"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("spans"))
    return plain.mapInArrow(tidy(work), example.schema)


def scored(field: Field, texts: list[str], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, list[list[dict]]]:
    order, sizes, token, feature, _ = _arranged(field, texts, known)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    push = _pushes(field, int(sizes.sum()), token, feature)
    m, _ = marginals(push, sizes, field.steps, field.first)
    value = np.empty(len(texts))
    value[order] = 1 / (1 + np.exp(-np.clip(_summary(m, owner, len(sizes)) @ field.link, -30, 30)))
    spans: list[list[dict]] = [[] for _ in texts]
    base = np.concatenate(([0], np.cumsum(sizes)))
    for k in np.unique(owner[m >= 0.5]):
        marked = m[base[k] : base[k + 1]] >= 0.5
        spans[order[k]] = [{"start": w.start(), "end": w.end()} for w, yes in zip(_WORDS.finditer(texts[order[k]]), marked) if yes]
    return value, spans


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of each row; labels of fold ``held_out`` are not learned from."""
    field = learn(docs, labels.where(fold("doc_id", folds) != held_out))
    found = score(docs.select("doc_id", "text"), field)
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns; the field learns from ``learn_from`` (else ``docs``), all labels but the held-out fold's."""
    field = learn(docs if learn_from is None else learn_from, labels.where(fold("doc_id", 5) != 0))
    # other columns may be called score or spans
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names)])
    found = score(rows, field, keep=True).where(F.col("score") < threshold)
    return found.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])
