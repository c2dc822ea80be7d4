"""Toxicity by weak supervision (operator 4).

1. Terms.  A bounded sample of labelled rows (``SAMPLE_ROWS``, by a hash of the id) gives words and word
   beginnings that occur in enough different toxic texts and hardly in others.  Near copies of one
   text count once (by their smallest five-word shingle).
2. Voters.  The terms are dealt into lexicon voters and pattern voters (word beginnings, density,
   shouting).  Each says toxic or nothing.
3. Label model.  The counts of all vote patterns over all rows that may be learned from (at most
   ``2 ** VOTERS`` counts) fit a generative model of label and votes: one accuracy weight per voter, and
   correlation weights for the pairs that the independent model explains worst.  The label is never
   seen by this step; only the share of toxic labels in the sample is.
4. Classifier.  A logistic regression on single terms is trained on the posterior labels of the sample
   and scores every whole text.

Only rows whose crc32 of the id's digits mod 4 is not 2 are learned from; language, source and id are not inputs.

Defined cases: a null or empty text has no terms and gets the score of the bias alone; a null id is not held out
(no label can be joined to it); rows with several labels are toxic if one of them is; repeated rows score alike; without any label every
score is ``NO_LABEL``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables
from newsflow.llm import textbytes as tb

SAMPLE_ROWS = 12_000
MOST_TERMS = 4_096
LEAST_SHARE = 0.01  # of the different toxic texts
LEAST_TEXTS = 3
PURITY = 0.8
PREFIXES = (4, 5)  # bytes of a word's beginning
LEXICONS, BEGINNINGS = 6, 4
VOTERS = LEXICONS + BEGINNINGS + 2
DENSITY = 0.01
SHOUT = 0.5
PAIRS = 12
THRESHOLD = 0.3
NO_LABEL = 0.05


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


@dataclass
class Words:
    """The words of a slice: their row, their hash and the hashes of their beginnings."""

    rows: int
    row: np.ndarray
    n: np.ndarray
    word: np.ndarray
    begin: list[np.ndarray]
    shout: np.ndarray
    first: np.ndarray


def _words(s: tb.Slice) -> Words:
    upper = _UPPER[s.buf[: s.size]]
    share = np.concatenate([[0], np.cumsum(upper)])
    upper_n = share[s.offsets[1:]] - share[s.offsets[:-1]]
    low = tb.Slice(s.lo, s.hi, tb.LOWER[s.buf], s.offsets)
    start, end, first = tb.runs(low, tb.ALNUM)
    begin = []
    for k in PREFIXES:
        h = tb.hashes(low, start, np.minimum(start + k, end))
        begin.append(np.where(end - start > k, tb.mix(h ^ np.uint64(k)), np.uint64(0)))
    size = np.maximum(np.diff(s.offsets), 1)
    return Words(
        s.rows, tb.row_of(first), np.diff(first), tb.hashes(low, start, end), begin, upper_n / size > SHOUT, first)


def _signature(w: Words) -> np.ndarray:
    """The smallest hash of five words of each row (of the row's words if there are fewer)."""
    out = np.zeros(w.rows, np.uint64)
    h, at = tb.windows(w.word, w.first, 5)
    row = w.row[at]
    order = np.lexsort((h, row))
    r, first = np.unique(row[order], return_index=True)
    out[r] = h[order][first]
    return out


def _collected(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the sample, stored: ``SAMPLE_ROWS`` rows at most, one text an id."""
    known = (
        tables.only(labels, ("doc_id", "doc_id", "long"), ("toxic", "toxic", "int"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = met.groupBy("doc_id", "toxic").agg(F.min_by("text", tables.text_key(F.col("text"))).alias("text"))
    return tables.stored(one.select("doc_id", "text", "toxic"), "toxic-sample")


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, kind, toxic, sig) distinct by text: kind 0 a word, 1.. a beginning."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.asarray(b.column(1)).astype(np.int32)
            for s in tb.slices(b.column(0)):
                w = _words(s)
                sig = _signature(w)
                for kind, h in enumerate([w.word, *w.begin]):
                    nth, _ = tb.occurrence(w.row, h)
                    one = (nth == 0) & (h != 0)
                    r = w.row[one]
                    yield tables.record([
                        ("term", pa.int64(), h[one].view(np.int64)),
                        ("kind", pa.int32(), np.full(len(r), kind, np.int32)),
                        ("toxic", pa.int32(), toxic[s.lo: s.hi][r]), ("sig", pa.int64(), sig[r].view(np.int64)),
                    ])

    return sample.select("text", "toxic").mapInArrow(work, "term long, kind int, toxic int, sig long")


def _terms(sample: DataFrame, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted term hashes, kinds)."""
    least = max(LEAST_TEXTS, int(LEAST_SHARE * n_toxic))
    both = _term_counts(sample).groupBy("kind", "term", "sig").agg(F.max("toxic").alias("toxic"))
    t = both.groupBy("kind", "term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    score = F.col("bad") / (F.col("bad") + F.col("good") + 1)
    best = t.where((F.col("bad") >= least) & (score >= PURITY)).orderBy(F.desc("bad"), "kind", "term").limit(MOST_TERMS)
    got = best.toArrow()
    h = got["term"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got["kind"].to_numpy()[order]


@dataclass
class Lexicon:
    terms: np.ndarray
    kinds: np.ndarray
    voter: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        deal = tb.mix(self.terms ^ np.uint64(77)) >> np.uint64(40)
        lex = (deal % np.uint64(LEXICONS)).astype(np.int64)
        half = BEGINNINGS // len(PREFIXES)
        pre = LEXICONS + (np.maximum(self.kinds, 1) - 1) * half + (deal % np.uint64(half)).astype(np.int64)
        self.voter = np.where(self.kinds == 0, lex, pre)

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term) of every distinct term of a text; the vote pattern of every row."""
        rows, terms = [], []
        words_hit = np.zeros(w.rows)
        if len(self.terms):
            for h in [w.word, *w.begin]:
                at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
                ok = self.terms[at] == h
                rows.append(w.row[ok])
                terms.append(at[ok])
            words_hit = np.bincount(rows[-1], minlength=w.rows)
            for k in rows[:-1]:
                words_hit = np.maximum(words_hit, np.bincount(k, minlength=w.rows))
        row = np.concatenate(rows or [np.zeros(0, np.int64)])
        term = np.concatenate(terms or [np.zeros(0, np.int64)])
        both = np.unique(row * (MOST_TERMS + 1) + term)
        row, term = both // (MOST_TERMS + 1), both % (MOST_TERMS + 1)
        pattern = np.zeros(w.rows, np.int64)
        np.bitwise_or.at(pattern, row, np.left_shift(1, self.voter[term]) if len(term) else term)
        pattern |= ((words_hit > 0) & (words_hit >= DENSITY * w.n)).astype(np.int64) << (VOTERS - 2)
        pattern |= w.shout.astype(np.int64) << (VOTERS - 1)
        return row, term, pattern


def pattern_counts(docs: DataFrame, lexicon) -> np.ndarray:
    """How many texts show each vote pattern."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << VOTERS, np.int64)
        for b in batches:
            for s in tb.slices(b.column(0)):
                total += np.bincount(lexicon.value.found(_words(s))[2], minlength=1 << VOTERS)
        p = np.flatnonzero(total)
        yield tables.record([("pattern", pa.int32(), p.astype(np.int32)), ("n", pa.int64(), total[p])])

    got = docs.select("text").mapInArrow(work, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << VOTERS)
    for r in got.collect():
        out[r.pattern] = r.n
    return out


def label_model(counts: np.ndarray, prior: float, steps: int = 400, pairs: int = PAIRS) -> np.ndarray:
    """The posterior probability of toxic for every vote pattern.

    A log-linear model of (label, votes) over all patterns, fitted to the pattern counts by
    gradient steps on the marginal likelihood; then the pairs with the largest error of their joint
    frequency get a weight and the fit goes on.  The label's share is held near ``prior``.
    """
    n = int(np.log2(len(counts)))
    v = ((np.arange(len(counts))[:, None] >> np.arange(n)) & 1).astype(np.float64)
    seen = counts / max(counts.sum(), 1)
    rate = seen @ v
    live = np.flatnonzero((rate > 0) & (rate < 1))
    if not len(live):
        return np.full(len(counts), prior)
    v1 = v[:, live]
    feats = v1  # votes; then chosen pairs
    a = np.log(np.clip(rate[live], 1e-6, 1 - 1e-6)) - 1.5  # how often a voter speaks on a clean text
    w = np.full(len(live), 3.0)  # how much oftener on a toxic one
    b = np.log(prior / (1 - prior))
    chosen: list[tuple[int, int]] = []
    m1 = [np.zeros_like(a), np.zeros_like(w), 0.0]
    m2 = [np.zeros_like(a), np.zeros_like(w), 0.0]
    for round_ in range(2):
        for t in range(1, steps + 1):
            e0 = feats @ a
            e1 = e0 + v1 @ w + b
            top = max(e0.max(), e1.max())
            p0, p1 = np.exp(e0 - top), np.exp(e1 - top)
            z = p0.sum() + p1.sum()
            p0, p1 = p0 / z, p1 / z
            post = p1 / (p0 + p1)
            q1 = seen * post
            grads = [
                seen @ feats - (p0 + p1) @ feats - 1e-4 * a, q1 @ v1 - p1 @ v1 - 1e-4 * w,
                (q1.sum() - p1.sum()) + 2.0 * (prior - p1.sum()),
            ]
            new = []
            for i, (x, g) in enumerate(zip([a, w, b], grads, strict=True)):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                new.append(x + 0.05 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.99**t)) + 1e-8))
            a, w, b = new
            w = np.maximum(w, 0.0)  # a voter never speaks against its own meaning
        if round_ == 0:
            gap = v1.T @ (seen[:, None] * v1) - v1.T @ ((p0 + p1)[:, None] * v1)
            i, j = np.triu_indices(len(live), 1)
            best = np.argsort(-np.abs(gap[i, j]))[:pairs]
            chosen = [(int(i[k]), int(j[k])) for k in best if abs(gap[i[k], j[k]]) > 1e-5]
            if not chosen:
                break
            feats = np.concatenate([v1, np.stack([v1[:, i] * v1[:, j] for i, j in chosen], 1)], 1)
            a = np.concatenate([a, np.zeros(len(chosen))])
            m1 = [np.zeros_like(a), np.zeros_like(w), 0.0]
            m2 = [np.zeros_like(a), np.zeros_like(w), 0.0]
    return post


def _sample_terms(sample: DataFrame, lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern of each sample row, row of each term, term)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tb.slices(b.column(0)):
                row, term, pattern = lexicon.value.found(_words(s))
                at = np.searchsorted(row, np.arange(s.rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(term, pa.int32()))
                yield tables.record([("pattern", pa.int32(), pattern.astype(np.int32)), ("terms", pa.list_(pa.int32()), lists)])

    got = sample.select("text").mapInArrow(work, "pattern int, terms array<int>").toArrow()
    sizes = np.array([len(x) for x in got["terms"].to_pylist()], np.int64)
    flat = np.array([t for x in got["terms"].to_pylist() for t in x], np.int64)
    return got["pattern"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), flat


def regression(target: np.ndarray, row: np.ndarray, term: np.ndarray, n_terms: int, steps: int = 300) -> np.ndarray:
    """Logistic regression on term presence, fitted to soft targets; weights, the bias last."""
    w = np.zeros(n_terms + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(row, w[term], minlength=len(target))
        err = 1 / (1 + np.exp(-z)) - target
        g = np.append(np.bincount(term, err[row], minlength=n_terms), err.sum()) / len(target)
        g[:-1] += 1e-6 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    docs = tables.only(docs, (doc_id, "doc_id", "long"), (text, "text", "string"))
    sample = _collected(spark, docs, labels)
    size, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    out_cols = "doc_id long, score double"
    if size == 0:
        scored = docs.select("doc_id", F.lit(NO_LABEL).alias("score"))
    else:
        terms, kinds = _terms(sample, n_toxic)
        lexicon = spark.sparkContext.broadcast(Lexicon(terms, kinds))
        prior = float(np.clip(n_toxic / size, 0.001, 0.5))
        post = label_model(pattern_counts(docs.where(~held_out(F.col("doc_id"))), lexicon), prior)
        pattern, row, term = _sample_terms(sample, lexicon)
        weights = spark.sparkContext.broadcast(regression(post[pattern], row, term, len(terms)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = weights.value
            for b in batches:
                for s in tb.slices(b.column(1)):
                    r, t, _ = lexicon.value.found(_words(s))
                    z = w[-1] + np.bincount(r, w[t], minlength=s.rows)
                    yield tables.record([
                        ("doc_id", pa.int64(), b.column(0).slice(s.lo, s.rows)),
                        ("score", pa.float64(), 1 / (1 + np.exp(-np.clip(z, -50, 50)))),
                    ])

        scored = docs.mapInArrow(work, out_cols)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels"))
