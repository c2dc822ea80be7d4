"""Language identification by a byte convolutional network (operator 8).

Bytes have an embedding; filters of widths 2, 3 and 4 slide over a window of ``WINDOW`` bytes, take
their maximum over the window, and feed a softmax.  The network is trained in numpy on windows of a
bounded sample (``SAMPLE_ROWS`` labelled texts of each language by a hash of the id, ``SAMPLE_WINDOWS`` each).  A
whole text is all its windows in batches; its prediction is the mean log probability over them, weighted by bytes.

For prediction the filters become tables over pairs of bytes, which gives the same sums.

Only texts and non-null languages of rows whose crc32 of the id's digits mod 3 is not 1 are learned
from.  Defined cases: a text that is null or has no letter is ``und`` with score 0; without a language to learn from every
text is ``und``; a null id is not held out; ties go to the language first in order; repeated
rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm import tables
from newsflow.llm import textbytes as tb

SAMPLE_ROWS = 1_000  # a language
SAMPLE_WINDOWS = 4
WINDOW = 128
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
STEPS = 750  # of training, whatever the sample's size
BATCH = 128
SLICE = 512 << 10
AT_ONCE = 1024  # windows

_PAD = max(WIDTHS) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_windows(s: tb.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes in each); the last window of a text is filled with zeros."""
    size = np.diff(s.offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(s.rows), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = s.offsets[row] + nth * WINDOW
    used = np.minimum(WINDOW, s.offsets[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    out = s.buf[np.minimum(at, len(s.buf) - 1)]
    out[np.arange(WINDOW) >= used[:, None]] = 0
    return out, row, used


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED, row 0 is zero
    filters: list[np.ndarray]  # width * EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        embed[0] = 0
        return cls(
            langs, embed,
            [r.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted cross entropy on a batch of windows."""
        n = len(x)
        x = np.concatenate([x, np.zeros((n, _PAD), np.uint8)], 1)
        e = self.embed[x]  # n x (WINDOW + pad) x EMBED
        pooled, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            cols = np.lib.stride_tricks.sliding_window_view(e, w, 1)[:, :WINDOW].transpose(0, 1, 3, 2)
            z = cols.reshape(n, WINDOW, w * EMBED) @ f
            where.append(z.argmax(1))
            pooled.append(z.max(1) + b)
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        p = _softmax(a @ self.out + self.out_bias)
        d = p
        d[np.arange(n), y] -= 1
        d *= (weight / n)[:, None]
        g_out, g_ob = a.T @ d, d.sum(0)
        dh = (d @ self.out.T) * (h > 0)
        g_embed = np.zeros_like(self.embed)
        g_f, g_b = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            dz = dh[:, i * FILTERS: (i + 1) * FILTERS]  # flows to the position of the maximum alone
            at = where[i][:, :, None] + np.arange(w)  # n x FILTERS x w
            seen = x[np.arange(n)[:, None, None], at]
            part = self.embed[seen]  # n x FILTERS x w x EMBED
            g_f.append(np.einsum("nf,nfwe->wef", dz, part).reshape(w * EMBED, FILTERS))
            g_b.append(dz.sum(0))
            np.add.at(g_embed, seen, np.einsum("nf,wef->nfwe", dz, f.reshape(w, EMBED, FILTERS)))
        g_embed[0] = 0
        return [g_embed, *g_f, *g_b, g_out, g_ob]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters as sums over byte pairs: (pair at the position, pair two further on, bias)."""
        first, second = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            one = [self.embed @ f[k * EMBED: (k + 1) * EMBED] for k in range(w)]
            zero = np.zeros((256, FILTERS), np.float32)
            a, b, c, d = (*one, zero, zero)[:4]
            first.append((a[:, None] + b[None]).reshape(65536, FILTERS))
            second.append((c[:, None] + d[None]).reshape(65536, FILTERS))
        return np.concatenate(first, 1), np.concatenate(second, 1), np.concatenate(self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Predictor:
    def __init__(self, net: Network):
        self.net = net
        self.first, self.second, self.bias = net.tables()

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of each window."""
        out = np.zeros((len(x), len(self.net.langs)), np.float32)
        for i in range(0, len(x), AT_ONCE):
            here = x[i: i + AT_ONCE]
            part = np.concatenate([here, np.zeros((len(here), _PAD + 1), np.uint8)], 1).astype(np.int32)
            pair = part[:, :-1] * 256 + part[:, 1:]
            h = (self.first[pair[:, :WINDOW]] + self.second[pair[:, 2: WINDOW + 2]]).max(1) + self.bias
            out[i: i + AT_ONCE] = np.log(_softmax(np.maximum(h, 0) @ self.net.out + self.net.out_bias) + 1e-12)
        return out


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 7) -> Network:
    """Adam on shuffled batches; languages weigh alike."""
    net, r = Network.new(langs, seed), np.random.default_rng(seed)
    count = np.bincount(y, minlength=len(langs))
    weight = (len(y) / (len(langs) * np.maximum(count, 1)))[y].astype(np.float32)
    m = [np.zeros_like(p) for p in net.params()]
    v = [np.zeros_like(p) for p in net.params()]
    t = 0
    while t < STEPS:
        order = r.permutation(len(y))
        for i in range(0, len(y), BATCH):
            k = order[i: i + BATCH]
            t += 1
            if t > STEPS:
                break
            for j, (p, g) in enumerate(zip(net.params(), net.gradients(x[k], y[k], weight[k]), strict=True)):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.01 * (g * g - v[j])
                p -= 0.004 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    return net


def _sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of the sample and their languages."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull()).withColumn(
        "key", tables.text_key(F.col("text")))
    # ids first, so that no text is sorted; a text counts once however often its row stands, and no language crowds out another
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key")
    ids = rows.select("lang", "doc_id", "key").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(1).to_pylist()
            for s in tb.slices(b.column(0), most=SLICE):
                x, row, _ = text_windows(s)
                n = np.bincount(row, minlength=s.rows)
                nth = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                # windows spread evenly over the whole text
                some = (nth * SAMPLE_WINDOWS) // n[row] != ((nth - 1) * SAMPLE_WINDOWS) // n[row]
                yield tables.record([
                    ("window", pa.binary(), [w.tobytes() for w in x[some]]),
                    ("lang", pa.string(), [lang[s.lo + r] for r in row[some]]),
                ])

    chosen = rows.join(ids.drop("nth"), ["lang", "doc_id", "key"]).groupBy("lang", "doc_id", "key").agg(F.first("text").alias("text"))
    chosen = chosen.select("text", "lang")
    got = chosen.mapInArrow(work, "window binary, lang string").orderBy("lang", "window").toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    x = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return x, np.array([index[v] for v in got["lang"].to_pylist()], np.int64), langs


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def _has_letter(s: tb.Slice) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[s.buf[: s.size]])])
    out = total[s.offsets[1:]] > total[s.offsets[:-1]]
    for r in np.flatnonzero(~out):
        text = s.raw(s.offsets[r], s.offsets[r + 1])
        out[r] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(shared.value)
        names = np.array([*p.net.langs, "und"], object)
        for b in batches:
            for s in tb.slices(b.column(1), most=SLICE):
                x, row, used = text_windows(s)
                each = p.log_probs(x) * used[:, None]
                total = np.stack([np.bincount(row, e, minlength=s.rows) for e in each.T], 1)
                prob = _softmax(total / np.maximum(np.diff(s.offsets), 1)[:, None])
                best = prob.argmax(1)
                letters = _has_letter(s)
                yield tables.record([
                    ("doc_id", pa.int64(), b.column(0).slice(s.lo, s.rows)),
                    ("lang_pred", pa.string(), names[np.where(letters, best, len(names) - 1)]),
                    ("score", pa.float64(), np.where(letters, prob[np.arange(s.rows), best], 0.0)),
                ])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = tables.only(docs, (doc_id, "doc_id", "long"), (text, "text", "string"), (lang, "lang", "string"))
    x, y, langs = _sample(docs)
    if langs:
        out = predict(docs, fit(x, y, langs))
    else:
        out = docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(tables.read(spark, sf_dir, "documents"))
