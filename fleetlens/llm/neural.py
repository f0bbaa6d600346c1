"""A log-bilinear language model, trained with noise-contrastive estimation.

Words are counted over all training documents. The model predicts *units*: the end,
the ``UNITS`` most frequent words, and for all other words one unit per frequent
last pair of bytes. Two previous units, each through its own matrix, predict the
next one bilinearly; a word inside a shared unit has its add-0.1 share of it, so
probabilities of a context sum to one over all words plus one unseen word.

Training passes over every training document: each task runs NCE steps on its
rows from the same start, and the parameters are averaged by tokens in a
distributed aggregate (first over a tenth of the documents to agree on a start, then
over all). Scoring normalises exactly: the logarithm of the sum over units is
tabled for all pairs of context units by batched matrix products.

Bounds: ``KNOWN`` counts of frequent, short words are broadcast; the others are
joined by word, so no count is missing. Model, table and suffixes have a fixed
size.

Defined cases: null and empty texts are the end alone; rows without doc_id belong to
training; repeated rows count and are scored each; with no training row
every token has the base probability 1 and the model is uniform; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import in_batches, landed, text_rows, words_of

UNITS, SUFFIXES, KNOWN, LONGEST = 400, 110, 150_000, 64
WIDTH, NOISE, BATCH, RATE, SQUARES = 24, 64, 1024, 0.1, 1e-4  # SQUARES: what AdaGrad starts from
END = b"\n"  # no word holds a blank
SMOOTH = 0.1
WARM_UP = 10  # one document in so many trains the common start


def in_training(doc_id: Column, n: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n != 0, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over all texts, the end of each text included."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (text,) in text_rows(batches, "text"):
            counts.update(words_of(text))
            counts[END] += 1
            if len(counts) > 400_000:
                yield from in_batches(iter(counts.items()), out, 50_000)
                counts.clear()
        yield from in_batches(iter(counts.items()), out, 50_000)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words by number, and what a number stands for."""

    number: dict[bytes, int]
    counts: np.ndarray  # by number
    unit: np.ndarray  # by number
    suffix: dict[bytes, int]  # last two bytes -> unit
    other: int  # the unit of any other word
    mass: np.ndarray  # tokens by unit
    kinds: np.ndarray  # words by unit, 0 for a unit that is one word
    tokens: int
    words: int

    def unit_of(self, word: bytes) -> int:
        return self.suffix.get(word[-2:], self.other)

    @property
    def n_units(self) -> int:
        return len(self.mass)

    @property
    def share(self) -> np.ndarray:
        """Denominator of a word's share in its unit."""
        return self.mass + SMOOTH * (self.kinds + 1)


def vocabulary(counts: DataFrame, units: int = UNITS, suffixes: int = SUFFIXES, known: int = KNOWN) -> Vocabulary:
    total, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = counts.where(F.octet_length("word") <= LONGEST)
    # The least count such that at most ``known`` words reach it, from the counts of counts.
    steps = sorted(((r.n, r.k) for r in short.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = None, 0
    for n, k in steps:
        if held + k > known:
            break
        least, held = n, held + k
    frequent = sorted(((r.n, bytes(r.word)) for r in short.where(F.col("n") >= least).collect()), key=lambda x: (-x[0], x[1])) if least else []
    single = [w for _, w in frequent if w != END][:units]
    ending = F.expr("substring(word, -2, 2)")
    tail = counts.where(~F.col("word").isin([bytearray(w) for w in [END, *single]])).groupBy(ending.alias("suffix")).agg(
        F.sum("n").alias("n"), F.count("*").alias("k")
    )
    tails = sorted(((r.n, bytes(r.suffix), r.k) for r in tail.collect()), key=lambda x: (-x[0], x[1]))  # at most 256 ** 2 + 256 suffixes
    own = {s: 1 + len(single) + i for i, (_, s, _) in enumerate(tails[:suffixes])}
    other = 1 + len(single) + len(own)
    by_word = dict((w, n) for n, w in frequent)
    mass = [by_word.get(END, 0), *[by_word[w] for w in single], *[n for n, _, _ in tails[:suffixes]], sum(n for n, _, _ in tails[suffixes:])]
    kinds = [0] * (1 + len(single)) + [k for _, _, k in tails[:suffixes]] + [sum(k for _, _, k in tails[suffixes:])]
    place = {END: 0} | {w: i + 1 for i, w in enumerate(single)}
    number = {w: i for i, (_, w) in enumerate(frequent)}
    if END not in number:
        number[END] = len(number)
        frequent.append((by_word.get(END, 0), END))
    unit = np.array([place[w] if w in place else own.get(w[-2:], other) for _, w in frequent], np.int32)
    return Vocabulary(number, np.array([n for n, _ in frequent], np.int64), unit, own, other, np.array(mass, float), np.array(kinds, float), int(total), int(words))


class Model:
    """Parameters as one vector, seen as context rows, target rows, biases and the two matrices."""

    def __init__(self, n_units: int, flat: np.ndarray, width: int = WIDTH):
        k, d = n_units, width
        ends = np.cumsum([(k + 1) * d, k * d, k, d * d, d * d])
        self.flat = flat
        r, q, self.bias, c1, c2 = np.split(flat, ends[:-1])
        self.rows, self.targets, self.c1, self.c2 = r.reshape(k + 1, d), q.reshape(k, d), c1.reshape(d, d), c2.reshape(d, d)

    @classmethod
    def start(cls, noise: np.ndarray, width: int = WIDTH) -> Model:
        """The unigram model: biases are its logarithms, the rest is small."""
        k, d = len(noise), width
        rng = np.random.default_rng(7)
        flat = np.concatenate((rng.normal(0, 0.3, (k + 1) * d), rng.normal(0, 0.05, k * d), np.log(noise), np.eye(d).ravel(), np.eye(d).ravel() * 0.5))
        return cls(k, flat.astype(np.float32), width)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.rows @ self.c1, self.rows @ self.c2

    def log_sums(self) -> np.ndarray:
        """Log of the sum over units for every pair of context units (nearer, farther)."""
        near, far = self.contexts()
        out = np.empty((len(near), len(far)), np.float32)
        for i, row in enumerate(near):
            s = (row + far) @ self.targets.T + self.bias
            top = s.max(1)
            out[i] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out


def noise_of(mass: np.ndarray) -> np.ndarray:
    smoothed = mass + SMOOTH
    return smoothed / smoothed.sum()


def contexts_of(units: np.ndarray, starts: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before and the one before that; ``blank`` where a document begins."""
    near, far = np.empty_like(units), np.empty_like(units)
    near[1:], far[2:] = units[:-1], units[:-2]
    near[starts] = blank
    far[starts] = blank
    second = starts + 1
    far[second[second < len(units)]] = blank
    return near, far


def train_on(model: Model, units: np.ndarray, starts: np.ndarray, noise: np.ndarray, squares: np.ndarray, rng: np.random.Generator) -> None:
    """NCE over all tokens, in batches with common noise and AdaGrad steps, in place."""
    k = model.bias.size
    near, far = contexts_of(units, starts, k)
    log_noise = np.log(NOISE * noise).astype(np.float32)
    sums = Model(k, squares)
    grad = Model(k, np.zeros_like(model.flat))

    def scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        d = values.shape[1]
        return np.bincount((at[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d)

    for a in range(0, len(units), BATCH):
        t, n1, n2 = units[a : a + BATCH], near[a : a + BATCH], far[a : a + BATCH]
        drawn = rng.choice(k, NOISE, p=noise)
        r1, r2 = model.rows[n1], model.rows[n2]
        h = r1 @ model.c1 + r2 @ model.c2
        qt, qn = model.targets[t], model.targets[drawn]
        gt = 1 - 1 / (1 + np.exp(-((h * qt).sum(1) + model.bias[t] - log_noise[t])))
        gn = -1 / (1 + np.exp(-(h @ qn.T + model.bias[drawn] - log_noise[drawn])))
        dh = gt[:, None] * qt + gn @ qn
        grad.targets[:] = scatter(t, gt[:, None] * h, k) + scatter(drawn, gn.T @ h, k)
        grad.bias[:] = np.bincount(t, gt, k) + np.bincount(drawn, gn.sum(0), k)
        grad.rows[:] = scatter(n1, dh @ model.c1.T, k + 1) + scatter(n2, dh @ model.c2.T, k + 1)
        grad.c1[:], grad.c2[:] = r1.T @ dh, r2.T @ dh
        grad.flat /= len(t)
        sums.flat += grad.flat**2
        model.flat += RATE * grad.flat / np.sqrt(sums.flat + 1e-8)


def numbered(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Numbers (-1: not held), units and document starts of all tokens, and the words of each text."""
    get = vocab.number.get
    words = [words_of(t) for t in texts]
    for w in words:
        w.append(END)
    flat = [x for w in words for x in w]
    numbers = np.array([get(x, -1) for x in flat], np.int64)
    units = vocab.unit[numbers]
    for i in np.flatnonzero(numbers < 0).tolist():
        units[i] = vocab.unit_of(flat[i])
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])).astype(np.int64)
    return numbers, units, starts, words


def _text_groups(rows: Iterator[tuple], chars: int = 1_500_000) -> Iterator[list[tuple]]:
    kept, load = [], 0
    for row in rows:
        kept.append(row)
        load += len(row[-1] or "") + 1
        if load >= chars:
            yield kept
            kept, load = [], 0
    if kept:
        yield kept


def train_round(docs: DataFrame, vocab, model: Model, noise: np.ndarray) -> Model:
    """Every task trains on its rows from ``model``; the results are averaged by tokens."""
    context = docs.sparkSession.sparkContext
    start = context.broadcast(model.flat)
    k = len(noise)
    out = pa.schema([("i", pa.int32()), ("v", pa.float64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, rng, n = Model(k, start.value.copy()), np.full_like(start.value, SQUARES), np.random.default_rng(11), 0
        for group in _text_groups(text_rows(batches, "text")):
            _, units, starts, _ = numbered([t for (t,) in group], vocab.value)
            train_on(own, units, starts, noise, squares, rng)
            n += len(units)
        if n:
            flat = own.flat.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * n), pa.array(np.full(len(flat), float(n)))], schema=out)

    sums = docs.select("text").mapInArrow(run, "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v"))
    flat = model.flat.copy()
    for r in sums.collect():  # as many rows as parameters
        flat[r.i] = r.v
    return Model(k, flat)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    training = docs.where(in_training(F.col("doc_id")))
    counts = landed(word_counts(training), "word-counts")
    words = vocabulary(counts)
    vocab, noise = context.broadcast(words), noise_of(words.mass)
    model = Model.start(noise)
    if words.tokens:
        warm = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % WARM_UP == 1, F.lit(False))
        model = train_round(training.where(warm), vocab, model, noise)
        model = train_round(training, vocab, model, noise)
    base_total = words.tokens + SMOOTH * (words.words + 1)
    near, far = model.contexts()
    shared = context.broadcast((near, far, model.targets, model.bias, model.log_sums()))
    k = len(noise)
    out = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64()), ("share", pa.float64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, (near, far, targets, bias, log_sums) = vocab.value, shared.value
        share, single = v.share, v.kinds == 0
        base_log = np.log10((v.counts + SMOOTH) / base_total)
        # A word that is its unit has all of it; any other has its share.
        share_log = np.where(single[v.unit], 0.0, np.log10((v.counts + SMOOTH) / share[v.unit]))
        known = (v.counts > 0).astype(np.int64)

        def rows() -> Iterator[tuple]:
            row = TaskContext.get().partitionId() << 40
            for group in _text_groups(text_rows(batches, "doc_id", "text")):
                numbers, units, starts, words = numbered([t for _, t in group], v)
                n1, n2 = contexts_of(units, starts, k)
                log_p = np.empty(len(units))
                for a in range(0, len(units), 100_000):
                    s = slice(a, a + 100_000)
                    h = near[n1[s]] + far[n2[s]]
                    log_p[s] = np.einsum("ij,ij->i", h, targets[units[s]]) + bias[units[s]] - log_sums[n1[s], n2[s]]
                held = numbers >= 0
                log_p = log_p / np.log(10) + np.where(held, share_log[numbers], 0.0)
                base = np.where(held, base_log[numbers], 0.0)
                sums = [np.add.reduceat(x, starts) for x in (np.where(held, known[numbers], 0), base, log_p)]
                gaps = np.split(np.flatnonzero(~held), np.searchsorted(np.flatnonzero(~held), starts[1:]))
                for i, (doc_id, _) in enumerate(group):
                    rare = Counter(words[i][j - starts[i]] for j in gaps[i].tolist())
                    yield row, doc_id, len(words[i]), int(sums[0][i]), float(sums[1][i]), float(sums[2][i]), [
                        {"word": w, "times": n, "share": float(share[v.unit_of(w)])} for w, n in rare.items()
                    ]
                    row += 1

        yield from in_batches(rows(), out, 2000, lambda r: 60 * len(r[6]))

    parts = landed(docs.mapInArrow(
        run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,times:long,share:double>>"
    ), "token-scores")
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.share")
    c = F.coalesce("n", F.lit(0))
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + SMOOTH) / F.lit(base_total))).alias("base"),
        F.sum(F.col("times") * F.log10((c + SMOOTH) / F.col("share"))).alias("within"),
    )
    return parts.drop("rare").join(found, "row", "left").select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("within", F.lit(0.0))).alias("score"),
    )
