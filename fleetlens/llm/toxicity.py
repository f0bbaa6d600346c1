"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded texts.

Folding undoes look-alike letters and digits that stand for letters. The lexicon
is learned: words and word beginnings that are far likelier in documents labelled
toxic, weighted by their log odds. One automaton holds all terms and exception
phrases; a term counts if it starts a word (a whole-word term must end it as well) and no
exception phrase covers it. The sum of weights and its rate per word go into a logistic
curve fitted on the same sample.

Bounds: at most ``SAMPLE`` labelled rows per class are learned from (the first in hash order of
doc_id), and the ``TERMS`` terms of the largest weight are kept, so the model and its training rows
are bounded; every document is scored whole. Of near copies in a class (``golay``: fingerprints
within four bits) one text counts, and every other text of the sample counts once.

Exception phrases are learned as well: pairs and triples of words that hold a matching word and stand, relative
to the class sizes, at least as often in clean texts as in toxic ones, in ``LEAST_SUPPORT`` clean texts or more.
The ``EXCEPTIONS`` that stand in most clean texts are kept.

Defined cases: null and empty texts have no match and get the curve's value
there; labels that are null are left out and a doc_id labelled twice takes the larger; without
both classes nothing matches and the score is the share of toxic labels; repeated rows are
scored each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import in_batches, landed, text_or_empty, text_rows
from fleetlens.llm.golay import grouped

SAMPLE, TERMS, EXCEPTIONS = 10_000, 20_000, 20_000
LEAST_SUPPORT, LEAST_WEIGHT = 5, 2.5
SHORTEST, LONGEST = 4, 8  # of word beginnings
THRESHOLD = 0.7
# Fixed: letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_TABLE = {ord(k): v for k, v in LOOK_ALIKE.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF))
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as Latin letters, invisible characters removed."""
    return text.lower().translate(_TABLE)


def terms_of(word: str) -> list[str]:
    """A whole word ends in a blank; beginnings do not."""
    return [word + " ", *[word[:n] for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]]


@dataclass
class Lexicon:
    """Term -> weight, exception phrases, and the curve (bias, total, rate)."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matcher(self):
        """text -> (sum of weights, number of words)."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        words: dict[str, list] = {}
        for term, weight in self.terms.items():
            whole = term.endswith(" ")
            words.setdefault(term.strip(), [0.0, 0.0, False])[0 if whole else 1] = weight
        for phrase in self.exceptions:
            words.setdefault(fold(phrase), [0.0, 0.0, False])[2] = True
        for key, value in words.items():
            automaton.add_word(key, (len(key), *value))
        automaton.make_automaton()

        def match(text: str | None) -> tuple[float, int]:
            folded = fold(text or "")
            found: dict[int, float] = {}
            spans, ends, n = [], {}, len(folded)
            for last, (size, whole, begins, excepted) in automaton.iter(folded) if words else ():
                start, end = last - size + 1, last + 1
                if start and folded[start - 1].isalpha():
                    continue
                closed = end == n or not folded[end].isalpha()
                if excepted and closed:
                    spans.append((start, end))
                weight = max(whole if closed else 0.0, begins)
                if weight > found.get(start, 0.0):
                    found[start], ends[start] = weight, end
            if spans and found:
                found = {s: w for s, w in found.items() if not any(a <= s and ends[s] <= b for a, b in spans)}
            return sum(found.values()), len(folded.split())

        return match

    def score(self, total: float, words: int) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(total) + self.curve[2] * math.log1p(1000 * total / max(1, words))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def bucket(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic, doc_id, text, text_hash of at most ``sample`` labelled rows per class."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    picked = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * sample rows of two numbers

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(chosen, "doc_id")
    return landed(texts.select("toxic", "doc_id", "text", F.xxhash64(text_or_empty()).alias("text_hash")), "toxicity-sample")


def _distinct(found: DataFrame) -> DataFrame:
    """toxic, text: of the near copies in each class one text, every other text as it is."""
    def of(toxic: int) -> DataFrame:
        own = found.where(F.col("toxic") == toxic)
        near = grouped(own).select("doc_id", "text_hash", "root").distinct()
        one = own.join(near, ["doc_id", "text_hash"]).groupBy("root").agg(F.min("text").alias("text"))
        return one.select(F.lit(toxic).alias("toxic"), "text")

    return landed(of(1).unionByName(of(0)), "toxicity-distinct")


def word_terms(text: str | None) -> set[str]:
    return {t for w in {*_WORD.findall(fold(text or ""))} if len(w) > 2 for t in terms_of(w)}


def phrases_of(text: str | None, terms: Container[str]) -> set[str]:
    """Pairs and triples of folded words, one blank apart, that hold a word with a term."""
    folded = fold(text or "")
    found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(folded)]
    telling = {w: any(t in terms for t in terms_of(w)) for w in {w for _, _, w in found}}
    out = set()
    for i, (start, at, word) in enumerate(found):
        hit = telling[word]
        for _, (a, b, other) in zip(range(2), found[i + 1 : i + 3]):
            if a != at + 1 or folded[at] != " ":
                break
            hit, at = hit or telling[other], b
            if hit:
                out.add(folded[start:at])
    return out


def _counted(texts: DataFrame, terms_in: Callable[[str | None], set[str]] = word_terms) -> DataFrame:
    """Term -> number of texts."""
    out = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (text,) in text_rows(batches, "text"):
            counts.update(terms_in(text))
            if len(counts) > 500_000:
                yield from in_batches(iter(counts.items()), out, 50_000)
                counts.clear()
        yield from in_batches(iter(counts.items()), out, 50_000)

    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon and curve from labelled rows; ``labels`` must hold only rows to learn from. ``exceptions`` join the learned ones."""
    found = _sampled(docs, labels, sample)
    sizes = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({}, exceptions, (40.0 if 1 in sizes else -40.0, 0.0, 0.0))
    # Near copies would make any of their words look telling: one text per group of copies and class counts.
    single = _distinct(found)
    kinds = {r.toxic: r.n for r in single.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic = _counted(single.where("toxic = 1")).where(F.col("n") >= min(LEAST_SUPPORT, max(1, kinds[1] // 4)))
    clean = _counted(single.where("toxic = 0")).select("term", F.col("n").alias("m"))
    log_odds = F.log((F.col("n") + 0.5) / (kinds[1] + 1)) - F.log((F.coalesce("m", F.lit(0)) + 0.5) / (kinds[0] + 1))
    weighed = toxic.join(clean, "term", "left").select("term", log_odds.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    kept = weighed.orderBy(F.col("weight").desc(), "term").limit(terms).collect()
    lexicon = Lexicon({r.term: round(r.weight, 6) for r in kept}, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(lexicon.terms))
    phrases = lambda text: phrases_of(text, shared.value)
    safe = _counted(single.where("toxic = 0"), phrases).where(F.col("n") >= LEAST_SUPPORT)
    harmful = _counted(single.where("toxic = 1"), phrases).select("term", F.col("n").alias("m"))
    even = F.col("n") * kinds[1] >= F.coalesce("m", F.lit(0)) * kinds[0]
    spared = safe.join(harmful, "term", "left").where(even).orderBy(F.col("n").desc(), "term").limit(EXCEPTIONS).collect()
    lexicon.exceptions = tuple(sorted({*exceptions, *(r.term for r in spared)}))
    rows = totals(found.select(F.col("toxic").cast("bigint").alias("doc_id"), "text"), lexicon).collect()  # the sample: bounded
    lexicon.curve = _curve(np.array([[r.total, r.words, r.doc_id] for r in rows], float))
    return lexicon


def _curve(rows: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; rows are (total, words, toxic)."""
    rows = rows[np.lexsort(rows.T)]
    x = np.column_stack((np.ones(len(rows)), np.log1p(rows[:, 0]), np.log1p(1000 * rows[:, 0] / np.maximum(1, rows[:, 1]))))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (rows[:, 2] - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 9) for v in w)


def totals(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, total (sum of weights), words, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    out = pa.schema([("doc_id", pa.int64()), ("total", pa.float64()), ("words", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        match = lex.matcher()

        def rows() -> Iterator[tuple]:
            for doc_id, text in text_rows(batches, "doc_id", "text"):
                total, words = match(text)
                yield doc_id, total, words, lex.score(total, words)

        yield from in_batches(rows(), out, 5000)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, total double, words long, score double")


def kept(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are: one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        match = lex.matcher()
        for batch in batches:
            clean = [lex.score(*match(t)) < threshold for (t,) in text_rows(iter([batch]), "text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(bucket(F.col("doc_id"), 3) != 1)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs`` by a lexicon learned from the training rows of ``labels``."""
    result = totals(docs, learn(docs, training_labels(labels)))
    return result.select(
        "doc_id", F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "total", "words"
    )
