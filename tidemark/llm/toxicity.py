"""Toxicity scores of texts after noisy-channel deobfuscation.

A word that looks tampered with (digits or signs among letters, letters repeated three times, letters spaced
out) is read as a lattice: each sign may be itself, a letter it stands for, or nothing.  The Viterbi
algorithm finds the letters that are likeliest under the channel's costs and a character language model of
order four, whose counts are gathered from every word of the corpus.  The restored words are scored by a
logistic regression on terms (words, and their first four and five letters) chosen for how strongly they
go with the label.

The model is learned from at most MAX_ROWS labelled rows, those with the smallest hashes of their ids; rows
held out (crc32 of the id as text, modulo 3, is 1) are never among them.  Everything else covers
all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, identified, pieces, texts_of, written

MAX_ROWS = 50_000
MAX_TERMS = 500
#: a term is considered if so many toxic rows hold it
LEAST_ROWS = 3
THRESHOLD = 0.7
PREFIXES = (4, 5)
FLUSH_TERMS = 200_000  # terms counted in a task before it hands them on
MEMO_ENTRIES = 400_000  # a memo, not a bound on the data

#: symbols of the language model: 0 ends a word, 1-26 are a-z, 27 is any other letter
SYMBOLS, OTHER = 28, 27
LAST_TABLED = 0x250

#: fixed values: letters that a sign may stand for
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
    "*": "aeiou",
}
#: costs of the channel, in nats
AS_LETTER, AS_ITSELF, SKIPPED, REPEATED = 1.0, 4.0, 0.7, 0.7
EDGE_SIGNS = ".,;:?!\"'()[]{}<>#%&*~_-=/\\|^`…“”«»„"
GAPS = set(".-_*~'·•,:;/\\ ")
THRICE = re.compile(r"(.)\1\1")
#: signs behind a word: a run of three or more equal ones, or signs that stand for no letter
LEAD = re.compile(r"^[.,;:?\"')\]}>#%&~_\-=/\\^`…\[{]+")
TAIL = re.compile(r"(?:([^\w\s])\1\1+|[.,;:?!\"')\]}>#%&~_\-=/\\^`…\[{]+)+$")


def symbol_table() -> np.ndarray:
    """LM symbol of each code point below LAST_TABLED; signs and digits are 0."""
    out = np.zeros(LAST_TABLED + 1, dtype=np.int32)
    for code in range(LAST_TABLED):
        c = chr(code).lower()[:1]
        if c.isalpha():
            out[code] = ord(c) - 96 if "a" <= c <= "z" else OTHER
    out[LAST_TABLED] = OTHER
    return out


_TABLE = symbol_table()


@cache
def symbol_of(letter: str) -> int:
    """LM symbol of a sign read as part of a word."""
    return int(_TABLE[min(ord(letter), LAST_TABLED)]) or OTHER


def four_grams(texts: Iterable[str]) -> np.ndarray:
    """Counts of (three symbols before, symbol) over all words, words led and followed by 0."""
    joined = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype="<u4")
    ids = _TABLE[np.minimum(joined, LAST_TABLED)]
    ids = ids[(ids != 0) | (np.r_[1, ids[:-1]] != 0)]
    ids = np.repeat(ids, np.where(ids == 0, 3, 1))
    code = ids[:-3]
    for k in (1, 2, 3):
        code = code * SYMBOLS + ids[k : len(ids) - 3 + k]
    return np.bincount(code, minlength=SYMBOLS**4)


def gram_counts(docs: DataFrame) -> DataFrame:
    """code, n over every text of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, dtype=np.int64)
        for batch in pieces(batches):
            total += four_grams(texts_of(batch))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after three others, flat; SYMBOLS^4 numbers, whatever the corpus."""
    counts = np.zeros(SYMBOLS**4)
    for r in gram_counts(docs).collect():  # at most SYMBOLS^4 rows
        counts[r["code"]] = r["n"]
    return smoothed(counts)


def smoothed(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Each order leans on the next lower one with the given weight, the lowest on a uniform distribution."""
    level = counts.reshape((SYMBOLS,) * 4)
    orders = [level]
    for _ in range(3):
        level = level.sum(axis=0)
        orders.append(level)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for c in reversed(orders):
        p = (c + weight * p) / (c.sum(axis=-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32).ravel()


class Restorer:
    """Reads tampered words back under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    @staticmethod
    def choices(word: str, at: int) -> list[tuple[str, float]]:
        """What the sign at a place may be: (letter or nothing, cost)."""
        c = word[at]
        out = []
        if c in STANDS_FOR:
            letters = STANDS_FOR[c]
            out += [(x, AS_LETTER + math.log(len(letters))) for x in letters]
        if c in GAPS or not (c.isalnum() or c in STANDS_FOR):
            out.append(("", SKIPPED))
        else:
            out.append((c, 0.0 if c.isalpha() else AS_ITSELF))
        if at and c == word[at - 1]:
            out.append(("", REPEATED))
        return out

    def decode(self, word: str) -> str:
        """The likeliest letters behind a word."""
        m, cube = self.model, SYMBOLS**3
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for at in range(len(word)):
            after: dict[int, tuple[float, tuple | None]] = {}
            for letter, cost in self.choices(word, at):
                symbol = symbol_of(letter) if letter else 0
                for context, (score, path) in paths.items():
                    if letter:
                        grams = context * SYMBOLS + symbol
                        entry, key = (score - cost + m[grams], (path, letter)), grams % cube
                    else:
                        entry, key = (score - cost, path), context
                    if key not in after or entry[0] > after[key][0]:
                        after[key] = entry
            paths = after
        _, path = max(((s + m[c * SYMBOLS], p) for c, (s, p) in paths.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def restore(self, word: str) -> str:
        """A lower-case word without signs around it, read back if it looks tampered with."""
        core = word.strip(EDGE_SIGNS)
        if core.isalpha() and not THRICE.search(core):
            return core
        whole = LEAD.sub("", TAIL.sub("", word))
        if whole.isalpha() and not THRICE.search(whole):
            return whole
        if sum(map(str.isalpha, whole)) < 2 and not (len(whole) > 3 and any(map(str.isalpha, whole))):
            return core
        return self.decode(whole)


def spaced_out(words: list[str]) -> list[str]:
    """Runs of three or more single letters or signs that stand for one, joined.

    The first or the last of a longer run may be a word of its own ("a", "i"): the run without it counts too.
    """
    single = [i for i, w in enumerate(words) if len(w) == 1 and (w.isalpha() or w in STANDS_FOR)]
    out: list[str] = []

    def closed(run: list[int]) -> None:
        if len(run) > 2:
            whole = "".join(words[j] for j in run)
            out.extend([whole, whole[1:], whole[:-1]] if len(run) > 3 else [whole])

    run: list[int] = []
    for i in single:
        if run and i != run[-1] + 1:
            closed(run)
            run = []
        run.append(i)
    closed(run)
    return out


def terms_of(word: str) -> tuple[str, ...]:
    """A restored word, marked at its end, and its first letters."""
    return (word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)) if word else ()


class TermReader:
    """Distinct terms of texts.  known: terms that matter, with their numbers; None for all."""

    def __init__(self, model: np.ndarray, known: dict[str, int] | None = None):
        self.restorer, self.known = Restorer(model), known
        self.memo: dict[str, tuple] = {}

    def of_word(self, word: str) -> tuple:
        restored = self.restorer.restore(word)
        terms = terms_of(restored)
        if self.known is not None:
            terms = tuple(self.known[t] for t in terms if t in self.known)
        return terms, restored != word.strip(EDGE_SIGNS)

    def read(self, text: str) -> tuple[set, int]:
        """The text's terms and how many different words were read back."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {}
        memo, words = self.memo, text.lower().split()
        distinct = set(words)
        distinct.update(spaced_out(words))
        for w in distinct:
            if w not in memo:
                memo[w] = self.of_word(w)
        terms: set = set()
        restored = 0
        for found, changed in map(memo.__getitem__, distinct):
            if found:
                terms.update(found)
            restored += changed
        return terms, restored


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; rows without an id are scored only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic of at most `most` labelled rows.  A document that any of its labels calls toxic is toxic."""
    open_rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = open_rows.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    # the bound makes it safe to broadcast: an id and a label each
    chosen = written(one.orderBy(F.xxhash64("_doc"), "_doc").limit(most), "labelled")
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    return met.select("doc_id", "text", F.col("_toxic").alias("toxic"))


def term_counts(rows: DataFrame, model) -> DataFrame:
    """term, toxic, clean: how many toxic and other rows hold a term; the term null counts the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(model.value)
        sides: tuple[Counter, Counter] = (Counter(), Counter())

        def handed_on() -> pa.RecordBatch:
            names = list(sides[0].keys() | sides[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([s[n] for n in names], pa.int64()) for s in reversed(sides)]],
                ["term", "toxic", "clean"],
            )

        for batch in pieces(batches):
            for text, toxic in zip(texts_of(batch), column(batch, "toxic").to_pylist(), strict=True):
                side = sides[toxic > 0]
                side.update(reader.read(text)[0])
                side[None] += 1
            if len(sides[0]) + len(sides[1]) > FLUSH_TERMS:
                yield handed_on()
                sides = (Counter(), Counter())
        yield handed_on()

    counted = rows.mapInArrow(run, "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling_terms(counts: DataFrame, most: int) -> list[str]:
    """The terms that go with the label most, by the log-likelihood ratio of their counts; at most `most`."""
    rows = counts.where("term is null").first()
    if rows is None or not rows["toxic"] or not rows["clean"]:
        return []
    t, c = float(rows["toxic"]), float(rows["clean"])

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / (t + c)
    ratio = part(a, t * share) + part(b, c * share) + part(t - a, t * (1 - share)) + part(c - b, c * (1 - share))
    chosen = counts.where(F.col("term").isNotNull() & (a >= LEAST_ROWS) & (a * c > b * t)).select("term", ratio.alias("ratio"))
    return [r["term"] for r in chosen.orderBy(F.desc("ratio"), "term").limit(most).collect()]


@dataclass(frozen=True)
class Model:
    letters: np.ndarray
    terms: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, numbers: set[int]) -> float:
        z = self.bias + float(sum(self.weights[i] for i in numbers))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(rows: list[tuple[int, list[int]]], n_terms: int, penalty: float = 2e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of terms, by full-batch Adam steps."""
    y = np.array([r[0] for r in rows], dtype=float)
    if not len(y):
        return np.zeros(n_terms), 0.0
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    term = np.fromiter((i for r in rows for i in r[1]), dtype=np.int64, count=len(row))
    w = np.zeros(n_terms + 1)
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, weights=w[term], minlength=len(y))
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        slope = np.r_[np.bincount(term, weights=off[row], minlength=n_terms), off.sum()] / len(y)
        slope[:-1] += penalty * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= 0.1 * (1 - k / (rounds + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MAX_ROWS, most_terms: int = MAX_TERMS) -> Model:
    """Language model from all of docs, classifier from its labelled rows that are not held out."""
    context = docs.sparkSession.sparkContext
    letters = language_model(docs)
    shared = context.broadcast(letters)
    rows = training_rows(docs, labels, most_rows)
    counts = term_counts(rows, shared).where((F.col("toxic") >= LEAST_ROWS) | F.col("term").isNull())
    terms = {t: i for i, t in enumerate(telling_terms(written(counts, "terms"), most_terms))}
    known = context.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(shared.value, known.value)
        for batch in pieces(batches):
            found = [sorted(reader.read(t)[0]) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "toxic"), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "toxic", "terms"],
            )

    # at most most_rows rows of a few numbers each
    examples = rows.mapInArrow(run, "doc_id bigint, toxic int, terms array<int>").collect()
    examples.sort(key=lambda r: (r["doc_id"], r["terms"]))
    weights, bias = fit([(int(r["toxic"] > 0), r["terms"]) for r in examples], len(terms))
    return Model(letters, terms, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted, n_restored of every row of docs.

    score is the estimated probability of the label; predicted is 1 from the threshold on.  n_restored counts the
    text's different words that were read back as something else.  Null and empty texts get the score
    of a text without any telling term.  Repeated rows give repeated results; an empty table gives an
    empty result; columns besides doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        reader = TermReader(known.letters, known.terms)
        for batch in pieces(batches):
            found = [reader.read(t) for t in texts_of(batch)]
            scores = [known.score(terms) for terms, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    column(batch, "text_hash"),
                    column(batch, "held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([n for _, n in found], pa.int32()),
                ],
                ["doc_id", "text_hash", "held_out", "score", "predicted", "n_restored"],
            )

    rows = identified(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text_hash", held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return rows.mapInArrow(
        run, "doc_id bigint, text_hash bigint, held_out boolean, score double, predicted int, n_restored int"
    )
