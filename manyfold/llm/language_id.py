"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. A language is a probability for every piece; the probability of a word is
the sum over all ways to cut it into pieces, by the forward algorithm, and that of a text the product over its words.
Words are runs of letters (``str.isalpha``) in lower case, in stretches of at most 32, with the space mark in front of a run's begin;
a letter that is no piece by itself has a fixed small probability in all languages.

Probabilities are learned by expectation maximisation over all labelled rows. Their words are counted per language first,
so a round costs as much as there are different words. Every label is a language, so the model is labels x pieces numbers,
which is what is broadcast.

The prediction is the likeliest language, the first in code point order of equals; the score is its posterior
probability with equal priors. Texts that are null or have no letter get ``und`` and 0. Rows with a null id or label
teach nothing. Every row gets a prediction, repeated ones too, an empty table an empty one. Without any label every text is
``und`` with 0, and nothing is rejected: what cannot be judged stays.

A posterior says which language is likeliest, not that a text is in any of them: it is near 1 for every longer text. So
documents are kept by their fit too: the log probability per letter under the winner, against that of all labelled texts.
Deviations shrink with the root of the letters, up to ``LETTERS`` of them; beyond, texts differ by their content.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from manyfold.llm.common import fresh
from manyfold.llm.pieces import CACHE, SPACE_MARK, Lattice, groups, vocabulary
from manyfold.sources.settled import settle

RUN = re.compile(r"[^\W\d_]+")
STRETCH = 32
MORE = "-"
UNKNOWN = 1e-8
SMOOTHING = 0.05
ROUNDS = 3
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
#: Numbers that a worker keeps of known words.
KNOWN = 8_000_000
#: A text fits if it lies at most so many deviations below its language's mean.
DEVIATIONS, LETTERS = 10.0, 500
#: A deviation is at least so large, and every language's is drawn to that of all by so many texts.
LEAST_DEVIATION, DRAWN = 2.0, 20


def letter_runs(text: str) -> Iterator[str]:
    """Runs of letters; number signs that count as word characters (fractions, Roman numerals) part them."""
    for run in RUN.findall(text):
        if run.isalpha():
            yield run
        else:
            yield from ("".join(part) for is_letter, part in groupby(run, str.isalpha) if is_letter)


def keys_of(text: str | None) -> list[str]:
    """Short names of the words of a text: a run without its space mark; what goes on with a run has MORE in front."""
    if not text:
        return []
    text = text.lower()
    runs = RUN.findall(text)
    # Nearly every text has only runs of letters, shorter than a stretch.
    if "".join(runs).isalpha() and max(map(len, runs)) < STRETCH:
        return runs
    out = []
    for run in letter_runs(text):
        out.append(run[: STRETCH - 1])
        out.extend(MORE + run[k : k + STRETCH] for k in range(STRETCH - 1, len(run), STRETCH))
    return out


def word_of(key: str) -> str:
    return key[1:] if key[0] == MORE else SPACE_MARK + key


def words_of(text: str | None) -> list[str]:
    return list(map(word_of, keys_of(text)))


class Sums:
    """Forward and backward sums over the segmentations of words under probabilities ``p[piece, language]``."""

    def __init__(self, path: str, words: list[str], p: np.ndarray):
        self.lattice = x = Lattice(path, words)
        self.start = np.concatenate([x.start, x.unknown - 1])
        self.end = np.concatenate([x.end, x.unknown])
        depth = np.concatenate([x.depth, x.unknown_depth])
        weight = np.concatenate([p[x.piece], np.full((len(x.unknown), p.shape[1]), UNKNOWN)])
        self.order = np.lexsort((self.end, depth))
        self.start, self.end, self.weight = self.start[self.order], self.end[self.order], weight[self.order]
        depth = depth[self.order]
        self.bounds = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]]) if len(depth) else np.zeros(1, int)
        self.forward = np.zeros((x.size, p.shape[1]))
        self.forward[x.base] = 1.0
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            ends = self.end[a:b]
            first = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1])
            self.forward[ends[first]] = np.add.reduceat(self.forward[self.start[a:b]] * self.weight[a:b], first, axis=0)

    def logs(self) -> np.ndarray:
        return np.log(self.forward[self.lattice.last])

    def expected(self, times: np.ndarray) -> np.ndarray:
        """Expected uses of every match, for words that come so many times in every language."""
        x = self.lattice
        backward = np.zeros_like(self.forward)
        whole = self.forward[x.last]
        backward[x.last] = times / whole
        uses = np.zeros_like(self.weight)
        for a, b in zip(self.bounds[-2::-1], self.bounds[:0:-1]):
            sent = backward[self.end[a:b]] * self.weight[a:b]
            uses[a:b] = sent * self.forward[self.start[a:b]]
            np.add.at(backward, self.start[a:b], sent)
        back = np.empty_like(uses)
        back[self.order] = uses
        return back[: len(x.piece)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages in code point order, and the rows that teach them, with lang as text."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    return sorted(r.lang for r in rows.select("lang").distinct().collect()), rows


def learn(languages: list[str], rows: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """p[piece, language] from columns lang and text of the labelled rows."""
    n_pieces = len(vocabulary(path)[0])
    if not languages:
        return np.zeros((n_pieces, 0))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(map(word_of, words)), pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs = batch.column(0).to_pylist()
            for first, last in groups(texts):
                for lang, text in zip(langs[first:last], texts[first:last]):
                    seen.setdefault(lang, Counter()).update(keys_of(text))
                if sum(map(len, seen.values())) >= COUNTED:
                    yield from out()
        yield from out()

    counts = rows.select("lang", "text").mapInArrow(tally, "lang string, word string, n long")
    counts = settle(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    place = {lang: k for k, lang in enumerate(languages)}
    p = np.full((n_pieces, len(languages)), 1.0 / n_pieces)
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            total = np.zeros(known.shape)
            for batch in batches:
                langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                words, times = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for lang in np.unique(langs):
                    own = np.flatnonzero(langs == lang)
                    for at in range(0, len(own), 20_000):
                        some = own[at : at + 20_000]
                        sums = Sums(path, [words[k] for k in some], known[:, lang : lang + 1])
                        uses = sums.expected(times[some][:, None].astype(float))
                        total[:, lang] += np.bincount(sums.lattice.piece, uses[:, 0], len(known))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "uses"])

        sums = counts.mapInArrow(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        found = sums.toPandas()
        p = np.full((n_pieces, len(languages)), SMOOTHING)
        p[found["piece"].to_numpy(np.int64), found["lang"].to_numpy(np.int64)] += found["uses"].to_numpy(float)
        p /= p.sum(axis=0)
    return p


class Known:
    """The log probabilities of words under every language, as far as a worker has met them."""

    def __init__(self, languages: int):
        self.place: dict[str, int] = {}
        self.logs = np.empty((min(CACHE, KNOWN // max(1, languages)), languages))


@lru_cache(maxsize=1)
def known_words(model: str, languages: int) -> Known:
    """What a worker knows under a model; it stays for the worker's next task, until another model is asked for."""
    return Known(languages)


def predictor(spark: SparkSession, languages: list[str], p: np.ndarray, path: str):
    """A function of a text column that gives a struct of lang_pred, score, fit (null for ``und``) and letters."""
    model, name = spark.sparkContext.broadcast(p), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double, fit double, letters long")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        store = known_words(name, len(languages))
        known = store.place
        for batch in batches:
            texts = batch.tolist()
            best, sure, fit, letters = [], [], [], []
            for first, last in groups(texts):
                words = [keys_of(t) if languages else [] for t in texts[first:last]]
                every = list(chain.from_iterable(words))
                numbers = list(map(known.get, every))
                lacking = [k for k, number in enumerate(numbers) if number is None]
                new = list({every[k] for k in lacking})
                if len(known) + len(new) > len(store.logs):
                    known.clear()
                    lacking, new = range(len(every)), list(set(every))
                    if len(new) > len(store.logs):
                        store.logs = np.empty((len(new), len(languages)))
                logs = store.logs
                for at in range(0, len(new), 20_000):
                    some = new[at : at + 20_000]
                    logs[len(known) : len(known) + len(some)] = Sums(path, list(map(word_of, some)), model.value).logs()
                    known.update(zip(some, range(len(known), len(known) + len(some))))
                for k in lacking:
                    numbers[k] = known[every[k]]
                places, end = np.array(numbers, np.int64), 0
                for own in words:
                    end += len(own)
                    sizes = list(map(len, own))
                    # A space mark for every run, and none for what goes on with one, after a key of full length.
                    more = sum(key[0] == MORE for key in own) if max(sizes, default=0) >= STRETCH - 1 else 0
                    letters.append(sum(sizes) + len(own) - 2 * more)
                    if not own:
                        fit.append(np.nan)
                        best.append("und")
                        sure.append(0.0)
                        continue
                    total = logs[places[end - len(own) : end]].sum(axis=0)
                    top = int(np.argmax(total))
                    best.append(languages[top])
                    fit.append(float(total[top]) / letters[-1])
                    sure.append(float(1.0 / np.exp(total - total[top]).sum()))
            yield pd.DataFrame({"lang_pred": best, "score": sure, "fit": fit, "letters": letters})

    return predicted


def identify(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those not held out."""
    languages, rows = labelled(docs.filter(~held_out()))
    p = learn(languages, rows, path, rounds)
    judged = docs.select("doc_id", held_out().alias("held_out"), predictor(docs.sparkSession, languages, p, path)("text").alias("p"))
    return judged.select("doc_id", "held_out", "p.lang_pred", "p.score")


def usual_fits(texts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the fit of every language, from columns lang and p of the labelled texts, predicted."""
    known = texts.filter(F.col("lang") == F.col("p.lang_pred")).select("lang", "p.fit", F.least("p.letters", F.lit(LETTERS)).alias("n"))
    sums = [F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.sum(F.col("fit") * F.col("n")).alias("x"), F.sum(F.col("fit") ** 2 * F.col("n")).alias("xx")]
    rows = known.groupBy("lang").agg(*sums).collect()
    # The sum of squares of deviations times the root of the letters.
    squares = {r.lang: max(0.0, r.xx - r.x * r.x / r.n) for r in rows}
    overall = max(LEAST_DEVIATION**2, sum(squares.values()) / max(1, sum(r.texts for r in rows)))
    return {r.lang: (r.x / r.n, max(LEAST_DEVIATION, ((squares[r.lang] + DRAWN * overall) / (r.texts + DRAWN)) ** 0.5)) for r in rows}


def keep_known_languages(docs: DataFrame, path: str, least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """The documents, with all their columns, that fit a language, and that one with a posterior of at least ``least``."""
    languages, rows = labelled(docs.filter(~held_out()))
    if not languages:
        return docs
    judge = predictor(docs.sparkSession, languages, learn(languages, rows, path, rounds), path)
    name = fresh(docs, "language")
    # Every text is predicted once, for the usual fits and for its own verdict.
    judged = settle(docs.withColumn(name, judge("text")), "languages")
    usual = usual_fits(labelled(judged.filter(~held_out()))[1].select("lang", F.col(name).alias("p")))
    own = F.col(name)
    fits = F.lit(True)
    for lang, (mean, deviation) in usual.items():
        away = (F.lit(mean) - own["fit"]) * F.sqrt(F.least(own["letters"], F.lit(LETTERS)))
        fits = F.when(own["lang_pred"] == lang, away <= DEVIATIONS * deviation).otherwise(fits)
    return judged.filter((own["lang_pred"] != "und") & (own["score"] >= least) & fits).drop(name)
