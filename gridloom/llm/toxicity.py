"""Toxicity by weak supervision.

1. Voters, each voting "toxic" where it matches, else "clean". Lexicons: several independent lists of insults, threats and abuse in four languages. Patterns: a person
   addressed with a word of a lexicon, shouted words, runs of exclamation marks. Keywords: whole words and word stems of 4 to 6 bytes that are far more frequent in toxic than in other training rows
   (lists know no invented or misspelt words). Labels propose the keywords and give the share of toxic rows; nothing else.
2. A generative label model estimates, by expectation maximisation on the votes alone, each voter's rates in the two classes. It starts from the votes' own frequencies.
   Correlations between voters, given the class, are estimated too; strong ones divide a voter's evidence among those that say the same.
3. A linear (logistic) classifier over the words, stems and patterns learns the model's posterior labels and scores every whole text.

At most ``MOST_LABELLED`` labelled documents are used, those of smallest hash of doc_id; held-out documents never are. The driver gets at most ``MOST_LABELLED`` rows of ``FEATURES`` numbers of four bytes
(655 MB if every row had every feature; a few per cent of that in fact); the model that is broadcast has ``FEATURES`` rows of 16 bytes.

Cases: null and empty texts get the score of a text without patterns; a null doc_id is not held out; repeated labels count as toxic if any
does; labels that are null or without a document are ignored; with no toxic training document every score is 0. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import HELD_OUT_FOLD, fold
from .shared import Prefix, chunks, lower, materialise, text_arrays, tidy

#: Labelled documents used, voters, features of the classifier, fewest toxic documents with a pattern, score of a toxic verdict.
MOST_LABELLED, VOTERS, FEATURES, LEAST, THRESHOLD = 40_000, 384, 4096, 5, 0.3
#: Correlation, given the class, from which two voters are taken to depend on each other.
DEPENDENT = 0.6
#: A keyword is at most so frequent in clean rows, for its frequency in toxic ones.
PURE = 0.1
#: The words of the lexicon voters, and those that address a person.
LEXICONS = {
    "wits": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "dumb", "imbecile", "fool", "foolish", "halfwit", "dimwit", "brainless"),
    "worth": ("loser", "losers", "pathetic", "worthless", "useless", "failure", "nobody", "coward", "creep", "weakling", "reject"),
    "dirt": ("scum", "trash", "garbage", "filth", "filthy", "disgusting", "vermin", "pig", "pigs", "maggot", "dirtbag", "scumbag"),
    "mockery": ("clown", "clowns", "joke", "laughable", "jerk", "freak", "freaks", "weirdo", "lunatic", "psycho", "crybaby"),
    "abuse": ("damn", "crap", "bastard", "bastards", "arse", "asshole", "bitch", "whore", "slut", "shit", "fuck", "fucking"),
    "threats": ("kill", "killed", "shoot", "stab", "murder", "destroy", "suffer", "strangle", "beat", "hurt"),
    "german": ("dumm", "dummkopf", "blöd", "blödmann", "depp", "trottel", "abschaum", "versager", "dreck", "drecksau", "idiot", "schwachkopf", "arschloch", "wertlos", "widerlich"),
    "french": ("idiot", "idiote", "crétin", "imbécile", "débile", "stupide", "ordure", "déchet", "minable", "connard", "salaud", "pourriture", "lâche", "répugnant"),
    "spanish": ("idiota", "imbécil", "estúpido", "estúpida", "tonto", "basura", "escoria", "patético", "inútil", "cabrón", "mierda", "payaso", "asqueroso", "cobarde", "perdedor"),
}
PERSONS = ("you", "your", "youre", "du", "dein", "ihr", "tu", "toi", "vous", "ton", "usted", "eres")
#: Names of the pattern voters; words between a person and a lexicon's word, shouted words and letters of one, marks of a run.
PATTERNS, NEAR, SHOUTED, LETTERS, RUN = ("addressed", "shouted", "exclaimed"), 3, 3, 4, 3
STEMS = (4, 5, 6)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def patterns(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), sorted and distinct: words and stems of each text, lower-cased, as 64-bit hashes, and the marks of lexicons and patterns."""
    low = lower(data)
    inside = _WORD_BYTE[low]
    before = np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(low)]] = False
    after = np.zeros(len(low), bool)
    after[:-1] = inside[1:]
    cut = offsets[1:-1]
    after[cut[cut > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    prefix = Prefix(low)
    keys, rows = [prefix.hash(starts, ends)], [row]
    for size in STEMS:
        long = ends - starts > size
        keys.append(prefix.hash(starts[long], starts[long] + size) ^ np.uint64(size))
        rows.append(row[long])
    for k, r in marks(data, offsets, keys[0], row, starts, ends):
        keys.append(k)
        rows.append(r)
    key, row = np.concatenate(keys), np.concatenate(rows)
    # One hash of (row, key) sorts faster than two keys; rows of a chunk are few.
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[fresh], key[fresh]


@functools.cache
def _lexicon() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all lexicons' words; (word, lexicon) flags; sorted hashes of words for persons."""
    hashed = lambda words: Prefix(d := text_arrays(c := pa.array(words))[0]).hash((o := text_arrays(c)[1])[:-1], o[1:]) if len(words) else d  # noqa: E731, F821
    every = np.unique(np.concatenate([hashed(w) for w in LEXICONS.values()]))
    flags = np.stack([np.isin(every, hashed(w)) for w in LEXICONS.values()], 1)
    return every, flags, np.sort(hashed(PERSONS))


def mark_key(name: str) -> np.uint64:
    """The key of a lexicon or pattern."""
    return Prefix(np.frombuffer(f"\x00{name}".encode(), np.uint8)).hash(np.array([0]), np.array([len(name) + 1]))[0]


def marks(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, rows) of lexicons and patterns that match; key, row, starts and ends are the words'."""
    every, flags, persons = _lexicon()
    n = len(offsets) - 1
    found = np.flatnonzero(_member(every, key))
    if len(found):
        which = flags[np.searchsorted(every, key[found])]
        for k, name in enumerate(LEXICONS):
            r = np.unique(row[found[which[:, k]]])
            yield np.full(len(r), mark_key(name)), r
        addressed = np.zeros(n, bool)
        for back in range(1, NEAR + 1):
            at = found[found >= back]
            at = at[(row[at - back] == row[at]) & _member(persons, key[at - back])]
            addressed[row[at]] = True
        r = np.flatnonzero(addressed)
        yield np.full(len(r), mark_key("addressed")), r
    capital = (data >= 65) & (data <= 90)
    loud = np.concatenate([[0], np.cumsum(capital)])
    long = ends - starts
    times = np.bincount(row[(long >= LETTERS) & (loud[ends] - loud[starts] == long)], minlength=n)
    r = np.flatnonzero(times >= SHOUTED)
    yield np.full(len(r), mark_key("shouted")), r
    run = data == 33
    for _ in range(RUN - 1):
        run = run[:-1] & (data[len(data) - len(run) + 1 :] == 33) if len(run) > 1 else run[:0]
    at = np.flatnonzero(run)
    first = np.searchsorted(offsets, at, "right") - 1
    r = np.unique(first[at + RUN <= offsets[first + 1]]) if len(at) else at
    yield np.full(len(r), mark_key("exclaimed")), r


def _count(wanted):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            for a, b in chunks(offsets):
                _, key = patterns(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if wanted is not None:
                    key = key[_member(wanted.value, key)]
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return count


def _member(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(key), bool)
    return table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key


def _features(wanted):
    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            out = []
            for a, b in chunks(offsets):
                row, key = patterns(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hit = _member(table, key)
                at, cols = row[hit], np.searchsorted(table, key[hit])
                out += np.split(cols, np.searchsorted(at, np.arange(1, b - a)))
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(out, pa.list_(pa.int32()))], ["toxic", "hits"])

    return rows


def first_guess(votes: np.ndarray, prior: float) -> np.ndarray:
    """P(vote | toxic) and P(vote | clean), shape (2, voters), if nine votes in ten were cast for toxic rows; a voter with more votes than there are toxic rows says nothing at first."""
    mean = votes.mean(0, dtype=np.float64)
    return np.where(mean <= prior, np.stack([0.9 * mean / prior, 0.1 * mean / (1 - prior)]), mean)


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row of a 0/1 vote matrix, the voters' rates by class, and their correlations; no label is used.

    ``start`` holds first guesses of P(vote | toxic) and P(vote | clean), shape (2, voters).
    """
    floor = 0.05 / len(votes)
    rate, weight = np.clip(start, floor, 1 - floor), np.ones(votes.shape[1])
    post, together = np.full(len(votes), prior), np.eye(votes.shape[1])
    # Second moments of the votes; those about the model's means follow from them, without another matrix of that size.
    n = len(votes)
    moments = (votes.T @ votes).astype(np.float64)
    for step in range(rounds):
        on, off = weight * np.log(rate[0] / rate[1]), weight * np.log((1 - rate[0]) / (1 - rate[1]))
        evidence = votes @ (on - off).astype(votes.dtype) + off.sum()
        new = 1 / (1 + np.exp(-np.clip(evidence.astype(np.float64) + np.log(prior / (1 - prior)), -40, 40)))
        done = step > 2 and np.abs(new - post).max() < 1e-5
        post = new
        hit = [(w.astype(votes.dtype) @ votes).astype(np.float64) for w in (post, 1 - post)]
        for c, w in enumerate((post, 1 - post)):
            rate[c] = np.clip((hit[c] + 0.05) / (w.sum() + 0.1), floor, 1 - floor)
        with_means = np.outer(hit[0], rate[0]) + np.outer(hit[1], rate[1])
        both = (post * (1 - post)).sum()
        means = (post**2).sum() * np.outer(rate[0], rate[0]) + ((1 - post) ** 2).sum() * np.outer(rate[1], rate[1]) + both * (np.outer(rate[0], rate[1]) + np.outer(rate[1], rate[0]))
        covariance = (moments - with_means - with_means.T + means) / n
        spread = np.sqrt(np.maximum(np.diag(covariance), 0)) + 1e-9
        together = covariance / np.outer(spread, spread)
        weight = 1 / np.maximum(1.0, np.where(together >= DEPENDENT, together, 0).sum(1))
        if done:
            break
    return post, rate, together


def logistic(rows: np.ndarray, cols: np.ndarray, n_cols: int, target: np.ndarray, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse 0/1 rows, by gradient steps with per-weight scaling."""
    w, bias, n = np.zeros(n_cols), 0.0, len(target)
    square, square_bias = np.full(n_cols, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], minlength=n) + bias, -40, 40)))
        slope = p - target
        g = np.bincount(cols, slope[rows], minlength=n_cols) / n + penalty * w
        square += g * g
        square_bias += slope.mean() ** 2
        w -= 0.5 * g / np.sqrt(square)
        bias -= 0.5 * slope.mean() / np.sqrt(square_bias)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature keys, their weights, and the bias."""
    spark = docs.sparkSession
    none = np.zeros(0, np.uint64), np.zeros(0), -40.0
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.where(fold(F.col("label_id")) != HELD_OUT_FOLD).orderBy(F.xxhash64("label_id"), "label_id").limit(most_labelled)
    # The bound of this broadcast is most_labelled rows of two numbers.
    texts = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", F.col("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic = sum(n for t, n in sizes.items() if t == 1)
    n_clean = sum(sizes.values()) - n_toxic
    if not n_toxic or not n_clean:
        return none
    toxic, clean = texts.where("toxic = 1").select("text"), texts.where("toxic <> 1").select("text")
    counted = lambda df, wanted: df.mapInArrow(_count(wanted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(2, min(LEAST, n_toxic // 10))
    often = counted(toxic, None).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(16 * FEATURES).toArrow()
    if not often.num_rows:
        return none
    keys = np.sort(often["key"].to_numpy().view(np.uint64))
    pos = np.zeros(len(keys))
    pos[np.searchsorted(keys, often["key"].to_numpy().view(np.uint64))] = often["n"].to_numpy()
    other = counted(clean, spark.sparkContext.broadcast(keys)).toArrow()
    neg = np.zeros(len(keys))
    neg[np.searchsorted(keys, other["key"].to_numpy().view(np.uint64))] = other["n"].to_numpy()
    p, q = (pos + 0.05) / (n_toxic + 0.1), (neg + 0.5) / (n_clean + 1)
    gain = np.where(p > q, p * np.log(p / q), 0)
    fixed = np.array([mark_key(x) for x in (*LEXICONS, *PATTERNS)])
    best = np.sort(np.lexsort((keys, -gain))[: FEATURES - len(fixed)])
    best = best[(gain[best] > 0) & ~np.isin(keys[best], fixed)]
    words, ahead = keys[best], gain[best]
    # Keywords: rare among clean rows.
    precise = neg[best] / n_clean <= PURE * pos[best] / n_toxic
    voting = words[precise][np.lexsort((words[precise], -ahead[precise]))[:VOTERS]]
    keys = np.sort(np.concatenate([words, fixed]))
    hits = texts.mapInArrow(_features(spark.sparkContext.broadcast(keys)), "toxic int, hits array<int>").select("hits").toArrow()["hits"].combine_chunks()
    at = hits.offsets.to_numpy()
    rows, cols = np.repeat(np.arange(len(hits)), np.diff(at)), hits.flatten().to_numpy()
    voters = np.searchsorted(keys, np.concatenate([fixed, voting]))
    votes = np.zeros((len(hits), len(voters)), np.float32)
    column = np.full(len(keys), -1)
    column[voters] = np.arange(len(voters))
    cast = column[cols] >= 0
    votes[rows[cast], column[cols[cast]]] = 1
    prior = n_toxic / (n_toxic + n_clean)
    post, _, _ = label_model(votes, first_guess(votes, prior), prior)
    w, bias = logistic(rows, cols, len(keys), post)
    return keys, w, bias


def _score(model):
    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, w, bias = model.value
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            total = np.full(len(offsets) - 1, bias)
            for a, b in chunks(offsets):
                row, key = patterns(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hit = _member(keys, key)
                total[a:b] += np.bincount(row[hit], w[np.searchsorted(keys, key[hit])] if len(keys) else None, minlength=b - a)
            p = np.round(1 / (1 + np.exp(-np.clip(total, -40, 40))), 6)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_labelled))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
