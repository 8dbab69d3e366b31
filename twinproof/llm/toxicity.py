"""Toxicity by class-conditional Kneser-Ney models.

Each class (ordinary, toxic) has a normalised model that spells words: the next letter given up to ``ORDER`` - 1
letters before it in the word, in the interpolated form. The top order takes the class's own counts and the orders
below it continuation counts (before how many different letters a group occurs; groups at a word's start keep their
counts), all discounted; the discounted mass, and ``PRIOR`` occurrences more, go to the next shorter context. The
shortest, single letters, back off to counts that both classes share: the numbers of different words that a letter
occurs in, taken from all documents. What neither class has seen is thus judged by backed-off mass alone, and what a
class has seen once moves it little, so rare expressions weigh little.

A document's features are the difference of the two log-likelihoods per word, with its sign, and the square root of
the words' mean excess of that difference over a margin: a few words in a long text stand out from the
style and language of the labelled texts, which move all words a little. A logistic function of both gives the
score. The margin is the one of ``MARGINS`` under which the labels of the rows kept back are likeliest.

Class counts come from about ``SAMPLE_ROWS`` labelled rows (all, if fewer) chosen by a hash of doc_id
and read whole; one in ``FOLDS`` of them is kept back to choose the margin and fit the logistic function. The shared counts
cover every document. Counts and probabilities are Spark tables under 64-bit hashes of the letter
groups. The model sent to the executors holds all groups and contexts of the sample, 12 bytes each.

Defined results: null texts are empty, and a text without words has both features 0; rows with null
labels teach nothing; without labels of both classes, or without rows kept back, every score is the
smoothed share of toxic labels; repeated rows get equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns, cut, once
from twinproof.llm.langid import sampled

SAMPLE_ROWS = 20_000
FOLDS = 4
DISCOUNT = 0.75
PRIOR = 5.0
#: Margins to choose from by the likelihood of the rows kept back from the training rows.
MARGINS = (0.0, 1.0, 2.5, 5.0, 7.5, 10.0, 15.0)
#: Letters of the longest counted groups: a letter and the context before it.
ORDER = 6
CACHED_WORDS = 300_000
LETTERS = re.compile(r"[^\W_]+")
END = "\n"
EMPTY = 0x9E3779B97F4A7C15


def spelled(chunk: str) -> list[str]:
    """The words of a lower-case stretch without white space."""
    return LETTERS.findall(chunk)


class Groups:
    """Hashes of the letter groups of words, which are written with a space before and END after.

    ``at[k][i]`` is the hash of the k letters that end at place i of all words; ``depth`` is the place in the
    word, so a group of k letters lies within its word where k <= depth + 1. Places of depth 0 are spaces.
    """

    def __init__(self, words: list[str], order: int = ORDER):
        joined = "".join([f" {w}{END}" for w in words])
        letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        self.starts = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.depth = np.arange(len(letters)) - self.starts[self.word]
        self.at = [np.full(len(letters), EMPTY, dtype=np.uint64)]
        for _ in range(order):
            before = self.at[-1]
            x = (np.concatenate([before[:1], before[:-1]]) ^ (letters * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            self.at.append(x ^ (x >> np.uint64(32)))

    def context(self, k: int, places: np.ndarray) -> np.ndarray:
        """The hashes of the k - 1 letters before the last one of groups of k letters."""
        return self.at[k - 1][places - 1]

    def places(self, k: int) -> np.ndarray:
        return np.flatnonzero((self.depth > 0) & (self.depth >= k - 1))


def word_types(texts: DataFrame) -> DataFrame:
    """The different words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update((text or "").lower().split())
            if len(seen) > 200_000:
                yield told(seen)
                seen.clear()
        yield told(seen)

    def told(seen: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list({w for chunk in seen for w in spelled(chunk)}), pa.string())], ["word"])

    return texts.mapInArrow(run, "word string").distinct()


def batch_of(names: str, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)) for a in arrays], names.split())


def shared_letters(texts: DataFrame) -> DataFrame:
    """(letter, p): the share of each letter's group by the number of different words it occurs in, over all texts.

    Letters that occur nowhere share the weight of half a word.
    """
    names = "g n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Groups(batch.column("word").to_pylist(), 1)
            places = words.places(1)
            order = np.lexsort((words.at[1][places], words.word[places]))
            g, w = words.at[1][places][order], words.word[places][order]
            once = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])[: len(g)]
            yield batch_of(names, *np.unique(g[once], return_counts=True))

    counts = cut(word_types(texts).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))
    top = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return counts.crossJoin(F.broadcast(top)).select(
        F.col("g").alias("letter"), ((F.col("n") + 0.5) / (F.col("total") + 0.5 * (F.col("kinds") + 1))).alias("p"))


def class_counts(rows: DataFrame) -> DataFrame:
    """(size, g, ctx, low, first, n0, n1): occurrences of groups of up to ORDER letters by class.

    ``ctx`` is the group without its last letter, ``low`` without its first one; ``first`` is 1 for groups that begin a word.
    """
    names = "size g ctx low first n0 n1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                held[toxic].update((text or "").lower().split())
            if sum(map(len, held.values())) > 200_000:
                yield from told(held)
                held = {0: Counter(), 1: Counter()}
        yield from told(held)

    def told(held: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for label, chunks in held.items():
            for chunk, n in chunks.items():
                for word in spelled(chunk):
                    sums.setdefault(word, [0, 0])[label] += n
        words, ns = Groups(list(sums)), np.array(list(sums.values()), dtype=np.float64).reshape(-1, 2)
        for k in range(1, ORDER + 1):
            places = words.places(k)
            g, first, own = np.unique(words.at[k][places], return_index=True, return_inverse=True)
            n = [np.bincount(own, weights=ns[words.word[places], c], minlength=len(g)) for c in (0, 1)]
            at = places[first]
            yield batch_of(names, np.full(len(g), k), g, words.context(k, at), words.at[k - 1][at],
                           (words.depth[at] == k - 1).astype(np.int64), *n)

    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, ", ".join(f"{c} long" for c in names.split()))
    return counted.groupBy(*names.split()[:5]).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def continuations(counts: DataFrame) -> DataFrame:
    """``counts`` with continuation counts below the top order: different letters before a group, by class."""
    longer = counts.filter(F.col("size") > 1).groupBy(F.col("low").alias("inner")).agg(*[
        F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"c{c}") for c in (0, 1)])
    whole = (F.col("size") == ORDER) | (F.col("first") == 1)
    joined = counts.join(longer, counts.g == longer.inner, "left")
    told = {f"n{c}": F.when(whole, F.col(f"n{c}")).otherwise(F.coalesce(f"c{c}", F.lit(0))) for c in (0, 1)}
    return joined.withColumns(told).drop("inner", "c0", "c1")


def contexts(counts: DataFrame) -> DataFrame:
    """(ctx, t0, t1, m0, m1): adjusted counts after a context and the mass it hands to the shorter one, by class."""
    sums = counts.groupBy("ctx").agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)], *[
        F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"k{c}") for c in (0, 1)])
    mass = lambda c: (DISCOUNT * F.col(f"k{c}") + PRIOR) / (F.col(f"t{c}") + PRIOR)
    return sums.select("ctx", "t0", "t1", mass(0).alias("m0"), mass(1).alias("m1"))


def probabilities(counts: DataFrame, letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, step) and (ctx, step): log ratios, toxic to ordinary, of a group's last letter after its context, and of
    the masses that a context hands to the shorter one."""
    sums = cut(contexts(counts))
    low = letters.select(F.col("letter").alias("inner"), F.col("p").alias("b0"), F.col("p").alias("b1"))
    steps: DataFrame | None = None
    for size in range(1, ORDER + 1):
        own = counts.filter(F.col("size") == size).join(sums, "ctx").join(low, F.col("g" if size == 1 else "low") == F.col("inner"))
        p = [F.greatest(F.lit(0.0), F.col(f"n{c}") - DISCOUNT) / (F.col(f"t{c}") + PRIOR) + F.col(f"m{c}") * F.col(f"b{c}") for c in (0, 1)]
        own = cut(own.select("g", p[0].alias("p0"), p[1].alias("p1")))
        low = own.select(F.col("g").alias("inner"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
        told = own.select("g", F.log(F.col("p1") / F.col("p0")).alias("step"))
        steps = told if steps is None else steps.unionByName(told)
    return steps, sums.select("ctx", F.log(F.col("m1") / F.col("m0")).alias("step"))


def fetched(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their values."""
    told = table.select(key, F.col(value).cast("float")).toArrow()
    keys, values = told.column(0).to_numpy().view(np.uint64), told.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


NONE = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS) -> dict:
    """The model of texts (doc_id, text) and labels (doc_id, toxic)."""
    wanted = sampled(labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()), size).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    # At most about ``size`` rows of two numbers, so this side may be broadcast.
    rows = docs.join(F.broadcast(wanted), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)))
    counts = cut(class_counts(rows.filter("fold > 0")))
    seen = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    share = wanted.agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).first()
    prior = math.log(((share.n1 or 0) + 1) / (share.n - (share.n1 or 0) + 1))
    model = {"steps": NONE, "masses": NONE, "weights": (prior, 0.0, 0.0), "margin": MARGINS[0]}
    if not (seen.n0 and seen.n1):
        return model
    letters = cut(shared_letters(docs.select("text")))
    steps, handed = probabilities(cut(continuations(counts)), letters)
    model["steps"], model["masses"] = fetched(steps, "g", "step"), fetched(handed, "ctx", "step")
    held = compared(rows.filter("fold = 0").select("doc_id", "text", "toxic"), model, "toxic", margins=MARGINS).select("x", "toxic").toArrow()
    x, y = np.array(held.column("x").to_pylist()).reshape(-1, len(MARGINS) + 1), held.column("toxic").to_numpy()
    if not len(y):
        return model
    fitted = [logistic(x[:, [0, i + 1]], y) for i in range(len(MARGINS))]
    best = min(range(len(MARGINS)), key=lambda i: loss(x[:, [0, i + 1]], y, fitted[i]))
    return model | {"weights": fitted[best], "margin": MARGINS[best]}


def loss(x: np.ndarray, y: np.ndarray, weights: tuple[float, ...]) -> float:
    """Minus the log-likelihood of labels under a logistic function."""
    return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (weights[0] + x @ np.array(weights[1:]))).sum())


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and slopes of a logistic function, by Newton's method."""
    scale = np.maximum(1e-9, x.std(axis=0))
    design = np.concatenate([np.ones((len(x), 1)), x / scale], axis=1)
    weights = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(bend, design.T @ (y - p) - 1e-3 * weights)
        weights = weights + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return (float(weights[0]), *(weights[1:] / scale).tolist())


class Table:
    """Values by hash: sorted hashes, and where each leading bit pattern begins, so that a lookup compares a few neighbours only."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.longest = int(np.diff(np.append(self.first, len(keys))).max())
        # One more, so that the place after the last is there; its hash may be asked for, its value counts nothing.
        self.keys, self.values, self.size = np.append(keys, np.uint64(0)), np.append(values, np.float32(0)), len(keys)

    def get(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the table, and their values (0 for others)."""
        at = self.first[(asked >> self.shift).astype(np.int64)].astype(np.int64)
        found, out = np.zeros(len(asked), dtype=bool), np.zeros(len(asked))
        left = np.arange(len(asked))
        for step in range(self.longest):
            place = at[left] + step
            inside = place < self.size
            left, place = left[inside], place[inside]
            own, wanted = self.keys[place], asked[left]
            hit = own == wanted
            found[left[hit]] = True
            out[left[hit]] = self.values[place[hit]]
            left = left[own < wanted]
            if not len(left):
                break
        return found, out


class Scorer:
    def __init__(self, model: dict, margins: tuple[float, ...]):
        self.steps, self.masses, self.margins = Table(*model["steps"]), Table(*model["masses"]), np.array(margins)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.margins) + 2))

    def words(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of words, all their letters included.

        A letter is judged in the longest context that has it; longer contexts that lack it hand their mass down.
        """
        groups = Groups(words)
        own, left = np.zeros(len(groups.word)), groups.places(1)
        for k in range(ORDER, 0, -1):
            inside = groups.depth[left] >= k - 1
            places, shallow = left[inside], left[~inside]
            found, step = self.steps.get(groups.at[k][places])
            own[places] += step
            places = places[~found]
            own[places] += self.masses.get(groups.context(k, places))[1]
            left = np.concatenate([shallow, places])
        return np.add.reduceat(own, groups.starts) if words else np.zeros(0)

    def learn(self, chunks: set[str]) -> None:
        """Differences of the log-likelihoods, their excess by margin, and numbers of words, of stretches without white space, all at once."""
        if len(self.index) > CACHED_WORDS:
            self.forget()
        fresh = [c for c in chunks if c not in self.index]
        split = [spelled(c) for c in fresh]
        own = self.words([w for words in split for w in words])
        owners = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        sums = [np.bincount(owners, weights=x, minlength=len(split)) for x in (own, *[np.maximum(0.0, own - m) for m in self.margins])]
        sums.append(np.bincount(owners, minlength=len(split)))
        at = len(self.index)
        self.index.update(zip(fresh, range(at, at + len(fresh))))
        self.sums = np.concatenate([self.sums, np.stack(sums, axis=1)])

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """By text: the words' mean of log p(word | toxic) - log p(word | ordinary), and the square root of its mean excess by margin."""
        out = np.zeros((len(texts), len(self.margins) + 1))
        for at in range(0, len(texts), 500):  # their new words are scored together
            split = [(t or "").lower().split() for t in texts[at : at + 500]]
            self.learn(set().union(*split))
            for i, chunks in enumerate(split, at):
                if chunks:
                    found = self.sums[np.fromiter(map(self.index.__getitem__, chunks), dtype=np.int64, count=len(chunks))].sum(axis=0)
                    out[i] = found[:-1] / max(1.0, found[-1])
        out[:, 1:] = np.sqrt(out[:, 1:])
        return out


def compared(docs: DataFrame, model: dict, *keep: str, margins: tuple[float, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and x: the signed difference per word, and the excess under each margin (the model's own, if none)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(key, lambda: Scorer(sent.value, margins or (sent.value["margin"],)))
        for batch in batches:
            found = scorer.differences(batch.column("text").to_pylist())
            x = pa.array(found.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *keep)], x], ["doc_id", *keep, "x"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join([*kinds, "x array<double>"]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and x of every row; learns from rows not held out."""
    rows = columns(docs, doc_id="doc_id", text="text")
    told = columns(labels, doc_id="doc_id", toxic="toxic").filter(~held_out())
    model = fit(rows, told)
    a, b, c = model["weights"]
    return compared(rows, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x")[0] + F.lit(c) * F.col("x")[1])))).alias("score"),
        F.col("x")[0].alias("difference"), F.col("x")[1].alias("excess"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
