"""Language ID of spans: script ranges, per-word scores, Viterbi with a switching penalty.

Words are the stretches between white space. The scripts of a word's letters narrow the
languages that may score (those whose training text uses the script); the word's score in each is the
log-probability of its character trigrams. Viterbi then labels the words, paying ``SWITCH`` to
change the language, and runs of equal labels are the spans. When no stretch of words prefers
another language by more than the penalty, the best single language is the Viterbi path, which
one vectorised pass shows; only other texts run the recursion.

The trigram counts are fitted on a sample of about ``SAMPLE_ROWS`` labelled rows of each language (all, if
fewer), chosen by a hash of doc_id and read whole, and all trigrams of it are kept: 12 bytes for each trigram and
language that has it, and 16 for each trigram, so many languages or large scripts don't multiply. How common a
language is counts over all labelled rows. Every document is predicted from its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if
there is nothing to learn from; ties go to the language first in alphabetical order; repeated
rows get equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns, cut, once

SAMPLE_ROWS = 20_000
SWITCH = 12.0
FOREIGN = -40.0
#: Words kept by a worker with four languages; fewer with more. And scores worked out at a time.
CACHED_WORDS, SCORES = 500_000, 4_000_000

# First and last code points of scripts, apart from Latin the blocks of common use.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


@cache
def script(letter: str) -> str:
    """The script of a letter, empty for other characters."""
    code = ord(letter)
    return next((name for name, first, last in SCRIPTS if first <= code <= last), "other") if letter.isalpha() else ""


def runs(word: str) -> Iterator[tuple[str, str]]:
    """(script, letters) of the runs of letters of one script in a lower-case word."""
    if word.isascii() and word.isalpha():
        yield "latin", word
        return
    held, kind = "", ""
    for letter in word:
        of = script(letter)
        if of != kind and held:
            yield kind, held
            held = ""
        kind = of
        if of:
            held += letter
    if held:
        yield kind, held


def grams(letters: str) -> list[str]:
    padded = f" {letters} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def packed_grams(stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the stretch, its code points in 21 bits each) of every trigram of stretches of letters."""
    sizes = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
    letters = np.frombuffer("".join([f" {x} " for x in stretches]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(owner)) + 2 * owner  # a stretch of n letters has n trigrams and takes n + 2 places
    shift = np.uint64(21)
    return owner, ((letters[at] << shift) | letters[at + 1]) << shift | letters[at + 2]


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """About ``size`` rows by a hash of doc_id; all rows if there are fewer."""
    total = rows.count()
    if total <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < (size << 40) // total)


def sampled_each(rows: DataFrame, totals: dict[str, int], size: int) -> DataFrame:
    """About ``size`` rows of each language by a hash of doc_id; all rows of a language that has fewer."""
    shares = {x: (size << 40) // n for x, n in totals.items() if n > size}
    if not shares:
        return rows
    limits = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < F.coalesce(limits[F.col("lang")], F.lit(1 << 40)))


def fit(labelled: DataFrame, size: int = SAMPLE_ROWS) -> dict:
    """The model of rows (doc_id, text, lang): languages, trigram log-probabilities, scripts.

    ``size`` is the number of rows sampled from each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > 200_000:
                yield told(words)
                words = {}
        yield told(words)

    def told(words: dict[str, Counter]) -> pa.RecordBatch:
        found: Counter = Counter()
        for lang, own in words.items():
            for word, n in own.items():
                for kind, letters in runs(word):
                    found[lang, "script", kind] += n * len(letters)
                    for g in grams(letters):
                        found[lang, "gram", g] += n
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in found], pa.string()) for i in range(3)] + [pa.array(list(found.values()), pa.int64())],
            ["lang", "what", "name", "n"])

    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).toArrow().to_pylist()}
    languages = sorted(per)
    counted = sampled_each(known, per, size).select("text", "lang").mapInArrow(count, "lang string, what string, name string, n long")
    summed = cut(counted.groupBy("lang", "what", "name").agg(F.sum("n").alias("n")))
    told = summed.filter("what <> 'gram'").toArrow().to_pylist()
    grammed = summed.filter("what = 'gram'").select("name", "lang", "n").toArrow()
    at = {x: i for i, x in enumerate(languages)}
    # A trigram is three code points: as many bytes in UTF-32 whatever its script.
    names = grammed.column("name").to_pylist()
    letters = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64).reshape(-1, 3)
    keys = (letters[:, 0] << np.uint64(42)) | (letters[:, 1] << np.uint64(21)) | letters[:, 2]
    owners = np.array([at[x] for x in grammed.column("lang").to_pylist()], dtype=np.int32)
    n = grammed.column("n").to_numpy()
    order = np.lexsort((owners, keys))
    keys, owners, n = keys[order], owners[order], n[order]
    grams_known, first = np.unique(keys, return_index=True)
    totals = np.bincount(owners, weights=n, minlength=len(languages)) + 0.5 * max(1, len(grams_known))
    scripts: dict[str, np.ndarray] = {}
    for r in told:
        if r["what"] == "script":
            scripts.setdefault(r["name"], np.zeros(len(languages)))[at[r["lang"]]] = r["n"]
    written = np.maximum(1, sum(scripts.values(), np.zeros(len(languages))))
    prior = np.array([per[x] for x in languages], dtype=float)
    return {
        "languages": languages, "grams": grams_known, "edges": np.append(first, len(keys)), "owners": owners,
        "gains": np.log1p(2.0 * n),  # log((n + 0.5) / total) less the value of an unknown trigram
        "rest": np.log(0.5 / totals) if languages else np.zeros(0),
        "scripts": {s: c / written >= 0.01 for s, c in scripts.items()},
        "prior": np.log(prior / max(1.0, prior.sum())) if languages else np.zeros(0),
    }


class Labeller:
    def __init__(self, model: dict, switch: float = SWITCH):
        self.model, self.switch, self.size = model, switch, len(model["languages"])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, self.size)), np.zeros(0, dtype=np.int64)

    def stretches(self, found: list[str]) -> np.ndarray:
        """Log-probabilities of stretches of letters in every language, whatever their script."""
        model, size = self.model, self.size
        own = np.zeros((len(found), size))
        for start in range(0, len(found), max(1, SCORES // size)):
            part = found[start : start + max(1, SCORES // size)]
            owner, keys = packed_grams(part)
            sums = np.bincount(owner, minlength=len(part))[:, None] * model["rest"]
            if len(model["grams"]):
                place = np.minimum(np.searchsorted(model["grams"], keys), len(model["grams"]) - 1)
                hit = model["grams"][place] == keys
                place, owner = place[hit], owner[hit]
                first, many = model["edges"][place], model["edges"][place + 1] - model["edges"][place]
                entry = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
                cell = np.repeat(owner, many) * size + model["owners"][entry]
                sums = sums + np.bincount(cell, weights=model["gains"][entry], minlength=len(part) * size).reshape(-1, size)
            own[start : start + len(part)] = sums
        return own

    def learn(self, words: set[str]) -> None:
        """Scores and numbers of letters of words that weren't met before, all at once."""
        if len(self.index) > CACHED_WORDS * 4 // max(4, self.size):
            self.forget()
        fresh = [w for w in words if w not in self.index]
        scripts, everywhere = self.model["scripts"], np.ones(self.size, dtype=bool)
        found, owners, allowed = [], [], []
        letters = np.zeros(len(fresh), dtype=np.int64)
        for i, word in enumerate(fresh):
            for kind, run in runs(word):
                letters[i] += len(run)
                used = scripts.get(kind)
                if used is not None and used.any():
                    found.append(run)
                    owners.append(i)
                    allowed.append(used if not used.all() else everywhere)
        scores = np.zeros((len(fresh), self.size))
        if found and self.size:
            own, sizes = self.stretches(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            own = np.where(np.array(allowed), own, FOREIGN * sizes[:, None])
            np.add.at(scores, np.array(owners), own)
            scores -= scores.max(axis=1, keepdims=True)
        at = len(self.index)
        self.index.update(zip(fresh, range(at, at + len(fresh))))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words by languages) and letters of learnt words."""
        places = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        return self.scores[places], self.letters[places]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The Viterbi labels of words."""
        prior = self.model["prior"]
        best = int(np.argmax(scores.sum(axis=0) + prior))
        gain = np.cumsum(scores - scores[:, [best]], axis=0)
        low = np.minimum(0, np.minimum.accumulate(np.vstack([np.zeros(self.size), gain[:-1]]), axis=0))
        if (gain - low + np.maximum(0, prior - prior[best])).max() <= self.switch:
            return np.full(len(scores), best)
        value, back = (prior + scores[0]).tolist(), []
        for row in scores[1:].tolist():
            most = max(value)
            least = most - self.switch  # a language below it is better reached from the best one
            back.append((value.index(most), [v < least for v in value]))
            value = [(least if v < least else v) + s for v, s in zip(value, row)]
        label = value.index(max(value))
        labels = [label]
        for top, moved in reversed(back):
            label = top if moved[label] else label
            labels.append(label)
        return np.array(labels[::-1])

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """(language, score, spans as (language, first word, end))."""
        words = (text or "").lower().split()
        self.learn(set(words))
        return self.label_words(words)

    def label_words(self, words: list[str]) -> tuple[str, float, list[tuple[str, int, int]]]:
        if not words or not self.size:
            return "und", 0.0, []
        scores, letters = self.rows(words)
        if not letters.sum():
            return "und", 0.0, []
        labels = self.path(scores)
        weight = np.bincount(labels, weights=letters, minlength=self.size)
        best = int(np.argmax(weight))
        own = scores[labels == best].sum(axis=0) + self.model["prior"]
        sure = 1 / np.exp(np.clip(own - own[best], -700, 50)).sum()
        edges = np.flatnonzero(np.diff(labels)) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(words)]
        spans = [(self.model["languages"][labels[a]], a, b) for a, b in zip(starts, ends)]
        return self.model["languages"][best], float(min(1.0, sure * weight[best] / letters.sum())), spans


def identify(docs: DataFrame, model: dict, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans of every row."""
    source = columns(docs, doc_id="doc_id", text="text")
    sent = source.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = once(key, lambda: Labeller(sent.value, switch))
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 500):  # their new words are scored together
                split = [(t or "").lower().split() for t in batch.column("text").slice(at, 500).to_pylist()]
                labeller.learn(set().union(*split))
                found += map(labeller.label_words, split)
            made = [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
                made.append(pa.array([[{"lang": x, "first": a, "end": b} for x, a, b in f[2]] for f in found], kind))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(made, names)

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return source.mapInArrow(run, schema + ", spans array<struct<lang:string,first:long,end:long>>" * spans)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def predict(docs: DataFrame, spans: bool = True) -> DataFrame:
    """Learn from the rows that aren't held out, then label every row."""
    rows = columns(docs, doc_id="doc_id", text="text", lang="lang")
    model = fit(rows.filter(F.coalesce(~held_out(), F.lit(True))))
    return identify(rows, model, spans=spans).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select(
        "doc_id", "held_out", "lang_pred", "score", *["spans"] * spans)
