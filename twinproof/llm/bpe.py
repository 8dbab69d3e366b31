"""BPE encoding and decoding.

Encoding is the backtracking method. One Aho-Corasick pass over a word finds the longest
token that starts at each symbol. Tokens are then laid from left to right; a token may follow
its predecessor only if BPE leaves the boundary between the two alone, which a walk back
through the merges of both decides (the pair-compatibility table remembers the answers). If no
token fits, the last one is replaced by its next shorter prefix token. Each end position fails
at most once, so a word costs linear time and the result equals that of the merge loop.
Decoding reads an offset table: all token strings lie in one byte array, and ids select slices.

Defined results: null encodes as the empty text (no ids, empty decoded text). Equal rows give
equal results, row by row. The vocabulary file is a parameter and must be readable under the
same path on every executor; each Python worker loads it once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from twinproof.llm.common import columns

#: Words, and stretches between white space, kept with their ids per worker; others are encoded
#: each time they occur.
CACHED_WORDS = 300_000
CACHED_PAIRS = 400_000

# Fixed values of the vocabulary file's normalizer and pre-tokenizer.
WHITE = r"[\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|(?:(?!{WHITE})[^\p{{L}}\p{{N}}])+"
WORD_END = "</w>"
# Letters and digits that `regex` (Unicode 17) knows and the patterns of the vocabulary's own library
# (Unicode 16) don't, and the lower-case forms that library knows and Python's (Unicode 15.1) doesn't.
UNKNOWN_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
NEW_LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)})


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [letters[b] for b in range(256)]


class WordBpe:
    """A lower-casing word BPE with a word-end suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        # Tokens are numbered in the order in which BPE can make them; base symbols come first.
        order = {t: i for i, t in enumerate(base)} | {a + b: len(base) + i for i, (a, b) in enumerate(merges)}
        self.n_base = len(base)
        self.ids = [0] * len(order)
        for token, o in order.items():
            self.ids[o] = vocab[token]
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            o = order[a + b]
            self.left[o], self.right[o] = order[a], order[b]
            self.pairs[order[a], order[b]] = o
        self.compatible: dict[tuple[int, int], bool] = {}
        # A word is a string of symbols; the last symbol, with the word end, has a letter of its own.
        final = {letter: chr(0x4000 + b) for b, letter in enumerate(byte_letters())}
        self.inner = {b: letter for b, letter in enumerate(byte_letters())}
        self.final = {b: final[letter] for b, letter in enumerate(byte_letters())}
        symbols, self.automaton = {}, ahocorasick.Automaton()
        for token, o in order.items():
            if token.endswith(WORD_END):
                body = token.removesuffix(WORD_END)
                symbols[o] = body[:-1] + final[body[-1]]
            else:
                symbols[o] = token
        self.length = [len(symbols[o]) for o in range(len(order))]
        usable = {s: o for o, s in symbols.items() if self.stays(self.left[o], self.right[o], o) or o < self.n_base}
        self.shorter = [-1] * len(order)
        for s, o in usable.items():
            self.automaton.add_word(s, o)
            self.shorter[o] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces = regex.compile(PIECES)
        some = regex.compile(f"[{UNKNOWN_LETTERS}{''.join(map(chr, NEW_LOWER))}]")
        beyond = re.compile("[\u0558-\U0010ffff]")  # most texts have nothing as far up
        self.newer = lambda text: beyond.search(text) and some.search(text)
        known = lambda kind: rf"(?:(?![{UNKNOWN_LETTERS}])\p{{{kind}}})"
        other = rf"(?:(?!{WHITE})(?:[{UNKNOWN_LETTERS}]|[^\p{{L}}\p{{N}}]))"
        self.strict = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{known('L')}+|{known('N')}|{other}+")
        self.heads = {t[:1] for t in self.special}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        shown = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.offsets = np.cumsum([0, *map(len, shown)])

    def stays(self, a: int, b: int, limit: int) -> bool:
        """Whether BPE leaves the boundary of tokens a and b alone before step ``limit``."""
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a < self.n_base and b < self.n_base:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:  # of two equal merges the left one comes first, so a step on this side may tie
                limit, b = b + 1, self.left[b]

    def may_follow(self, a: int, b: int) -> bool:
        found = self.compatible.get((a, b))
        if found is None:
            found = self.stays(a, b, len(self.ids))
            if len(self.compatible) < CACHED_PAIRS:
                self.compatible[a, b] = found
        return found

    def word(self, word: str) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        text = "".join(map(self.inner.__getitem__, raw[:-1])) + self.final[raw[-1]]
        size, length, shorter = len(text), self.length, self.shorter
        longest = [-1] * (size + 1)
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token
        out: list[int] = []
        failed: set[int] = set()
        at, token = 0, longest[0]
        while at < size:
            while token >= 0 and (at + length[token] in failed or (out and not self.may_follow(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                failed.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        found = np.array([self.ids[t] for t in out], dtype="<u4").tobytes()
        if len(self.words) < CACHED_WORDS and len(word) <= 64:
            self.words[word] = found
        return found

    def chunk(self, text: str) -> bytes:
        """The ids of a stretch of normalised text without white space, or of any text."""
        pieces = self.pieces if text.isascii() or not self.newer(text) else self.strict
        found = b"".join([self.words.get(w) or self.word(w) for w in pieces.findall(text)])
        if len(self.chunks) < CACHED_WORDS and len(text) <= 64:
            self.chunks[text] = found
        return found

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.newer(text):
                text = text.translate(NEW_LOWER)
        # White space needs no step of its own: pieces never contain it. Letter by letter, without the final form of sigma.
        return text.replace("Σ", "σ").lower()

    def encode(self, text: str) -> np.ndarray:
        chunks, encode, out = self.chunks, self.chunk, []
        for i, part in enumerate(self.specials.split(text) if any(h in text for h in self.heads) else (text,)):
            if i % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                plain = self.normalized(part)
                # str.split() takes these four for white space, the vocabulary's pattern doesn't.
                split = [plain] if any(c in plain for c in "\x1c\x1d\x1e\x1f") else plain.split()
                out += [chunks.get(c) or encode(c) for c in split]
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by spaces, in UTF-8; ids are looked up a million at a time."""
        parts = []
        for at in range(0, len(ids), 1_000_000):
            some = ids[at : at + 1_000_000]
            sizes = self.offsets[some + 1] - self.offsets[some]
            shift = np.repeat(self.offsets[some] - np.cumsum(sizes) + sizes, sizes)
            parts.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts)[:-1]


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens and the digests of ids and decoded text.

    ``ids`` and ``decoded`` add the outputs themselves (array of ints, text); a caller that
    needs the digests only leaves them in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = bpe.encode(text or "")
                plain = bpe.decode(found)
                rows.append((len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(plain).hexdigest(),
                             found.tolist() if ids else None, plain.decode() if decoded else None))
            names = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string())
            keep = [True, True, True, ids, decoded]
            made = [pa.array([r[i] for r in rows], kinds[i]) for i in range(5) if keep[i]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *[n for n, k in zip(names, keep) if k]])

    source = columns(docs, doc_id="doc_id", text="text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>" * ids + ", decoded string" * decoded
    return source.mapInArrow(run, schema)
