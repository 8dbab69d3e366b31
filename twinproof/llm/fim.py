"""Fill-in-the-middle transformation: each text is cut at two unit borders and its pieces reordered.

The cuts come from a salted hash of the document id, so they don't depend on partitioning. The work on
bytes is done for a whole batch at once, eight bytes a step (``Marks``): the UTF-8 buffer is viewed
as unsigned 64-bit words, arithmetic on a word leaves 0x80 in each byte that ends a unit, and
``bitwise_count`` gives the marks of each word. Their running sum finds the word of a unit's end by binary
search, and dropping lower marks finds the byte within the word. Units are lines (with their line
feed) or code points. No shuffle; batches are worked off in pieces of ``PIECE`` bytes.

``restore`` rebuilds the exact text from output and form with string functions.

Defined results: a null text is the empty text; an empty text has no unit and stays plain, as do texts that
contain a marker; the last line need not end in a line feed; a null id is hashed as an empty one; repeated
rows get equal rows; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of texts that are transformed, and percent of those that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 100, 50
SALT = "7:"
#: Bytes of text worked on at a time.
PIECE = 1 << 23

HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE, EIGHT, LAST_BYTE = np.uint64(1), np.uint64(8), np.uint64(56)


def feeds(words: np.ndarray) -> np.ndarray:
    """0x80 in every byte that is a line feed."""
    x = words ^ FEEDS
    return ~(((x & LOW) + LOW) | x | LOW)


def leads(words: np.ndarray) -> np.ndarray:
    """0x80 in every byte that begins a code point: all but 0b10xxxxxx."""
    return ~(words & ~(words << ONE)) & HIGH


class Marks:
    """Marked bytes of a buffer: how many lie before a byte, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.total = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each byte offset."""
        word, inside = at >> 3, ((at & 7) << 3).astype(np.uint64)
        below = self.marks[word] & ((ONE << inside) - ONE)
        return self.total[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th mark, k counting from 1."""
        word = np.searchsorted(self.total, k, side="left") - 1
        left, marks = k - self.total[word], self.marks[word]
        for _ in range(7):
            more = left > 1
            if not more.any():
                break
            marks = np.where(more, marks & (marks - ONE), marks)
            left = left - more
        lowest = marks & (~marks + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE) >> 3)


class Buffer:
    """The texts of a string array in one padded buffer of 64-bit words."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        size = int(edges[-1] - edges[0])
        padded = np.zeros(((size >> 3) + 2) << 3, dtype=np.uint8)
        if size:
            padded[:size] = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        self.bytes = padded
        self.words = padded.view("<u8")
        self.lead = leads(self.words)

    def ends(self, unit: str) -> np.ndarray:
        """Marks of the bytes that end a unit."""
        if unit == "char":  # the byte before each lead byte
            following = np.append(self.lead[1:], HIGH)
            return (self.lead >> EIGHT) | ((following & np.uint64(0x80)) << LAST_BYTE)
        marks = feeds(self.words)
        last = self.edges[1:][np.diff(self.edges) > 0] - 1
        np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
        return marks


def cuts(buffer: Buffer, unit: str, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the byte offsets where prefix and middle end.

    The prefix has the smaller of ``first`` and ``second`` modulo (units + 1), the middle ends after the larger.
    """
    ends = Marks(buffer.ends(unit))
    begin = ends.before(buffer.edges[:-1])
    n = ends.before(buffer.edges[1:]) - begin
    a, b = first % (n + 1), second % (n + 1)

    def place(units: np.ndarray) -> np.ndarray:
        out = buffer.edges[:-1].copy()
        some = units > 0
        out[some] = ends.select((begin + units)[some]) + 1
        return out

    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE bytes of text."""
    sizes = np.cumsum([0, *[s or 0 for s in pc.binary_length(batch.column("text")).to_pylist()]])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + PIECE, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _strings(values: list[bytes | memoryview]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def transform(docs: DataFrame, unit: str = "line", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
              salt: str = SALT, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output.

    psm is prefix, suffix, middle and spm is suffix, prefix, middle, each after its marker.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is line or char")
    _checked(markers)
    told = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = columns(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash", told).select("doc_id", "text", *h)
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("text", F.lit(m))
    plain = marked | (F.col("text") == "") | (F.col("h2") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h3") % 100 < spm_percent, "spm").otherwise("psm")
    source = rows.select("doc_id", "text", F.col("h0").alias("first"), F.col("h1").alias("second"), form.alias("form"))
    head, tail, mid = (m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                buffer = Buffer(batch.column("text"))
                first, second = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second"))
                n, one, two = cuts(buffer, unit, first, second)
                points = Marks(buffer.lead)
                begin, middle = points.before(buffer.edges[:-1]), points.before(one)
                sizes = middle - begin, points.before(two) - middle
                raw, forms, outputs = memoryview(buffer.bytes), batch.column("form").to_pylist(), []
                for kind, s, p, m, e in zip(forms, buffer.edges[:-1].tolist(), one.tolist(), two.tolist(), buffer.edges[1:].tolist()):
                    if kind == "plain":
                        outputs.append(bytes(raw[s:e]))
                    elif kind == "psm":
                        outputs.append(b"".join((head, raw[s:p], tail, raw[m:e], mid, raw[p:m])))
                    else:
                        outputs.append(b"".join((tail, raw[m:e], head, raw[s:p], mid, raw[p:m])))
                none = np.array([k == "plain" for k in forms], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(sizes[0], pa.int64(), mask=none),
                     pa.array(sizes[1], pa.int64(), mask=none), _strings(outputs)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _checked(markers: tuple[str, str, str]) -> None:
    """Markers that no join of pieces can imitate: one opening and one closing bracket, at the ends."""
    if len(set(markers)) != 3 or any(not re.fullmatch(r"<[^<>]+>", m) for m in markers):
        raise ValueError("markers are three different texts of the form <...>")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The original text of an output."""
    _checked(markers)
    part = F.split(output, "|".join(re.escape(m) for m in markers))
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))).otherwise(
        F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))
