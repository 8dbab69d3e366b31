"""Merkle manifests, fill-in-the-middle and licence scans against plain Python, on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import compare, connect
from tests.llm import brute
from tests.llm.test_operators import CLASH, DOCS
from twinproof.llm import fim, licences, merkle

SF = "/root/testdata/sf0.001"


def rows_of(rng):
    """Three sources (one null, one with most rows), null and equal ids, repeated rows, nulls in every column."""
    texts = [None, "", "Aß é", "x\n" * 40, "Plain TEXT", "y" * 70_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", None]), "big", rng.choice([1, None])) for i in range(300)]
    rows += [(i, rng.choice(texts), None, None, 2) for i in (5, 5, None, 7)] + [(None, None, None, None, None)] * 2
    rows += [(900, "one", "en", "lone", 3), (901, "é", "de", "", 3), (902, "é", "de", "", 3)]
    rng.shuffle(rows)
    return rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join(told))


def build(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, at, fanout):
    """(left, right) siblings of node ``at`` up to the root."""
    out = []
    for level in levels[:-1]:
        run = at - at % fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        at //= fanout
    return out


def brute_manifest(rows, fanout):
    """[(doc_id, leaf, subroot, root, path)]"""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], leaf(*r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: build([h for _, h in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for s in order}
    top = build([trees[s][-1][0] for s in order], fanout)
    out = []
    for place, s in enumerate(order):
        for at, (i, h) in enumerate(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            out.append((i, h, trees[s][-1][0], top[-1][0], climb(trees[s], at, fanout) + climb(top, place, fanout)))
    return out


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_equals_brute_force(spark, fanout):
    rows = rows_of(random.Random(1))
    df = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], DOCS + CLASH)
    claimed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    got = merkle.manifest(df, claimed, fanout).proofs().withColumn("folded", merkle.folded(F.col("claim"), F.col("path"))).collect()
    key = lambda x: tuple(map(str, x))
    want = brute_manifest(rows, fanout)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got], key=key) == sorted(want, key=key)
    texts = {leaf(*r): r for r in rows}
    for r in got:
        i, text, lang, source, n = texts[r.leaf]
        claim = leaf(i, (text or "") + "!" if i is not None and i % 2 == 0 else text, lang, source, n)
        value = claim
        for left, right in r.path:
            value = digest(left + value + right)
        assert (r.claim, r.folded) == (claim, value) and (value == r.root) == (claim == r.leaf)


def test_manifest_of_few_rows_and_changes(spark):
    rows = rows_of(random.Random(2))
    df = spark.createDataFrame(rows, DOCS)
    none = merkle.manifest(df.limit(0))
    assert none.proofs().count() == none.root().count() == none.subroots().count() == 0
    one = merkle.manifest(spark.createDataFrame(rows[:1], DOCS))
    assert [r.root for r in one.root().collect()] == [leaf(*rows[0])] and one.proofs().first().path == []
    old = merkle.manifest(df)
    newer = df.filter("source is null or source != 'lone'").withColumn("n_chars", F.when(F.col("source").isNull(), 9).otherwise(F.col("n_chars")))
    newer = newer.unionByName(spark.createDataFrame([(1, "new", "en", "fresh", 1)], DOCS))
    assert {tuple(r) for r in merkle.changed(old, merkle.manifest(newer)).collect()} == {("fresh", "added"), ("lone", "removed"), (None, "differs")}
    assert merkle.changed(old, merkle.manifest(df.repartition(13))).count() == 0  # the same rows, dealt otherwise


def test_query_matches_crc_and_lowering(spark):
    """The tampered fifth that has capital letters fails, all else verifies."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op11_merkle_manifest"](spark, SF).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and re.search("[A-Z]", docs[r.doc_id] or "")
        assert r.verified == (not hit)


def pieces(doc_id, text, unit):
    """(n, form, prefix, middle, suffix)"""
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "") if unit == "line" else list(text or "")
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    plain = not text or any(m in text for m in fim.MARKERS)
    form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


ODD = [None, "", "\n", "\n\n\n", "no feed", "a\nb\nc", "a\nb\nc\n", "é\n漢字\n\U0001f600x\n", "has <P> inside\nb", "<", "<P\n>S>\n<", "ਊਊ\nਊ",
       "\r\nx\r\n", "x" * 9 + "\n", "long\n" * 30_000, "z" * 200_000]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle(spark, unit):
    rows = [(i * 16 + k if i else None, t, None, None, 1) for i in range(12) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], DOCS + CLASH)
    made = fim.transform(df, unit).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows) and {r.form for r in made} == {"plain", "psm", "spm"}
    want = sorted((str(i), t or "", *pieces(i, t, unit)) for i, t, *_ in rows)
    for r, (i, text, n, form, p, m, s) in zip(sorted(made, key=lambda r: (str(r.doc_id), r.restored)), want):
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (str(r.doc_id), r.n, r.form, r.output, r.restored) == (i, n, form, output, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert fim.transform(df.limit(0), unit).count() == 0
    assert {r.form for r in fim.transform(df, unit, fim_percent=0).select("form").collect()} == {"plain"}


def test_fill_in_middle_parameters(spark):
    df = spark.createDataFrame([(1, "a\nb\n")], "doc_id long, text string")
    for markers in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S>", "<M><")):
        with pytest.raises(ValueError):
            fim.transform(df, markers=markers)
    with pytest.raises(ValueError):
        fim.transform(df, unit="word")
    own = ("<|p|>", "<|s|>", "<|m|>")
    assert fim.transform(df, spm_percent=100, markers=own).select(fim.restore(F.col("output"), F.col("form"), own)).first()[0] == "a\nb\n"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("a\né漢\U0001f600\x00\x8a<")), max_size=6), st.integers(0, 40), st.integers(0, 40))
def test_word_wise_cuts(texts, first, second):
    buffer = fim.Buffer(pa.array(["lead", *texts], pa.string()).slice(1))
    for unit in ("line", "char"):
        n, one, two = fim.cuts(buffer, unit, np.full(len(texts), first), np.full(len(texts), second))
        for i, text in enumerate(texts):
            units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
            a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
            edge = buffer.edges[i]
            assert (n[i], one[i] - edge, two[i] - edge) == (len(units), len("".join(units[:a]).encode()), len("".join(units[:b]).encode()))


def test_licences_equal_every_place(spark):
    """The index finds what trying every template at every place finds."""
    rng = random.Random(3)
    pool = sorted({w for t in licences.TEMPLATES for w in t.words}) + [f"w{i}" for i in range(40)]
    texts = [None, "", "-- !", "CC-BY cc by; CC  BY", "All rights reserved" * 3, "license " * 3000]
    for t in licences.TEMPLATES:
        w = t.words
        spoilt = [x for x in w if rng.random() > 0.08]
        spoilt.insert(rng.randrange(len(spoilt) + 1), "extra")
        texts += [f"É {t.text.title()}, ok", " ".join(spoilt), f"{t.text} {t.text}", " ".join(rng.choice(pool) for _ in range(300)) + " " + t.text.upper()]
    df = spark.createDataFrame([(i, t, None, None, 1, *["x"] * 9) for i, t in enumerate(texts)], DOCS + CLASH)
    rows = {r.doc_id: r for r in licences.scan(df).collect()}
    every = licences.Index(licences.TEMPLATES, 1, {})
    for i, text in enumerate(texts):
        words = [w.encode() for w in brute.fold_words(text)]
        want = []
        for number, t in enumerate(every.templates):
            size, good = len(every.words[number]), []
            for at in range(-size, len(words) + size):
                n = every.stands(words, number, at)
                if n >= t.need and every.keyed(words, number, at):
                    good.append((at, n))
            good = good if t.base else licences._apart(good, size)
            want += [(max(0, at), t.label, n / size) for at, n in good]
        got = [(p.first, p.label, p.share) for p in rows[i].places]
        assert (rows[i].n_words, sorted(got)) == (len(words), sorted(want))
        for p in rows[i].places:
            assert brute.fold_words(text[p.start : p.end]) == [w.decode() for w in words[p.first : p.stop]]
    assert {p.label for r in rows.values() for p in r.places} == {t.label for t in licences.TEMPLATES}
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_rules(spark):
    """A key phrase is mandatory; a few spoilt words are let off; a base phrase must be whole."""
    t = (licences.phrase("p", "alpha beta"), licences.Template("n", "one two three four five six seven eight nine ten", ("five six",)))
    texts = ["one two three four five six seven eight x ten", "one two three four five x six seven eight nine ten", "one x two three four five six seven eight nine ten",
             "alpha x beta", "ALPHA-beta alpha\nbeta", "one two three four five six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(p.label, p.first) for p in r.places] for r in licences.scan(df, t).collect()}
    assert [got[i] for i in range(6)] == [[("n", 0)], [], [("n", 0)], [], [("p", 0), ("p", 2)], []]
    assert licences.scan(df, ()).filter("size(places) > 0").count() == 0


def test_document_counts_cover_all_rows(spark):
    df = spark.createDataFrame([(i, "gnu gnu apache" if i % 2 else "apache") for i in range(500)], "doc_id long, text string").repartition(7)
    assert licences.document_counts(df) == (500, {"apache": 500, "gnu": 250})


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fill_in_middle", "op13_license_scans"])
def test_query_matches_sql(spark, name):
    ok, message, n = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok and n > 0, message
