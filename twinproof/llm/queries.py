"""The registered queries of this package and their SQL restatements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.llm import (
    bpe, chat, decontaminate, fim, langid, licences, linededup, merkle, quality, secrets, simhash, substring, toxicity,
)
from twinproof.llm.common import digest, shared_folder, table
from twinproof.session import ship_package

TOKENIZER = "word_bpe_49k.json"
PROBE = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"), with_counts=True)
    return done.select("doc_id", "n_lines", "n_removed", digest(F.coalesce("text", F.lit(""))).alias("text_sha256"))


OP1 = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM lines WHERE len(l) >= 3),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l[pos + 1:pos + 3] ORDER BY doc_id, pos) AS nth FROM starts),
covered AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM ranked WHERE nth > 1),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM lines),
kept AS (SELECT e.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
         coalesce(string_agg(CASE WHEN c.i IS NULL THEN e.line END, chr(10) ORDER BY e.i), '') AS text
         FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    secrets.extend(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), ledger, "first")  # half of the versions arrive
    found = secrets.findings(docs, secrets.extend(docs, ledger, "second"))
    base = F.filter("found", lambda f: f["base"])
    n = lambda kind: F.coalesce(F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long"), F.lit(0).cast("long"))
    told = found.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    return told.select(
        F.col("path").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        digest(secrets.joined_spans(base)).alias("base_sha256"), secrets.joined_spans(F.col("found")).alias("spans"))


def _op2_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    runs = " UNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, {str(r.base).lower()} AS base, "
        f"string_split_regex(text, {quoted(r.pattern)}) AS g, regexp_extract_all(text, {quoted(r.pattern)}, 0) AS m, "
        f"regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS x FROM d WHERE regexp_matches(text, {quoted(r.pattern)})"
        for i, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), runs AS ({runs}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM runs),
placed AS (SELECT doc_id, kind, rank, base, length(m[i]) AS size, length(x[i]) >= least AS good,
  sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
told AS (SELECT *, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE good),
per AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY stop - size, rank) AS spans,
  string_agg(span, ',' ORDER BY stop - size, rank) FILTER (base) AS based FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False, decoded=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6 = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
t AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[pos:pos + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS pos FROM t WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
spots AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT s.doc_id, s.pos, s.size, x.item_id FROM spots s JOIN wins x ON x.size = s.size AND x.win = array_to_string(s.w[s.pos:s.pos + s.size - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), text=False)


OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM spots GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM spots SEMI JOIN twice USING (h)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY e.i) AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"), spans=False).select("doc_id", "held_out", "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    made = chat.conversations(turns.unionByName(probe)).withColumn("turns", chat.read_turns(F.col("text")))
    loss = chat.masked_text(F.col("segments"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(whole).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"))


OP9 = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
sized AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>'))
  + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS size FROM rows),
per AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(size) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM per"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered).otherwise(F.col("text"))
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), claimed=tampered).proofs()
    root = merkle.folded(F.col("claim"), F.col("path"))
    told = proofs.select("doc_id", "leaf", "subroot", "root", merkle.sha(merkle.siblings(F.col("path"))).alias("proof_sha256"), root.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op11_sql() -> str:
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(4294967295, list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: {bits}))"
    tree = lambda name, base: f"""
{name} AS (SELECT g, 0 AS level, pos, n, hash FROM {base} UNION ALL
  SELECT g, level + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // 16),
{name}_runs AS (SELECT g, level, pos // 16 AS up, list(hash ORDER BY pos) AS kids FROM {name} WHERE n > 1 GROUP BY g, level, pos // 16)"""  # noqa: E731
    left, right = "array_to_string(kids[:pos % 16], '')", "array_to_string(kids[pos % 16 + 2:], '')"
    fold = lambda name, base, runs: f"""
{name} AS (SELECT doc_id, g, 0 AS level, pos, n, own, '' AS told FROM {base} UNION ALL
  SELECT f.doc_id, f.g, f.level + 1, f.pos // 16, (f.n + 15) // 16, sha256({left} || own || {right}), told || {left} || {right}
  FROM {name} f JOIN {runs} r ON f.g = r.g AND f.level = r.level AND f.pos // 16 = r.up WHERE f.n > 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE docs AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE text END AS told FROM documents),
rows AS (SELECT doc_id, g, {leaf('text')} AS hash, {leaf('told')} AS own, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM docs WINDOW w AS (PARTITION BY g ORDER BY doc_id)), {tree("low", "rows")},
tops AS (SELECT '' AS g, g AS key, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1), {tree("high", "tops")},
root AS (SELECT hash AS root FROM high WHERE n = 1), {fold("up", "rows", "low_runs")},
mid AS (SELECT doc_id, t.g, t.key, t.hash AS subroot, t.pos, t.n, own, told FROM up JOIN tops t ON up.g = t.key WHERE up.n = 1),
{fold("over", "mid", "high_runs").replace("'' AS told", "told")}
SELECT r.doc_id, r.hash AS leaf, m.subroot, root, sha256(o.told) AS proof_sha256, o.own AS folded_root, o.own = root AS verified
FROM rows r JOIN mid m ON r.doc_id = m.doc_id JOIN over o ON r.doc_id = o.doc_id AND o.n = 1, root"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("places", lambda x: x["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    return licences.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"), joined(base).alias("base_labels"), joined("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def _op13_sql() -> str:
    words, keys = [], []
    for number, t in enumerate(licences.TEMPLATES):
        for i, w in enumerate(t.words):
            words.append(f"({number}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {t.need}, {t.slack}, {i}, '{w}')")
        for k, key in enumerate(t.keys):
            size = len(key.split())
            keys += [f"({number}, {k}, {size}, {i}, '{w}')" for i, w in enumerate(key.split())]
    return rf"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
t AS (SELECT * FROM (VALUES {", ".join(words)}) AS x(number, label, base, m, need, slack, i, word)),
k AS (SELECT * FROM (VALUES {", ".join(keys)}) AS x(number, k, size, i, word)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
known AS (SELECT * FROM each SEMI JOIN t USING (word)),
near AS (SELECT doc_id, number, label, base, m, need, slack, i, unnest(range(p - i - slack, p - i + slack + 1)) AS pos FROM known JOIN t USING (word)),
spots AS (SELECT doc_id, number, label, base, m, slack, pos, count(DISTINCT i) AS n FROM near GROUP BY ALL HAVING count(DISTINCT i) >= any_value(need)),
keyed AS (SELECT doc_id, number, k, size, p - i AS pos FROM known JOIN k USING (word) GROUP BY ALL HAVING count(DISTINCT i) = size),
asked AS (SELECT number, count(DISTINCT k) AS n_keys FROM k GROUP BY number),
good AS (SELECT s.doc_id, s.number, label, base, s.pos, s.n, m FROM spots s JOIN keyed y ON s.doc_id = y.doc_id AND s.number = y.number
  AND y.pos >= s.pos - slack AND y.pos + y.size <= s.pos + m + slack JOIN asked a ON s.number = a.number
  GROUP BY ALL HAVING count(DISTINCT k) = any_value(n_keys)),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(CAST(n AS DOUBLE) / m) AS score FROM good GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_line_dedup, op2_secret_scans, op3_bpe, op4_toxicity, op5_simhash, op6_decontamination, op7_substring_dedup,
    op8_language_id, op9_chat_format, op10_quality_rules, op11_merkle_manifest, op12_fill_in_middle, op13_license_scans)}
ORACLE = {"op1_line_dedup": OP1, "op2_secret_scans": _op2_sql(), "op6_decontamination": OP6, "op7_substring_dedup": OP7,
          "op9_chat_format": OP9, "op11_merkle_manifest": _op11_sql(), "op12_fill_in_middle": OP12, "op13_license_scans": _op13_sql()}
