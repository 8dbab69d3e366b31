"""Evidence tables: strict intake, nested <-> long forms, side merging.

Long form, one row per (pair, field): ``pair_id, field`` and for each side the columns
``<side>_value, <side>_unit, <side>_raw, <side>_page, <side>_doc``. A side is cited when
``<side>_page`` is set. ``<side>_ref_raw/page/doc`` carry the same side's reference cell
(the field that other fields derive from), so that derivation and order rules stay
row-local: no self-join, no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.text import json_element, json_signature, strip_fence
from twinproof.profile import SIDES, TRUST_FUND, Profile, field_dim
from twinproof.session import unrolled

CELL_PARTS = ("value", "unit", "raw", "page", "doc")
REF_PARTS = ("raw", "page", "doc")

CITATION = T.StructType([T.StructField("document", T.StringType()), T.StructField("page", T.IntegerType())])
DOCUMENT_VALUE = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("unit", T.StringType()),
    T.StructField("raw_text", T.StringType()), T.StructField("citation", CITATION),
])
COMPARABLE = T.StructType([T.StructField(s, DOCUMENT_VALUE) for s in SIDES])


def extraction_schema(profile: Profile = TRUST_FUND) -> T.StructType:
    out = [T.StructField("schema_version", T.StringType())]
    for section, leaves in profile.sections.items():
        out.append(T.StructField(section, T.StructType([T.StructField(x, COMPARABLE) for x in leaves])))
    return T.StructType(out)


# --- strict intake ------------------------------------------------------------------------


def _shape_pattern(profile: Profile) -> str:
    """Type signature every valid document has (keys in the order Spark reports them)."""
    text = "(?:VOID|STRING)"
    cite = "(?:VOID|OBJECT<document: STRING, page: BIGINT>)"
    cell = f"OBJECT<citation: {cite}, raw_text: {text}, unit: {text}, value: {text}>"
    both = f"OBJECT<contract: {cell}, im: {cell}>"
    parts = {"schema_version": "STRING"}
    for section, leaves in profile.sections.items():
        parts[section] = "OBJECT<" + ", ".join(f"{x}: {both}" for x in sorted(leaves)) + ">"
    return "^OBJECT<" + ", ".join(f"{k}: {parts[k]}" for k in sorted(parts)) + ">$"


def _key_problems(path: Column, keys: Column, expected: list[str]) -> Column:
    # Below a missing parent there is nothing to report.
    want = F.array(*[F.lit(k) for k in expected])
    have = F.coalesce(keys, want)
    unknown = F.transform(F.array_except(have, want), lambda k: F.concat(F.lit("unknown_key:"), path, k))
    missing = F.transform(F.array_except(want, have), lambda k: F.concat(F.lit("missing_key:"), path, k))
    return F.concat(unknown, missing)


def _loose_schema(profile: Profile) -> str:
    return ", ".join(["schema_version string", *[f"{s} map<string,map<string,map<string,string>>>" for s in profile.sections]])


def _structure_problems(keys: Column, doc: Column, profile: Profile) -> Column:
    """Key report from columns: lambdas are interpreted, and a parser inside would run once an element."""
    sections = profile.sections
    root = _key_problems(F.lit("$."), keys, ["schema_version", *sections])
    level1 = F.array(*[
        F.struct(F.lit(f"$.{s}.").alias("path"), F.map_keys(doc[s]).alias("keys"),
                 F.array(*[F.lit(x) for x in leaves]).alias("want"))
        for s, leaves in sections.items()
    ])
    level2 = F.array(*[
        F.struct(F.lit(f"$.{s}.{x}.").alias("path"), F.map_keys(doc[s][x]).alias("keys"))
        for s, leaves in sections.items() for x in leaves
    ])
    level3 = F.array(*[
        F.struct(F.lit(f"$.{s}.{x}.{d}.").alias("path"), F.map_keys(doc[s][x][d]).alias("keys"))
        for s, leaves in sections.items() for x in leaves for d in SIDES
    ])

    def of_section(e: Column) -> Column:
        have = F.coalesce(e["keys"], e["want"])
        return F.concat(
            F.transform(F.array_except(have, e["want"]), lambda k: F.concat(F.lit("unknown_key:"), e["path"], k)),
            F.transform(F.array_except(e["want"], have), lambda k: F.concat(F.lit("missing_key:"), e["path"], k)),
        )

    found = F.concat(
        root,
        F.flatten(F.transform(level1, of_section)),
        F.flatten(F.transform(level2, lambda e: _key_problems(e["path"], e["keys"], list(SIDES)))),
        F.flatten(F.transform(level3, lambda e: _key_problems(
            e["path"], e["keys"], ["value", "unit", "raw_text", "citation"]))),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("bad_type:$")))


def _cells(doc: Column, profile: Profile) -> Column:
    return F.array(*[
        F.struct(F.lit(f"{s}.{x}.{d}").alias("path"), F.lit(profile.documents[d]).alias("expected"),
                 doc[s][x][d].alias("cell"))
        for s, leaves in profile.sections.items() for x in leaves for d in SIDES
    ])


def _own_form(doc: Column, profile: Profile) -> Column:
    """Has a parsed document every object it must have, and citations with both parts?"""
    cells = [doc[s][x][d] for s, leaves in profile.sections.items() for x in leaves for d in SIDES]
    out = doc["schema_version"].isNotNull()
    for cell in cells:
        cite = cell["citation"]
        out = out & cell.isNotNull() & (cite.isNull() | (cite["document"].isNotNull() & cite["page"].isNotNull()))
    return out


def _clean(doc: Column, profile: Profile) -> Column:
    """No cell of a well-formed document has a problem; what ``cell_problems`` says without its lambda."""
    documents, out = list(profile.documents.values()), doc["schema_version"] == "v0"
    for cell in [doc[s][x][d] for s, leaves in profile.sections.items() for x in leaves for d in SIDES]:
        cite = cell["citation"]
        out = out & F.when(cite.isNull(), cell["raw_text"].isNull()).otherwise(cite["document"].isin(*documents) & (cite["page"] >= 1))
    return F.coalesce(out, F.lit(False))


def validate_extractions(df: DataFrame, text: str = "raw_json", profile: Profile = TRUST_FUND,
                         fenced: bool = True) -> DataFrame:
    """Add ``extraction`` (null when rejected) and ``violations`` for a raw JSON column.

    A document that is written again as the very same text has exactly the expected keys and types, so nothing
    else needs to look at them. Any other one (another layout or order of keys, a defect) is parsed to a type
    signature; only documents that miss that pay for the detailed key report.
    """
    documents = list(profile.documents.values())
    body = strip_fence(F.col(text)) if fenced else F.col(text)
    staged = df.withColumn("_body", body).withColumn("_read", F.from_json("_body", extraction_schema(profile)))
    again = F.to_json("_read", {"ignoreNullFields": "false"}) == F.col("_body")
    staged = staged.withColumn("_own", F.coalesce(again & _own_form(F.col("_read"), profile), F.lit(False)))
    staged = staged.withColumn("_parsed", json_element(F.when(~F.col("_own"), F.col("_body"))))
    staged = staged.withColumn("_signature", json_signature(F.col("_parsed"))).drop("_parsed")
    staged = staged.withColumns({
        "_object": F.col("_own") | F.coalesce(F.col("_signature").startswith("OBJECT"), F.lit(False)),
        "_shape": F.col("_own") | F.coalesce(F.col("_signature").rlike(_shape_pattern(profile)), F.lit(False)),
    }).drop("_signature", "_own")
    odd = F.col("_object") & ~F.col("_shape")
    staged = staged.withColumns({
        "_doc": F.when(F.col("_shape"), F.col("_read")),
        "_keys": F.when(odd, F.json_object_keys("_body")),
        "_loose": F.when(odd, F.from_json("_body", _loose_schema(profile))),
    }).drop("_read")

    def cell_problems(e: Column) -> Column:
        cell = e["cell"]
        page, document = cell["citation"]["page"], cell["citation"]["document"]
        cited = cell["citation"].isNotNull()
        return F.array_compact(F.array(
            F.when(cited & ~document.isin(*documents), F.concat(F.lit("bad_document:"), e["path"])),
            F.when(cited & ~(F.coalesce(page, F.lit(0)) >= 1), F.concat(F.lit("bad_page:"), e["path"])),
            F.when(cell["raw_text"].isNotNull() & ~cited,
                   F.concat(F.lit("raw_text_without_citation:"), e["path"])),
        ))

    version = F.when(F.col("_doc.schema_version") != "v0", F.array(F.lit("bad_version:$.schema_version"))
                     ).otherwise(F.array().cast("array<string>"))
    problems = (
        F.when(~F.col("_object"), F.array(F.lit("json_invalid:$")))
        .when(~F.col("_shape"), _structure_problems(F.col("_keys"), F.col("_loose"), profile))
        .when(_clean(F.col("_doc"), profile), F.array().cast("array<string>"))
        .otherwise(F.concat(version, F.flatten(F.transform(_cells(F.col("_doc"), profile), cell_problems))))
    )
    return (
        staged.withColumn("violations", problems)
        .withColumn("extraction", F.when(F.size("violations") == 0, F.col("_doc")))
        .drop("_body", "_object", "_shape", "_doc", "_keys", "_loose")
    )


# --- nested <-> long ------------------------------------------------------------------------


def _cell_columns(cell: Column, side: str) -> list[Column]:
    return [
        cell["value"].alias(f"{side}_value"), cell["unit"].alias(f"{side}_unit"),
        cell["raw_text"].alias(f"{side}_raw"), cell["citation"]["page"].alias(f"{side}_page"),
        cell["citation"]["document"].alias(f"{side}_doc"),
    ]


def flatten(df: DataFrame, keys: list[str], extraction: str = "extraction",
            profile: Profile = TRUST_FUND) -> DataFrame:
    """Nested extraction -> 14 long rows, each carrying its side's reference cell.

    A part of a profile gives its fields' rows; without a derived field among them no reference columns.
    """
    rows = []
    derives = not profile.whole or any(p.derive_from for p in profile.policies)
    for path in profile.fields:
        ordinal = profile.order[path]
        node = F.col(f"{extraction}.{path}")
        columns = [F.lit(path).alias("field"), F.lit(ordinal).alias("ord")]
        for side in SIDES:
            columns += _cell_columns(node[side], side)
        for side in SIDES if derives else ():
            derive = profile.policy(path).derive_from
            ref = F.col(f"{extraction}.{derive}")[side] if derive else None
            for part, dtype in (("raw", "string"), ("page", "int"), ("doc", "string")):
                name = f"{side}_ref_{part}"
                source = {"raw": "raw_text", "page": "page", "doc": "document"}[part]
                if ref is None:
                    columns.append(F.lit(None).cast(dtype).alias(name))
                else:
                    value = ref[source] if part == "raw" else ref["citation"][source]
                    columns.append(value.alias(name))
        rows.append(F.struct(*columns))
    # Built in a projection of its own; texts and pages are never null as a whole, so every row stays.
    return unrolled(df, "_row", F.array(*rows)).select(*keys, "_row.*")


def flatten_parts(df: DataFrame, keys: list[str], chain, extraction: str = "extraction",
                  profile: Profile = TRUST_FUND, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``flatten`` after ``chain(rows, part)``, one part of the profile at a time.

    In a part of like fields most of a chain's cases are settled before it runs (no dates among percents), so rows
    pass few and narrow projections. Each part reads its own columns of ``df``: a scan, or a cheap projection of
    one; store what is costly. A stream is flattened in one piece, its source would be read once a part.
    ``fields`` limits the parts to some fields.
    """
    if df.isStreaming:
        return chain(flatten(df, keys, extraction, profile), profile)
    out = None
    for part in profile.parts(fields):
        rows = chain(flatten(df, keys, extraction, part), part)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def cell_struct(side: str) -> Column:
    """The cell columns of one side as a nested document value (null parts kept)."""
    page, doc = F.col(f"{side}_page"), F.col(f"{side}_doc")
    citation = F.when(page.isNotNull(), F.struct(doc.alias("document"), page.cast("int").alias("page")))
    return F.struct(
        F.col(f"{side}_value").alias("value"), F.col(f"{side}_unit").alias("unit"),
        F.col(f"{side}_raw").alias("raw_text"), citation.alias("citation"),
    )


def nest(df: DataFrame, keys: list[str], profile: Profile = TRUST_FUND) -> DataFrame:
    """Long rows -> one nested extraction per key; fields without a row become empty cells."""
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in DOCUMENT_VALUE])
    cell = F.struct(*[cell_struct(side).alias(side) for side in SIDES])
    picked = [
        F.first(F.when(F.col("field") == path, cell), ignorenulls=True).alias(path.replace(".", "__"))
        for path in profile.fields
    ]
    wide = df.groupBy(*keys).agg(*picked)
    blank = F.struct(*[empty.alias(s) for s in SIDES])
    sections = [
        F.struct(*[
            F.coalesce(F.col(f"{section}__{leaf}"), blank).alias(leaf) for leaf in leaves
        ]).alias(section)
        for section, leaves in profile.sections.items()
    ]
    return wide.select(*keys, F.struct(F.lit("v0").alias("schema_version"), *sections).alias("extraction"))


def from_case(df: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Labelled cases -> evidence: absent raw text has no citation; absent or bad pages become 1."""
    out = df
    for side in SIDES:
        raw, page = F.col(f"{side}_raw"), F.col(f"{side}_page")
        out = (
            out.withColumn(f"{side}_page", F.when(
                raw.isNotNull(), F.coalesce(F.when(page > 0, page), F.lit(1)).cast("int")))
            .withColumn(f"{side}_doc", F.when(raw.isNotNull(), F.lit(profile.documents[side])))
        )
    return out


def nullify(df: DataFrame, side: str, when: Column, parts: tuple[str, ...] = CELL_PARTS) -> DataFrame:
    """Empty one side's cell where ``when`` holds."""
    keep, have = ~F.coalesce(when, F.lit(False)), df.columns
    return df.withColumns({f"{side}_{p}": F.when(keep, F.col(f"{side}_{p}")) for p in parts if f"{side}_{p}" in have})


def has_evidence(side: str) -> Column:
    return F.col(f"{side}_raw").isNotNull() & F.col(f"{side}_page").isNotNull()


def merge_sides(side_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One-document extractions -> comparable rows, by conditional aggregation.

    Input has ``side`` plus the cell parts; one shuffle with map-side combine replaces the
    full outer join of the two halves, and a missing half simply leaves its cell empty.
    """
    cell = F.struct(*[F.col(p) for p in CELL_PARTS])
    merged = side_rows.groupBy(*keys, "field").agg(*[
        F.first(F.when(F.col("side") == s, cell), ignorenulls=True).alias(f"_{s}") for s in SIDES
    ])
    columns = [F.col(f"_{s}")[p].alias(f"{s}_{p}") for s in SIDES for p in CELL_PARTS]
    return merged.select(*keys, "field", *columns)


def split_sides(df: DataFrame, keys: list[str]) -> DataFrame:
    """Comparable rows -> one row per side (no shuffle)."""
    halves = F.array(*[
        F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{p}").alias(p) for p in CELL_PARTS if f"{s}_{p}" in df.columns])
        for s in SIDES
    ])
    return unrolled(df, "_half", halves).select(*keys, "field", "_half.*")


def attach_reference(df: DataFrame, keys: list[str], profile: Profile = TRUST_FUND) -> DataFrame:
    """Give long rows their reference cells when the input never was nested.

    Only the derived field needs them, so only those rows take part in the join; the rest of
    the table passes by without a shuffle.
    """
    derived = {p.field: p.derive_from for p in profile.policies if p.derive_from}
    empty = {f"{s}_ref_{p}": F.lit(None).cast("int" if p == "page" else "string")
             for s in SIDES for p in REF_PARTS}
    out = df.filter(~F.col("field").isin(*derived)).withColumns(empty)
    for target, source in derived.items():
        refs = (
            df.filter(F.col("field") == source).groupBy(*keys)
            .agg(*[F.first(f"{s}_{p}").alias(f"{s}_ref_{p}") for s in SIDES for p in REF_PARTS])
        )
        out = out.unionByName(df.filter(F.col("field") == target).join(refs, keys, "left"))
    return out


def attach_labels(df: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    dims = field_dim(df.sparkSession, profile).select("field", "label")
    return df.drop("label").join(dims, "field", "left") if "label" in df.columns else df.join(dims, "field", "left")


def role_violations(documents: DataFrame, profile: Profile = TRUST_FUND, key: str = "pair_id") -> DataFrame:
    """Pairs that do not have exactly one document of each role."""
    roles = list(profile.documents.values())
    counts = documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_documents"),
        *[F.count_if(F.col("role") == r).alias(f"_n{i}") for i, r in enumerate(roles)],
    )
    ok = (F.col("n_documents") == len(roles)) & (F.col("_n0") == 1) & (F.col("_n1") == 1)
    reason = F.when(F.col("n_documents") != len(roles), F.lit("document_count")).otherwise(F.lit("document_roles"))
    return counts.filter(~ok).select(key, "n_documents", reason.alias("reason_code"))


def role_order(role: Column, profile: Profile = TRUST_FUND) -> Column:
    """Contract first, then the memo, then anything else."""
    out = F.lit(len(profile.documents))
    for i, name in reversed(list(enumerate(profile.documents.values()))):
        out = F.when(role == name, F.lit(i)).otherwise(out)
    return out
