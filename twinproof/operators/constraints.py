"""Graph form of the evidence and its constraint checks.

Triples: ``graph_id, s, p, o, o_kind (iri | literal), o_datatype``. Shapes are plain
aggregations and filters; there is no rule engine underneath.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions import canonical as C
from twinproof.functions.literals import lookup
from twinproof.functions.text import escape_ntriples
from twinproof.functions.verdicts import iso_date
from twinproof.profile import SIDES, TRUST_FUND, Profile
from twinproof.session import inline_dim, unrolled

ONTOLOGY, DATA = "urn:twinproof:ontology#", "urn:twinproof:data#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "rdf:type"

# Section -> class, section -> link from the fund node.
CLASSES = {"fund": "Fund", "party": "Party", "fee_schedule": "FeeSchedule",
           "redemption_terms": "RedemptionTerms"}
LINKS = {"party": "has_party", "fee_schedule": "has_fee_schedule",
         "redemption_terms": "has_redemption_terms"}
PREDICATE_ALIASES = {"fund.name": "fund_name", "fund.type": "fund_type"}

# Constraint messages.
MESSAGES = {
    "fund_name_min": "Fund must include fund_name raw_text.",
    "has_party_link": "Fund must link to Party.",
    "has_fee_schedule_link": "Fund must link to FeeSchedule.",
    "has_redemption_terms_link": "Fund must link to RedemptionTerms.",
    "maturity_order": "maturity_date must be after inception_date.",
    "contract_asset_manager_min": "Contract Party must include asset_manager raw_text.",
    "contract_trustee_exactly_one": "Contract Party must include exactly one trustee raw_text.",
    "im_asset_manager_min": "IM Party must include asset_manager raw_text.",
    "management_fee_min": "FeeSchedule must include management_fee raw_text.",
    "management_fee_range": "management_fee must be within 0.0% and 5.0%.",
}


def predicate_of(path: str) -> str:
    return PREDICATE_ALIASES.get(path, path.split(".", 1)[1])


def _triple(s: Column | str, p: Column | str, o: Column | str, kind: str, datatype: str | None = None) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        as_col(s).alias("s"), as_col(p).alias("p"), as_col(o).alias("o"), F.lit(kind).alias("o_kind"),
        F.lit(datatype).cast("string").alias("o_datatype"),
    )


def _structure() -> list[Column]:
    out = []
    for side in SIDES:
        for section, cls in CLASSES.items():
            out.append(_triple(f"{section}_{side}", RDF_TYPE, cls, "iri"))
        for section, link in LINKS.items():
            out.append(_triple(f"fund_{side}", link, f"{section}_{side}", "iri"))
    return out


def structure_triples(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Nodes, types and links of both sides, for one row per pair."""
    return (
        pairs.select(F.col(key).alias("graph_id"), F.explode(F.array(*_structure())).alias("t"))
        .select("graph_id", "t.*")
    )


def raw_triples(df: DataFrame, key: str = "pair_id", profile: Profile = TRUST_FUND, structure: bool = False) -> DataFrame:
    """Raw text literals of long evidence rows (null text is skipped).

    ``structure`` adds nodes, types and links at each pair's row of the profile's first field, so
    a whole graph comes from one scan.
    """
    section = F.substring_index("field", ".", 1)
    predicate = lookup(F.col("field"), {f: predicate_of(f) for f in profile.fields})
    cells = F.array(*[
        F.when(F.col(f"{s}_raw").isNotNull(),
               _triple(F.concat(section, F.lit(f"_{s}")), predicate, F.col(f"{s}_raw"), "literal"))
        for s in SIDES
    ])
    if structure:
        cells = F.when(F.col("field") == profile.fields[0], F.concat(F.array(*_structure()), cells)).otherwise(cells)
    return (
        unrolled(df, "t", cells).select(F.col(key).alias("graph_id"), "t.*")
    )


def extraction_triples(extractions: DataFrame, key: str = "pair_id", column: str = "extraction",
                       profile: Profile = TRUST_FUND) -> DataFrame:
    """Nested extractions -> all triples in one pass, one explode, no shuffle."""
    cells = []
    for path in profile.fields:
        section = path.split(".", 1)[0]
        for side in SIDES:
            raw = F.col(f"{column}.{path}")[side]["raw_text"]
            cells.append(F.when(raw.isNotNull(), _triple(f"{section}_{side}", predicate_of(path), raw, "literal")))
    return (
        unrolled(extractions, "t", F.array(*_structure(), *cells)).select(F.col(key).alias("graph_id"), "t.*")
    )


def detailed_triples(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """Value, unit, raw text, document, page and normalized predicates per cell.

    ``df`` is long evidence, optionally with ``<side>_normalized_value`` and
    ``<side>_normalized_unit`` (joined on (pair, field)); a numeric value is typed decimal.
    """
    section, leaf = F.substring_index("field", ".", 1), F.substring_index("field", ".", -1)
    numeric = r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$"
    cells = []
    for s in SIDES:
        subject = F.concat(section, F.lit(f"_{s}"))
        parts = [("value", "value", None), ("unit", "unit", None), ("raw_text", "raw", None),
                 ("document", "doc", None), ("page", "page", "xsd:integer"),
                 ("normalized_unit", "normalized_unit", None)]
        for suffix, column, datatype in parts:
            name = f"{s}_{column}"
            if name in df.columns:
                cells.append(F.when(F.col(name).isNotNull(), _triple(
                    subject, F.concat(leaf, F.lit(f"_{suffix}")), F.col(name).cast("string"), "literal", datatype)))
        name = f"{s}_normalized_value"
        if name in df.columns:
            value, predicate = F.col(name), F.concat(leaf, F.lit("_normalized_value"))
            cells.append(F.when(value.rlike(numeric), _triple(subject, predicate, value, "literal", "xsd:decimal")))
            cells.append(F.when(~value.rlike(numeric), _triple(subject, predicate, value, "literal")))
    return (
        unrolled(df, "t", F.array(*cells)).select(F.col(key).alias("graph_id"), "t.*")
    )


def property_dim(spark, profile: Profile = TRUST_FUND) -> DataFrame:
    """Domain and range class of every property (configuration)."""
    rows = [(link, "Fund", CLASSES[section]) for section, link in LINKS.items()]
    rows += [(predicate_of(f), CLASSES[f.split(".", 1)[0]], None) for f in profile.fields]
    return inline_dim(spark, [("p", "string"), ("domain", "string"), ("range", "string")], rows)


def infer_types(triples: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Type rows implied by domain and range, plus the stated ones, distinct.

    One pass suffices: the vocabulary has no sub-classes or sub-properties.
    """
    dims = property_dim(triples.sparkSession, profile)
    implied = unrolled(triples.join(dims, "p"), "t", F.array(
        F.when(F.col("domain").isNotNull(), F.struct(F.col("s").alias("node"), F.col("domain").alias("cls"))),
        F.when(F.col("range").isNotNull() & (F.col("o_kind") == "iri"),
               F.struct(F.col("o").alias("node"), F.col("range").alias("cls"))),
    )).select("graph_id", "t.*")
    stated = triples.filter(F.col("p") == RDF_TYPE).select("graph_id", F.col("s").alias("node"), F.col("o").alias("cls"))
    return implied.unionByName(stated).distinct()


# --- shapes -----------------------------------------------------------------------------------

_KOREAN_DATE = r"([0-9]{4})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일"


def order_number(text: Column) -> Column:
    """y*10000 + m*100 + d of the first Korean date: components compare as numbers, valid or not."""
    part = lambda i: F.regexp_extract(text, _KOREAN_DATE, i).cast("int")
    return F.when(text.rlike(_KOREAN_DATE), part(1) * 10000 + part(2) * 100 + part(3))


def _is(p: str) -> Column:
    return F.col("p") == p


def node_facts(triples: DataFrame, infer: bool = True, profile: Profile = TRUST_FUND) -> DataFrame:
    """One row per (graph, node): counts and extremes every shape needs, in one aggregation.

    Counts combine map-side, so a graph or node with very many triples is no hot spot.
    """
    strings = (F.col("o_kind") == "literal") & (F.col("o_datatype").isNull() | F.col("o_datatype").isin("xsd:string"))
    when = lambda cond, value: F.when(cond, value)
    fund_props = [predicate_of(f) for f in profile.fields if f.startswith("fund.")] + list(LINKS.values())
    fee_props = [predicate_of(f) for f in profile.fields if f.startswith("fee_schedule.")]
    inferred_fund = F.col("p").isin(*fund_props) if infer else F.lit(False)
    inferred_fee = F.col("p").isin(*fee_props) if infer else F.lit(False)
    # A link also tells the class of its object: one explode covers both ends in a single scan.
    own = F.struct(F.col("s").alias("node"), "p", "o", "o_kind", "o_datatype")
    both = F.array(own)
    if infer:
        target = (F.col("o_kind") == "iri") & (F.col("p") == "has_fee_schedule")
        both = F.array(own, F.when(target, F.struct(
            F.col("o").alias("node"), F.lit(RDF_TYPE).alias("p"), F.lit("FeeSchedule").alias("o"),
            F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))))
    subject = unrolled(triples, "t", both).select("graph_id", "t.*")
    is_type = _is(RDF_TYPE)
    count = lambda p: F.count_if(_is(p)).alias(f"n_{p}")
    typed = lambda p: F.count_if(_is(p) & ~strings).alias(f"bad_{p}")
    singles = ("fund_name", "asset_manager", "trustee", "management_fee")
    return subject.groupBy("graph_id", "node").agg(
        F.max(F.coalesce((is_type & (F.col("o") == "Fund")) | inferred_fund, F.lit(False))).alias("is_fund"),
        F.max(F.coalesce((is_type & (F.col("o") == "FeeSchedule")) | inferred_fee, F.lit(False))).alias("is_fee"),
        *[count(p) for p in singles], *[typed(p) for p in singles], *[count(p) for p in LINKS.values()],
        *[F.count_if(_is(p) & (F.col("o_kind") != "iri")).alias(f"bad_{p}") for p in LINKS.values()],
        F.count_if(when(_is("management_fee"), C.shape_percent(F.col("o"))) < 0.0).alias("n_low_fee"),
        F.count_if(when(_is("management_fee"), C.shape_percent(F.col("o"))) > 5.0).alias("n_high_fee"),
        F.max(when(_is("inception_date"), order_number(F.col("o")))).alias("last_inception"),
        F.min(when(_is("maturity_date"), order_number(F.col("o")))).alias("first_maturity"),
    )


def _node_rules(infer: bool) -> list[Column]:
    """Names of the rules a node's facts break (null where a rule holds)."""
    hit = lambda cond, name: F.when(cond, F.lit(name))
    fund, fee = F.col("is_fund"), F.col("is_fee")
    # Range inference gives link objects their class; only a literal object can break it.
    broken = lambda link: (F.col(f"n_{link}") < 1) | (F.col(f"bad_{link}") > 0) if infer else F.col(f"n_{link}") < 1
    return [
        hit(fund & ((F.col("n_fund_name") < 1) | (F.col("bad_fund_name") > 0)), "fund_name_min"),
        *[hit(fund & broken(link), f"{link}_link") for link in LINKS.values()],
        hit(fund & (F.col("first_maturity") <= F.col("last_inception")), "maturity_order"),
        hit(fee & ((F.col("n_management_fee") < 1) | (F.col("bad_management_fee") > 0)), "management_fee_min"),
        hit((F.col("n_low_fee") > 0) | (F.col("n_high_fee") > 0), "management_fee_range"),
    ]


_TARGETS = ("party_contract", "party_im")


def _target_counts() -> list[Column]:
    return [
        F.sum(F.when(F.col("node") == node, F.col(c)).otherwise(F.lit(0))).alias(f"{node}__{c}")
        for node in _TARGETS for c in ("n_asset_manager", "bad_asset_manager", "n_trustee", "bad_trustee")
    ]


def _target_rules() -> list[Column]:
    """Rules of the fixed target nodes, which apply even where a graph never mentions them."""
    bad = lambda node, p: (F.col(f"{node}__n_{p}") < 1) | (F.col(f"{node}__bad_{p}") > 0)
    on = lambda cond, node, name: F.when(cond, F.struct(F.lit(node).alias("focus"), F.lit(name).alias("constraint")))
    return [
        on(bad("party_contract", "asset_manager"), "party_contract", "contract_asset_manager_min"),
        on(bad("party_contract", "trustee") | (F.col("party_contract__n_trustee") > 1),
           "party_contract", "contract_trustee_exactly_one"),
        on(bad("party_im", "asset_manager"), "party_im", "im_asset_manager_min"),
    ]


def shape_violations(triples: DataFrame, infer: bool = True, profile: Profile = TRUST_FUND) -> DataFrame:
    """Violations ``graph_id, focus, constraint, message``; no row for a conforming graph."""
    facts = node_facts(triples, infer, profile)
    # Facts are computed once: a graph's few nodes carry their broken rules into the target counts.
    broken = F.array_compact(F.array(*_node_rules(infer)))
    own = F.transform(broken, lambda name: F.struct(F.col("node").alias("focus"), name.alias("constraint")))
    graphs = facts.withColumn("_own", own).groupBy("graph_id").agg(F.flatten(F.collect_list("_own")).alias("_own"), *_target_counts())
    found = F.concat("_own", F.array_compact(F.array(*_target_rules())))
    out = unrolled(graphs, "v", found).select("graph_id", "v.*")
    if not infer:
        out = out.unionByName(link_class_violations(triples, infer, profile))
    return out.withColumn("message", lookup(F.col("constraint"), MESSAGES))


def link_class_violations(triples: DataFrame, infer: bool = True, profile: Profile = TRUST_FUND) -> DataFrame:
    """Link objects that do not have the linked class. Range inference makes this hold for nodes."""
    links = triples.filter(F.col("p").isin(*LINKS.values()))
    wanted = lookup(F.col("p"), {link: CLASSES[s] for s, link in LINKS.items()})
    links = links.select("graph_id", F.col("s").alias("focus"), F.col("o").alias("node"), "o_kind",
                         wanted.alias("cls"), F.concat(F.col("p"), F.lit("_link")).alias("constraint"))
    if infer:
        bad = links.filter(F.col("o_kind") != "iri")
    else:
        types = triples.filter(_is(RDF_TYPE)).select("graph_id", F.col("s").alias("node"), F.col("o").alias("cls"))
        # Types grow with the graphs; size estimates don't see an explode's rows and would broadcast them.
        bad = links.join(types.hint("merge"), ["graph_id", "node", "cls"], "left_anti")
    return bad.select("graph_id", "focus", "constraint")


def conformance(triples: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """``graph_id, n_violations, conforms`` for every graph, from one scan of the triples."""
    facts = node_facts(triples, True, profile)
    as_count = lambda rules: sum((F.when(r.isNotNull(), 1).otherwise(0) for r in rules), F.lit(0))
    graphs = facts.withColumn("_n", as_count(_node_rules(True))).groupBy("graph_id").agg(
        F.sum("_n").alias("_nodes"), *_target_counts())
    total = F.col("_nodes") + as_count(_target_rules())
    return graphs.select("graph_id", total.alias("n_violations"), (total == 0).alias("conforms"))


#: Fields whose cells the shape rules read.
SHAPE_FIELDS = ("fund.name", "fund.inception_date", "fund.maturity_date", "party.asset_manager", "party.trustee",
                "fee_schedule.management_fee")


def row_violations(cell: Callable[[str, str], Column]) -> Column:
    """Broken rules of one pair as ``array<struct<focus, constraint>>``, from its own cells.

    ``cell(path, side)`` is a raw text. An extraction states every node and link and has one cell a
    field and side, so these are the violations of its graph, without building or shuffling it.
    """
    on = lambda cond, focus, name: F.when(cond, F.struct(F.lit(focus).alias("focus"), F.lit(name).alias("constraint")))
    found = []
    for s in SIDES:
        fee = cell("fee_schedule.management_fee", s)
        percent = C.shape_percent(fee)
        later, earlier = order_number(cell("fund.maturity_date", s)), order_number(cell("fund.inception_date", s))
        found += [
            on(cell("fund.name", s).isNull(), f"fund_{s}", "fund_name_min"),
            on(later <= earlier, f"fund_{s}", "maturity_order"),
            on(fee.isNull(), f"fee_schedule_{s}", "management_fee_min"),
            on((percent < 0.0) | (percent > 5.0), f"fee_schedule_{s}", "management_fee_range"),
            on(cell("party.asset_manager", s).isNull(), f"party_{s}", f"{s}_asset_manager_min"),
        ]
    found.append(on(cell("party.trustee", "contract").isNull(), "party_contract", "contract_trustee_exactly_one"))
    return F.array_compact(F.array(*found))


def shape_event(conforming: DataFrame) -> DataFrame:
    """The global guard event per graph: reported, nothing is emptied."""
    ok = F.col("conforms")
    return conforming.select(
        F.col("graph_id").alias("pair_id"), F.lit("G3").alias("guard"),
        F.when(ok, F.lit("pass")).otherwise(F.lit("reject")).alias("decision"),
        F.when(ok, F.lit("shacl_conforms")).otherwise(F.lit("shacl_violation")).alias("reason_code"),
    )


def normalized_rules(triples: DataFrame, profile: Profile = TRUST_FUND) -> DataFrame:
    """Fallback rules over normalized predicates: fee ranges and date order."""
    value = F.col("o")
    rows = triples.filter(F.col("p").endswith("_normalized_value"))
    leaf = F.regexp_replace("p", "_normalized_value$", "")
    limits = {f.split(".", 1)[1]: profile.policy(f) for f in profile.guard_range_fields}
    lo = lookup(leaf, {k: v.range_min for k, v in limits.items()})
    hi = lookup(leaf, {k: v.range_max for k, v in limits.items()})
    number = value.try_cast("double")
    # A value that is no number breaks the range too.
    fees = rows.filter(F.col("s").startswith("fee_schedule_") & lo.isNotNull()
                       & (number.isNull() | ~number.between(lo, hi))).select(
        "graph_id", F.col("s").alias("subject"), F.col("p").alias("field"),
        F.concat(leaf, F.lit(" must be between "), lo.cast("string"), F.lit(" and "), hi.cast("string"),
                 F.lit(" percent per year.")).alias("message"), value.alias("value"))
    earlier = F.when(F.col("p") == "inception_date_normalized_value", iso_date(value))
    later = F.when(F.col("p") == "maturity_date_normalized_value", iso_date(value))
    order = rows.filter(F.col("s").startswith("fund_")).groupBy("graph_id", "s").agg(
        F.max(earlier).alias("_a"), F.min(later).alias("_b")).filter("_b <= _a").select(
        "graph_id", F.col("s").alias("subject"), F.lit("maturity_date_normalized_value").alias("field"),
        F.lit("maturity_date must be after inception_date.").alias("message"), F.col("_b").cast("string").alias("value"))
    return fees.unionByName(order)


def triple_lines(triples: DataFrame) -> DataFrame:
    """N-Triples lines (one statement per line, so the dump splits)."""
    graph = F.concat(F.lit(DATA), F.col("graph_id").cast("string"), F.lit("/"))
    subject = F.concat(F.lit("<"), graph, F.col("s"), F.lit(">"))
    rdf_type = F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>")
    predicate = F.when(_is(RDF_TYPE), rdf_type).otherwise(F.concat(F.lit(f"<{ONTOLOGY}"), F.col("p"), F.lit(">")))
    node = F.when(_is(RDF_TYPE), F.concat(F.lit(f"<{ONTOLOGY}"), F.col("o"), F.lit(">"))).otherwise(
        F.concat(F.lit("<"), graph, F.col("o"), F.lit(">")))
    datatype = F.concat(F.lit(f"^^<{XSD}"), F.substring_index("o_datatype", ":", -1), F.lit(">"))
    literal = F.concat(F.lit('"'), escape_ntriples(F.col("o")), F.lit('"'), F.coalesce(datatype, F.lit("")))
    return triples.select(F.concat_ws(
        " ", subject, predicate, F.when(F.col("o_kind") == "iri", node).otherwise(literal), F.lit(".")
    ).alias("value"))
