"""Field catalogue and per-field policies (configuration, read once on the driver)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from importlib.resources import files
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from twinproof.session import inline_dim

SIDES = ("contract", "im")


@dataclass(frozen=True)
class FieldPolicy:
    field: str
    label: str
    value_type: str
    canonicalizer: str
    compare_policy: str
    judge_allowed: bool
    absence_semantics: str
    range_min: float | None = None
    range_max: float | None = None
    derive_from: str | None = None


@dataclass(frozen=True)
class Profile:
    name: str
    documents: dict[str, str]
    policies: tuple[FieldPolicy, ...]
    guard_range_fields: tuple[str, ...] = ()
    guard_date_fields: tuple[str, ...] = ()
    order_earlier: str | None = None
    order_later: str | None = None
    alias_fields: tuple[str, ...] = ()
    series_field: str | None = None
    normalization_targets: dict[str, str] = field(default_factory=dict)
    judge_routes: dict[str, str] = field(default_factory=dict)
    whole: tuple[str, ...] = ()

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(p.field for p in self.policies)

    @property
    def order(self) -> dict[str, int]:
        """Field -> place in the reading order; a part keeps the places of the whole profile."""
        return {f: i for i, f in enumerate(self.whole or self.fields)}

    def part(self, fields: tuple[str, ...]) -> Profile:
        """The profile of some fields only. Their rows know that no other field occurs (``whole`` is set)."""
        keep = lambda names: tuple(n for n in names if n in fields)
        return replace(
            self, policies=tuple(p for p in self.policies if p.field in fields), whole=self.whole or self.fields,
            guard_range_fields=keep(self.guard_range_fields), guard_date_fields=keep(self.guard_date_fields),
            order_later=self.order_later if self.order_later in fields else None, alias_fields=keep(self.alias_fields))

    def parts(self, fields: tuple[str, ...] | None = None) -> tuple[Profile, ...]:
        """Fields that are parsed alike, together: texts, percents, dates and the other notations. ``fields``: only these.

        The part with the last field in reading order is the last one: its row ends a pair's guard chain.
        """
        kinds: dict[str, list[str]] = {}
        for p in self.policies:
            if fields is not None and p.field not in fields:
                continue
            kind = {"none": "text", "percent": "percent", "date": "date", "maturity_date": "date"}.get(p.canonicalizer, "other")
            if p.field in self.guard_date_fields or p.derive_from:
                kind = "date"
            elif p.field in self.guard_range_fields:
                kind = "percent"
            kinds.setdefault(kind, []).append(p.field)
        in_order = sorted(kinds.values(), key=lambda names: self.order[names[-1]])
        return tuple(self.part(tuple(names)) for names in in_order)

    @property
    def sections(self) -> dict[str, tuple[str, ...]]:
        out: dict[str, list[str]] = {}
        for path in self.fields:
            section, leaf = path.split(".", 1)
            out.setdefault(section, []).append(leaf)
        return {k: tuple(v) for k, v in out.items()}

    def policy(self, path: str) -> FieldPolicy:
        return next(p for p in self.policies if p.field == path)

    @property
    def normalization_order(self) -> tuple[str, ...]:
        """Fields in the order the normalizer reports them: targets first, then the rest."""
        rest = [f for f in self.fields if f not in self.normalization_targets]
        return tuple(self.normalization_targets) + tuple(rest)


def _policy(raw: dict) -> FieldPolicy:
    known = {"field", "label", "value_type", "canonicalizer", "compare_policy",
             "judge_allowed", "absence_semantics", "range", "derive_from"}
    unknown = set(raw) - known
    if unknown:
        raise ValueError(f"unknown policy keys for {raw.get('field')}: {sorted(unknown)}")
    limits = raw.get("range") or {}
    return FieldPolicy(
        field=raw["field"], label=raw["label"], value_type=raw["value_type"],
        canonicalizer=raw["canonicalizer"], compare_policy=raw["compare_policy"],
        judge_allowed=bool(raw["judge_allowed"]), absence_semantics=raw["absence_semantics"],
        range_min=float(limits["min"]) if "min" in limits else None,
        range_max=float(limits["max"]) if "max" in limits else None,
        derive_from=raw.get("derive_from"),
    )


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML policies needs PyYAML; JSON works without it") from exc
        return yaml.safe_load(text)
    return json.loads(text)


def load_field_policies(path: str | Path) -> dict[str, FieldPolicy]:
    """Policies keyed by field; the file is a mapping, or a profile with a ``policies`` list."""
    raw = _read(Path(path) if isinstance(path, str) else path)
    items = raw["policies"] if "policies" in raw else [{"field": k, **v} for k, v in raw.items()]
    return {item["field"]: _policy(item) for item in items}


def load_profile(path: str | Path) -> Profile:
    path = Path(path) if isinstance(path, str) else path
    raw = _read(path)
    order = raw.get("order_rule", {})
    return Profile(
        name=raw["name"], documents=dict(raw["sides"]),
        policies=tuple(load_field_policies(path).values()),
        guard_range_fields=tuple(raw.get("guard_range_fields", ())),
        guard_date_fields=tuple(raw.get("guard_date_fields", ())),
        order_earlier=order.get("earlier"), order_later=order.get("later"),
        alias_fields=tuple(raw.get("alias_fields", ())), series_field=raw.get("series_field"),
        normalization_targets=dict(raw.get("normalization_targets", {})),
        judge_routes=dict(raw.get("judge_routes", {})),
    )


TRUST_FUND = load_profile(files("twinproof") / "profiles" / "trust_fund.json")  # also from a shipped archive


def policy_dim(spark: SparkSession, profile: Profile = TRUST_FUND) -> DataFrame:
    """Policy rows as a broadcast dimension keyed by ``field``."""
    rows = [
        (p.field, i, p.label, p.value_type, p.canonicalizer, p.compare_policy, p.judge_allowed,
         p.absence_semantics, p.range_min, p.range_max, p.derive_from)
        for i, p in enumerate(profile.policies)
    ]
    columns = [("field", "string"), ("ord", "int"), ("label", "string"), ("value_type", "string"),
               ("canonicalizer", "string"), ("compare_policy", "string"), ("judge_allowed", "boolean"),
               ("absence_semantics", "string"), ("range_min", "double"), ("range_max", "double"),
               ("derive_from", "string")]
    return inline_dim(spark, columns, rows)


def field_dim(spark: SparkSession, profile: Profile = TRUST_FUND) -> DataFrame:
    """Field catalogue: path, label, reading order and the normalizer's own order."""
    norm = {f: i for i, f in enumerate(profile.normalization_order)}
    rows = [(p.field, p.label, i, norm[p.field]) for i, p in enumerate(profile.policies)]
    return inline_dim(
        spark, [("field", "string"), ("label", "string"), ("ord", "int"), ("norm_ord", "int")], rows
    )


def target_dim(spark: SparkSession, profile: Profile = TRUST_FUND) -> DataFrame:
    """Normalization scope: field and the unit its values must come back in."""
    return inline_dim(spark, [("field", "string"), ("target_unit", "string")],
                      list(profile.normalization_targets.items()))
