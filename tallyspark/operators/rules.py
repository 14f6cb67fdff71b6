"""The rule language: declarations in YAML, validated on the driver and compiled to column expressions."""

from __future__ import annotations

import dataclasses
import logging
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError
from ..functions.coerce import NUMERIC, day, num, shown, type_of
from .digest import hash_record
from .findings import SEVERITIES, Check, emit, first_of_each

log = logging.getLogger(__name__)

#: The conditions, what each must state, and the placeholders of configured lists.
COMPARISONS = ("gt", "gte", "lt", "lte")
CONDITIONS = (*COMPARISONS, "eq", "neq", "in", "not_in", "is_null", "not_null", "matches", "not_matches", "weekend_transaction", "end_of_period", "cross_field_gt", "cross_field_eq", "compound")
NEEDS = {**dict.fromkeys(COMPARISONS, "threshold"), "eq": "value", "neq": "value", "in": "values", "not_in": "values", "matches": "pattern", "not_matches": "pattern", "cross_field_gt": "reference_field", "cross_field_eq": "reference_field"}
PLACEHOLDERS = ("__CONFIG_APPROVED_VENDORS__", "__CONFIG_PUBLIC_HOLIDAYS__")
#: Longer lists are joined, not written into the plan; up to so many bytes as a broadcast.
LIST_LIMIT, BROADCAST_BYTES = 200, 8 << 20


@dataclass
class Rule:
    id: str = ""
    name: str = ""
    condition: str = ""
    severity: str = "medium"
    description: str = ""
    field: str | None = None
    fields: list[str] = dataclasses.field(default_factory=list)
    threshold: float | None = None
    value: object = None
    values: object = None
    pattern: str | None = None
    reference_field: str | None = None
    logic: str | None = None
    conditions: list[dict] = dataclasses.field(default_factory=list)
    active: bool = True
    requires_cross_check: bool = False
    tags: list[str] = dataclasses.field(default_factory=list)
    audit_standard: str | None = None

    def targets(self) -> list[str]:
        """The columns that the rule is about; a row is found if any of them meets the condition."""
        return ([self.field] if self.field else []) + [f for f in self.fields or [] if f != self.field]


@dataclass(frozen=True)
class Settings:
    """Values that rules refer to: the fiscal year's last day, and the configured lists by placeholder."""

    fiscal_month: int = 12
    fiscal_day: int = 31
    lists: dict[str, list] = dataclasses.field(default_factory=dict)


def build(data: dict) -> Rule:
    """A rule from its declaration; unknown keys are reported and left out, absent keys keep their defaults."""
    known = {f.name for f in dataclasses.fields(Rule)}
    for key in data.keys() - known:
        log.warning("rule %s: unknown key %s", data.get("id"), key)
    return Rule(**{k: v for k, v in data.items() if k in known and v is not None})


def _leaf_errors(where: str, condition: str, get) -> list[str]:
    if condition not in CONDITIONS:
        return [f"{where}: unknown condition {condition!r}"]
    if condition == "compound":
        subs = get("conditions") or []
        errors = [] if get("logic") in ("AND", "OR") else [f"{where}: logic must be AND or OR"]
        errors += [] if subs else [f"{where}: a compound needs conditions"]
        for k, sub in enumerate(subs):
            at = f"{where}, condition {k + 1}"
            errors += _leaf_errors(at, sub.get("condition", ""), sub.get) if isinstance(sub, dict) else [f"{at}: not a mapping"]
        return errors
    errors = [] if get("field") or get("fields") else [f"{where}: needs a field"]
    need = NEEDS.get(condition)
    if need and get(need) is None:
        errors.append(f"{where}: {condition} needs {need}")
    if need == "threshold" and get(need) is not None and (isinstance(get(need), bool) or not isinstance(get(need), (int, float))):
        errors.append(f"{where}: threshold must be a number")
    if need == "pattern" and get(need) is not None:
        try:
            re.compile(get(need))
        except (re.error, TypeError) as error:
            errors.append(f"{where}: pattern does not compile: {error}")
    return errors


def errors_of(rule: Rule) -> list[str]:
    where = f"rule {rule.id or '?'}"
    errors = [] if re.fullmatch(r"[A-Z][0-9]{3}", rule.id or "") else [f"{where}: the id must be a capital letter and three digits"]
    errors += [] if rule.name else [f"{where}: needs a name"]
    errors += [] if rule.severity in SEVERITIES else [f"{where}: unknown severity {rule.severity!r}"]
    return errors + _leaf_errors(where, rule.condition, lambda k: getattr(rule, k, None))


def validate(rules: list[Rule]) -> list[str]:
    """All that is wrong with the rules, one by one and together."""
    ids = [r.id for r in rules]
    return [e for r in rules for e in errors_of(r)] + [f"rule {i}: the id occurs more than once" for i in sorted({i for i in ids if ids.count(i) > 1})]


def parse(data) -> list[Rule]:
    """Rules from loaded YAML: a list, or a mapping with `rules`; raises RuleError with the first thing wrong."""
    if data is None:
        return []
    data = data.get("rules") or [] if isinstance(data, dict) else data
    if not isinstance(data, list) or not all(isinstance(x, dict) for x in data):
        raise RuleError("a rule file must be a list of rules or a mapping with `rules`")
    rules = [build(x) for x in data]
    if wrong := validate(rules):
        raise RuleError(wrong[0])
    return rules


def load(path: str | Path) -> list[Rule]:
    try:
        return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except yaml.YAMLError as error:
        raise RuleError(f"{path}: {error}") from error


def default_rules(pack: str = "default") -> list[Rule]:
    return load(Path(__file__).parent.parent / "packs" / f"{pack}.yaml")


def resolved(rules: list[Rule], settings: Settings) -> list[Rule]:
    """The rules with configured lists in place of placeholders; rules whose list is empty are left out."""
    out = []
    for rule in rules:
        got = rule.values
        if isinstance(got, str) and got in PLACEHOLDERS or isinstance(got, list) and len(got) == 1 and got[0] in PLACEHOLDERS:
            values = settings.lists.get(got if isinstance(got, str) else got[0]) or []
            if not values:
                log.warning("rule %s: its list is not configured; left out", rule.id)
                continue
            rule = Rule(**{**rule.__dict__, "values": list(values)})
        out.append(rule)
    return out


def _typed(df: DataFrame, column: str, values: list) -> list:
    """Of a list's values, those of the column's own kind: numbers for numbers, text for text, no nulls."""
    kind = type_of(df, column)
    if isinstance(kind, NUMERIC):
        return [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if isinstance(kind, T.BooleanType):
        return [v for v in values if isinstance(v, bool)]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [str(v)[:10] for v in values if v is not None]
    return [v for v in values if isinstance(v, str)]


def membership(df: DataFrame, column: str, values: list) -> Column:
    """Whether the column, null-safe, is one of the values; dates compare by day."""
    typed = _typed(df, column, values)
    return F.coalesce(member_key(df, column).isin(typed), F.lit(False)) if typed else F.lit(False)


def member_key(df: DataFrame, column: str) -> Column:
    """What of a column is compared with a list of any length: dates by day, as text, and numbers as doubles."""
    kind = type_of(df, column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return day(df, column).cast("string")
    return num(df, column) if isinstance(kind, NUMERIC) else F.col(f"`{column}`")


def leaf(df: DataFrame, column: str, condition: str, get, settings: Settings) -> tuple[Column, object] | None:
    """(predicate, what was expected) of one condition on one column; None if a column that it names is missing."""
    if column not in df.columns or get("reference_field") and condition.startswith("cross") and get("reference_field") not in df.columns:
        log.warning("condition %s: column %s is missing", condition, column if column not in df.columns else get("reference_field"))
        return None
    c, value = F.col(f"`{column}`"), get("value")
    if condition in COMPARISONS:
        x, t = num(df, column), float(get("threshold"))
        return {"gt": x > t, "gte": x >= t, "lt": x < t, "lte": x <= t}[condition], get("threshold")
    if condition in ("eq", "neq"):
        if value is None:
            return (c.isNull() if condition == "eq" else c.isNotNull()), None
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            same = num(df, column) == float(value)
            return (same if condition == "eq" else c.isNotNull() & ~F.coalesce(same, F.lit(False))), value
        same = F.trim(F.coalesce(shown(df, column), F.lit(""))) == str(value)
        return (same if condition == "eq" else c.isNotNull() & ~same), value
    if condition in ("in", "not_in"):
        values = get("values") if isinstance(get("values"), list) else [get("values")]
        flag = membership_flag(df, column, values)
        found = F.col(flag) if flag in df.columns else membership(df, column, values)
        return (found if condition == "in" else c.isNotNull() & ~found), values
    if condition == "is_null":
        return c.isNull(), "not null"
    if condition == "not_null":
        return c.isNotNull(), "null"
    if condition in ("matches", "not_matches"):
        found = F.coalesce(shown(df, column), F.lit("")).rlike(get("pattern"))
        return (found if condition == "matches" else ~found), get("pattern")  # a null is "", so it does not match
    if condition == "weekend_transaction":
        return F.weekday(day(df, column)) >= 5, "weekend"
    if condition == "end_of_period":
        d = day(df, column)
        period = value if value in ("quarter", "year") else "month"
        if period == "year":
            return (F.month(d) == settings.fiscal_month) & (F.dayofmonth(d) == settings.fiscal_day), period
        last = F.last_day(d) == d
        return (last & (F.month(d) % 3 == 0) if period == "quarter" else last), period
    other = num(df, get("reference_field"))
    return (num(df, column) > other if condition == "cross_field_gt" else num(df, column) == other), get("reference_field")


def compiled(df: DataFrame, condition: str, get, settings: Settings) -> tuple[Column, object] | None:
    """(predicate, expected) of a condition, simple or compound. Null counts as false before AND, OR and NOT."""
    if condition == "compound":
        parts = [compiled(df, sub["condition"], sub.get, settings) for sub in get("conditions")]
        if not parts or any(p is None for p in parts):
            return None
        return reduce(and_ if get("logic") == "AND" else or_, [p[0] for p in parts]), get("logic")
    names = ([get("field")] if get("field") else []) + [f for f in get("fields") or [] if f != get("field")]
    parts = [p for p in (leaf(df, name, condition, get, settings) for name in names) if p is not None]
    if not parts:
        return None
    return reduce(or_, [F.coalesce(p[0], F.lit(False)) if len(parts) > 1 or condition not in COMPARISONS else p[0] for p in parts]), parts[0][1]


def check_of(df: DataFrame, rule: Rule, settings: Settings = Settings()) -> Check | None:
    """The check that a rule makes on df; None, with a warning, if a column is missing."""
    got = compiled(df, rule.condition, lambda k: getattr(rule, k, None), settings)
    if got is None:
        return None
    column = next((t for t in rule.targets() if t in df.columns), None) if rule.condition != "compound" else None
    actual = shown(df, column) if column else None
    about = rule.description or rule.name
    return Check(rule.id, rule.name, got[0], rule.severity, column, actual, got[1], f"{about} ({rule.condition})", 3, "anomaly")


def membership_flag(df: DataFrame, column: str, values: list) -> str:
    """The flag column of a long list on a column, by the list's place among those that with_memberships has joined."""
    if len(values) <= LIST_LIMIT:
        return ""
    return f"__in_{column}_{hash_record({'values': [str(v) for v in values], 'kinds': [type(v).__name__ for v in values]})}"


def with_memberships(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with a flag column for each long list of the rules: the list, which the driver holds, is joined as a small table."""

    def leaves(condition, get):
        if condition == "compound":
            for sub in get("conditions"):
                yield from leaves(sub["condition"], sub.get)
        elif condition in ("in", "not_in") and isinstance(get("values"), list) and len(get("values")) > LIST_LIMIT:
            for name in ([get("field")] if get("field") else []) + list(get("fields") or []):
                yield name, get("values")

    for rule in rules:
        for column, values in leaves(rule.condition, lambda k, r=rule: getattr(r, k, None)):
            flag = membership_flag(df, column, values)
            if column in df.columns and flag not in df.columns:
                kind = "double" if isinstance(type_of(df, column), NUMERIC) else "string"
                key = member_key(df, column).cast(kind)
                typed = list(dict.fromkeys(_typed(df, column, values)))
                size = sum(len(v.encode()) + 24 if isinstance(v, str) else 24 for v in typed)
                listed = df.sparkSession.createDataFrame([(v,) for v in typed], f"__key {kind}").withColumn(flag, F.lit(True))
                df = df.withColumn("__key", key).join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, "__key", "left").drop("__key").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return df


def fields_of(rules: list[Rule]) -> set[str]:
    """All columns that the rules name."""

    def named(condition, get):
        own = {get("field"), get("reference_field"), *(get("fields") or [])} - {None}
        return own.union(*[named(sub["condition"], sub.get) for sub in get("conditions") or []]) if condition == "compound" else own

    return set().union(*[named(r.condition, lambda k, r=r: getattr(r, k, None)) for r in rules], set())


class RuleEngine:
    """A set of rules, evaluated in one scan."""

    def __init__(self, rules: list[Rule], settings: Settings = Settings()):
        if wrong := validate(rules):
            raise RuleError(wrong[0])
        self.settings, self.rules = settings, resolved(rules, settings)

    @classmethod
    def load_from_yaml(cls, path: str | Path, settings: Settings = Settings()) -> RuleEngine:
        return cls(load(path), settings)

    def evaluate(self, df: DataFrame, session_id: str = "session", row_index: str = "row_index", snapshot: list[str] | None = None) -> DataFrame:
        """The findings of all active rules. A rule finds a row at most once, as each rule is evaluated once per row and ids
        are unique, so no shuffle is needed to remove repeats."""
        active = [r for r in self.rules if r.active]
        df = with_memberships(df, active)
        checks = [c for c in (check_of(df, r, self.settings) for r in active) if c is not None]
        return emit(df, checks, session_id, row_index, snapshot)

    def evaluate_rule(self, df: DataFrame, rule: Rule, session_id: str = "session", row_index: str = "row_index") -> DataFrame:
        df = with_memberships(df, [rule])
        check = check_of(df, rule, self.settings)
        return emit(df, [check] if check else [], session_id, row_index)


__all__ = ["Rule", "RuleEngine", "RuleError", "Settings", "build", "check_of", "default_rules", "errors_of", "first_of_each", "load", "parse", "resolved", "validate"]
