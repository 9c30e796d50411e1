"""The catalogue of rules: id, pillar, severity, confidence and, for some, a threshold; and the presets of profiles."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from sievework.operators.descriptions import TEXTS


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pillar: str
    severity: str
    confidence: str
    threshold: float | None = None
    description: str = ""
    remediation: str = ""
    option_keys: tuple[str, ...] = ()
    list_keys: tuple[str, ...] = ()


# Fixed values, one rule a line: id, pillar, severity, confidence, threshold.
_TABLE = """
complexity.cognitive complexity warning high 15
complexity.cyclomatic complexity warning high 15
dead-code.unused-private-method dead-code advisory low
design.circular-import design warning medium
design.deep-relative-import design advisory medium 2
design.large-module-concentration design advisory medium 55
design.package-bin-missing design warning high
design.package-bin-not-executable design warning high
docs.fixture-purpose-missing documentation advisory medium
docs.magic-threshold-without-rationale documentation advisory medium
docs.missing-error-behavior-doc documentation advisory medium
docs.missing-exported-function-doc documentation warning medium
docs.missing-file-overview documentation advisory medium
docs.missing-interface-doc documentation advisory medium
docs.missing-internal-function-doc documentation advisory medium
docs.missing-invariant-doc documentation advisory medium
docs.missing-param-tag documentation advisory medium
docs.missing-public-doc documentation advisory medium
docs.missing-return-tag documentation advisory medium
docs.missing-side-effect-doc documentation advisory medium
docs.missing-why-for-complex-code documentation advisory medium
docs.stale-comment documentation advisory medium
docs.stale-param-tag documentation advisory medium
docs.suppression-without-rationale documentation advisory medium
docs.todo-without-tracking documentation advisory high
docs.useless-docblock documentation advisory medium
waste.any-type maintainability warning high
waste.broad-runtime-version maintainability advisory medium
waste.commented-out-code maintainability advisory high
waste.console-log maintainability advisory high
waste.empty-function maintainability advisory high
waste.exported-any maintainability warning medium
waste.redundant-boolean-cast maintainability advisory medium
waste.redundant-variable maintainability advisory medium
waste.swallowed-catch maintainability warning medium
waste.unreachable-code maintainability warning high
waste.unused-import maintainability advisory medium
waste.unused-parameter maintainability advisory medium
waste.useless-catch maintainability advisory high
waste.useless-return maintainability advisory medium
modernisation.date-now-candidate modernisation advisory high
modernisation.double-cast modernisation warning medium
modernisation.loose-equality modernisation advisory medium
modernisation.non-null-assertion modernisation warning medium
modernisation.nullish-coalescing-candidate modernisation advisory medium
modernisation.object-spread-candidate modernisation advisory medium
modernisation.optional-chaining-candidate modernisation advisory medium
modernisation.public-property modernisation advisory high
modernisation.readonly-property-candidate modernisation advisory medium
modernisation.ts-comment-without-rationale modernisation warning medium
modernisation.tsconfig-exact-optional-disabled modernisation warning high
modernisation.tsconfig-index-safety-disabled modernisation warning high
modernisation.tsconfig-strict-disabled modernisation warning high
modernisation.var-declaration modernisation advisory high
naming.acronym-case naming advisory medium
naming.boolean-prefix naming advisory medium
naming.class-file-mismatch naming advisory medium
naming.generic-function naming advisory high
naming.generic-parameter naming advisory medium
naming.hungarian-notation naming advisory medium
naming.identifier-quality naming advisory medium
naming.inconsistent-casing naming advisory medium
naming.negative-boolean naming advisory medium
naming.short-variable naming advisory medium
security.async-foreach security warning medium
security.disabled-tls-verification security error high
security.document-write security warning high
security.dynamic-regexp security warning medium
security.eval-call security error high
security.floating-promise security warning medium
security.github-actions-broad-permissions security warning medium
security.github-actions-pull-request-target security warning medium
security.github-actions-remote-shell security warning medium
security.github-actions-secrets-in-pr security warning medium
security.github-actions-unpinned-action security warning medium
security.inner-html security warning high
security.insecure-random security warning high
security.javascript-url security error high
security.new-function security error high
security.open-redirect-candidate security warning medium
security.path-traversal-candidate security warning medium
security.process-exec security warning high
security.proto-access security warning medium
security.remote-install-script security error medium
security.risky-lifecycle-script security warning medium
security.sql-concatenation security warning high
security.ssrf-candidate security warning medium
security.string-timer security warning high
security.throw-non-error security warning medium
security.unsafe-deserialization security warning medium
security.url-dependency security warning medium
security.weak-crypto security warning high
security.xxe-candidate security warning medium
sensitive-data.api-key-pattern sensitive-data error high
sensitive-data.aws-access-key sensitive-data error high
sensitive-data.database-url-password sensitive-data error high
sensitive-data.gcp-service-account-key sensitive-data error high
sensitive-data.hardcoded-env-value sensitive-data error medium 16
sensitive-data.high-entropy-string sensitive-data error medium 32
sensitive-data.jwt-token sensitive-data error high
sensitive-data.phi-pattern sensitive-data error high
sensitive-data.pii-pattern sensitive-data error high
sensitive-data.private-key sensitive-data error high
size.file-length size warning high 750
size.function-length size warning high 200
size.parameter-count size warning high 7
test-quality.conditional-logic test-quality advisory high
test-quality.exception-type-only test-quality advisory high
test-quality.global-state-mutation test-quality warning high
test-quality.loop-in-test test-quality advisory high
test-quality.magic-number-assertion test-quality advisory medium
test-quality.missing-nearby-test test-quality advisory medium
test-quality.mock-only-test test-quality advisory high
test-quality.no-assertions test-quality warning high
test-quality.no-throw-only-test test-quality advisory high
test-quality.only-skip test-quality advisory high
test-quality.setup-bloat test-quality advisory medium 12
test-quality.sleep-in-test test-quality advisory high
test-quality.snapshot-only-test test-quality advisory high
test-quality.trivial-assertion test-quality warning high
test-quality.unused-mock test-quality advisory medium
"""

RULES: dict[str, Rule] = {}
for _line in _TABLE.split("\n"):
    if _line:
        _id, _pillar, _severity, _confidence, *_threshold = _line.split()
        RULES[_id] = Rule(_id, _pillar, _severity, _confidence, float(_threshold[0]) if _threshold else None, *TEXTS[_id])


# Options of rules besides their threshold, with their defaults. Fixed values.
OPTIONS: dict[str, dict[str, float]] = {
    "design.large-module-concentration": {"minFiles": 4, "minLines": 80},
    "naming.generic-parameter": {"minParameters": 3, "minLineCount": 30, "minCyclomatic": 8},
}
# The lists of names that a rule reads. Fixed values.
LISTS: dict[str, tuple[str, ...]] = {
    "naming.acronym-case": ("known_acronyms",), "naming.boolean-prefix": ("accepted_boolean_names", "boolean_prefixes"), "naming.generic-function": ("banned_generic_names",), "naming.generic-parameter": ("placeholder_names",),
    "naming.hungarian-notation": ("hungarian_prefixes",), "naming.identifier-quality": ("placeholder_names",), "naming.negative-boolean": ("negative_boolean_allowed",), "naming.short-variable": ("accepted_abbreviations",),
}
for _id in {*OPTIONS, *LISTS}:
    RULES[_id] = replace(RULES[_id], option_keys=tuple(OPTIONS.get(_id, ())), list_keys=LISTS.get(_id, ()))


@dataclass(frozen=True)
class Config:
    """What a run may change: thresholds, disabled rules, name lists, ignored paths. The lists are fixed values."""

    thresholds: dict[str, float] = field(default_factory=dict)
    options: dict[str, dict[str, float]] = field(default_factory=dict)
    severities: dict[str, str] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    ignored_paths: tuple[str, ...] = ()
    #: Severity from which on a command fails, per command.
    minimum_severity: dict[str, str] = field(default_factory=dict)
    secret_previews: frozenset[str] = frozenset()
    accepted_abbreviations: frozenset[str] = frozenset("age app cb db fn fs id io key log max min now raw rx tx ui url".split())
    banned_generic_names: frozenset[str] = frozenset("process handle doit run execute manage".split())
    accepted_boolean_names: frozenset[str] = frozenset("all apply check dev enabled force fresh harness json ok verbose yes".split())
    boolean_prefixes: frozenset[str] = frozenset("is has can should does did was will may in scan supports requires allow check enable exclude include omit skip with without".split())
    hungarian_prefixes: frozenset[str] = frozenset("str obj arr bool int num".split())
    placeholder_names: frozenset[str] = frozenset("foo bar baz tmp temp thing stuff data value item".split())
    negative_boolean_allowed: frozenset[str] = frozenset("nostore nofollow noreferrer noscript noindex".split())
    known_acronyms: frozenset[str] = frozenset("url http https id xml json html css api sql db io ui uuid ip tcp udp ast cli npm".split())

    def threshold(self, rule_id: str) -> float:
        value = self.thresholds.get(rule_id, RULES[rule_id].threshold)
        if value is None:
            raise KeyError(f"{rule_id} has no threshold")
        return value

    def option(self, rule_id: str, name: str) -> float:
        return self.options.get(rule_id, {}).get(name, OPTIONS[rule_id][name])

    def enabled(self, rule_id: str) -> bool:
        return rule_id not in self.disabled


# Presets: what a profile changes against the defaults. Fixed values.
PROFILES: dict[str, dict] = {
    "minimal": {"only_pillars": ("security", "sensitive-data")},
    "recommended": {},
    "strict": {
        "thresholds": {"complexity.cognitive": 10.0, "complexity.cyclomatic": 10.0, "size.file-length": 400.0, "size.function-length": 60.0, "size.parameter-count": 4.0, "test-quality.setup-bloat": 8.0, "design.deep-relative-import": 1.0, "design.large-module-concentration": 40.0, "sensitive-data.hardcoded-env-value": 12.0, "sensitive-data.high-entropy-string": 24.0}
    },
}


class ConfigError(ValueError):
    """A configuration that cannot be used, with what is wrong in the message."""


def resolve_profile(name: str, custom: dict[str, dict] | None = None, seen: tuple[str, ...] = ()) -> dict:
    """A profile with what it extends; the child's values win, field by field. Unknown names and cycles raise."""
    known = PROFILES | (custom or {})
    if name in seen:
        raise ConfigError("profiles extend each other: " + " -> ".join([*seen, name]))
    if name not in known:
        raise ConfigError(f"unknown profile {name!r}; known are {', '.join(sorted(known))}")
    own = known[name]
    base = resolve_profile(own["extends"], custom, (*seen, name)) if "extends" in own else {}
    unknown = {*own.get("thresholds", {}), *own.get("severities", {}), *own.get("disabled", ())} - set(RULES)
    if unknown:
        raise ConfigError(f"unknown rules {sorted(unknown)}")
    merged = base | {k: v for k, v in own.items() if k not in ("extends", "thresholds", "severities", "disabled")}
    for key in ("thresholds", "severities"):
        merged[key] = base.get(key, {}) | own.get(key, {})
    merged["disabled"] = frozenset(base.get("disabled", ())) | frozenset(own.get("disabled", ()))
    return merged


def config_of(profile: str = "recommended", overrides: dict | None = None, custom: dict[str, dict] | None = None) -> Config:
    """The configuration of a profile with the overrides of a configuration file on top."""
    found = resolve_profile(profile, custom)
    overrides = overrides or {}
    named = set(overrides.get("named", ()))  # a rule that the configuration names takes nothing from the profile
    found = found | {k: {r: v for r, v in found.get(k, {}).items() if r not in named} for k in ("thresholds", "options", "severities")} | {"disabled": set(found.get("disabled", ())) - named}
    disabled = set(found["disabled"]) | set(overrides.get("disabled", ()))
    if only := found.get("only_pillars"):
        disabled |= {r.rule_id for r in RULES.values() if r.pillar not in only and r.rule_id not in named}
    lists = {k: frozenset(v) for k, v in overrides.items() if k in Config.__dataclass_fields__ and k not in ("thresholds", "options", "severities", "disabled", "ignored_paths", "minimum_severity")}
    return Config(
        thresholds=found.get("thresholds", {}) | overrides.get("thresholds", {}),
        options={r: found.get("options", {}).get(r, {}) | overrides.get("options", {}).get(r, {}) for r in {*found.get("options", {}), *overrides.get("options", {})}},
        severities=found.get("severities", {}) | overrides.get("severities", {}),
        disabled=frozenset(disabled),
        minimum_severity=overrides.get("minimum_severity", {}),
        ignored_paths=tuple(dict.fromkeys([*found.get("ignored_paths", ()), *overrides.get("ignored_paths", ())])),
        **lists,
    )
