"""Layered configuration on the driver: defaults, composer.json, presets, files, overrides; later layers win by key."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace
from graphlib import CycleError, TopologicalSorter
from typing import Any

from codestrata.operators.rules import RULES, Rule

PRIORITY = {"defaults": 0, "composer": 10, "preset": 15, "file": 20, "cli": 30}  # fixed values: the order of layers
KEYS = frozenset("paths exclude excludePaths excludeNamespaces rules onlyRules disabledRules computedMetrics architecture baseline failOn format workers".split())


class ConfigError(ValueError):
    pass


def merge(layers: Sequence[tuple[str, Mapping[str, Any]]]) -> dict[str, Any]:
    """Layers in the order of their priority; a top-level key is replaced as a whole, unknown keys are errors."""
    out: dict[str, Any] = {}
    for name, layer in sorted(layers, key=lambda x: PRIORITY[x[0]]):
        if unknown := set(layer) - KEYS:
            raise ConfigError(f"{name}: unknown keys {sorted(unknown)}")
        out.update(layer)
    return out


def yaml_layer(text: str) -> dict[str, Any]:
    """A configuration file's layer. An empty file is an empty layer; anything but a mapping of strings is an error."""
    try:
        import yaml
    except ImportError as e:  # the parser isn't part of the package
        raise ConfigError("reading YAML needs PyYAML") from e
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    if doc is None:
        return {}
    if not isinstance(doc, dict) or not all(isinstance(k, str) for k in doc):
        raise ConfigError("a configuration is a mapping")
    if unknown := set(doc) - KEYS:
        raise ConfigError(f"unknown keys {sorted(unknown)}")
    return doc


def composer_paths(text: str) -> tuple[list[str], list[str]]:
    """(source paths, namespace prefixes) that a composer.json autoloads, those of autoload-dev last."""
    doc = json.loads(text)
    paths, spaces = [], []
    for part in ("autoload", "autoload-dev"):
        for standard in ("psr-4", "psr-0"):
            for prefix, at in doc.get(part, {}).get(standard, {}).items():
                spaces.append(prefix.rstrip("\\"))
                paths += [x.rstrip("/") for x in ([at] if isinstance(at, str) else at)]
    return list(dict.fromkeys(paths)), list(dict.fromkeys(spaces))


def thresholds(options: Mapping[str, Any]) -> dict[str, float]:
    """`threshold` stands for both levels; mixing it with `warning` or `error` is an error; null is unset."""
    given = {k: v for k, v in options.items() if k in ("threshold", "warning", "error") and v is not None}
    if "threshold" in given and len(given) > 1:
        raise ConfigError("threshold can't be mixed with warning or error")
    return {"warning": given["threshold"], "error": given["threshold"]} if "threshold" in given else given


def configure(options: Mapping[str, Any], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules with their options: true or false enables, a mapping sets `enabled` and thresholds."""
    if unknown := set(options) - {r.name for r in rules} - {r.code for r in rules}:
        raise ConfigError(f"unknown rules {sorted(unknown)}")
    out = []
    for rule in rules:
        given = options.get(rule.code, options.get(rule.name))
        if isinstance(given, bool):
            rule = replace(rule, enabled=given)
        elif isinstance(given, Mapping):
            rule = replace(rule, enabled=given.get("enabled", rule.enabled), **thresholds(given))
        out.append(rule)
    return out


def collector_order(provides: Mapping[str, set[str]], requires: Mapping[str, set[str]]) -> list[str]:
    """Collectors so that each comes after those that provide what it requires; a requirement nobody provides is an
    error, as is a cycle."""
    owner = {m: c for c, ms in provides.items() for m in ms}
    if missing := {m for ms in requires.values() for m in ms} - set(owner):
        raise ConfigError(f"nobody provides {sorted(missing)}")
    return list(TopologicalSorter({c: {owner[m] for m in requires.get(c, ())} for c in provides}).static_order())


def check_layers(layers: Sequence[str], allowed: Sequence[tuple[str, str, str | None]]) -> list[str]:
    """What is wrong with a layer policy: unknown layers, a layer that is declared twice or allowed everything, cycles."""
    found = [f"layer {n} is declared twice" for n in sorted({n for n in layers if layers.count(n) > 1})]
    found += [f"unknown layer {n}" for n in sorted({n for a, b, _ in allowed for n in (a, b)} - set(layers) - {"*"})]
    found += [f"{a} may use every layer" for a, b, _ in allowed if b == "*"]
    uses: dict[str, set[str]] = {}
    for a, b, _ in allowed:
        if a != b and b != "*":
            uses.setdefault(a, set()).add(b)
    try:
        TopologicalSorter(uses).prepare()
    except CycleError as e:
        found.append("cycle: " + " > ".join(e.args[1]))
    return found
