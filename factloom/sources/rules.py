"""Scoring rules from YAML (or JSON) files, checked before they are used."""

from __future__ import annotations

import glob
import json
import re

#: The parts of a rule file, the keys that each of their entries may have, and those below them.
PARTS = {
    "expect_sequence": {"id", "score", "pattern"},
    "forbid_sequence": {"id", "score", "pattern"},
    "expect_set": {"id", "score", "tools"},
    "forbid_set": {"id", "score", "when", "require_prior"},
    "receipts": {"id", "score", "when", "require"},
}
BELOW = {"when": {"tool_used"}, "require_prior": {"any_of"}, "require": {"receipts_non_empty"}}
STEP = {"tool", "args_match"}


def parsed(text: str) -> dict:
    """A rule file's content. JSON needs nothing; YAML needs the module of that name."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        pass
    try:
        import yaml
    except ImportError as error:
        raise ValueError("rules that are not JSON need the yaml module") from error
    return yaml.safe_load(text)


def _rule_faults(where: str, part: str, rule) -> list[str]:
    if not isinstance(rule, dict):
        return [f"{where}: not a rule"]
    out = [f"{where}: unknown key {k}" for k in rule if k not in PARTS[part]]
    if not rule.get("id"):
        out.append(f"{where}: id is missing")
    for key, may in BELOW.items():
        own = rule.get(key) or {}
        if key in PARTS[part]:
            out += [f"{where}.{key}: unknown key {k}" for k in own if k not in may]
    if "when" in PARTS[part] and not (rule.get("when") or {}).get("tool_used"):
        out.append(f"{where}: when.tool_used is missing")
    for m, step in enumerate(rule.get("pattern") or []):
        at = f"{where}.pattern[{m}]"
        if not isinstance(step, dict) or not step.get("tool"):
            out.append(f"{at}: tool is missing")
            continue
        out += [f"{at}: unknown key {k}" for k in step if k not in STEP]
        for key, value in (step.get("args_match") or {}).items():
            if key.endswith("_regex"):
                try:
                    re.compile(value)
                except re.error as error:
                    out.append(f"{at}: {key}: {error}")
    return out


def faults(rules) -> list[str]:
    """What is wrong with rules, in their order; none: they may be used."""
    if not isinstance(rules, dict):
        return ["not a table of rules"]
    out = [f"unknown part {k}" for k in rules if k not in PARTS and k != "task_kind"]
    for part in PARTS:
        for n, rule in enumerate(rules.get(part) or []):
            out += _rule_faults(f"{part}[{n}]", part, rule)
    return out


def as_rules(table: dict) -> list[dict]:
    """A checked file's rules as `rules.scored` takes them, in the order in which they count: {id, kind, score} and, by kind,
    steps [(tool, texts, patterns)], tools, or when and any_of or non_empty."""
    out = []
    for part in PARTS:
        for rule in table.get(part) or []:
            own = {"id": rule["id"], "kind": part, "score": rule.get("score", 0)}
            if part.endswith("sequence"):
                split = [[(k.endswith("_regex"), v) for k, v in (s.get("args_match") or {}).items()] for s in rule.get("pattern") or []]
                own["steps"] = [(s["tool"], [v for re_, v in m if not re_], [v for re_, v in m if re_]) for s, m in zip(rule.get("pattern") or [], split)]
            elif part == "expect_set":
                own["tools"] = list(rule.get("tools") or [])
            else:
                own["when"] = rule["when"]["tool_used"]
                own["any_of"] = list((rule.get("require_prior") or {}).get("any_of") or [])
                own["non_empty"] = bool((rule.get("require") or {}).get("receipts_non_empty"))
            out.append(own)
    return out


def loaded(path: str) -> list[dict]:
    """The rules of a file. Faults are an error that names them all."""
    with open(path, encoding="utf-8") as file:
        table = parsed(file.read())
    if wrong := faults(table):
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return as_rules(table)


def expected_tools(rules: list[dict]) -> list[str]:
    """Names of the tools that sequences and sets expect, for recall."""
    expected = [r for r in rules if r["kind"].startswith("expect")]
    return sorted({t for r in expected for t in (r["tools"] if "tools" in r else [s[0] for s in r["steps"]]) if t})


def corpus_faults(folder: str, name: str = "expected_tools.yaml") -> dict[str, str]:
    """What is wrong with each rule file one level below a folder; files that may be used are left out."""
    out = {}
    for path in sorted(glob.glob(f"{glob.escape(folder)}/*/{name}")):
        try:
            loaded(path)
        except (ValueError, OSError) as error:
            out[path] = str(error)
    return out
