"""Rule files, and scores of runs against a scorer that takes one call after another."""

import json
import random
import re

from factloom.operators import rules as scoring
from factloom.sources import rules

FILE = {
    "task_kind": "x",
    "expect_sequence": [{"id": "a-then-b", "score": 2, "pattern": [{"tool": "a"}, {"tool": "b", "args_match": {"sym": "Foo", "p_regex": "x+$"}}]}, {"id": "nothing", "score": 5}, {"id": "twice", "score": 1, "pattern": [{"tool": "a"}, {"tool": "a"}, {"tool": "a"}]}],
    "forbid_sequence": [{"id": "c-then-a", "score": -1, "pattern": [{"tool": "c"}, {"tool": "a"}]}],
    "expect_set": [{"id": "all", "score": 3, "tools": ["a", "b", "c", "a"]}, {"id": "none", "score": 7, "tools": []}],
    "forbid_set": [{"id": "d-unchecked", "score": -4, "when": {"tool_used": "d"}, "require_prior": {"any_of": ["a", "b"]}}, {"id": "d-alone", "score": -6, "when": {"tool_used": "d"}}],
    "receipts": [{"id": "d-receipts", "score": 1, "when": {"tool_used": "d"}, "require": {"receipts_non_empty": True}}, {"id": "c-used", "score": 1, "when": {"tool_used": "c"}}],
}


def scores_by_brute_force(calls, table):
    def meets(call, step):
        args = (step.get("args_match") or {}).items()
        return call[0] == step["tool"] and all(re.search(v, call[1]) if k.endswith("_regex") else v in call[1] for k, v in args)

    def sequence(pattern):
        k = 0
        for c in calls:
            if k < len(pattern) and meets(c, pattern[k]):
                k += 1
        return k == len(pattern)

    def unchecked(rule):
        at = next((k for k, c in enumerate(calls) if c[0] == rule["when"]["tool_used"]), None)
        return at is not None and not any(c[0] in (rule.get("require_prior") or {}).get("any_of", []) for c in calls[:at])

    def receipts(rule):
        for c in calls:
            if c[0] == rule["when"]["tool_used"]:
                if not (rule.get("require") or {}).get("receipts_non_empty"):
                    return True
                head, found, rest = c[1].partition("receipts:[")
                return bool(found) and "]" in rest and rest.split("]")[0].strip() != ""
        return False

    holds = {"expect_sequence": lambda r: sequence(r.get("pattern") or []), "forbid_sequence": lambda r: sequence(r.get("pattern") or []), "expect_set": lambda r: set(r["tools"]) <= {c[0] for c in calls}, "forbid_set": unchecked, "receipts": receipts}
    return {r["id"]: r["score"] if holds[part](r) else 0 for part in holds for r in table.get(part) or []}


def test_all_rules_in_one_pass(spark):
    r, rows = random.Random(4), []
    args = ["", "Foo xx", "Foo", "xx Foo x", 'receipts:["r1"]', "receipts:[]", "receipts:[ ]", "receipts:[", None]
    for run in range(40):
        rows += [(run, k // 2, k, r.choice("abcde"), r.choice(args)) for k in range(r.choice([0, 1, 3, 8, 30]))]
    rows += [(7777, k, k, r.choice("abcd") if k < 700 else "d", "Foo x") for k in range(800)] + [(5, 99, 999, None, None), (None, 1, 1, "a", None)]
    calls = spark.createDataFrame(rows, "run long, t long, ord long, tool string, arguments string").repartition(5)
    ids = [(run,) for run in sorted({x[0] for x in rows if x[0] is not None} | set(range(40)))]
    found = {}
    for x in scoring.scored(calls, rules.as_rules(FILE), spark.createDataFrame(ids, "run long")).collect():
        found.setdefault(x["run"], {})[x["rule"]] = x["score"]
    for (run,) in ids:
        own = [(x[3], x[4] or "") for x in sorted((x for x in rows if x[0] == run and x[3]), key=lambda x: (x[1], x[2]))]
        assert found[run] == scores_by_brute_force(own, FILE), run
    assert len({json.dumps(x) for x in found.values()}) > 8


def test_files_are_checked(tmp_path):
    assert rules.faults(FILE) == []
    bad = {"extra": 1, "expect_sequence": [{"pattern": [{"tool": "", "x": 1}, {"tool": "a", "x": 1, "args_match": {"p_regex": "("}}], "odd": 1}, 3], "forbid_set": [{"id": "f", "when": {"used": "a"}, "tools": ["a"]}], "receipts": [{"id": "r"}]}
    found = "; ".join(rules.faults(bad))
    for part in ("unknown part extra", "expect_sequence[0]: id is missing", "unknown key odd", "tool is missing", "unknown key x", "p_regex", "not a rule", "forbid_set[0]: unknown key tools", "forbid_set[0].when: unknown key used", "receipts[0]: when.tool_used is missing"):
        assert part in found
    for name, table in {"a": FILE, "b": bad}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "expected_tools.yaml").write_text(json.dumps(table))
    loaded = rules.loaded(str(tmp_path / "a/expected_tools.yaml"))
    assert [x["id"] for x in loaded] == [x["id"] for part in rules.PARTS for x in FILE[part]] and rules.expected_tools(loaded) == ["a", "b", "c"]
    assert list(rules.corpus_faults(str(tmp_path))) == [str(tmp_path / "b/expected_tools.yaml")]
