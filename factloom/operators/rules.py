"""Rules on runs of tool calls, all of them in one pass over the calls.

Each rule is a small automaton. The calls are dealt out by ranges of (run, time), so that a long run is shared by several tasks; a task tells of each
rule where a run's slice leads from each state, and the slices' maps are combined in order. What is gathered for a run is a map a task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands in a call's arguments before its receipts.
_RECEIPTS = "receipts:["


def holds_receipts(arguments: str) -> bool:
    """Whether the arguments list a receipt."""
    at = arguments.find(_RECEIPTS)
    return at >= 0 and arguments[at + len(_RECEIPTS) :].partition("]")[0].strip() != "" and "]" in arguments[at:]


class _Rule:
    """What a slice of a run does to a rule: `now` is, of a sequence, the state that each state leads to; else one number, of which 0 is none.

    Of a set that number is the tools seen, as bits; of the others how the first call that matters decides: 1 a hit, 2 none.
    """

    def __init__(self, rule: dict):
        self.kind, self.rule = rule["kind"], rule
        self.steps = [(tool, texts, [re.compile(p) for p in patterns]) for tool, texts, patterns in rule.get("steps", [])]
        self.bit = {t: 1 << k for k, t in enumerate(dict.fromkeys(rule.get("tools", [])))}
        #: The tools whose calls matter to the rule.
        self.tools = {s[0] for s in self.steps} | set(self.bit) | ({rule["when"], *rule["any_of"]} if "when" in rule else set())

    def start(self) -> list[int]:
        return list(range(len(self.steps) + 1)) if self.kind.endswith("sequence") else [0]

    def hit(self) -> int:
        """The state or number that is a hit."""
        return len(self.steps) if self.kind.endswith("sequence") else sum(self.bit.values()) if self.kind == "expect_set" else 1

    def _meets(self, k: int, tool: str, arguments: str) -> bool:
        own, texts, patterns = self.steps[k]
        return own == tool and all(t in arguments for t in texts) and all(p.search(arguments) for p in patterns)

    def follow(self, now: list[int], tool: str, arguments: str) -> None:
        if self.kind.endswith("sequence"):
            meets = [self._meets(k, tool, arguments) for k in range(len(self.steps))] + [False]
            now[:] = [k + meets[k] for k in now]
        elif self.kind == "expect_set":
            now[0] |= self.bit[tool]
        elif not now[0]:
            if self.kind == "receipts":
                now[0] = 1 if not self.rule["non_empty"] or holds_receipts(arguments) else 2
            else:  # the trigger comes first, or something that must come before it
                now[0] = 1 if tool == self.rule["when"] else 2


def scored(calls: DataFrame, rules: list[dict], runs: DataFrame | None = None) -> DataFrame:
    """(run, rule, score) for each rule of as_rules() and each run of calls (run, t, ord, tool, arguments), or of runs (run) where these are given.

    The score is the rule's where it holds, else 0. A sequence holds if its steps are met one after another, others between them or not; an empty one always
    does. A set holds if all of its tools are called. A forbidden set holds if the trigger is called before any of the others. A receipts rule looks at the
    trigger's first call. Null arguments are empty, calls without a tool count for nothing, a set has 31 tools at most.
    """
    if not rules:
        raise ValueError("there are no rules")
    kind = calls.schema["run"].dataType.simpleString()
    compiled = [_Rule(r) for r in rules]
    if any(len(r.bit) > 31 for r in compiled):
        raise ValueError("a set of over 31 tools")
    by_tool: dict[str, list[int]] = {}
    for k, r in enumerate(compiled):
        for tool in r.tools:
            by_tool.setdefault(tool, []).append(k)

    def slices(batches):
        task, run, states, began = TaskContext.get().partitionId(), None, {}, False
        for batch in batches:
            out = []
            for own, tool, arguments in zip(*[batch.column(k).to_pylist() for k in (0, 3, 4)]):
                if not began or own != run:
                    out += [(run, task, k, now) for k, now in states.items()]
                    run, states, began = own, {}, True
                for k in by_tool.get(tool, ()):
                    if k not in states:
                        states[k] = compiled[k].start()
                    compiled[k].follow(states[k], tool, arguments)
            yield table(out)
        yield table([(run, task, k, now) for k, now in states.items()])

    def table(rows):
        kinds = pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["run", "task", "rule", "now"])

    own = calls.select(F.col("run").cast("string").alias("run"), "t", "ord", "tool", F.coalesce("arguments", F.lit("")).alias("arguments")).where("run is not null")
    tasks = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.where(F.col("tool").isin(sorted(by_tool))).repartitionByRange(tasks, "run", "t", "ord").sortWithinPartitions("run", "t", "ord")
    maps = dealt.mapInArrow(slices, "run string, task int, rule int, now array<int>")
    listed = maps.groupBy("run", "rule").agg(F.sort_array(F.collect_list(F.struct("task", "now"))).alias("x"))
    facts = calls.sparkSession.createDataFrame([(k, r.kind.endswith("sequence"), r.kind == "expect_set", r.hit(), r.rule["id"], r.rule["score"]) for k, r in enumerate(compiled)], "rule int, sequence boolean, bits boolean, hit int, id string, worth int")
    each = (calls if runs is None else runs).select(F.col("run").cast("string").alias("run")).where("run is not null").distinct().join(F.broadcast(facts))  # a rule is a row: the table is as small as the file
    follow = lambda s, e: F.when(F.col("sequence"), F.get(e["now"], s)).when(F.col("bits"), s.bitwiseOR(e["now"][0])).when(s == 0, e["now"][0]).otherwise(s)
    end = F.coalesce(F.aggregate("x", F.lit(0), follow), F.lit(0))
    return each.join(listed, ["run", "rule"], "left").select(F.col("run").cast(kind).alias("run"), F.col("id").alias("rule"), F.when(end == F.col("hit"), F.col("worth")).otherwise(0).alias("score"))
