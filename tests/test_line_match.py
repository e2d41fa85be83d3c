"""Line matches against the rules written out, case by case and at random."""

import random
import re

import pytest

from factloom.operators.line_match import line_matches

SPACE = "[\\s\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def bare(x):
    return re.sub(f"^{SPACE}+|{SPACE}+$", "", x)


def reflow(replacement, searched, matched):
    margins = [re.match(r"[ \t]*", x)[0] for x in searched if x.strip()]
    prefix = margins[0] if margins else ""
    for m in margins:
        while not m.startswith(prefix):
            prefix = prefix[:-1]
    first = next((re.match(r"[ \t]*", x)[0] for x in matched if x.strip()), "")
    out = ["" if not x.strip() else first + (x[len(prefix) :] if x.startswith(prefix) else x) for x in replacement.split("\n")]
    return "\n".join(out)


def by_brute_force(source, search, replacement):
    if not bare(search):
        return "empty"
    own, gap = source.split("\n"), re.compile(r"(?m)^[ \t]*\.\.\.$")
    pieces, replaced = gap.split(search), gap.split(replacement) if replacement is not None else None
    if len(pieces) > 1:
        if any(not bare(p) for p in pieces) or replaced and len(replaced) > 1 and any(not bare(p) for p in replaced):
            return "empty segment"
        if replaced and len(replaced) != len(pieces):
            return "segments"
        one = lambda x: x.removesuffix("\n").removeprefix("\n")
        pieces, replaced = list(map(one, pieces)), replaced and list(map(one, replaced))
    else:
        replaced = replacement if replacement is None else [replacement]
    at, first, worst, texts = 0, None, 0, []
    for k, piece in enumerate(pieces):
        wanted = piece.split("\n")
        for rule, normal in enumerate((str, bare, lambda x: x.lstrip(" \t"))):
            goal = list(map(normal, wanted))
            hits = [i for i in range(at, len(own) - len(wanted) + 1) if list(map(normal, own[i : i + len(wanted)])) == goal]
            if len(hits) > 1:
                return "ambiguous"
            if hits:
                break
        else:
            return "no match"
        first, worst, at = hits[0] if first is None else first, max(worst, rule), hits[0] + len(wanted)
        if replaced:
            texts.append(reflow(replaced[k], wanted, own[hits[0] : at]))
    start = sum(len(x.encode()) + 1 for x in own[:first])
    end = len(source.encode()) if at >= len(own) else sum(len(x.encode()) + 1 for x in own[:at]) - 1
    return (("exact", 1.0), ("whitespace_normalized", 0.95), ("indent_flexible", 0.85))[worst] + (first, at, start, end, "\n...\n".join(texts) if replaced else None)


def results(spark, cases):
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "id long, source string, search string, replacement string")
    return {r["id"]: r["error"] or tuple(r[c] for c in ("strategy", "score", "first", "after", "start", "end", "text")) for r in line_matches(frame).collect()}


EXACT = [
    (("a  b\nc", "a b", None), "no match"),  # white space inside a line counts
    (("\ta  b\nc", "a  b", "x\n  y"), ("whitespace_normalized", 0.95, 0, 1, 0, 5, "\tx\n\t  y")),
    (("    foo \nx", "\tfoo ", None), ("whitespace_normalized", 0.95, 0, 1, 0, 8, None)),
    (("  a \n\ta", "a ", None), "ambiguous"),
    (("a　", "a", None), ("whitespace_normalized", 0.95, 0, 1, 0, 4, None)),
    (("x\n...  \ny", "x\n...  \ny", None), ("exact", 1.0, 0, 3, 0, 9, None)),  # a gap has nothing behind its dots
    (("f\na\nb\ng", "f\n...\ng", "F\n...\nG"), ("exact", 1.0, 0, 4, 0, 7, "F\n...\nG")),
    (("f\na\ng", "f\n...\ng", "F"), "segments"),
    (("f\na\ng", "f\n...\n", None), "empty segment"),
    (("f\na\ng", " \n\t", None), "empty"),
    (("g\nf", "f\n...\ng", None), "no match"),
    (("f\n", "f\n", None), ("exact", 1.0, 0, 2, 0, 2, None)),  # a closing line break is a line
    (("é\nf\ng", "f", "h"), ("exact", 1.0, 1, 2, 3, 4, "h")),
    ((None, "x", None), "no match"),
    (("x", None, "y"), "empty"),
    (("a\na", "a", None), "ambiguous"),
]


def test_rules(spark):
    found = results(spark, [c for c, _ in EXACT])
    assert [found[k] for k in range(len(EXACT))] == [w for _, w in EXACT]
    assert all(by_brute_force(a or "", b or "", c) == w for (a, b, c), w in EXACT)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_at_random(spark, seed):
    r, cases = random.Random(seed), []
    line = lambda: r.choice(["", "", "  ", "\t", "    "]) + r.choice(["a", "b", "c", "a  b", "", "é"]) + r.choice(["", "", " "])
    for _ in range(400):
        own = [line() for _ in range(r.randint(1, 9))]
        k = r.randint(0, len(own) - 1)
        part = [r.choice([x, x.strip(), x.lstrip(), "  " + x]) for x in own[k : k + r.randint(1, 3)]]
        if r.random() < 0.4:
            part += [r.choice(["...", "  ...", "... "])] + [r.choice([x, x.strip()]) for x in own[-r.randint(1, 2) :]]
        new = r.choice([None, "n", "n\n  m", "n\n...\n  m", "...", "\tn\n\n...\nm\n"])
        cases.append(("\n".join(own), "\n".join(part), new))
    found = results(spark, cases)
    assert [found[k] for k in range(len(cases))] == [by_brute_force(*c) for c in cases]
    # what the third rule finds, the second has found before
    assert {x if isinstance(x, str) else x[0] for x in found.values()} == {"empty", "empty segment", "segments", "no match", "ambiguous", "exact", "whitespace_normalized"}
