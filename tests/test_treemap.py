"""Maps of files against a renderer that draws every prefix it asks about."""

import random

import pytest

from factloom.operators.treemap import placed_files, tree_map

SF = "/root/testdata/sf0.001"


def rendered(files):
    root = {}
    for path, content in files:
        *folders, name = path.split("/")
        at = root
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = content or ""

    def lines(node, depth):
        for name in sorted((n for n in node if isinstance(node[n], dict)), key=str.encode):
            yield "  " * depth + name + "/"
            yield from lines(node[name], depth + 1)
        for name in sorted((n for n in node if not isinstance(node[n], dict)), key=str.encode):
            yield "  " * depth + name
            yield from ("  " * depth + "    " + x for x in node[name].split("\n") if x)

    return "".join(x + "\n" for x in lines(root, 0))


def map_by_brute_force(rows, budget):
    ranked = [(p, c) for p, s, c in sorted(rows, key=lambda r: (-r[1], r[0].encode()))]
    low, high, best, most = 1, len(ranked), "", 0
    while low <= high:
        mid = (low + high) // 2
        text = rendered(ranked[:mid])
        n = len(text.encode()) // 4
        if n > most and (n <= budget or abs(n - budget) / budget < 0.15):
            best, most = text, n
        if n < budget:
            low = mid + 1
        else:
            high = mid - 1
    return best or (rendered(ranked[:1]) if ranked else "")


def mapped(spark, rows, budget):
    found = tree_map(spark.createDataFrame(rows, "path string, score double, content string"), budget).orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, len(found) + 1))
    return "".join(r["line"] + "\n" for r in found)


@pytest.mark.parametrize("seed", range(6))
def test_maps(spark, seed):
    r = random.Random(seed)
    name = lambda: r.choice(["a", "b", "lib", "é", "Zed", "x y"]) + str(r.randint(0, 3))
    rows = {}
    for _ in range(r.choice([1, 7, 60])):
        path = "/".join([name() + "d" for _ in range(r.randint(0, 4))] + [name() + ".go"])
        rows[path] = (path, float(r.randint(0, 9)), r.choice([None, "", "func a()\n\nfunc é()", "x\n" * r.randint(1, 20)]))
    for budget in (1, 30, 200, 100_000):
        assert mapped(spark, list(rows.values()), budget) == map_by_brute_force(list(rows.values()), budget)


@pytest.mark.parametrize("budget", [40, 900])
def test_maps_of_parts_and_pages(spark, budget):
    parts = [(f"{x.p_type}/{x.p_brand}/{x.p_partkey}.go", float(x.p_retailprice), f"{x.p_name}\n\n{x.p_type}") for x in spark.read.parquet(f"{SF}/part.parquet").collect()]
    pages = [(x.url.split("://")[-1].strip("/") + "/page", float(x.page_id % 17), (x.html or "")[:200]) for x in spark.read.parquet(f"{SF}/pages.parquet").collect() if x.url]
    for rows in (parts, [(p, s, c) for p, s, c in {p: (p, s, c) for p, s, c in pages}.values()]):
        assert mapped(spark, rows, budget) == map_by_brute_force(rows, budget)


def test_a_path_counts_once_and_no_files_draw_nothing(spark):
    rows = spark.createDataFrame([("a/b", 1.0, "x"), ("a/b", 3.0, "y"), (None, 9.0, "z"), ("a/c", 2.0, None)], "path string, score double, content string")
    assert [(x["path"], x["place"], x["used"]) for x in placed_files(rows, 100).orderBy("place").collect()] == [("a/b", 1, 3 + 4 + 8), ("a/c", 2, 3 + 4 + 8 + 4)]
    assert tree_map(rows.limit(0), 10).count() == 0
