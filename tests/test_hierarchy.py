from pyspark.sql import functions as F

from sylvaspark.operators import hierarchy as H

SCHEMA = "course_code string, prerequisites array<string>, code string, id long"


def run(spark, rows):
    df = spark.createDataFrame([(c, p, "clash", 7) for c, p in rows], SCHEMA)
    h = H.with_paths(spark, H.hierarchy(spark, *H.parent_links(df)))
    return {r["code"]: r for r in h.collect()}


def test_chain_star_ring_and_dirty_codes(spark):
    rows = [(f"C{i:03}", [f"C{i - 1:03}"] if i else None) for i in range(40)]
    rows += [(f"S{i:03}", ["\ts000 "]) for i in range(1, 30)] + [("S000", ["无", None, "", "ZZ9"])]
    rows += [("R1", ["R2"]), ("R2", ["R3"]), ("R3", ["R1"]), ("Q", ["R2"]), ("P", ["q"]), ("L", ["L"]), ("M", ["L"])]
    rows += rows[:5] + [(None, ["C001"]), ("", None)]
    got = run(spark, rows)
    assert len(got) == 40 + 30 + 7
    assert got["C039"]["depth"] == 39 and got["C039"]["root_code"] == "C000" and got["C039"]["path"] == [f"C{i:03}" for i in range(40)]
    assert got["C000"]["n_below"] == 39 and got["S000"]["n_below"] == 29
    assert all(got[f"S{i:03}"]["path"] == ["S000", f"S{i:03}"] for i in range(1, 30))
    assert {k: (got[k]["ring"], got[k]["root_code"]) for k in ("R1", "R2", "R3", "Q", "P", "L", "M")} == {
        "R1": ("on", "R1"), "R2": ("on", "R1"), "R3": ("on", "R1"), "Q": ("below", "R1"), "P": ("below", "R1"), "L": ("on", "L"), "M": ("below", "L")}
    for a in got.values():
        for b in got.values():
            inside = a["root_id"] == b["root_id"] and a["entry"] < b["entry"] < a["exit"]
            assert inside == (a["code"] in b["path"][:-1])


def test_empty_and_all_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None)]) == {}


def test_several_parents_keep_the_smallest(spark):
    got = run(spark, [("A", None), ("B", None), ("C", ["B", "A"])])
    assert got["C"]["parent_code"] == "A"


def test_long_ring_below_one_window(spark):
    rows = [(f"N{i:03}", [f"N{(i + 1) % 70:03}"]) for i in range(70)]
    got = run(spark, rows)
    assert all(r["ring"] == "on" and r["root_code"] == "N000" for r in got.values())
    assert sum(F is not None for F in got) == 70


def test_paths_over_many_partitions(spark):
    """A deep chain with bushes spans many range partitions: open intervals come over every seam."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        up = {i: i - 1 for i in range(1, 120)} | {1000 + i: i % 120 for i in range(600)} | {2000 + i: 1000 + i % 50 for i in range(100)}
        nodes = spark.createDataFrame([(f"{i:05d}",) for i in [0, *up]], "code string")
        links = spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for a, b in up.items()], "code string, parent string")
        got = {r["code"]: list(r["path"]) for r in H.with_paths(spark, H.hierarchy(spark, nodes, links)).collect()}
        for i in [0, *up]:
            want, at = [], i
            while at is not None:
                want.insert(0, f"{at:05d}")
                at = up.get(at)
            assert got[f"{i:05d}"] == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
