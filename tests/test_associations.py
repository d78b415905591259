"""Associations against a plain count, and their lines as files."""

import csv
from itertools import combinations_with_replacement
from pathlib import Path

from fieldmark.operators.associations import association_times, list_lines, matrix_lines, matrix_rows, of_species, write_lines

ROWS = [("g1", "b", 5), ("g1", "a", 5), ("g1", "b", 5), ("g2", "a", 9), ("g2", "c,d", 9), ("g3", "a", 9), ("g3", "b", 9), ("g4", 'e"', None), ("g5", None, 1), (None, "f", 1), ("g6", "a", 10), ("g7", "b", None), ("g7", "a", None)]


def plain():
    at, groups = {}, {}
    for g, n, t in ROWS:
        if g and n:
            groups.setdefault(g, set()).add(n)
            at[g] = t
    met = {}
    for g, names in groups.items():
        for x, y in combinations_with_replacement(sorted(names), 2):
            met.setdefault((x, y), []).append(str(at[g]))
    return met


def text(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*.txt")))


def test_as_plain(spark, tmp_path):
    met = plain()
    pairs = association_times(spark.createDataFrame(ROWS, "grp string, name string, t long"))
    got = {(r["name1"], r["name2"]): (r["groups"], r["n"], r["times"]) for r in pairs.collect()}
    assert got == {k: (len(v), len(set(v)), sorted(set(v))) for k, v in met.items()}
    write_lines(list_lines(pairs), f"file://{tmp_path}/list")
    lines = list(csv.reader(text(f"{tmp_path}/list").splitlines()))
    assert lines[0] == ["NAME1", "NAME2", "ASSOCIATIONS", "TIME1", "TIME2", "TIME3", "TIME4"]
    assert lines[1:] == [[a, b, str(len(set(v))), *sorted(set(v))] for (a, b), v in sorted(met.items())]
    write_lines(matrix_lines(pairs), f"file://{tmp_path}/matrix")
    rows = list(csv.reader(text(f"{tmp_path}/matrix").splitlines()))
    names = sorted({a for a, _ in met})
    assert rows[0] == ["MATRIX", *[f"NAME{i + 1}" for i in range(len(names))]]
    assert rows[1:] == [[n, *[str(len(met[c, n])) if (c, n) in met else "" for c in names]] for n in names]


def test_odd(spark, tmp_path):
    empty = association_times(spark.createDataFrame([], "grp string, name string, t long, `a.b` int"))
    assert empty.collect() == [] and matrix_rows(empty).collect() == []
    write_lines(list_lines(empty), f"file://{tmp_path}/list")
    write_lines(matrix_lines(empty), f"file://{tmp_path}/matrix")
    assert text(f"{tmp_path}/list") == "NAME1,NAME2,ASSOCIATIONS,\n" and text(f"{tmp_path}/matrix") == "MATRIX,\n"
    one = association_times(spark.createDataFrame([(1, 7, 3), (1, 7, 2)], "grp long, name long, t long"))
    assert [r["line"] for r in list_lines(one).sort("place").collect()] == ["NAME1,NAME2,ASSOCIATIONS,TIME", "7,7,1,2"]
    assert [r["line"] for r in matrix_lines(one).sort("place").collect()] == ["MATRIX,NAME", "7,1"]


def test_of_species(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "grp string, name string")
    seen = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", None)], "name string, species string")
    assert sorted(r["name"] for r in of_species(members, seen, "x").collect()) == ["a", "b"]
