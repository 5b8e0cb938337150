"""Folder fingerprints and the comparison of trees, against hand-made trees and a plain recursion."""

import random

from symloom.operators import folders

FILE = "workspace string, path string, md5 string"


def tree(spark, files, workspace="w"):
    return folders.folder_tree(spark.createDataFrame([(workspace, p, m) for p, m in files], FILE))


def changes(new, old):
    return sorted((r.path, r.is_dir, r.change, r.old_path, r.n_files) for r in folders.compare_trees(new, old).collect())


BASE = [("a/b/1", "x"), ("a/b/2", "y"), ("a/c/3", "z"), ("d/e/f/4", "x"), ("top", "t")]


def test_one_changed_file_opens_its_own_folders_alone(spark):
    old = tree(spark, BASE)
    new = tree(spark, [(p, "new" if p == "a/c/3" else m) for p, m in BASE])
    assert changes(new, old) == [
        ("", True, "changed", None, 5), ("a", True, "changed", None, 3), ("a/c", True, "changed", None, 1),
        ("a/c/3", False, "changed", None, 1),
    ]
    assert changes(old, old) == []


def test_moved_folders_and_files_are_one_row(spark):
    old = tree(spark, BASE)
    new = tree(spark, [("d/moved/1", "x"), ("d/moved/2", "y"), ("a/c/3", "z"), ("d/e/f/4", "x"), ("under/top", "t"), ("n", "n")])
    found = [row for row in changes(new, old) if row[2] != "changed"]
    assert found == [("d/moved", True, "moved", "a/b", 2), ("n", False, "added", None, 1), ("under/top", False, "moved", "top", 1)]


def test_every_lost_path_is_named_once(spark):
    old = tree(spark, [("k/1", "x"), ("k/2", "x"), ("k/3", "q")])
    new = tree(spark, [("k/3", "q"), ("k/4", "x"), ("k/5", "x")])
    found = [row for row in changes(new, old) if not row[1]]
    assert found == [
        ("k/2", False, "removed", None, 1), ("k/4", False, "moved", "k/1", 1), ("k/5", False, "moved", "k/1", 1),
    ]


def test_odd_trees(spark):
    nothing = spark.createDataFrame([], FILE)
    empty = folders.folder_tree(nothing)
    assert empty.count() == 0 and changes(empty, empty) == []
    # Null keys are left out, rows repeat, names are empty, a name is file and folder.
    odd = [("a", "1"), ("a/b", "2"), ("a/b", "2"), ("/x", "3"), ("p//q", "4"), ("c", None), (None, "5"), ("m", "6"), ("m", "7")]
    made = tree(spark, odd)
    assert made.where("depth = 0").first().n_files == 6
    assert [r[:3] for r in changes(made, empty)] == [(p, False, "added") for p in ["/x", "a", "a/b", "c", "m", "p//q"]]
    assert [r[2] for r in changes(empty, made)] == ["removed"] * 6
    extra = spark.createDataFrame([("w", "a", "1", 5, "z")], FILE + ", depth int, name string")
    assert folders.folder_tree(extra).count() == 2


def test_random_trees_give_the_differing_files(spark):
    rng = random.Random(3)
    sides = []
    for _ in range(2):
        paths = {"/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)}
        sides.append({p: rng.choice(["s", "t"]) if rng.random() < 0.3 else "same" for p in paths})
    new, old = sides
    found = folders.compare_trees(tree(spark, new.items()), tree(spark, old.items())).collect()
    changed = {r.path for r in found if r.change == "changed" and not r.is_dir}
    assert changed == {p for p in new if p in old and new[p] != old[p]}

    def below(kind, field, files):
        tops = [(r[field], r.is_dir) for r in found if r.change in kind and r[field] is not None]
        return {f for f in files for top, is_dir in tops if f == top and not is_dir or is_dir and f.startswith(top + "/")}

    assert below(("added", "moved"), "path", new) == set(new) - set(old)
    assert below(("removed",), "path", old) | below(("moved",), "old_path", old) == set(old) - set(new)
