"""Path rules: real trees under a temporary folder, and column functions."""

import os

import pytest
from pyspark.sql import functions as F

from tilewright.functions import paths
from tilewright.operators import collection
from tilewright.plans import catalogue
from tilewright.sources import catalog


@pytest.fixture()
def tree(tmp_path):
    for p in ("x.png", "_u.png", ".h.png", "B.PNG", "n.txt", "sub/a.jpg", "sub/deep/b.psd", ".hid/c.png", "_und/d.svg", "other/e.dds"):
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    os.symlink(tmp_path / "x.png", tmp_path / "l.png")
    return tmp_path


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


def test_valid_paths(tree):
    x = str(tree / "x.png")
    assert catalog.valid_paths(None) == [] and catalog.valid_paths([None, " ", "\t", str(tree / "no")]) == []
    assert catalog.valid_paths([x, str(tree) + "/", x, str(tree)]) == [x, str(tree)]


def test_same_parent(tree):
    x, b, a = (str(tree / p) for p in ("x.png", "B.PNG", "sub/a.jpg"))
    assert catalog.same_parent([x, b]) and not catalog.same_parent([x, a])
    assert catalog.same_parent([str(tree / "sub"), a])
    with pytest.raises(FileNotFoundError):
        catalog.same_parent([x, str(tree / "no")])
    with pytest.raises(ValueError):
        catalog.same_parent([])


def test_has_subdirectories(tree):
    assert catalog.has_subdirectories(str(tree)) and not catalog.has_subdirectories(str(tree / "other"))
    for bad in (None, " "):
        with pytest.raises(ValueError):
            catalog.has_subdirectories(bad)
    with pytest.raises(NotADirectoryError):
        catalog.has_subdirectories(str(tree / "no"))


def test_canonical_and_links(tree):
    assert catalog.canonical(str(tree / "link"), False) == str(tree / "link")
    assert catalog.canonical(str(tree / "link"), True) == os.path.realpath(tree / "sub")
    assert os.path.isabs(catalog.canonical("no/such", True))
    assert catalog.is_link(str(tree / "link")) and catalog.is_link(str(tree / "l.png"))
    assert not catalog.is_link(str(tree / "x.png")) and not catalog.is_link(str(tree / "no")) and not catalog.is_link(str(tree / "sub"))


def test_scan(spark, tree):
    flat = ["B.PNG", "_u.png", "l.png", "n.txt", "x.png"]
    assert names(catalog.scan(spark, [str(tree)], recursive=False), tree) == sorted(flat)
    deep = [*flat, "_und/d.svg", "other/e.dds", "sub/a.jpg", "sub/deep/b.psd"]
    assert names(catalog.scan(spark, [str(tree)]), tree) == sorted(deep)
    hidden = names(catalog.scan(spark, [str(tree)], hidden=True), tree)
    assert ".h.png" in hidden and ".hid/c.png" in hidden
    followed = names(catalog.scan(spark, [str(tree)], follow_links=True), tree)
    assert len(followed) == len(deep)  # each real directory once, loop ended
    assert catalog.scan(spark, [str(tree / "no")]).count() == 0


def test_scan_pushes_extension(spark, tree):
    df = catalog.scan(spark, [str(tree)])
    assert names(df.filter("extension = '.png'"), tree) == ["B.PNG", "_u.png", "l.png", "x.png"]
    assert names(df.filter("extension in ('.psd', '.svg')"), tree) == ["_und/d.svg", "sub/deep/b.psd"]
    assert names(catalog.scan(spark, [str(tree)], extensions=[".jpg"]), tree) == ["sub/a.jpg"]


@pytest.mark.parametrize(
    "given,want",
    [
        ([], None), ([None, " "], None), (["/a/b.png"], "/a/b.png"), (["/a/b/x", "/a/b/y"], "/a/b"), (["/a/b/c1/x.png", "/a/b/c2/y.png", "/a/x/z.png"], "/a"),
        (["/usr/bin/a", "/etc/hosts"], "/"), (["/a/b", "/a/b/c"], "/a"), (["/tmp/s1", "/tmp/s2"], "/tmp"), (["a", "b"], None), (["/a/b/", "/a/b"], "/a/b"),
    ],
)
def test_top_directory(spark, given, want):
    df = spark.createDataFrame([(p,) for p in given], "path string")
    assert collection.top_directory(df).first()[0] == want


@pytest.mark.parametrize(
    "path,directory,name,ext,hidden",
    [
        ("/a/b.PNG", "/a", "b.PNG", ".PNG", False), ("/a", "/", "a", "", False), ("/a/.secret", "/a", ".secret", ".secret", True), ("/x/.git/", "/x/.git", "", "", True),
        ("bare.", None, "bare.", "", False), ("  ", None, "  ", "", False), (None, None, None, None, False), ("/a/c.tar.gz", "/a", "c.tar.gz", ".gz", False),
    ],
)
def test_parts(spark, path, directory, name, ext, hidden):
    p = F.col("p")
    df = spark.createDataFrame([(path,)], "p string").select(paths.directory(p), paths.name(p), paths.extension(p), paths.is_hidden(p))
    assert tuple(df.first()) == (directory, name, ext, hidden)


def test_normalise_directory(spark):
    rows = [("/a/b/", True, True, "/a/b"), ("/a/f.png", False, True, "/a"), ("/a/f.png", False, False, "/a"), ("/a/no", False, False, "/a/no"), (" ", False, False, None)]
    df = spark.createDataFrame(rows, "p string, d boolean, e boolean, want string")
    for r in df.select("want", paths.normalise_directory(F.col("p"), F.col("d"), F.col("e")).alias("got")).collect():
        assert r.want == r.got


def test_orders(spark):
    df = spark.createDataFrame([("\U0001f600",), ("～",)], "p string")
    assert [r.p for r in df.orderBy("p").collect()] == ["～", "\U0001f600"]
    assert [r.p for r in df.orderBy(paths.utf16_order(F.col("p"))).collect()] == ["\U0001f600", "～"]
    two = spark.createDataFrame([(1, "/A"), (2, "/a"), (3, "/b")], "o int, path string")
    assert collection.distinct_paths(two, ordinal="o", fold=True).count() == 2 and collection.distinct_paths(two).count() == 3


def test_drop_plans(spark, tree):
    x, b, sub, other = (str(tree / p) for p in ("x.png", "B.PNG", "sub", "other"))
    for given, kind, n, single in [
        ([x], "SingleDirectoryCollection", 4, True), ([x, b], "SingleDirectorySelection", 2, False), ([other], "SingleDirectoryCollection", 0, False),
        ([sub], "MultiDirectorySelection", 2, False), ([sub, x], "MultiDirectorySelection", 3, False), ([], "Undefined", 0, False),
    ]:
        found, drop = catalogue.collection(spark, given)
        assert catalogue.kind_of(drop) == kind and drop.single_file == single
        assert found.count() == n
    found, drop = catalogue.collection(spark, [x])
    assert [r.idx for r in found.orderBy("idx").collect()] == [1, 2, 3, 4]
    assert collection.anchor_index(found, drop.anchor).first()[0] == [r.name for r in found.orderBy("idx").collect()].index("x.png") + 1
    assert catalogue.top(found, drop, spark) == str(tree)


def test_navigation_edges(spark):
    rows = [(f"/{d}/{i}",) for d in "abc" for i in range(3)]
    o = collection.order_collection(spark.createDataFrame(rows, "path string"))
    m = {r.idx: r for r in collection.moves(collection.directory_runs(o)).collect()}
    assert (m[1].previous, m[9].next, m[5].next) == (1, 9, 6)
    assert (m[5].dir_first, m[5].dir_last, m[4].dir_first, m[6].dir_last, m[1].dir_first, m[9].dir_last) == (4, 6, 3, 7, 1, 9)
    assert m[5].run == 2 and m[5].dir_index == 2 and not m[1].has_previous and not m[9].has_next
    assert collection.neighbourhood(o, -1).first().neighbours == []
    n = {r.idx: r.neighbours for r in collection.neighbourhood(o, 2).collect()}
    assert len(n[1]) == 3 and len(n[5]) == 5 and n[2][0] == "/a/0"
    assert collection.anchor_index(o, "/none").first()[0] == 1 and collection.anchor_index(o.limit(0), None).first()[0] == -1
