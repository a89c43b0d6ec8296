import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import incremental, reports, store
from codeloom.operators.apply import for_each_file
from codeloom.sources.tree import source_tree, tree_listing

TREE = """a.py pkg/__init__.py pkg/_p.py pkg/b.txt pkg/c.PY venv/v.py .git/g.py node_modules/n.py
pkg/__pycache__/c.py venv2/w.py x/venv .hidden/h.py x/deep/er/y.py x/noext""".split()
FOUND = {"a.py", "pkg/__init__.py", "pkg/_p.py", "venv2/w.py", ".hidden/h.py", "x/deep/er/y.py"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in TREE:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {name}\n")
    (root / "link").symlink_to(root / "pkg")
    return root


def test_tree_scan(spark, tree):
    rows = source_tree(spark, str(tree)).collect()
    assert {r.path[len(str(tree)) + 1 :] for r in rows} == FOUND
    assert all(bytes(r.content).decode() == f"# {r.path[len(str(tree)) + 1:]}\n" for r in rows)
    listing = tree_listing(spark, str(tree), (".py", "")).collect()
    assert {r.path[len(str(tree)) + 1 :] for r in listing} == FOUND | {"x/venv", "x/noext", "link"}
    assert tree_listing(spark, str(tree / "venv")).count() == 0


def test_missing_root_is_an_error(spark, tree):
    with pytest.raises(Exception, match="No such file"):
        tree_listing(spark, str(tree / "absent")).collect()


def test_path_columns_agree_with_the_scan(spark, tree):
    rows = spark.createDataFrame([(n,) for n in TREE], "path string")
    kept = rows.where(~X.in_skipped_directory(F.col("path")) & (X.extension(F.col("path")) == ".py"))
    assert {r.path for r in kept.collect()} == FOUND


def test_white_space(spark):
    frame = spark.createDataFrame([("  a \t\n b\f\r\nc  ",)], "t string")
    assert frame.select(X.normalized(F.col("t")), X.stripped(F.col("t"))).first()[0] == "a b c"


def test_changes_and_groups(spark):
    files = spark.createDataFrame(
        [("a", "g1", "x"), ("b", "g1", "y"), ("c", "g2", "z"), ("d", "g3", "w")], "path string, grp string, content string"
    )
    manifest = incremental.manifest_of(files.where("path <> 'd'")).withColumn(
        "sha256", F.when(F.col("path") == "a", F.lit("old")).otherwise(F.col("sha256"))
    )
    changes = incremental.with_change(files, manifest)
    assert {(r.path, r.changed) for r in changes.collect()} == {("a", True), ("b", False), ("c", False), ("d", True)}
    assert {r.path for r in incremental.refresh_groups(changes, "grp").collect()} == {"a", "b", "d"}
    renewed = incremental.refreshed_manifest(manifest, changes.where("changed"))
    assert renewed.count() == 4
    assert incremental.with_change(files, renewed).where("changed").count() == 0


def test_sets(spark):
    numbers = spark.createDataFrame([(1,), (2,), (2,), (3,)], "n int")
    assert sorted(r.n for r in store.as_set(numbers, "n").collect()) == [1, 2, 3]
    two = spark.createDataFrame([(2,)], "n int")
    assert sorted(r.n for r in store.without(numbers, two, "n").collect()) == [1, 3]
    assert [r.n for r in store.members(numbers, two, "n").collect()] == [2, 2]


def test_footprint(spark):
    entries = spark.createDataFrame(
        [("models--org--m", 1048576), ("org_m-v2", 524288), ("other", 5)], "directory string, length long"
    )
    rows = {r.name: r.megabytes for r in reports.footprint(entries, ["org/m", "none"]).collect()}
    assert rows == {"org/m": 1.5, "none": None}


def test_user_function_over_files(spark, tree):
    def factory():
        def handle(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"path": batch["path"], "size": batch["content"].map(len)})

        return handle

    rows = for_each_file(source_tree(spark, str(tree)), factory, "path string, size long").collect()
    assert len(rows) == len(FOUND) and all(r["size"] > 3 for r in rows)


def test_a_wide_and_deep_tree_is_listed_by_levels(spark, tmp_path):
    for i in range(20):
        for j in range(20):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "m.py").write_text("x = 1")
        (tmp_path / f"d{i}" / "n.py").write_text("y = 1")
    deep = tmp_path.joinpath(*[f"l{k}" for k in range(30)])
    deep.mkdir(parents=True)
    (deep / "z.py").write_text("z = 1")
    found = [r.path for r in tree_listing(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(str(path) for path in tmp_path.rglob("*.py"))
    assert tree_listing(spark, str(deep / "z.py")).collect()[0].length == 5
