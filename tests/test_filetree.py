import pytest

from gaugeframe.sources.filetree import list_tree
from gaugeframe.sources.listing import experiment_tree


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """10,000 files: task/condition/participant/image, and a few where they do not belong."""
    root = tmp_path_factory.mktemp("tree")
    for t in range(2):
        for c in range(5):
            for p in range(20):
                d = root / f"t{t}" / f"c{c}" / f"p{p}"
                d.mkdir(parents=True)
                for i in range(50):
                    (d / f"img{i}{'.png' if i % 2 else '.txt'}").touch()
    (root / "img0.png").write_bytes(b"abc")
    (root / "t1" / "img1.png").touch()
    (root / "empty").mkdir()
    return root


def paths(df, root):
    return sorted(r.path[len(str(root)) + 1 :] for r in df.collect())


def on_disk(root, top="."):
    return sorted(str(p.relative_to(root)) for p in (root / top).rglob("*") if p.is_file())


@pytest.mark.parametrize("parts", [1, 2, 7, 64, 1000])
def test_every_file_is_listed_once(spark, tree, parts):
    assert paths(list_tree(spark, str(tree), parts=parts), tree) == on_disk(tree)


def test_several_tasks_list(spark, tree):
    df = list_tree(spark, str(tree), parts=20)
    assert df.rdd.getNumPartitions() == 20 and sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 10


def test_depth_prefix_and_pattern(spark, tree):
    assert paths(list_tree(spark, str(tree), depth=1), tree) == ["img0.png"]
    assert paths(list_tree(spark, str(tree), depth=2, parts=1), tree) == ["img0.png", "t1/img1.png"]
    assert paths(list_tree(spark, str(tree), depth=2, parts=64), tree) == ["img0.png", "t1/img1.png"]
    for parts in (1, 64):
        assert paths(list_tree(spark, str(tree), prefix="t1/c2", parts=parts), tree) == on_disk(tree, "t1/c2")
        assert paths(list_tree(spark, str(tree), prefix="t1/c", parts=parts), tree) == []
        assert paths(list_tree(spark, str(tree), pattern=r"^img4\d\.png$", parts=parts), tree) == [p for p in on_disk(tree) if p.split("/")[-1] in {f"img4{i}.png" for i in range(10)}]


def test_sizes_empty_and_missing_folders(spark, tree):
    assert [r.size for r in list_tree(spark, f"file://{tree}", depth=1).collect()] == [3]
    assert list_tree(spark, str(tree / "empty")).count() == 0
    with pytest.raises(Exception):
        list_tree(spark, str(tree / "absent")).count()


def test_experiment_tree_of_listed_files(spark, tree):
    root_depth = len(str(tree).split("/"))
    got = experiment_tree(list_tree(spark, str(tree)), root_depth)
    assert got.count() == 5000 and got.select("task", "condition", "participant").distinct().count() == 200
