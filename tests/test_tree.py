"""The repository source: what is listed, what is opened, what is pushed."""

import pyarrow.fs as pafs
import pytest

from quillspar.sources import repository, tree

FILES = {"src/a.js": "1", "src/b/c.ts": "2", "src/b/node_modules/d/e.js": "3", "node_modules/x/y.js": "4", "docs/z.md": "5", "README.md": "6", "src/b/é.js": "7"}


@pytest.fixture
def root(tmp_path):
    for name, body in FILES.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(body)
    (tmp_path / "r/src/odd.js").write_bytes(b"\xff\xfe")
    return str(tmp_path / "r")


class Counting:
    """A file system that remembers what was listed."""

    def __init__(self):
        self.fs, self.seen = pafs.LocalFileSystem(), []

    def get_file_info(self, selector):
        self.seen.append(selector.base_dir)
        return self.fs.get_file_info(selector)


@pytest.mark.parametrize(
    ("chosen", "folders", "files"),
    [
        (tree.Selection(("**/*.js",), ("**/node_modules/**",)), {"", "src", "src/b", "docs"}, {"src/a.js", "src/b/é.js", "src/odd.js"}),
        (tree.Selection(("src/**",), ("src/b/**",)), {"", "src"}, {"src/a.js", "src/odd.js"}),
        (tree.Selection(starts=("src/b/",), ends=(".ts",)), {"", "src", "src/b", "src/b/node_modules", "src/b/node_modules/d"}, {"src/b/c.ts"}),
        (tree.Selection(exact=("docs/z.md", "none/x")), {"", "docs"}, {"docs/z.md"}),
        (tree.Selection(parts=("READ",)), None, {"README.md"}),
    ],
)
def test_ignored_folders_are_never_listed(root, chosen, folders, files):
    fs = Counting()
    deeper, found = tree.listed(fs, root, "", chosen)
    found += tree.walked(fs, root, deeper, chosen)
    assert {p for p, _ in found} == files
    assert folders is None or {s.removeprefix(root).lstrip("/") for s in fs.seen} == folders


def test_rows_and_numbers(spark, root):
    found = {r.path: (r.size, r.content) for r in repository.tree(spark, root, [], ["**/node_modules/**"]).collect()}
    assert found == {p: (len(c.encode()), c) for p, c in FILES.items() if "node_modules" not in p} | {"src/odd.js": (2, "��")}
    assert [(r.ord, r.path) for r in repository.scan(spark, root, ["**/*.js"], ["**/node_modules/**"]).orderBy("ord").collect()] == [(1, "src/a.js"), (2, "src/b/é.js"), (3, "src/odd.js")]
    assert {r.content for r in repository.tree(spark, root, content=False).collect()} == {""}


def test_filters_reach_the_listing(spark, root, capsys):
    df = repository.tree(spark, root).filter("path LIKE 'src/%' AND path LIKE '%.ts' AND size > 0")
    assert [r.path for r in df.collect()] == ["src/b/c.ts"]
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "StartsWith" not in plan.split("Filter")[0] or "PushedFilters" in plan
    assert repository.tree(spark, root).filter("path IN ('docs/z.md', 'x')").count() == 1


def test_many_folders_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    for i in range(90):
        (tmp_path / f"m/d{i}/e").mkdir(parents=True)
        (tmp_path / f"m/d{i}/e/f.txt").write_text(str(i))
    reader = tree.RepositoryReader({"root": str(tmp_path / "m")})
    assert len(reader.partitions()) == tree.FANOUT and sum(len(p.folders) for p in reader.partitions()) == 90
    assert repository.tree(spark, str(tmp_path / "m")).count() == 90
    assert repository.tree(spark, str(tmp_path / "m/d0/e/")).count() == 1
