"""The scan of a code tree: what is pruned is never opened."""

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains, StringStartsWith

from loomspark.functions import paths as P
from loomspark.sources.code_tree import CodeTree, CodeTreeReader

FILES = ["main.py", "big.bin", "src/a.py", "src/deep/er/b.py", "src/deep/er/tests/t.py", "src/deep/build/x.o", "src/latest/c.py", "node_modules/m/index.js", "docs/d.md", ".git/HEAD", "gen/out.tmp", "tests/t.py"]


def tree(folder):
    for k, f in enumerate(FILES):
        path = folder / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (k + 1))
    return str(folder)


class Counting(CodeTreeReader):
    """A reader that remembers what it opens and enters."""

    opened: list[str]

    def system(self):
        real, base = super().system()
        reader = self

        class System:
            def get_file_info(self, selector):
                reader.opened.append(selector.base_dir[len(base) :].strip("/") + "/")
                return real.get_file_info(selector)

            def open_input_stream(self, path):
                reader.opened.append(path[len(base) + 1 :])
                return real.open_input_stream(path)

        return System(), base


def scanned(root, filters=(), **kwargs):
    reader = Counting(root, kwargs.get("ignore", []), kwargs.get("tests", False), kwargs.get("content", True))
    reader.opened = []
    rest = list(reader.pushFilters(list(filters)))
    return sorted(r[0] for p in reader.partitions() for r in reader.read(p)), set(reader.opened), rest


def test_pruned_files_are_not_opened(tmp_path):
    root = tree(tmp_path)
    found, opened, _ = scanned(root, ignore=["*.tmp"])
    assert found == ["big.bin", "docs/d.md", "main.py", "src/a.py", "src/deep/er/b.py"]
    assert {x for x in opened if not x.endswith("/")} == set(found)
    assert not any(x.startswith((".git", "node_modules", "tests", "src/latest", "src/deep/build", "src/deep/er/tests")) for x in opened)
    kept, _, _ = scanned(root, tests=True)
    assert "src/latest/c.py" in kept and "tests/t.py" in kept and "node_modules/m/index.js" not in kept
    assert {x for x in scanned(root, content=False)[1] if not x.endswith("/")} == set()


def test_filters_prune_the_listing(tmp_path):
    root = tree(tmp_path)
    found, opened, rest = scanned(root, [StringStartsWith(("rel_path",), "src/deep"), GreaterThan(("size_bytes",), 2), StringContains(("rel_path",), "b")])
    assert found == ["src/deep/er/b.py"] and [type(f) for f in rest] == [StringContains]
    assert not any(x.startswith(("docs", "gen")) for x in opened)
    found, opened, rest = scanned(root, [EqualTo(("rel_path",), "docs/d.md")])
    assert found == ["docs/d.md"] and len(rest) == 1 and not any(x.startswith("src") for x in opened)


def test_read_through_spark(spark, tmp_path):
    root = tree(tmp_path)
    spark.dataSource.register(CodeTree)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("code_tree").option("ignore", "*.tmp").load(root)
        got = {r.rel_path: (r.size_bytes, bytes(r.content)) for r in df.collect()}
        kept = spark.createDataFrame([(f,) for f in FILES], "p string").filter(~P.ignored(F.col("p"), ["*.tmp"]) & ~P.is_test_path(F.col("p")))
        assert set(got) == {r.p for r in kept.collect()} and all(b"x" * n == c for n, c in got.values())
        assert [r.rel_path for r in df.filter("rel_path like 'src/%' and size_bytes > 3").collect()] == ["src/deep/er/b.py"]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
