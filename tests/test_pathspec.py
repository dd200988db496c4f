import re

import pytest
from pyspark.sql import functions as F

from vhist.functions.pathspec import PathspecError, compile_specs, glob_regex, literal_prefix, parse
from vhist.operators import attributes

PATHS = ["a.txt", "dir/a.txt", "dir/sub/b.txt", "dir/sub/c.md", "DIR/A.TXT", "star*.txt", "starx.txt", "x/y", "with[b", "é.txt", "dirty/a"]


def select(spark, *specs, prefix=""):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return sorted(r[0] for r in df.where(compile_specs(list(specs), F.col("path"), prefix)).collect())


@pytest.mark.parametrize(
    "specs, expected",
    [
        (["dir"], ["dir/a.txt", "dir/sub/b.txt", "dir/sub/c.md"]),
        (["*.txt"], ["a.txt", "dir/a.txt", "dir/sub/b.txt", "star*.txt", "starx.txt", "é.txt"]),
        ([":(glob)*.txt"], ["a.txt", "star*.txt", "starx.txt", "é.txt"]),
        ([":(glob)**/b.txt"], ["dir/sub/b.txt"]),
        ([":(glob)dir/**/*.md"], ["dir/sub/c.md"]),
        ([":(icase)dir/a.txt"], ["DIR/A.TXT", "dir/a.txt"]),
        ([":(literal)star*.txt"], ["star*.txt"]),
        ([":!*.txt", ":!*.TXT"], ["dir/sub/c.md", "dirty/a", "with[b", "x/y"]),
        (["dir", ":^dir/sub"], ["dir/a.txt"]),
        (["[[:alpha:]].txt"], ["a.txt"]),
        (["a.txt/"], []),
        ([":"], sorted(PATHS)),
        (["s?arx.txt"], ["starx.txt"]),
        ([":(glob)d[!x]r/a.txt"], ["dir/a.txt"]),
    ],
)
def test_select(spark, specs, expected):
    assert select(spark, *specs) == sorted(expected)


def test_prefix(spark):
    assert select(spark, "sub", prefix="dir") == ["dir/sub/b.txt", "dir/sub/c.md"]
    assert select(spark, ":/a.txt", prefix="dir") == ["a.txt"]


@pytest.mark.parametrize("bad", [":(glob,literal)x", ":(nope)x", "../x", ":(glob", "x" * 5000])
def test_refused(bad):
    with pytest.raises(PathspecError):
        parse(bad)


def test_too_many():
    with pytest.raises(PathspecError):
        compile_specs(["a"] * 129, None)


def test_attributes(spark):
    df = spark.createDataFrame([("a", {"text": "+"}), ("b", {"text": "-"}), ("c", {}), ("d", {"text": "x"})], "path string, m map<string,string>")
    keep = lambda spec: [r[0] for r in df.where(compile_specs([spec], F.col("path"), attributes=F.col("m"))).collect()]
    assert keep(":(attr:text)") == ["a"] and keep(":(attr:-text)") == ["b"] and keep(":(attr:!text)") == ["c"] and keep(":(attr:text=x)") == ["d"]


def test_helpers():
    assert literal_prefix("src/ab*c") == "src/ab"
    assert re.match(glob_regex("a/**", True).replace(r"\z", r"\Z"), "a/b/c")


@pytest.mark.parametrize(
    "base, pattern, expected",
    [
        ("", "*", ["README", "a.tar.gz", "docs/a.md", "docs/sub/b.md", "en", "src1/README", "src1/en/x.c", "src1/x.c"]),
        ("", "README", ["README", "src1/README"]),
        ("", "/README", ["README"]),
        ("", "docs/*.md", ["docs/a.md"]),
        ("", "*.md", ["docs/a.md", "docs/sub/b.md"]),
        ("", "*.tar.gz", ["a.tar.gz"]),
        ("", "[ab]*", ["a.tar.gz", "docs/a.md", "docs/sub/b.md"]),
        ("", "**/x.c", ["src1/en/x.c", "src1/x.c"]),
        ("", "en/**", []),
        ("", "src1/**", ["src1/README", "src1/en/x.c", "src1/x.c"]),
        ("src1", "en/**", ["src1/en/x.c"]),
        ("src1", "src1/**", []),
        ("src1", "/x.c", ["src1/x.c"]),
        ("src1", "README", ["src1/README"]),
        ("docs", "sub/?.md", ["docs/sub/b.md"]),
        ("", "docs/", []),
        ("", "!README", []),
    ],
)
def test_attribute_rules(spark, base, pattern, expected):
    paths = ["README", "a.tar.gz", "docs/a.md", "docs/sub/b.md", "en", "src1/README", "src1/en/x.c", "src1/x.c"]
    rules = spark.createDataFrame([(0, 1, base, pattern, "text", "+")], "depth int, line int, base string, pattern string, attribute string, state string")
    out = attributes.states(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()
    assert sorted(r.path for r in out) == expected and all(r.state == "+" for r in out)
