"""Operators on random graphs against plain walkers."""

import heapq
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vhist.functions.textdiff import edit_script, lines_of, spans
from vhist.operators import blame, graph, history, refs, search, shortlog
from vhist.plans.materialize import materialized
from vhist.queries import QUERIES
from vhist.streaming import ingest

START = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def dag(spark):
    """160 commits, clocks skewed, merges where i % 3 is 0; equal times happen."""
    r = random.Random(11)
    parents = {0: []}
    for i in range(1, 160):
        parents[i] = [max(0, i - 2)] + ([max(0, i - 3)] if i % 3 == 0 and max(0, i - 3) != max(0, i - 2) else [])
    time = {i: START + timedelta(seconds=i // 2 * 10 + r.randrange(-30, 30)) for i in parents}
    edges = spark.createDataFrame([(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)], "child long, ord int, parent long").cache()
    commits = spark.createDataFrame([(i, f"{i:040x}", time[i], i) for i in parents], "id long, oid string, time timestamp_ntz, seq long").cache()
    return parents, time, edges, commits


def ancestors(parents, roots, first=False):
    seen, todo = set(roots), list(roots)
    while todo:
        for p in parents[todo.pop()][: 1 if first else None]:
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def roots_of(spark, pairs):
    return spark.createDataFrame(pairs, "root long, node long")


def test_closure(spark, dag):
    parents, _, edges, _ = dag
    got = {(x.root, x.node) for x in graph.closure(roots_of(spark, [(1, 159), (2, 60), (3, 0)]), edges).collect()}
    assert got == {(1, n) for n in ancestors(parents, [159])} | {(2, n) for n in ancestors(parents, [60])} | {(3, 0)}
    got = {x.node for x in graph.closure(roots_of(spark, [(1, 158)]), edges, first_parent=True).collect()}
    assert got == ancestors(parents, [158], True)


def test_ranges_and_bases(spark, dag):
    parents, _, edges, commits = dag
    got = {x.node for x in graph.ranges(roots_of(spark, [(1, 159)]), roots_of(spark, [(1, 100)]), edges).collect()}
    assert got == ancestors(parents, [159]) - ancestors(parents, [100])
    pairs = spark.createDataFrame([(1, 159, 158), (2, 7, 4)], "pair long, a long, b long")
    got = {(x.pair, x.node) for x in graph.merge_bases(pairs, edges, commits).collect()}
    want = set()
    for k, a, b in [(1, 159, 158), (2, 7, 4)]:
        common = ancestors(parents, [a]) & ancestors(parents, [b])
        want |= {(k, n) for n in common - {p for n in common for p in parents[n]}}
    assert got == want
    assert {x.pair: x.yes for x in graph.is_ancestor(pairs.selectExpr("pair", "b as a", "a as b"), edges).collect()} == {1: 158 in ancestors(parents, [159]), 2: 4 in ancestors(parents, [7])}


def plain_walk(parents, time, starts):
    heap, seen, want = [], set(), []
    for n in starts:
        if n not in seen:
            seen.add(n)
            heapq.heappush(heap, (-time[n].timestamp(), len(seen), n))
    while heap:
        n = heapq.heappop(heap)[2]
        want.append(n)
        for p in parents[n]:
            if p not in seen:
                seen.add(p)
                heapq.heappush(heap, (-time[p].timestamp(), len(seen), p))
    return want


def test_walk(spark, dag):
    parents, time, edges, commits = dag
    start = roots_of(spark, [(1, 159), (2, 60)])
    found = graph.closure(start, edges)
    got = [(x.root, x.node) for x in graph.walk(found, start, edges, commits).orderBy("root", "pos").collect()]
    assert got == [(1, n) for n in plain_walk(parents, time, [159])] + [(2, n) for n in plain_walk(parents, time, [60])]
    assert graph.heap_needed(found, edges, commits).first().exact
    got = [x.node for x in graph.walk(found, start, edges, commits, limit=20).where("root = 1").orderBy("pos").collect()]
    assert got == plain_walk(parents, time, [159])[:20]


@pytest.mark.parametrize("seed", range(2))
def test_walk_with_few_times(spark, seed):
    """Many equal times, several starts in a given order, skew, random merges."""
    r = random.Random(seed)
    parents = {i: r.sample(range(max(0, i - 8), i), min(i, r.choice([1, 1, 2, 3]))) for i in range(60)}
    time = {i: START + timedelta(seconds=(i // r.choice([3, 5])) - r.choice([0, 0, 0, 6])) for i in parents}
    edges = spark.createDataFrame([(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)], "child long, ord int, parent long")
    commits = spark.createDataFrame([(i, time[i]) for i in parents], "id long, time timestamp_ntz")
    given = r.sample(range(40, 60), 5)
    start = spark.createDataFrame([(1, n, k) for k, n in enumerate(given)], "root long, node long, k int")
    got = [x.node for x in graph.walk(graph.closure(start, edges), start, edges, commits).orderBy("pos").collect()]
    assert got == plain_walk(parents, time, given)


def test_walk_writes_only_what_moves(spark, monkeypatch):
    """Rows outside stretches are stored once, with the times' order, and not again with the heaps' places."""
    stored = []

    def counted(df):
        out = materialized(df)
        stored.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(graph, "materialized", counted)
    parents = {i: [i - 1] if i else [] for i in range(300)}
    time = {i: START + timedelta(seconds=i - (i == 200)) for i in parents}
    edges = spark.createDataFrame([(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)], "child long, ord int, parent long")
    commits = spark.createDataFrame([(i, time[i]) for i in parents], "id long, time timestamp_ntz")
    start = roots_of(spark, [(1, 299)])
    got = [x.node for x in graph.walk(graph.closure(start, edges), start, edges, commits).orderBy("pos").collect()]
    assert got == plain_walk(parents, time, [299])
    assert [n for columns, n in stored if "t" in columns and "lo" in columns] == [2, 2]
    monkeypatch.setattr(graph, "ROWS_A_ROOT", 100)
    dealt = graph.timed(graph.closure(start, edges), commits).orderBy("pos").collect()
    assert [x.pos for x in dealt] == list(range(1, 301)) and sorted(x.node for x in dealt if x.tie) == [199, 200]


def test_random_graphs(spark):
    """Closures, ranges, bases and membership on graphs with many chains, nodes without edges, and unrelated roots."""
    for seed in range(1):
        r = random.Random(seed)
        parents = {i: r.sample(range(max(0, i - 12), i), min(i, r.choice([0, 1, 1, 1, 2, 3]))) for i in range(80)}
        edges = spark.createDataFrame([(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)], "child long, ord int, parent long")
        commits = spark.createDataFrame([(i, f"{i:040x}", i) for i in parents], "id long, oid string, time long")
        asked = [(k, r.randrange(80)) for k in range(8)] + [(0, 79), (9, 1000)]
        for first in (False, True):
            got = sorted((x.root, x.node) for x in graph.closure(roots_of(spark, asked), edges, first).collect())
            assert got == sorted((k, n) for k in {q for q, _ in asked} for n in ancestors({**parents, 1000: []}, [m for q, m in asked if q == k], first))
        less = [(k, r.randrange(60)) for k in range(0, 8, 2)]
        for first in (False, True):
            got = sorted((x.root, x.node) for x in graph.ranges(roots_of(spark, asked[:8]), roots_of(spark, less), edges, first).collect())
            assert got == sorted((k, n) for k, m in asked[:8] for n in ancestors(parents, [m], first) - ancestors(parents, [b for q, b in less if q == k]))
        pairs = [(k, r.randrange(80), r.randrange(80)) for k in range(20)]
        frame = spark.createDataFrame(pairs, "pair long, a long, b long")
        got = sorted((x.pair, x.node) for x in graph.merge_bases(frame, edges, commits).collect())
        want = []
        for k, a, b in pairs:
            common = ancestors(parents, [a]) & ancestors(parents, [b])
            want += [(k, n) for n in common - {p for n in common for p in parents[n]}]
        assert got == sorted(want)
        assert sorted((x.pair, x.yes) for x in graph.is_ancestor(frame, edges).collect()) == [(k, a in ancestors(parents, [b])) for k, a, b in pairs]


def test_long_chain(spark, monkeypatch):
    """100,000 commits in a row with merges: rounds grow with the logarithm of the depth."""
    calls = []
    monkeypatch.setattr(graph, "materialized", lambda df: calls.append(1) or materialized(df))
    n = 100_000
    line = spark.range(1, n).select(F.col("id").alias("child"), F.lit(0).alias("ord"), (F.col("id") - 1).alias("parent"))
    side = spark.range(5, n, 1000).select(F.col("id").alias("child"), F.lit(1).alias("ord"), (F.col("id") - 4).alias("parent"))
    edges = line.unionByName(side)
    got = {x.root: x["count"] for x in graph.closure(roots_of(spark, [(1, n - 1), (2, 7)]), edges).groupBy("root").count().collect()}
    assert got == {1: n, 2: 8} and len(calls) < 40
    pair = spark.createDataFrame([(1, n - 1, 500)], "pair long, a long, b long")
    assert not graph.is_ancestor(pair, edges).first().yes


def test_nth(spark, dag):
    parents, _, edges, _ = dag
    at = 159
    for _ in range(13):
        at = parents[at][0]
    assert graph.nth_ancestor(roots_of(spark, [(1, 159)]), edges, 13).first().node == at
    assert graph.nth_parent(roots_of(spark, [(1, 9)]), edges, 2).first().node == parents[9][1]
    assert graph.nth_parent(roots_of(spark, [(1, 10)]), edges, 2).isEmpty()


@pytest.mark.parametrize("first_parent", [False, True])
def test_simplification(spark, dag, first_parent):
    parents, _, edges, commits = dag
    r = random.Random(5)
    writes = {i: str(r.randrange(3)) for i in parents if r.random() < 0.2}
    value = {}
    for i in parents:
        value[i] = writes.get(i, value[parents[i][0]] if parents[i] else None)
    seen, todo, want = {159}, [159], set()
    while todo:
        n = todo.pop()
        ps = parents[n][: 1 if first_parent else None]
        same = [p for p in ps if value[p] == value[n]]
        if not same and (ps or value[n] is not None):
            want.add(n)
        for p in same[:1] or ps:
            if p not in seen:
                seen.add(p)
                todo.append(p)
    rows = spark.createDataFrame(list(writes.items()), "id long, value string")
    got = {x.node for x in history.path_log(roots_of(spark, [(1, 159)]), commits, edges, rows, first_parent).collect()}
    assert got == want


def test_blame(spark):
    r = random.Random(8)
    parents = {0: [], 1: [0], 2: [0], 3: [1, 2], 4: [3], 5: [4, 2]}
    text = {0: "".join(f"{k}\n" for k in range(12))}
    for n in range(1, 6):
        ls = lines_of(text[parents[n][0]])
        for _ in range(4):
            ls.insert(r.randrange(len(ls) + 1), f"{n}.{r.random()}\n") if r.random() < 0.6 else ls.pop(r.randrange(len(ls)))
        text[n] = "".join(ls)
    want = {}
    live = [(5, i, i) for i in range(len(lines_of(text[5])))]
    while live:
        n, at, final = live.pop()
        for p in parents[n]:
            kept = {j: i for k, i, j in edit_script(lines_of(text[p]), lines_of(text[n])) if k == " "}
            if at in kept:
                live.append((p, kept[at], final))
                break
        else:
            want[final + 1] = (n, at + 1)
    edges = spark.createDataFrame([(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)], "child long, ord int, parent long")
    files = spark.createDataFrame(list(text.items()), "node long, content string")
    rows = blame.blame(roots_of(spark, [(1, 5)]), files, edges).collect()
    assert {x.final_line: (x.node, x.original_line) for x in rows} == want
    assert all(x.boundary == (x.node == 0) for x in rows)


def test_names(spark):
    commits = spark.createDataFrame([(1, "abcd" + "0" * 36), (2, "abcd1" + "0" * 35), (3, "f" * 40)], "id long, oid string")
    names = spark.createDataFrame([("main",), ("v1",), ("abcd",), ("abcd1",), ("ffff",), ("fff",), ("f" * 40,), ("nope",)], "name string")
    where = spark.createDataFrame([("refs/heads/main", 1), ("refs/tags/main", 2), ("refs/tags/v1", 2)], "name string, id long")
    got = {x.name: (x.id, x.how) for x in refs.resolve(names, where, commits).collect()}
    assert got == {"main": (1, "ref"), "v1": (2, "ref"), "abcd1": (2, "object"), "ffff": (3, "object"), "f" * 40: (3, "object")}
    short = {x.id: x.short for x in refs.abbreviations(commits, 4).collect()}
    assert short == {1: "abcd0", 2: "abcd1", 3: "ffff"}


def test_search(spark):
    files = spark.createDataFrame([("a", "one\ntwo\n"), ("b", "x\0two"), ("c", "two\r\nTWO"), ("d", None), ("e", "")], "path string, content string")
    assert {(x.path, x.line_no) for x in search.grep(files, ["two"]).collect()} == {("a", 2), ("c", 1)}
    assert {(x.path, x.n) for x in search.grep_counts(files, ["TWO"], icase=True).collect()} == {("a", 1), ("c", 2)}
    assert {x.path for x in search.grep_files(files, ["^t"]).collect()} == {"a", "c"}
    assert {(x.path, x.line_no) for x in search.grep(files, ["t.o"], fixed=True).collect()} == set()
    assert search.basic_regex(r"\(a\|b\)+(") == r"(a|b)\+\("
    with pytest.raises(ValueError):
        search.basic_regex(r"\(a\)\1")
    oid = files.where("path = 'e'").select(search.blob_id(files.content)).first()[0]
    assert oid == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


def test_renames(spark):
    d = spark.createDataFrame([("x", "p/a"), ("x", "p/b"), ("y", "q")], "oid string, path string")
    a = spark.createDataFrame([("x", "r/b"), ("x", "r/c"), ("x", "r/d"), ("z", "q2")], "oid string, path string")
    assert {tuple(x) for x in search.exact_renames(d, a).collect()} == {("p/b", "r/b"), ("p/a", "r/c")}


def test_shortlog(spark):
    rows = [(1, "A", "a@x", "s"), (2, "B", "A@X", "s"), (3, "C", "c@x", "s")]
    commits = spark.createDataFrame(rows, "id long, author string, email string, subject string")
    rules = spark.createDataFrame([(1, "Ann", None, "A", "a@x"), (2, "Anne", "n@x", None, "a@X")], "line_no int, name string, email string, old_name string, old_email string")
    got = {x.id: (x.author, x.email) for x in shortlog.mapped(commits, rules).collect()}
    assert got == {1: ("Ann", "a@x"), 2: ("Anne", "n@x"), 3: ("C", "c@x")}
    texts = spark.createDataFrame([("[PATCH 1/2] fix\n it\n\nbody",), ("",), (None,)], "m string")
    assert [x[0] for x in texts.select(shortlog.subject(texts.m)).collect()] == ["fix it", "<none>", "<none>"]


def test_ingest(spark, tmp_path):
    base, inbox = f"file://{tmp_path}/base", str(tmp_path / "in")
    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(inbox)
    put([3, 2])
    schema = spark.read.parquet(inbox).schema
    run = lambda: ingest.ingest(spark.readStream.schema(schema).parquet(inbox), base).awaitTermination()
    run()
    put([2, 1])
    run()
    assert sorted(x.id for x in ingest.covered(spark, base, schema).collect()) == [1, 2, 3]
    version, _ = ingest.latest(spark, base)
    with pytest.raises(ingest.Conflict):
        ingest.publish(spark, base, version, {})
    ingest.compact(spark, base, schema)
    assert sorted(x.id for x in ingest.covered(spark, base, schema).collect()) == [1, 2, 3]
    edges = spark.createDataFrame([(3, 0, 2), (1, 0, 0)], "child long, ord int, parent long")
    assert [x.parent for x in ingest.frontier(ingest.covered(spark, base, schema), edges).collect()] == [0]


def test_similar_pairs(spark, monkeypatch, tmp_path):
    """Against all pairs: chains away from a line's smallest path, short lines only, hot lines, copies, CR LF, no text."""
    monkeypatch.setattr(search, "BLOCK", 4, raising=False)
    r = random.Random(5)
    licence = "This line of the licence stands in each of these files, see below.\n"
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)) + "\n"
    texts = ["", None, "x", "x", "a\r\nb\r\n", "a\r\nb\r\n", "a\nb\n"]
    for size in (12, 50, 150):
        for _ in range(3):
            body = [line(size) for _ in range(8)]
            for cut in (0, 2, 4, 6):
                own = body[cut:] + [line(size) for _ in range(cut)]
                r.shuffle(own)
                texts.append(licence + "".join(own))
    texts += [licence] * 9 + [texts[7]] * 6
    files = {f"s/l/{100 + i}.txt": t for i, t in enumerate(texts)}
    counted = {p: spans((t or "").encode(), False) for p, t in files.items()}
    want = set()
    for a in files:
        for b in files:
            big = max(len((files[a] or "").encode()), len((files[b] or "").encode()))
            score = sum((counted[a] & counted[b]).values()) * 60000 // big if big else 0
            if a < b and score >= 30000:
                want.add((a, b, score))
    docs = [(100 + i, "s", "l", t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["rename_similarity"](spark, str(tmp_path)).collect()
    members: dict[str, list[tuple[str, int]]] = {}
    for x in rows:
        if x.copy:
            assert files[x.old] == files[x.new] and x.old < x.new
            members.setdefault(x.old, []).append((x.new, x.score))
    got = []
    for x in rows:
        if not x.copy:
            assert files[x.old] != files[x.new]
            both = [[p, *(c for c, _ in members.get(p, []))] for p in (x.old, x.new)]
            got += [(min(a, b), max(a, b), x.score) for a in both[0] for b in both[1]]
    for head, copies in members.items():
        paths = sorted([head, *(c for c, _ in copies)])
        got += [(a, b, copies[0][1]) for n, a in enumerate(paths) for b in paths[n + 1 :]]
    assert sum(x.copy for x in rows) == sum(len(c) for c in members.values()) < 20
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
