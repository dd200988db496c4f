"""Operators over whole tables, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vhist.llm import common, components, decontaminate, line_dedup, near_dup, neighbours, secrets, warc

WORDS = [f"w{i}" for i in range(60)]


def group_of(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = group_of(links, {n for p in links if p[0] != p[1] for n in p})
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")).count() == 0


def near_texts():
    r = random.Random(9)
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(WORDS) for _ in range(r.choice([3, 9, 30, 120, 400]))]
        for _ in range(r.randrange(1, 9)):
            ws = list(base)
            for _ in range(r.randrange(0, 1 + len(ws) // 25)):
                ws[r.randrange(len(ws))] = r.choice(WORDS)
            rows.append((n, " ".join(ws)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "é É"), (n + 6, "x " * 30_000)]
    return rows


@pytest.mark.parametrize("k, similar, block", [(4, 85, 1 << 20), (5, 80, 50), (2, 60, 1 << 20)])
def test_near_duplicates(spark, monkeypatch, k, similar, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = near_texts()
    # Ids that repeat, with a text that others have, with one of their own, and with none.
    rows += [(1000, rows[0][1]), (1000, rows[40][1]), (1001, "words of its own alone"), (1001, rows[30][1]), (1002, None), (1002, rows[50][1])]
    docs = spark.createDataFrame([(*x, "c") for x in rows] + [(None, "one two", "c"), (rows[0][0], rows[0][1], "c")], "doc_id long, text string, component_id string")
    out = near_dup.near_duplicates(docs, k, similar).collect()
    sets = []
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append((i, {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()))
    links = [(a, b) for n, (a, s) in enumerate(sets) for b, t in sets[:n] if a != b and s and 100 * len(s & t) >= similar * len(s | t)]
    want = group_of(links, {i for i, _ in rows})
    assert len(links) > 20 and len(out) == len(rows) + 2
    left = sorted((i, len(s)) for i, s in [*sets, sets[0]])
    assert left == sorted((x.doc_id, x.n_shingles) for x in out if x.doc_id is not None)
    assert all(x.component_id == (None if x.doc_id is None else want[x.doc_id]) for x in out)
    assert near_dup.near_duplicates(docs.limit(0), k, similar).count() == 0


def test_large_family_of_long_texts(spark):
    """5,000 near copies of a long text and some texts that share passages with them: one comparison a copy, in little memory."""
    import resource

    words = F.expr("transform(sequence(1, 1500), i -> concat('w', i))")
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("base"))
    docs = docs.select("doc_id", F.concat("base", F.lit(" end"), F.col("doc_id").cast("string")).alias("text"))
    other = spark.range(5000, 5020).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.slice(words, 1, 1100), " "), F.expr("array_join(transform(sequence(1, 400), i -> concat(' x', id, i)), '')")).alias("text"))
    out = near_dup.near_duplicates(docs.unionByName(other), 4, 85)
    assert out.where("doc_id < 5000 AND component_id = 0").count() == 5000 and out.where("component_id = doc_id").count() == 21
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 3_000_000


def test_spanning_links_skip_components():
    """Blocks of long near copies that are known to hang together cost nothing; links across are found once."""
    r = np.random.default_rng(2)
    base = [np.unique(r.integers(0, 2**63, 20_000).astype(np.uint64)) for _ in range(2)]
    sets = [np.unique(np.concatenate([base[i % 2][n:], r.integers(0, 2**63, n).astype(np.uint64)])) for i, n in enumerate(range(1, 121))]
    ids = np.arange(120)
    links = list(near_dup.spanning_links(ids, sets, np.zeros(120, int), ids % 2, 85))
    assert links == []
    links = list(near_dup.spanning_links(ids, sets, np.zeros(120, int), ids, 85))
    assert len(links) == 118 and all((a - b) % 2 == 0 for a, b in links)


def test_close_sets_lose_no_link():
    """Sets that link are close by size and bitmap, in one block and across two; components that links join get one label."""
    r = np.random.default_rng(6)
    for similar, lower in ((60, 0), (80, 40), (85, 0)):
        sets = []
        for size in (1, 2, 4, 9, 30, 50, 60):
            for _ in range(5):
                base = r.integers(0, 2**63, size).astype(np.uint64)
                sets += [np.unique(np.concatenate([base[e:], r.integers(0, 2**63, e).astype(np.uint64)])) for e in r.integers(0, 1 + size // 4, 5)]
        sets.sort(key=len)
        n, component = np.array([len(s) for s in sets]), r.integers(0, 60, len(sets))
        bits = np.frombuffer(b"".join(near_dup.parities(s, 128) for s in sets), np.uint64).reshape(len(sets), -1)
        for side in (np.zeros(len(sets), int), r.integers(0, 2, len(sets))):
            met, label = near_dup.close_sets(n, bits, component, side, lower, similar)
            links = [(i, j) for i in range(len(sets)) for j in range(i) if component[i] != component[j] and n[i] > lower and (side[i] != side[j] or not side.any()) and near_dup.linked(sets[i], sets[j], similar)]
            assert len(links) >= 10 and all(met[i] and met[j] and label[i] == label[j] for i, j in links)
            assert all(len(set(label[component == c].tolist())) == 1 for c in component)


@pytest.mark.parametrize("cells", [1 << 23, 4096])
def test_sets_with_common_passages_are_not_compared(spark, monkeypatch, cells):
    """Texts that hang together by a few common shingles aren't compared word by word: what is doesn't grow with the family."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(14)]
    rows = [(i, " ".join(common + [f"w{r.randrange(10**6)}" for _ in range(r.randrange(18, 40))])) for i in range(600)]
    # Chains whose ends aren't linked, so that no hub is linked with all.
    for chain in range(6):
        ws = common + [f"x{chain}y{j}" for j in range(60)]
        for step in range(8):
            rows.append((1000 + 10 * chain + step, " ".join(ws)))
            ws = ws[:14] + ws[17:] + [f"z{chain}y{3 * step + j}" for j in range(3)]
    r.shuffle(rows)
    seen = []
    whole = near_dup.links_in_blocks
    monkeypatch.setattr(near_dup, "CELLS", cells, raising=False)
    monkeypatch.setattr(near_dup, "links_in_blocks", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs, 5, 80).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) >= 42 and got == group_of(links, sets)
    assert sum(seen) <= 60


def shuffled(spark):
    """Name and bytes of the shuffle files that there are."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffles(spark):
    import time

    before = set(shuffled(spark))
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    out = common.stored(df.groupBy("k").agg(F.sum("id").alias("s")).join(df, "k").repartition(3, "s"))
    end = time.time() + 20
    while set(shuffled(spark)) - before and time.time() < end:
        time.sleep(0.2)
    assert not set(shuffled(spark)) - before and out.count() == 1000
    assert out.groupBy("k").count().collect() and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_candidate_sets_travel_packed(spark):
    """Every set with a link is a candidate, however many slots there are; signatures take about ten bytes each on the way."""
    r = random.Random(12)
    rows = []
    for i in range(0, 400, 2):
        ws = [f"w{r.randrange(10**6)}" for _ in range(r.choice([6, 40, 300]))]
        rows += [(i, " ".join(ws)), (i + 1, " ".join(ws[: len(ws) - len(ws) // 40] if i % 8 else ws[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kit = near_dup.Shingles(5)
    sets = [kit.of(t.encode()) for _, t in rows]
    want = {int(near_dup.digest(x)[0]) % 2**64 >> 26 for a, b in zip(sets[::2], sets[1::2]) if len(a) != len(b) and near_dup.linked(a, b, 80) for x in (a, b)}
    signatures = len(near_dup.signatures_of(sets, 80)[0])
    for shingles in (0, 2**29):
        before = set(shuffled(spark))
        got = {x.x38 for x in near_dup.candidate_sets(docs, 5, 80, shingles).collect()}
        assert len(want) > 50 and want <= got and len(got) < len(rows)
        if not shingles:
            assert sum(n for f, n in shuffled(spark).items() if f not in before) - sum(len(t) for _, t in rows) < 16 * signatures


def test_partenum_shares_a_signature():
    """Any two sets that are similar enough share a signature, whatever their size; also with many empty partitions."""
    r = np.random.default_rng(3)
    for similar in (60, 85):
        for size in [1, 2, 3, 5, 8, 13, 21, 40, 90, 300]:
            for _ in range(6):
                a = r.integers(0, 2**63, size).astype(np.uint64)
                change = int(size * (100 - similar) / 100 * r.random())
                b = np.concatenate([a[: size - change], r.integers(0, 2**63, r.integers(0, change + 1)).astype(np.uint64)])
                a, b = np.unique(a), np.unique(b)
                common = len(np.intersect1d(a, b))
                if len(b) and 100 * common >= similar * (len(a) + len(b) - common):
                    sig, at, band, shares = near_dup.signatures_of([a, b], similar)
                    common = set(sig[at == 0].tolist()) & set(sig[at == 1].tolist())
                    count = lambda s, h: sum(i == s and g == h and x in common for x, i, g in zip(sig.tolist(), at, band))
                    # In some band both have it, each shares as many as it says a link takes.
                    assert any(all(shares[s, e] and count(s, e) >= shares[s, e] for s, e in ((0, h), (1, g))) for h, g in ((0, 0), (0, 1), (1, 0), (1, 1)))


def test_line_dedup(spark):
    r = random.Random(6)
    pool = [f"line {i} " + "x" * r.choice([0, 5, 60, 100, 200]) for i in range(16)] + [""]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 30)))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a\nb\nc\nd\na\nb\nc\nd")]
    docs = spark.createDataFrame([(*x, 7) for x in rows] + [(*rows[5], 7)], "doc_id long, text string, n_lines int")
    out = line_dedup.dedup_lines(docs).collect()
    first, gone, longest = {}, defaultdict(set), defaultdict(int)
    for i, t in sorted(rows):
        ls = (t or "").split("\n") if t is not None else []
        for n in (1, 2, 3, 4, 8, 16, 32):
            for at in range(len(ls) - n + 1):
                if first.setdefault((n, tuple(ls[at : at + n])), (i, at)) < (i, at):
                    longest[i] = max(longest[i], n if n != 3 else 2)
                    if n == line_dedup.RUN or n < line_dedup.RUN and sum(map(len, ls[at : at + n])) >= line_dedup.CHARS:
                        gone[i] |= set(range(at, at + n))
    for x in out:
        t = dict(rows)[x.doc_id]
        if t is None:
            assert x.text is None and x.n_lines == x.n_deleted == 0
            continue
        ls = t.split("\n")
        assert x.text == "\n".join(line for k, line in enumerate(ls) if k not in gone[x.doc_id])
        assert (x.n_lines, x.n_deleted, x.longest_run) == (len(ls), len(gone[x.doc_id]), longest[x.doc_id])
    assert len(out) == len(rows) + 1 and sum(map(len, gone.values())) > 30


def test_line_dedup_short_lines(spark):
    """A passage of over 50 words on two or three lines, each below 160 characters, in two documents; clashing columns stay."""
    two, three = ["a " * 60, "b " * 40], ["c " * 27, "d " * 27, "e " * 27]
    rows = [(1, "\n".join(["x", *two, "y"])), (2, "\n".join([*two, "z"])), (3, "\n".join(three)), (4, "\n".join(["q", *three, "r"])), (5, "\n".join(three[:2]))]
    rows.append((6, "\n".join(["w " * 10_000] * 3 + [f"line {i}" for i in range(3000)])))
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, d int, _h int, row int")
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs).collect()}
    assert {i: got[i].text for i in range(1, 6)} == {1: rows[0][1], 2: "z", 3: rows[2][1], 4: "q\nr", 5: rows[4][1]}
    assert got[6].text == "\n".join(["w " * 10_000] + [f"line {i}" for i in range(3000)]) and got[6].n_deleted == 2
    assert (got[2].d, got[2]._h, got[2].row) == (1, 2, 3)


def test_line_dedup_null_ids_and_empty(spark):
    long = "x" * 300
    docs = spark.createDataFrame([(None, long), (4, long), (4, long + "\ny")], "doc_id long, text string")
    out = {(x.doc_id, x.n_lines): x.text for x in line_dedup.dedup_lines(docs).collect()}
    assert out[None, 1] == long and out[4, 1] == "" and out[4, 2] == "y"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def hits(docs, items, size):
    out = {}
    split = lambda t: decontaminate.words((t or "").encode())
    wins = {(i, tuple(w[k : k + size])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - size + 1))}
    for d, t in docs:
        ws, hit, named = split(t), set(), set()
        for i, g in wins:
            for k in range(len(ws) - len(g) + 1):
                if tuple(ws[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    named.add(str(i))
        out[d] = (len(ws), len(hit), sorted(named))
    return out


@pytest.mark.parametrize("limit", [500_000, 3])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", limit)
    r = random.Random(2)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 6, 12, 30])] + [(7, None), (8, "..."), (10, "same same same same same same same")]
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(80))) for i in range(20)]
    docs += [(100 + i, f"{docs[i][1]}, {items[i % 7][1].upper()}! {docs[i + 1][1]}") for i in range(14)]
    docs += [(200, None), (201, ""), (202, "same " * 9), (203, items[6][1]), (204, items[6][1][:40])]
    frame = lambda rows, key: spark.createDataFrame([(*x, "c") for x in rows], f"{key} long, text string, key string")
    given = frame([*docs, docs[25], (None, docs[25][1])], "doc_id")
    out = decontaminate.contamination(given, frame([*items, items[2]], "item_id"), size=6).collect()
    want = hits([*docs, (None, docs[25][1])], items, 6)
    assert len(out) == len(docs) + 2
    for x in out:
        assert (x.n_words, x.n_hit, x["items"]) == want[x.doc_id] and x.contaminated == (x.n_hit > 0) and x.n_items == len(x["items"])
    assert decontaminate.contamination(given, frame(items, "item_id").limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(given.limit(0), frame(items, "item_id")).count() == 0


def test_decontamination_item_ids(spark):
    """Items with one id and different texts, and null ids, against the query's SQL."""
    import duckdb

    r = random.Random(3)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(12))
    items = [(1, text()), (1, text()), (1, text()), (2, text()), (None, text()), (None, text())]
    items.append((3, items[3][1]))
    docs = [(i, f"{text()} {t} {text()}") for i, (_, t) in enumerate(items)] + [(20, items[0][1] + " " + items[4][1]), (21, text())]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    out = decontaminate.contamination(frame(docs, "doc_id"), frame(items, "item_id"))
    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        c.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    out = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(tuple(x) for x in out) == sorted(c.sql(decontaminate.ORACLE_OP4).fetchall())
    got = {x.doc_id: (x.n_hit, x.n_items) for x in out}
    assert got[20] == (24, 2) and got[4] == got[5] == (12, 1) and got[3][1] == 2 and got[21] == (0, 0)


def test_proximity(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "delta " + "z " * 20 + "alpha beta gamma")], "doc_id long, text string")
    index = decontaminate.Index(docs, item, size=4, rarest=4, slop=2)
    near = index.proximity().join(index.docs, "key").select("doc_id", "shift").collect()
    assert {(x.doc_id, x["shift"]) for x in near} <= {(1, 0), (2, 1), (2, 2)} and {1} <= {x.doc_id for x in near}


def test_neighbours(spark):
    r = np.random.default_rng(1)
    vs = r.normal(size=(600, 16))
    vs[100:300] = vs[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, rank int")
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0)
    got = defaultdict(list)
    for x in sorted(out.collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.vec_id, x.score))
    unit = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    right = 0
    assert sorted(got) == list(range(0, 600, 50))
    for q in got:
        cos = np.round(unit @ unit[q], 12)
        order = [int(i) for i in np.lexsort((np.arange(600), -cos)) if i != q][:5]
        right += len(set(order) & {i for i, _ in got[q]})
        assert all(abs(s - vs[i] @ vs[q] / np.linalg.norm(vs[i]) / np.linalg.norm(vs[q])) < 1e-9 for i, s in got[q])
    assert right / (5 * len(got)) >= 0.9
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    # Repeated ids stand for their smallest vector, and one longer vector changes nothing.
    more = spark.createDataFrame([(7, [-9.0] * 16, 0), (7, [8.0] * 16, 0), (5000, [1.0] * 17, 0), (5050, [2.0] * 17, 0)], df.schema)
    again = neighbours.nearest(df.where("vec_id < 60").unionByName(more), F.col("vec_id").isin(7, 50, 5050)).collect()
    assert sorted((x.query_id, x["rank"]) for x in again) == [(q, k) for q in (7, 50) for k in range(1, 6)] and len({(x.query_id, x.vec_id) for x in again}) == 10
    q = np.full(16, -9.0) / 36
    assert {x.vec_id for x in again if x.query_id == 7} == set(sorted((i for i in range(60) if i != 7), key=lambda i: -unit[i] @ q)[:5])


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours_recall(spark, monkeypatch, block):
    """The query itself on the table at hand, and clustered vectors, where far fewer points have to be looked at."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    out = neighbours.op2_neighbours(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = {(x.query_id, x.vec_id) for x in out.collect()}
    ids = np.array([x.vec_id for x in given])
    m = np.array([x.embedding for x in given], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(int(ids[q]), int(ids[j])) for q in np.flatnonzero(ids % 50 == 0) for j in [i for i in np.argsort(-(m @ m[q])) if i != q][:5]}
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)
    r = np.random.default_rng(5)
    centres = r.normal(size=(100, 24))
    tight = np.array([centres[i % 100] + 0.05 * r.normal(size=24) for i in range(4000)])
    tight /= np.linalg.norm(tight, axis=1, keepdims=True)
    loose = r.normal(size=(4000, 24))
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    assert neighbours.Forest(tight).effort(tight, 5) < 0.5 * neighbours.Forest(loose).effort(loose, 5)


def test_warc(spark, tmp_path):
    big, small = "é" * 60, "x" * 99
    rows = [(3, "u3", big), (1, "u1", big), (2, "u2", small), (4, "u4", small), (5, None, None), (6, "u6", ""), (7, "a\r\nb\u00e9", big + "!"), (None, "n", big), (None, "m", big)]
    rows += [(8, "u8", "z\r\n\r\n" * 50_000), (1, "u1", big), (2, "u2", small)]
    pages = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, payload string, first int")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    all_rows = warc.read_archive(spark, path).collect()
    out = {x.page_id: x for x in all_rows}
    assert len(all_rows) == len(rows) and [(out[i].record_type, out[i].refers_to) for i in (1, 2, 3, 4)] == [("response", None), ("response", None), ("revisit", 1), ("response", None)]
    assert out[None].record_type == "revisit" and out[1].payload_bytes == out[3].payload_bytes == 120 and out[5].payload_bytes == out[6].payload_bytes == 0
    assert sorted((x.page_id or 0, x.url) for x in all_rows) == sorted((i or 0, u or "") for i, u, _ in rows)
    whole = warc.parse(warc.reconstruct(spark, path)).collect()
    html = {i: (t or "").encode() for i, _, t in rows}
    ids = {x.page_id: x.record_id for x in whole}
    for x in whole:
        record, own = bytes(x.record), bytes(x.payload)
        head, http, *_ = record.split(b"\r\n\r\n")
        fields = dict(f.split(b": ", 1) for f in head.split(b"\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and http.startswith(b"HTTP/1.1 200 OK\r\n")
        assert {b"WARC-Record-ID", b"WARC-Date", b"WARC-Type", b"Content-Length"} <= set(fields)
        assert len(record) == len(head) + 4 + int(fields[b"Content-Length"]) + 4 and record.endswith(own + b"\r\n\r\n")
        assert own == (b"" if x.record_type == "revisit" else html[x.page_id])
        if x.record_type == "revisit":
            assert fields[b"WARC-Refers-To"].decode() == ids[x.refers_to] and b"identical-payload-digest" in fields[b"WARC-Profile"]
    assert len({x.record_id for x in whole}) == len({(i, u) for i, u, _ in rows})
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 5
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}-bad/payloads")
    stored.where("length(payload) <> 120").write.parquet(f"{path}-lost/payloads")
    for name, error in (("bad", "fit its digest"), ("lost", "no payload under")):
        spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-{name}/headers")
        with pytest.raises(Exception, match=error):
            warc.read_archive(spark, f"{path}-{name}").collect()
    warc.write_archive(pages.limit(0), f"{path}-none")
    assert warc.read_archive(spark, f"{path}-none").count() == 0
    same = spark.createDataFrame([(None, "u", big)] * 3, "page_id long, url string, html string")
    warc.write_archive(same, f"{path}-same")
    assert [x.record_type for x in warc.read_archive(spark, f"{path}-same").collect()] == ["response"] * 3
    assert spark.read.parquet(f"{path}-same/payloads").count() == 1


def test_secrets(spark):
    import re

    texts = ["", None, "é password: hunter2xyz and Token = 'abc' api-key", 'API_KEY="' + "a" * 30 + '"', "AKIA" + "Z" * 16 + " AKIAZ", "f" * 24 + " " + "f" * 23]
    texts += ["password=token:abcdefgh secret=secret=longenough", "x ghp_" + "a1" * 18, "deadbeef" * 500 + " passwd:aaaaaa", "token=" + "-" * 6, "no secrets here"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[2], "c"), (2, texts[2], "c")], "doc_id long, text string, kinds string")
    out = secrets.find_secrets(docs).select("doc_id", "spans").collect()
    base = {
        "assign": (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
    }
    for x in out:
        text = texts[2] if x.doc_id is None else texts[x.doc_id]
        want = {(m.start(), m.end(), k) for k, (p, g, least) in base.items() for m in p.finditer(text or "") if len(m[g]) >= least}
        assert {(s.start, s.end, s.kind) for s in x.spans if s.kind in base} == want
    assert len(out) == len(texts) + 2 and any(s.kind == "github" for x in out for s in x.spans)
    out = secrets.find_secrets(docs.selectExpr("doc_id", "text", "1 AS key", "2 AS spans", "3 AS row")).where("doc_id = 4").first()
    assert (out.key, out.row) == (1, 3) and len(out.spans) == 1
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(1, ("f" * 24 + " ") * 20_000), (2, ("f" * 24 + " ") * 20_000)], "doc_id long, text string")
    assert [len(x.spans) for x in secrets.find_secrets(many).collect()] == [20_000] * 2


def test_trigram_queries():
    """Derived queries hold for every match, and only patterns without a mandatory trigram have none."""
    import re

    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is None and q["access"] == ("and", "aki", "kia") and q["jwt"] == ("and", ".ey", "eyj")
    assert q["github"] == ("or", ("and", "gho", "ho_"), ("and", "ghp", "hp_"), ("and", "ghr", "hr_"), ("and", "ghs", "hs_"), ("and", "ghu", "hu_"))
    assert {"rsa"} & secrets.trigrams_in(q["pem"]) == set() and {"beg", "pri", "key"} <= secrets.trigrams_in(q["pem"])
    assert secrets.trigrams_in(q["assign"]) >= {"pas", "wor", "sec", "tok", "api", "key"}
    assert [secrets.trigram_query(p) for p in ("ab", "a?b?c?", "(abc)?d", "abc|d", "x*")] == [None] * 5
    assert secrets.trigram_query("(abcd|xyz)+\\d") == ("or", ("and", "abc", "bcd"), "xyz")

    def holds(query, text):
        return query is None or (query in text if isinstance(query, str) else (all if query[0] == "and" else any)(holds(x, text) for x in query[1:]))

    r = random.Random(7)
    for p in [r"ab[cd]e?fg", r"(foo|ba[rz]|q)x{1,3}yz", r"(?i:aBc)d+ef?", r"a(bc(de|fg)h|ij)+k", "[ab]{3}cde"]:
        query, hit = secrets.trigram_query(p), 0
        for _ in range(60_000):
            text = "".join(r.choice("abcdefghijkxyzqoABC"[: r.choice([8, 12, 19])]) for _ in range(9))
            if re.search(p, text):
                hit += 1
                assert holds(query, text.lower()), (p, query, text)
        assert hit or p.startswith("(foo")
