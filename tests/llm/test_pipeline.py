import duckdb
import pytest

import corpus_pipeline
from vhist.llm.common import held_out, is_held_out, stored, table
from vhist.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == counts[-1] and "ids_sha256" in out.columns


def test_empty_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    extra = docs.limit(40).selectExpr("*", "'a' AS score", "1 AS n_lines", "2 AS n_deleted", "3 AS longest_run", "4 AS row", "5 AS _stays")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and out.select("score", "n_lines", "n_deleted", "longest_run", "row", "_stays").distinct().collect() in ([("a", 1, 2, 3, 4, 5)], []), name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 3, name


def test_near_duplicates_shuffle_texts_once(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "t", 13), (3, None, "en", "s", None), (3, "other", "en", "s", 5)]
    rows += [(None, "x y", "en", "s", 3), (None, "x y", "en", "s", 3), (0, "x y", "de", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id IS NULL OR doc_id <> 2").distinct().collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline.drop_near_duplicates(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and not [line for line in plan.splitlines() if "hashpartitioning" in line and "text" in line]


def test_queries_by_brute_force(spark):
    """The thin queries themselves: op1 against all pairs, op5 against the library, op7 and op9 by held-out accuracy, op3 by its rows."""
    import hashlib
    import struct

    import public_tokenizers
    import tiktoken

    from vhist.llm import bpe, html_text

    sf = "/root/testdata/sf0.01"
    docs = [(x.doc_id, x.text, x.lang) for x in table(spark, sf, "documents").collect()]
    labels = {x.doc_id: x.quality for x in table(spark, sf, "labels").collect()}
    got = {x.doc_id: x for x in QUERIES["op1_near_dup"](spark, SF).collect()}
    small = [(x.doc_id, x.text) for x in table(spark, SF, "documents").collect()]
    sets = {}
    for i, t in small:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[j : j + 4]) for j in range(max(1, len(ws) - 3))} if ws else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == {i: (len(s), root(i)) for i, s in sets.items()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    got = {x.doc_id: x for x in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    for i, t in small:
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    got = {x.doc_id: x for x in QUERIES["op7_quality"](spark, sf).collect()}
    held = [i for i in labels if is_held_out(i) and labels[i] is not None]
    assert len(got) == len(docs) and all(got[i].held_out == is_held_out(i) and got[i].predicted == (got[i].score >= 0.5) for i in got)
    assert sum(got[i].predicted == labels[i] for i in held) / len(held) >= 0.95 and {got[i].predicted for i in held} == {0, 1}
    got = {x.doc_id: x for x in QUERIES["op9_language_id"](spark, sf).collect()}
    held = [(i, lang) for i, t, lang in docs if is_held_out(i) and lang and t and any(c.isalpha() for c in t)]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) >= 0.95 and all(got[i].held_out == is_held_out(i) for i in got)
    pages = {x.page_id: x for x in table(spark, SF, "pages").collect()}
    got = QUERIES["op3_html_text"](spark, SF).collect()
    assert {x.page_id: (x.url, x.text, x.n_chars) for x in got} == {i: (p.url, t := html_text.main_text(p.html or ""), len(t)) for i, p in pages.items()}


def test_folds(spark):
    rows = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(x.h == is_held_out(x.id) for x in rows) and 70 < sum(x.h for x in rows) < 130


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda cols, rows: sorted(repr([dict(zip(cols, r))[k] for k in order]) for r in rows)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(want.columns, want.fetchall())
