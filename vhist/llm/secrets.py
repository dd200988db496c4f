"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule is a pattern. Its Boolean query over trigrams that any match must hold is derived from the parsed pattern
(`trigram_query`): literals, small classes, choices and optional parts give the strings of which a match holds one, each
string demands all its trigrams, and what follows in turn is demanded together. The index
has a posting (trigram, document key) for each trigram of the queries that a text holds, in lower case. Postings are
intersected and united under each document's key; a rule's candidates are the documents that meet its query. Candidates, and every
document for rules that demand no trigram, are verified with the pattern itself; only texts with a match leave their
task. Spans are running sums over the matches and the pieces between them, so offsets count code points of the whole text;
ends are exclusive.

Base kinds: assign, access, hex. Further kinds: github, slack, jwt, pem. Matches shorter than a
rule's least length (of its group) are dropped. Null text counts as empty: no spans. The index is keyed by
the text's two hashes and its length, not by id, so null and repeated ids need no care; equal texts share
their postings and are verified once. Extra columns are left out by the query and kept by `find_secrets`, whatever their names, but
for one called `spans`, which gives way to the result. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length in characters.
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ with 24 characters or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

#: Strings that one stretch of a pattern may stand for before they are cut there; characters that a class may stand for.
MAX_STRINGS = 16
MAX_CLASS = 8


def stretches(tree) -> list[list[str] | list[list]]:
    """What a parsed pattern demands in turn: for each stretch of it, the strings of which a match holds one. A list of lists
    is a choice whose branches demand different things each."""
    done: list = []
    now = [""]

    def cut() -> None:
        nonlocal now
        if now != [""]:
            done.append(now)
        now = [""]

    def add(strings: list[str]) -> None:
        nonlocal now
        if len(now) * len(strings) > MAX_STRINGS:
            cut()
        now = [a + b for a in now for b in strings]

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            add([chr(value)])
        elif name == "IN":
            chars = [c for kind, v in value for c in ([chr(v)] if str(kind) == "LITERAL" else map(chr, range(v[0], v[1] + 1)) if str(kind) == "RANGE" else [None])]
            add(chars) if 0 < len(chars) <= MAX_CLASS and None not in chars else cut()
        elif name == "SUBPATTERN":
            own = stretches(value[3])
            if len(own) == 1 and isinstance(own[0][0], str) and whole(value[3]):
                add(own[0])
            else:
                cut()
                done += own
        elif name == "BRANCH":
            own = [stretches(b) for b in value[1]]
            if all(len(o) == 1 and isinstance(o[0][0], str) and whole(b) for o, b in zip(own, value[1])) and sum(len(o[0]) for o in own) <= MAX_STRINGS:
                add([t for o in own for t in o[0]])
            else:
                cut()
                done.append(own)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, part = value
            if least == 0 and most == 1 and len(own := stretches(part)) == 1 and isinstance(own[0][0], str) and whole(part) and len(now) * (len(own[0]) + 1) <= MAX_STRINGS and now != [""]:
                now = [a + b for a in now for b in ["", *own[0]]]
            else:
                cut()
                if least:
                    done += stretches(part)
        elif name == "AT":
            continue
        else:
            cut()
    cut()
    return done


def whole(tree) -> bool:
    """Whether the strings of a pattern's only stretch are all that it matches."""
    for op, value in tree:
        name = str(op)
        if name == "SUBPATTERN" and whole(value[3]) or name == "BRANCH" and all(map(whole, value[1])) or name == "LITERAL":
            continue
        if name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value) and sum(1 if str(k) == "LITERAL" else v[1] - v[0] + 1 for k, v in value) <= MAX_CLASS:
            continue
        if name == "MAX_REPEAT" and value[:2] == (0, 1) and whole(value[2]):
            continue
        return False
    return True


def trigram_query(pattern: str):
    """The Boolean query over lower-case trigrams that every match of a pattern meets, as nested ("and", ...) and ("or", ...)
    of trigrams; None if the pattern demands no trigram."""

    def both(parts: list):
        flat = [x for p in parts if p is not None for x in (p[1:] if isinstance(p, tuple) and p[0] == "and" else [p])]
        parts = sorted(set(flat), key=str)
        return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)

    def either(parts: list):
        if None in parts or not parts:
            return None
        parts = sorted(set(parts), key=str)
        # A branch that another one implies adds nothing.
        grams = [set(p[1:]) if isinstance(p, tuple) and p[0] == "and" and all(isinstance(x, str) for x in p[1:]) else {p} for p in parts]
        parts = [p for p, g in zip(parts, grams) if not any(o < g for o in grams)]
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def of(found: list):
        out = []
        for part in found:
            if isinstance(part[0], str):
                out.append(either([both([t.lower()[i : i + 3] for i in range(len(t) - 2)]) for t in part]))
            else:
                out.append(either([of(branch) for branch in part]))
        return both(out)

    return of(stretches(re._parser.parse(pattern)))


def trigrams_in(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1:]))


def meets(query, held: Column) -> Column:
    """Whether an array of trigrams meets a query."""
    if isinstance(query, str):
        return F.array_contains(held, query)
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, [meets(q, held) for q in query[1:]])


def text_key(body: Column) -> Column:
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"), F.length(body).alias("n")).alias("key")


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for every trigram of the list that the lower-cased text holds."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query each indexed document meets. A document's postings, at most as many as there
    are trigrams in the rules, come together under its key; copies of a text are one key and are added up before."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if not queries:
        return index.select("key", F.array().cast("array<string>").alias("kinds")).limit(0)
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*[F.when(meets(q, F.col("held")), F.lit(kind)) for kind, q in queries.items()]))
    return held.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def pieces(text: Column, order: int, rule: Rule) -> Column:
    """array<struct<order, k, before, size, counted>>: each match's length, that of its counted group, and of the text before it."""
    p = F.lit(rule.pattern)
    whole, counted = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    zipped = F.arrays_zip(between.alias("b"), whole.alias("w"), counted.alias("c"))
    return F.transform(
        zipped,
        lambda m, k: F.struct(F.lit(order).alias("order"), k.cast("long").alias("k"), F.length(m["b"]).cast("long").alias("before"), F.length(m["w"]).cast("long").alias("size"), F.length(m["c"]).alias("counted")),
    )


NONE = "array<struct<start:int,order:int,end:int,kind:string>>"


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans) of the distinct texts that hold any."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(text_key(F.col("text")), "text")
    grams = sorted(set().union(*map(trigrams_in, queries.values())))
    # A stored table of known size: Spark sends it to all tasks while it is small, and joins by shuffles beyond that.
    hits = stored(candidates(postings(texts, grams), rules))
    some = texts.join(hits, "key").select("key", "text", "kinds")
    full = [r for r in rules if queries[r.kind] is None]
    if full:
        match = reduce(Column.__or__, [F.regexp_like("text", F.lit(r.pattern)) for r in full])
        some = some.unionByName(texts.where(match).withColumn("kinds", F.array().cast("array<string>")))
    # Copies of a text meet in each task first.
    once = some.groupBy("key").agg(F.first("text").alias("text"), F.max("kinds").alias("kinds"))
    none = F.array().cast("array<struct<order:int,k:bigint,before:bigint,size:bigint,counted:int>>")
    each = [
        F.when((F.array_contains("kinds", r.kind) if queries[r.kind] is not None else F.lit(True)) & F.regexp_like("text", F.lit(r.pattern)), pieces(F.col("text"), n, r)).otherwise(none)
        for n, r in enumerate(rules)
    ]
    found = once.select("key", F.explode(F.concat(*each)).alias("m")).select("key", "m.*")
    end = F.sum(F.col("before") + F.col("size")).over(Window.partitionBy("key", "order").orderBy("k"))
    least = reduce(lambda c, x: c.when(F.col("order") == x[0], x[1].least), enumerate(rules), F.when(F.lit(False), 0))
    kind = reduce(lambda c, x: c.when(F.col("order") == x[0], F.lit(x[1].kind)), enumerate(rules), F.when(F.lit(False), F.lit("")))
    rows = found.withColumn("end", end).where(F.col("counted") >= least)
    span = F.struct((F.col("end") - F.col("size")).cast("int").alias("start"), "order", F.col("end").cast("int").alias("end"), kind.alias("kind"))
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `spans`: array<struct<start, order, end, kind>>, sorted by start, then by the rules' order."""
    found = stored(secret_spans(docs, rules))
    own = [c for c in docs.columns if c != "spans"]
    rows = docs.select(F.struct(*own).alias("row"), text_key(F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(found, "key", "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in own], F.coalesce("spans", F.array().cast(NONE)).alias("spans"))


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda m: m["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def oracle_op10() -> str:
    parts = []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {order} AS ord, '{r.kind}' AS kind, e - w AS s, e, c FROM (
    SELECT doc_id, w, c, sum(b + w) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
      SELECT doc_id, k, length(string_split_regex(t, '{p}')[k]) AS b,
        length(regexp_extract_all(t, '{p}')[k]) AS w, length(regexp_extract_all(t, '{p}', {r.group})[k]) AS c
      FROM (SELECT doc_id, t, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k FROM d)))
  WHERE c >= {r.least}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ",\n  ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE)
    text = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({text}) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({text}) FILTER (kind IS NOT NULL), '') AS spans
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
