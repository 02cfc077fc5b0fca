"""Operator 4: benchmark decontamination by winnowed word k-grams, on DataFrame functions only.

Documents and items select fingerprints by the same rule: of each six consecutive 5-gram hashes the smallest. So any
10 words that both have, also share the fingerprint of that window; joining fingerprints loses no shared window. Hits
are then extended to the 10 words around and compared as words, so no hash decides the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.common import ascii_lower, counted, row_keys, small, table, written

WINDOW, K = 10, 5


def words(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(c), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def n_words(c: Column) -> Column:
    """How many words a text has (null: none); case doesn't matter for that."""
    found = F.array_remove(F.split(c, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    return F.coalesce(F.when(c.isNotNull(), F.size(found)), F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, not once for each reference in a lambda."""
    return F.transform(F.array(value), body)[0]


def _runs(ws: Column, length: int, k: int) -> Column:
    """The selected fingerprints f of all windows of so many words, with the range lo..hi of the windows' starts."""

    def of(h):
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(F.lit(length), *(h[i + j] for j in range(k))))
        return _let(grams, lambda g: _let(F.transform(F.sequence(F.lit(0), F.size(g) - (length - k + 1)), lambda i: F.least(*(g[i + j] for j in range(length - k + 1))) if length > k else g[i]), spans))

    def spans(m):
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (m[i] != F.get(m, i - 1)))
        return _let(starts, lambda s: F.transform(s, lambda lo, j: F.struct(m[lo].alias("f"), lo.alias("lo"), F.coalesce(F.get(s, j + 1) - 1, F.size(m) - 1).alias("hi"))))

    none = F.array().cast("array<struct<f:bigint,lo:int,hi:int>>")
    return _let(ws, lambda w: F.when(F.size(w) >= length, _let(F.transform(w, lambda x: F.xxhash64(x)), of)).otherwise(none))


def _window(w: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(w, start + 1, length), " ")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document with a hit: _r1, _r2 (of doc_id and text), _covered (places of hit words), _items."""
    items = benchmark.where("text is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    items = written(items, "items")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most WINDOW values
    windows = items.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: _window(F.col("w"), i, F.col("n")))).alias("key"))
    windows = written(windows.distinct(), "windows")
    size = counted(windows, "key")
    out = None
    for length in lengths:
        k = min(K, length) if length == WINDOW else length
        prints = items.where(F.col("n") == length).select(F.explode(_runs(F.col("w"), length, k)).alias("x")).select("x.f").distinct()
        found = docs.where("text is not null").select(*row_keys("doc_id", "text"), F.explode(_runs(words(F.col("text")), length, k)).alias("x")).select("_r1", "_r2", "x.*")
        # there are no more prints than windows
        found = found.join(small(prints, size), "f", "left_semi").select("_r1", "_r2", F.struct(F.lit(length).alias("n"), "lo", "hi").alias("x"))
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "_r1 bigint, _r2 bigint, _covered bigint, _items array<string>")
    out = written(out.groupBy("_r1", "_r2").agg(F.collect_set("x").alias("x")), "candidates")
    # the few candidates go to the texts as long as they are small; else both meet by key
    texts = docs.where("text is not null").select(*row_keys("doc_id", "text"), "text").join(small(out, counted(out, "x")), ["_r1", "_r2"])
    texts = texts.select("_r1", "_r2", words(F.col("text")).alias("w"), "x")
    cand = texts.withColumn("c", _let(F.col("w"), lambda w: F.flatten(F.transform(F.col("x"), lambda r: F.transform(F.sequence(r["lo"], r["hi"]), lambda i: F.struct(r["n"].alias("n"), i.alias("at"), _window(w, i, r["n"]).alias("key")))))))
    cand = cand.select("_r1", "_r2", F.explode("c").alias("c")).select("_r1", "_r2", "c.*")
    true = written(cand.join(small(windows.select("n", "key").distinct(), size), ["n", "key"], "left_semi").distinct(), "hits")
    covered = true.groupBy("_r1", "_r2").agg(F.collect_set(F.struct("at", "n")).alias("s")).select("_r1", "_r2", F.size(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))).cast("long").alias("_covered"))
    which = true.select("_r1", "_r2", "n", "key").distinct().join(small(windows, size), ["n", "key"]).groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    found = written(covered.join(which, ["_r1", "_r2"]), "contaminated")
    return small(found, counted(found, "_items", 96))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, items (sorted item ids as strings) and contaminated.

    A null or empty text has no words and no hits; a benchmark item without words is never found; a null item_id is
    left out of items though its words hit. Repeated rows each get their result; an empty benchmark hits nothing.
    """
    found = hits(docs, benchmark)
    out = docs.select(F.struct(*docs.columns).alias("_row"), *row_keys("doc_id", "text"), n_words(F.col("text")).alias("_n_words")).join(found, ["_r1", "_r2"], "left")
    new = [F.col("_n_words").alias("n_words"), F.coalesce("_covered", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"), F.col("_covered").isNotNull().alias("contaminated")]
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")), *new)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, as they are."""
    found = hits(docs, benchmark).select("_r1", "_r2")  # keeps its broadcast hint
    return docs.select(F.struct(*docs.columns).alias("_row"), *row_keys("doc_id", "text")).join(found, ["_r1", "_r2"], "left_anti").select("_row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    out = docs.select("doc_id", *row_keys("doc_id", "text"), n_words(F.col("text")).alias("n_words"))
    out = out.join(found, ["_r1", "_r2"], "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", F.coalesce("_covered", F.lit(0).cast("long")).alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), F.col("_covered").isNotNull().alias("contaminated"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE = f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
b as (select item_id, {_WORDS.format("text")} as w from benchmark where text is not null),
bw as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(0, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 10)], ' '))) as key from b where len(w) > 0),
ns as (select distinct n from bw),
dw as (select doc_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda i: {{'p0': i, 'key': array_to_string(w[i + 1 : i + n], ' ')}})) as x from d, ns where len(w) >= n),
h as (select dw.doc_id, dw.n, dw.x.p0 as p0, bw.item_id from dw join bw on dw.n = bw.n and dw.x.key = bw.key),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(p0, p0 + n)) as p from (select distinct doc_id, n, p0 from h)) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id)
select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""
