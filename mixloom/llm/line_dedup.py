"""Operator 1: cross-site boilerplate lines, by HyperLogLog sketches of the sites of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.llm.common import BLANKS, counted, row_keys, small, table, written

MIN_SITES = 10
LG_K = 9


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that has more than white space: its 128-bit hash, site, place."""
    rows = docs.where("text is not null").select("doc_id", "source", *row_keys("doc_id", "text"), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    rows = rows.where(F.btrim("_line", F.lit(BLANKS)) != "")
    return rows.select("doc_id", "source", "_r1", "_r2", "_pos", F.xxhash64("_line").alias("_k1"), F.xxhash64(F.lit(1), "_line").alias("_k2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines (_k1, _k2) seen on min_sites sites or more, each with _first, the place that keeps it.

    One aggregation merges the sketches of a line hash; Spark combines them map-side, so a line in a third of
    all documents sends one row per task. Estimates far from min_sites decide by themselves; lines near it are
    counted exactly over their distinct (line, site) pairs.
    """
    lines = _lines(docs)
    margin = max(2.0, 0.25 * min_sites)
    seen = lines.groupBy("_k1", "_k2").agg(F.hll_sketch_agg(F.concat(F.lit("s"), "source"), F.lit(LG_K)).alias("_s"), F.min(F.struct("doc_id", "_r1", "_r2", "_pos")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    seen = seen.where(F.col("_n") >= min_sites).withColumn("_est", F.hll_sketch_estimate("_s")).where(F.col("_est") >= min_sites - margin)
    seen = written(seen.select("_k1", "_k2", "_first", (F.col("_est") > min_sites + margin).alias("_sure")), "lines")
    near = seen.where(~F.col("_sure")).select("_k1", "_k2")
    exact = lines.select("_k1", "_k2", "source").where("source is not null").join(near, ["_k1", "_k2"], "left_semi").distinct().groupBy("_k1", "_k2").count().where(F.col("count") >= min_sites).select("_k1", "_k2")
    sure = seen.where("_sure").select("_k1", "_k2")
    return seen.join(sure.unionAll(exact), ["_k1", "_k2"], "left_semi").select("_k1", "_k2", "_first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the boilerplate lines taken out of text, n_chars made anew if it is there, and _n_removed.

    A line is boilerplate if the same line stands on min_sites sites (sources) or more; its first place (smallest
    doc_id, then line) keeps it, all others lose it. Lines of white space are never touched. A null source is no
    site. A null text stays null and an empty one empty; a document that loses every line stays, with an empty text.
    Rows that agree in doc_id and text count as one place and get the same result. No documents: no rows.
    """
    found = _lines(docs).join(boilerplate(docs, min_sites), ["_k1", "_k2"])
    found = found.where(~((F.col("_r1") == F.col("_first._r1")) & (F.col("_r2") == F.col("_first._r2")) & (F.col("_pos") == F.col("_first._pos"))))
    found = written(found.groupBy("_r1", "_r2").agg(F.collect_set("_pos").alias("_gone")), "gone")
    found = small(found, counted(found, "_gone"))  # else the texts are shuffled to meet it
    out = docs.select(F.struct(*docs.columns).alias("_row"), *row_keys("doc_id", "text")).join(found, ["_r1", "_r2"], "left")
    text, gone = F.col("_row.text"), F.col("_gone").isNotNull()
    kept = F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone")), lambda i: ls[i]), "\n"))[0]
    out = out.select("_row", "_gone", F.when(gone, kept).otherwise(text).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(gone, F.char_length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    cols = [new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c != "_n_removed"]
    return out.select(*cols, F.when(gone, F.size("_gone")).otherwise(0).cast("long").alias("_n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    left = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")
    return out.select("doc_id", (F.coalesce(F.when(F.col("text").isNull(), F.lit(0)).otherwise(left), F.lit(0)) + F.col("_n_removed")).alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
m as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' as blank from l),
b as (select line, min(row(doc_id, pos)) as first from m where not blank group by line having count(distinct source) >= {MIN_SITES}),
k as (select m.*, b.line is not null and row(m.doc_id, m.pos) <> b.first as gone from m left join b on m.line = b.line and not m.blank),
d as (select doc_id, count(*) filter (not blank) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from k group by doc_id)
select documents.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when text is not null then sha256(kept) end as kept_sha256 from documents left join d using (doc_id)
"""
