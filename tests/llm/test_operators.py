import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mixloom.llm import bpe, common, decontaminate, jaccard_join, line_dedup, lm_score, pitman_yor, quality, registry, repeats, token_counts, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _r1 int"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (7, "Ünï <|endoftext|> it's\n\nx  y'll " * 40), (8, "z" * 20000), (9, "日本 語 " * 50)]


def frame(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, None, f"s{k % 12}", None, 5) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA).toArrow()
    want = con.sql(registry.ORACLES[name]).to_arrow_table().select(got.column_names)
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist()))


def test_bpe_equals_the_library_and_round_trips(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rows = EDGE + texts
    out = bpe.encode(frame(spark, rows), digests=True)
    for r in out.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {(r.doc_id, r.text) for r in bpe.decode(out.drop("text")).collect()} == {(i, x or "") for i, x in rows}


def test_token_counts(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    rows = EDGE + texts + [(i + 10**6, t + " " + t) for i, t in texts[:20]] + [(6, "\0\0 \0> \x01"), (6, "日本" * 200 + "x" * 70_000)]
    out = token_counts.count_tokens(frame(spark, rows).withColumn("n_tokens", F.lit("old"))).collect()
    assert len(out) == len(rows) and token_counts.count_tokens(frame(spark, [])).count() == 0
    for r in out:
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())


def test_token_counts_of_odd_texts():
    """Control characters, marks of other scripts and special strings, in any order."""
    import random

    own, r = token_counts.Counts(public_tokenizers.path(token_counts.VOCABULARY)), random.Random(3)
    signs = ["\0", ">", "a", "B", " ", "\n", "\x01", "\x1c", "\x85", "\xa0", "é", "Ω", "日", "'s", "12", "<|endoftext|>", "<|startoftext|>", "ǅ", "İ", "ﬁ", "\u200b", "\u3000"]
    texts = ["\0>", "\0\0", *("".join(r.choice(signs) for _ in range(r.randrange(12))) for _ in range(5000))]
    want = [len(e.ids) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.count([t.encode() for t in texts]) == want


def test_label_ties_and_repeated_ids(spark):
    """Labels that disagree are left out; of several documents of one id the smallest text counts."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (3, None), (4, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (None, 1), (5, 2)], "doc_id bigint, quality int")
    got = quality.labelled_sample(docs, labels, "quality", 10).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in got) == [(1, "a", 1), (3, "d", 0), (4, None, 0)]


def test_decoder_equals_all_readings():
    """Viterbi against every path of the lattice; long tokens and chains are restored like short ones."""
    import itertools
    import random

    import numpy as np

    n = np.random.default_rng(2).random((28, 28, 28)) ** 3
    d, r = toxicity.Decoder(np.log(n / n.sum(axis=2, keepdims=True))), random.Random(5)

    def cost(letters):
        x, y, s = 0, 0, 0.0
        for c in [*letters, " "]:
            z = toxicity._code(c)
            s, x, y = s + d.logs[x][y][z], y, z
        return s

    for k in range(300):
        gaps = k % 2 > 0
        span = " ".join(r.choice("ab01|") for _ in range(4)) if gaps else "".join(r.choice("abo01|$!") for _ in range(7))
        paths = [("".join(a for a, _ in p), sum(c for _, c in p)) for p in itertools.product(*d._arcs(span, gaps))]
        best = max(c + cost(t) for t, c in paths)
        assert any(t == d.restore(span, gaps) and abs(c + cost(t) - best) < 1e-9 for t, c in paths)
        d.known.clear()


def test_edge_rows_everywhere(spark):
    d = frame(spark)
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, "..."), (None, "日本 語")], "item_id bigint, text string")
    assert line_dedup.dedup_lines(d, 2).count() == len(EDGE)
    hit = {r.doc_id: r for r in decontaminate.contamination(d, bench).collect()}
    assert hit[5].contaminated and hit[5].n_hit == 3 and hit[5]["items"] == ["1"] and hit[9].contaminated and not hit[2].contaminated and hit[1].n_words == 0
    near = jaccard_join.near_duplicates(d).collect()
    assert Counter(r.component_id for r in near)[5] == 3 and {r.n_shingles for r in near if r.doc_id in (1, 2, 3)} == {0}
    assert lm_score.score(d).count() == len(EDGE)
    assert quality.judge(d, quality.train(d, labels)).where("kept").count() <= len(EDGE)
    assert toxicity.score_texts(d, toxicity.train(d, labels)).where("score between 0 and 1").count() == len(EDGE)


def test_empty_tables(spark):
    d = frame(spark, [])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert line_dedup.dedup_lines(d).count() == 0 and decontaminate.contamination(d, bench).count() == 0
    assert decontaminate.contamination(frame(spark), bench).where("contaminated").count() == 0
    assert jaccard_join.near_duplicates(d).count() == 0 and lm_score.score(d).count() == 0
    assert quality.judge(d, quality.train(d, labels)).count() == 0 and bpe.encode(d).count() == 0
    assert toxicity.score_texts(d, toxicity.train(d, labels)).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), [0.0] * url_filter.BUCKETS, 0.0).count() == 0


def test_base_score_by_brute_force(spark, texts):
    import math

    split = {i: t.encode().lower().split() + [b"\n"] for i, t in texts}
    c = Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = registry.QUERIES["op5_lm_scoring"](spark, DATA).collect()
    for r in got:
        assert r.n_known == sum(c[w] > 0 for w in split[r.doc_id]) and r.train_tokens == n
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split[r.doc_id])) < 1e-6
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_follow_the_order_of_words(spark):
    """Texts of the same words in another order have the same base score, and the order that was learnt from scores better."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "the cat sat on a mat") for i in range(60) if i not in held] + [(held[0], "The cat sat on a mat"), (held[1], "mat a on sat cat the"), (held[2], None)]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = got[held[0]], got[held[1]]
    assert len(got) == len(rows) and a.held_out and b.held_out and got[held[2]].n_tokens == 1
    assert abs(a.base_score - b.base_score) < 1e-9 and a.n_known == b.n_known == 7 and a.score > b.score + 5 and a.score > -1


def test_scores_and_messages_do_not_depend_on_shuffle_partitions(spark, texts, monkeypatch):
    made, got, old = [], [], spark.conf.get("spark.sql.shuffle.partitions")

    def written(df, name):
        out = common.written(df, name)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(lm_score, "written", written)
    d = frame(spark, EDGE + texts[:20]).coalesce(1)
    try:
        for n in ("4", "19"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            made.append(0)
            got.append(sorted(map(repr, lm_score.score(d).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] and made[0] == made[1] < 3000
    size = sum(len((t or "").encode()) for _, t in EDGE + texts[:20])
    monkeypatch.setattr(lm_score, "PART_BYTES", size // 10)
    assert lm_score._parts(d) in (10, 11) and lm_score._parts(frame(spark, [])) == lm_score._parts(frame(spark, [(1, None)])) == lm_score.LEAST_PARTS


def test_distinct_pairs_of_words():
    import numpy as np

    rng = np.random.default_rng(2)
    for most, n in ((1, 0), (1, 1), (3, 50), (1000, 5000), (1 << 31, 5000)):  # the last does not fit 64 bits with its positions
        u, w = rng.integers(0, most, n // 2 + 1)[rng.integers(0, n // 2 + 1, n)], rng.integers(0, most, n)
        key, back = np.unique(np.stack([u, w], axis=1), axis=0, return_inverse=True)
        a, b, at = lm_score._unique(u, w)
        assert (a == key[:, 0]).all() and (b == key[:, 1]).all() and (at == back.ravel()).all()


def test_cells_of_the_speller_are_counted_by_range(spark):
    import numpy as np
    import pyarrow as pa

    words = [[b"a", b"abc", "日本".encode()], [b"abc", bytes([0, 255]), b"z" * 300], [b"q"]]
    cells = [lm_score.spelling(w)[0] for w in words]
    times = [np.arange(1, len(c) + 1) for c in cells]
    rows = [lm_score._cells(c, n) for c, n in zip(cells, times, strict=True)]
    assert all(len(r) <= lm_score.RANGES for r in rows)
    got = lm_score._used(spark.createDataFrame(pa.Table.from_batches([lm_score._batch(r) for r in rows])))
    assert (got == np.bincount(np.concatenate(cells), np.concatenate(times), len(got))).all()
    assert (np.unique(lm_score._mixed_cells(np.arange(len(got)))) == np.arange(len(got))).all()


def test_words_after_a_word_have_probability_one_in_all():
    import numpy as np

    rng = np.random.default_rng(1)
    totals = lm_score.Totals(40, 25, 0.4, 0.3)
    n, t, spelled = np.array([20, 15, 5]), np.array([12, 9, 4]), np.array([0.1, 0.15, 0.05])
    words = np.append(totals.words(n, t, spelled), totals.unseen())
    assert abs(words.sum() - 1) < 1e-12
    pair, seats = np.array([7, 1, 3]), np.array([4, 1, 2])
    step = lm_score.Step(np.arange(4), np.zeros(4, np.int64), np.array([1, 2, 3, 0]), None, None, None, np.array([0, 1, 2, -1]), None, None, None)
    draws = [(np.array([seats.sum(), 0, 0, 0]), words, seats), (np.array([5, 0, 0, 0]), words, np.array([3, 1, 1]))]
    got = lm_score.predictive(step, np.array([pair.sum(), 0, 0, 0]), pair, iter(draws), 0.6)
    assert abs((10**got).sum() - 1) < 1e-12
    for most in (1, 255, 256, 1 << 40):
        x = rng.integers(0, most + 1, 1000)
        assert (lm_score.unpack(lm_score.pack(x)) == x).all()


def test_flat_seating_law():
    """With one weight for every new table: draws have the mean of the law, whatever the size of the dish."""
    import numpy as np

    exact = pitman_yor.log_stirling(0.6, 400)
    for c in (5, 60, 400):
        for a, p in ((50.0, 0.02), (3.0, 0.001)):
            t = np.arange(1, c + 1)
            w = exact[c, 1 : c + 1] + t * np.log(a * p)
            w = np.exp(w - w.max())
            w /= w.sum()
            mean, sd = float(w @ t), float(np.sqrt(max(0.0, w @ (t * t) - (w @ t) ** 2)))
            x = pitman_yor.draw_tables(np.full(4000, c), np.full(4000, a), np.full(4000, p), 0.6, np.arange(4000, dtype=np.uint64), flat=True)
            assert abs(x.mean() - mean) < 4 * sd / 4000**0.5 + 1e-3


def test_seating_law_against_the_recursion():
    """Small and large dishes alike: draws have the mean and spread of the law, and its weights agree point by point."""
    import numpy as np

    for d in (0.05, 0.5, 0.9):
        exact = pitman_yor.log_stirling(d, 1000)
        for c in (48, 60, 130, 1000):
            for a, p in ((1e5, 1e-4), (1e3, 1e-3), (1.0, 0.5), (1e6, 0.01)):
                t = np.arange(1, c + 1)
                w = exact[c, 1 : c + 1] + np.cumsum(np.log(a + d * np.arange(c)) + np.log(p))
                w = np.exp(w - w.max())
                w /= w.sum()
                mean = float(w @ t)
                sd = float(np.sqrt(max(0.0, w @ (t * t) - mean**2)))
                if c > pitman_yor.EXACT:
                    q = pitman_yor.log_weights(np.array([c]), t[None, :], np.array([a]), np.array([p]), d)[0]
                    q = np.exp(q - q.max())
                    assert abs(q / q.sum() - w).sum() < 0.02
                x = pitman_yor.draw_tables(np.full(4000, c), np.full(4000, a), np.full(4000, p), d, np.arange(4000, dtype=np.uint64))
                assert abs(x.mean() - mean) < 4 * sd / 4000**0.5 + 1e-3 and abs(x.std() - sd) < 0.08 * sd + 0.05


def test_quality_signals_by_brute_force(texts):
    rows = texts + [(0, x or "") for _, x in EDGE]
    got = quality.signals([t.encode() for _, t in rows])
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {i + j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert tuple(int(got[x][k]) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_near_copies_of_one_passage(spark):
    import random

    r = random.Random(4)
    base = [f"w{r.randrange(9999)}" for _ in range(150)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(150)] = f"v{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                lo, hi = sorted((label[a], label[b]))
                label = [lo if x == hi else x for x in label]
    assert {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(frame(spark, rows)).collect()} == dict(enumerate(label))


def test_unlinked_texts_around_one_boilerplate_text(spark):
    """Two linked texts stand in a long list without any other link, and the smaller node of the two stands for it."""
    import random

    r = random.Random(6)
    shared = [f"w{r.randrange(10**6)}" for _ in range(94)]  # 90 shingles

    def text(own):
        return " ".join([*shared, *(f"v{r.randrange(10**9)}" for _ in range(own))])

    def node(t):
        return jaccard_join.signature(jaccard_join.shingle_sets([t.encode()])[0])

    a, b = sorted((text(10) for _ in range(2)), key=node)
    others = [t for t in (text(14) for _ in range(4000)) if node(t) > node(a)][:60]
    assert len(others) == 60
    rows = list(enumerate([b, *others, a]))
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: 0 if i == 61 else i for i, _ in rows}


def test_urls(spark):
    rows = ["https://WWW.Example.com/en/1?x", "http://example.com/en/", "ftp://a.b.net/es/#t", "http://x.com", None, "nothing", "http://x.com/y", "http://casino-win.example.org/en/1", "http://garden-club.example.org/en/1"]
    w, b = url_filter.train(url_filter.labelled_urls(spark))
    got = [tuple(r)[1:] for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string"), w, b).drop("score", "url").orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[2][2:] == ("net/es/", "block") and got[3][2] is None and got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6][2:] == ("com/", "allow") and got[7][3] == "block" and got[8][3] == "allow"


def test_url_labels_held_out(spark):
    """Trained on most host words, the filter knows those hosts with other fronts and paths, and spares ordinary ones."""
    rows = url_filter.labelled_urls(spark).withColumn("h", F.pmod(F.xxhash64("url"), F.lit(4)))
    w, b = url_filter.train(rows.where("h > 0"))
    got = url_filter.judge(rows.where("h = 0").withColumnRenamed("label", "page_id"), w, b).where("rule is null").groupBy("page_id", "verdict").count().collect()
    n = {(r.page_id, r.verdict): r["count"] for r in got}
    assert n[1, "block"] >= 0.9 * (n[1, "block"] + n.get((1, "allow"), 0)) and n[0, "allow"] >= 0.95 * (n[0, "allow"] + n.get((0, "block"), 0))


def test_urls_by_brute_force(spark):
    """Host, path and rule of every page and of odd URLs, by plain Python."""
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    odd = ["://", "a://", "x://H?y://z", "x://a.com", "x://A.COM/en/", "://www.example.com/en/#", "x://.net/es/", "x://net/es", "x://n.net/es/?", "x://example.com/en", "http:/a.com/", "", None, "x://b\n.com/\n?q"]
    rows = pages + pages[:3] + [(-k, u) for k, u in enumerate(odd)]
    weights, bias = [0.0] * url_filter.BUCKETS, -1.0

    def said(u):
        rest = (u or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path, host = re.split("[?#]", rest[len(host) :])[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
        return host, path, rule, verdict

    got = url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), weights, bias).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *said(u)) for i, u in rows)


def test_toxicity_held_out_and_disguises(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_texts(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
    r = out.groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in r}
    assert n.get((0, 0), 0) >= 0.97 * (n.get((0, 0), 0) + n.get((0, 1), 0)) and n.get((1, 1), 0) >= 0.6 * (n.get((1, 0), 0) + n.get((1, 1), 0))
    d = toxicity.Decoder(toxicity.character_model(docs))
    assert "idiot" in d.readings("well,you.are.such.an.absolutely.complete.1d10t") and "idiot" in d.readings("x" * 50_000 + "-1d10t-" + "y" * 50_000)
    assert "idiot" in d.readings("an 1d10t") and "scum" in d.readings("s.c.u.m") and "moron" in d.readings("moooooron")


def test_pipeline_run(spark, tmp_path):
    """Whole tables, empty ones, and a table with nulls and repeated rows; what a stage drops stays dropped."""
    import corpus_pipeline

    docs, bench, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    got = corpus_pipeline.run(spark, DATA)
    assert 0 < got.count() < docs.count() and got.select("doc_id").distinct().count() == got.count()
    near = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert len({near[r.doc_id] for r in got.collect()}) == got.count()
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "one two three four five six", None, None, 9), (3, "one two three four five six", None, None, 9), (4, "one two three four five six", "en", "s", 9), (3, "seven eight nine ten eleven twelve", "en", "s", 9)], docs.schema)
    for where, d in (("none", docs.limit(0)), ("odd", odd)):
        for name, t in (("documents", d), ("benchmark", bench.limit(0)), ("labels", labels.limit(0))):
            t.write.parquet(f"{tmp_path}/{where}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    left = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens > 0) for r in left) == [(False, 1, False), (False, 2, False), (False, 3, True), (False, 3, True), (True, 0, False)]


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_by_brute_force(spark, texts):
    import random

    r = random.Random(1)
    rows = list(texts)
    for i in range(60):
        parts = [t[(a := r.randrange(max(1, len(t)))) : a + r.randrange(300)] for _, t in r.sample(texts, 4)]
        rows.append((100_000 + r.randrange(10**6), r.choice(["", "x"]) .join(parts)))
    rows += [(5_000_000, "ab" * 300), (5_000_001, "z" * 1000), (5_000_002, "q" * 99), (5_000_003, ""), (5_000_004, "xy" + "ab" * 80)]
    got = sorted(tuple(x) for x in repeats.remove_repeats(frame(spark, rows), texts=False).collect())
    assert got == brute_repeats(rows)
    assert repeats.remove_repeats(frame(spark)).count() == len(EDGE) and repeats.remove_repeats(frame(spark, [])).count() == 0


def test_sketches_lose_no_link():
    r = np.random.default_rng(4)
    for n in (1, 4, 5, 63, 64, 65, 300, 1500):
        for apart in (0, 1, n // 9, n // 8, n // 4, n):
            x = r.integers(0, 2**63, n, np.uint64)
            y = np.concatenate([x[: max(1, n - apart)], r.integers(0, 2**63, r.integers(0, apart + 1), np.uint64)])
            inter = len(np.intersect1d(x, y))
            may = jaccard_join._may_link(*(jaccard_join._parities(jaccard_join.sketch(s)) for s in (x, y)))
            assert may or not jaccard_join.linked(inter, len(x), len(y))
    x, y = (r.integers(0, 2**63, n, np.uint64) for n in (1000, 1100))
    assert not jaccard_join._may_link(*(jaccard_join._parities(jaccard_join.sketch(s)) for s in (x, y)))


def test_near_duplicates_leave_no_scratch_tables(spark, docs):
    before = set(common._TABLES)
    jaccard_join.near_duplicates(docs)
    assert {p.split("mixloom-")[-1].split("-")[0] for p in set(common._TABLES) - before} == {"scanned", "links", "edges", "least", "named", "components"}
