"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import gzip
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitewise.llm import (catalog, common, language_id, licences, mixing, near_dup, packing, quality_rules, shard_table, syncmers, token_scan, warc, word_ids)

WORDS = "the quick brown fox jumps over a lazy dog while seven small ships sail slowly past old grey walls toward open sea".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{'abcdefghij'[j]}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 10, n)))


LONG = prose(60_000, 1)
ROWS = [
    (1, prose(80, 2), "en", "a", 1), (2, prose(80, 2), "en", "a", 1), (2, prose(80, 2), "en", "a", 1), (3, prose(80, 2) + " more", "en", "b", 1),
    (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \n\t ", "fr", "b", 4), (7, LONG, "en", "hot", len(LONG)), (8, "word", "en", "a", 4),
    (9, "12 34 !!", None, "a", 8), (10, prose(40, 3), None, None, 1), (None, prose(50, 4), "en", "a", 1), (11, "ähnlich ß 日本", "de", "b", 1),
]
CLASH = ["_row", "n_words", "kept", "_copy", "_order", "_n", "_rate", "_language", "shard", "slot", "_words", "rejected", "pid", "_key_0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with odd rows and with columns named like the operators' own."""
    path = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(2)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 0), (2, None, None), (99, 1, 0), (None, 1, 0), (3, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a/\r\nX: y", "p" * 1000), (2, None, "p" * 1000), (2, None, "p" * 1000), (3, "u", "p" * 999), (4, "u", "p" * 999), (5, "", None), (6, "ü", ""), (None, "u", "p" * 1000), (7, "u", "ß" * 90_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, prose(30, 9)), (1, prose(30, 9)), (None, None), (2, "")], "item_id long, text string").withColumn("bucket", F.lit(1)) \
        .write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_every_query_takes_odd_rows_and_empty_tables(spark, folder, empty, name):
    rows = catalog.queries()[name](spark, folder).collect()
    assert catalog.queries()[name](spark, empty).collect() == []
    if name.startswith(("op1_", "op2_", "op3_", "op4_", "op7_", "op8_", "op9_", "op11_", "op12_", "op13_")):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


def test_pipeline_takes_odd_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "pack" or docs.columns == columns
        kept[name] = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert kept["quality"] == ["1", "10", "2", "2", "3", "7", "None"]
    assert kept["language"] == kept["quality"] and kept["near_duplicates"] == ["1", "10", "7", "None"]
    assert set(kept["mix"]) <= set(kept["near_duplicates"]) and set(kept["pack"]) == set(kept["mix"])


def test_pipeline_takes_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_quality_counts(spark):
    text = "a b c d e f\na b c d e\n\n \nx y #*\na b c d e\r"
    row = quality_rules.with_metrics(spark.createDataFrame([(text,), (None,)], "text string"), "text").orderBy("text").collect()
    assert row[0].asDict() == {"text": None, **{c: 0 for c in [*quality_rules.BASE, "n_upper", "n_lines"]}}
    got = row[1]
    assert (got.n_words, got.n_symbols, got.n_dup_lines, got.n_lines, got.word_chars) == (18, 2, 0, 4, sum(map(len, text.split(" "))) - text.count("\n") - text.count("\r"))
    assert got.n_repeat_words == 15


def test_binomial_tail_and_fixed_sequence(spark):
    from math import comb
    for k, n in [(0, 10), (3, 400), (50, 4000), (9, 900)]:
        p = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.02)).first()[0]
        want = sum(comb(n, j) * 0.02**j * 0.98**(n - j) for j in range(k + 1))
        assert p == pytest.approx(want, rel=1e-9)
    good = [("en", True, 0.0)] * 3000 + [("en", False, 0.3)] * 50 + [("fr", True, 0.0)] * 20 + [("fr", False, 0.9)]
    df = spark.createDataFrame(good, "lang string, good boolean, symbol_share double").withColumns({r: F.lit(0.0) for r in quality_rules.SHARES if r != "symbol_share"})
    report = quality_rules.safe_cutoffs(df, "lang", quality_rules.RuleParams())
    cut = {r["lang"]: r["symbol_share_cutoff"] for r in quality_rules.chosen_cutoffs(report, "lang").collect()}
    assert cut == {"en": 0.2, "fr": None}


def test_poisson_counts_by_inversion(spark):
    import math
    rows = spark.range(2000).select("id", mixing.hashed_uniform("s", F.col("id")).alias("u")).select("id", "u", *[mixing.poisson_count(F.lit(r), F.col("u")).alias(f"n{i}") for i, r in enumerate((0.0, 0.3, 7.5))]).collect()
    for r in rows[:300]:
        for i, rate in enumerate((0.3, 7.5), 1):
            k, upto = 0, math.exp(-rate)
            while upto <= r["u"]:
                k += 1
                upto += math.exp(-rate) * rate**k / math.factorial(k)
            assert r[f"n{i}"] == k
        assert r["n0"] == 0
    assert abs(sum(r["n2"] for r in rows) / 2000 - 7.5) < 0.3


def test_poisson_counts_at_large_rates(spark):
    rates = (499.9, 500.1, 1700.0)
    rows = spark.range(3000).select(mixing.hashed_uniform("s", F.col("id")).alias("u")).select(*[mixing.poisson_count(F.lit(r), F.col("u")).alias(f"n{i}") for i, r in enumerate(rates)]).collect()
    for i, rate in enumerate(rates):
        drawn = np.array([r[f"n{i}"] for r in rows])
        assert abs(drawn.mean() - rate) < 5 * (rate / 3000) ** 0.5
        assert abs(drawn.var() / rate - 1) < 5 * (2 / 3000) ** 0.5


def test_mix_repeats_a_one_document_source_beside_a_large_one(spark):
    docs = spark.createDataFrame([(1, "ab", None)] + [(i, "x" * 1000, "large") for i in range(2, 1002)], "doc_id long, text string, source string")
    mass = mixing.source_mass(docs)
    rates = mixing.repetition_rates(mass, mixing.tempered_targets(mass))
    rate = {r["source"]: r["rate"] for r in rates.collect()}[None]
    assert rate > 700
    copies = [r["_copy"] for r in mixing.mix(docs, rates).where("doc_id = 1").collect()]
    assert sorted(copies) == list(range(1, len(copies) + 1)) and abs(len(copies) - rate) < 6 * rate ** 0.5


def test_mix_reaches_target_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3600, "big").otherwise("small").alias("source"), F.lit("x" * 10).alias("text"))
    mass = mixing.source_mass(docs)
    out = mixing.mix(docs, mixing.repetition_rates(mass, spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")))
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    assert out.groupBy("doc_id", "_copy").count().where("count > 1").isEmpty()
    keys = [r["_order"] for r in out.collect()]
    assert keys == sorted(keys)


def test_shards_move_little_and_weights_count():
    shards = [f"s{i}" for i in range(20)]
    table = shard_table.fill_table(shards, 65_537)
    assert np.ptp(np.bincount(table)) <= 1
    less = shard_table.fill_table(shards[:-1], 65_537)
    assert (table != less).mean() < 0.15
    double = np.bincount(shard_table.fill_table(shards, 65_537, {"s0": 2}))
    assert double[0] == pytest.approx(2 * double[1], rel=0.01)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shard_table.fill_table(bad)
    with pytest.raises(ValueError):
        shard_table.fill_table(shards, 100)


def test_hot_key_is_spread(spark):
    docs = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    shards = [f"s{i}" for i in range(8)]
    placed = shard_table.place(docs, "k", shards, shard_table.fill_table(shards, 1009), {"hot": 64}, "id")
    assert placed.where("k = 'hot'").select("shard").distinct().count() == 8


def test_near_duplicates_across_boundaries(spark):
    params = near_dup.NearDupParams(words=2, rows_per_part=40)
    texts = [prose(60, 10 + i // 3) + f" x{i % 3}" for i in range(90)] + ["same words here now"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, sets = list(range(len(texts))), [set(zip(t.split(), t.split()[1:])) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    got = near_dup.near_duplicates(docs, params).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}


def test_near_duplicates_link_a_fringe_to_one_member_of_a_large_group(spark):
    """3,000 texts of which most pairs reach 0.8, and 24 that reach it with one of them alone, by no word of their own."""
    rng = np.random.default_rng(11)
    texts = [[f"w{i}" for i in range(100) if i not in gone] for _ in range(3000) for gone in [set(rng.choice(100, 8, False))]]
    for m in range(0, 3000, 125):
        gone = set(rng.choice(92, 10, False))
        texts.append([f"f{m}w{i}" if i in gone else w for i, w in enumerate(texts[m])])
    sets = [set(t) for t in texts]
    assert [sum(10 * len(s & t) >= 8 * len(s | t) for t in sets[:3000]) for s in sets[3000:]] == [1] * 24
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(docs, near_dup.NearDupParams(words=1)).collect()
    assert len(got) == len(texts) and {r["component_id"] for r in got} == {0}


def test_near_duplicates_in_a_region_without_links_stay_apart(spark):
    rng, base = np.random.default_rng(12), [f"w{i}" for i in range(100)]
    texts = [" ".join(f"v{m}w{i}" if i in gone else w for i, w in enumerate(base)) for m in range(300) for gone in [set(rng.choice(100, 8, False))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, group = [set(t.split()) for t in texts], list(range(300))
    for i in range(300):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, near_dup.NearDupParams(words=1)).collect()}
    assert got == dict(enumerate(group))


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(5)
    ids = rng.integers(1, 50, 5000).astype("<u2")
    ids[rng.integers(0, 5000, 120)] = 0
    ids[2000:3500] = 7
    (tmp_path / "a.ids").write_bytes(ids.tobytes())
    (tmp_path / "b.ids").write_bytes(np.array([0, 0, 5, 0], "<u2").tobytes())
    (tmp_path / "c.ids").write_bytes(b"")
    files = token_scan.list_token_files(spark, str(tmp_path))
    out = token_scan.scan(files, str(tmp_path), 0, block_ids=64).orderBy("file", "ordinal").collect()
    ends = np.flatnonzero(ids == 0)
    want = np.diff(np.concatenate(([-1], ends, [5000]))) - 1
    mine = [r for r in out if r["file"] == "a.ids"]
    assert [r["n_tokens"] for r in mine] == want[:len(mine)].tolist() and [r["ordinal"] for r in mine] == list(range(len(mine)))
    assert [r["ended"] for r in mine] == [True] * len(ends) + [False] * (len(mine) - len(ends))
    assert [r["n_tokens"] for r in out if r["file"] == "b.ids"] == [0, 0, 1]
    (tmp_path / "d.ids").write_bytes(b"abc")
    with pytest.raises(Exception, match="broken length"):
        token_scan.scan(token_scan.list_token_files(spark, str(tmp_path)), str(tmp_path), 0).collect()


def test_language_rejects_by_distance():
    import pandas as pd
    params = language_id.LanguageParams(sample=30, clusters=2)
    texts = [("xx", "abc abd abe " * (5 + i % 7)) for i in range(30)] + [("yy", "öäü zxw qpk " * (5 + i % 5)) for i in range(30)]
    sparse = language_id._sparse(pd.Series([t for _, t in texts]), params.dims)
    model = language_id.fit_vectors(sparse.assign(lang=[lang for lang, _ in texts]), params)
    out = language_id.predict(pd.Series(["ABC abd", "zxw öäü qpk", "", None, "123 !?", "mnmn rtrt vuvu " * 6]), model)
    assert out["lang_pred"].tolist()[:5] == ["xx", "yy", "und", "und", "und"] and out["rejected"].tolist() == [False, False, True, True, True, True]
    assert (language_id.gram_counts(LONG, 64) == language_id.gram_counts("  " + LONG + " ", 64)).all()
    whole, language_id.SLICE = language_id.gram_counts(LONG, 64).sum(), 1000
    try:
        assert abs(language_id.gram_counts(LONG, 64).sum() - whole) < whole * 0.02
    finally:
        language_id.SLICE = 1 << 20


def test_licences_by_size():
    scan = licences.Templates(licences.TEMPLATES, licences.LEAST)
    for name, text in licences.TEMPLATES.items():
        assert (1.0, name) in scan.matches(text.upper())
    assert scan.matches("") == [] and scan.matches("mit") == [] and scan.matches(prose(30, 8)) == []


def test_fingerprint_slices_agree():
    params, text = syncmers.SyncmerParams(), LONG[:50_000]
    whole, syncmers.SLICE = syncmers.fingerprint(text, params), 777
    try:
        assert syncmers.fingerprint(text, params) == whole
    finally:
        syncmers.SLICE = 1 << 18
    a = syncmers.read(whole)
    assert syncmers.likeness(a, a, params) == 1.0 and syncmers.fingerprint(None) == "" and syncmers.likeness(syncmers.read(""), a, params) == 0.0


def test_neighbours_across_runs(spark):
    rows = [(i, f"{prose(20, i)} {i}") for i in range(40)] + [(7, None), (None, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {(r["doc_id"], r["n_chars"]): r for r in syncmers.fingerprints_with_neighbours(docs, run_rows=3).collect()}
    one = {(r["doc_id"], r["n_chars"]): r for r in syncmers.fingerprints_with_neighbours(docs, run_rows=1000).collect()}
    assert few == one and len(one) == len(rows)


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers
    ids = word_ids.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", "Don't STOP's 12.5  x", "é́ é", "ÀÉß ß'LL", "<|endoftext|> hi", "a b", "日本 語", "İstanbul", "x'!s''t 'S", "½²", "ªº", "\x1c a", LONG[:3000]]
    assert [x == ids.whole(t) for t, x in zip(odd, ids.many(odd))] == [True] * len(odd)


def test_packing_of_many_equal_and_tiny_pieces(spark):
    params = packing.PackParams(capacity=64, rows_per_part=50)
    lengths = [64] * 3 + [1] * 200 + [22] * 100 + [40] * 30 + [33] * 20
    cut = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE)
    out = packing.pack(cut, params).toPandas().sort_values(["sequence_id", "offset"])
    seq = out.groupby("sequence_id")
    assert len(out) == len(lengths) and seq["length"].sum().max() <= 64
    assert ((seq["length"].cumsum() - out["length"]) == out["offset"]).all()
    assert seq.ngroups <= 3 + 30 + 20 + 50 + 5


def test_warc_archives_are_checked(spark, tmp_path):
    params = warc.WarcParams(archive_bytes=1500)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{prose(200, i % 3)}") for i in range(9)], "page_id long, url string, html string").coalesce(1)
    written = warc.write_archives(pages, str(tmp_path), params)
    assert written.count() > 1 and written.agg(F.sum("records")).first()[0] == 9
    listed = warc.list_archives(spark, str(tmp_path))
    assert listed.count() == written.count()
    out = {r["page_id"]: r for r in warc.read_archives(listed, str(tmp_path), with_payload=True).collect()}
    assert {i for i, r in out.items() if r["record_type"] == "response"} == {6, 7, 8} and out[0]["refers_to"] == 6
    assert out[6]["payload"].decode() == f"<p>{prose(200, 0)}" and out[0]["payload_bytes"] == len(out[6]["payload"]) and out[3]["url"] == "http://x/3"
    data = (tmp_path / "part-000000-0000.warc.gz").read_bytes()
    plain = gzip.decompress(data)
    assert len(list(warc.records(io.BytesIO(data)))) == plain.count(b"WARC/1.1\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data[:-20])))
    record = warc.page_record(1, "u", b"payload", None, params)
    text = zlib.decompress(record, 31)
    for broken in (text.replace(b"payload\r\n", b"paYload\r\n"), text.replace(b"payload\r\n", b"payloads\r\n"), text.replace(b"WARC/1.1", b"WERC/1.1")):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(gzip.compress(broken))))


def test_lookup_join_with_null_keys(spark, monkeypatch):
    big = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    small = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    want = [("a", 1, 10), (None, 2, 20), ("z", 3, None)]
    for most in (100, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, common.lookup_join(big, small, ["k"]).collect()), key=str) == sorted(want, key=str)
