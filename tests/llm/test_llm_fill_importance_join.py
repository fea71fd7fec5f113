"""Fill-in-the-middle, importance resampling and the token-group join against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import fill_middle, importance, token_groups
from sitewise.llm.shingles import shingle_sets

LINES = ["", "one", "one\n", "\n\n\n", "ä\nß€\n\n😀 end", "x" * 3000 + "\n" + "y" * 50, "<P> inside\nof it", "a<S\n>b\n", "<", "ends with <\n<\n", "\n".join("línea %d" % i for i in range(500))]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 4096])
def test_cuts_at_every_unit(block):
    for text in LINES:
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        tree = fill_middle.UnitTree(text.encode(), block)
        assert tree.n == len(units)
        for k in range(0, len(units) + 1, max(1, len(units) // 60)):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def plain_fim(doc_id, text, seed=7, percent=100):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text or ""
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_the_middle_and_back(spark):
    rows = [(i, t) for i, t in enumerate([*LINES, *LINES, *LINES, None])] + [(None, "p\nq\nr"), (3, "again\nand\nagain"), (3, "again\nand\nagain"), (1 << 60, "big\nid\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("c", F.lit(0))
    for percent in (100, 40):
        out = fill_middle.transform(docs, fill_middle.FillParams(percent=percent, block_bytes=64))
        out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        want = sorted([(str(i), *plain_fim(i, t, percent=percent), t or "") for i, t in rows], key=str)
        assert sorted([(str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out], key=str) == want


def plain_features(text, run=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i:i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def test_crc_of_rows():
    rng = np.random.default_rng(1)
    for width in (1, 2, 9, importance.WIDE - 1, importance.WIDE, importance.WIDE + 5):
        rows = rng.integers(0, 256, (7, width)).astype(np.uint8)
        assert importance.crc32_of_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


TEXTS = ["The quick, brown FOX", "ß Ä é1 2", None, "", "...", "a a a a", "w" * 2000 + " tail " + "w" * 2000, " ".join("t%d u" % (i % 37) for i in range(400)), "the Fox the fox"]


@pytest.mark.parametrize("slice_bytes, chunk", [(4 << 20, 1 << 19), (16, 1 << 19), (16, 8), (5, 1)])
def test_slices_and_chunks_change_nothing(monkeypatch, slice_bytes, chunk):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(importance, "CHUNK_WORDS", chunk)
    params = importance.ImportanceParams(buckets=997)
    found, words = {i: [] for i in range(len(TEXTS))}, np.zeros(len(TEXTS), int)
    for where, bucket, doc, new in importance.bucketed([None if t is None else t.encode() for t in TEXTS], params):
        for i, b in zip(where.tolist(), bucket.tolist()):
            found[i].append(b)
        np.add.at(words, doc, new)
    for i, text in enumerate(TEXTS):
        split, features = plain_features(text)
        assert sorted(found[i]) == sorted(zlib.crc32(f.encode()) % 997 for f in features) and words[i] == len(split)


def test_resampling(spark):
    rows = [(i, " ".join(f"{w}{(i * j) % 11}" for j, w in enumerate(["alpha", "beta", "gamma"] * (1 + i % 12)))) for i in range(300)]
    rows += [(i, t) for i, t in enumerate(TEXTS, 1000)] + [(None, "no id " * 20), (5, rows[5][1]), (5, rows[5][1])]
    target = [t for _, t in rows[:40:3]] + [None, ""]
    params = importance.ImportanceParams(buckets=501, percent=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash")).withColumn("_row", F.lit(1)).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), params).collect()
    s, t = np.zeros(501, int), np.zeros(501, int)
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in plain_features(x)[1]:
                counts[zlib.crc32(f.encode()) % 501] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 501) / ((a + 1) * (t.sum() + 501)))) for a, b in zip(s.tolist(), t.tolist())]
    want = []
    for i, x in rows:
        words, features = plain_features(x)
        weight = sum(gain[zlib.crc32(f.encode()) % 501] for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0] or 0))
    for n, w in enumerate(able[:len(able) * 20 // 100], 1):
        w[5] = n
    assert sorted([tuple(r) for r in got], key=str) == sorted([tuple(w) for w in want], key=str)


def test_linked_sets_share_a_fingerprint():
    rng, percent = np.random.default_rng(5), 85
    for size in [*range(6, 60), 75, 120, 400, 1500, 5000]:
        for _ in range(12):
            union = np.unique(rng.integers(0, 1 << 63, 2 * size, np.uint64))[:size + size * 15 // 85 + 2]
            rng.shuffle(union)
            # The two sets differ in as many tokens as they may, dealt over both sides at random.
            spare, mine = union[size:], rng.integers(0, 2, len(union) - size).astype(bool)
            a, b = (np.unique(np.r_[union[:size], spare[side]]) for side in (mine, ~mine))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(spare):
                one, other = token_groups.fingerprints([a, b], percent)
                assert np.intersect1d(one, other).size


def variants(rng, base, many, most):
    out = []
    for _ in range(many):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, most + 1)):
            words[at] = f"x{rng.integers(0, 10 ** 6)}"
        out.append(" ".join(words))
    return out


def plain_shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_shingles_of_many_texts():
    texts = ["", None, " \t", "one", "One  two", "a b c d e", "a b c d e a b c d", "ß Ä é\x0b日本 x\u00a0y", "z" * (3 << 19) + " tail of it", " lead and trail \n", "b a b a b a", "ab c", "a bc"]
    found = shingle_sets([None if t is None else t.encode() for t in texts], 4)
    assert [len(s) for s in found] == [len(plain_shingles(t, 4)) for t in texts]
    for i, s in enumerate(found):
        assert (np.diff(s.astype(float)) >= 0).all()
        for j, o in enumerate(found[:i]):
            assert len(np.intersect1d(s, o)) == len(plain_shingles(texts[i], 4) & plain_shingles(texts[j], 4))
    assert all((a == b).all() for a, b in zip(found, [shingle_sets([None if t is None else t.encode()], 4)[0] for t in texts]))


def brute_components(texts, params):
    sets = [plain_shingles(t, params.words) for t in texts]
    low = list(range(len(texts)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= params.percent * (len(x) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                low[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("members", [1, 5, 256])
def test_components_equal_brute_force(spark, members):
    rng = np.random.default_rng(11)
    passage = [f"common{i}" for i in range(30)]
    texts = []
    for f, (size, many, most) in enumerate([(150, 60, 4), (150, 120, 8), (40, 40, 2), (12, 25, 1), (600, 10, 20)]):
        texts += variants(rng, [f"f{f}w{i}" for i in range(size)], many, most)
    texts += [" ".join([*passage, *(f"own{i}v{j}" for j in range(120))]) for i in range(40)]
    texts += [None, "", "one", "one", "ONE", "one two", " \n", texts[0], texts[0], texts[3].upper(), " ".join(f"long{i}" for i in range(30_000)), " ".join(f"long{i}" for i in range(29_990))]
    params = token_groups.JoinParams(members=members, rows_per_part=60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("print", F.lit("clash")).withColumn("g", F.lit(1))
    out = token_groups.join(docs.repartition(6), params).toPandas().sort_values("doc_id")
    assert out["doc_id"].tolist() == list(range(len(texts)))
    assert out["component_id"].tolist() == brute_components(texts, params)
    assert out["n_shingles"].tolist() == [len(plain_shingles(t, 4)) for t in texts]


def test_join_of_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text), (4, text + " more"), (None, text), (9, text), (9, "other words of the same id here"), (7, "other words of the same id here"), (None, None)]
    out = token_groups.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out]) == [
        (0, 0, 0), (0, 57, 0), (4, 58, 4), (7, 4, 7), (9, 4, 7), (9, 57, 4), (9, 57, 4)]
    assert token_groups.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
