"""Every query with SQL against its SQL; the others against plain Python over the same table."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitewise import llm
from sitewise.llm import catalog, shard_table, syncmers

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages labels benchmark".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select * from documents order by doc_id desc").df()


def got(spark, name):
    return llm.queries()[name](spark, FOLDER).toPandas()


def canonical(pdf):
    def text(v):
        return "~" if v is None or pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found, want = got(spark, name), duck.execute(llm.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    whole = [c for c in want.columns if (pd.api.types.is_float_dtype(found[c]) and "id" in c) or c in ("refers_to", "rank", "prefix_chars", "middle_chars")]
    assert canonical(found.astype({c: "Int64" for c in whole})) == canonical(want.astype({c: "Int64" for c in whole}))


def test_shards_follow_the_turns(spark, documents):
    size = shard_table.TABLE_SIZE
    free, table, at = size, [None] * size, {s: 0 for s in catalog.SHARDS}
    walks = {s: shard_table._walk(s, size) for s in catalog.SHARDS}
    while free:
        for s, (first, step) in walks.items():
            while table[(first + step * at[s]) % size] is not None:
                at[s] += 1
            table[(first + step * at[s]) % size] = s
            free -= 1
            if not free:
                break
    out = got(spark, "op1_shard_table").set_index("doc_id")
    for i in documents["doc_id"]:
        slot = int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) % size
        assert (out.loc[i, "slot"], out.loc[i, "shard"]) == (slot, table[slot])


def test_token_counts(spark, documents):
    encode = catalog.byte_pair_encoder()
    assert got(spark, "op3_separator_scan").set_index("doc_id")["n_tokens"].to_dict() == {
        i: len(encode(t)) for i, t in zip(documents["doc_id"], documents["text"])}


def test_held_out_languages(spark, documents):
    out = got(spark, "op4_language_centroids").merge(documents, on="doc_id")
    assert len(out) == len(documents) and (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    assert (out["lang_pred"] == out["lang"])[out["held_out"]].mean() > 0.95 and not out["rejected"].any() and out["score"].between(0, 1).all()


def check_packed(out, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = out.sort_values(["doc_id", "piece"])
    for i, text in zip(documents["doc_id"], documents["text"]):
        ids, mine = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], out[out["doc_id"] == i]
        assert mine["start"].tolist() == list(range(0, len(ids), 4096)) and mine["piece"].tolist() == list(range(len(mine)))
        for start, length, crc in zip(mine["start"], mine["length"], mine["ids_crc32"]):
            part = ids[start:start + 4096]
            assert (len(part), zlib.crc32(np.array(part, "<u4").tobytes())) == (length, crc)
    out = out.sort_values(["sequence_id", "offset"])
    seq = out.groupby("sequence_id")
    assert ((seq["length"].cumsum() - out["length"]) == out["offset"]).all() and seq["length"].sum().max() <= 4096
    return seq.ngroups, math.ceil(out["length"].sum() / 4096)


def test_packing(spark, documents):
    used, least = check_packed(got(spark, "op5_best_fit"), documents)
    assert used <= least * 1.05 + 2


def plain_anchors(text, k, s):
    points = np.array([ord(c) for c in text], np.uint32)
    small = [int(syncmers._mix(syncmers._window(points[i:i + s].copy(), s))[0]) for i in range(len(text) - s + 1)]
    out = []
    for i in range(len(text) - k + 1):
        inner = small[i:i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((int(syncmers._mix(syncmers._window(points[i:i + k].copy(), k))[0]), i))
    return out


def test_fingerprints(spark, documents):
    out, params = got(spark, "op8_closed_syncmers").set_index("doc_id"), syncmers.SyncmerParams()
    ids, texts = documents["doc_id"].tolist(), documents["text"].tolist()
    for n, (i, text) in enumerate(zip(ids, texts)):
        following = texts[(n + 1) % len(texts)]
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        row = out.loc[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if n < 20 and len(text) >= params.short:
            first = {}
            for h, at in plain_anchors(text, params.k, params.s):
                first.setdefault(h, at)
            assert row["fingerprint"] == "".join(f"{h:08x}{first[h]:08x}" for h in sorted(first)[:params.size])
    assert out["near_edited"].mean() > 0.25 and out["near_next"].mean() < 0.02
    assert (out["near_edited"] >= out["near_next"]).mean() > 0.95


def test_registered_once_per_operator():
    names = list(llm.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
