"""Files are streamed in blocks; damaged ones give a row too."""

import gzip
import hashlib
import io

import pandas as pd

from sitewise.operators.quality import file_facts, file_inventory


def test_inventory_of_whole_and_damaged_files(spark, tmp_path):
    text = b"a\tb\tc\n" + b"1\t2\t3\n" * 5000 + b"4\t5\t6"
    packed = gzip.compress(text)
    table = io.BytesIO()
    pd.DataFrame({"x": range(7), "y": range(7)}).to_parquet(table)
    files = {"t.tsv": text, "t.tsv.gz": packed, "cut.tsv.gz": packed[:-9], "p.parquet": table.getvalue(), "bad.parquet": b"PAR1 no", "empty.csv": b"", "other.bin": b"\0\1"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in file_inventory(spark, str(tmp_path)).collect()}
    files.pop("empty.csv")  # Spark lists no file without a byte
    assert set(got) == set(files)
    for name, content in files.items():
        assert (got[name]["bytes"], got[name]["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())
    told = {n: (r["readable"], r["rows"], r["columns"]) for n, r in got.items()}
    assert told == {"t.tsv": (True, 5002, 3), "t.tsv.gz": (True, 5002, 3), "cut.tsv.gz": (False, None, None), "p.parquet": (True, 7, 2),
                    "bad.parquet": (False, None, None), "other.bin": (True, None, None)}
    assert file_inventory(spark, str(tmp_path), "*.none").isEmpty()


def test_lines_longer_than_a_block():
    assert file_facts("e.csv", io.BytesIO(b""))["rows"] == 0
    facts = file_facts("x.csv", io.BytesIO(b"a,b," + b"c" * 100 + b"\nd,e,f\n"), 16)
    assert (facts["rows"], facts["columns"], facts["readable"]) == (2, 3, True)
