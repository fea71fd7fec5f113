"""Gates, constraints and audits over any table."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A required check did not pass."""


def evaluate_gates(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared gates against observed booleans, one row per gate.

    A gate passes only if it is declared, observed and true; names on one side
    only are reported as such.
    """
    j = declared.select("gate", F.lit(True).alias("_d")).join(
        observed.select("gate", "passed", F.lit(True).alias("_o")), "gate", "full_outer")
    status = F.when(F.col("_o").isNull(), "not_observed").when(F.col("_d").isNull(), "not_declared") \
        .when(F.col("passed"), "PASS").otherwise("FAIL")
    return j.select("gate", status.alias("status"))


def overall_status(gates: DataFrame) -> DataFrame:
    """PASS only if every gate passed."""
    ok = F.coalesce(F.bool_and(F.col("status") == "PASS"), F.lit(False))
    return gates.agg(F.count(F.lit(1)).alias("gates"), F.count_if(F.col("status") != "PASS").alias("not_passed"),
                     F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def threshold_gates(observed: DataFrame, required: DataFrame) -> DataFrame:
    """Observed numbers against required minima, by metric name."""
    j = required.select("metric", "required").join(observed.select("metric", "observed"), "metric", "left")
    return j.withColumn("passed", F.coalesce(F.col("observed") >= F.col("required"), F.lit(False)))


def admission_rules(tracks: DataFrame, rules: Sequence[tuple[str, Column]], kind: str, hold: str = "HOLD") -> DataFrame:
    """Label each track by the first rule it meets, else hold it."""
    label = None
    for name, cond in rules:
        cond = F.coalesce(cond, F.lit(False))
        label = F.when(cond, name) if label is None else label.when(cond, name)
    out = tracks.withColumn("admission", label.otherwise(hold))
    return out.withColumn("admitted_kind", F.when(F.col("admission") != hold, F.col(kind)))


def go_no_go(admitted: DataFrame, minimum: int) -> DataFrame:
    """GO when enough distinct kinds were admitted."""
    n = F.count_distinct("admitted_kind")
    return admitted.agg(n.alias("admitted_kinds"), F.when(n >= minimum, "GO").otherwise("NO_GO").alias("gate"))


def admission_with_failures(df: DataFrame, criteria: dict[str, Column], admit: str = "ADMIT_FOR_ASSOCIATION",
                            hold: str = "HOLD_NOT_ADMITTED") -> DataFrame:
    """Decision per row from several booleans, with the names of the failed ones."""
    tested = {n: F.coalesce(c, F.lit(False)) for n, c in criteria.items()}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in tested.items()]))
    return df.withColumn("failed_criteria", F.array_join(failed, ";")) \
        .withColumn("decision", F.when(F.col("failed_criteria") == "", admit).otherwise(hold))


def constraint_violations(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """How many rows break each constraint; all of them in one aggregate."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in constraints.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("violations")) for n in constraints])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def require_constraints(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    bad = constraint_violations(df, constraints).where("violations > 0").collect()
    if bad:
        raise GateError("; ".join(f"{r['constraint']}: {r['violations']} rows" for r in bad))
    return df


def referential_checks(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Duplicate parent keys, orphan child rows, parents without children."""
    parents = parent.groupBy(F.col(parent_key).alias("_k")).agg(F.count(F.lit(1)).alias("_p"))
    children = child.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    j = parents.join(children, "_k", "full_outer")
    return j.agg(
        F.count_if(F.col("_p") > 1).alias("duplicate_parent_keys"),
        F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("_c"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(F.col("_c").isNull()).alias("uncovered_parents"),
    )


def schema_contract(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Raise unless the required (or exactly these) columns exist."""
    have, want = set(df.columns), set(columns)
    if (have != want) if exact else not want <= have:
        raise GateError(f"columns differ: missing {sorted(want - have)}, extra {sorted(have - want)}")
    return df


def population_invariants(df: DataFrame, key: str, implications: dict[str, tuple[Column, Column]],
                          expected_rows: int | None = None) -> DataFrame:
    """Uniqueness, implications (if left then right) and frozen counts, as named violations."""
    checks = {"duplicate_ids": F.count(key) - F.count_distinct(key)}
    for name, (a, b) in implications.items():
        checks[name] = F.count_if(F.coalesce(a, F.lit(False)) & ~F.coalesce(b, F.lit(False)))
    if expected_rows is not None:
        checks["row_count_difference"] = F.abs(F.count(F.lit(1)) - expected_rows)
    one = df.agg(*[c.cast("long").alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(n).alias("violations")) for n in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def leakage_audit(df: DataFrame, split: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column that occur in more than one split (must be 0)."""
    long = df.select(split, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])).alias("kv"))
    spread = long.where("kv.value is not null").groupBy("kv.variable", "kv.value") \
        .agg((F.min(split) != F.max(split)).alias("_leaks"))
    return spread.groupBy("variable").agg(F.count_if("_leaks").alias("overlap"))


def require_pass(status: DataFrame) -> DataFrame:
    """The status table must hold exactly one row and say PASS."""
    row = status.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "PASS").alias("ok")).first()
    if (row["n"], row["ok"]) != (1, 1):
        raise GateError(f"required stage did not pass: {row['n']} rows, {row['ok']} PASS")
    return status


def status_precondition(status: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per stage: is there exactly one row, and is it PASS?"""
    return status.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        ((F.count(F.lit(1)) == 1) & F.bool_and(F.col("status") == "PASS")).alias("ready"))


def reproduction_check(recomputed: DataFrame, published: DataFrame, on: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Recomputed against published values in long form; a missing side fails."""
    j = recomputed.select(*on, F.col("value").alias("recomputed")).join(
        published.select(*on, F.col("value").alias("published")), list(on), "full_outer")
    diff = F.abs(F.col("recomputed") - F.col("published"))
    return j.withColumns({"abs_difference": diff, "match": F.coalesce(diff <= tolerance, F.lit(False))})


def row_digest(columns: Sequence[str]) -> Column:
    """Order-fixed digest of a row; NULL differs from the empty text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a table: row count and sum of digest prefixes.

    Each task adds its own rows, so a table of any size needs one small shuffle.
    """
    part = F.conv(F.substring(row_digest(columns), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).cast("string").alias("fingerprint"))


def fingerprint_match(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    a, b = table_fingerprint(before, columns), table_fingerprint(after, columns)
    out = a.select(F.col("rows").alias("rows_before"), F.col("fingerprint").alias("_fa")).withColumns({
        "rows_after": b.select("rows").scalar(), "_fb": b.select("fingerprint").scalar()})
    same = (F.col("rows_before") == F.col("rows_after")) & F.col("_fa").eqNullSafe(F.col("_fb"))
    return out.select("rows_before", "rows_after", F.when(same, "MATCH").otherwise("DIFFERENT").alias("result"))


def ordered_set_digest(df: DataFrame, column: str, prefix: int = 4) -> str:
    """Tree digest of a set of ids, the same for any order or partitioning of the rows.

    Every id's SHA-256 falls into the leaf of its first ``prefix`` hex digits; a leaf is the
    SHA-256 of its sorted digests, one per line, and the root that of the leaves (``digits
    digest`` lines in order). Repeated ids count each time, a NULL id as the text ``~null``.
    Leaves spread over tasks: with n ids one holds about n / 16 ** prefix of them.
    """
    ids = df.select(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("~null")), 256).alias("d"))
    lines = F.concat(F.array_join(F.array_sort(F.collect_list("d")), "\n"), F.lit("\n"))
    leaves = ids.groupBy(F.substring("d", 1, prefix).alias("p")).agg(F.sha2(lines, 256).alias("leaf"))
    rows = F.concat(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "leaf"))), "\n"), F.lit("\n"))
    return leaves.agg(F.sha2(rows, 256).alias("root")).first()["root"]


def table_equivalence(left: DataFrame, right: DataFrame, on: Sequence[str], numeric: Sequence[str],
                      text: Sequence[str] = (), tolerance: float = 1e-8) -> DataFrame:
    """Same keys, same null pattern, equal text, numbers within tolerance."""
    cols = [*numeric, *text]
    a = left.select(*on, F.lit(1).alias("_a"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    b = right.select(*on, F.lit(1).alias("_b"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    j = a.join(b, list(on), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def pair(c):
        return F.col(f"_l_{c}"), F.col(f"_r_{c}")

    diffs = [F.abs(pair(c)[0] - pair(c)[1]) for c in numeric]
    nulls = [(pair(c)[0].isNull() != pair(c)[1].isNull()).cast("int") for c in cols]
    texts = [(~pair(c)[0].eqNullSafe(pair(c)[1])).cast("int") for c in text]
    zero = F.lit(0)
    agg = j.agg(
        F.count_if(both).alias("common_rows"),
        F.count_if(~both).alias("unmatched_rows"),
        F.sum(F.when(both, sum(nulls, zero)).otherwise(0)).alias("null_pattern_differences"),
        F.sum(F.when(both, sum(texts, zero)).otherwise(0)).alias("text_differences"),
        F.coalesce(F.max(F.greatest(*diffs, F.lit(0.0))), F.lit(0.0)).alias("max_abs_difference"),
    )
    ok = (F.col("unmatched_rows") == 0) & (F.col("null_pattern_differences") == 0) \
        & (F.col("text_differences") == 0) & (F.col("max_abs_difference") <= tolerance)
    return agg.withColumn("equivalent", ok)


def formula_consistency(rows: DataFrame, checks: dict[str, tuple[Column, Column]], tolerance: float = 1e-12) -> DataFrame:
    """Stored values against their recomputation, one row per named formula."""
    one = rows.agg(*[x for n, (a, b) in checks.items() for x in (
        F.max(F.abs(a - b)).alias(f"{n}__d"),
        F.count_if(~F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))).alias(f"{n}__v"))])
    out = F.array(*[F.struct(F.lit(n).alias("formula"), F.col(f"{n}__d").alias("max_abs_difference"),
                             F.col(f"{n}__v").alias("violations")) for n in checks])
    return one.select(F.explode(out).alias("r")).select("r.*")


_ARROW_STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
_FILE_FACTS = "path string, bytes long, sha256 string, readable boolean, rows long, columns int"


def _open_file(path: str):
    """A file in the shared store, for reading block by block inside a task."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _Hashed(io.RawIOBase):
    """Bytes of ``raw``, counted and digested as they pass."""

    def __init__(self, raw):
        self.raw, self.digest, self.bytes = raw, hashlib.sha256(), 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        block = self.raw.read(len(into))
        into[:len(block)] = block
        self.digest.update(block)
        self.bytes += len(block)
        return len(block)


def file_facts(path: str, raw, block: int = 1 << 20) -> dict:
    """Size, digest, and if it can be read to its end, rows and columns of a file, of which a block is held at a time.

    Rows of a text table are its lines, columns the fields of the first one by tab or else
    by comma; a gzip file is unpacked as it streams. Other files have neither.
    """
    name, facts = path.lower(), {"path": path, "readable": True, "rows": None, "columns": None}
    hashed, whole = _Hashed(raw), False
    try:
        stream = io.BufferedReader(hashed, block)
        packed = name.endswith(".gz")
        inner = gzip.GzipFile(fileobj=stream) if packed else stream
        table = name.removesuffix(".gz").endswith((".tsv", ".csv", ".txt", ".bed"))
        lines, last, head, headed = 0, b"\n", bytearray(), False
        while part := inner.read(block):
            if table:
                lines, last = lines + part.count(b"\n"), part[-1:]
                if not headed:
                    headed = b"\n" in part
                    head += part.split(b"\n", 1)[0]
        whole = not hashed.read(block)
        if table:
            first = bytes(head)
            facts |= {"rows": lines + (last != b"\n"), "columns": (first.count(b"\t") or first.count(b",")) + 1 if first else 0}
        elif name.endswith(".parquet"):
            from pyarrow import parquet

            raw.seek(0)
            meta = parquet.ParquetFile(raw).metadata
            facts |= {"rows": meta.num_rows, "columns": meta.num_columns}
    except (OSError, EOFError, ValueError, zlib.error):  # pyarrow's errors are ValueErrors or OSErrors
        facts["readable"] = False
        while not whole and hashed.read(block):  # what is left counts for size and digest
            pass
    return facts | {"bytes": hashed.bytes, "sha256": hashed.digest.hexdigest()}


def file_inventory(spark, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Path, size, SHA-256, readable flag, rows and columns of every file under ``path``.

    Spark lists the files and deals them to tasks by size; a task streams each in blocks,
    so a file of any size will do; Spark leaves out files without a byte. In a store that only Spark's readers can open, files
    come as rows and must stay under 2 GB each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", str(recursive).lower()).load(path)
    first = files.select("path").first()
    streamed = first is None or first[0].split(":", 1)[0] in _ARROW_STORES

    def audit(batches):
        for batch in batches:
            for at in range(len(batch)):
                name = batch["path"].iloc[at]
                with _open_file(name) if streamed else io.BytesIO(batch["content"].iloc[at]) as raw:
                    yield pd.DataFrame([file_facts(name, raw)]).astype({"rows": "Int64", "columns": "Int64"})[["path", "bytes", "sha256", "readable", "rows", "columns"]]

    return files.select("path", *([] if streamed else ["content"])).mapInPandas(audit, _FILE_FACTS)
