"""Secret scans over an incremental ledger of blobs.

Every version of every file is addressed by its content's SHA-256. A blob is scanned once per rule and rule version, whatever the number of paths
and times it occurs; the ledger keeps what was found, nothing found included, and the next scan starts from there. Findings reach
paths by a join on the blob.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, settle

FOUND = "array<struct<start: int, k: int, kind: string, end: int>>"
#: Rows that may be broadcast.
BROADCAST_ROWS = 250_000
LEDGER = "blob string, kind string, version int, spans array<struct<start: int, end: int>>"

# The rules' patterns. kind, version, pattern, least length (of the group, else of the match), group, strings of which a
# text must hold one (lower case: compared without case).
RULES = (
    ("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", 1, r"AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    ("hex", 1, r"[0-9a-f]{24,}", 24, 0, ()),
    ("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 40, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack", 1, r"xox[abeoprs]-[A-Za-z0-9-]+", 15, 0, ("xox",)),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, ("eyJ",)),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("PRIVATE KEY-----",)),
)
KINDS = tuple(r[0] for r in RULES)


def find(text: str, rule: tuple) -> list[tuple[int, int]]:
    """(start, end) in code points of a rule's matches: leftmost, not overlapping, then those long enough."""
    kind, _, pattern, least, group, hints = rule
    if kind == "assign":
        folded = text.lower()
        if not any(h in folded for h in hints):
            return []
        flags = re.ASCII | re.IGNORECASE
    elif hints and not any(h in text for h in hints):
        return []
    else:
        flags = re.ASCII
    return [m.span() for m in re.compile(pattern, flags).finditer(text) if m.end(group) - m.start(group) >= least]


def _unseen(rows: DataFrame, files: DataFrame, ledger: DataFrame | None, rules: tuple) -> DataFrame:
    """(blob, text, kinds): the blobs of which rules' present versions are not in the ledger, with these rules' kinds. Texts stay where they are read, unless the blobs that stand in
    several rows or in the ledger are too many to broadcast."""
    kinds = F.array(*[F.lit(k) for k, *_ in rules])
    place = F.struct("path")
    skip = rows.groupBy("blob").agg(F.count("*").alias("k"), F.min(place).alias("first"))
    if ledger is None:
        skip = skip.withColumn("done", F.lit(None).cast("array<string>"))
    else:
        now = F.create_map(*[F.lit(x) for k, v, *_ in rules for x in (k, v)])
        done = ledger.filter(now[F.col("kind")] == F.col("version")).groupBy("blob").agg(F.collect_set("kind").alias("done"))  # as many as there are rules
        skip = skip.join(done, "blob", "left")
    todo = F.array_except(kinds, F.coalesce("done", F.array().cast("array<string>")))
    texts = files.withColumn("blob", F.sha2("text", 256))
    few = settle(skip.filter("k > 1 or done is not null").select("blob", "first", "done"), "secrets-skip")
    if few.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(few), "blob", "left").filter(F.col("first").isNull() | place.eqNullSafe(F.col("first")))
        return texts.select("blob", "text", todo.alias("kinds")).filter(F.size("kinds") > 0)
    wanted = skip.select(F.col("blob").alias("b"), F.col("first.path").alias("p"), todo.alias("kinds")).filter(F.size("kinds") > 0)
    return texts.join(wanted, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p"))).select("blob", "text", "kinds")


def scan(files: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new): paths has a row for each row of files: path, blob, found (array of kind, start, end by start, then kind as listed);
    new holds the ledger's rows for the pairs of blob and rule version that were not in `ledger` and have been scanned now.

    A null text counts as empty; null paths are paths like others. Rows of one path are its versions. A rule whose version is raised is scanned anew and its older findings are not
    reported. Equal texts, however many, are scanned once, as a whole; an empty table or ledger is fine; other columns are ignored.
    """
    files = files.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = settle(files.select("path", F.sha2("text", 256).alias("blob")), "secrets-paths")
    version = F.create_map(*[F.lit(x) for k, v, *_ in rules for x in (k, v)])
    rank = F.create_map(*[F.lit(x) for i, (k, *_) in enumerate(rules) for x in (k, i)])

    def search(batches):
        for pdf in batches:
            out = []
            for blob, text, kinds in zip(pdf["blob"], pdf["text"], pdf["kinds"], strict=True):
                out += [(blob, r[0], r[1], [{"start": s, "end": e} for s, e in find(text, r)]) for r in rules if r[0] in kinds]
            yield pd.DataFrame(out, columns=["blob", "kind", "version", "spans"])

    new = _unseen(rows, files, ledger, rules).mapInPandas(search, LEDGER)
    if rows.groupBy("path", "blob").count().filter("count > 1").take(1):  # a path holds one blob in several rows, with equal findings
        new = new.dropDuplicates(["blob", "kind"])
    new = settle(new, "secrets-new")
    every = new if ledger is None else new.unionByName(ledger.filter(version[F.col("kind")] == F.col("version")).select(new.columns))
    found = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[F.col("kind")].alias("k"), F.col("kind").alias("kind"), s["end"].alias("end")))
    hits = every.filter(F.size("spans") > 0).select("blob", found.alias("found")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))  # a row for each rule
    hits = settle(hits, "secrets-hits")
    out = rows.join(F.broadcast(hits), "blob", "left") if hits.count() <= BROADCAST_ROWS else meet(rows, hits, "blob", how="left")
    return out.select("path", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")), new


def scan_into(files: DataFrame, where: str, **how) -> DataFrame:
    """scan()'s paths, with the ledger as a table in the folder `where`: read if it is there, and added to. A scan that fails adds nothing, or what it has found in full."""
    spark = files.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    paths, new = scan(files, spark.read.schema(LEDGER).parquet(where) if there else None, **how)
    new.write.mode("append").parquet(where)
    return paths


def digests(paths: DataFrame, base: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """Counts and digests of each path's findings."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    old = F.filter("found", lambda x: x["kind"].isin(*base))
    return paths.select("path", *[count(k).alias(f"n_{k}") for k in base], F.sha2(F.concat_ws(",", F.transform(old, line)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("found", line)).alias("spans"))
