"""Line dedup over levelled sorted runs of line hashes.

What is known of the lines seen so far is kept in runs: tables of (h1, h2, holder), a line's 128-bit hash and the document that keeps it, bucketed and sorted by hash. A batch's
distinct hashes are merge-anti-joined with every run, bucket by bucket, without moving a run; what is left becomes a run of level 0. When a level has FAN runs they are merged into
one run of the next level, so that n batches leave some FAN * log n runs and a hash is written log n times. A hash's holder never changes. All of it is DataFrame code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _remove, lower_ascii, own_folder, settle

#: Shorter keys are never dropped; characters that keys are stripped of; batches of one call; runs of a level that are merged.
SHORTEST, BLANK, BATCHES, FAN = 10, " \t\n\x0b\x0c\r", 6, 3
HASH = ["h1", "h2"]


class Runs:
    """The runs in a folder that driver and executors share. A run's folder is named by level and number of buckets and counts once it is whole, so that a later session (or one that
    takes over after a loss) opens what is there; what a lost merge left twice does no harm, as runs are sets."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder, fan
        self.runs: list[tuple[int, str, str]] = []  # level, table, path
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for at in sorted(str(x.getPath()) for x in fs.listStatus(path)) if fs.exists(path) else ():
            name = at.rsplit("/", 1)[1]
            if name.startswith("run-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
                _, level, buckets, kind, _ = name.split("-")
                table = f"lacuna_{uuid.uuid4().hex}"
                spark.sql(f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT, holder {kind}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {int(buckets)} BUCKETS LOCATION '{at}'")
                self.runs.append((int(level), table, at))

    def _write(self, df: DataFrame, level: int) -> None:
        buckets, kind = int(self.spark.conf.get("spark.sql.shuffle.partitions")), dict(df.dtypes)["holder"]
        table = f"lacuna_{uuid.uuid4().hex}"
        path = f"{self.folder}/run-{level}-{buckets}-{kind}-{uuid.uuid4().hex}"
        df.select(*HASH, "holder").write.format("parquet").bucketBy(buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(table)
        self.runs.append((level, table, path))

    def add(self, lines: DataFrame) -> None:
        """Take a batch of (h1, h2, doc): hashes that no run has get the batch's smallest document (a null one last) as their holder."""
        new = lines.groupBy(*HASH).agg(F.min("doc").alias("holder"))  # summed up before rows move, however frequent a line is
        for _, table, _ in self.runs:
            new = new.join(self.spark.table(table).select(*HASH).hint("merge"), HASH, "left_anti")
        self._write(new, 0)
        self.compact()

    def compact(self) -> None:
        for level in range(64):
            full = [r for r in self.runs if r[0] == level]
            if len(full) < self.fan:
                return
            merged = self.spark.table(full[0][1])
            for _, table, _ in full[1:]:
                merged = merged.unionByName(self.spark.table(table))
            self._write(merged.groupBy(*HASH).agg(F.min("holder").alias("holder")), level + 1)  # of co-bucketed runs: nothing moves
            for run in full:
                self.runs.remove(run)
                self.spark.sql(f"DROP TABLE {run[1]}")
                _remove(run[2], self.spark)

    def known(self) -> DataFrame:
        """All (h1, h2, holder), each hash once."""
        return self.spark.read.schema(self.spark.table(self.runs[0][1]).schema).parquet(*[path for _, _, path in self.runs])

    def close(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for _, table, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def key_of(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup(docs: DataFrame, runs: Runs | None = None, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with repeated lines taken out of their texts, and n_lines (before) and n_dropped.

    Lines are what stands between line feeds. A line whose key (stripped of blanks at both ends, A-Z lowered) has SHORTEST or more code points stays in one document alone, with all its
    occurrences there: the one that the runs already name, else the one of the smallest id. docs come as `batches` batches in order of their ids, cut at quantiles (ids that are
    not numbers: one batch), each against the runs of those before; with `runs` given, lines of earlier calls count as well, and docs' go into them.

    A null text stays null and counts as one empty line; so does an empty one. Rows of one id are one document; a null id is an id, after all others. Equal rows are
    separate rows with equal results. An empty table gives an empty one. Columns named n_lines or n_dropped are replaced; others stay. Positions of dropped lines gather by
    document, so a task holds those of its texts, never of a line.
    """
    spark = docs.sparkSession
    own = runs is None
    runs = Runs(spark, own_folder(spark, "line-runs")) if own else runs
    doc, whole = F.col(f"`{key}`"), F.col(f"`{text}`")
    cuts = []
    if batches > 1 and dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        cuts = sorted(set(docs.agg(F.percentile_approx(doc, [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []))  # batches - 1 numbers
    batch = sum((F.coalesce(doc > F.lit(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))
    each = docs.select(doc.alias("doc"), F.xxhash64(whole).alias("th"), batch.alias("batch"), F.posexplode(_lines(whole)).alias("pos", "line")).withColumn("line", key_of(F.col("line")))
    each = each.filter(F.char_length("line") >= SHORTEST).select("doc", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "batch")
    path = own_folder(spark, "lines")
    each.write.partitionBy("batch").parquet(path)
    each = spark.read.schema(each.schema).parquet(path)
    for b in range(len(cuts) + 1):
        runs.add(each.filter(F.col("batch") == b))
    # by hash and document: a line of a third of all documents is a key of its own in each
    known = runs.known().withColumnsRenamed({"h1": "g1", "h2": "g2"})
    gone = each.join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("doc").eqNullSafe(F.col("holder")), "left_anti")
    if own:
        runs.close()
    gone = settle(gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone")), "lines-gone").withColumnsRenamed({"doc": "__doc", "th": "__th", "gone": "__gone"})
    out = docs.join(gone, doc.eqNullSafe(F.col("__doc")) & (F.xxhash64(whole) == F.col("__th")), "left")
    stay = lambda at: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col("__gone")), lambda i: F.element_at(at, i + 1)))
    clean = F.when(F.col("__gone").isNull(), whole).otherwise(F.get(F.transform(F.array(_lines(whole)), stay), F.lit(0)))  # the text is split once
    out = out.withColumns({"n_lines": F.size(_lines(whole)).cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), text: clean})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


ORACLE = f"""
with l as (select doc_id, u.i as i, u.line as line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'i': i, 'line': x}})) as u from documents)),
held as (select k, min(doc_id) as holder from l where length(k) >= {SHORTEST} group by k),
j as (select l.doc_id, l.i, l.line, coalesce(held.holder < l.doc_id, false) as gone from l left join held on l.k = held.k and length(l.k) >= {SHORTEST})
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id"""
