"""Line dedup, spelling variants and centroid clustering against plain versions, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import centroids, common, lines, spelling

BLANK = " \t\n\x0b\x0c\r"
UP = str.maketrans(common.UPPER, common.LOWER)

# ---- lines


def plain_lines(rows, shortest=10):
    place = lambda i: (i is None, i or 0)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(BLANK).translate(UP)
            if len(k) >= shortest and (k not in held or place(i) < place(held[k])):
                held[k] = i
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if len(k := x.strip(BLANK).translate(UP)) < shortest or held[k] == i]
        out.append((i, len(all_), len(all_) - len(stay), None if t is None else "\n".join(stay)))
    return sorted(out, key=repr)


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    said = ["common licence line here", "  Common LICENCE line here\t", "short", "", "a line with ü and   inside ", "\x85 next line control \x85"] + [f"line number {k} of many" for k in range(40)]
    rows = [(int(i), "\n".join(said[int(k)] for k in rng.integers(0, len(said), int(rng.integers(0, 12))))) for i in rng.permutation(n)]
    return rows + [(None, "common licence line here\nonly without an id"), (None, None), (3, "line of the other row of three\nshort"), (4, ""), (2, None), (5, "\n\n"), (6, "a\r\nline of the other row of three  \r\n")] + [rows[0], rows[0]]


def test_lines_equal_a_plain_version(spark):
    rows = table(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n_lines", "doc", "th", "gone", "line", "pos", "h1", "batch", "holder")})
    for batches in (1, 6):
        got = lines.dedup(docs.repartition(5), batches=batches)
        assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"] and got.filter("doc <> 'mine' or gone <> 'mine'").count() == 0
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == plain_lines(rows)


def test_runs_are_merged_and_opened_again(spark):
    rows = sorted((r for r in table(200, 1) if r[0] is not None), key=lambda r: r[0])
    folder, got = common.own_folder(spark, "runs"), []
    for at in range(0, 200, 25):  # eight calls of one batch each, each with what the folder has
        runs = lines.Runs(spark, folder)
        part = spark.createDataFrame([r for r in rows if at <= r[0] < at + 25], "doc_id long, text string")
        got += [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup(part, runs, batches=1).collect()]
        assert max(Counter(level for level, _, _ in runs.runs).values()) < lines.FAN
        runs.close()
    assert sorted(level for level, _, _ in runs.runs) == [0, 0, 1, 1]
    assert sorted(got, key=repr) == plain_lines(rows)


def test_runs_stay_where_they_are(spark, capsys):
    runs = lines.Runs(spark, common.own_folder(spark, "runs"), fan=9)
    batch = lambda a, b: spark.range(a, b).selectExpr("id as doc", "id div 2 as h1", "id as h2")
    runs.add(batch(0, 100))
    runs.add(batch(50, 200))
    a, b = (spark.table(t) for _, t, _ in runs.runs)
    assert (a.count(), b.count()) == (100, 100)
    a.groupBy("h1", "h2").agg(F.min("holder")).join(b.hint("merge"), lines.HASH, "left_anti").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    a.unionByName(b).groupBy("h1", "h2").agg(F.min("holder")).explain()
    assert "Exchange" not in capsys.readouterr().out
    runs.close()


def test_lines_of_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "some line of text\nx"), ("a", "SOME line of text"), (None, "some line of text")], "doc_id string, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in lines.dedup(docs).collect()), key=repr) == sorted([("a", "SOME line of text"), ("b", "x"), (None, "")], key=repr)
    assert lines.dedup(docs.filter("false")).count() == 0
    long = spark.createDataFrame([(1, "\n".join(["the same long line"] * 50_000)), (2, "the same long line\n" + "y" * 1_000_000)], "doc_id long, text string")
    assert sorted((r["n_lines"], r["n_dropped"]) for r in lines.dedup(long).collect()) == [(2, 1), (50_000, 0)]


# ---- spelling


def plain_spelling(rows, least=5, seen=3):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= least
    n = {w: c for w, c in count.items() if c >= seen}
    near = defaultdict(set)
    alphabet = sorted({x for w in n for x in w})
    for w in n:
        for j in range(len(w) + 1):
            made = [w[:j] + x + w[j:] for x in alphabet] + ([w[:j] + w[j + 1 :]] + [w[:j] + x + w[j + 1 :] for x in alphabet] if j < len(w) else [])
            near[w] |= {v for v in made if v != w and v in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def test_spelling_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    base = ["maison", "maisons", "mässig", "straße", "aaaaa", "aaaaaa", "abaaa", "color", "colour", "colours", "dolor", "×÷×÷×", "ABCDE", "Éclairs", "éclairs", "abcdef", "bcdef", "abcde"]
    rows = []
    for i in range(400):
        said = [base[int(k) % len(base)] for k in rng.zipf(1.4, 30)]
        for _ in range(3):
            j = int(rng.integers(len(said)))
            at = int(rng.integers(len(said[j])))
            said[j] = said[j][:at] + "abcdeo"[int(rng.integers(6))] + said[j][at + int(rng.integers(2)) :]
        rows.append((i, " ".join(said)))
    rows += [(None, "colour colour"), (7, None), (8, ""), (9, "123 !!"), (10, "x" * 3000 + " " + "x" * 2999), (11, ("x" * 3000 + " ") * 3 + ("x" * 2999 + " ") * 8), (12, "colorİcolor")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "n", "id", "h", "run", "k", "root")})
    got = spelling.group(docs.repartition(4))
    assert sorted((tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == plain_spelling(rows)
    want = plain_spelling(rows)
    assert any(r[2] != r[1] and r[1] for r in want) and any(r[0] == "x" * 3000 and r[1] == "x" * 2999 for r in want)  # chains, and a very long word
    assert spelling.group(docs.filter("false")).count() == 0 and spelling.group(docs.filter("text = '123 !!'")).count() == 0


def test_roots_follow_long_chains(spark):
    got = spelling.roots(spark.range(1, 1000).selectExpr("id", "id - 1 as to")).agg(F.max("root"), F.count("*")).first()
    assert tuple(got) == (0, 999)


# ---- centroids


def plain_clusters(rows, k, rounds, seed=2):
    """Lloyd's rounds in whole numbers of any size."""
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    c = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(c)):
            if mine := [v for (_, v), a in zip(rows, own, strict=True) if a == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in rows]
    each = Counter()
    for d, j in last:
        each[j] += d
    return sorted([(i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, last, strict=True)], key=repr)


@pytest.mark.parametrize("top", [3, 200, 1 << 26])
def test_clusters_equal_plain_rounds(spark, top):
    rng = np.random.default_rng(top)
    mid = rng.integers(-top, top, (12, 4))
    rows = [(int(i), [int(x) for x in np.clip(mid[int(i) % 12] + rng.integers(-top // 3, top // 3 + 1, 4), -top, top)]) for i in range(300)]
    rows += [rows[0], rows[0], rows[5], (None, rows[7][1]), (None, [0, 0, 0, 0])]  # of small numbers many are equal and equally far
    got = centroids.cluster(spark.createDataFrame(rows, "key long, v array<int>").repartition(3), k=20, rounds=5, dims=4)
    assert sorted((tuple(r) for r in got.drop("scanned").collect()), key=repr) == plain_clusters(rows, 20, 5)
    if top == 200:
        assert got.agg(F.avg("scanned")).first()[0] < 0.6 * 20 * 6  # most distances are never worked out


def test_clusters_of_odd_vectors(spark):
    good = [float(x) for x in np.arange(64) / 64]
    rows = [(1, good), (2, None), (3, good[:63]), (4, [*good[:63], None]), (5, [*good[:63], float("nan")]), (6, [*good[:63], float("inf")]), (7, []), (8, good), (8, good), (9, [*good[:63], 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("v", "x", "key", "a", "cluster")})
    whole = centroids.whole(df)
    assert sorted(r["key"] for r in whole.collect()) == [1, 8, 8]
    got = centroids.cluster(whole).collect()  # fewer vectors than centroids, all equal
    assert sorted((r["key"], r["cluster"], r["distance"], r["inertia"]) for r in got) == [(1, 0, 0, 0), (8, 0, 0, 0), (8, 0, 0, 0)]
    assert centroids.cluster(whole.filter("false")).count() == 0
    one = centroids.cluster(whole, k=1).collect()
    assert {r["cluster"] for r in one} == {0}
