"""Spelling variants by a symmetric-delete join.

Every word of the vocabulary emits itself and its distinct single deletions, as 64-bit keys; words that share a key meet in an equi-join, and those at a distance of exactly one are
near. A key of m letters is shared by at most (m + 1) * (letters of the alphabet) + 1 words, so no group grows with the corpus. Each word's form is its most frequent near word, if it is frequent
enough, and roots are found by following forms, twice as far in each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _PINV, _powers, lower_ascii, mix, settle

#: Runs of letters; the least code points and occurrences of a word; one run in RATE of (document, run) loses a letter; a form is at least TIMES as frequent.
LETTERS, LEAST, SEEN, RATE, TIMES = "[A-Za-z\\u00C0-\\u00FF]+", 5, 3, 97, 2


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lowered; where RATE divides the crc32 h of `<id>:<run>`, without the letter at h % length. Words of `least` code points and `seen`
    occurrences or more. A null text has no words; a null id is spelled as nothing. Words are counted before rows move."""
    run = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    run = run.filter(F.char_length("run") >= least).withColumn("run", lower_ascii(F.col("run")))
    run = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = run.select(F.when(F.col("h") % RATE == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)
    return word.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)


def _emit(batches):
    """(k, id) for every word and each of its distinct single deletions, in time linear in the letters: hashes of prefixes and suffixes add up to those of deletions."""
    for b in batches:
        words, ids = b.column(0).to_pylist(), b.column(1).to_numpy()
        data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)  # letters are code points below 256
        size = np.array([len(w) for w in words], np.int64)
        if not len(data):
            continue
        p, q = _powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
        end = np.cumsum(size)
        start = end - size
        first = np.zeros(len(data), bool)
        first[start] = True
        first[1:] |= data[1:] != data[:-1]  # deletions within a run of one letter are the same
        j = np.flatnonzero(first)
        w = np.searchsorted(end, j, "right")
        s, e = start[w], end[w]
        cut = ((total[j] - total[s]) + (total[e] - total[j + 1]) * _PINV) * q[s]
        whole = (total[end] - total[start]) * q[start]
        length = np.concatenate([size, size[w] - 1]).astype(np.uint64)
        k = mix(np.concatenate([whole, cut]) + length * np.uint64(0xD6E8FEB86659FD93))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.concatenate([ids, ids[w]]))], names=["k", "id"])


def near(words: DataFrame) -> DataFrame:
    """(id, other): both directions of each pair of words (id, word, n) that differ by exactly one inserted, deleted or replaced code point."""
    keys = settle(words.select("word", "id").mapInArrow(_emit, "k long, id long"), "spelling-keys")
    pairs = keys.join(keys.withColumnRenamed("id", "other"), "k").filter(F.col("id") < F.col("other")).select("id", "other").distinct()
    a, b = words.select("id", F.col("word").alias("a")), words.select(F.col("id").alias("other"), F.col("word").alias("b"))
    pairs = pairs.join(a, "id").join(b, "other").filter(F.levenshtein("a", "b", 1) == 1)
    return pairs.select(F.explode(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))).alias("p")).select("p.id", "p.other")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, to): the last that is reached by following `to` as far as there is one. Every step at least doubles a word's count, so the chains' length is the logarithm of a
    count and the rounds' number the logarithm of that."""
    now = settle(forms.withColumnRenamed("to", "root"), "spelling-roots")
    while True:
        then = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        then = settle(then, "spelling-roots")
        moved = then.filter("moved").take(1)
        now = then.select("id", "root")
        if not moved:
            return now


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seen: int = SEEN, times: int = TIMES) -> DataFrame:
    """A row for each word of the vocabulary: word, n, n_near (its near words), form (its near word of largest n, ties by code points, if that n is at least `times` its own; else null), form_n and
    root (the last word on the way of forms; itself without one). Words without a near word have n_near 0. An empty table, or one without words, gives no rows; columns other than key and text are
    not looked at. A very long word costs memory and keys in proportion to its length."""
    words = settle(vocabulary(docs, key, text, least, seen).withColumn("id", F.monotonically_increasing_id()), "spelling-words")  # written once, so ids stay
    best = near(words).join(words.select(F.col("id").alias("other"), F.col("word").alias("w"), F.col("n").alias("m")), "other")
    best = best.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "w", "other")).alias("best"))
    best = words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= times * F.col("n"), F.col("best")).alias("best"))
    best = settle(best.select("id", "word", "n", "n_near", F.col("best.w").alias("form"), (-F.col("best.m")).alias("form_n"), F.col("best.other").alias("to")), "spelling-forms")
    last = roots(best.filter("to is not null").select("id", "to"))
    out = best.join(last, "id", "left").join(words.select(F.col("id").alias("root"), F.col("word").alias("last")), "root", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 as the polynomial's table and a fold over bytes, from its definition.
ORACLE = f"""
with recursive bits as (select i, 0 as step, i::bigint as c from range(256) t(i) union all
  select i, step + 1, case when c % 2 = 1 then xor(3988292384::bigint, c // 2) else c // 2 end from bits where step < 8),
crc as (select list(c order by i) as t from bits where step = 8),
runs as (select doc_id::varchar || ':' || run as s, run, sum(k)::bigint as k from (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, 1 as k from documents) group by doc_id, run),
coded as (select run, k, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, (length(hex(encode(s))) // 2 + 1)::bigint), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::bigint)),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) as h from runs, crc where length(run) >= {LEAST}),
made as (select case when h % {RATE} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from coded),
words as (select word, sum(k)::bigint as n from made where length(word) >= {LEAST} group by word having sum(k) >= {SEEN}),
cuts as (select distinct word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as k from (select word, n, unnest(range(1, (length(word) + 1)::bigint)) as i from words)),
near as (
  select a.word, b.word as other, b.n as m from cuts a join cuts b on a.k = b.k and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.k = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.k = b.word),
best as (select word, count(*)::bigint as n_near, arg_min(struct_pack(w := other, m := m), struct_pack(a := -m, w := encode(other))) as b from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= {TIMES} * w.n then b.w end as form, case when b.m >= {TIMES} * w.n then b.m end as form_n from words w left join best using (word)),
walk as (select word, word as root, form as next from forms union all select walk.word, forms.word, forms.form from walk join forms on forms.word = walk.next)
select word, form, root, n, n_near, form_n from forms join (select word, root from walk where next is null) using (word)"""
