"""Operators against plain versions that share no code with them, odd rows, and rows that gather under one key."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import chat, common, decontam, langid, lm, mixing, sharding, urls

# ---- language id


def plain_bayes(rows, asked):
    """Naive Bayes over character n-grams of one to three, each n-gram hashed on its own."""
    mask = (1 << 64) - 1

    def grams(text):
        c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 32 for x in text]
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                g = c[i : i + n]
                if not (g[0] == 32 and g[-1] == 32 and n < 3):
                    h = g[0] + 1
                    for x in g[1:]:
                        h = (h * 0x100000001B3 + x) & mask
                    yield ((h * 0x9E3779B97F4A7C15) & mask) >> 50

    count, prior = defaultdict(Counter), Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            prior[lang] += 1
            count[lang].update(grams(text))
    out = []
    for text in asked:
        if not any(x.isalpha() for x in text or ""):
            out.append(("und", 0.0))
            continue
        score = {k: math.log(prior[k] / sum(prior.values())) + sum(math.log((count[k][g] + 0.5) / (sum(count[k].values()) + 0.5 * 16384)) for g in grams(text)) for k in sorted(prior)}
        best = max(score, key=lambda k: score[k])
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


def test_language_id_equals_plain_bayes(spark):
    a, b, c = "the cat sat on THE mat", "der hund lief über die straße", "le chat était là, où ça"
    rows = [(f"{x[i % 9 :]} {i * 37}", k) for i in range(12) for x, k in ((a, "en"), (b, "de"), (c, "fr"))] + [(None, "en"), ("", "de"), ("no label", None), ("  .. ", "fr")]
    asked = ["cat", "straße ist", "où", "the  hund là", "", None, "12 34", "İstanbul ǅ", "mat straße chat cat"]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    got = {r["i"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model).collect()}
    for i, (lang, score) in enumerate(plain_bayes(rows, asked)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-6)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.range(5).select(F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang")))


# ---- rows under one key


def test_chat_of_a_first_turn_that_most_share(spark, monkeypatch):
    turns = [(c, 0, "user", "the same first turn") for c in range(120)] + [(c, 1, "assistant", f"answer {c % 50}") for c in range(120)] + [(c, 2, "user", f"next {c}") for c in range(0, 120, 3)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")

    def shown():
        nodes, paths, convs = chat.build(df)
        return sorted(map(str, nodes.select("node", "start", "end", "position", "attends").collect())), sorted(map(str, chat.read_back(nodes, paths, convs).collect()))

    whole = shown()
    monkeypatch.setattr(common, "HOT", 5)
    assert shown() == whole and len(whole[1]) == 120


def test_urls_of_odd_pages_and_one_host(spark, monkeypatch):
    rows = [(i, f"http://a.io/{i}", f'<a href="//b{i % 3}.org/x">') for i in range(60)] + [(100, "http://b1.org/", '<a href="//spam.net/">'), (100, "http://b1.org/", '<a href="//spam.net/">'), (None, "http://c.io/", None), (None, None, "<a href='//a.io'>"), (101, "", ""), (102, "http:///x", "x" * 300_000), (103, "http://c.io/" + "y" * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("host", "path", "rule", "said", "key", "n", "trust", "verdict")})
    shown = lambda: sorted(str((r["key"], r["host"], r["path"], r["rule"], r["verdict"], round(r["trust"], 9), round(r["distrust"], 9))) for r in urls.judge(pages).collect())
    whole = shown()
    assert len(whole) == len(rows) and sum("'a.io'" in r for r in whole) == 60
    assert sum(r.startswith("(100") for r in whole) == 2 and sum(r.startswith("(None") for r in whole) == 2
    monkeypatch.setattr(common, "HOT", 5)
    assert shown() == whole
    assert urls.judge(pages.filter("false")).count() == 0


def test_leaks_of_a_seed_that_very_many_texts_have(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"of the first and then {i} " + (passage if i % 50 == 0 else "other words")) for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, "of the first and then this item goes on for a while with words of its own")], "item_id long, text string")
    shown = lambda: sorted((r["key"], r["item"], r["matched"]) for r in decontam.leaks(docs, bench).collect())
    whole = shown()
    assert [r[:2] for r in whole] == [(0, 1), (50, 1), (100, 1), (150, 1)]
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 1)
    assert shown() == whole


# ---- mixing


def test_mix_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "A", None)] * 50 + [(None, text, "A", "x")] * 3 + [(1, text, None, None), (1, text, None, None), (2, "", "A", None), (3, None, "B", None)] + [(10 + i, f"{text} {i}", "AB"[i % 2], None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    taken = mixing.taken(docs, block=16, shards=8)
    assert taken.count() == len(rows) and taken.filter("taken > 2 * size").count() == 0
    for r in taken.groupBy("source").agg(F.sum("taken").alias("k"), F.max("target").alias("t")).collect():
        assert abs(r["k"] - r["t"]) <= 0.5
    out = mixing.mixed(docs, block=16, shards=8)
    assert out.columns == docs.columns
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n")).collect()}
    want = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r["n"]}
    assert got == want
    monkeypatch.setattr(mixing, "SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.taken(docs)


# ---- sharding


def test_limit_for_a_number_of_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 40)) for i in range(500)] + [(None, None)], "doc_id long, text string")
    total = sum(i % 40 for i in range(500))
    assert sharding.limit_for(docs, 10) == -(-total // 10) and sharding.limit_for(docs, 10, most=100) == 100 and sharding.limit_for(docs.filter("false"), 10) == 1
    assert sharding.shard(docs, limit=sharding.limit_for(docs, 10)).select("shard").distinct().count() >= 10


# ---- language models


def test_continuations_and_what_they_leave_are_a_distribution():
    rng = np.random.default_rng(3)
    given = rng.dirichlet(np.ones(9))
    num = np.array([5, 1, 1, 3, 0, 0, 0, 0, 0])
    p = lm._smoothed(num, np.full(9, num.sum()), np.full(9, (num > 0).sum()), given)
    assert p.sum() == pytest.approx(1) and (p > 0).all()
    assert lm._smoothed(np.zeros(9), np.zeros(9), np.zeros(9), given) == pytest.approx(given)


def test_scores_of_odd_training_sets(spark):
    docs = spark.createDataFrame([(i, "word " * 3000 if i == 3 else f"some text {i}") for i in range(30)], "doc_id long, text string")
    got = lm.score(docs).collect()
    assert len(got) == 30 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    held = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    got = lm.score(held).collect()  # nothing to learn from
    assert got and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in got)
