import math
import random
from collections import Counter
from dataclasses import replace
from datetime import date

import pytest
from support import rows
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.functions.text import tokens, without_stop_words
from searchpulse.operators import cluster
from searchpulse.operators.features import fit_features, simple_config, term_idf, term_tfidf
from searchpulse.plans.text_queries import STOP_WORDS

CFG = TrendConfig(feature_partitions=4)
TEXTS = ["red apple pie", "red apple cake", "blue sky day", "blue sky night", "green tea leaf", "green tea cup"]


def daily(spark, texts, per_text=1):
    data = [(t, date(2024, 1, 1 + i), 10 + i, 5, 1.0, 0.5) for t in texts for i in range(per_text)]
    schema = "query_text string, date date, query_count long, unique_users long, avg_results_count double, click_through_rate double"
    return spark.createDataFrame(data, schema)


def test_tokens_drop_empty_ones(spark):
    df = spark.createDataFrame([("  Big\tRED  dog \n",), ("",)], "t string").select(tokens(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["big", "red", "dog"], []]


def test_stop_words_keep_repeats(spark):
    df = spark.createDataFrame([(["the", "dog", "the", "dog"],)], "w array<string>")
    assert df.select(without_stop_words(F.col("w"), ["the"]).alias("w")).head().w == ["dog", "dog"]


def test_inlined_stop_words_are_the_library_ones(spark):
    assert STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_term_weights_match_brute_force(spark):
    texts = ["a a b", "a c", "a b d", "a", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, query_text string")
    df_of = Counter(t for text in texts for t in set(text.split()))
    want = {}
    for i, text in enumerate(texts):
        for term, tf in Counter(text.split()).items():
            idf = math.log((len(texts) + 1) / (df_of[term] + 1)) if df_of[term] >= 2 else 0.0
            want[i, term] = (tf, round(tf * idf, 9))
    weighted = term_tfidf(docs, "doc_id")
    assert {(r.doc_id, r.term): (r.tf, round(r.tfidf, 9)) for r in weighted.collect()} == want
    assert {r.term: r.doc_freq for r in term_idf(docs).collect()} == dict(df_of)


def test_hashed_features_follow_the_floor(spark):
    _, feats = fit_features(daily(spark, ["solo word", "pair x", "pair y"]), CFG)
    by_text = {r.query_text: r.features for r in feats.collect()}
    assert not by_text["solo word"].toArray().any()
    _, plain = fit_features(daily(spark, ["solo word", "pair x", "pair y"]), simple_config(CFG))
    assert all(r.features.toArray().any() for r in plain.collect())
    assert "filtered_words" not in plain.columns


@pytest.mark.parametrize("n,k", [(10, 10), (9, 4), (5, 2), (3, 2), (1, 2), (11, 10)])
def test_cluster_count_rule(spark, n, k):
    assert cluster.choose_k(n, 10) == k
    assert spark.range(1).select(cluster.choose_k_column(F.lit(n), 10).alias("k")).head().k == k


def test_clustering_invariants(spark):
    df = daily(spark, TEXTS, per_text=2)
    out = cluster.cluster_queries(df, "run", replace(CFG, cluster_count=3))
    got = out.rows.collect()
    assert len(got) == 12 and out.k == 3 and out.cost >= 0
    assert {r.cluster_count for r in got} == {3} and {r.processing_timestamp for r in got} == {"run"}
    of_text = {}
    for r in got:
        of_text.setdefault(r.query_text, set()).add(r.cluster_id)
    assert all(len(v) == 1 for v in of_text.values())
    assert sum(r.cluster_size for r in cluster.cluster_sizes(out.rows).collect()) == 12


def test_same_seed_same_clusters_whatever_the_layout(spark):
    df = daily(spark, TEXTS, per_text=2)
    first = cluster.cluster_queries(df, "run", replace(CFG, cluster_count=3))
    second = cluster.cluster_queries(df.orderBy(F.rand(1)).repartition(3), "run", replace(CFG, cluster_count=3))
    assert sorted(rows(first.rows)) == sorted(rows(second.rows)) and first.cost == pytest.approx(second.cost)


def test_cost_is_that_of_the_final_centres(spark):
    # one iteration: the summary's cost is still that of the starting centres
    words, pick = "red blue green tea sky apple pie cake day night leaf cup".split(), random.Random(0)
    texts = sorted({" ".join(pick.sample(words, 3)) for _ in range(30)})
    out = cluster.cluster_queries(daily(spark, texts), "run", replace(CFG, cluster_count=3, max_iterations=1))
    centres = [c.tolist() for c in out.model.clusterCenters()]
    x = {r.query_text: r.features.toArray().tolist() for r in out.features.transform(daily(spark, texts)).collect()}
    want = sum(sum((a - b) ** 2 for a, b in zip(x[r.query_text], centres[r.cluster_id])) for r in out.rows.collect())
    assert out.cost == pytest.approx(want, rel=1e-9)


def test_fewer_vectors_than_clusters(spark):
    out = cluster.cluster_queries(daily(spark, ["pair x", "pair x y", "pair y"], per_text=5), "run", CFG)
    assert out.k <= 3 and out.rows.count() == 15


def test_one_distinct_text_needs_no_fit(spark):
    out = cluster.cluster_queries(daily(spark, ["same words"], per_text=12), "run", CFG)
    assert out.model is None and out.k == 1
    assert {r.cluster_id for r in out.rows.collect()} == {0}


def test_only_stop_words(spark):
    out = cluster.cluster_queries(daily(spark, ["the and of", "to the"], per_text=6), "run", CFG)
    assert {r.cluster_id for r in out.rows.collect()} == {0}


def test_nothing_left_to_cluster(spark):
    with pytest.raises(cluster.NoRecentQueries):
        cluster.cluster_queries(daily(spark, ["x"]).where("query_count > 1000"), "run", CFG)


def test_group_stats(spark):
    data = [(i % 2, f"q{i % 7}", i) for i in range(100)]
    df = spark.createDataFrame(data, "cluster_id int, query_text string, query_count long")
    stats = {r.cluster_id: r for r in cluster.group_stats(df, sample=3).collect()}
    evens = [n for c, _, n in data if c == 0]
    assert (stats[0].cluster_size, stats[0].total_queries, stats[0].avg_query_count) == (50, sum(evens), sum(evens) / 50)
    assert stats[0].sample_queries == ["q0", "q5", "q3"]


def test_a_null_group_keeps_its_sample(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("x", "c", 3)], "lang string, query_text string, query_count long")
    got = {r.lang: (r.cluster_size, r.sample_queries) for r in cluster.group_stats(df, "lang", sample=5).collect()}
    assert got == {None: (2, ["b", "a"]), "x": (1, ["c"])}


def test_documents_are_tokenised_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, query_text string")
    weighted = term_tfidf(docs, "doc_id")
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("split") == 0
    got = {(r.doc_id, r.term): (r.tf, r.doc_freq) for r in weighted.collect() if r.term}
    assert got == {(1, "a"): (2, 1), (1, "b"): (1, 2), (2, "b"): (1, 2), (2, "c"): (1, 1)}


def test_counted_terms_are_read_back_as_parquet_not_a_checkpoint(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, query_text string")
    weighted = term_tfidf(docs, "doc_id")
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2
    assert {(r.doc_id, r.term): r.tf for r in weighted.collect()} == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1, (2, "c"): 1}


def test_term_counts_per_row_match_a_counter(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("a b c dd é a\tb".split(" ")) for _ in range(rng.randrange(0, 40))) for _ in range(30)] + ["", None, " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, query_text string")
    got = {(r.doc_id, r.term): r.tf for r in term_tfidf(docs, "doc_id").collect()}
    want = {(i, term): tf for i, text in enumerate(texts) for term, tf in Counter((text or "").lower().split()).items()}
    assert got == want
