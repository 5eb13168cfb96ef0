"""The clustering's fit does not depend on the layout of its input or on the session."""

import random

from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.operators import cluster
from searchpulse.operators.features import idf_stage, term_stages
from searchpulse.plans.text_queries import query_docs


def assigned(df, **conf):
    found = cluster.cluster_queries(df, "run", TrendConfig(**conf), key=("doc_id",))
    return {r.doc_id: r.cluster_id for r in found.rows.select("doc_id", "cluster_id").collect()}, found


def test_same_clusters_in_any_layout(spark):
    docs = query_docs(spark, "/root/testdata/sf0.01").select("doc_id", "query_text", "query_count")
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts, order in ((4, "doc_id"), (64, "query_text"), (1, "query_count")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(assigned(docs.repartition(parts, F.rand(parts)).sortWithinPartitions(order))[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == 10


def test_rows_of_one_text_weigh_as_many(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.sample(words, 3)) for _ in range(40)]
    rows = [(i, texts[i % 40], 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, query_text string, query_count long")
    got, found = assigned(df, cluster_count=4)
    assert all(len({got[i] for i, t, _ in rows if t == text}) == 1 for text in texts)
    counted = found.features.transform(df)
    distinct, number = cluster.weighted_vectors(counted)
    assert number == distinct.count() <= 40 and distinct.agg(F.sum("weight")).head()[0] == 400
    assert distinct.rdd.getNumPartitions() == 1


def test_partitions_of_the_fit_follow_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(cluster, "VECTORS_IN_PARTITION", 10)
    df = spark.range(95).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("query_text"))
    from pyspark.ml import PipelineModel

    counted = PipelineModel(term_stages(TrendConfig(num_features=1 << 16))).transform(df)
    features = idf_stage(TrendConfig(min_doc_freq=0)).fit(counted).transform(counted)
    distinct, number = cluster.weighted_vectors(features)
    assert distinct.rdd.getNumPartitions() == -(-number // 10) >= 9
