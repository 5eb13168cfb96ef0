"""Tokens, TF-IDF, clustering and labels over whole documents."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, StopWordsRemover, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from searchpulse.config import TrendConfig
from searchpulse.functions.text import tokens
from searchpulse.operators import cluster, label
from searchpulse.operators.consolidate import consolidate, recent_high_volume, write_by_date
from searchpulse.operators.features import fit_features, simple_config, term_idf, term_tfidf
from searchpulse.plans.daily import Tables, run_daily
from searchpulse.plans.registry import DAILY_SQL, query
from searchpulse.session import work_dir
from searchpulse.sources.fixtures import AS_OF, query_docs, search_log, table

RUN_TS = "2024-01-31T02:00:00"

# The default English stop words of Spark ML.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

# Keywords that occur in the bundled documents, for the offline labeller.
DOC_KEYWORDS = {
    "news": ["the", "that", "was"],
    "education": ["of", "and", "to"],
    "travel": ["le", "la", "les", "de"],
    "finance": ["der", "die", "und"],
    "sports": ["el", "los", "que"],
}

TOKENS_SQL = r"[w FOR w IN string_split_regex(lower(text), '[ \t\n\x0B\f\r]') IF w <> '']"
STOPS_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"

IDF_SQL = f"""
SELECT term, count(*) AS doc_freq,
       CASE WHEN count(*) >= 2 THEN ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) ELSE 0 END AS idf
FROM (SELECT unnest(list_distinct({TOKENS_SQL})) AS term FROM documents) GROUP BY term
"""

TOP_TEXTS_SQL = """
SELECT source, text, rn FROM (
  SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, text, doc_id) AS rn FROM documents)
WHERE rn <= 10
"""

LABELS_SQL = f"""
SELECT source, coalesce(category, 'other') AS category FROM (
  SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY hits DESC, category ASC NULLS LAST) AS rn
  FROM (
    SELECT source, category, count(category) AS hits
    FROM (SELECT source, unnest({TOKENS_SQL}) AS term FROM ({TOP_TEXTS_SQL})) t
    LEFT JOIN (VALUES {", ".join(f"('{w}', '{c}')" for c, ws in DOC_KEYWORDS.items() for w in ws)}) d(term, category) USING (term)
    GROUP BY source, category))
WHERE rn = 1
"""


@query("tokens", f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, array_to_string({TOKENS_SQL}, ' ') AS words FROM documents")
def tokens_query(spark, sf_dir):
    words = Tokenizer(inputCol="query_text", outputCol="words").transform(query_docs(spark, sf_dir))
    kept = F.filter("words", lambda w: w != "")
    return words.select("doc_id", F.size(kept).cast("long").alias("n_tokens"), F.array_join(kept, " ").alias("words"))


@query("tokens_no_stop", f"""
SELECT doc_id, len(words) AS n_tokens, array_to_string(words, ' ') AS words
FROM (SELECT doc_id, [w FOR w IN {TOKENS_SQL} IF NOT list_contains({STOPS_SQL}, w)] AS words FROM documents)
""")
def tokens_no_stop(spark, sf_dir):
    stages = [Tokenizer(inputCol="query_text", outputCol="words"), StopWordsRemover(inputCol="words", outputCol="filtered_words")]
    docs = query_docs(spark, sf_dir)
    words = Pipeline(stages=stages).fit(docs).transform(docs)
    kept = F.filter("filtered_words", lambda w: w != "")
    return words.select("doc_id", F.size(kept).cast("long").alias("n_tokens"), F.array_join(kept, " ").alias("words"))


def _non_zero(vector: str):
    return F.size(F.filter(vector_to_array(vector), lambda x: x != 0))


@query("tf_nnz", f"SELECT doc_id, len(list_distinct({TOKENS_SQL})) AS terms, len({TOKENS_SQL}) AS n_tokens FROM documents")
def tf_nnz(spark, sf_dir):
    """Filled buckets plus the terms that fell into a bucket already filled make up a text's distinct terms."""
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=1000)
    words = query_docs(spark, sf_dir).withColumn("words", tokens(F.col("query_text")))
    hashed = tf.transform(words).select("doc_id", _non_zero("tf").alias("nnz"), F.size("words").cast("long").alias("n_tokens"))
    terms = words.select("doc_id", F.explode(F.array_distinct("words")).alias("term"))
    one = tf.transform(terms.select("term").distinct().withColumn("words", F.array("term")))
    place = one.select("term", F.array_position(vector_to_array("tf"), 1.0).alias("place"))
    met = terms.join(place, "term").groupBy("doc_id").agg((F.count("*") - F.count_distinct("place")).alias("met"))
    both = hashed.join(met, "doc_id", "left")
    return both.select("doc_id", (F.col("nnz") + F.coalesce("met", F.lit(0))).alias("terms"), "n_tokens")


@query("tf_totals", f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens FROM documents")
def tf_totals(spark, sf_dir):
    """Hashing moves tokens into buckets but loses none."""
    words = query_docs(spark, sf_dir).withColumn("words", tokens(F.col("query_text")))
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=1000).transform(words)
    total = F.aggregate(vector_to_array("tf"), F.lit(0.0), lambda a, x: a + x)
    return hashed.select("doc_id", total.cast("long").alias("n_tokens"))


@query("features", f"SELECT doc_id, len([w FOR w IN {TOKENS_SQL} IF NOT list_contains({STOPS_SQL}, w)]) AS n_tokens, true AS weighted FROM documents")
def features(spark, sf_dir):
    """Hashed TF-IDF; each weight is compared with the one that the term counts of all vectors give."""
    _, rows = fit_features(query_docs(spark, sf_dir))
    pairs = rows.select("doc_id", vector_to_array("rawFeatures").alias("tf"), vector_to_array("features").alias("weight"))
    n_docs = pairs.agg(F.count("*")).scalar()
    filled = pairs.select("doc_id", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.size("tf") - 1).alias("slot"), "tf", "weight")))
    filled = filled.where("tf > 0")
    slots = filled.groupBy("slot").agg(F.count("*").alias("doc_freq"))
    idf = F.when(F.col("doc_freq") >= 2, F.log((n_docs + 1) / (F.col("doc_freq") + 1))).otherwise(0.0)
    checked = filled.join(slots, "slot")
    per_doc = checked.groupBy("doc_id").agg(
        F.sum("tf").cast("long").alias("n_tokens"), F.bool_and(F.abs(F.col("weight") - F.col("tf") * idf) < 1e-9).alias("weighted")
    )
    every = pairs.select("doc_id").join(per_doc, "doc_id", "left")
    return every.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("weighted", F.lit(True)).alias("weighted"))


@query("term_idf", f"SELECT term, doc_freq, round(idf, 9) AS idf FROM ({IDF_SQL})")
def term_idf_query(spark, sf_dir):
    return term_idf(query_docs(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query("term_tfidf", f"""
SELECT doc_id, term, tf, doc_freq, round(idf, 9) AS idf, round(tf * idf, 9) AS tfidf
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY doc_id, term)
JOIN ({IDF_SQL}) USING (term)
""")
def term_tfidf_query(spark, sf_dir):
    weighted = term_tfidf(query_docs(spark, sf_dir), "doc_id")
    return weighted.withColumns({"idf": F.round("idf", 9), "tfidf": F.round("tfidf", 9)})


def _clustered(spark, sf_dir, cfg=TrendConfig()):
    docs = query_docs(spark, sf_dir).select("doc_id", "query_text", "query_count")
    return cluster.cluster_queries(docs, RUN_TS, cfg, key=("doc_id",))


def _nearest_checked(spark, sf_dir, cfg):
    """Every row with whether its cluster's centre is the nearest of all to its own features."""
    import numpy as np

    found = _clustered(spark, sf_dir, cfg)
    centres = np.array(found.model.clusterCenters()) if found.model else np.zeros((1, cfg.num_features))
    weights = found.features.transform(query_docs(spark, sf_dir).select("doc_id", "query_text")).select(
        "doc_id", vector_to_array("features").alias("x")
    )

    def check(frames):
        for frame in frames:
            x = np.stack(frame["x"].to_list()) if len(frame) else np.zeros((0, centres.shape[1]))
            far = (centres**2).sum(1) - 2 * x @ centres.T
            own = far[np.arange(len(frame)), frame["cluster_id"].to_numpy()]
            yield frame[["doc_id", "query_count", "cluster_count"]].assign(nearest=own <= far.min(1) + 1e-6)

    rows = found.rows.select("doc_id", "query_count", "cluster_id", "cluster_count").join(weights, "doc_id")
    return rows.mapInPandas(check, "doc_id long, query_count long, cluster_count int, nearest boolean")


NEAREST_SQL = "SELECT doc_id, n_chars AS query_count, CAST(10 AS INTEGER) AS cluster_count, true AS nearest FROM documents"


@query("cluster_queries", NEAREST_SQL)
def cluster_queries(spark, sf_dir):
    return _nearest_checked(spark, sf_dir, TrendConfig())


@query("cluster_queries_simple", NEAREST_SQL)
def cluster_queries_simple(spark, sf_dir):
    return _nearest_checked(spark, sf_dir, simple_config())


@query("clustering_cost", "SELECT count(*) AS n_rows, CAST(10 AS INTEGER) AS k, true AS cost_agrees, true AS below_one_cluster FROM documents")
def clustering_cost(spark, sf_dir):
    """The fit's cost is the sum of squared distances to the centres, and below that of a single cluster."""
    import numpy as np

    found = _clustered(spark, sf_dir)
    centres = np.array(found.model.clusterCenters())
    weights = found.features.transform(query_docs(spark, sf_dir).select("doc_id", "query_text"))
    rows = found.rows.select("doc_id", "cluster_id").join(weights.select("doc_id", vector_to_array("features").alias("x")), "doc_id")

    def sums(frames):
        for frame in frames:
            x = np.stack(frame["x"].to_list()) if len(frame) else np.zeros((0, centres.shape[1]))
            apart = x - centres[frame["cluster_id"].to_numpy()]
            yield frame[["doc_id"]].assign(distance=(apart**2).sum(1), square=(x**2).sum(1))

    per_row = rows.mapInPandas(sums, "doc_id long, distance double, square double")
    # of one cluster the cost is the squares' sum less n times the square of the mean
    total = weights.select(Summarizer.mean(weights["features"]).alias("m")).head()[0]
    mean_square = float(total.dot(total))
    cost = F.lit(float(found.cost))
    return per_row.agg(
        F.count("*").alias("n_rows"),
        F.lit(found.k).alias("k"),
        (F.abs(F.sum("distance") - cost) <= 1e-6 * cost).alias("cost_agrees"),
        (cost < F.sum("square") - F.count("*") * mean_square).alias("below_one_cluster"),
    )


@query("cluster_invariants", """
SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total_queries, CAST(10 AS BIGINT) AS clusters,
       CAST(0 AS BIGINT) AS split_texts FROM documents
""")
def cluster_invariants(spark, sf_dir):
    """Every row is in one of ten clusters, and equal texts are together."""
    rows = _clustered(spark, sf_dir).rows
    per_text = rows.groupBy(F.sha2("query_text", 256).alias("digest")).agg(
        F.min("cluster_id").alias("low"),
        F.max("cluster_id").alias("high"),
        F.count("cluster_id").alias("n"),
        F.sum("query_count").alias("volume"),
    )
    return per_text.agg(
        F.sum("n").alias("n_rows"),
        F.sum("volume").alias("total_queries"),
        F.count_distinct("low").alias("clusters"),
        F.count_if(F.col("low") != F.col("high")).alias("split_texts"),
    )


@query("cluster_sizes", "SELECT count(DISTINCT 1 + doc_id % 10) AS clusters, count(*) AS n_rows, true AS all_filled FROM documents")
def cluster_sizes(spark, sf_dir):
    sizes = cluster.cluster_sizes(_clustered(spark, sf_dir).rows)
    return sizes.agg(
        F.count("*").alias("clusters"),
        F.sum("cluster_size").alias("n_rows"),
        (F.min("cluster_size") > 0).alias("all_filled"),
    )


@query("cluster_stats", """
SELECT CAST(10 AS BIGINT) AS clusters, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total_queries, true AS means_agree,
       max(n_chars) AS busiest FROM documents
""")
def cluster_stats(spark, sf_dir):
    """Statistics of the clusters as written; the busiest text leads the sample of its cluster."""
    path = work_dir(spark, "cluster-stats")
    rows = _clustered(spark, sf_dir).rows
    cluster.group_stats(rows, sample=10, order=("doc_id",)).write.parquet(path)
    first = F.element_at("sample_queries", 1)
    return spark.read.parquet(path).agg(
        F.count("*").alias("clusters"),
        F.sum("cluster_size").alias("n_rows"),
        F.sum("total_queries").alias("total_queries"),
        F.bool_and(F.abs(F.col("avg_query_count") * F.col("cluster_size") - F.col("total_queries")) < 1e-3).alias("means_agree"),
        F.max(F.char_length(first).cast("long")).alias("busiest"),
    )


@query("clustered_write", f"""
SELECT query_text, date, query_count, unique_users, round(avg_results_count, 9) AS avg_results_count, click_through_rate,
       true AS clustered, '{RUN_TS}' AS processing_timestamp
FROM ({DAILY_SQL}) WHERE date > DATE '{AS_OF}' - 7 AND query_count >= 5
""")
def clustered_write(spark, sf_dir):
    """Consolidate, filter, cluster and store by date; read the stored table back."""
    path = work_dir(spark, "clustered")
    daily = recent_high_volume(consolidate(search_log(spark, sf_dir)), AS_OF)
    write_by_date(cluster.cluster_queries(daily, RUN_TS).rows, path)
    stored = spark.read.parquet(path)
    valid = F.col("cluster_id").between(0, F.col("cluster_count") - 1)
    return stored.select(
        "query_text",
        "date",
        "query_count",
        "unique_users",
        F.round("avg_results_count", 9).alias("avg_results_count"),
        "click_through_rate",
        valid.alias("clustered"),
        "processing_timestamp",
    )


@query("daily_trends", f"""
SELECT date, query_text AS query, CAST(rank AS INTEGER) AS rank, query_count AS count, unique_users,
       CAST(round(click_through_rate, 3) AS DOUBLE) AS click_through_rate, CAST(0 AS BIGINT) AS misplaced
FROM (SELECT *, row_number() OVER (ORDER BY query_count DESC, query_text) AS rank
      FROM ({DAILY_SQL}) WHERE date = DATE '{AS_OF}' AND query_count >= 5) WHERE rank <= 5
""")
def daily_trends(spark, sf_dir):
    """The daily run with five queries per cluster.

    Whatever the clusters, the day's first five are in them; of all rows, those out
    of rank order, beyond the fifth of their cluster or unlike the log are counted.
    """
    tables = Tables(work_dir(spark, "daily"))
    items = run_daily(search_log(spark, sf_dir), tables, AS_OF, "2024-01-31 02:00:00")
    daily = consolidate(search_log(spark, sf_dir)).select(
        F.col("query_text").alias("query"), "date", F.col("query_count").alias("in_log")
    )
    by_rank, by_cluster = Window.partitionBy("date").orderBy("rank"), Window.partitionBy("date", "cluster_id").orderBy("rank")
    checked = items.join(daily, ["query", "date"], "left").withColumns(
        {"before": F.lag("count").over(by_rank), "in_cluster": F.row_number().over(by_cluster)}
    )
    wrong = ~F.coalesce(F.col("count") == F.col("in_log"), F.lit(False)) | (F.col("before") < F.col("count")) | (F.col("in_cluster") > 5)
    checked = checked.withColumn("misplaced", F.count_if(F.coalesce(wrong, F.lit(False))).over(Window.partitionBy("date")))
    shown = checked.where(F.col("rank") <= 5)
    return shown.select("date", "query", "rank", "count", "unique_users", "click_through_rate", "misplaced")


@query("daily_true_top", f"""
SELECT a.date, a.query_text AS query,
       CAST(row_number() OVER (ORDER BY a.query_count DESC, a.query_text) AS INTEGER) AS rank, a.query_count AS count,
       a.unique_users, 'other' AS category, CAST(round(a.click_through_rate, 3) AS DOUBLE) AS click_through_rate,
       (a.query_count - b.query_count) / b.query_count AS growth_rate
FROM ({DAILY_SQL}) a LEFT JOIN ({DAILY_SQL}) b ON b.query_text = a.query_text AND b.date = a.date - 1
WHERE a.date = DATE '{AS_OF}' AND a.query_count >= 5
QUALIFY rank <= 50
""")
def daily_true_top(spark, sf_dir):
    """The whole daily run, ranking all clustered queries: everything but the cluster number is determined."""
    tables = Tables(work_dir(spark, "daily"))
    cfg = TrendConfig(per_cluster=None, with_growth=True)
    stored = run_daily(search_log(spark, sf_dir), tables, AS_OF, "2024-01-31 02:00:00", cfg)
    return stored.select("date", "query", "rank", "count", "unique_users", "category", "click_through_rate", "growth_rate")


def _top_texts(spark, sf_dir):
    return label.top_texts(query_docs(spark, sf_dir), key="source", order=("doc_id",))


@query("label_clusters", LABELS_SQL)
def label_clusters(spark, sf_dir):
    return label.label_by_keywords(_top_texts(spark, sf_dir), DOC_KEYWORDS, key="source")


@query("label_clusters_injected", f"""
SELECT source, CASE WHEN max(length(text)) > 5000 THEN 'long texts' ELSE 'short texts' END AS category
FROM ({TOP_TEXTS_SQL}) GROUP BY source
""")
def label_clusters_injected(spark, sf_dir):
    """A Python labeller called once per cluster inside the tasks."""
    lists = label.text_lists(_top_texts(spark, sf_dir), key="source")
    return label.label_with(lists, lambda texts: " Long texts" if max(map(len, texts)) > 5000 else "SHORT texts ", key="source")


@query("label_prompt", f"""
SELECT source, md5('Analyze the following search queries and classify them into a single category.' || chr(10) ||
  'Choose from these categories: {", ".join(label.LABELS)}.' || chr(10) || chr(10) || 'Search queries:' || chr(10) ||
  string_agg('- ' || text, chr(10) ORDER BY rn) || chr(10) || chr(10) ||
  'Respond with only the category name, nothing else.') AS prompt
FROM ({TOP_TEXTS_SQL}) GROUP BY source
""")
def label_prompt(spark, sf_dir):
    lists = label.text_lists(_top_texts(spark, sf_dir), key="source")
    return lists.select("source", F.md5(label.label_prompt(F.col("texts"))).alias("prompt"))


@query("attach_labels", f"SELECT doc_id, source, coalesce(category, 'other') AS category FROM documents LEFT JOIN ({LABELS_SQL}) USING (source)")
def attach_labels(spark, sf_dir):
    labels = label.label_by_keywords(_top_texts(spark, sf_dir), DOC_KEYWORDS, key="source")
    docs = query_docs(spark, sf_dir).select("doc_id", "source")
    return label.attach_labels(docs, labels, key="source").select("doc_id", "source", "category")


@query("label_normalise", """
SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'other') AS category,
       coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'other') IN ('click', 'purchase', 'other') AS in_label_set
FROM events
""")
def label_normalise(spark, sf_dir):
    reply = F.when(F.col("event_type") != "view", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    raw = table(spark, sf_dir, "events").select("event_id", reply.alias("category"))
    return label.normalise_labels(raw, labels=["click", "purchase", "other"])
