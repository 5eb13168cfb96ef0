"""The operators over their whole tables, one named query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchpulse.llm import token_rollup as rollup
from searchpulse.llm.alignment import BROADCAST_PAIRS, align_texts, link_totals
from searchpulse.llm.ann import nearest
from searchpulse.llm.common import remainder_of_id, stored, table
from searchpulse.llm.decontaminate import find_contamination
from searchpulse.llm.license_scan import scan_licenses
from searchpulse.llm.lm_mixing import score_texts
from searchpulse.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digest
from searchpulse.llm.near_duplicates import near_duplicates
from searchpulse.llm.orc_tokens import token_digest, write_tokens
from searchpulse.llm.packing import pack_documents, piece_digest
from searchpulse.llm.rank_codec import decode_ids, encode_texts
from searchpulse.llm.registry import ORACLES, QUERIES, query
from searchpulse.llm.tokens import tokenizer_path
from searchpulse.llm.toxicity import MAX_DOCS, THRESHOLD, labelled_sample, learn, score_documents
from searchpulse.llm.url_filter import canonical_url, judge_urls
from searchpulse.session import work_dir

# Fixed rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS params
  FROM parts
), whole AS (
  SELECT *, CASE WHEN host <> '' THEN host || rtrim(path, '/') || CASE WHEN params = '' THEN '' ELSE '?' || params END END AS canonical,
         CASE
           WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
         END AS rule
  FROM named
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN coalesce(substr(md5(canonical), 1, 1) = '0', false) THEN 'block' ELSE 'allow' END AS verdict,
       canonical
FROM whole
"""


@query("op1_url_filter", _URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged. The tables hold no list of URLs, so the canonical URLs whose md5 starts with 0 are listed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.select(canonical_url(F.col("url")).alias("canonical"))
    listed = listed.where(F.substring(F.md5(F.col("canonical").cast("binary")), 1, 1) == "0")
    judged = judge_urls(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical")


_ROLLUP_SQL = r"""
WITH counted AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n1,
         len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS n2
  FROM documents
), kept AS (
  SELECT source, lang, CASE WHEN lang <> 'en' THEN 'words-2' ELSE 'words-1' END AS tokenizer,
         CASE WHEN lang <> 'en' THEN n2 ELSE n1 END AS n
  FROM counted WHERE n1 >= 50
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM kept GROUP BY ALL
"""


@query("op2_token_rollup", _ROLLUP_SQL)
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, the second of them committed twice.

    Batch 1 inserts every document under tokenizer version words-1 (runs between
    white space), batch 2 revises those not in English to words-2 (runs of letters
    and digits), batch 3 deletes those of fewer than 50 words.
    """
    text = F.coalesce("text", F.lit(""))
    counted = stored(
        table(spark, sf_dir, "documents").select(
            "source",
            "lang",
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n1"),
            F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n2"),
        ),
        "token-counts",
    )
    revised = F.col("lang") != "en"
    first, second = F.lit("words-1"), F.lit("words-2")

    def state(tokenizer, n):
        return ["source", "lang", tokenizer.alias("tokenizer"), n.alias("n_tokens")]

    def before(tokenizer, n):
        return [
            F.col("source").alias("old_source"),
            F.col("lang").alias("old_lang"),
            tokenizer.alias("old_tokenizer"),
            n.alias("old_n_tokens"),
        ]

    n1, n2, none, no_name = F.col("n1"), F.col("n2"), F.lit(None).cast("long"), F.lit(None).cast("string")
    insert = counted.select(F.lit("insert").alias("op"), *state(first, n1), *before(no_name, none))
    revise = counted.where(revised).select(F.lit("revise").alias("op"), *state(second, n2), *before(first, n1))
    now = F.when(revised, second).otherwise(first), F.when(revised, n2).otherwise(n1)
    delete = counted.where(n1 < 50).select(F.lit("delete").alias("op"), *state(no_name, none), *before(*now))
    root = work_dir(spark, "token-rollup")
    for batch_id, changes in [(1, insert), (2, revise), (2, revise), (3, delete)]:
        rollup.commit_batch(changes, root, batch_id, first=batch_id == 1)
    return rollup.totals(spark, root)


@query("op3_lm_mixing")
def lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, remainder_of_id("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


@query("op4_ann")
def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op5_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"], F.lit(" "), s["label"])).alias("spans"),
    )


@query("op6_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    taught = remainder_of_id("doc_id", 4) != 2
    model = learn(labelled_sample(docs, labels, taught, MAX_DOCS, "doc_id", "text", "toxic"))
    scored = score_documents(docs, model, THRESHOLD)
    return scored.select(
        "doc_id",
        (remainder_of_id("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "worst_sentence",
        F.size("offending").alias("n_offending"),
    )


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HITS_SQL = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM item)
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM item))
), met AS (
  SELECT doc_id, k, i, item_id FROM grams JOIN windows USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS place FROM (SELECT DISTINCT doc_id, k, i FROM met)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op7_decontaminate", _HITS_SQL)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return piece_digest(pack_documents(table(spark, sf_dir, "documents"), path, drops_blanks=True))


_GROUPS_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(2, len(w)) AS k, unnest(generate_series(1, len(w) - least(2, len(w)) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), both_ways AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM both_ways JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x
)
SELECT doc.doc_id AS doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id, doc.doc_id = min(y) AS kept
FROM reach LEFT JOIN size ON size.doc_id = reach.x JOIN doc ON doc.doc_id = reach.x GROUP BY doc.doc_id, n
"""


@query("op9_near_duplicates", _GROUPS_SQL)
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@query("op10_orc_tokens")
def orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{work_dir(spark, 'orc-tokens')}/ids"
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"))
    return token_digest(spark, out)


def aligned_digest(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Numbers of tokens, groups and links of each text, how usual its links are, and the digest of its groups."""
    aligned = align_texts(docs, path_a, path_b)
    totals = link_totals(aligned, broadcast_pairs)
    # the groups are digested before the join, so they are not shuffled
    own = aligned.select(
        "row", "doc_id", "n_a", "n_b", "n_groups",
        F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"),
    )
    none = F.lit(0).cast("long")
    return own.join(totals, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256"
    )


@query("op11_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

_FIELD_SQL = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in [*LEAF_COLUMNS[:-1], text]) + ")"


# the lowest bit of crc32, bit by bit
_EVEN_SQL = """(xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 1) & 1) = 0"""


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of trees of fanout three above ``leaves`` (scope, idx, h, n), level by level."""
    return f"""{name} AS (
  SELECT scope, 0 AS level, idx, h, n FROM {leaves}
  UNION ALL
  SELECT scope, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY scope, level, idx // 3, n
)"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """``start`` (row, scope, idx, n, h) hashed up its tree with the siblings' digests."""
    return f"""{name} AS (
  SELECT row, scope, 0 AS level, idx, n, h FROM {start}
  UNION ALL
  SELECT f.row, f.scope, f.level + 1, f.idx // 3, (f.n + 2) // 3,
         sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.h ELSE t.h END, '' ORDER BY t.idx))
  FROM {name} f JOIN {tree} t ON t.scope = f.scope AND t.level = f.level AND t.idx // 3 = f.idx // 3
  WHERE f.n > 1 GROUP BY f.row, f.scope, f.level, f.idx, f.n
)"""


def _siblings_sql(tree: str, rows: str) -> str:
    return f"""
  SELECT r.row, string_agg(t.h, '' ORDER BY t.level, t.idx) AS p
  FROM {rows} r JOIN {tree} t ON t.scope = r.scope AND t.idx // 3 = r.idx // CAST(pow(3, t.level + 1) AS BIGINT)
    AND t.idx <> r.idx // CAST(pow(3, t.level) AS BIGINT) AND t.n > 1
  GROUP BY r.row"""


_MERKLE_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS scope, {_leaf_sql("text")} AS h,
         CASE WHEN coalesce({_EVEN_SQL}, false) THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY scope) AS n,
         row_number() OVER (ORDER BY scope, doc_id NULLS FIRST, h) AS row
  FROM leaf
), {_tree_sql("tree", "placed")}, tops AS (
  SELECT scope AS source, '' AS scope, row_number() OVER (ORDER BY scope) - 1 AS idx, h, count(*) OVER () AS n FROM tree WHERE n = 1
), {_tree_sql("crown", "tops")}, changed AS (
  SELECT row, scope, idx, n, changed AS h FROM placed
), {_fold_sql("low", "tree", "changed")}, middle AS (
  SELECT l.row, '' AS scope, t.idx, t.n, l.h FROM low l JOIN tops t ON t.source = l.scope WHERE l.n = 1
), {_fold_sql("high", "crown", "middle")}, below AS ({_siblings_sql("tree", "placed")}
), above AS ({_siblings_sql("crown", "middle")}
), root AS (
  SELECT h FROM crown WHERE n = 1
)
SELECT doc_id, placed.h AS leaf, tops.h AS subroot, root.h AS root, sha256(coalesce(below.p, '') || coalesce(above.p, '')) AS proof_sha256,
       high.h AS folded_root, high.h = root.h AS verified
FROM placed JOIN tops ON tops.source = placed.scope CROSS JOIN root JOIN high ON high.row = placed.row AND high.n = 1
LEFT JOIN below ON below.row = placed.row LEFT JOIN above ON above.row = placed.row
"""


@query("op12_merkle", _MERKLE_SQL)
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, checked against a copy of which half has lost its line feeds."""
    docs = table(spark, sf_dir, "documents")
    lost = leaf_digest(*[F.col(c) for c in LEAF_COLUMNS[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle_manifest(docs, LEAF_COLUMNS, extra={"changed": F.when(remainder_of_id("doc_id", 2) == 0, lost)})
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.coalesce("_changed", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_rank_codec")
def rank_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
