"""The corpus operators against plain versions on small inputs with every awkward case."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from searchpulse.llm import ann, decontaminate, license_scan, lm_mixing, orc_tokens, packing, toxicity, url_filter
from searchpulse.llm import near_duplicates as near
from searchpulse.llm import token_rollup as rollup
from searchpulse.llm.components import components
from searchpulse.llm.queries import URL_RULES
from searchpulse.llm.tokens import Encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and model data train river stone cloud paper green window copper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ".", ","])) for _ in range(n))


def corpus():
    """Nulls, empty, blank and long texts, repeated rows, unusual white space, one huge source."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [None, "", " ", "\n\t ", "a", "A B", "x" * 5000, prose(rng, 20_000), "é ÉTÉ naïve\u00a0x  y\r\nz", "<|endoftext|> a"]
    texts += [texts[0]] * 5 + [texts[1].upper(), texts[2] + " tail"]
    rows = [(i, t, "en", "src0" if i % 3 else f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], None, None, None), (None, "alone " * 9, None, None, None), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns({"rank": F.lit(1), "score": F.lit("clash")}).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# 1: URLs


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM", "https://www.example.com/en/x?utm_source=a&b=1#f",
        "https://example.com/en/", "http://x.example.com/de", "http://b.net/es/q", "http://net/fr/", "http://b.net/es",
        "http://xnet/es/a", "http://a.org/p/?b=2&a=1", "http://a.org/p?a=1&b=2&ref=z", "ftp://a.org/p", "http://h?x://y"]


def test_urls_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("a.org/p?a=1&b=2",), (None,), ("zzz",)], "canonical string")
    for limit in (8 << 20, 0):
        got = {r.page_id: r for r in url_filter.judge_urls(df, listed, URL_RULES, broadcast_bytes=limit).collect()}
        assert len(got) == len(URLS)
        assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
        assert (got[4].host, got[4].path, got[4].rule) == ("a.example.com", "", None)
        assert (got[5].rule, got[5].verdict) == ("www.example.com/en/", "allow")
        assert (got[6].rule, got[6].verdict) == ("example.com/en/", "block")
        assert (got[7].rule, got[7].verdict) == ("com/", "allow")
        assert [got[i].rule for i in (8, 9, 10, 11)] == ["net/es/", "net/fr/", None, None]
        assert [got[i].verdict for i in (12, 13, 14)] == ["block", "block", "allow"]
        assert (got[15].host, got[15].path) == ("h", "")
    assert url_filter.judge_urls(df.where("false"), listed.where("false"), URL_RULES).count() == 0


def test_repeated_and_very_long_urls(spark):
    long = "http://a.org/" + "p" * 300_000
    df = spark.createDataFrame([(1, long), (2, long), (2, long), (3, "http://h." + "x" * 5000 + ".net/fr/")], "page_id long, url string").withColumns({"rule": F.lit(1), "verdict": F.lit(None).cast("int")})
    listed = spark.createDataFrame([("a.org/" + "p" * 300_000,)] * 3, "canonical string")
    got = url_filter.judge_urls(df, listed, URL_RULES).collect()
    assert sorted((r.page_id, len(r.path), r.rule, r.verdict) for r in got) == [(1, 300_001, None, "block"), (2, 300_001, None, "block"), (2, 300_001, None, "block"), (3, 4, "net/fr/", "block")]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    pages = spark.range(20_000).select("id", F.concat(F.lit("http://h/"), "id").alias("url"))
    judged = url_filter.judge_urls(pages, keys, [])
    assert judged.where("listed").count() == 5000 == judged.where("id < 5000 AND listed").count()
    assert judged.where("maybe_listed AND NOT listed").count() < 300


# 2: rollup


def test_rollup_batches_are_idempotent(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long"
    feed = lambda *rows: spark.createDataFrame(rows, schema)
    none = (None,) * 4
    first = feed(("insert", "a", "en", "t1", 10, *none), ("insert", "a", "en", "t1", 5, *none), ("insert", None, None, "t1", None, *none), ("odd", "a", "en", "t1", 9, *none))
    second = feed(("revise", "a", "en", "t2", 7, "a", "en", "t1", 5))
    third = feed(("delete", None, None, None, None, "a", "en", "t2", 7))
    root, packed = str(tmp_path / "r"), str(tmp_path / "c")
    rollup.commit_batch(first, root, 1, first=True)
    for _ in range(3):
        rollup.commit_batch(second, root, 2)
    got = lambda path: {tuple(r)[:3]: (r.n_docs, r.n_tokens) for r in rollup.totals(spark, path).collect()}
    assert got(root) == {("a", "en", "t1"): (1, 10), ("a", "en", "t2"): (1, 7), (None, None, "t1"): (1, 0)}
    rollup.compact(spark, root, packed, 1)
    assert got(packed) == got(root)
    with pytest.raises(rollup.BatchAlreadyFolded):
        rollup.commit_batch(second, packed, 1)
    rollup.commit_batch(third, packed, 3)
    rollup.commit_batch(first.where("false"), packed, 4)
    assert got(packed) == {("a", "en", "t1"): (1, 10), (None, None, "t1"): (1, 0)}


# 3: language model


def test_base_scores_match_brute_force(docs, none):
    rows = corpus()
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    words = [brute.words_between_blanks(t) + [None] for _, t, *_ in rows]
    taught = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in rows]
    counts = Counter(w for ws, t in zip(words, taught) if t for w in ws)
    total, space = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    want = sorted((len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / space) for w in ws), 6)) for ws in words)
    for head in (4, 65_536):
        got = lm_mixing.score_texts(docs, trains, head_size=head).collect()
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == total and r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_mixing.score_texts(none, trains).count() == 0
    untaught = lm_mixing.score_texts(docs, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.score < 0 for r in untaught)


def test_code_paths_are_a_prefix_code():
    code = lm_mixing.Code.huffman([5, 1, 1, 8, 3])
    paths = {"".join(map(str, code.bits[s : s + n])) for s, n in zip(code.starts, code.lengths)}
    assert sum(2.0 ** -len(p) for p in paths) == 1.0 and len(paths) == 5


def test_probabilities_of_all_next_symbols_sum_to_one():
    rng = np.random.default_rng(1)
    code = lm_mixing.Code.huffman(list(range(1, 30)))
    tables = np.zeros((lm_mixing.TABLES, 2 << lm_mixing.SLOT_BITS), np.int32)
    seen = rng.integers(0, 29, 4000)
    lm_mixing.count_decisions(tables, code, seen, np.array([0]), lm_mixing.WORD_CONTEXTS)
    model, first = lm_mixing.predictions(tables), lm_mixing.first_weights()
    prefix = seen[:700]
    before = lm_mixing.mix(model, first, code, prefix, np.array([0]), lm_mixing.WORD_CONTEXTS, True)[0]
    each = [
        lm_mixing.mix(model, first, code, np.append(prefix, s), np.array([0]), lm_mixing.WORD_CONTEXTS, True)[0] for s in range(29)
    ]
    assert sum(10 ** (e - before) for e in each) == pytest.approx(1.0, abs=1e-4)


def test_counts_above_32_bits(spark):
    tables = np.zeros((lm_mixing.TABLES, 2 << lm_mixing.SLOT_BITS), np.int64)
    tables[0, :4] = [2**31 - 1, 1, 0, 2**33]
    pieces = [tuple(r.values()) for batch in lm_mixing._chunks(tables) for r in batch.to_pylist()]
    parts = spark.createDataFrame([(p, bytearray(b)) for p, b in pieces * 2], lm_mixing.PIECE_SCHEMA)
    total = lm_mixing.summed_tables(parts)
    assert total[0, :4].tolist() == [2**32 - 2, 2, 0, 2**34] and total.sum() == 2 * tables.sum()
    code = lm_mixing.Code.huffman([1, 1])
    lm_mixing.count_decisions(total, code, np.array([0]), np.array([0]), lm_mixing.WORD_CONTEXTS)
    assert total.sum() == 2 * tables.sum() + lm_mixing.TABLES and total.min() == 0
    stretched, confidence = lm_mixing.predictions(total)
    assert stretched[0, :2].tolist() == [-127, 127] and confidence[0, :2].tolist() == [3, 3]


# 4: nearest neighbours


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    vectors = [(i, (centres[i % 8] + rng.normal(size=12) * 0.5).tolist()) for i in range(1500)]
    vectors += [(i, [1.0] * 12) for i in range(2000, 2100)]
    odd = [(3000, None), (3020, [0.0] * 12), (3040, [float("nan")] * 12), (3060, [1.0, None] + [0.0] * 10), (3080, [1.0, 2.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(vectors + odd + [vectors[0]], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.nearest(df, F.col("id") % 20 == 0, k=20, sample=500).toPandas()
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(set(got.query_id)) == queries
    for q, rows in got.sort_values("rank").groupby("query_id"):
        scores = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert list(rows["rank"]) == list(range(1, 21)) and q not in set(rows.vec_id) and rows.vec_id.is_unique
        hits += len(set(ids[order]) & set(rows.vec_id))
    assert hits / (20 * len(queries)) >= 0.9
    twins = got[got.query_id == 2000].sort_values("rank")
    assert list(twins.vec_id) == list(range(2001, 2021)) and set(twins.score) == {12.0}
    few = ann.nearest(df.where("vec_id < 5"), F.col("id") % 20 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3, 4]
    assert ann.nearest(df.where("false"), F.col("id") % 20 == 0).count() == 0


# 5: licences


LICENSED = [
    ("Licensed under the Apache License, Version 2.0.", "apache", {"apache", "apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", {"gpl", "gpl-3.0"}),
    ("Licensed under CC BY-NC 4.0.", "", {"cc-by-nc-4.0"}),
    ("the MIT\n license; mit,license", "mit", {"mit"}),
    ("permit license", "", set()),
    ("SPDX-License-Identifier: BSD-3-Clause", "", {"bsd-3-clause"}),
    ("GNU Lesser General Public License, version 2.1", "gpl", {"gpl", "lgpl-2.1"}),
    ("plain prose", "", set()),
    (None, "", set()),
    ("", "", set()),
]


def test_licences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LICENSED)], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, (text, base, labels) in enumerate(LICENSED):
        r = got[i]
        assert (r.base_labels, set(filter(None, r.labels.split(",")))) == (base, labels)
        words = brute.words_of_letters(text)
        assert r.n_words == len(words) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 1, 3)
    assert license_scan.scan_licenses(df.where("false")).count() == 0
    assert len(license_scan.build_rules()) > 300


WRAPPED = [
    ("GNU General Public\n * License, version 3", "gpl-3.0", "general public\n * license, version 3"),
    ("Mozilla Public\nLicense Version 2.0", "mpl-2.0", "mozilla public\nlicense version 2.0"),
    ("# Redistribution and\n# use in source and binary forms", "bsd", "redistribution and\n# use in source and binary forms"),
    ("Licensed  under the\r\n\t// Apache License,\r\n\t// Version 2.0", "apache-2.0", "licensed  under the\r\n\t// apache license,\r\n\t// version 2.0"),
    ("/* Creative   Commons */\n/* Attribution 4.0 */", "cc-by-4.0", "creative   commons */\n/* attribution 4.0"),
    ("All rights reserved. Neither the name of the\n;; owner nor the names of its\n;; contributors", "bsd-3-clause", "neither the name of the\n;; owner nor the names of its\n;; contributors"),
    ("is in the public\n\n  domain", "public-domain", "is in the public\n\n  domain"),
]


@pytest.mark.parametrize("text,label,span", WRAPPED)
def test_wrapped_and_commented_notices(text, label, span):
    rules = [(*rule[:5], re.compile(rule[5])) for rule in license_scan.build_rules()]
    row = license_scan.scan_text("é intro\n\n" + text + "\n * the end", rules)
    assert label in row[5].split(",") and row[6] > 0
    low = ("é intro\n\n" + text).lower()
    assert any(s["label"] == label and low[s["start"] : s["end"]].endswith(span) for s in row[7])


NAMED = [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2.0-or-later"}),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause", {"gpl-2.0-only", "bsd-3-clause"}),
    ("SPDX-License-Identifier: LGPL-2.1+ OR LicenseRef-Own", {"lgpl-2.1-or-later", "licenseref"}),
    ("see http://www.apache.org/licenses/LICENSE-2.0 for more", {"apache-2.0"}),
    ("https://www.gnu.org/licenses/old-licenses/gpl-2.0.html", {"gpl-2.0"}),
    ("https://opensource.org/licenses/BSD-3-Clause", {"bsd-3-clause"}),
    ("https://creativecommons.org/publicdomain/zero/1.0/", {"cc0-1.0"}),
    ("GNU GPL v2", {"gpl-2.0"}),
    ("GPL version 3", {"gpl-3.0"}),
    ("it is GPLv2+ code", {"gpl-2.0-or-later"}),
    ("BSD License", {"bsd"}),
    ("licensed under the LGPL", {"lgpl"}),
    ("MPL 2.0", {"mpl-2.0"}),
    ("either version 3 of the License, or\n * (at your option) any later version", {"gpl-3.0-or-later"}),
    ("Redistributions in binary form must reproduce the above copyright notice,", {"bsd"}),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", {"zlib"}),
    ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES', {"isc"}),
    ("The submit button and a commit; emails are no licence. The apache tribe, an epl match, a simple rule.", set()),
    ("the gplx file of version 3, an impl 2.0 and a simplex 1.1", set()),
]


@pytest.mark.parametrize("text,labels", NAMED)
def test_expressions_addresses_and_short_names(text, labels):
    rules = [(*rule[:5], re.compile(rule[5])) for rule in license_scan.build_rules()]
    assert set(filter(None, license_scan.scan_text(text, rules)[5].split(","))) == labels


def test_every_written_rule_finds_its_own_label():
    """Each rule in lists compiles and has a keyword that its matches hold; a gate word opens the text."""
    for label, pattern, keywords in license_scan.SENTENCES + license_scan.BODIES + [(a, b, [c]) for a, b, c in license_scan.ADDRESSES] + license_scan.SHORT:
        assert re.compile(pattern) and keywords and label
    assert len(license_scan.SENTENCES) + len(license_scan.BODIES) + len(license_scan.ADDRESSES) + len(license_scan.SHORT) + 87 > 200


def test_base_columns_match_brute_force(spark):
    rng = random.Random(12)
    bits = ["mit", "license", "apache", "general", "public", "MIT", "License", "the", "é", "licenses", "xmit"]
    texts = [rng.choice(["", ". ", "-"]).join([""]) + "".join(rng.choice(bits) + rng.choice([" ", "\n", "--", ", ", "."]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "license", "mit license " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"labels": F.lit("clash"), "spans": F.lit(1)})
    for r in license_scan.scan_licenses(df).collect():
        words = brute.words_of_letters(texts[r.doc_id])
        places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
                  for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))


def test_clause_behind_a_title_is_no_version():
    rules = [(*rule[:5], re.compile(rule[5])) for rule in license_scan.build_rules()]
    assert "apache-2.0" not in license_scan.scan_text("Apache License\n\n2. Grant of rights", rules)[5]


def test_contained_detections_are_suppressed():
    found = [(0, 10, 1, "a", 50, 0.5), (2, 8, 2, "b", 90, 0.9), (9, 20, 3, "c", 50, 0.5), (30, 40, 4, "d", 10, 0.1), (30, 40, 5, "e", 10, 0.1)]
    assert [d[3] for d in license_scan.resolve(found)] == ["b", "c", "d"]


# 6: toxicity


def toxic_rows():
    rng = random.Random(9)
    rows = []
    for i in range(600):
        lines = [prose(rng, 8) for _ in range(rng.randint(1, 12))]
        bad = i % 5 == 0
        if bad:
            lines[rng.randrange(len(lines))] += " you vile scumbag"
        rows.append((i, "\n".join(lines), int(bad)))
    return rows


def test_toxic_documents_and_their_sentences(spark, docs):
    rows = toxic_rows()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(df, labels, F.col("doc_id") % 4 != 2, 1000, "doc_id", "text", "toxic")
    model = toxicity.learn(sample)
    scored = {r.doc_id: r for r in toxicity.score_documents(df, model, 0.3).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert all((scored[i].score >= 0.3) == bool(y) for i, _, y in held)
    for i, text, y in held:
        if y:
            spans = [text.encode()[s.start : s.end] for s in scored[i].offending]
            assert any(b"scumbag" in s for s in spans)
    clean = toxicity.reject_toxic(df, labels)
    assert {r.doc_id for r in clean.collect()} == {i for i, _, y in rows if not y}
    every = toxicity.score_documents(docs, model, 0.3).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    untaught = toxicity.learn(sample.where("label = 0"))
    assert {r.score for r in toxicity.score_documents(docs, untaught, 0.3).collect()} == {0.0}
    assert toxicity.reject_toxic(docs.where("false"), labels).columns == docs.columns


def plain_noisy_or(text, weights, bias):
    """1 - prod(1 - p) over the sentences of a text, p logistic over each distinct word's features."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s) for s in re.split(r"[.!?\n]", low)]
    clean = 1.0
    for words in [p for p in parts if p] or [[]]:
        z = bias + sum(weights.get(f, 0.0) for w in set(words) for f in [w, *[f"{w[:n]}*" for n in (4, 5) if len(w) > n]])
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_match_a_plain_noisy_or(spark, docs):
    rng = random.Random(7)
    weights = {w: rng.uniform(-2, 2) for w in [*WORDS, "wate*", "modelx", "copp*", "windo*", "é", "ét"]}
    model = (weights, -3.0)
    scored = toxicity.score_documents(docs, model, 0.3).collect()
    of_id = {}
    for i, t, *_ in corpus():
        of_id.setdefault(i, []).append(plain_noisy_or(t, *model))
    got = {}
    for r in scored:
        got.setdefault(r.doc_id, []).append(r.score)
    assert {i: sorted(v) for i, v in got.items()} == {i: pytest.approx(sorted(v), abs=1e-9) for i, v in of_id.items()}


def test_fit_follows_the_gradient_of_the_likelihood():
    """The fitted weights are better than ones moved a little in any direction, up to the weight decay."""
    rng = np.random.default_rng(0)
    docs = [[rng.integers(0, 6, 3).tolist() for _ in range(rng.integers(1, 4))] for _ in range(400)]
    labels = np.array([float(any(0 in s for s in d) != (rng.random() < 0.1)) for d in docs])  # some wrong: the optimum is finite
    bags = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    parts = [sorted(set(s)) for d in docs for s in d]
    owners = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    features = np.concatenate(parts)
    w, bias = toxicity.fit_noisy_or(labels, bags, owners, features, 6, steps=1500, rate=0.05)

    def loss(w, bias):
        z = bias + np.bincount(owners, w[features], len(bags))
        bag = np.maximum(np.bincount(bags, np.logaddexp(0, z), len(docs)), 1e-9)
        return -np.mean(labels * np.log(-np.expm1(-bag)) - (1 - labels) * bag) + 0.5e-4 * (w**2).sum()

    best = loss(w, bias)
    for k in range(6):
        for step in (-0.5, 0.5):
            assert loss(w + step * (np.arange(6) == k), bias) > best - 1e-4
    assert loss(w, bias + 0.5) > best and loss(w, bias - 0.5) > best and w[0] == max(w)


# 7: decontamination


def test_hits_match_brute_force(spark):
    rng = random.Random(2)
    few = "a b c d".split()
    items = [(i, " ".join(rng.choice(few) for _ in range(n))) for i, n in enumerate([3, 10, 11, 14, 25, 1, 10, 12])]
    items += [(20, None), (21, ""), (22, "..."), (23, items[4][1])]
    texts = [" ".join(rng.choice(few + ["Q"] * (i % 2)) for _ in range(rng.randint(0, 90))) for i in range(60)]
    texts += [items[4][1].upper().replace(" ", ". "), "x " + items[2][1], None, "", "Zz " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_hit", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for short in (items, items[1:5] + items[6:]):
        kept = bench.where(F.col("item_id").isin([i for i, _ in short]))
        want = {i: brute.contamination(t, short) for i, t in enumerate(texts)}
        for size in (200_000, 20):
            got = decontaminate.find_contamination(docs, kept, words_per_automaton=size).collect()
            assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want
    assert not decontaminate.find_contamination(docs, bench.where("false")).where("contaminated").count()


def test_items_without_an_id_hit_but_are_not_named(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, f"{passage} twelve alpha beta gamma delta"), (3, "clean"), (None, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (7, "alpha beta gamma"), (None, None)], "item_id long, text string")
    for size in (200_000, 5):
        got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate.find_contamination(docs, bench, words_per_automaton=size).collect()}
        assert got == {1: (11, 0, [], True), 2: (14, 1, ["7"], True), 3: (0, 0, [], False), None: (11, 0, [], True)}
        cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, max_coverage=0.95, words_per_automaton=size).collect()}
        assert cut == {1: "before  after", 2: " twelve  delta", 3: "clean"}


def test_hits_match_their_sql_with_null_items(spark, tmp_path):
    import duckdb

    from searchpulse.llm import queries

    passage = "one two three four five six seven eight nine ten eleven"
    texts = [passage, passage + " x " + passage.upper(), "alpha beta", None, "", "gamma delta one two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, passage), (2, "alpha beta"), (None, "gamma"), (3, passage)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op7_decontaminate"])
    got = queries.decontaminate(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_passages_are_cut(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it: {passage.title()}! After that, more and more words follow here, as a text is mostly its own.", 9), (2, passage, 9), (3, "clean", 5), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("extra", F.lit(1))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert got[1].text == "Before it: ! After that, more and more words follow here, as a text is mostly its own." and got[1].n_chars == len(got[1].text)
    assert set(got) == {1, 3, 4} and got[3].text == "clean" and got[4].text is None


# 8 and 10: tokens


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_parts_have_the_library_ids(name, drops):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name), drops)
    texts = [r[1] for r in corpus()] + ["a.\nb, c.d e.. Hello, The's. x.", "a\nb\nc", ".", "\0a b", "é ́a", "ΑΣ a.", "a\x1c b", "|a | b|"]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


def test_sequences_hold_every_id_once(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    encoder = Encoder(path, True)
    pieces = packing.pack_documents(docs, path, True, max_segments=16).toPandas()
    sequences = pieces.groupby("sequence_id")
    for _, rows in sequences:
        rows = rows.sort_values("offset")
        assert list(rows.offset) == list(np.cumsum([0, *rows.length])[:-1])
        total = rows.length.sum()
        assert total <= 4096 and len(rows) <= 16 and (rows.sequence_length == total).all()
    padding = sum(4096 - n for n in sequences.length.sum() if n & (n - 1))
    assert padding < 0.05 * pieces.length.sum() + 4096
    once = {r[0]: encoder.encode([r[1]])[0] for r in corpus() if r[0] is not None and r[0] != 3}
    for key, rows in pieces[pieces.doc_id.notna() & (pieces.doc_id != 3)].groupby("doc_id"):
        rows, ids = rows.sort_values("start"), once[int(key)]
        assert list(rows.start) == list(np.cumsum([0, *rows.length])[:-1]) and rows.length.sum() == len(ids) // 4
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in rows.itertuples())
    assert packing.pack_documents(none, path, True).count() == 0


def test_tiny_documents_fill_their_sequences(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).repartition(2)
    sizes = packing.pack_documents(df, path, True).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r.n for r in sizes) == 36_000 and sum(4096 - r.n for r in sizes if r.n & (r.n - 1)) == 0
    assert max(r.k for r in sizes) > 1024
    pieces = packing.pack_documents(df, path, True, max_segments=100)
    assert pieces.groupBy("sequence_id").count().where("count > 100").count() == 0


def test_pool_and_parts_are_bounded_by_bytes():
    path = tokenizer_path("word_bpe_49k.json")
    packer = packing.Packer(64, 64, 64, 0)
    given = made = 0
    for i in range(400):
        ids = np.arange(3000, dtype="<u4").tobytes()
        given += 3000
        made += sum(p[2] for p in packer.add(i, ids))
        assert packer.held == given - made <= packing.POOL_TOKENS
    assert made + sum(p[2] for p in packer.finish()) == given and packer.held == 0
    small, plain = Encoder(path, True, parts_bytes=2000), Encoder(path, True)
    for at in range(0, 400, 40):
        texts = [f"word{i} other{i * 7} tail" for i in range(at, at + 40)]
        assert small.encode(texts) == plain.encode(texts)
    assert len(small.parts) < len(plain.parts)


def test_portions_are_bounded_by_bytes():
    import pyarrow as pa

    from searchpulse.llm.common import by_bytes

    texts = [None, "", "x" * 5, "y" * 50, "z", None, "w" * 9, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "t"])
    for limit in (1, 6, 10, 1000):
        parts = list(by_bytes([batch, batch.slice(0, 0)], 1, limit, 3))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or p.num_rows <= 3 and sum(len(t or "") for t in p.column(1).to_pylist()) <= limit for p in parts)


def test_pieces_hold_their_ids(spark, docs, tmp_path):
    import corpus_pipeline
    from searchpulse.llm import queries

    docs.where("doc_id > 3").write.parquet(str(tmp_path / "documents.parquet"))
    path = tokenizer_path("word_bpe_49k.json")
    once = {r[0]: np.frombuffer(Encoder(path, True).encode([r[1]])[0], "<i4").tolist() for r in corpus() if r[0] is not None}
    pieces = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {i for i in once if i > 3}
    assert all(r.ids == once[r.doc_id][r.start : r.start + r.length] for r in pieces)
    digests = queries.packing(spark, str(tmp_path))
    assert "ids" not in digests.columns
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in digests.collect()) == sorted(
        (r.doc_id, r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in pieces
    )


def test_loss_limit_and_prompts(spark):
    df = spark.createDataFrame([(i, "answer " * (5 + i % 40), "question " * 30) for i in range(300)], "doc_id long, text string, prompt string")
    pieces = packing.pack_documents(df, tokenizer_path("word_bpe_49k.json"), True, prompt_col="prompt", length=512, max_segments=8, max_loss=128)
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss"))
    assert sums.where("n > 512 OR k > 8 OR loss > 128").count() == 0
    assert pieces.agg(F.sum("loss_tokens")).head()[0] == sum(6 + i % 40 for i in range(300))


def test_orc_round_trip(spark, docs, none, tmp_path):
    path, out = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "orc")
    orc_tokens.write_tokens(docs, out, path)
    got = orc_tokens.token_digest(spark, out).orderBy("start").collect()
    encoder = Encoder(path, False)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (key, text, *_) in zip(got, rows, strict=True):
        ids = encoder.encode([text])[0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    assert [r.doc_id for r in orc_tokens.read_tokens(spark, out, doc_ids=[5]).collect()] == [5]
    orc_tokens.write_tokens(none, str(tmp_path / "none"), path)
    assert orc_tokens.token_digest(spark, str(tmp_path / "none")).count() == 0


# 9: near duplicates


@pytest.mark.parametrize("shingle_words", [1, 2, 5])
def test_groups_match_brute_force(spark, shingle_words):
    rng = random.Random(shingle_words)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    base = [f"v{i}" for i in range(100)]
    for i in range(80):  # one large group of near copies, some of them only linked through others
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[0].upper()] * 30 + [None, "", "  ", "a", "A", "a b", "a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    want = {i: (n, c) for i, (n, c) in brute.near_duplicates(rows, shingle_words, 80).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, shingle_words).collect()}
    assert got == want


def test_deduplicated_rows(docs, none):
    kept = near.deduplicate(docs)
    assert kept.columns == docs.columns and near.deduplicate(none).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and ids.count(0) == 1 and ids.count(None) == 1 and not {70, 71, 72, 73, 74, 75} & set(ids)
    assert {60, 61, 62, 63} <= set(ids)


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    rng = random.Random(6)
    long = [prose(rng, 80) for _ in range(5)]
    rows = [(1, long[0], "a"), (1, long[1], "b"), (1, long[1], "c"), (2, long[0] + " tail", "d"), (3, long[2], "e"), (4, None, "f"), (4, "", "g"), (None, long[3], "h"), (None, long[3] + " tail", "i"), (None, long[2], "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text or "", r.text is None) for r in near.deduplicate(df).collect())
    unnamed = [g for g in got if g[0] == 0]
    assert [g for g in got if g[0]] == sorted([(1, long[0], False), (1, long[1], False), (3, long[2], False), (4, "", True), (4, "", False)])
    assert len(unnamed) == 1 and unnamed[0][1].startswith(long[3])


def test_chains_become_one_component(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1002, 1001), (5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(n)} == {0} and {got[i] for i in (1000, 1001, 1002)} == {1000} and 5000 not in got


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 900).astype(np.uint64)
    rows = []
    for i in range(20):
        own = [np.append(both, rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(2)]
        rows.append([near.odd_sketch(near.minhash(s)).tolist() for s in own])
    df = spark.createDataFrame(rows, "x array<long>, y array<long>")
    mean = df.select(F.avg(near.estimated_similarity(near._differing([(F.col("x")[i], F.col("y")[i]) for i in range(near.SKETCH_WORDS)])))).head()[0]
    assert mean == pytest.approx(0.9, abs=0.03)


# pipeline


def test_pipeline_runs_over_a_table(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t, _ in toxic_rows()[:200]] + [(900, toxic_rows()[1][1], "en", "s", 1), (901, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows()[:200]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage in any of these documents at all today")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == {i for i, _, y in toxic_rows()[:200] if not y} | {901}


def test_pipeline_of_awkward_tables(spark, docs, tmp_path):
    """Null and repeated ids, null columns, extra columns, a document with a passage; then no documents at all."""
    import corpus_pipeline

    rng = random.Random(1)
    passage = prose(rng, 14)
    extra = spark.createDataFrame([(700, f"{prose(rng, 60)} {passage} {prose(rng, 60)}"), (60, "another text with the id of row sixty")], "doc_id long, text string")
    every = docs.unionByName(extra, allowMissingColumns=True)
    bench = [(None, passage), (2, None)]
    for name, table in (("full", every), ("none", every.where("false"))):
        base = tmp_path / name
        table.write.parquet(str(base / "documents.parquet"))
        spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "full"))
    whole = {(r.doc_id, r.ids[-1]) for r in found.select("doc_id", "ids").collect()}
    assert (None, 2) in whole and (700, 2) in whole and (60, 2) in whole
    encoder = Encoder(tokenizer_path("word_bpe_49k.json"), True)
    uncut = len(encoder.encode([extra.where("doc_id = 700").head().text])[0]) // 4
    assert found.where("doc_id = 700").agg(F.sum("length")).head()[0] <= uncut - 14
    assert found.where("doc_id = 60 AND start = 0").count() == 2
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
