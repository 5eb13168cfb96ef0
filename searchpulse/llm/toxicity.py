"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its distinct
words (the word itself and its first four and five characters); the document's score is
their noisy-or, 1 - prod(1 - p). Only document labels are known, so the gradient of
the document's likelihood is what teaches the sentence scores, and afterwards the
sentence scores tell where the offence is.

The model is fitted on a bounded sample of labelled documents (``max_docs``, taken in
the order of a hash of the id) and a vocabulary of at most ``max_features`` features
chosen there by how unevenly they occur; every document is then scored whole.

Edge cases: null and empty texts are one sentence without words; labels that are
null or without a document teach nothing; of repeated labels of an id the largest
counts; repeated rows are scored each; without a document of either label every
score is 0; of features with the same weight the smaller text is chosen; an empty table gives
no rows; very long texts are scored whole; only the id, the text and the label are read, so other
columns' names may clash. Label, language, source and id are never inputs of a score.
The bound on features is one on the model that is broadcast, as the sample's is on the fit: it cuts no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchpulse.llm.common import by_bytes, give_back, share, stored

MAX_DOCS = 12_000
MAX_FEATURES = 3_000
MIN_DOCS = 6
PREFIXES = (4, 5)
THRESHOLD = 0.3
#: Bytes of text that are scored together.
TEXT_BYTES = 2 << 20

# A-Z lower-cased; full stop, ! and ? end a sentence like a line feed; other ASCII characters divide words.
SENTENCE_BYTES = bytes(
    10 if b in b".!?\n" else b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def features_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked so that they differ from words."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def sentences(texts: list[str | None]):
    """Parts of a batch of texts: distinct words, word numbers, word borders of each sentence, sentence borders of each text, byte borders."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [t.encode().translate(SENTENCE_BYTES) if t else b"" for t in texts]
    parts = pc.split_pattern(pa.array(plain, pa.large_binary()).cast(pa.large_string()), "\n")
    flat = parts.flatten()
    words = pc.ascii_split_whitespace(flat)
    coded = words.flatten().dictionary_encode()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), words.offsets.to_numpy(), parts.offsets.to_numpy(), np.asarray(lengths)


def _sums(values, borders):
    """Sums of ``values`` between consecutive borders."""
    import numpy as np

    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[borders[1:]] - total[borders[:-1]]


def sentence_logits(texts: list[str | None], weights: dict[str, float], bias: float):
    """Logit and number of words of each sentence, with sentence borders of each text and sentence lengths in bytes."""
    import numpy as np

    words, index, word_borders, text_borders, lengths = sentences(texts)
    get = weights.get
    of_word = np.array([sum(get(f, 0.0) for f in features_of(w)) if w else 0.0 for w in words], np.float64)
    real = np.array([w != "" for w in words], np.float64)
    # each distinct word of a sentence speaks once, however often it is repeated
    n = len(word_borders) - 1
    sentence = np.repeat(np.arange(n), np.diff(word_borders))
    place, word = np.divmod(np.unique(sentence * max(1, len(words)) + index), max(1, len(words)))
    logits = bias + np.bincount(place, of_word[word], n)
    return logits, np.bincount(place, real[word], n), text_borders, lengths


def noisy_or(logits, n_words, borders):
    """Document scores; sentences without words count only where there is no other."""
    import numpy as np

    loss = np.where(n_words > 0, np.logaddexp(0, logits), 0.0)
    bags = _sums(loss, borders)
    empty = _sums(n_words, borders) == 0
    first = np.logaddexp(0, logits[borders[:-1]])
    return -np.expm1(-np.where(empty, first, bags))


def fit_noisy_or(labels, bags, sentences_of, features, n_features: int, steps: int = 200, rate: float = 0.08, decay: float = 1e-4):
    """Weights and bias from documents (label, sentences) and sentences (features), by Adam on the bags' likelihood.

    ``bags`` numbers the document of each sentence, ``sentences_of`` the sentence of
    each feature occurrence and ``features`` the feature.
    """
    import numpy as np

    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    share = min(max(labels.mean(), 1e-3), 0.999)
    w[-1] = np.log(share / max(1.0, len(bags) / len(labels)))
    n = len(labels)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sentences_of, w[features], len(bags))
        bag = np.maximum(np.bincount(bags, np.logaddexp(0, z), n), 1e-9)
        of_bag = (1 - labels) - labels * np.exp(-bag) / -np.expm1(-bag)
        of_sentence = of_bag[bags] / (1 + np.exp(-z))
        g = np.append(np.bincount(features, of_sentence[sentences_of], n_features), of_sentence.sum()) / n
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, max_docs: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text and label of at most ``max_docs`` labelled documents among those ``train`` selects."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train)
    known = known.groupBy(id_col).agg(F.max(F.col(label_col)).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return stored(rows.join(F.broadcast(chosen), id_col).select("text", F.col("_label").alias("label"), F.xxhash64(id_col).alias("place")), "labelled")


def learn(sample: DataFrame, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> tuple[dict[str, float], float]:
    """Weights of the chosen features and the bias, from a bounded sample of (text, label)."""
    import numpy as np
    import pyarrow as pa

    counts = dict(sample.groupBy("label").count().collect())
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    if not positive or not negative:
        return {}, -1e9

    def occurring(batches):
        from collections import Counter

        with_label: tuple = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns)):
                words = set((text or "").encode().translate(SENTENCE_BYTES).decode().split())
                with_label[label].update({f for w in words for f in features_of(w)})
        found = list(with_label[0].keys() | with_label[1].keys())
        rows = [pa.array(found, pa.string()), *(pa.array([c[f] for f in found], pa.int64()) for c in with_label)]
        yield pa.RecordBatch.from_arrays(rows, ["feature", "n0", "n1"])

    seen = sample.select("text", "label").mapInArrow(occurring, "feature string, n0 long, n1 long")
    seen = seen.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= min_docs)
    pooled = (F.col("n0") + F.col("n1")) / (positive + negative)
    gap = F.abs(F.col("n1") / positive - F.col("n0") / negative)
    weight = gap / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / positive + 1 / negative))
    chosen = [r[0] for r in seen.orderBy(weight.desc(), "feature").select("feature").limit(max_features).collect()]
    number = {f: i for i, f in enumerate(chosen)}

    def numbered(batches):
        get = number.get
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words, index, borders, _, _ = sentences([text])
                of_word = [[k for f in features_of(w) if (k := get(f)) is not None] for w in words]
                spans = [index[a:b] for a, b in zip(borders[:-1], borders[1:]) if b > a]
                out.append([[k for i in sorted(set(span.tolist())) for k in of_word[i]] for span in spans] or [[]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(out, pa.list_(pa.list_(pa.int32())))], ["label", "place", "sentences"]
            )

    rows = sample.select("text", "label", "place").mapInArrow(numbered, "label int, place long, sentences array<array<int>>")
    found = rows.orderBy("place").select("label", "sentences").toArrow().combine_chunks()  # numbers only, of a bounded sample
    labels = found.column(0).to_numpy().astype(np.float64)
    docs = found.column(1).combine_chunks()
    parts = docs.flatten()
    bags = np.repeat(np.arange(len(docs), dtype=np.int32), docs.value_lengths().to_numpy())
    owners = np.repeat(np.arange(len(parts), dtype=np.int32), parts.value_lengths().to_numpy())
    w, bias = fit_noisy_or(labels, bags, owners, parts.flatten().to_numpy(), len(chosen))
    return {f: float(x) for f, x in zip(chosen, w)}, bias


SCORE_SCHEMA = "score double, worst_sentence int, offending array<struct<start: int, end: int, probability: double>>"


def score_documents(docs: DataFrame, model: tuple[dict[str, float], float], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``SCORE_SCHEMA`` of every document; sentences at or above the threshold are located by byte offsets."""
    import pyarrow as pa

    shared = share(docs.sparkSession, model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        import numpy as np

        weights, bias = shared()
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])
        for part in by_bytes(batches, 1, TEXT_BYTES, 1024):
            logits, n_words, borders, lengths = sentence_logits(part.column(1).to_pylist(), weights, bias)
            scores = noisy_or(logits, n_words, borders)
            p = np.where(n_words > 0, 1 / (1 + np.exp(-np.clip(logits, -700, 700))), 0.0)
            ends = np.cumsum(lengths + 1)
            worst, found = [], []
            for a, b in zip(borders[:-1], borders[1:]):
                shift = ends[a] - lengths[a] - 1
                worst.append(int(np.argmax(p[a:b])) if n_words[a:b].any() else None)
                found.append(
                    [
                        {"start": int(ends[s] - 1 - lengths[s] - shift), "end": int(ends[s] - 1 - shift), "probability": float(p[s])}
                        for s in (np.flatnonzero(p[a:b] >= threshold) + a)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.int32()), pa.array(found, pa.list_(span))],
                [id_col, "score", "worst_sentence", "offending"],
            )
        give_back()

    return docs.select(id_col, text_col).mapInArrow(score, f"{id_col} {id_type}, {SCORE_SCHEMA}")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents below the threshold with all their columns, from a model fitted on every labelled one the sample takes."""
    import pyarrow as pa

    model = learn(labelled_sample(docs, labels, F.lit(True), max_docs, id_col, text_col, "toxic"))
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def keep(batches):
        weights, bias = shared()
        for part in by_bytes(batches, at, TEXT_BYTES, 1024):
            logits, n_words, borders, _ = sentence_logits(part.column(at).to_pylist(), weights, bias)
            yield part.filter(pa.array(noisy_or(logits, n_words, borders) < threshold))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
