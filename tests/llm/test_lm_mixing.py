"""The mixing against plain loops, spelling included, and against more text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchpulse.llm import lm_mixing as lm


def plain_counts(code, texts, depths):
    """{(table, slot): [zeros, ones]} of sequences of symbols, decision by decision."""
    counts = {}
    for text in texts:
        for table, slot, bit in decisions(code, text, depths):
            counts.setdefault((table, slot), [0, 0])[bit] += 1
    return counts


def decisions(code, text, depths):
    """(table, slot, bit) of every decision and table, in order."""
    symbols, start = np.array(text), np.array([0])
    nodes, bits, sizes = code.decisions(symbols)
    each = [lm.slots(c, nodes, sizes) for c in lm.contexts(symbols, start, depths)]
    return [(k, int(each[k][i]), int(bits[i])) for i in range(len(bits)) for k in range(len(depths))]


def plain_score(code, counts, first, text, depths, adapt):
    """log10 probability of one text by a loop over its decisions, the weights and the map moving after each block."""
    def look(table, slot):
        zero, one = counts.get((table, slot), (0, 0))
        stretched = max(-127, min(127, round(np.float32(math.log((one + 0.3) / (zero + 0.3))) * 16))) / 16
        return stretched, (zero + one > 0) + (zero + one >= 4) + (zero + one >= 16)

    rows = decisions(code, text, depths)
    w = [list(map(float, g)) for g in first]
    cells = [1 / (1 + math.exp(-(c - lm.MAP_CELLS // 2) / 2)) for c in range(lm.MAP_CELLS)]
    total, at, block = 0.0, 0, lm.FIRST_BLOCK
    n = len(rows) // lm.TABLES
    while at < n:
        moves, seen = [], {}
        for i in range(at, min(n, at + block)):
            found = [look(*rows[i * lm.TABLES + k][:2]) for k in range(lm.TABLES)]
            bit = rows[i * lm.TABLES][2]
            gate = found[1][1] * 4 + found[2][1]
            x = sum(w[gate][k] * found[k][0] for k in range(lm.TABLES))
            if adapt:
                x = max(-7.9, min(7.9, x))
            p = 1 / (1 + math.exp(-x))
            cell = round(x * 2) + lm.MAP_CELLS // 2 if adapt else 0
            q = 0.5 * (p + cells[cell]) if adapt else p
            q = max(1e-5, min(1 - 1e-5, q))
            total += math.log10(q if bit else 1 - q)
            moves.append((gate, bit - p, [f[0] for f in found]))
            seen.setdefault(cell, []).append(bit)
        if adapt:
            for gate, missed, inputs in moves:
                for k in range(lm.TABLES):
                    w[gate][k] += lm.RATE * missed * inputs[k]
            for cell, bits in seen.items():
                cells[cell] += lm.MAP_RATE * sum(b - cells[cell] for b in bits) / (len(bits) + 16)
        at, block = at + block, min(2 * block, lm.LAST_BLOCK)
    return total


@pytest.mark.parametrize("spelling", [False, True])
def test_mixing_matches_a_plain_loop(spelling):
    rng = np.random.default_rng(3)
    if spelling:
        code, depths = lm.Code.of_bytes(), lm.BYTE_CONTEXTS
        texts = [list(w.encode()) + [32] for w in ("stone", "stones", "é", "tone", "x", "stonestone" * 12)]
    else:
        code, depths = lm.Code.huffman(list(range(1, 40))), lm.WORD_CONTEXTS
        texts = [rng.integers(0, 39, n).tolist() for n in (1, 3, 40, 300, 900)] + [[5, 6, 7] * 60]
    tables = np.zeros((lm.TABLES, 2 << lm.SLOT_BITS), np.int64)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    symbols = np.concatenate(texts)
    lm.count_decisions(tables, code, symbols, starts, depths)
    counts = plain_counts(code, texts, depths)
    for (table, slot), pair in counts.items():
        assert tables[table, 2 * slot : 2 * slot + 2].tolist() == pair
    assert tables.sum() == sum(map(sum, counts.values()))
    first = lm.first_weights()
    got = lm.mix(lm.predictions(tables), first, code, symbols, starts, depths, adapt=not spelling)
    want = [plain_score(code, counts, first, t, depths, not spelling) for t in texts]
    assert got == pytest.approx(want, rel=2e-3, abs=2e-3)


def test_spellings_of_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(2)
    code = lm.Code.of_bytes()
    tables = np.zeros((lm.TABLES, 2 << lm.SLOT_BITS), np.int64)
    lm.count_decisions(tables, code, rng.integers(97, 110, 5000), np.array([0]), lm.BYTE_CONTEXTS)
    model, first = lm.predictions(tables), lm.first_weights()
    word = rng.integers(97, 110, 9)
    score = lambda s: lm.mix(model, first, code, s, np.array([0]), lm.BYTE_CONTEXTS, adapt=False)[0]
    assert sum(10 ** (score(np.append(word, b)) - score(word)) for b in range(256)) == pytest.approx(1.0, abs=1e-3)


def test_short_texts_adapt():
    """A text of fewer decisions than the largest block is helped by its own repetitions."""
    code = lm.Code.huffman(list(range(1, 40)))
    tables = np.zeros((lm.TABLES, 2 << lm.SLOT_BITS), np.int64)
    model, first = lm.predictions(tables), lm.first_weights()
    text = np.array([0] * 60)
    assert code.lengths[0] * 60 < lm.LAST_BLOCK
    adapted, static = (lm.mix(model, first, code, text, np.array([0]), lm.WORD_CONTEXTS, adapt)[0] for adapt in (True, False))
    assert adapted > static


def test_held_out_text_is_better_known_after_more_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 0
    few = docs.where(held | (F.col("doc_id") % 10 == 1))
    score = lambda df: lm.score_texts(df, F.col("doc_id") % 5 != 0).where("NOT trains").agg(F.sum("score") / F.sum("n_tokens")).head()[0]
    assert score(docs) > score(few) + 0.05


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_BYTES", 4000)
    df = spark.createDataFrame([(i, "word " * (10 if i % 3 else 5000)) for i in range(200)] + [(500, None)], "id long, text string")
    texts = [r.text or "" for r in lm._bounded_sample(df).collect()]
    assert 10 < len(texts) and sum(map(len, texts)) <= 4000


def test_first_weights_are_fitted_on_all_training_words(spark):
    import random

    import pyarrow as pa

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    symbols, starts = lm._byte_symbols(pa.array(words))
    code, tables = lm.Code.of_bytes(), np.zeros((lm.TABLES, 2 << lm.SLOT_BITS), np.int64)
    for _ in range(2):  # the words are counted twice, so that taking one fit's own counts out leaves some
        lm.count_decisions(tables, code, symbols, starts, lm.BYTE_CONTEXTS)
    whole = lm.fit_weights(tables, code, symbols, starts, lm.BYTE_CONTEXTS)[0]
    few = lm.fit_weights(tables, code, *lm._byte_symbols(pa.array(words[:300])), lm.BYTE_CONTEXTS)[0]
    df = spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)
    got = lm.fitted_weights(df, tables, code, lambda batch: [lm._byte_symbols(batch.column(0))], lm.BYTE_CONTEXTS)
    assert np.allclose(got, whole, atol=1e-5) and not np.allclose(got, few, atol=1e-3)


def test_fit_of_a_piece_reads_only_its_slots_and_fits_each_decision(monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(2000)]
    symbols, starts = lm._byte_symbols(pa.array(words))
    code, tables = lm.Code.of_bytes(), np.zeros((lm.TABLES, 2 << lm.SLOT_BITS), np.int64)
    for _ in range(3):
        lm.count_decisions(tables, code, symbols, starts, lm.BYTE_CONTEXTS)
    # a plain fit: predictions of whole tables without the piece's own counts, every decision a term of its own
    own = np.zeros_like(tables)
    lm.count_decisions(own, code, symbols, starts, lm.BYTE_CONTEXTS)
    inputs, gates, bits, _ = lm.inputs_of(lm.predictions(tables - own), code, symbols, starts, lm.BYTE_CONTEXTS)
    w = lm.first_weights().astype(np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share_of_gate = np.maximum(np.bincount(gates, minlength=lm.GATES), 1)[:, None]
    for step in range(1, 61):
        missed = bits - 1 / (1 + np.exp(-sum(w[:, k][gates] * inputs[k] for k in range(lm.TABLES))))
        g = np.stack([np.bincount(gates, missed * inputs[k], lm.GATES) for k in range(lm.TABLES)], 1) / share_of_gate
        m, v = 0.8 * m + 0.2 * g, 0.98 * v + 0.02 * g * g
        w += 0.05 * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-4)

    def whole_tables(_):
        raise AssertionError("a piece's fit turned the whole tables into predictions")

    monkeypatch.setattr(lm, "predictions", whole_tables)
    got, seen = lm.fit_weights(tables, code, symbols, starts, lm.BYTE_CONTEXTS)
    assert np.allclose(got, w, rtol=0, atol=1e-6) and (seen == np.bincount(gates, minlength=lm.GATES)).all()
