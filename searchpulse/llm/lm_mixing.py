"""Language-model scores by online logistic context mixing.

A text is a sequence of words (A-Z lower-cased, between ASCII white space) and an
end mark. It is coded in binary decisions: frequent words and the marks by the path
of a Huffman tree, any other word by an escape mark and then the bits of its bytes.

Every decision is predicted by several tables of counts, each addressed by a hash of
a context and the decision's node: for words no context, the last word, the last two
and the last but one; for bytes the last zero to three bytes. The predictions are
mixed in the logistic domain by weights chosen by a gate (how much two of the contexts
have seen). The gates' first weights are fitted on all training texts, piece by piece with
each piece's own counts taken out of the tables, and averaged; from there the weights follow the document, after 32 decisions, then
64 and so on up to every 1024, and an adaptive map from mixed to observed probabilities
refines the result, so a document's score depends on what came before in it. Spelling has fixed weights, so a rare word costs
the same wherever it stands and is spelled once for the whole corpus.

The tables are summed over all training documents, in 64 bits: every word passes the
root of the tree, so one slot counts all of them. Their number of slots is a
parameter; the frequent words are at most ``HEAD`` and known by their counts. Rare
words are joined by shuffle, never collected.

Edge cases: a null text is empty and has the end mark alone; repeated rows are scored
each, and repeated ids row by row; a null id is no training document's complement
but trains; without training documents every count is 0; words of the same count are
ordered by their bytes; an empty table gives no rows; very long texts are whole, in one
task; only the id, the text and what ``trains`` names are read, so other columns' names may clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchpulse.llm.common import lowered, share, stored

#: Words that have a path of their own in the tree.
HEAD = 65_536
#: log2 of the slots of a table.
SLOT_BITS = 20
TABLES = 4
CHUNKS = 64
#: Decisions between two updates of a document's weights: few at its start, twice as many each time up to the second number.
FIRST_BLOCK, LAST_BLOCK = 32, 1024
RATE, MAP_RATE = 0.002, 0.5
GATES = 16
MAP_CELLS = 33
#: Distinct words a task counts before it passes them on.
COUNTED = 500_000
#: Bytes of text a task turns into decisions at once.
BATCH_BYTES = 1 << 20

#: Bounds of ``_bounded_sample``, which no longer fits the gates' first weights: all training texts and words do.
SAMPLE_TEXTS, SAMPLE_BYTES, SAMPLE_WORDS = 300, 2 << 20, 20_000

END, ESCAPE = 0, 1
LN10 = 2.302585092994046


class Code:
    """Paths of symbols as flat arrays of (node, bit)."""

    def __init__(self, nodes, bits, lengths):
        import numpy as np

        self.bits, self.lengths = bits, lengths
        self.mixed = ((nodes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)  # hashes of the nodes
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def huffman(cls, weights: list[int]) -> Code:
        import heapq

        import numpy as np

        n = len(weights)
        parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for made in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = made
            side[y] = 1
            heapq.heappush(heap, (a + b, made))
        nodes, bits, lengths = [], [], []
        for symbol in range(n):
            path = []
            at = symbol
            while at != 2 * n - 2:
                path.append((parent[at] - n, side[at]))
                at = parent[at]
            nodes += [p[0] for p in reversed(path)]
            bits += [p[1] for p in reversed(path)]
            lengths.append(len(path))
        return cls(np.array(nodes, np.uint64), np.array(bits, np.int8), np.array(lengths, np.int64))

    @classmethod
    def of_bytes(cls) -> Code:
        import numpy as np

        value = np.arange(256)[:, None]
        down = np.arange(8)
        nodes = (1 << down) | (value >> (8 - down))
        return cls(nodes.ravel().astype(np.uint64), ((value >> (7 - down)) & 1).ravel().astype(np.int8), np.full(256, 8))

    def decisions(self, symbols):
        """Hashes of the nodes and bits of a sequence of symbols, and the number of bits of each."""
        import numpy as np

        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[symbols] - (ends - sizes), sizes)
        return self.mixed[at], self.bits[at], sizes


def contexts(symbols, starts, depths: list[tuple[int, ...]]):
    """One 64-bit context per symbol for each depth: a hash of the symbols so far back in the same text."""
    import numpy as np

    n = len(symbols)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    back = {}
    for k in {k for depth in depths for k in depth}:
        before = np.zeros(n, np.uint64)
        before[k:] = symbols[: n - k].astype(np.uint64) + np.uint64(1) if k < n else 0
        before[since < k] = 0
        back[k] = before
    out = []
    for number, depth in enumerate(depths):
        h = np.full(n, number + 1, np.uint64)
        for k in depth:
            h = (h + back[k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out.append(h)
    return out


WORD_CONTEXTS = [(), (1,), (1, 2), (2,)]
BYTE_CONTEXTS = [(), (1,), (1, 2), (1, 2, 3)]


def slots(context, nodes, sizes):
    """Table slot of each decision, from 32 bits of its context's hash and its node's."""
    import numpy as np

    h = np.repeat((context ^ (context >> np.uint64(32))).astype(np.uint32), sizes)
    h += nodes
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h >>= np.uint32(32 - SLOT_BITS)
    return h.astype(np.int64)


def count_decisions(tables, code: Code, symbols, starts, depths) -> None:
    """Add the decisions of a sequence to ``tables`` (table, slot * 2 + bit)."""
    import numpy as np

    nodes, bits, sizes = code.decisions(symbols)
    for table, context in zip(tables, contexts(symbols, starts, depths)):
        at = slots(context, nodes, sizes)
        at <<= 1
        at += bits
        table += np.bincount(at, minlength=len(table))


def predictions(tables):
    """Summed counts as (stretched probability * 16, confidence 0 to 3) in single bytes."""
    import numpy as np

    counts = np.asarray(tables).reshape(TABLES, -1, 2).astype(np.float32)
    return predicted(counts[..., 0], counts[..., 1])


def predicted(zero, one):
    """``predictions`` of counts of zeros and ones as float32 arrays."""
    import numpy as np

    stretched = np.log((one + 0.3) / (zero + 0.3))
    total = zero + one
    confidence = (total > 0).astype(np.int8) + (total >= 4) + (total >= 16)
    return np.clip(np.round(stretched * 16), -127, 127).astype(np.int8), confidence.astype(np.int8)


def first_weights():
    """Weights of each gate before any adaptation: in proportion to what a table's context has seen."""
    import numpy as np

    w = np.empty((GATES, TABLES), np.float32)
    for gate in range(GATES):
        trust = np.array([1.0, gate // 4, gate % 4, 0.5], np.float32)
        w[gate] = 1.1 * trust / trust.sum()
    return w


def inputs_of(model, code: Code, symbols, starts, depths):
    """Predictions of all tables in the logistic domain, gates, bits and the number of bits of each symbol."""
    import numpy as np

    stretched, confidence = model
    nodes, bits, sizes = code.decisions(symbols)
    inputs = np.empty((TABLES, len(bits)), np.float32)
    gates = np.zeros(len(bits), np.int64)
    for k, context in enumerate(contexts(symbols, starts, depths)):
        at = slots(context, nodes, sizes)
        np.multiply(stretched[k][at], np.float32(1 / 16), out=inputs[k])
        if k in (1, 2):
            gates += confidence[k][at].astype(np.int64) * (4 if k == 1 else 1)
    return inputs, gates, bits, sizes


def fit_weights(tables, code: Code, symbols, starts, depths, steps: int = 60, rate: float = 0.05):
    """Weights of each gate learnt from some training sequences, and how many of their decisions each gate had.

    Their own counts are taken out of the tables first, as a text that is
    scored later need not have been counted.
    """
    import numpy as np

    nodes, bits, sizes = code.decisions(symbols)
    # each decision as one key of gate, bit and its inputs, sixteenths of single bytes: equal decisions
    # are fitted once, weighted by how often they occur
    key = bits.astype(np.int64) << 32
    gates = np.zeros(len(bits), np.int64)
    for k, context in enumerate(contexts(symbols, starts, depths)):
        # as ``inputs_of(predictions(tables - own counts))``, at the slots these decisions touch only
        at = slots(context, nodes, sizes)
        at <<= 1
        own = np.bincount(at + bits, minlength=len(tables[k]))
        counts = (tables[k][at] - own[at]).astype(np.float32), (tables[k][at + 1] - own[at + 1]).astype(np.float32)
        del at, own
        stretched, confidence = predicted(*counts)
        del counts
        key |= (stretched.astype(np.int64) + 128) << (24 - 8 * k)
        if k in (1, 2):
            gates += confidence.astype(np.int64) * (4 if k == 1 else 1)
    seen = np.bincount(gates, minlength=GATES)
    gates <<= 33
    key |= gates
    del gates, nodes
    key, times = np.unique(key, return_counts=True)
    x_of = np.stack([((key >> s) & 255) - 128 for s in (24, 16, 8, 0)], 1) / 16.0
    y, times, bounds = ((key >> 32) & 1).astype(np.float64), times.astype(np.float64), np.searchsorted(key >> 33, np.arange(GATES + 1))
    w = first_weights().astype(np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share_of_gate = np.maximum(seen, 1)[:, None]
    for step in range(1, steps + 1):
        g = np.zeros_like(w)
        for gate in np.flatnonzero(bounds[1:] > bounds[:-1]):
            a, b = bounds[gate], bounds[gate + 1]
            missed = y[a:b] - 1 / (1 + np.exp(-(x_of[a:b] @ w[gate])))
            g[gate] = (times[a:b] * missed) @ x_of[a:b]
        g /= share_of_gate
        m, v = 0.8 * m + 0.2 * g, 0.98 * v + 0.02 * g * g
        w += rate * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-4)
    return w.astype(np.float32), seen


def fitted_weights(parts: DataFrame, tables, code: Code, pieces, depths):
    """Weights of each gate learnt from every row of ``parts``.

    ``pieces(batch)`` gives (symbols, starts) of bounded pieces of an Arrow batch. Each task
    fits every piece of its rows, with the piece's own counts taken out, and the weights
    of all pieces are averaged per gate by its number of decisions in them; a gate
    without decisions keeps its first weights.
    """
    import numpy as np
    import pyarrow as pa

    sent = share(parts.sparkSession, (pa.compress(np.ascontiguousarray(tables).tobytes(), "zstd", asbytes=True), tables.shape, code))

    def fit(batches):
        packed, shape, code = sent()
        tables = np.frombuffer(pa.decompress(packed, 8 * math.prod(shape), "zstd", asbytes=True), np.int64).reshape(shape)
        for batch in batches:
            for symbols, starts in pieces(batch):
                if not len(starts):
                    continue
                w, seen = fit_weights(tables, code, symbols, starts, depths)
                gate, k = np.divmod(np.arange(GATES * TABLES), TABLES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gate, pa.int32()), pa.array(k, pa.int32()), pa.array(w.ravel().astype(np.float64) * seen[gate]), pa.array(seen[gate], pa.int64())],
                    ["gate", "k", "weighted", "n"],
                )

    summed = parts.mapInArrow(fit, "gate int, k int, weighted double, n long").groupBy("gate", "k").agg(F.sum("weighted"), F.sum("n"))
    w = first_weights()
    for gate, k, weighted, n in summed.collect():
        if n:
            w[gate, k] = weighted / n
    return w


def mix(model, first, code: Code, symbols, starts, depths, adapt: bool):
    """log10 probability of each sequence that begins at ``starts``, from the gates' ``first`` weights on."""
    import numpy as np

    inputs, gates, bits, sizes = inputs_of(model, code, symbols, starts, depths)
    bit_ends = np.concatenate(([0], np.cumsum(sizes)))
    n = len(starts)
    begin = bit_ends[starts]
    length = np.diff(np.append(begin, len(bits)))
    y = bits.astype(np.float32)

    def squash(x):
        return 1 / (1 + np.exp(-x))

    if not adapt:
        x = sum(first[:, k][gates] * inputs[k] for k in range(TABLES))
        p = np.clip(squash(x), 1e-5, 1 - 1e-5)
        cost = np.log(np.where(y > 0, p, 1 - p))
        return np.add.reduceat(cost.astype(np.float64), begin) / LN10 if n else np.zeros(0)

    weights = np.tile(first, (n, 1))
    cells = np.tile(squash((np.arange(MAP_CELLS, dtype=np.float32) - MAP_CELLS // 2) / 2), n)
    total = np.zeros(n)
    done, block = 0, FIRST_BLOCK
    while len(open_ := np.flatnonzero(length > done)):
        size = np.minimum(length[open_] - done, block)
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin[open_] + done - (ends - size), size)
        done, block = done + block, min(2 * block, LAST_BLOCK)
        owner = np.repeat(np.arange(len(open_)), size)
        of_block = (open_[:, None] * GATES + np.arange(GATES)).ravel()
        key = owner * GATES + gates[at]
        now, here, yb = weights[of_block], inputs[:, at], y[at]
        x = np.zeros(len(at), np.float32)
        for k in range(TABLES):
            x += now[:, k][key] * here[k]
        np.clip(x, -7.9, 7.9, out=x)
        p = squash(x)
        map_of_block = (open_[:, None] * MAP_CELLS + np.arange(MAP_CELLS)).ravel()
        cell = owner * MAP_CELLS + np.round(x * 2).astype(np.int64) + MAP_CELLS // 2
        mapped = cells[map_of_block]
        refined = np.clip(0.5 * (p + mapped[cell]), 1e-5, 1 - 1e-5)
        total[open_] += np.bincount(owner, np.log(np.where(yb > 0, refined, 1 - refined)), len(open_))
        missed = yb - p
        for k in range(TABLES):
            now[:, k] += RATE * np.bincount(key, missed * here[k], len(now)).astype(np.float32)
        weights[of_block] = now
        seen = np.bincount(cell, minlength=len(mapped))
        off = np.bincount(cell, yb, len(mapped)) - seen * mapped
        cells[map_of_block] = mapped + (MAP_RATE * off / (seen + 16)).astype(np.float32)
    return total / LN10


def text_words(column):
    """(words, borders of each text) of an Arrow string column."""
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(lowered(column))
    return parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def document_symbols(column, head):
    """Words, their mask of non-empty ones and text numbers, symbols with end marks, and the start of each text."""
    import numpy as np
    import pyarrow.compute as pc

    words, borders = text_words(column)
    of_text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    words, of_text = words.filter(real), of_text[real]
    found = pc.index_in(words, value_set=head)
    number = pc.fill_null(found, ESCAPE - 2).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    per_text = np.bincount(of_text, minlength=len(borders) - 1)
    symbols = np.full(len(words) + len(per_text), END, np.int64)
    symbols[np.arange(len(words)) + of_text] = number
    starts = np.cumsum(per_text + 1) - (per_text + 1)
    return words, of_text, number, symbols, starts, per_text


def slices(batch, text_at: int):
    """A batch in slices of about ``BATCH_BYTES`` of text."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of all words of ``docs`` (text)."""
    import pyarrow as pa

    def count(batches):
        from collections import Counter

        seen: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], ["word", "c"]
            )
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update((text or "").encode().lower().split())
                if len(seen) > COUNTED:
                    yield from flush()
        if seen:
            yield from flush()

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _chunks(tables):
    """The tables in compressed pieces, those without counts left out."""
    import numpy as np
    import pyarrow as pa

    rows = []
    for k, table in enumerate(tables):
        for c, piece in enumerate(table.reshape(CHUNKS, -1)):
            if piece.any():
                rows.append((k * CHUNKS + c, pa.compress(np.ascontiguousarray(piece).tobytes(), "zstd", asbytes=True)))
    keys, blobs = zip(*rows) if rows else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["piece", "counts"])


def summed_tables(parts: DataFrame):
    """Sums of the pieces (piece, counts) of all tasks, as one array (table, slot * 2 + bit).

    Pieces are summed as they stream through the task they are dealt to; the result
    has the fixed size of the tables.
    """
    import numpy as np
    import pyarrow as pa

    width = (2 << SLOT_BITS) // CHUNKS

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(pa.decompress(blob, 8 * width, "zstd", asbytes=True), np.int64)
                held[piece] = held[piece] + counts if piece in held else counts
        blobs = [pa.compress(v.tobytes(), "zstd", asbytes=True) for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(blobs, pa.binary())], ["piece", "counts"])

    dealt = parts.repartition("piece").mapInArrow(add, parts.schema)
    out = np.zeros((TABLES * CHUNKS, width), np.int64)
    for piece, blob in dealt.toLocalIterator():
        out[piece] = np.frombuffer(pa.decompress(bytes(blob), 8 * width, "zstd", asbytes=True), np.int64)
    return out.reshape(TABLES, -1)


PIECE_SCHEMA = "piece int, counts binary"
SCORED_SCHEMA = (
    "row long, n_words long, head_known long, head_base double, head_score double, n_bytes long, "
    "rare array<struct<word: string, n: int>>"
)


def _bounded_sample(taught: DataFrame) -> DataFrame:
    """At most ``SAMPLE_TEXTS`` texts of at most ``SAMPLE_BYTES`` together, in order of their ids' hashes; longer ones fit no weights."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    few = taught.where(size <= SAMPLE_BYTES // 4).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_TEXTS)
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("text")


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD) -> DataFrame:
    """One row per document: id, trains, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``trains`` selects the documents that are learnt from; all are scored.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    taught = source.where("trains")
    counts = stored(word_counts(taught), "word-counts")
    n_docs = taught.count()
    totals = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).head()
    n_tokens, n_distinct = totals[1] + n_docs, totals[0] + (n_docs > 0)
    space = n_tokens + n_distinct + 1

    # the words above the count at which at most ``head_size`` are left
    levels = counts.groupBy("c").count().orderBy(F.desc("c")).limit(head_size + 1).collect()
    floor, taken = (levels[0]["c"] + 1 if levels else 1), 0
    for level in levels:
        taken += level["count"]
        if taken > head_size:
            break
        floor = level["c"]
    frequent = counts.where(F.col("c") >= floor).orderBy(F.desc("c"), "word").collect()
    head_counts = [r["c"] for r in frequent]
    rare_tokens = totals[1] - sum(head_counts)
    code = Code.huffman([max(1, n_docs), rare_tokens + 1, *head_counts])
    shared = share(spark, (code, [r["word"] for r in frequent], head_counts))

    def train(batches):
        code, words, _ = shared()
        head, tables = pa.array(words, pa.large_string()), np.zeros((TABLES, 2 << SLOT_BITS), np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                _, _, _, symbols, starts, _ = document_symbols(part.column(0), head)
                count_decisions(tables, code, symbols, starts, WORD_CONTEXTS)
        yield from _chunks(tables)

    tables = summed_tables(taught.select("text").mapInArrow(train, PIECE_SCHEMA))

    def word_pieces(batch):
        head = pa.array(shared()[1], pa.large_string())
        for part in slices(batch, 0):
            yield document_symbols(part.column(0), head)[3:5]

    first = fitted_weights(taught.select("text"), tables, code, word_pieces, WORD_CONTEXTS)
    words_model = share(spark, (predictions(tables), first))
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        from pyspark import TaskContext

        code, words, known = shared()
        (model, first), head = words_model(), pa.array(words, pa.large_string())
        base_of = np.log10((np.array([n_docs, -1, *known], np.float64) + 1).clip(1) / space)
        base_of[ESCAPE] = 0.0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1):
                words, of_text, number, symbols, starts, per_text = document_symbols(part.column(1), head)
                n = part.num_rows
                scores = mix(model, first, code, symbols, starts, WORD_CONTEXTS, adapt=True)
                ends = np.append(starts[1:], len(symbols))
                sums = np.concatenate(([0.0], np.cumsum(base_of[symbols])))
                rare = number == ESCAPE
                coded = words.filter(rare).dictionary_encode()
                width = max(1, len(coded.dictionary))
                pairs, times = np.unique(of_text[rare] * width + coded.indices.to_numpy(), return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(n + 1) * width).astype(np.int32)
                names = coded.dictionary.to_pylist()
                spelt = pa.array([names[i] for i in (pairs % width).tolist()], pa.string())
                lists = pa.StructArray.from_arrays([spelt, pa.array(times.tolist(), pa.int32())], ["word", "n"])
                lengths = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(row + np.arange(n)), pa.array(per_text, pa.int64()),
                        pa.array(np.bincount(of_text[~rare], minlength=n) + (n_docs > 0), pa.int64()),
                        pa.array(sums[ends] - sums[starts]), pa.array(scores), lengths,
                        pa.ListArray.from_arrays(pa.array(offsets), lists),
                    ],
                    ["id", "trains", *(c.split()[0] for c in SCORED_SCHEMA.split(", ")[:6]), "rare"],
                )
                row += n

    scored = stored(source.select("id", "text", "trains").mapInArrow(score, f"id {id_type}, trains boolean, {SCORED_SCHEMA}"), "scored")
    rare = scored.select("row", "trains", F.inline("rare"))
    words = stored(rare.groupBy("word").agg(F.sum(F.when(F.col("trains"), F.col("n")).otherwise(0)).alias("c")), "rare-words")
    spelled = _spelled(words).withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(space))))
    of_rare = rare.join(spelled, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.col("base")).alias("rare_base"),
        F.sum(F.col("n") * F.col("spelling")).alias("rare_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    whole = scored.drop("rare").join(of_rare, "row", "left")
    zero = F.lit(0.0)
    score_col = F.col("head_score") + F.coalesce("rare_score", zero)
    return whole.select(
        F.col("id").alias(id_col),
        "trains",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", zero)).alias("base_score"),
        score_col.alias("score"),
        F.when(F.col("n_bytes") > 0, -score_col * F.lit(LN10 / 0.6931471805599453) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _byte_symbols(column):
    """Bytes of each word and a blank behind it, with the start of each word."""
    import numpy as np

    raw = [w.encode() for w in column.to_pylist()]
    starts = np.cumsum([0, *(len(w) + 1 for w in raw)])[:-1]
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8).astype(np.int64), starts


def _spelled(words: DataFrame) -> DataFrame:
    """``words`` (word, c) with the log10 probability of the word's bytes, learnt from the distinct training words."""
    import numpy as np
    import pyarrow as pa

    spark = words.sparkSession
    code = share(spark, Code.of_bytes())
    at_once = 50_000

    def train(batches):
        loaded, tables = code(), np.zeros((TABLES, 2 << SLOT_BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                count_decisions(tables, loaded, *_byte_symbols(batch.column(0)[at : at + at_once]), BYTE_CONTEXTS)
        yield from _chunks(tables)

    learnt = words.where("c > 0").select("word").mapInArrow(train, PIECE_SCHEMA)
    tables = summed_tables(learnt)

    def byte_pieces(batch):
        for at in range(0, batch.num_rows, at_once):
            yield _byte_symbols(batch.column(0)[at : at + at_once])

    first = fitted_weights(words.where("c > 0").select("word"), tables, Code.of_bytes(), byte_pieces, BYTE_CONTEXTS)
    model = share(spark, (predictions(tables), first))

    def spell(batches):
        loaded, (tables, first) = code(), model()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                costs = mix(tables, first, loaded, *_byte_symbols(part.column(0)), BYTE_CONTEXTS, adapt=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(costs, pa.float64())], ["word", "c", "spelling"])

    return words.select("word", "c").mapInArrow(spell, "word string, c long, spelling double")
