"""Alignment of the token ids of two tokenizers over the same text.

A is a byte-level vocabulary of the ``tokenizers`` library, B a sentencepiece model,
which puts a space before every text; so A reads the text behind a space too. A text
is tokenised in full by both. Where a token ends in both and the next one is marked
with a space in both, the text is cut into windows; that both end there is
verified with byte offsets. A window's alignment depends on its ids alone: it is
worked out once for each tuple of A ids and tuple of B ids and remembered. Within a window
each shared end closes a group of tokens and links the two that end there.

Links are counted over the whole corpus; a link is best where no other A id is
linked with its B id more often.

A regular text is tokenised by its blank-separated parts, whose ids don't depend on
what stands around them (no piece of either vocabulary holds white space behind
another character); the libraries see each distinct part once in a while, texts with
unusual white space, marks of special tokens or U+2581 whole.

Edge cases: texts that are null, empty or not given back byte for byte by either
tokenizer have no tokens; a null id is kept; repeated rows are rows of their own and
their links all count; an empty table gives no rows; ties for the most frequent link of a B
id are all best; a very long text is held by one task, with about thirty bytes for each of its own; only
the id and the text are read, so other columns' names may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchpulse.llm.common import give_back, per_process, stored
from searchpulse.llm.tokens import Encoder

#: Bytes of text that are aligned together.
TEXT_BYTES = 2 << 20
#: Bytes of remembered parts, and of remembered windows, that a worker keeps.
MEMO_BYTES = 64 << 20
#: Distinct pairs up to which their counts (17 bytes a pair) are broadcast; beyond, they are joined by shuffle.
BROADCAST_PAIRS = 400_000
#: What a remembered entry takes besides its bytes, about.
ENTRY_BYTES = 300
COMMA, BAR, SEMICOLON, NOTHING = range(4)
#: B's mark of a space.
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def gather(flat, begin, size, index):
    """Runs ``begin[i], size[i]`` of ``flat`` in the order of ``index``, one behind the other, and where each ends."""
    import numpy as np

    sizes = size[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin[index] - ends + sizes, sizes)], ends


def runs(parts: list[bytes], kind: str):
    """Joined parts as one array, with begins and sizes."""
    import numpy as np

    flat = np.frombuffer(b"".join(parts), kind)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // flat.itemsize
    return flat, np.cumsum(size) - size, size


class Memo:
    """Remembered values in two generations of a bounded number of bytes; what is asked for stays in the younger one."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.young, self.old, self.limit, self.held = {}, {}, limit // 2, 0

    def values(self, keys: list, learn, size) -> list:
        """The values of distinct keys; ``learn`` gives those of unknown ones, ``size`` the bytes of a value."""
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        new = [k for k in keys if k not in young]
        unknown = [k for k in new if k not in old]
        if old:
            young.update((k, old[k]) for k in new if k in old)
        young.update(zip(unknown, learn(unknown) if unknown else ()))
        self.held += sum(len(k) + size(young[k]) for k in new) + ENTRY_BYTES * len(new)
        return [young[k] for k in keys]


class Vocabulary:
    """Bytes of the tokens of one tokenizer."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        self.tokens = tokens
        self.flat, self.begin, self.size = runs(tokens, "u1")
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def text(self, ids) -> bytes:
        return gather(self.flat, self.begin, self.size, ids)[0].tobytes()


class Aligner:
    """Both tokenizers with their memos; one in a worker."""

    def __init__(self, path_a: str, path_b: str, memo_bytes: int = MEMO_BYTES):
        import pyarrow as pa
        import sentencepiece

        self.a = Encoder(path_a, drops_blanks=False)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = {i: name for name, i in self.a.library.get_vocab(with_added_tokens=True).items()}
        self.words_a = Vocabulary([bytes(alphabet.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.words_b = Vocabulary(
            [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        )
        # every id as text with what may follow it, in the order of COMMA, BAR, SEMICOLON, NOTHING
        self.names = max(len(self.words_a.tokens), len(self.words_b.tokens))
        self.named = pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(self.names)], pa.string())
        self.parts, self.windows = Memo(memo_bytes), Memo(memo_bytes)

    # ids

    def _learn(self, parts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of distinct parts: behind a blank, or behind the line feed they start with."""
        import array

        # the space before a line feed is a piece of its own
        ids_b = [array.array("I", b[p[0] == "\n" :]).tobytes() for p, b in zip(parts, self.b.encode(parts, num_threads=1))]
        return list(zip(self.a._part_ids(parts), ids_b))

    def _regular(self, texts: list[str]):
        """For A and B: ids of all texts in a row, and where each text ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.large_string())
        words = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        known = self.parts.values(parts, self._learn, lambda ids: len(ids[0]) + len(ids[1]))
        index, borders = coded.indices.to_numpy(), words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        for side in (0, 1):
            ids, ends = gather(*runs([k[side] for k in known], "<u4"), index)
            yield ids, ends[borders - 1]

    def _whole(self, texts: list[str]):
        """As ``_regular``, straight from the libraries."""
        import numpy as np

        ids_a = [self.a.library.encode(" " + t, add_special_tokens=False).ids for t in texts]
        ids_b = self.b.encode(texts, num_threads=1)
        for ids in (ids_a, ids_b):
            yield np.array([i for x in ids for i in x], np.uint32), np.cumsum([len(x) for x in ids], dtype=np.int64)

    # windows

    def _align(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """Of each window its groups as text, and its links as pairs of ids in one number."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        raw, begin, size = runs(keys, "<u4")
        n_a = raw[begin].astype(np.int64)
        n_b, every = size - 1 - n_a, np.arange(len(keys))
        a, stop_a = gather(raw, begin + 1, n_a, every)
        b, stop_b = gather(raw, begin + 1 + n_a, n_b, every)
        ends_a, ends_b = np.cumsum(self.words_a.size[a]), np.cumsum(self.words_b.size[b])  # equal at the windows' ends
        at = np.zeros(int(ends_a[-1]) + 1, bool)
        at[ends_a] = True
        last_b = at[ends_b]
        at[:] = False
        at[ends_b[last_b]] = True
        last_a = at[ends_a]
        # tokens in the order of their groups, those of A first, each with what follows it
        places_a, places_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        before_a = np.cumsum(last_a) - last_a
        before_b = np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], places_b + 1))[before_a]] = a + np.where(last_a, BAR, COMMA) * self.names
        closed = np.where(last_b, SEMICOLON, COMMA)
        closed[stop_b - 1] = NOTHING
        order[np.arange(len(b)) + (places_a + 1)[before_b]] = b + closed * self.names
        tokens = self.named.take(pa.array(order))
        offsets = pa.array(np.concatenate(([0], stop_a + stop_b)).astype(np.int32))
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), "").to_pylist()
        links = (a[last_a].astype(np.int64) << 32 | b[last_b]).tobytes()
        stops = (np.cumsum(last_b)[stop_b - 1] * 8).tolist()
        return [(t, links[p:q]) for t, p, q in zip(texts, [0, *stops], stops)]

    def _window_keys(self, sides, total: int):
        """The windows' ids (how many of A, those of A, those of B) as binary values, and their first bytes in the texts."""
        import numpy as np
        import pyarrow as pa

        starts = [np.cumsum(v.size[ids]) - v.size[ids] for v, ids in sides]
        marked = [s[v.spaced[ids]] for s, (v, ids) in zip(starts, sides)]
        shared = np.zeros(total + 1, bool)
        shared[marked[0]] = True
        anchors = marked[1][shared[marked[1]]]
        shared[:] = False
        shared[anchors] = True
        first = [np.flatnonzero(shared[s]) for s in starts]
        count = [np.diff(f, append=len(ids)) for f, (_, ids) in zip(first, sides)]
        ends = np.cumsum(1 + count[0] + count[1])
        begin = ends - 1 - count[0] - count[1]
        keys = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        keys[begin] = count[0]
        for before, f, n, (_, ids) in zip((begin + 1, begin + 1 + count[0]), first, count, sides):
            keys[np.arange(len(ids)) + np.repeat(before - f, n)] = ids
        offsets = pa.py_buffer(np.concatenate(([0], ends * 4)).astype(np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(keys)]), anchors

    def _aligned(self, texts: list[str], streams):
        """(n_a, n_b, n_groups, groups, links) of each text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        wanted = [b" " + t.encode() for t in texts]
        good, kept, numbers = np.ones(len(texts), bool), [], []
        for words, (ids, ends) in zip((self.words_a, self.words_b), streams):
            made, done = words.text(ids), np.concatenate(([0], np.cumsum(words.size[ids])))[np.concatenate(([0], ends))]
            good &= [made[a:b] == w for a, b, w in zip(done[:-1], done[1:], wanted)]
            n = np.diff(ends, prepend=0)
            kept.append((words, ids, np.repeat(np.arange(len(texts)), n)))
            numbers.append(n)
        sides = [(words, ids[good[owner]]) for words, ids, owner in kept]
        n_a, n_b = (np.where(good, n, 0) for n in numbers)

        length = np.array([len(w) for w in wanted], np.int64) * good
        keys, anchors = self._window_keys(sides, int(length.sum()))
        coded = keys.dictionary_encode()
        known = self.windows.values(coded.dictionary.to_pylist(), self._align, lambda found: len(found[0]) + len(found[1]))
        index = coded.indices.to_numpy()
        # a text's windows: they start at its first byte at the latest, so none reaches over a border
        borders = np.searchsorted(anchors, np.concatenate(([0], np.cumsum(length))))
        lines = pa.array([t for t, _ in known], pa.large_string()).take(coded.indices)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), lines), pa.scalar(";", pa.large_string())).to_pylist()
        pairs, ends = gather(*runs([p for _, p in known], "<i8"), index)
        ends = np.concatenate(([0], ends))[borders]
        return [(a, b, q - p, g or "", pairs[p:q]) for a, b, p, q, g in zip(n_a.tolist(), n_b.tolist(), ends[:-1], ends[1:], groups)]

    def align(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, groups, links) of each text; links are pairs of ids in one number."""
        import numpy as np

        out = [(0, 0, 0, "", np.zeros(0, np.int64))] * len(texts)
        there = [i for i, t in enumerate(texts) if t]
        odd = self.a._irregular([texts[i] for i in there]) if there else set()
        odd = {i for k, i in enumerate(there) if k in odd or MARK in texts[i]}
        for own, streams in (([i for i in there if i not in odd], self._regular), (sorted(odd), self._whole)):
            if own:
                group = [texts[i] for i in own]
                for i, found in zip(own, self._aligned(group, list(streams(group)))):
                    out[i] = found
        return out


LINKS = "array<struct<pair:long,n:long>>"


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, the id, ``n_a``, ``n_b``, ``n_groups``, ``groups`` (``a1,a2|b1;a3|b2,b3``) and the distinct ``links`` of each text with their number.

    A link's ``pair`` is its A id times 2**32 plus its B id. The rows are stored, so that their numbers stay.
    """
    import numpy as np
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["row", id_col, "n_a", "n_b", "n_groups", "groups", "links"]

    def made(ids, rows, first):
        n_a, n_b, n_groups, groups, pairs = zip(*rows)
        counted = [np.unique(p, return_counts=True) for p in pairs]
        ends = np.cumsum([0, *(len(p) for p, _ in counted)], dtype=np.int32)
        links = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*counted)], ["pair", "n"])
        numbers = [pa.array(np.array(x, np.int64)) for x in (range(first, first + len(rows)), n_a, n_b, n_groups)]
        return pa.RecordBatch.from_arrays(
            [numbers[0], ids, *numbers[1:], pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends), links)], names
        )

    def run(batches):
        from pyspark import TaskContext

        aligner = per_process(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            begin, texts, held = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py())
                held += len(texts[-1] or "")
                if held >= TEXT_BYTES or i == batch.num_rows - 1:
                    yield made(batch.column(0).slice(begin, len(texts)), aligner.align(texts), row)
                    row += len(texts)
                    begin, texts, held = i + 1, [], 0
        give_back()

    schema = f"row long, `{id_col}` {id_type}, n_a long, n_b long, n_groups long, groups string, links {LINKS}"
    return stored(docs.select(id_col, text_col).mapInArrow(run, schema), "alignment", compression="zstd")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, how many links hold it (``count``) and whether none with its B id is held by more (``best``)."""
    each = aligned.select(F.explode("links").alias("link")).select("link.pair", "link.n")
    counts = each.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def link_totals(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``row``, ``n_links``, ``n_best`` and ``count_sum`` over the links of each row that has any."""
    counts = stored(pair_counts(aligned), "alignment-pairs")
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    each = aligned.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.n")
    joined = each.join(counts, "pair").groupBy("row")
    return joined.agg(
        F.sum("n").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )
