"""Benchmark decontamination with a generalised suffix automaton over words.

All test items go into one automaton whose letters are word numbers. A document's
words are streamed through it; at each word the automaton knows the length of the
longest run of words, ending here, that occurs in some item. Where that run
reaches ``window`` words the last ``window`` words are a window of at least one
item, and the words are hit. An item shorter than ``window`` is one window itself.

Only stretches of words that all occur in some item are streamed: any other word
resets the automaton, so leaving it out changes nothing.

Items are dealt by hash over as many automata as keep each at about
``words_per_automaton`` words. Tasks build them and write them to a table in the
shared folder; they are broadcast from there one after the other, so the driver holds one at
most. With more than one, the documents are streamed through each and the hits
merged by position.

Edge cases: null texts have no words and no hits; items without words (or null)
are never found; repeated items each count; an item without an id hits and is cut like
any other, but is in no list of items; very long documents are streamed like
any other; an empty benchmark hits nothing; a null document id is kept, repeated ids
are judged row by row; only the named columns are read, so other columns' names may clash.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchpulse.llm.common import WORD_BYTES, alnum_words, by_bytes, give_back, stored

WINDOW = 10
WORDS_PER_AUTOMATON = 200_000
#: Bytes of text whose words are held at once, and documents at most: with one automaton, and with several to load for each portion.
TEXT_BYTES, ROWS_AT_ONCE = (4 << 20, 32 << 20), (256, 1 << 16)


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items of each window; an item without a name is None."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items if words]
        for _, letters in coded:
            last = 0
            for letter in letters:
                last = self._extend(last, letter)
        self.shortest = min([window, *(len(x) for _, x in coded)]) if coded else window
        self.windows: dict[int, list[str | None]] = {}  # items by the state of the window
        self.short: dict[int, list[tuple[int, str]]] = {}  # short whole items by their state
        for name, letters in coded:
            state = 0
            for i, letter in enumerate(letters):
                state = self.next[state][letter]
                if i + 1 >= window:
                    found = self.windows.setdefault(self._suffix(state, window), [])
                    if not found or found[-1] != name:
                        found.append(name)
            if len(letters) < window:
                self.short.setdefault(self._suffix(state, len(letters)), []).append((len(letters), name))

    def _extend(self, last: int, letter: int) -> int:
        """The state of the string of ``last`` followed by ``letter``, added where it is missing."""
        if letter in self.next[last]:
            at = self.next[last][letter]
            if self.length[at] == self.length[last] + 1:
                return at
            return self._split(last, letter, at)
        new = self._state({}, self.length[last] + 1)
        while last != -1 and letter not in self.next[last]:
            self.next[last][letter] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            at = self.next[last][letter]
            self.link[new] = at if self.length[at] == self.length[last] + 1 else self._split(last, letter, at)
        return new

    def _split(self, last: int, letter: int, at: int) -> int:
        copy = self._state(dict(self.next[at]), self.length[last] + 1)
        self.link[copy] = self.link[at]
        self.link[at] = copy
        while last != -1 and self.next[last].get(letter) == at:
            self.next[last][letter] = copy
            last = self.link[last]
        return copy

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _suffix(self, state: int, length: int) -> int:
        """The state of the last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, letters) -> list[tuple[int, int]]:
        """(state, longest match) after each word."""
        out, state, match = [], 0, 0
        for letter in letters:
            while state and letter not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if letter in self.next[state]:
                state = self.next[state][letter]
                match += 1
            else:
                match = 0
            out.append((state, match))
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) inside windows that occur in ``words``, and their items."""
        import numpy as np

        get = self.number.get
        coded = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], coded >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for begin, end in known.reshape(-1, 2):
            if end - begin < self.shortest:
                continue
            for at, (state, match) in enumerate(self.stream(coded[begin:end].tolist()), begin):
                covered = 0
                if match >= self.window:
                    covered = self.window
                    items.update(self.windows[self._suffix(state, self.window)])
                if self.short:
                    up = state
                    while up > 0:
                        for length, name in self.short.get(up, ()):
                            if length <= match:
                                covered = max(covered, length)
                                items.add(name)
                        up = self.link[up]
                if covered:
                    start = int(at) + 1 - covered
                    if spans and spans[-1][1] >= start:
                        start = min(start, spans[-1][0])
                        spans.pop()
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, int(at) + 1))
        return spans, items


def automata(benchmark: DataFrame, window: int, item_id: str, text_col: str, words_per_automaton: int) -> list:
    """Loaders of the automata over all items of the benchmark, of about ``words_per_automaton`` words each."""
    import pickle

    import pandas as pd

    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text_col).alias("text"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(words.cast("long"))).head()[0] or 0
    groups = max(1, -(-total // words_per_automaton))

    def build(rows):
        texts = sorted(zip(rows["id"], rows["text"]), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        built = SuffixAutomaton([(name, alnum_words(text)) for name, text in texts], window)
        return pd.DataFrame({"automaton": [pickle.dumps(built.__dict__)]})

    group = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).alias("group")
    made = stored(items.select("id", "text", group).groupBy("group").applyInPandas(build, "automaton binary"), "automata")
    return [_sent(benchmark.sparkSession, row[0]) for row in made.toLocalIterator()]


def _sent(spark, state: bytes):
    """Broadcast a pickled automaton; the returned function gives it back in a task."""
    import pickle

    sent = spark.sparkContext.broadcast(bytes(state))

    def load() -> SuffixAutomaton:
        automaton = SuffixAutomaton.__new__(SuffixAutomaton)
        automaton.__dict__.update(pickle.loads(sent.value))
        return automaton

    return load


HIT_SCHEMA = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "item_ids array<string>, spans array<struct<start: int, end: int>>"
)


def _merge(spans: list) -> list:
    out: list = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _parts(batches, column: int, many: bool):
    """Portions of the documents whose words fit a task; larger ones where each loads several automata."""
    return by_bytes(batches, column, TEXT_BYTES[many], ROWS_AT_ONCE[many])


def _hits_of(docs_words: list, shared: list, held) -> list[tuple[list, set]]:
    """Spans and items of each document of a batch; several automata are loaded one after the other."""
    if held is not None:
        return list(map(held.hits, docs_words))
    found: list[tuple[list, set]] = [([], set()) for _ in docs_words]
    for load in shared:
        automaton = load()
        for (spans, items), words in zip(found, docs_words):
            more, names = automaton.hits(words)
            spans += more
            items |= names
    return [(_merge(spans), items) for spans, items in found]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words_per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """One row per document: its id and ``HIT_SCHEMA``; spans count words."""
    import pyarrow as pa

    shared = automata(benchmark, window, item_id, item_text, words_per_automaton)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(span)]
        names = [c.split()[0] for c in HIT_SCHEMA.split(", ")[:6]] + ["spans"]
        held = shared[0]() if len(shared) == 1 else None
        for batch in _parts(batches, 1, held is None):
            rows = []
            docs_words = list(map(alnum_words, batch.column(1).to_pylist()))
            for words, (spans, items) in zip(docs_words, _hits_of(docs_words, shared, held)):
                ids = sorted(items - {None})
                digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
                n_hit = sum(e - s for s, e in spans)
                rows.append(
                    (len(words), n_hit, len(ids), digest, n_hit > 0, ids, [{"start": s, "end": e} for s, e in spans])
                )
            columns = list(zip(*rows)) or [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *names])
        give_back()

    return docs.select(id_col, text_col).mapInArrow(scan, f"{id_col} {id_type}, {HIT_SCHEMA}")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters of the given word spans [start, end)."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    text_col: str = "text",
    words_per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """Documents with every benchmark span cut out of the text.

    A document of whose words more than ``max_coverage`` are hit is dropped; one
    without hits keeps its text as it is. All columns stay; ``n_chars``, where it
    is there, follows the new text.
    """
    import pyarrow as pa

    shared = automata(benchmark, window, "item_id", "text", words_per_automaton)
    at, chars = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches):
        held = shared[0]() if len(shared) == 1 else None
        for batch in _parts(batches, at, held is None):
            keep, texts, lengths = [], batch.column(at).to_pylist(), batch.column(chars).to_pylist() if chars is not None else []
            docs_words = list(map(alnum_words, texts))
            for i, (words, (spans, _)) in enumerate(zip(docs_words, _hits_of(docs_words, shared, held))):
                hit = sum(e - s for s, e in spans)
                keep.append(hit <= max_coverage * len(words))
                if hit and keep[-1]:
                    texts[i] = cut_spans(texts[i], spans)
                    if chars is not None:
                        lengths[i] = len(texts[i])
            arrays = batch.columns
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                arrays[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(clean, docs.schema)
