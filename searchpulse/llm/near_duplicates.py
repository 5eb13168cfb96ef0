"""Near duplicates by MinHash bands, odd sketches and an exact check.

A document's set is its distinct runs of ``shingle_words`` words. Documents of equal
words form a class and go on as its smallest id. Each class has 128 MinHash samples:
bands of four find candidates, and an odd sketch (the samples' parities folded into
512 bits) tells from the bits two sketches differ in how similar the sets are, and a
second one of all the set's hashes does so more precisely for sets that do not fill
it. They remove false candidates without their texts; the rest is confirmed on full
sets.

Candidates of a bucket are not all paired. First each member is checked against the
bucket's smallest; components join what is linked. In some turns, members outside a
bucket's largest component are then checked against a few of its members. What is
left in other components after that is checked against all of its bucket that is not
in its own: no link between components is lost, and a large group of copies costs a
few checks a member, except for members that are candidates but link with none. A
pair at the threshold misses all bands with a probability of 5e-8.

Edge cases: null and empty texts have empty sets and link with nothing; a text of
fewer words than a shingle has its whole sequence as its only one; repeated rows are
copies; a repeated id is judged row by row; a null id links its copies but can lead
no group (``deduplicate`` tells such documents apart); ties go to the smallest id; an empty
table gives no rows; very long texts are whole; only the id and the text are read, so
other columns' names may clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchpulse.llm.common import blank_words, by_bytes, give_back, lowered, stored
from searchpulse.llm.components import components
from searchpulse.llm.merkle import numbered

BANDS, ROWS = 32, 4
#: Turns in which the members outside a bucket's largest component meet some of its members, and how many.
HUB_TURNS, HUBS = 1, 4
SKETCH_WORDS = 8  # of 64 bits
#: Bytes of text that are signed together.
TEXT_BYTES = 2 << 20
#: Six deviations of the estimate (MinHash and sketch together) below the threshold.
MARGIN = 0.25

#: Words of 64 bits of the odd sketch of the whole set.
WHOLE_WORDS = 16

SIGNATURE_SCHEMA = "digest string, n_shingles long, bands array<long>, sketch array<long>, whole array<long>"


def _mix(x):
    """Finaliser of a 64-bit hash."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(column, shingle_words: int) -> list:
    """Distinct 64-bit shingle hashes of each text of an Arrow string array."""
    import numpy as np
    import pandas as pd
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(lowered(column))
    coded = words.flatten().dictionary_encode()
    texts = np.array(coded.dictionary.to_pylist(), object)
    of_word = pd.util.hash_array(texts, categorize=False) if len(texts) else np.zeros(0, np.uint64)
    blank = texts == ""
    index = coded.indices.to_numpy()
    borders = words.offsets.to_numpy() - words.offsets[0].as_py()
    factor = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for a, b in zip(borders[:-1], borders[1:]):
        part = index[a:b]
        if len(part) and (blank[part[0]] or blank[part[-1]]):  # white space at an end leaves an empty word
            part = part[~blank[part]]
        h = of_word[part]
        n = min(shingle_words, len(h))
        if not n:
            out.append(h)
            continue
        run = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            run = _mix(run * factor + h[i : len(h) - n + 1 + i])
        out.append(np.unique(run))
    return out


def _constants():
    import numpy as np

    numbers = _mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[::2] | np.uint64(1), numbers[1::2]


def minhash(shingles):
    """128 samples of a non-empty set of 64-bit hashes."""
    import numpy as np

    multiply, flip = _constants()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        hashed = (shingles[at : at + 2048, None] ^ flip) * multiply
        hashed ^= hashed >> np.uint64(29)
        least = np.minimum(least, hashed.min(0))
    return least


def band_keys(samples):
    """One key for each band of samples."""
    import numpy as np

    keys = np.arange(BANDS, dtype=np.uint64)
    for row in samples.reshape(BANDS, ROWS).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def parities(hashes, words: int):
    """Bitmap in which a bit is set when an odd number of the hashes falls on it."""
    import numpy as np

    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def odd_sketch(samples):
    """Parities of the (position, sample) pairs."""
    import numpy as np

    return parities(_mix(samples + np.arange(len(samples), dtype=np.uint64)), SKETCH_WORDS)


def signatures(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the words, set size, band keys and odd sketch of each row; no keys for empty sets."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        import hashlib

        for part in by_bytes(batches, 1, TEXT_BYTES, 1024):
            sets = shingle_hashes(part.column(1), shingle_words)
            digests = [hashlib.sha256(b" ".join(blank_words(t))).hexdigest() for t in part.column(1).to_pylist()]
            samples = [minhash(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(digests),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([band_keys(s) if s is not None else [] for s in samples], pa.list_(pa.int64())),
                    pa.array([odd_sketch(s) if s is not None else [] for s in samples], pa.list_(pa.int64())),
                    pa.array([parities(_mix(s), WHOLE_WORDS) for s in sets], pa.list_(pa.int64())),
                ],
                ["id", "digest", "n_shingles", "bands", "sketch", "whole"],
            )
        give_back()

    return docs.select(id_col, text_col).mapInArrow(sign, f"id {id_type}, {SIGNATURE_SCHEMA}")


def _differing(words: list[tuple[Column, Column]]) -> Column:
    """Number of bits in which two bitmaps differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(x.bitwiseXOR(y)) for x, y in words])


def estimated_similarity(differing: Column) -> Column:
    """Jaccard similarity from the number of bits in which two odd sketches of samples differ."""
    bits = 64 * SKETCH_WORDS
    left = F.greatest(1 - 2 * differing / bits, F.lit(1e-9))
    return 1 + bits / (4 * BANDS * ROWS) * F.log(left)


def may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether set sizes and both odd sketches of the structs ``a`` and ``b`` allow the similarity.

    Of two sets similar enough, at most (1 - s) / (1 + s) of both sizes are shingles of
    one alone. Each of these changes one bit of the sketch of the whole set, so the
    sketches never differ in more bits: this bound loses no pair. For sets that are
    large beside the sketch it removes none either.
    """
    n_a, n_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    bits_apart = _differing([(F.col(f"{a}.{w}"), F.col(f"{b}.{w}")) for w in WHOLE])
    samples_apart = _differing([(F.col(f"{a}.{w}"), F.col(f"{b}.{w}")) for w in SAMPLES])
    return (
        (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
        & (bits_apart * (100 + percent) <= (n_a + n_b) * (100 - percent))
        & (estimated_similarity(samples_apart) >= percent / 100 - MARGIN)
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle_words: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    import pyarrow as pa

    def confirm(batches):
        def whole_set(text):
            words = blank_words(text)
            n = min(shingle_words, len(words))
            return set(zip(*(words[i:] for i in range(n))))

        held, set_a = None, set()
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if held is None or held != (a, text_a):
                    held, set_a = (a, text_a), whole_set(text_a)
                set_b = whole_set(text_b)
                both = len(set_a & set_b)
                keep.append(both > 0 and 100 * both >= percent * (len(set_a) + len(set_b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    kind = pairs.schema["a"].dataType.simpleString()
    a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(confirm, f"a {kind}, b {kind}")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of buckets with at least two members, with the bucket's smallest."""
    buckets = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1")
    return keys.join(buckets.select("key", "first"), "key")


# Words of the two sketches as columns, which generated code compares without bounds checks.
SAMPLES = [f"s{i}" for i in range(SKETCH_WORDS)]
WHOLE = [f"w{i}" for i in range(WHOLE_WORDS)]
SIGNED = ["id", "n_shingles", *SAMPLES, *WHOLE]


def _first_pairs(shared: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with the bucket's smallest, where their sketches allow it."""
    pairs = shared.where("id <> first").select("first", "id").distinct()
    b = reps.select("id", F.struct(*SIGNED).alias("y"))
    a = reps.select(F.col("id").alias("first"), F.struct(*SIGNED).alias("x"))
    found = pairs.join(b, "id").join(a, "first").where(may_be_similar("x", "y", percent))
    return found.select(F.col("first").alias("a"), F.col("id").alias("b"))


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_rows(shared: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, with each row's and the bucket's largest one."""
    rows = shared.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("groups"))
    rows = rows.join(mixed.where("groups > 1").select("key", F.col("top.component").alias("main")), "key")
    return rows.join(reps.select("id", F.struct(*SIGNED).alias("y")), "id")


def _hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member outside its bucket's largest component with a few members of that component, others in each turn."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(turn)), "id")
    hubs = rows.where("component = main").withColumn("n", F.row_number().over(order)).where(F.col("n") <= HUBS)
    others = rows.where("component <> main").select("key", F.col("id").alias("o"), F.col("y").alias("x"))
    met = others.join(hubs.select("key", "id", "y"), "key").where(may_be_similar("x", "y", percent))
    return met.select(*_pairs("o", "id")).distinct()


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket in different components; one side is outside the bucket's largest component."""
    others = rows.where("component <> main")
    others = others.select("key", F.col("id").alias("o"), F.col("component").alias("o_group"), F.col("y").alias("x"))
    met = others.join(rows, "key").where("o_group <> component AND (component = main OR o < id)")
    met = met.where(may_be_similar("x", "y", percent))
    return met.select(*_pairs("o", "id")).distinct()


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_shingles, component_id and kept.

    Two documents are linked when the intersection of their sets has at least
    ``percent`` % of the union; the component is the smallest id reachable.
    """
    signed = stored(signatures(docs, shingle_words, id_col, text_col), "signatures")
    # only texts that occur several times; stored, so that the join can split a class with many members
    classes = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("members")).where("members > 1")
    classes = stored(classes.select("digest", "rep"), "classes")
    classed = signed.join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "id"))
    words = [*[F.col("sketch")[i].alias(w) for i, w in enumerate(SAMPLES)], *[F.col("whole")[i].alias(w) for i, w in enumerate(WHOLE)]]
    leading = classed.where("n_shingles > 0 AND id = rep")
    reps = stored(leading.select("id", "n_shingles", "bands", *words), "representatives")
    keys = reps.select("id", F.explode("bands").alias("key"))
    reps = reps.select(*SIGNED)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def links_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return _confirmed(pairs, texts.join(wanted, "id", "left_semi"), percent, shingle_words)

    def joined(links: DataFrame) -> DataFrame:
        known = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return stored(components(known.unionByName(links)), "components")

    shared = stored(_shared_keys(keys), "shared-keys")
    tried = stored(_first_pairs(shared, reps, percent), "pairs")
    groups = stored(components(links_of(tried)), "components")
    for turn in range(HUB_TURNS):
        rows = stored(_open_rows(shared, groups, reps), "open-rows")
        pairs = stored(_hub_pairs(rows, turn, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        groups = joined(links_of(pairs))
        tried = tried.unionByName(pairs)
    rows = stored(_open_rows(shared, groups, reps), "open-rows")
    rest = stored(_open_pairs(rows, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    final = joined(links_of(rest))

    members = classed.select("id", "rep", "n_shingles")
    found = members.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    lead = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    found = found.select(F.col("id").alias(id_col), "n_shingles", lead.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that lead their group, one row each, with all their columns.

    Exact copies with the same id are one document, of which any row stays. Where an id
    is null, or stands at different texts, each pair of id and text is a document of its
    own, numbered in order of the ids (null last); then the smallest number leads.
    """
    digest = F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit(""))
    pairs = docs.select(id_col, digest.alias("_digest"))
    spread = pairs.groupBy(id_col).agg((F.min("_digest") < F.max("_digest")).alias("several"))
    if not spread.where(F.col("several") | F.col(id_col).isNull()).limit(1).count():
        kept = near_duplicates(docs, shingle_words, percent, id_col, text_col).where("kept").select(id_col).distinct()
        return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    keys = pairs.distinct().withColumn("_none", F.col(id_col).isNull())
    keys = numbered(keys, [], ["_none", id_col, "_digest"]).select(F.col(id_col).alias("_id"), "_digest", F.col("position").alias("_key"))
    rows = docs.withColumn("_digest", digest)
    rows = stored(rows.join(keys, F.col(id_col).eqNullSafe(F.col("_id")) & (rows["_digest"] == keys["_digest"])).select(*docs.columns, "_key"), "keyed")
    kept = near_duplicates(rows, shingle_words, percent, "_key", text_col).where("kept").select("_key").distinct()
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
