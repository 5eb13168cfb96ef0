"""The Merkle manifest and the rank codec against plain versions."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from searchpulse.llm import merkle, queries
from searchpulse.llm.rank_codec import RankCodec, decode_ids, encode_texts
from searchpulse.llm.tokens import tokenizer_path

# 12: Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, marked):
    """Root of ``nodes`` and the (left, right) siblings of each, level by level; ``marked``: places asked for."""
    steps = {i: [] for i in marked}
    place = {i: i for i in marked}
    while len(nodes) > 1:
        for i, at in place.items():
            run = at - at % 3
            steps[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
            place[i] = at // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return (nodes[0] if nodes else None), steps


def plain_manifest(rows):
    """[(id, leaf, subroot, root, steps)] of (id, source, lang, n_chars, text) rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_of(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[s] = climb([leaf for _, leaf in groups[s]], range(len(groups[s])))
    root, upper = climb([subs[s][0] for s in order], range(len(order)))
    return [
        (key, leaf, subs[s][0], root, subs[s][1][i] + upper[n])
        for n, s in enumerate(order)
        for i, (key, leaf) in enumerate(groups[s])
    ]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(n):
    """One source with most rows, sources of a row each, a null source, null ids and values, repeated rows, a long text."""
    rng = random.Random(n)
    rows = [(i, "hot" if i % 3 else f"s{rng.randrange(9)}", rng.choice(["en", None]), i, f"text {i}\nline\n") for i in range(n)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, "é\n"), (5, None, "en", 0, ""), (7, "é", "en", 2, "x" * 50_000), (8, "zz", "", 1, "\n")]
    return rows + rows[:3] + [(0, rows[0][1], "xx", 1, "same id, other text")]


@pytest.mark.parametrize("n,levels", [(0, 6), (1, 1), (40, 1), (100, 1), (100, 2), (245, 1), (300, 3)])
def test_manifest_matches_plain_tree(spark, n, levels):
    rows = manifest_rows(n) if n else []
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("clash"), "root": F.lit(1), "block": F.lit(2)}).repartition(4)
    found = merkle.merkle_manifest(df, queries.LEAF_COLUMNS, extra={"n": F.col("n_chars")}, block_levels=levels)
    folded = found.withColumns({"folded": merkle.fold(F.col("leaf"), F.col("steps")), "proof": merkle.proof_digest(F.col("steps"))})
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.steps], r.folded, r.proof) for r in folded.collect()]
    want = [(*w, w[3], h(*[a + b for a, b in w[4]])) for w in plain_manifest(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_equal_rows_have_leaves_of_their_own(spark):
    df = spark.createDataFrame([(1, "a", "en", 1, "t")] * 7, SCHEMA)
    found = merkle.merkle_manifest(df, queries.LEAF_COLUMNS, block_levels=1).collect()
    assert len(found) == 7 and len({r.root for r in found}) == 1 and len({str(r.steps) for r in found}) > 3


def test_changed_rows_do_not_verify(spark, tmp_path):
    rows = [(i, "a" if i % 2 else None, "en", 3, "x\ny" if i % 5 else None) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    for r in queries.merkle(spark, str(tmp_path)).collect():
        assert r.verified == (not (r.doc_id % 5 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0))
        assert r.verified == (r.folded_root == r.root)


def test_no_scope_is_sorted_in_one_task(spark):
    df = spark.range(3000).select(F.lit("hot").alias("s"), F.col("id").alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = merkle.numbered(df, ["s"], ["v"])
        assert found.where("position <> v OR total <> 3000").count() == 0 and found.count() == 3000
        assert sum("numbered" in f for f in found.inputFiles()) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# 13: ranks


PATH = tokenizer_path("byte_bpe_50k.tiktoken")


def odd_texts():
    rng = random.Random(4)
    bits = ["word", "Ünïcode", "日本語。", "12", "345", " ", "  ", "\n", "\t", "'s", "'ll", "'", "...", "!?", "é", "🙂", " ", "　", "<|endoftext|>", "\0", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    return texts + ["", " ", "\n\n", "x" * 3000, "a b" * 1000, "日本" * 700 + "。" + "1" * 500 + "a" * 500, " " * 300 + "x", "x" + "\n" * 300]


@pytest.mark.parametrize("segment", [1, 7, 60, 1 << 18])
def test_segments_have_the_ids_of_the_whole(segment, monkeypatch):
    import re

    from searchpulse.llm import rank_codec

    codec = RankCodec(PATH, segment=segment)
    if segment < 100:
        monkeypatch.setattr(rank_codec, "LONG_BLANK", 3)
        monkeypatch.setattr(rank_codec, "_BLANKS", re.compile(f"[{rank_codec._SPACE}]{{3,}}"))
    for text in odd_texts():
        parts = [p for p, _ in codec._pieces(text)]
        assert "".join(parts) == text and all(parts)
        import array

        ids = codec.encode(text)
        assert array.array("I", ids).tolist() == codec.library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def plain_merges(piece, ranks):
    """The textbook merge: the pair of the lowest rank, leftmost first."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ids_match_plain_merges():
    import array
    import base64

    import public_tokenizers
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    codec = RankCodec(PATH)
    for text in odd_texts()[:40]:
        pieces = regex.findall(public_tokenizers.PATTERN, text.replace("\x1c", ""))
        want = [i for p in pieces for i in plain_merges(p.encode(), ranks)]
        assert array.array("I", codec.encode(text.replace("\x1c", ""))).tolist() == want


def test_very_long_texts():
    codec = RankCodec(PATH)
    begun = time.time()
    for text in (" " * 1_500_000 + "x", "x" * 300_000, "\n" * 1_200_000, "ab " * 400_000, "日" * 100_000):
        assert codec.decode(codec.encode(text)).decode() == text
    assert time.time() - begun < 60


def test_codec_over_a_table(spark, tmp_path):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (900, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "made": F.lit(1), "lang": F.lit(None).cast("string")})
    codec = RankCodec(PATH)
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in decode_ids(encode_texts(df, PATH), PATH).collect())
    assert got == sorted((i is None, i, codec.encode(t), (t or "").encode()) for i, t in rows)
    assert decode_ids(encode_texts(df.where("false"), PATH), PATH).count() == 0
    df.where("doc_id IS NOT NULL").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.rank_codec(spark, str(tmp_path)).where("doc_id <> 3").collect():
        text = dict(rows)[r.doc_id]
        ids = codec.encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
