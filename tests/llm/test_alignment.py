"""The alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from searchpulse.llm import alignment, queries
from searchpulse.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_bytes(libraries, text):
    """Ids and token bytes of a text in both tokenizers, from the libraries alone."""
    a, b = libraries
    alphabet = alignment.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))


def plain_alignment(libraries, text):
    """(n_a, n_b, groups, links) by walking along both rows of tokens."""
    if not text:
        return 0, 0, [], []
    left, right = plain_bytes(libraries, text)
    want = b" " + text.encode()
    if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
        return 0, 0, [], []
    groups, links, own, other, at_a, at_b, k = [], [], [], [], 0, 0, 0
    for i, x in left:
        own.append(i)
        at_a += len(x)
        while at_b < at_a:
            other.append(right[k][0])
            at_b += len(right[k][1])
            k += 1
        if at_a == at_b:
            groups.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
            links.append((own[-1], other[-1]))
            own, other = [], []
    return len(left), len(right), groups, links


def plain_table(libraries, rows):
    found = [(key, plain_alignment(libraries, text)) for key, text in rows]
    counts = Counter(link for _, f in found for link in f[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for key, (n_a, n_b, groups, links) in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(8)
    words = "the tokenizer Überraschung naïve 日本語 don't 1234567 e=mc2 antidisestablishmentarianism  x <|endoftext|> <s> <0x41> 🙂 foo.bar,baz -- ".split(" ")
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += ["\n".join(" ".join(rng.choice(words) for _ in range(6)) for _ in range(5)) for _ in range(20)]
    out += [None, "", " ", "  ", "\n", "a\n\nb", " lead", "tail ", "a  b   c", "tab\there", "x\r\ny", "▁mark", "a ▁b", "nul\0nul", "x" * 5000, "the cat " * 4000, "日" * 600, ".", "\x1c"]
    return out + [out[0]] * 4 + ["ab", "ab", "cd"]


def digests(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rows = list(enumerate(texts())) + [(None, "no id here"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "groups": F.lit(1), "pair": F.lit(None).cast("int")})
    return rows, df.repartition(3)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_matches_plain_version(libraries, table, limit):
    rows, df = table
    got = queries.aligned_digest(df, A, B, broadcast_pairs=limit)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert digests(got.select(*names)) == plain_table(libraries, rows)


def test_empty_table(table):
    assert queries.aligned_digest(table[1].where("false"), A, B).count() == 0


def test_memos_that_overflow_give_the_same(libraries):
    small, large = alignment.Aligner(A, B, memo_bytes=1), alignment.Aligner(A, B)
    for _ in range(2):
        for group in (texts()[:30], texts()[30:]):
            for x, y, text in zip(small.align(group), large.align(group), group):
                n_a, n_b, groups, links = plain_alignment(libraries, text)
                assert x[:4] == y[:4] == (n_a, n_b, len(groups), ";".join(groups)) and x[4].tolist() == y[4].tolist()
                assert x[4].tolist() == [a << 32 | b for a, b in links]
