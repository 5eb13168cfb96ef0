"""Byte-level BPE by a file of ranks, through the tiktoken library, and decoding to raw bytes.

Every match of the split pattern is merged on its own by the library. Long texts go
through it in segments that end where a match ends in any case: behind an ASCII
character before white space, behind a run of letters or digits before another
kind of character. Runs of white space beyond ``LONG_BLANK`` characters are one match
(without the last one, if text follows), which the library's pattern can't walk;
they are merged as a single piece. Ids are little-endian unsigned 32-bit integers
in a binary column, so their size and digest are Spark expressions.

Edge cases: null and empty texts have no ids and decode to no bytes; a null id is
kept; repeated rows are encoded each; an empty table gives no rows; texts of any
length are cut into segments, and a single match of any length is merged whole;
only the id and the text are read, so other columns' names may clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from searchpulse.llm.common import per_process

#: Characters of a long text that are encoded at once, about.
SEGMENT = 1 << 18
#: White-space characters in a row that are merged as a piece of their own.
LONG_BLANK = 4096
#: Ids that are decoded at once.
IDS_AT_ONCE = 1 << 18
#: Bytes of results in one Arrow batch, about.
BATCH_BYTES = 8 << 20

_SPACE = r"\t-\r \x85\xa0  -     　"
_BLANKS = re.compile(f"[{_SPACE}]{{{LONG_BLANK},}}")
# Places where a match ends whatever stands around; only characters whose kind is the same in all Unicode versions.
_SAFE = re.compile(
    f"(?<=[!-~])(?=[{_SPACE}])"
    r"|(?<=[A-Za-z\u4e00-\u9fa5])(?=[!-@\[-`{-~\u3001\u3002\uff0c])"
    r"|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~\u4e00-\u9fa5\u3001\u3002\uff0c])"
)


class RankCodec:
    """The library with the ranks of a local file; no special tokens."""

    def __init__(self, path: str, pattern: str | None = None, segment: int = SEGMENT):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.segment = segment

    def _pieces(self, text: str):
        """(part, whether it is a single match) of a text, in order."""
        at = 0
        for run in _BLANKS.finditer(text) if len(text) >= LONG_BLANK else ():
            yield from ((part, False) for part in self._segments(text[at : run.start()]))
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
        yield from ((part, False) for part in self._segments(text[at:]))

    def _segments(self, text: str):
        at = 0
        while len(text) - at > self.segment:
            cut = _SAFE.search(text, at + self.segment)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | None) -> bytes:
        import array

        out = []
        for part, single in self._pieces(text or ""):
            ids = self.library._encode_single_piece(part) if single else self.library.encode_ordinary(part)
            out.append(array.array("I", ids).tobytes())
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        import numpy as np

        numbers = np.frombuffer(ids or b"", "<u4")
        parts = range(0, len(numbers), IDS_AT_ONCE)
        return b"".join(self.library.decode_bytes(numbers[a : a + IDS_AT_ONCE].tolist()) for a in parts)


def _mapped(df: DataFrame, columns: list[str], schema: str, method, keep: bool) -> DataFrame:
    """``method()`` of the last column as the column ``made``, in batches bounded by bytes; ``keep``: beside it."""
    import pyarrow as pa

    def run(batches):
        work = method()
        for batch in batches:
            last = batch.num_columns - 1
            begin, made, held = 0, [], 0
            for i in range(batch.num_rows):
                made.append(work(batch.column(last)[i].as_py()))
                held += len(made[-1])
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    kept = batch.slice(begin, len(made)).columns[: last + keep]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary())], [*batch.schema.names[: last + keep], "made"])
                    begin, made, held = i + 1, [], 0

    return df.select(*columns).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the ``ids`` of every text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    made = _mapped(docs, [id_col, text_col], f"`{id_col}` {id_type}, made binary", lambda: worker_codec(path).encode, False)
    return made.withColumnRenamed("made", "ids")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``, the raw bytes that the ids stand for."""
    id_type = encoded.schema[id_col].dataType.simpleString()
    made = _mapped(encoded, [id_col, "ids"], f"`{id_col}` {id_type}, ids binary, made binary", lambda: worker_codec(path).decode, True)
    return made.withColumnRenamed("made", "decoded")


def worker_codec(path: str) -> RankCodec:
    """The worker's codec for a file of ranks."""
    return per_process(("ranks", path), lambda: RankCodec(path))
