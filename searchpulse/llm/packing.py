"""Packing of token sequences by vector bin packing.

Sequences are bins with three limits: tokens, segments and loss-bearing tokens. A
bin is filled by the dot-product heuristic: of the pieces that fit, the one whose
demand vector has the largest dot product with what the bin has left. When no
piece fits any more, the piece with the largest product is cut, so bins end full
unless a limit other than tokens closes them.

Each task packs what it reads, through a pool of bounded size, without a shuffle;
the order of a split's rows is that of its file, so a repeated task gives the same
bins. What is left when the rows end goes into sequences of power-of-two lengths,
which need no padding. Unless a limit on segments is given, as many pieces share a
sequence as it has room for; with one, documents of few tokens close sequences early
and are padded.

Texts are encoded, and items pooled, in portions bounded by bytes, and the encoder
forgets its parts at a bound; one text longer than these is held alone.

Edge cases: null and empty texts have the end id alone; very long texts are cut;
repeated rows are packed each; of pieces with the same product the first read comes
first; an empty table gives no pieces; only the id, the text and the prompt are read,
so other columns' names may clash.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from searchpulse.llm.common import by_bytes, give_back
from searchpulse.llm.tokens import END_ID, worker_encoder

LENGTH = 4096
#: Items a task looks at when it chooses the next piece, and their tokens, about.
POOL, POOL_TOKENS = 1024, 1 << 19
#: Bytes of text tokenised at once, and documents at most.
TEXT_BYTES, ROWS_AT_ONCE = 4 << 20, 4096
#: Bytes of known parts that a worker keeps.
PARTS_BYTES = 48 << 20

PIECE_SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long, sequence_length long, ids array<int>"
)
#: Tokens of the pieces passed on at once.
TOKENS_AT_ONCE = 1 << 19


class Packer:
    """Fills sequences from a pool of items (key, ids in bytes, loss-bearing tokens at the end)."""

    def __init__(self, length: int, max_segments: int, max_loss: int, first_id: int, pool: int = POOL):
        import numpy as np

        self.limits = np.array([length, max_segments, max_loss], np.float64)
        self.pool = pool
        self.next_id = first_id
        self.items: list[list] = []  # [key, ids, tokens of the document, loss tokens, start of what is left]
        self.held = 0  # tokens of the items

    def _demand(self):
        import numpy as np

        left = np.array([[n - start, 1, min(loss, n - start)] for _, _, n, loss, start in self.items], np.float64)
        return left.reshape(-1, 3)

    def add(self, key, ids: bytes, loss: int | None = None):
        """Take an item; gives pieces once the pool is full."""
        n = len(ids) // 4
        self.items.append([key, ids, n, n if loss is None else loss, 0])
        self.held += n
        full = len(self.items) >= self.pool and self.held >= 2 * self.limits[0] or self.held >= POOL_TOKENS
        return self.fill(self.pool // 2, POOL_TOKENS // 2) if full else []

    def fill(self, keep: int = 0, tokens: int = 0) -> list[tuple]:
        """Pieces of full sequences until ``keep`` items of ``tokens`` are left or the tokens no longer fill one."""
        import numpy as np

        pieces: list[tuple] = []
        demand = self._demand()
        alive = np.ones(len(self.items), bool)
        left = demand[:, 0].sum()
        while (alive.sum() > keep or left > tokens) and left >= self.limits[0]:
            pieces += self._sequence(demand, alive, self.limits)
            left = demand[alive, 0].sum()
        self.held = int(left)
        self.items = [item for item, on in zip(self.items, alive) if on]
        return pieces

    def finish(self) -> list[tuple]:
        """The last pieces: full sequences, then one for each power of two in what is left."""
        import numpy as np

        pieces = self.fill()
        demand, alive = self._demand(), np.ones(len(self.items), bool)
        while alive.any():
            left = int(demand[alive, 0].sum())
            size = min(self.limits[0], 1 << (left.bit_length() - 1))
            pieces += self._sequence(demand, alive, np.array([size, *self.limits[1:]]))
        self.items, self.held = [], 0
        return pieces

    def _sequence(self, demand, alive, limits) -> list[tuple]:
        import numpy as np

        room, chosen = limits.copy(), []
        while (room > 0).all() and alive.any():
            product = (demand / limits) @ (room / limits)
            fits = alive & (demand <= room).all(1)
            cut = not fits.any()
            at = int(np.argmax(np.where(alive if cut else fits, product, -1)))
            key, ids, n, loss, start = self.items[at]
            take = int(demand[at, 0])
            if cut:  # tokens that bear no loss come first, so the loss limit allows at least its room
                plain = take - int(demand[at, 2])
                take = int(min(take, room[0], plain + room[2]))
            bears = max(0, start + take - max(start, n - loss))
            chosen.append((key, start, take, ids[4 * start : 4 * (start + take)], n, bears))
            room -= [take, 1, bears]
            self.items[at][4] = start + take
            demand[at] = [n - start - take, 1, min(loss, n - start - take)]
            alive[at] = n > start + take
        offset, out, total = 0, [], sum(c[2] for c in chosen)
        for key, start, take, ids, n, bears in chosen:
            out.append((key, start, take, zlib.crc32(ids), n, bears, self.next_id, offset, total, ids))
            offset += take
        self.next_id += 1
        return out


def pack_documents(
    docs: DataFrame,
    path: str,
    drops_blanks: bool,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    length: int = LENGTH,
    max_segments: int | None = None,
    max_loss: int | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents with their token ids and place: the id and ``PIECE_SCHEMA``.

    For instruction data ``prompt_col`` holds the prompt, whose tokens come first
    and bear no loss. A sequence's number is the task's number and a running one.
    """
    import numpy as np
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, text_col] + ([prompt_col] if prompt_col else [])
    names = [id_col] + [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def pack(batches):
        from pyspark import TaskContext

        encoder = worker_encoder(path, drops_blanks, end_id, PARTS_BYTES)
        packer = Packer(length, max_segments or length, max_loss or length, TaskContext.get().partitionId() << 32)
        kind = None

        def made(pieces):
            *places, ids = zip(*pieces)
            arrays = [pa.array(c, t) for c, t in zip(places, [kind] + [pa.int64()] * 8)]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends), values)], names)

        for part in by_bytes(batches, 1, TEXT_BYTES, ROWS_AT_ONCE):
            kind = part.schema.field(0).type
            texts = encoder.encode(part.column(1).to_pylist())
            prompts = encoder.encode(part.column(2).to_pylist()) if prompt_col else [encoder.end] * len(texts)
            pieces, held = [], 0
            for key, ids, prompt in zip(part.column(0).to_pylist(), texts, prompts):
                full = packer.add(key, prompt[:-4] + ids, len(ids) // 4)
                pieces += full
                held += sum(p[2] for p in full)
                if held >= TOKENS_AT_ONCE:
                    yield made(pieces)
                    pieces, held = [], 0
            if pieces:
                yield made(pieces)
        if pieces := packer.finish():
            yield made(pieces)
        give_back()

    return docs.select(*columns).mapInArrow(pack, f"{id_col} {id_type}, {PIECE_SCHEMA}")


def piece_digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids_crc32`` computed from their ids, without the ids."""
    import pyarrow as pa

    kept = [f for f in pieces.schema if f.name not in ("ids", "ids_crc32")]

    def digest(batches):
        import numpy as np

        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crcs, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids_crc32 long"])
    found = pieces.select(*[f"`{f.name}`" for f in kept], "ids").mapInArrow(digest, schema)
    return found.select(*[f"`{c}`" for c in pieces.columns if c != "ids"])
