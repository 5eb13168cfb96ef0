"""Token ids of whole texts with a public tokenizer of the ``tokenizers`` library.

A tokenizer of that kind splits a text before it merges bytes, and no piece of the
split holds white space behind another character, nor a letter and a full stop or
comma behind it. So the ids of a text are those of its parts in a row, and each
part needs the library only once: the parts repeat a lot, and a worker keeps their
ids. Texts with unusual white space or the mark of a special token go to the
library whole. Splitting, numbering and putting ids together runs in Arrow and numpy.
"""

from __future__ import annotations

import re

from searchpulse.llm.common import per_process

END_ID = 2
#: Distinct parts whose ids a worker keeps; at the bound it starts afresh.
PARTS_KEPT = 1_000_000
#: Bytes of text whose parts are looked up together.
BATCH_BYTES = 8 << 20
#: Parts that go through the library in one text.
JOINED = 200

# White space beyond the blank and the line feed, and the opening of a special token.
UNUSUAL = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]|<\\|")
# Bytes of which each of these has one; other characters may have them too.
SUSPECT = [b < 32 and b != 10 or b in b"<\xc2\xe1\xe2\xe3\xef" for b in range(256)]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, closed by the end id.

    ``drops_blanks`` is for vocabularies that ignore white space and case. Known
    parts are an Arrow array; their ids lie in a row in one numpy array.
    """

    def __init__(self, path: str, drops_blanks: bool, end_id: int = END_ID, parts_bytes: int | None = None):
        from tokenizers import Tokenizer

        self.parts_bytes = parts_bytes

        self.library = Tokenizer.from_file(path)
        self.drops_blanks = drops_blanks
        self.end = end_id.to_bytes(4, "little")
        self.closing = dict(zip(".,", self.whole([".", ","])))
        # Behind a separator the library starts a new piece, so parts can go through it in one text.
        self.separator = " | " if drops_blanks else "\n"
        self.separator_id = self.library.encode(self.separator, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        import numpy as np
        import pyarrow as pa

        self.parts = pa.array([""], pa.large_string())
        self.begin, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _held(self) -> int:
        """Bytes of the known parts, the index that Arrow builds over them, and their ids."""
        return self.parts.nbytes + 32 * len(self.parts) + self.begin.nbytes + self.size.nbytes + self.ids.nbytes

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the library."""
        import array

        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of short texts, many of them in one call of the library."""
        import numpy as np

        mark = self.separator.strip() or self.separator
        out: list[bytes] = []
        for at in range(0, len(texts), JOINED):
            group = texts[at : at + JOINED]
            if not any(mark in t for t in group):
                found = self.library.encode_batch_fast([self.separator.join(group)], add_special_tokens=False)[0].ids
                ids = np.array(found, "<u4")
                cuts = np.flatnonzero(ids == self.separator_id[0])
                if len(self.separator_id) == 1 and len(cuts) == len(group) - 1:
                    ends = [*cuts.tolist(), len(ids)]
                    out += [ids[a:b].tobytes() for a, b in zip([0, *(cuts + 1).tolist()], ends)]
                    continue
            out += self.whole(group)
        return out

    def _irregular(self, texts: list[str]) -> set[int]:
        """Numbers of the texts that do not split into parts; they are encoded whole."""
        import numpy as np

        raw = [t.encode() for t in texts]
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])  # a line feed closes each text
        joined = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        owner = lambda places: np.unique(np.searchsorted(starts, places, "right") - 1).tolist()
        odd = {i for i in owner(np.flatnonzero(np.array(SUSPECT)[joined])) if UNUSUAL.search(texts[i])}
        if not self.drops_blanks:
            blank = (joined == 32) | (joined == 10)
            odd.update(owner(np.flatnonzero(blank[1:] & blank[:-1])))  # runs, and blanks at the end
            odd.update(np.flatnonzero(blank[starts[:-1]]).tolist())
            odd.update(i for i in owner(np.flatnonzero(joined == 0)))
        return odd

    def _split(self, texts: list[str]):
        """Parts of each text as an Arrow list array.

        A part stands for itself behind a blank, except that one with a mark of
        its own (line feed, or NUL for the first) stands behind no blank.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.large_string())
        if self.drops_blanks:
            return pc.ascii_split_whitespace(pc.ascii_lower(column))
        marked = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar("\0", pa.large_string()))
        return pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of new parts. A full stop or comma behind a letter is always a piece of its own."""
        if self.drops_blanks:
            texts = parts
        else:
            texts = [p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p for p in parts]
        closed = [len(t) > 2 and t[-1] in ".," and t[-2].isascii() and t[-2].isalpha() for t in texts]
        todo = sorted({t[:-1] if c else t for t, c in zip(texts, closed)})  # marked parts come first
        ids = dict(zip(todo, self._each(todo)))
        return [ids[t[:-1]] + self.closing[t[-1]] if c else ids[t] for t, c in zip(texts, closed)]

    def _numbers(self, parts):
        """Places of the distinct parts among the known ones, the missing ones having been learnt."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.parts) > PARTS_KEPT or self.parts_bytes and self._held() > self.parts_bytes:
            self._forget()
        found = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(found.is_null())
        if len(new):
            ids = self._part_ids(new.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            found[found < 0] = np.arange(len(self.parts), len(self.parts) + len(new))
            self.parts = pa.concat_arrays([self.parts, new])
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), "<u4")))
            return found
        return found.to_numpy(zero_copy_only=False)

    def _together(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        words = self._split(texts)
        coded = words.flatten().dictionary_encode()
        index = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.size[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        stream = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[index] - ends[:-1], sizes)]
        borders = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [stream[a:b].tobytes() + self.end for a, b in zip(borders[:-1], borders[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text in bytes, with the end id; null is the empty text."""
        out: list[bytes] = [self.end] * len(texts)
        groups: list[list[int]] = []
        size = BATCH_BYTES
        for i, text in enumerate(texts):
            if text:
                if size >= BATCH_BYTES:
                    groups.append([])
                    size = 0
                groups[-1].append(i)
                size += len(text)
        for group in groups:
            odd = self._irregular([texts[i] for i in group])
            for i in (group[k] for k in odd):
                out[i] = self.whole([texts[i]])[0] + self.end
            plain = [i for k, i in enumerate(group) if k not in odd]
            for i, ids in zip(plain, self._together([texts[i] for i in plain]) if plain else ()):
                out[i] = ids
        return out


def worker_encoder(path: str, drops_blanks: bool, end_id: int = END_ID, parts_bytes: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file; known parts are forgotten beyond ``parts_bytes``."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return per_process(
        ("encoder", path, drops_blanks, end_id, parts_bytes), lambda: Encoder(path, drops_blanks, end_id, parts_bytes)
    )
