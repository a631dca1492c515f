"""Encoding to and decoding from SentencePiece ids by an Aho-Corasick automaton and one pass of dynamic programming."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
LATIN = "A-Za-zÀ-ɏ"
#: Runs of Latin letters, or of anything else, each with the spaces before it.
FINE = re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+")
COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PartIds(dict):
    """Ids of the parts met lately, worked out on a miss.

    Two generations of ``limit`` / 2 parts: when the young one is full the old one is forgotten and the young one takes its place. A part that
    is met again in time moves back to the young one, so frequent parts are never worked out twice, however many rare ones pass.
    """

    def __init__(self, ids: Callable[[str], bytes], limit: int):
        super().__init__()
        self.ids, self.half, self.old = ids, max(1, limit // 2), {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.ids(part)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Codec:
    """A SentencePiece BPE model with byte fallback and without normalisation rules.

    A text is cut where no piece can lie across the border (after a run of other characters than spaces, and
    between Latin letters and other characters if the vocabulary has no piece with both). In each part the automaton
    yields, position by position, all pieces that end there, along its output links. The pieces are a merge
    list, so the best piece at a position is the one that merging would leave last there: a candidate counts if the best piece
    where it starts and the candidate itself do not merge any further. There is exactly one, so one pass relaxes each
    position once, as for additive scores, and gives the library's ids.
    """

    def __init__(self, path: str, limit: int = 200_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.limit = limit
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids, self.score, self.id_of = {}, {}, {}
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id_of[piece] = model.get_score(i), i
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        mixed = re.compile(f"[{LATIN}][^{LATIN}]|[^{LATIN}{SPACE}][{LATIN}]")
        self.parts = COARSE if any(map(mixed.search, self.id_of)) else FINE
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            self.parts = re.compile("(?s:.+)")
        control = {i for i in range(len(self.pieces)) if model.is_control(i)}
        decoded = [
            b"" if i in control else bytes([int(p[3:5], 16)]) if model.is_byte(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.bytes = np.frombuffer(b"".join(decoded), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in decoded], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = PartIds(self.part_ids, limit)
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best-scored pair first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, key: tuple[str, str]) -> bool:
        """Whether merging leaves the two pieces (the first may be none) as they are."""
        if len(self.fits) >= self.limit:
            self.fits.clear()
        last, piece = key
        found = self.fits[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return found

    def best_path(self, part: str) -> list[str]:
        best: list[str | None] = [None] * (len(part) + 1)
        known = self.fits
        for end, piece in self.automaton.iter(part):
            if best[end + 1] is None:
                at = end + 1 - len(piece)
                # all pieces that end at ``at`` have been seen; a character no piece ends at stands alone
                key = ((best[at] or part[at - 1]) if at else "", piece)
                fits = known.get(key)
                if self.fit(key) if fits is None else fits:
                    best[end + 1] = piece
        path, at = [], len(part)
        while at:
            piece = best[at] or part[at - 1]
            path.append(piece)
            at -= len(piece)
        return path[::-1]

    def part_ids(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.best_path(part):
            i = self.id_of.get(piece)
            if i is None:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            else:
                ids.append(i)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray, most: int = 1 << 18) -> list[str]:
        """The texts of consecutive runs of ``ids`` of the given sizes. The pieces' bytes are gathered for about ``most`` ids at once."""
        ends, texts, start = np.concatenate(([0], np.cumsum(sizes))), [], 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            texts += self._gathered(ids[ends[start] : ends[stop]], sizes[start:stop])
            start = stop
        return texts

    def _gathered(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        raw = self.bytes[at].tobytes()
        borders = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        texts = [raw[i:j].decode(errors="replace") for i, j in zip(borders, borders[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker, so that its caches outlive a task."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``, array<int>: the ids of the text under the model file ``path``. No shuffle.

    A null text counts as empty and has no ids. All rows and columns stay (``ids_col`` is replaced).
    """

    @F.arrow_udf("array<int>")
    def to_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for texts in batches:
            each = [own.encode(t) for t in texts.to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in each]))).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(each), dtype="<i4"))

    return docs.withColumn(ids_col, to_ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of the ids. A null list gives an empty text; ids that are no text give U+FFFD."""

    @F.arrow_udf("string")
    def to_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for lists in batches:
            offsets = lists.offsets.to_numpy()
            yield pa.array(own.decode_all(lists.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)), pa.string())

    return rows.withColumn(text_col, to_text(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))
