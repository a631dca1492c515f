"""Sum-of-squares online packing of token sequences into windows of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .pretokens import END_OF_TEXT, UNSURE, library, ranks_engine

PIECE_SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Windows of ``size`` tokens that fill up one document at a time.

    ``level[h]`` counts the open windows filled to h. A piece of s tokens goes to the level h (0: a new
    window) for which the sum of squared counts is least afterwards; among equals to the fullest. Pieces that
    fit are never cut. When more than ``max_open`` windows are open, and at the end, the open ones are laid
    head to tail and cut at ``size``; what then remains is cut into powers of two, which need no padding.
    """

    def __init__(self, size: int, max_open: int, first_id: int):
        self.size, self.max_open, self.next_id = size, max_open, first_id
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.windows: dict[int, list[list]] = {}
        self.open = 0
        self.done: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.size):
            piece = (doc, at, ids[at : at + self.size], len(ids))
            if len(piece[2]) == self.size:
                self._close([piece])
            else:
                self._place(piece)

    def _place(self, piece: tuple) -> None:
        s = len(piece[2])
        # change of the sum of squares when a window goes from h to h + s, for h = 0 .. size - s
        change = 2 * (self.level[s:] - self.level[: self.size - s + 1]) + 2
        change[-1] = 1 - 2 * self.level[self.size - s]  # a full window is counted no more
        change[1:][self.level[1 : self.size - s + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.level[s] + 1
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            window = self.windows[h].pop()
            self.level[h] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if h + s == self.size:
            self._close(window)
            return
        self.windows.setdefault(h + s, []).append(window)
        self.level[h + s] += 1
        self.open += 1
        if self.open > self.max_open:
            self.flush()

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.done.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def flush(self) -> None:
        pieces = [p for h in sorted(self.windows) for w in self.windows[h] for p in w]
        left = sum(len(p[2]) for p in pieces)
        window, room = [], self._room(left)
        for doc, start, ids, total in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                window.append((doc, start, part, total))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if not room:
                    self._close(window)
                    window, room = [], self._room(left)
        self.windows, self.open = {}, 0
        self.level[:] = 0

    def _room(self, left: int) -> int:
        return self.size if left >= self.size else 1 << (left.bit_length() - 1) if left else 0


def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> uint32 ids of the tokenizers file; through the rank file of the same vocabulary where both surely agree."""
    own = library(json_path)
    by_library = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    if ranks_path is None:
        return by_library
    special = {END_OF_TEXT: own.token_to_id(END_OF_TEXT)}
    ranks, allowed = ranks_engine(ranks_path, pattern, special), set(special)
    return lambda text: by_library(text) if UNSURE.search(text) else ranks.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4")


def pack(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 1,
    size: int = 2048, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Each task packs the documents of its own splits as they come: no shuffle, one pass, and memory
    for the open windows only (at most ``max_open`` of ``size`` ids). Windows are numbered within the
    task's range of 2^40 ids, so a task that is run again gives the same numbers. ``size`` is a power of two.

    Every document ends with ``end_id``; an empty or null text is that id alone. Repeated rows are packed
    as documents of their own, a null id stays null, an empty table gives no rows, and other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(json_path, ranks_path, pattern)
        packer = Packer(size, max_open, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4")

        def ready() -> pd.DataFrame:
            rows, packer.done = packer.done, []
            frame = pd.DataFrame(rows, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            frame["id"] = frame["id"].astype("Int64")
            return frame

        for batch in batches:
            for doc, text in zip(batch["id"].array, batch["text"]):
                packer.add(None if pd.isna(doc) else int(doc), np.concatenate([encode(text), end]))
                if len(packer.done) >= 4096:
                    yield ready()
        packer.flush()
        yield ready()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, PIECE_SCHEMA).withColumnRenamed("id", id_col)


def with_crc(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ids_crc32 in place of ids."""
    return pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in pieces.columns])
