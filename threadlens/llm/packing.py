"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts are tokenised by a public byte-level BPE (its rank file is a parameter). A text is cut before single
spaces between two visible characters, where the tokeniser always cuts too, so only the distinct chunks of
a batch are encoded and the rest is array indexing; the ids are those of encoding the whole text.

Overlong texts are split into pieces of the row length without loss. Pieces are packed best-fit decreasing:
a segment tree over the free capacities finds the fullest open row that still fits. Packing runs inside a
partition, over buffers of at most ``buffer_tokens`` tokens, so nothing is shuffled and no task holds more
than one buffer.

A packed row holds the id matrix row (little-endian, padded), the cumulative segment lengths, the position
resets (where a segment starts in the row, and at which position of its text it continues) and the ids of
its texts. Edge cases: null and empty texts have no token and are in no row; repeated rows are packed each;
a null id stands as null; extra columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import words as W

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of this public tokeniser.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
# First bytes of characters among which are white space, and last bytes of such characters.
_WIDE_FIRST = np.zeros(256, dtype=bool)
_WIDE_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_ENCODINGS: dict[int, object] = {}


def read_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoding(ranks: dict[bytes, int]):
    """The tokeniser of a rank table, built once per process."""
    import tiktoken

    key = hash((len(ranks), next(iter(ranks), b""), sum(ranks.values())))
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the chunks of all non-empty texts: safe cuts before single spaces, and text starts."""
    n = len(data)
    if n < 3:
        inner = np.zeros(0, dtype=np.int64)
    else:
        mid = (data[1:-1] == 0x20) & ~_WHITE[data[:-2]] & ~_WHITE[data[2:]] & ~_WIDE_FIRST[data[2:]]
        at = np.flatnonzero(mid) + 1
        back2, back3 = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        high = data[at - 1] >= 0x80
        inner = at[~(high & ((back2 == 0xC2) | ((back3 >= 0xE1) & (back3 <= 0xE3) & (back2 >= 0x80))))]
    starts = bounds[:-1][np.diff(bounds) > 0]
    # A space at the very start or end of a text has no neighbour in that text.
    inside = ~np.isin(inner, bounds) & ~np.isin(inner + 1, bounds)
    return np.union1d(starts, inner[inside])


def tokenize(column: pa.Array, enc) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of every text, concatenated, and their bounds per text."""
    data, bounds = W.text_bytes(column)
    starts = chunk_starts(data, bounds)
    if not len(starts):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64)
    ends = np.append(starts[1:], bounds[-1])
    h = W.SpanHasher(data)(starts, ends)
    _, first, inv = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    pieces = [enc.encode_ordinary(raw[starts[i]:ends[i]].decode("utf-8")) for i in first]
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    flat = np.array([t for p in pieces for t in p], dtype=np.uint32)
    offset = np.cumsum(size) - size
    per = size[inv]
    at = np.cumsum(per) - per
    ids = flat[np.repeat(offset[inv] - at, per) + np.arange(per.sum())]
    total = np.concatenate(([0], np.cumsum(per)))
    return ids, total[np.searchsorted(starts, bounds)]


class CapacityTree:
    """Segment tree over free capacities 0..capacity: the smallest one that is open and large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def best(self, need: int) -> int:
        """The smallest open capacity of at least ``need``, or -1."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:     # the subtree to the right
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces by falling length, ties by number, each into the fullest row that fits."""
    tree, open_rows, rows = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        free = tree.best(need) if need < capacity else -1
        if free < 0:
            rows.append([i])
            row, left = len(rows) - 1, capacity - need
        else:
            row = open_rows[free].pop()
            tree.add(free, -1)
            rows[row].append(i)
            left = free - need
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def pack(docs: DataFrame, capacity: int = 2048, ranks_path: str = DEFAULT_RANKS, end_id: int | None = None,
         buffer_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One output row per packed row.

    ``end_id`` (default: the first id after the vocabulary) closes every text and pads the rows. Ids are
    stored in two bytes if they fit, in four otherwise (``id_bytes``).
    """
    ranks = read_ranks(ranks_path)
    end = max(ranks.values()) + 1 if end_id is None else end_id
    width = 2 if max(end, max(ranks.values())) < 1 << 16 else 4
    kind = np.dtype("<u2" if width == 2 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)     # the size of the vocabulary
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def flush(part: int, turn: int, ids: list, tokens: list, arrow_id: pa.DataType) -> Iterator[pa.RecordBatch]:
        owner, start, piece = [], [], []
        for i, t in enumerate(tokens):
            for at in range(0, len(t), capacity):
                owner.append(i)
                start.append(at)
                piece.append(t[at:at + capacity])
        rows = best_fit_decreasing([len(p) for p in piece], capacity)
        for lo in range(0, len(rows), 1024):
            some = rows[lo:lo + 1024]
            cum = [np.concatenate(([0], np.cumsum([len(piece[i]) for i in r]))).astype(np.int32) for r in some]
            matrix = np.full((len(some), capacity), end, dtype=kind)
            for j, (r, c) in enumerate(zip(some, cum)):
                for i, a, b in zip(r, c[:-1], c[1:]):
                    matrix[j, a:b] = piece[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{turn}-{lo + j}" for j in range(len(some))]),
                 pa.array([int(c[-1]) for c in cum], pa.int32()), pa.array([width] * len(some), pa.int32()),
                 pa.array([m.tobytes() for m in matrix], pa.binary()),
                 pa.array(cum, pa.list_(pa.int32())), pa.array([c[:-1] for c in cum], pa.list_(pa.int32())),
                 pa.array([[start[i] for i in r] for r in some], pa.list_(pa.int64())),
                 pa.array([[ids[owner[i]] for i in r] for r in some], pa.list_(arrow_id))],
                names=["pack_id", "n_tokens", "id_bytes", "input_ids", "cu_seqlens", "position_resets",
                       "text_offsets", "doc_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, turn, held = context.partitionId() if context else 0, 0, 0
        ids, tokens, enc, arrow_id = [], [], encoding(shared.value), None
        for batch in batches:
            arrow_id = batch.column(0).type
            for a, b in W.slices(batch.column(1)):
                flat, cut = tokenize(batch.column(1).slice(a, b - a), enc)
                flat = flat.astype(kind)
                for j, name in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    if cut[j + 1] > cut[j]:
                        t = np.empty(cut[j + 1] - cut[j] + 1, dtype=kind)
                        t[:-1], t[-1] = flat[cut[j]:cut[j + 1]], end
                        ids.append(name)
                        tokens.append(t)
                        held += len(t)
                        if held >= buffer_tokens:
                            yield from flush(part, turn, ids, tokens, arrow_id)
                            ids, tokens, held, turn = [], [], 0, turn + 1
        if tokens:
            yield from flush(part, turn, ids, tokens, arrow_id)

    return src.mapInArrow(run, f"pack_id string, n_tokens int, id_bytes int, input_ids binary, "
                               f"cu_seqlens array<int>, position_resets array<int>, text_offsets array<bigint>, "
                               f"doc_ids array<{id_type}>")


def matrix_row(input_ids: bytes, id_bytes: int) -> np.ndarray:
    """The ids of one packed row."""
    return np.frombuffer(input_ids, dtype="<u2" if id_bytes == 2 else "<u4")
