"""Vector code compression: product codes, assigned through memoised grid cells.

A vector is cut into equal parts, and each part is replaced by the number of its nearest entry of that part's codebook. To find
it, the part's coarse cell on a grid is hashed. A cell's list holds the entries not dominated across the cell's box: an entry goes if even the
least difference between its squared distance and that of the entry nearest to the box's centre, over all points of the box, is
positive. This is the test of least against greatest distance, with the terms that both share left out. Only entries of
the list are evaluated exactly. Lists are remembered per task and codebook, up to MEMO cells a part, so copies and near neighbours
reuse them; when the memory is full it starts anew, which changes no result.

Components are integers, floor(1024 x), so all distances are exact. Codebooks (parts * entries vectors, whatever the data) are
the only thing sent to tasks; each round returns one sum per entry. Rounds run on a written table, and lost tasks are run again.

Rows are dropped whose vector is null or holds null or non-finite components. Defined results: the length of vectors is that of the
smallest kept id; rows of another length, and all rows where it is no multiple of the parts, have no code and are dropped. Integers are
held within +-2**24 (16,384 in a component), so that sums fit 64 bits. Null ids count as the largest; rows that repeat an
id are rows of their own, in the order of their vectors. With fewer rows than entries, codebooks have as many entries as rows.
Empty tables give empty results. Null labels are one label.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fichaflow.llm.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, LIMIT = 1024, 1 << 24
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Edge of a grid cell in integer units, and cells that a task remembers for a part.
WIDTH, MEMO = 64, 20_000
#: Integers below this are exact in double precision.
EXACT = float(1 << 53)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exact: in floating point where all sums stay below EXACT."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < EXACT:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


class Cells:
    """Nearest entries of one part's codebook, by lists per grid cell."""

    def __init__(self, book: np.ndarray, width: int = WIDTH, memo: int = MEMO):
        self.book, self.width, self.memo = book, width, memo
        self.norms = np.einsum("ij,ij->i", book, book)
        self.apart = np.stack([np.abs(book - e).sum(1) for e in book]) if len(book) else np.zeros((0, 0), np.int64)
        self.lists: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """The list of each cell: entries that are nearest to some point of its box, and perhaps more."""
        centre = 2 * cells * self.width + (self.width - 1)  # doubled, to stay whole
        twice = 2 * self.book
        far = np.einsum("ij,ij->i", centre, centre)[:, None] - 2 * product(centre, twice) + 4 * self.norms[None]
        best = far.argmin(1)
        # four times the least of |x - a|^2 - |x - b|^2 over the box: linear in x, so taken at a corner
        least = far - far[np.arange(len(far)), best][:, None] - 4 * (self.width - 1) * self.apart[best]
        return [np.flatnonzero(row) for row in least <= 0]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; ties go to the lower entry."""
        if not len(parts) or not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        grid = np.ascontiguousarray(parts // self.width)
        keys = grid.view(f"V{grid.shape[1] * 8}").ravel()
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[i].tobytes() for i in first]
        new = [k for k, name in enumerate(names) if name not in self.lists]
        if len(self.lists) + len(new) > self.memo:
            self.lists.clear()
            new = list(range(len(names)))
        for begin in range(0, len(new), 1024):
            some = new[begin:begin + 1024]
            for k, found in zip(some, self.undominated(grid[first[some]])):
                self.lists[names[k]] = found
        held = [self.lists[name] for name in names]
        sizes = np.array([len(x) for x in held])
        edge = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(held)
        count = sizes[of]
        stop = np.cumsum(count)
        row = np.repeat(np.arange(len(parts)), count)
        entry = flat[np.arange(stop[-1]) - np.repeat(stop - count - edge[of], count)]
        apart = parts[row] - self.book[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        self.evaluated += len(row)
        order = np.lexsort((entry, distance, row))[stop - count]
        return entry[order], distance[order]


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): the kept rows with integer components, those of any length."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v"):
                # nulls become NaN
                x = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                ok = x is not None and bool(np.isfinite(x).all())
                out.append(np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype(np.int64) if ok else None)
            rows = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(out, pa.list_(pa.int64()))], ["id", "label", "v"])
            yield rows.filter(rows.column("v").is_valid())

    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(convert, f"id {types['id']}, label {types['label']}, v array<bigint>")


def cut(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """The vectors of a batch as (row, part, component)."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(part, entry, component) of the smallest ids; a bounded number of rows, whatever the table."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    dims = len(first[0]["v"]) if first else 0
    if dims % parts:
        return np.zeros((parts, 0, 0), np.int64)
    found = [r["v"] for r in first if len(r["v"]) == dims]
    return np.array(found, np.int64).reshape(len(found), parts, dims // parts).transpose(1, 0, 2).copy()


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each used entry becomes the floored mean of its parts."""
    parts, entries, width = books.shape
    sums = [f"s{i}" for i in range(width)]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Cells(b) for b in shared.value]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            v = cut(batch, parts, width)
            for p, finder in enumerate(finders):
                entry, _ = finder.nearest(v[:, p])
                count[p] += np.bincount(entry, minlength=entries)
                np.add.at(total[p], entry, v[:, p])
        p, e = np.nonzero(count)
        columns = [p.astype(np.int32), e.astype(np.int32), count[p, e], *total[p, e].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["part", "entry", "n", *sums])

    schema = "part int, entry int, n long" + "".join(f", {s} long" for s in sums)
    found = rows.select("v").mapInArrow(add, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *sums]))
    books = books.copy()
    for r in found.collect():  # one row per entry
        books[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) learnt from all rows of `whole_numbers`."""
    books = first_books(rows, parts, entries)
    if books.size:
        rows = rows.filter(F.size("v") == parts * books.shape[2])
        for _ in range(rounds):
            books = next_books(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): two hex digits per part, and the squared distance over all parts."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Cells(b) for b in shared.value]
        for batch in batches:
            v = cut(batch, parts, width)
            found = [finder.nearest(v[:, p]) for p, finder in enumerate(finders)]
            codes = np.stack([e for e, _ in found], 1).astype(np.uint8)
            error = sum((d for _, d in found), np.zeros(len(v), np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                ["id", "label", "code", "error"])

    types = dict(rows.dtypes)
    rows = rows.filter((F.size("v") == parts * width) & F.lit(entries > 0))
    return rows.mapInArrow(assign, f"id {types['id']}, label {types['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> list[float]:
    """The vector that a code stands for, in the middle of its integer cell."""
    return [(int(x) + 0.5) / SCALE for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e]]


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The (id, label, code, error) of all kept rows, as a written table, and the codebooks."""
    rows = stored(whole_numbers(vectors, key, vector, label), "vectors")
    books = fit(rows, parts, entries, rounds)
    return stored(encode(rows, books), "codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add the error summed over all rows of the same label; a label's rows are summed before they meet."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")
