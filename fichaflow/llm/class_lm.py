"""Class-based bigram language model with exchange clustering, and scores of whole texts.

P(word | before) = (c(word) + 0.1) * (MIX * P(class | class before) / Z(class) + (1 - MIX) / Z): the class bigram with word
emission, mixed with the smoothed unigram. Z are the sums of all c + 0.1 of a class or of the vocabulary, one unknown word
included, so each part is a distribution. Class transitions are smoothed towards the classes' own frequencies.

What is learnt, over all training documents: counts of all tokens, and a class for every word by exchange, in two steps. learn()
counts pairs of units: one of the CLUSTERED most frequent words, or all other words of one ending (ENDINGS groups by the last three
bytes). Each unit in turn moves to the class that raises the likelihood of the pairs most, until a sweep gains next to nothing; the
pair table has (CLUSTERED + ENDINGS + 1)**2 entries at most. place_words() then exchanges every other word alone, in sweeps over a
table of all words: the words beside it count by the classes of their units, which stay, so no counts of all word pairs are needed,
which are about as many rows as tokens. Transitions come from the classes that all words have in the end. Only words not seen in
training get the class of their ending. The end of a text is a class of its own.

Counts of at most HEAD frequent words go to all tasks as a table. All rarer words of a text meet theirs in a join, each once per
text, so no word is left out and the vocabulary may have any size.

A null text is scored as an empty one: its end is its only token. A null key counts as the empty string in the fold. Ids may
repeat: rows are scored one by one. Further columns are ignored. Without training documents every token has base probability 1.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fichaflow.llm.storage import discard_stored, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD, HEAD_BYTES = 65_536, 64
CLUSTERED, CLASSES, ENDINGS = 1000, 64, 1024
#: The exchange ends with a sweep that raises the likelihood by less than this share.
TOLERANCE = 1e-4
ADD, MIX, TRANSITION_PRIOR = 0.1, 0.7, 20.0
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 200_000
#: Tokens whose neighbours or pairs a task counts at once; words that a sweep moves at once; counts below this have their logarithms in a table.
COUNTED_TOKENS, SWEPT_ROWS, FEW = 2_000_000, 1024, 16
#: Words of several Arrow batches that a task takes together, so that those with the same neighbours are moved once.
TOGETHER = 16_384
#: In codes of neighbours, the classes after the word; in encoded texts, a word outside the table.
AFTER, RARE = 128, 255


def tokens(text: str | None) -> list[bytes]:
    """Words in A-Z lower case, as UTF-8; the end of the text is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Distinct words, and numbers from 1 for the words of all texts in their order, with 0 before, between and after the texts; cut
    after about COUNTED_TOKENS."""
    own: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
    ids = array("i", [0])
    for batch in batches:
        for text in batch.column(0).to_pylist():
            ids.extend(map(own.__getitem__, tokens(text)))
            ids.append(0)
            if len(ids) > COUNTED_TOKENS:
                yield list(own), np.array(ids)
                own.clear()
                own.default_factory = itertools.count(1).__next__
                ids = array("i", [0])
    yield list(own), np.array(ids)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def ending_column(word: Column) -> Column:
    """The same of a binary column."""
    return F.pmod(F.crc32(F.when(F.octet_length(word) > 3, F.substring(word, -3, 3)).otherwise(word)), F.lit(ENDINGS))


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
            if len(found) > COUNTED_WORDS:
                yield rows(found)
                found = Counter()
        yield rows(found)

    def rows(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The HEAD most frequent words, ties by the word; a histogram of counts tells which words come into question."""
    place = F.floor(F.log2("n") * 32).cast("int")
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    histogram = short.groupBy(place.alias("place")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, 1
    for row in sorted(histogram, key=lambda r: -r["place"]):
        total += row["words"]
        least = row["least"]
        if total >= HEAD:
            break
    head = short.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(HEAD).collect()
    return [(bytes(r["word"]), r["n"]) for r in head]


@dataclass
class Vocabulary:
    """symbol: of frequent words, their own unit or that of their ending; count: their training counts."""

    symbol: dict[bytes, int]
    count: dict[bytes, int]
    clustered: int

    @property
    def symbols(self) -> int:
        return self.clustered + ENDINGS + 1

    def of(self, words: list[bytes]) -> list[int]:
        get, base = self.symbol.get, self.clustered
        return [s if (s := get(w)) is not None else base + ending(w) for w in words]


def vocabulary(head: list[tuple[bytes, int]]) -> Vocabulary:
    k = min(CLUSTERED, len(head))
    symbol = {w: i if i < k else k + ending(w) for i, (w, _) in enumerate(head)}
    return Vocabulary(symbol, dict(head), k)


def count_pairs(train: DataFrame, words: Vocabulary) -> np.ndarray:
    """Counts of (symbol before, symbol), each text beginning and ending with the end symbol."""
    shared, size = train.sparkSession.sparkContext.broadcast(words), words.symbols

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for own, ids in numbered(batches):
            unit = np.array([size - 1, *shared.value.of(own)], np.int32)[ids]
            pairs, n = np.unique(unit[:-1] * size + unit[1:], return_counts=True)
            total[pairs] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    found = train.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Of the class pairs counted in a table, given the class before: what the exchange raises, up to a constant."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=1)).sum() - xlogx(table.sum(axis=0)).sum())


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, tolerance: float = TOLERANCE) -> np.ndarray:
    """Class of each symbol: those that move in 0..classes-1, the others fixed behind."""
    size = len(pairs)
    classes = max(1, min(classes, movable))
    cls = np.concatenate([np.arange(movable) % classes, classes + np.arange(size - movable)])
    width = classes + size - movable
    table = np.zeros((width, width))
    np.add.at(table, (cls[:, None], cls[None, :]), pairs)
    own = np.arange(classes)
    ahead = [np.flatnonzero(pairs[w]) for w in range(movable)]
    behind = [np.flatnonzero(pairs[:, w]) for w in range(movable)]
    before = likelihood(table)
    while True:
        moved = 0
        for w in range(movable):
            a, again = cls[w], pairs[w, w]
            right = np.bincount(cls[ahead[w]], weights=pairs[w, ahead[w]], minlength=width)
            left = np.bincount(cls[behind[w]], weights=pairs[behind[w], w], minlength=width)
            table[a] -= right
            table[:, a] -= left
            table[a, a] += again
            right[a] -= again
            left[a] -= again
            # sums with the pairs of the word that stay in a class wherever the word goes
            out, into = (table.sum(axis=1) + left)[:classes], (table.sum(axis=0) + right)[:classes]
            across, down = table[:classes], table[:, :classes]
            wide = across + right
            wide[own, own] += left[:classes] + again
            tall = down + left[:, None]
            tall[own, own] = down[own, own]  # the diagonal is in `wide`
            gain = (xlogx(wide) - xlogx(across)).sum(axis=1) + (xlogx(tall) - xlogx(down)).sum(axis=0)
            gain -= xlogx(out + right.sum() + again) - xlogx(out) + xlogx(into + left.sum() + again) - xlogx(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += again
            cls[w] = b
            moved += b != a
        after = likelihood(table)
        if not moved or after - before < tolerance * abs(before):
            return cls
        before = after


@dataclass
class ClassModel:
    """cls: class of each symbol; context[class before, class]: log10 of the factor beside c(word) + ADD; whole: Z.

    units: how many words were units of their own; fixed[class, code]: counts of the classes beside them, as in neighbours().
    """

    words: Vocabulary
    cls: np.ndarray
    units: int
    fixed: np.ndarray
    context: np.ndarray
    ends: int
    train_tokens: int
    distinct: int

    @property
    def whole(self) -> float:
        return self.train_tokens + ADD * (self.distinct + 1)


def learn(train: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model and the stored counts of all words, from (text)."""
    counts = stored(count_words(train), "words")
    ends = train.count()
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    words = vocabulary(frequent(counts))
    pairs = count_pairs(train, words)
    end = words.symbols - 1
    cls = exchange(pairs, end)
    width = int(cls.max()) + 1
    table = np.zeros((width, width))
    np.add.at(table, (cls[:, None], cls[None, :]), pairs)

    # distinct words of each class; the end is one
    distinct = np.bincount([*cls[:words.clustered], cls[end]], minlength=width).astype(float)
    for row in counts.groupBy(ending_column(F.col("word")).alias("e")).count().collect():
        distinct[cls[words.clustered + row["e"]]] += row["count"]
    for w, s in words.symbol.items():
        if s < words.clustered:
            distinct[cls[words.clustered + ending(w)]] -= 1
    fixed = np.zeros((int(cls[end]), 256))
    for unit in range(words.clustered):
        np.add.at(fixed[cls[unit]], cls, pairs[:, unit])
        np.add.at(fixed[cls[unit]], AFTER + cls, pairs[unit])
    model = ClassModel(words, cls, words.clustered, fixed, table, ends, int(total["n"]) + ends, int(total["v"]) + (ends > 0))
    return with_context(model, table, distinct), counts


def with_context(model: ClassModel, table: np.ndarray, distinct: np.ndarray) -> ClassModel:
    """The model for these counts of class pairs and of distinct words of each class."""
    n = table.sum(axis=0)
    share = (n + ADD) / (n.sum() + ADD * len(n))
    move = (table + TRANSITION_PRIOR * share) / (table.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    return replace(model, context=np.log10(MIX * move / (n + ADD * (distinct + 1)) + (1 - MIX) / model.whole))


def neighbours(train: DataFrame, model: ClassModel) -> DataFrame:
    """(word, codes, amounts) of all training words that are no unit of their own: how often which class of units stands before
    (code = class) and after (code = AFTER + class), in one byte and one int32 for each code. A word has a row for each piece of the
    texts; all of them are in one partition, one after the other."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cls = shared.value.words, shared.value.cls.astype(np.int32)
        for own, ids in numbered(batches):
            yield rows(words, cls, own, ids)

    def rows(words: Vocabulary, cls: np.ndarray, own: list[bytes], ids: np.ndarray) -> pa.RecordBatch:
        unit = np.array([words.symbols - 1, *words.of(own)], np.int32)
        alone = (unit >= words.clustered) & (unit < words.symbols - 1)
        place, classes = (np.cumsum(alone) - 1).astype(np.int32), cls[unit][ids]
        at = np.flatnonzero(alone[ids])
        word = place[ids[at]] << 8
        pairs, n = np.unique(np.concatenate([word | classes[at - 1], word | AFTER + classes[at + 1]]), return_counts=True)
        listed = [own[i - 1] for i in np.flatnonzero(alone)]
        return pa.RecordBatch.from_arrays([pa.array(listed, pa.binary()), *packed(pairs >> 8, pairs & 255, n, len(listed))], names)

    names = ["word", "codes", "amounts"]
    found = train.select("text").mapInArrow(count, "word binary, codes binary, amounts binary")
    return found.repartition("word").sortWithinPartitions("word")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of TOGETHER rows or more, the last one but not empty."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if any(map(len, held)):
        yield pa.concat_batches(held)


def joined(values: pa.Array, kind: type) -> np.ndarray:
    """All values of a binary column, one after the other."""
    return np.frombuffer(b"".join(values.to_pylist()), kind)


def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, amount) of a batch of words."""
    codes = batch.column("codes")
    row = np.repeat(np.arange(len(batch)), pc.binary_length(codes).to_numpy())
    return row, joined(codes, np.uint8).astype(int), joined(batch.column("amounts"), np.int32).astype(int)


def added_up(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row (word, codes, amounts), by code, for each word of rows in which those of a word follow each other."""
    word = batch.column("word")
    new = np.ones(len(word), bool)
    new[1:] = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
    row, code, n = counted(batch)
    row = (np.cumsum(new) - 1)[row]
    rows, found = int(new.sum()), []
    for low in range(0, rows, SWEPT_ROWS):
        high = min(low + SWEPT_ROWS, rows)
        a, b = np.searchsorted(row, (low, high))
        total = np.bincount(row[a:b] - low << 8 | code[a:b], weights=n[a:b], minlength=(high - low) * 256).astype(np.int64)
        at = np.flatnonzero(total)
        found.append((at + (low << 8), total[at]))
    at, total = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([word.filter(pa.array(new)), *packed(at >> 8, at & 255, total, rows)], ["word", "codes", "amounts"])


def alike(batch: pa.RecordBatch, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first rows of all that have the same neighbours and class, and to which of these each row belongs."""
    ends = pa.py_buffer(np.arange(len(cls) + 1, dtype=np.int32))
    own = pa.Array.from_buffers(pa.binary(), len(cls), [None, ends, pa.py_buffer(cls.astype(np.uint8))])
    # five bytes for each neighbour, and one
    number = pc.binary_join_element_wise(batch.column("codes"), batch.column("amounts"), own, b"").dictionary_encode().indices.to_numpy()
    first = np.zeros(number.max() + 1, int)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return first, number


def packed(row: np.ndarray, code: np.ndarray, n: np.ndarray, rows: int) -> list[pa.Array]:
    """Columns codes and amounts of counts that are sorted by their row."""
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return [pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends * values.itemsize), pa.py_buffer(values)])
            for values in (code.astype(np.uint8), n.astype(np.int32))]


class Moves:
    """The best class of a word while all others stay, by the classes of units beside it.

    around[class, code]: counts beside all words of a class; those of the word are among them in the class that it has.
    """

    def __init__(self, around: np.ndarray):
        self.around, self.total = around, around.sum(axis=1) / 2
        self.now = xlogx(around)
        self.few = np.stack([(xlogx(around + m) - self.now).T for m in range(FEW)])

    def best(self, row: np.ndarray, code: np.ndarray, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Of words in the classes cls, with their counts sorted by the word's row."""
        own, around = np.arange(len(cls)), self.around
        of_word = np.bincount(row, weights=n * (code < AFTER), minlength=len(cls))
        amounts, where = np.unique(of_word, return_inverse=True)
        gain = -2 * (xlogx(self.total + amounts[:, None]) - xlogx(self.total))[where]
        gain[own, cls] = -2 * (xlogx(self.total[cls]) - xlogx(self.total[cls] - of_word))
        added = self.few[np.minimum(n, FEW - 1), code]
        many = n >= FEW
        added[many] = xlogx(around.T[code[many]] + n[many, None]) - self.now.T[code[many]]
        a = cls[row]
        added[np.arange(len(row)), a] = self.now[a, code] - xlogx(around[a, code] - n)
        gain += np.add.reduceat(added, np.searchsorted(row, own))
        best = gain.argmax(axis=1)
        return np.where(gain[own, best] > gain[own, cls] + 1e-9, best, cls)


def around_likelihood(around: np.ndarray) -> float:
    """Of the classes beside all words, given the words' classes, up to a constant."""
    return float(xlogx(around).sum() - 2 * xlogx(around.sum(axis=1) / 2).sum())


def place_words(train: DataFrame, model: ClassModel) -> tuple[ClassModel, DataFrame]:
    """The model with an exchanged class of its own for every training word, its context not yet learnt, and (word, n, cls) of all
    words that are no units.

    Units keep the classes that they have. Every other word starts in the class of its ending, and is moved in sweeps to the class
    that raises the likelihood of the units' classes beside it most. A sweep moves all words at once. Where that loses, as many words
    made way for each other, it is not kept: the next one moves half as many, drawn anew, and after a gain twice as many. The last
    sweep gains next to nothing for its share of the words, or would move less than one.
    """
    words, k, end = model.words, model.words.clustered, model.words.symbols - 1
    fixed = model.fixed
    size, start = len(fixed), model.cls[k:end]
    names = ["word", "n", "codes", "amounts", "cls"]
    schema = "word binary, n long, codes binary, amounts binary, cls short"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.RecordBatch] = []  # the next batch may have more rows of its word
        for batch in together(batches):
            found = added_up(pa.concat_batches([*last, batch]))
            last = [found.slice(len(found) - 1)]
            yield placed(found.slice(0, len(found) - 1))
        for found in last:
            yield placed(found)

    def placed(found: pa.RecordBatch) -> pa.RecordBatch:
        row, code, n = counted(found)
        total = np.bincount(row, weights=n * (code < AFTER), minlength=len(found)).astype(int)
        cls = start[np.array([ending(w) for w in found.column("word").to_pylist()], int)]
        return pa.RecordBatch.from_arrays(
            [found.column("word"), pa.array(total), found.column("codes"), found.column("amounts"), pa.array(cls, pa.int16())], names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size * 256)
        for batch in together(batches):
            row, code, n = counted(batch)
            out += np.bincount(batch.column("cls").to_numpy()[row].astype(int) << 8 | code, weights=n, minlength=size * 256)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(int))], ["at", "n"])

    def around_all(state: DataFrame) -> np.ndarray:
        found = state.select("codes", "amounts", "cls").mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = fixed.copy()
        out.reshape(-1)[found["at"].to_numpy()] += found["n"].to_numpy()
        return out

    def sweep(state: DataFrame, around: np.ndarray, share: float, turn: bytes) -> DataFrame:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves = Moves(around)
            for batch in together(batches):
                cls = batch.column("cls").to_numpy().astype(int)
                drawn = np.ones(len(cls), bool)
                if share < 1:
                    drawn[:] = [zlib.crc32(w + turn) < share * 2**32 for w in batch.column("word").to_pylist()]
                if drawn.any():
                    cls[drawn] = best(moves, batch.select(["codes", "amounts"]).filter(pa.array(drawn)), cls[drawn])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cls, pa.int16())], names)

        def best(moves: Moves, batch: pa.RecordBatch, cls: np.ndarray) -> np.ndarray:
            first, number = alike(batch, cls)
            parts, cls = batch.take(pa.array(first)), cls[first]
            ends = range(0, len(first), SWEPT_ROWS)
            return np.concatenate([moves.best(*counted(parts.slice(at, SWEPT_ROWS)), cls[at:at + SWEPT_ROWS]) for at in ends])[number]

        return stored(state.mapInArrow(move, schema), "classes")

    state = stored(neighbours(train, model).mapInArrow(begin, schema), "classes")
    around, rows = around_all(state), state.count()
    share, turn = 1.0, 0
    while share * rows >= 1:
        moved = sweep(state, around, share, turn.to_bytes(2, "big"))
        after = around_all(moved)
        before, now = around_likelihood(around), around_likelihood(after)
        turn += 1
        if now <= before:
            discard_stored(moved)
            share /= 2
            continue
        discard_stored(state)
        state, around = moved, after
        if now - before < TOLERANCE * share * abs(before):
            break
        share = min(1.0, 2 * share)

    table = list(words.count)
    alone = train.sparkSession.createDataFrame([(w,) for w in table[k:]], "word binary")
    found = {bytes(r["word"]): r["cls"] for r in state.join(F.broadcast(alone), "word").select("word", "cls").collect()}
    cls = np.concatenate([model.cls[:k], np.array([found[w] for w in table[k:]], int), model.cls[k:]])
    own = Vocabulary({w: i for i, w in enumerate(table)}, words.count, len(table))
    return replace(model, words=own, cls=cls), state.select("word", "n", "cls")


def learn_context(filled: DataFrame, model: ClassModel, counts: DataFrame) -> ClassModel:
    """The model with the transitions of the classes in training texts, from with_classes and place_words."""
    end = int(model.cls[-1])
    width = end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width * width, np.int64)
        for batch in batches:
            cls = np.frombuffer(bytes([end]) + b"".join(c + bytes([end]) for c in batch.column("classes").to_pylist()), np.uint8).astype(int)
            out += np.bincount(cls[:-1] * width + cls[1:], minlength=width * width)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    found = filled.select("classes").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width * width)
    table[found["at"].to_numpy()] = found["n"].to_numpy()
    distinct = np.bincount([*model.cls[:model.units], end], minlength=width).astype(float)
    for row in counts.groupBy("cls").count().collect():
        distinct[row["cls"]] += row["count"]
    return with_context(model, table.reshape(width, width), distinct)


ENCODED = "id {id}, row long, n_tokens long, n_known long, head_score double, classes binary, at binary, rare array<struct<word:binary,n:int>>"


def encode(docs: DataFrame, model: ClassModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored texts as a byte of class for each word, RARE for those outside the table, which are listed once and by place."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = list(m.words.count)
        places = dict(zip(table, itertools.count()))
        weight = np.log10(np.array([*m.words.count.values(), 0]) + ADD)  # the last place, -1, is that of rare words
        cls = np.array([*(m.cls[m.words.symbol[w]] for w in table), RARE], np.uint8)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            once, times, ends = [], [], [0]
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                place = np.array([places.get(w, -1) for w in words], int)
                met = [words[i] for i in np.flatnonzero(place < 0)]
                rare = Counter(met)
                listed = dict(zip(rare, itertools.count()))
                head = np.log10(m.ends + ADD) + weight[place[place >= 0]].sum()
                values = (len(words) + 1, len(words) - len(met) + (m.ends > 0), float(head), cls[place].tobytes(),
                          np.array([listed[w] for w in met], np.int32).tobytes())
                for col, v in zip(cols, values):
                    col.append(v)
                once += rare
                times += rare.values()
                ends.append(len(once))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            words = pa.StructArray.from_arrays([pa.array(once, pa.binary()), pa.array(times, pa.int32())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)],
                ["id", "row", "n_tokens", "n_known", "head_score", "classes", "at", "rare"])

    return stored(docs.mapInArrow(write, ENCODED.format(id=docs.schema["id"].dataType.simpleString())), "parts")


FILLED = "id {id}, n_tokens long, n_known long, weight double, classes binary"


def with_classes(parts: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, weight, classes) of encoded texts: rare words meet their counts and classes in a join."""
    of_ending = F.element_at(F.lit([int(c) for c in model.cls[model.words.clustered:-1]]), (ending_column(F.col("word")) + 1).cast("int"))
    cls = F.coalesce(F.col("cls").cast("int"), of_ending) if "cls" in counts.columns else of_ending
    rare = parts.select("row", F.posexplode("rare").alias("place", "r")).select("row", "place", "r.word", F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.collect_list(F.col("place").cast("long") * 256 + cls).alias("places"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            ends, values = places.offsets.to_numpy(), places.values.to_numpy()
            out = []
            for i, (classes, at) in enumerate(zip(batch.column("classes").to_pylist(), batch.column("at").to_pylist())):
                if at:
                    known = values[ends[i]:ends[i + 1]]
                    of_place = np.empty(len(known), np.uint8)
                    of_place[known >> 8] = known & 255
                    whole = np.frombuffer(classes, np.uint8).copy()
                    whole[whole == RARE] = of_place[np.frombuffer(at, np.int32)]
                    classes = whole.tobytes()
                out.append(classes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["id", "n_tokens", "n_known", "weight", "classes"])

    return parts.drop("rare").join(met, "row", "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))).alias("weight"), "classes", "at", "places",
    ).mapInArrow(fill, FILLED.format(id=parts.schema["id"].dataType.simpleString()))


def score_filled(filled: DataFrame, model: ClassModel) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) from with_classes."""
    end, context = int(model.cls[-1]), model.context

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for classes in batch.column("classes").to_pylist():
                s = np.frombuffer(bytes([end]) + classes + bytes([end]), np.uint8)
                found.append(float(context[s[:-1], s[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.float64())], ["id", "n_tokens", "n_known", "weight", "context"])

    schema = f"id {filled.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, weight double, context double"
    return filled.mapInArrow(score, schema).select(
        "id", "n_tokens", "n_known", (F.col("weight") - F.col("n_tokens") * float(np.log10(model.whole))).alias("base_score"),
        (F.col("weight") + F.col("context")).alias("score"))


def score_texts(docs: DataFrame, model: ClassModel, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of all texts; words whose counts have no class have that of their ending."""
    return score_filled(with_classes(encode(docs, model, key, text), model, counts), model)
