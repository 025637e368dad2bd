"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words: each blank begins one, and one blank is put before the text. Line feeds stand alone, as
no piece holds one. Of the words of a batch, the distinct ones are sorted, which lists the leaves of their trie
depth first. The forward scores of a word are kept per position, so the next word starts at the end of the prefix that
both share. An automaton of all pieces, in Aho and Corasick's way, is led over the characters, whose state lists the pieces that end
at a position. A model made by merges has no likelihoods but ranks; by Zipf's law a piece of rank r gets the score -log(r + ZIPF).
The best path has the largest sum of piece scores; among equal ones the one whose last piece is longer, at
each position. A character that is no piece costs `UNKNOWN_COST` more than the worst piece and becomes its UTF-8 bytes.
So does the mark itself where a text has it, and decoding gives back every text exactly.

Null texts have null ids, empty ones none. Rows are independent: ties, repeated rows, further columns and empty tables
need no care; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
UNKNOWN_COST = 10.0
#: Offset of ranks in Zipf's law.
ZIPF = 100
#: Words whose ids a worker remembers; longer words are not kept.
MEMORY_WORDS, MEMORY_CHARS = 200_000, 40
_WORD = re.compile(f" [^ \n{MARK}]*|[^ \n{MARK}]+|[\n{MARK}]")


class Pieces:
    """A vocabulary: scores and ids of the pieces (the mark written as a blank), and ids of the 256 byte pieces."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], skip: Iterable[int] = ()):
        self.byte_ids = byte_ids
        skip = set(skip) | set(byte_ids)
        self.found = {
            p.replace(MARK, " "): (s, i) for i, (p, s) in enumerate(zip(names, scores)) if i not in skip and p}
        self.unknown = min((s for s, _ in self.found.values()), default=0.0) - UNKNOWN_COST
        self.bytes = [p.replace(MARK, " ").encode() if i not in skip else b"" for i, p in enumerate(names)]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> "Pieces":
        """Read a model file on the driver; its size does not depend on the data."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)]
        skip = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        scores = [model.get_score(i) for i in ids]
        usable = sorted({-scores[i] for i in ids if i not in {*skip, *byte_ids}})
        if all(s >= 0 and s == int(s) for s in usable):  # ranks of merges
            scores = [-math.log(ZIPF + max(-s, 0.0)) for s in scores]
        return cls(names, scores, byte_ids, skip)

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    @cached_property
    def automaton(self) -> tuple[list[dict[str, int]], list[int], list[tuple[tuple[int, float], ...]]]:
        """Of each state, the states by the next character, the state of the longest shorter suffix, and (length, score) of the pieces
        that end there, the shorter ones first."""
        to: list[dict[str, int]] = [{}]
        fail, hits = [0], [()]
        for piece, (score, _) in self.found.items():
            state = 0
            for char in piece:
                state = to[state].setdefault(char, len(to))
                if state == len(to):
                    to.append({})
                    fail.append(0)
                    hits.append(())
            hits[state] = ((len(piece), score),)
        layer = list(to[0].values())
        while layer:
            for state in layer:
                hits[state] = hits[fail[state]] + hits[state]
                for char, after in to[state].items():
                    shorter = fail[state]
                    while shorter and char not in to[shorter]:
                        shorter = fail[shorter]
                    fail[after] = to[shorter].get(char, 0)
            layer = [after for state in layer for after in to[state].values()]
        return to, fail, hits

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, by one depth-first walk over their trie."""
        found, unknown = self.found, self.unknown
        to, fail, hits = self.automaton
        out: dict[str, list[int]] = {}
        best, back, states, last = [0.0], [0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:], states[shared + 1:]
            state = states[shared]
            for end, char in enumerate(word[shared:], shared + 1):
                after = to[state].get(char)
                while after is None and state:
                    state = fail[state]
                    after = to[state].get(char)
                state = after or 0
                top, start = best[-1] + unknown, end - 1
                for length, score in hits[state]:
                    score += best[-length]
                    if score >= top:
                        top, start = score, end - length
                best.append(top)
                back.append(start)
                states.append(state)
            ids: list[int] = []
            end = len(word)
            while end:
                start = back[end]
                hit = found.get(word[start:end])
                ids += reversed(self.fallback(word[start:end])) if hit is None else (hit[1],)
                end = start
            out[word] = ids[::-1]
            last = word
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes batches of texts; remembers the ids of words, as bytes, from batch to batch.

    Words fill one memory. When it is full it becomes the older one, whose words come back when they are met, and a new one begins; so
    frequent words stay, and no more than two memories are held.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else _WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.memory) > MEMORY_WORDS:
            self.memory, self.older = {}, self.memory
        known, older = self.memory, self.older
        known[MARK] = array("i", self.pieces.fallback(MARK)).tobytes()
        missing = [w for w in set(chain.from_iterable(c for c in cut if c)) if w not in known]
        known.update((w, older[w]) for w in missing if w in older)
        new = self.pieces.encode_words(w for w in missing if w not in known)
        known.update((w, array("i", ids).tobytes()) for w, ids in new.items())
        out = [None if c is None else np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32) for c in cut]
        for word in new:
            if len(word) > MEMORY_CHARS:
                del known[word]
        return out


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the piece ids of every whole text, as array<int>."""
    # a worker keeps its copy of the encoder, and so the words that this remembers, for all its tasks
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(Pieces.load(model_file)))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encoder.value.encode([None if t is None else t for t in batch]), dtype=object)

    return docs.withColumn(into, encode(F.col(f"`{text}`")))


def decode_ids(docs: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that piece ids stand for; null ids give a null text."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_file))

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else pieces.value.decode(x.tolist()))

    return docs.withColumn(into, decode(F.col(f"`{ids}`")))
