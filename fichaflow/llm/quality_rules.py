"""Quality rules, lines first: lines that fail are removed, then documents that lost too much text are rejected.

A line with a word fails for the first of these reasons that holds:
  symbols      more than a tenth of its word characters are symbols
  navigation   it has three separators of menu entries or more, and one in 40 word characters
  repetition   more than half of its words equal the word before
  boilerplate  it is short and has a phrase of page furniture or licences
  punctuation  no part of it ends like a sentence, with or without closing quotes and brackets
Lines without a word are neither judged nor counted. A document is rejected when under `min_kept` percent of its word
characters are in lines that stay. Ahead of that stand the base rules: fewer than 20 words, or more than 30 % of the
words in 8-word windows that occur twice or more.

Null and empty texts have no words and are rejected. Rows are independent: ties, repeated rows, further columns and empty
tables need no care; columns that have the names of added ones are replaced.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

from fichaflow.llm.words import Words, chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Base rules.
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
SYMBOLS = "[#*$%&|<>]"
# Line rules. A phrase counts in lines of up to SHORT_LINE word characters.
# A menu has MENU_MARKS separators and one in MENU_SPAN word characters; a » counts unless a « of the line pairs it off.
MIN_KEPT_PERCENT, SHORT_LINE, MENU_MARKS, MENU_SPAN = 50, 160, 3, 40
SEPARATORS = "[|>·•]"
SENTENCE_END = "[.!?:;…。！？][\"'”’»)\\]]*( |$)"
PHRASES = (
    "all rights reserved|privacy policy|terms of (use|service)|cookie|click here|sign (in|up)|log in|subscribe|newsletter"
    "|javascript|licensed under|copyright|read more|share this|skip to (main )?content"
)
BLANKS = " \t\n\x0b\x0c\r"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "kept_chars")
ADDED = [T.StructField(x, T.LongType()) for x in _COUNTS] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]


class LineRules:
    def __init__(self):
        self.symbol, self.separator = re.compile(SYMBOLS), re.compile(SEPARATORS)
        self.end, self.phrase = re.compile(SENTENCE_END), re.compile(PHRASES)

    def fails(self, line: str) -> str | None:
        """The reason why a line with a word fails; None if it stays. Upper case counts as lower case in A-Z only."""
        line = line.strip(BLANKS)
        size = chars(line)
        if 10 * len(self.symbol.findall(line)) > size:
            return "symbols"
        marks = len(self.separator.findall(line)) + max(0, line.count("»") - line.count("«"))
        if marks >= MENU_MARKS and MENU_SPAN * marks >= size:
            return "navigation"
        words = line.encode("utf-8", "surrogatepass").split()
        if 2 * sum(map(eq, words, words[1:])) > len(words):
            return "repetition"
        if size <= SHORT_LINE and self.phrase.search(line.translate(LOWER)):
            return "boilerplate"
        return None if self.end.search(line) else "punctuation"


LOWER = {i: i + 32 for i in range(65, 91)}
_NO_BLANKS = {ord(c): None for c in BLANKS}


def chars(text: str) -> int:
    """Code points in words."""
    return len(text.translate(_NO_BLANKS)) if not text.isascii() else len(text) - sum(map(text.count, BLANKS))


def split_lines(rules: LineRules, text: str) -> tuple[list[str], int, int, int, int]:
    """Lines that stay; number of lines with a word, of those that fail, of copies of earlier lines; word characters kept."""
    stay, seen, total, failed, copies, kept = [], set(), 0, 0, 0, 0
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            stay.append(line)
            continue
        total += 1
        copies += line in seen
        seen.add(line)
        if rules.fails(line):
            failed += 1
        else:
            stay.append(line)
            kept += chars(line)
    return stay, total, failed, copies, kept


def repeated_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """Per text, the words covered by windows that occur twice or more in it."""
    hashes, at = words.windows(size)
    texts = words.text_of_word()
    order = np.lexsort((hashes, texts[at]))
    same = (hashes[order][1:] == hashes[order][:-1]) & (texts[at[order]][1:] == texts[at[order]][:-1])
    twice = np.zeros(len(at) + 1, bool)
    twice[1:-1] = same
    twice = at[order[twice[:-1] | np.append(same, False)[:len(at)]]] if len(at) else at
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + size, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return np.diff(covered[words.first])


def clean_lines(docs: DataFrame, text: str = "text", with_text: bool = True, min_kept: int = MIN_KEPT_PERCENT) -> DataFrame:
    """Judge all documents. Adds the counts, `base_failed`, `kept` and, if asked for, `clean_text`: the lines that stay.

    Empty tables give empty results; `clean_text` is null where the text is.
    """
    added = ADDED + [T.StructField("clean_text", T.StringType())] * with_text
    docs = docs.drop(*(f.name for f in added))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = LineRules()
        for batch in batches:
            for part in chunks(batch, text):
                new = judge_batch(rules, part.column(text), min_kept, with_text)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(judge, T.StructType(docs.schema.fields + added))


def judge_batch(rules: LineRules, texts: pa.Array, min_kept: int, with_text: bool) -> list[pa.Array]:
    words = Words(texts)
    total = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[words.text])
    blank = np.isin(words.data, np.frombuffer(BLANKS.encode(), np.uint8))
    word_chars = total(~blank & (words.data & 0xC0 != 0x80))
    n_symbols = total(np.isin(words.data, np.frombuffer(SYMBOLS[1:-1].encode(), np.uint8)))
    n_words, n_repeat = words.counts, repeated_words(words)
    lines = [split_lines(rules, t) if t else ([], 0, 0, 0, 0) for t in texts.to_pylist()]
    n_lines, n_failed, n_copies, kept_chars = (np.array([x[i] for x in lines], np.int64) for i in (1, 2, 3, 4))
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words)
    kept = ~failed & (100 * kept_chars >= min_kept * word_chars)
    new = [n_words, word_chars, n_symbols, n_copies, n_repeat, n_lines, n_failed, kept_chars]
    out = [pa.array(x.astype(np.int64)) for x in new] + [pa.array(failed), pa.array(kept)]
    if with_text:
        out.append(pa.array([None if t is None else "\n".join(x[0]) for t, x in zip(texts.to_pylist(), lines)], pa.string()))
    return out
