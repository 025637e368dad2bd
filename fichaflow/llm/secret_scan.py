"""Secret scan: all rules in one automaton, one pass over the bytes of each whole text.

The combined automaton reads a text backwards and marks, for all rules at once, the bytes at which a match begins. From
the leftmost start of a rule its own automaton runs forward to the longest end, and goes on behind it. So every rule gets
its leftmost-longest matches without overlap; for these rules they are those of a backtracking search as well, since no
rule can match in two ways from one start. A match that fails the rule's lengths is dropped and its bytes stay used.

Null and empty texts have no spans. Rows are independent: ties, repeated rows, further columns and empty tables need no
care; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fichaflow.llm.automaton import compile_patterns

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group: number of the group that must have `min_group` characters or more (0: none must)."""

    kind: str
    pattern: str
    min_length: int = 0
    group: int = 0
    min_group: int = 0


# The rules that every result rests on.
BASE_RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2, min_group=6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Public shapes of further credentials, reported beside the base rules.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", min_length=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", min_length=39),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", min_length=24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", min_length=40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", "[a-z]+://[^/@:\\x20\\x09-\\x0D]+:[^/@:\\x20\\x09-\\x0D]+@"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"


class Scanner:
    """The automata of some rules; built once on the driver and sent with the job as transition arrays."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.starts = compile_patterns([r.pattern for r in rules], backwards=True, anywhere=True)
        self.ends = [compile_patterns([r.pattern]) for r in rules]
        self.groups = [re.compile(r.pattern.encode()) if r.group else None for r in rules]
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) in bytes, by start and then rule."""
        if self._rows is None:
            self._rows = self.starts.rows(), [a.rows() for a in self.ends]
        rows, forward = self._rows
        hits: list[tuple[int, int]] = []
        row = rows[0]
        for at, b in zip(range(len(data) - 1, -1, -1), reversed(data)):
            row = row[b]
            if row[256]:
                hits.append((at, row[256]))
        found = []
        behind = [0] * len(self.rules)
        for at, bits in reversed(hits):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and at >= behind[k]:
                    end = behind[k] = _longest(forward[k], data, at)
                    if end - at >= rule.min_length and (
                        not rule.group or len(self.groups[k].fullmatch(data, at, end)[rule.group]) >= rule.min_group
                    ):
                        found.append((at, end, k))
        return found


def _longest(rows: list[list], data: bytes, at: int) -> int:
    """The end of the longest match that begins at a byte."""
    row, end = rows[0], at
    for i in range(at, len(data)):
        row = row[data[i]]
        if row is None:
            break
        if row[256]:
            end = i + 1
    return end


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the spans of all rules: code points from 0, end exclusive, by start and then rule as listed."""
    scanner = Scanner(rules)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: in_code_points(scanner, t) if t else [])

    return docs.withColumn(into, spans(F.col(f"`{text}`")))


def code_points(data: bytes, positions: Iterable[int]) -> dict[int, int]:
    """Code points ahead of each byte position, counted once over the text."""
    out, done, count = {}, 0, 0
    for at in sorted(set(positions)):
        count += len(data[done:at].decode("utf-8", "surrogatepass"))
        out[at] = count
        done = at
    return out


def in_code_points(scanner: Scanner, text: str) -> list[dict]:
    data = text.encode("utf-8", "surrogatepass")
    found = scanner.spans(data)
    kind = lambda k: scanner.rules[k].kind
    if len(data) == len(text):
        return [{"kind": kind(k), "start": at, "end": end} for at, end, k in found]
    point = code_points(data, (x for span in found for x in span[:2]))
    return [{"kind": kind(k), "start": point[at], "end": point[end]} for at, end, k in found]


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans (of some kinds), comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace every stretch of a text that spans cover, alone or overlapping, by a mark; other texts stay as they are."""
    scanner = Scanner(rules)

    @F.pandas_udf(T.StringType())
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_spans(scanner, t, mark) if t else t)

    return docs.withColumn(text, cleaned(F.col(f"`{text}`")))


def without_spans(scanner: Scanner, text: str, mark: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    out, done = [], 0
    for at, end, _ in scanner.spans(data):
        if end <= done:
            continue
        if at >= done:
            out += [data[done:at], mark.encode()]
        done = end
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass") if out else text
