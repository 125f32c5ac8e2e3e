"""Recognisers with spans: patterns with checks, words that must stand near, dictionaries of names; overlaps resolved, one replacement."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of all dictionaries together, at most: they travel to every task.
MOST_NAMES = 1_000_000
SPAN = "struct<start:int,end:int,entity:string,score:double>"


def luhn(text: str) -> bool:
    """Whether the digits of a card number have its check sum."""
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def iban(text: str) -> bool:
    """Whether an account number has 15 to 34 characters and its check sum, the remainder 1 of 97."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def octets(text: str) -> bool:
    return all(int(x) <= 255 for x in text.split("."))


def phone(text: str) -> bool:
    return 9 <= sum(c.isdigit() for c in text) <= 15


@dataclass(frozen=True)
class Recogniser:
    """What matches the pattern, holds by the check and has one of the words within 40 characters before it, is the entity."""

    entity: str
    pattern: str
    score: float
    check: Callable[[str], bool] | None = None
    near: tuple[str, ...] = ()


#: The recognisers that are known without more; patterns are ASCII ones.
DEFAULT = (
    Recogniser("EMAIL_ADDRESS", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 1.0),
    Recogniser("API_KEY", r"(?:AIza[0-9A-Za-z\-_]{35}|hf_[A-Za-z0-9]{34}|sk-(?:proj-|ant-)?[A-Za-z0-9\-_]{48,})", 1.0),
    Recogniser("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, iban),
    Recogniser("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 0.9, luhn),
    Recogniser("US_SSN", r"\b(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}\b", 0.85),
    Recogniser("US_ITIN", r"\b9\d{2}[- ](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[- ]\d{4}\b", 0.85),
    Recogniser("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.8, octets),
    Recogniser("US_PASSPORT", r"\b(?:[A-Z]\d{8}|\d{9})\b", 0.75, None, ("passport",)),
    Recogniser("US_BANK_NUMBER", r"\b\d{8,17}\b", 0.72, None, ("account", "acct", "bank", "routing")),
    Recogniser("PHONE_NUMBER", r"(?<!\w)(?:\+?\d[\d .()\-]{7,}\d)(?!\w)", 0.7, phone),
)
#: Score of a name from a dictionary.
NAMED = 0.6


class Finder:
    """Finds the spans of a text. Patterns are compiled and dictionaries built once per worker."""

    def __init__(self, recognisers: tuple[Recogniser, ...] = DEFAULT, names: dict[str, list[str]] | None = None, entities: list[str] | None = None):
        self.recognisers = tuple(r for r in recognisers if entities is None or r.entity in entities)
        self.names = {e: [n for n in v if n.strip()] for e, v in (names or {}).items() if entities is None or e in entities}
        if sum(map(len, self.names.values())) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} names")
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _make(self):
        automaton = None
        if any(self.names.values()):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for entity, names in self.names.items():
                for n in names:
                    automaton.add_word(n, (n, entity))
            automaton.make_automaton()
        return [(r, re.compile(r.pattern, re.ASCII)) for r in self.recognisers], automaton

    def candidates(self, text: str) -> list[tuple[int, int, str, float]]:
        """start, end, entity, score of all that is found, overlaps included. Names must be whole words, of any script."""
        self._ready = self._ready or self._make()
        patterns, automaton = self._ready
        out = []
        for r, p in patterns:
            for m in p.finditer(text):
                if r.near and not any(w in text[max(0, m.start() - 40) : m.start()].lower() for w in r.near):
                    continue
                if r.check is None or r.check(m[0]):
                    out.append((m.start(), m.end(), r.entity, r.score))
        if automaton is not None:
            for last, (name, entity) in automaton.iter(text):
                a, b = last + 1 - len(name), last + 1
                if not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                    out.append((a, b, entity, NAMED))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Candidates that don't overlap, in order: the surer one stays, of equally sure ones the longer, then the first."""
        taken: list[tuple[int, int, str, float]] = []
        for c in sorted(self.candidates(text or ""), key=lambda c: (-c[3], c[0] - c[1], c[0], c[2])):
            if all(c[1] <= t[0] or t[1] <= c[0] for t in taken):
                taken.append(c)
        return sorted(taken)

    def scrub(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with each span replaced by <ENTITY>, in one pass, and the entities found."""
        found = self.spans(text)
        if not found:
            return text, []
        out, at = [], 0
        for a, b, entity, _ in found:
            out += [text[at:a], f"<{entity}>"]
            at = b
        return "".join(out) + text[at:], [e for *_, e, _ in found]


def may_have(text: Column, finder: Finder) -> Column:
    """Whether a text has what any recogniser needs, a digit, an @ or a key's beginning: other texts don't go to Python. Own recognisers and names look at all."""
    if any(finder.names.values()) or not set(finder.recognisers) <= set(DEFAULT):
        return F.lit(True)
    return F.rlike(text, F.lit(r"[0-9@]|sk-|hf_|AIza"))


def with_spans(df: DataFrame, text: str, finder: Finder = Finder(), name: str = "spans") -> DataFrame:
    """df with the spans of a text column: an array of start, end, entity, score; empty for null texts."""

    @F.pandas_udf(f"array<{SPAN}>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "end", "entity", "score"), s)) for s in finder.spans(t)])

    # texts without a sign are passed as null, so only the others travel
    return df.withColumn(name, find(F.when(may_have(F.col(text), finder), F.col(text))))


def scrubbed(texts: Column, finder: Finder = Finder()) -> Column:
    """An array of texts as an array of (text, found): each with its spans replaced, and the entities of these."""

    @F.pandas_udf("array<struct<text:string,found:array<string>>>")
    def scrub(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: None if ts is None else [dict(zip(("text", "found"), finder.scrub(t))) for t in ts])

    return scrub(texts)


def entity_counts(df: DataFrame, spans: str = "spans") -> DataFrame:
    """entity, n, rows: how often each entity was found, and in how many rows."""
    found = F.col(f"{spans}.entity")
    of_row = F.transform(F.array_distinct(found), lambda e: F.struct(e.alias("entity"), F.size(F.filter(found, lambda x: x == e)).alias("n")))
    return df.select(F.explode(of_row).alias("x")).groupBy("x.entity").agg(F.sum("x.n").alias("n"), F.count("*").alias("rows"))
