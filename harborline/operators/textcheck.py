"""Numeric checks of drafted text.

`extract_numbers` scans the tokens around each number, so it is an Arrow function over batches; all else is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: units and their scales, and the words that decide what a number is
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
WEIGHTS = {"kg"}
SPANS_OF_TIME = {"day", "week", "month", "quarter", "year", "period", "window"}
LABELS = {"EU", "G"}
FALLING = {"down", "fell", "lost"}
FALLING_STEMS = {"cut", "declin", "decreas", "drop", "fall", "loss", "reduc"}

_TOKEN = re.compile(r"(?P<number>[0-9]+)|(?P<word>[^\W\d_]+)|(?P<space>\s+)|(?P<mark>.)", re.DOTALL)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Scan:
    """A text as runs of digits, runs of letters, white space and single marks; places are those of the list."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("end", "", len(self.text), len(self.text))

    def joined(self, i: int) -> bool:
        """Whether token i and the one before make one word."""
        return all(t.kind in ("number", "word") or t.text == "_" for t in (self.at(i - 1), self.at(i)))

    def skip(self, i: int, marks: str = "", most: int | None = None, step: int = 1) -> int:
        """The first place from i on that is neither white space nor one of the marks; over `most` tokens at most."""
        gone = 0
        while (most is None or gone < most) and (self.at(i).kind == "space" or (self.at(i).kind == "mark" and self.at(i).text in marks)):
            i, gone = i + step, gone + 1
        return i

    def number(self, i: int, least: int, most: int) -> bool:
        """Whether token i is a whole word of so many digits."""
        t = self.at(i)
        return t.kind == "number" and least <= len(t.text) <= most and not self.joined(i + 1)

    def year(self, i: int) -> bool:
        return self.number(i, 4, 4) and self.at(i).text[:2] in ("19", "20")

    def no_facts(self) -> set[int]:
        """Places of digits that state no fact: years, spans of time, codes, numbered labels, chapters."""
        out: set[int] = set()
        for i, t in enumerate(self.tokens):
            if t.kind == "number" and not self.joined(i):
                k = self.skip(i + 1, "-")
                span = self.at(k).kind == "word" and self.at(k).text.lower().removesuffix("s") in SPANS_OF_TIME and not self.joined(k + 1)
                if self.year(i) or (k > i + 1 and (span or self.year(k))):  # a day before a year is part of a date
                    out.add(i)
            elif t.kind == "word" and not self.joined(i):
                out |= self._named(i, t.text)
        return out

    def _named(self, i: int, word: str) -> set[int]:
        """Places of the digits that the word at i names."""
        low, out = word.lower(), set()
        dash = i + 1 + (self.at(i + 1).text == "-")
        if word in LABELS and self.number(dash, 1, 3):
            out.add(dash)
        version = low == "cn" and self.at(i + 1).text == "8"
        if low in ("hs", "code", "codes") or version:
            k = self.skip(i + 1 + version)
            if self.number(k, 4, 8):
                out |= {k, i + 1} if version else {k}
        k = self.skip(i + 1)
        first = k if low in ("chapter", "chapters") and k > i + 1 else self._short_gap(i + 1) if low == "hs" else None
        if first is not None and self.at(first).kind == "number" and len(self.at(first).text) <= 2:
            if self.at(first + 1).text in ("-", "/", "\u2013") and self.number(first + 2, 1, 2):
                out |= {first, first + 2}
            elif self.number(first, 1, 2):
                out.add(first)
        return out

    def _short_gap(self, i: int) -> int:
        """i, or the place after one hyphen or one white space character."""
        t = self.at(i)
        return i + 1 if t.text == "-" or (t.kind == "space" and len(t.text) == 1) else i

    def amount(self, i: int, masked: set[int]) -> tuple[int, int, str]:
        """(place after it, end, digits) of the number that begins at i: groups of three after commas, then a decimal part."""
        digits, k = self.at(i).text, i + 1
        while len(self.at(i).text) <= 3 and self.at(k).text == "," and self.at(k + 1).kind == "number" and len(self.at(k + 1).text) >= 3 and k + 1 not in masked:
            digits, k = digits + self.at(k + 1).text[:3], k + 2
            if len(self.at(k - 1).text) > 3:  # a longer group ends the number
                return k, self.at(k - 1).start + 3, digits
        if self.at(k).text == "." and self.at(k + 1).kind == "number" and k + 1 not in masked:
            digits, k = f"{digits}.{self.at(k + 1).text}", k + 2
        return k, self.at(k - 1).end, digits

    def before(self, i: int) -> tuple[int, str]:
        """(where the number at i begins, its sign): a sign and a euro sign in front belong to it unless a word does too."""
        free = lambda k: not (self.at(k).kind == "number" or (self.at(k).kind == "word" and self.at(k).text.isascii()))
        signed = self.at(i - 1).text in ("+", "-")
        k = i - 1 if signed else i
        euro = self.skip(k - 1, step=-1)
        if self.at(euro).text == "€" and free(euro - 1):
            return self.at(euro).start, self.at(i - 1).text if signed else ""
        if signed and free(i - 2):
            return self.at(i - 1).start, self.at(i - 1).text
        return self.at(i).start, ""

    def falls(self, start: int, end: int) -> bool:
        """Whether a word of decrease lies between two characters' places."""
        for i, t in enumerate(self.tokens):
            low = t.text.lower()
            if t.kind == "word" and start <= t.start < end and not self.joined(i):
                if low in FALLING and t.end <= end and not self.joined(i + 1):
                    return True
                if any(low.startswith(x) and t.start + len(x) <= end for x in FALLING_STEMS):
                    return True
        return False


def numbers_in(text: str, near: int = 40) -> list[tuple[str, float, str]]:
    """(raw, value, kind) of each number: pct (as a fraction), currency (with a scale) or count.

    A percentage without a sign is negative where a word of decrease stands within `near` characters.
    """
    scan, out, i = Scan(text), [], 0
    masked = scan.no_facts()
    while i < len(scan.tokens):
        t, last = scan.at(i), scan.at(i - 1)
        inside = last.end == t.start and (last.kind == "number" or (last.kind == "word" and last.text[-1].isascii()))
        if t.kind != "number" or i in masked or inside:
            i += 1
            continue
        start, sign = scan.before(i)
        k, end, digits = scan.amount(i, masked)
        u, value = scan.skip(k), float(digits)
        unit = scan.at(u).text.lower() if end == scan.at(k - 1).end else ""
        known = unit == "%" or (unit in SCALES or unit in WEIGHTS) and not scan.joined(u + 1)
        unit, end = (unit, scan.at(u).end) if known else ("", end)
        if sign == "-" or (unit == "%" and not sign and scan.falls(max(0, start - near), end + near)):
            value = -value
        kind = "pct" if unit == "%" else "currency" if unit in SCALES else "count"
        out.append((text[start:end], value / 100 if kind == "pct" else value * SCALES.get(unit, 1.0), kind))
        i = u + 1 if known else k
    return out


def extract_numbers(drafts: DataFrame) -> DataFrame:
    """draft_id, at, raw, value, kind for every number of every draft (draft_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, *x) for k, t in zip(b.column("draft_id").to_pylist(), b.column("text").to_pylist(), strict=True) for i, x in enumerate(numbers_in(t or ""))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["draft_id", "at", "raw", "value", "kind"])

    return drafts.select(F.col("draft_id").cast("string").alias("draft_id"), "text").mapInArrow(run, "draft_id string, at int, raw string, value double, kind string")


def flatten_facts(sheets: DataFrame, key: str = "draft_id", facts: str = "facts") -> DataFrame:
    """(key, path, value) of a map of facts."""
    return sheets.select(key, F.explode(facts).alias("path", "value"))


def verify_numbers(numbers: DataFrame, facts: DataFrame, pct: float = 0.005, currency: float = 0.05, count: float = 0.5) -> DataFrame:
    """Each number with its nearest fact (draft_id, path, value) and whether it lies within the tolerance of its kind."""
    f = facts.select("draft_id", "path", F.col("value").alias("fact"))
    j = numbers.join(f, "draft_id", "left")
    far = F.abs(F.col("value") - F.col("fact"))
    by_size = F.abs(F.abs("value") - F.abs("fact"))
    distance = F.when(F.col("kind") == "pct", F.least(far, by_size)).otherwise(far)
    limit = F.when(F.col("kind") == "pct", F.lit(pct)).when(F.col("kind") == "currency", currency * F.abs("fact")).otherwise(F.lit(count))
    best = F.min_by(F.struct("path", "fact"), F.struct(distance.alias("d"), F.col("path")))
    v = j.groupBy("draft_id", "at", "raw", "value", "kind").agg(best.alias("best"), F.coalesce(F.bool_or(distance <= limit), F.lit(False)).alias("verified"))
    return v.select("draft_id", "at", "raw", "value", "kind", F.col("best.path").alias("nearest"), F.col("best.fact").alias("nearest_value"), "verified")


def validate_drafts(drafts: DataFrame, catalogue: DataFrame, verified: DataFrame) -> DataFrame:
    """The first reason against each draft (draft_id, text, hypothesis_ids), or `ok`."""
    ids = drafts.select("draft_id", F.explode_outer("hypothesis_ids").alias("hypothesis_id"))
    unknown = ids.where("hypothesis_id is not null").join(catalogue.select("hypothesis_id"), "hypothesis_id", "left_anti").groupBy("draft_id").agg(F.count("*").alias("n_unknown"))
    failed = verified.where(~F.col("verified")).groupBy("draft_id").agg(F.count("*").alias("n_failed"))
    j = drafts.join(unknown, "draft_id", "left").join(failed, "draft_id", "left")
    reason = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_text").when(F.coalesce(F.size("hypothesis_ids"), F.lit(0)) <= 0, "no_hypothesis")
        .when(F.col("n_unknown") > 0, "unknown_hypothesis").when(F.col("n_failed") > 0, "unverified_number").otherwise("ok")
    )
    return j.select("draft_id", reason.alias("reason"))


def corroboration_steps(drafts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The steps of a draft's hypotheses in catalogue order, each once.  catalogue: hypothesis_id, ord, steps."""
    j = drafts.select("draft_id", F.explode("hypothesis_ids").alias("hypothesis_id")).join(catalogue, "hypothesis_id")
    listed = j.groupBy("draft_id").agg(F.array_sort(F.collect_set(F.struct("ord", "steps"))).alias("all"))
    return listed.select("draft_id", F.array_distinct(F.flatten(F.col("all.steps"))).alias("steps"))


def rejection_rates(log: DataFrame) -> DataFrame:
    """Counts and shares by stage, reason and model."""
    n = log.groupBy("stage", "reason", "model").agg(F.count("*").alias("n"))
    total = log.groupBy("stage").agg(F.count("*").alias("_t"))
    return n.join(total, "stage").withColumn("share", F.col("n") / F.col("_t")).drop("_t")
