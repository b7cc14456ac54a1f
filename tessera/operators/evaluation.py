"""Scoring of answers against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"
RANGE = r"(\d+(?:\.\d+)?)\s*(?:-|~|–|—|至|到)\s*(\d+(?:\.\d+)?)"


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def answer_numbers(text: Column) -> Column:
    """The numbers of an answer, and both ends of its ranges: ``8-10`` holds 10 as well as -10."""
    ends = lambda g: F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(g)), lambda x: x.cast("double"))
    return F.concat(numbers(text), ends(1), ends(2))


def unknown_ids(text: Column, families: dict[str, tuple[int, int]], digits: int = 3) -> Column:
    """Ids in a text, a family's letters and some digits, whose number is outside the family's range."""
    longest = "|".join(sorted(families, key=lambda f: (-len(f), f)))
    pattern = rf"\b(?:{longest})\d{{{digits}}}\b"
    limits = F.create_map(*(F.lit(v) for f, (lo, hi) in families.items() for v in (f, f"{lo:0{digits}d}-{hi:0{digits}d}")))

    def outside(x: Column) -> Column:
        number, limit = F.regexp_extract(x, r"(\d+)$", 1), F.element_at(limits, F.regexp_extract(x, r"^(.*?)\d+$", 1))
        return (number < F.substring_index(limit, "-", 1)) | (number > F.substring_index(limit, "-", -1))

    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), outside)))


def fields(text: Column) -> Column:
    """field=value parts of an answer as a map."""
    parts = F.filter(F.split(text, r"[，,;；]\s*"), lambda p: p.rlike(r"^\s*[^=]+=[^=]+$"))
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring_index(p, "=", -1)).alias("v")))
    return F.map_from_entries(F.array_distinct(entries))


def approximately(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(b) * tolerance, F.lit(tolerance))


def score_answers(answers: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(case_id, score, status) of (case_id, answer, key_facts): a fact is met where the answer contains it, letter
    for letter; for a number, where it is one of the answer's; for one after ≈, where one is within the tolerance. pass at 1, partial from 0.5, else fail."""
    found = answer_numbers(F.col("answer"))

    def hit(f: Column) -> Column:
        near = F.exists(found, lambda n: approximately(n, F.regexp_replace(f, "^≈", "").try_cast("double"), tolerance))
        exact = F.exists(found, lambda n: n == F.trim(f).try_cast("double"))
        inside = F.contains("answer", f)
        return F.when(f.rlike(rf"^≈\s*{NUMBER}\s*$"), near).when(f.rlike(rf"^\s*{NUMBER}\s*$"), exact).otherwise(inside)

    met = F.transform("key_facts", lambda f: hit(f).cast("int"))
    share = F.when(F.size("key_facts") == 0, 1.0).otherwise(F.aggregate(met, F.lit(0), lambda a, x: a + x) / F.size("key_facts"))
    status = F.when(share >= 1, "pass").when(share >= 0.5, "partial").otherwise("fail")
    return answers.select("case_id", share.alias("score"), status.alias("status"))
