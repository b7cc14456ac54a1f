"""Text functions as Column expressions; only Unicode normalisation needs Python, and whole tables are cut into words in Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD_OR_HAN = r"[a-z0-9]+|\p{IsHan}+"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC. ASCII text does not need it: see :func:`normalize_text`."""
    return text.str.normalize("NFKC")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column, unicode_forms: bool = False) -> Column:
    """Lower case, markdown marks and runs of white space as one space. ``unicode_forms`` adds
    NFKC, which leaves the JVM; leave it off for text known to be normalised."""
    base = nfkc(text) if unicode_forms else text
    plain = F.regexp_replace(F.lower(base), r"[`*_~#\[\]()>|]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _ngrams(token: Column, n: int) -> Column:
    count = F.char_length(token) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(token, i, n))
    return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column, han: bool = True, unicode_forms: bool = False) -> Column:
    """Distinct tokens in order: ASCII runs, Han runs, and 2- and 3-grams of Han runs. What :func:`normalize_text` does beyond lower case only
    turns characters that are in no token into others, so it is left out."""
    runs = F.regexp_extract_all(F.lower(nfkc(text) if unicode_forms else text), F.lit(WORD_OR_HAN if han else "[a-z0-9]+"), F.lit(0))
    if not han:
        return F.array_distinct(runs)
    each = F.transform(runs, lambda t: F.when(t.rlike(r"^\p{IsHan}+$"), F.concat(F.array(t), _ngrams(t, 2), _ngrams(t, 3))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(each))


#: Bytes of text that are cut at a time.
PART_BYTES = 1 << 23
_WORD = re.compile("[a-z0-9]+")


def parts(*texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to, in order, with some :data:`PART_BYTES` of the texts or one row."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART_BYTES, "right")))
        yield a, b
        a = b


def ascii_tokens(texts: pa.Array) -> pa.Array:
    """What :func:`tokenize` gives without Han runs, for the texts of a part."""
    ends, flat = np.zeros(len(texts) + 1, np.int32), []
    for i, text in enumerate(texts.to_pylist()):
        if text is not None:
            flat += dict.fromkeys(_WORD.findall(text.lower()))
        ends[i + 1] = len(flat)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.string()), mask=texts.is_null())


def alias_key_query(text: Column) -> Column:
    """Key of a table name at query time: no spaces, brackets or punctuation."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_\-()\[\]（）【】{}《》:：,，.。/\\]+", "")


def alias_key_build(text: Column) -> Column:
    """Key of a table name at build time: no spaces, underscores, slashes or hyphens."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_/\-]+", "")


def normalize_path(text: Column) -> Column:
    """Lower case, forward slashes, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\\", "/"), r"\s+", " "))


def slug(text: Column) -> Column:
    """ASCII slug."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def page_slug(text: Column) -> Column:
    """Slug of letters and digits of any script; a hash where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(plain != "", plain).otherwise(F.concat(F.lit("page-"), F.substring(F.sha1(text), 1, 8)))


def cluster_query(text: Column) -> Column:
    """A feedback query without its tool prefix, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"^[a-z_]+:", "")), r"\s+", " "))


def gap_query_key(text: Column) -> Column:
    key = F.substring(F.regexp_replace(F.lower(strip(text)), r"\s+", " "), 1, 400)
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("empty")).otherwise(key)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-16 code units, 32 bits, as 8 hex digits."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.char_length(digits) / 4).cast("int") - 1), lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.char_length(digits) > 0, units).otherwise(F.array().cast("array<bigint>"))
    # the product of a 32-bit and a 25-bit number fits a long
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    value = F.aggregate(units, F.lit(2166136261).cast("long"), step)
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def snippet(body: Column, terms: Column, length: int = 240) -> Column:
    """The first line that holds any of the terms, else the first that isn't empty."""
    lines = F.split(body, r"\r?\n")
    hit = F.filter(lines, lambda line: F.exists(terms, lambda t: F.contains(normalize_text(line), t)))
    any_line = F.filter(lines, lambda line: line != "")
    return F.substring(F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(any_line, F.lit(1)), F.lit("")), 1, length)


def yaml_scalar(text: Column, key: str) -> Column:
    """The first value of a key at any indent, quotes removed; null when absent."""
    value = F.regexp_extract(text, rf"(?m)^\s*{key}:\s*(.+?)\s*$", 1)
    return F.when(value != "", F.regexp_replace(value, r"^[\"']|[\"']$", ""))


def file_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return (
        F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("docx", "doc"), "document").when(ext.isin("xlsx", "xls", "csv"), "table")
        .when(ext.isin("txt", "json"), "text").otherwise("other")
    )


def loose_json(text: Column) -> Column:
    """JSON out of a model's answer: as it is, without a code fence, or the first object in it."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    checked = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    return F.coalesce(checked(strip(text)), checked(strip(fence)), checked(inner))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def local_day(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """The day of a time zone, dotted."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy.MM.dd")


def local_day_start(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """When the day of a time zone began."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def is_stale(at: Column, now: Column, days: int) -> Column:
    """Whether a time given as text is older than some days; what is missing or no time is."""
    return F.coalesce(now - F.try_to_timestamp(at) > F.make_dt_interval(F.lit(days)), F.lit(True))
