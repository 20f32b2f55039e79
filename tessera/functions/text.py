"""Text, hash and JSON columns (STRF-*, HSH-*, PRJ-*)."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_safe(c: Column) -> Column:
    """STRF-01: characters outside A-Z a-z 0-9 . _ - become _; empty or dotted names get a _ in front."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]", "_")
    return F.when((s == "") | s.startswith("."), F.concat(F.lit("_"), s)).otherwise(s)


def file_name(c: Column) -> Column:
    """STRF-02: the first hundred characters without those that file systems refuse; blank gives output."""
    s = F.regexp_replace(F.substring(c, 1, 100), r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit("")), F.lit("output"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form: no built-in has it, so batches go to Python."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised(c: Column) -> Column:
    """STRF-03: NFKC, lower case, punctuation dropped, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def has_cjk(c: Column) -> Column:
    """STRF-04: any character of the CJK, kana or hangul blocks."""
    return c.rlike("[぀-ヿ㐀-䶿一-鿿가-힯]")


@F.pandas_udf(T.DoubleType())
def word_error_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """STRF-05: edits over words of the reference; without reference words 0 for no words, else 1."""

    def rate(a: str | None, b: str | None) -> float:
        r, h = (a or "").split(), (b or "").split()
        if not r:
            return float(bool(h))
        row = list(range(len(h) + 1))
        for i, x in enumerate(r, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(h, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] / len(r)

    return pd.Series([rate(a, b) for a, b in zip(ref, hyp, strict=True)])


def char_error_rate(ref: Column, hyp: Column) -> Column:
    """STRF-05 by characters: edits between whole normalised texts, blanks left out, over characters of the
    reference; without reference characters 0 for none, else 1."""
    a, b = (F.replace(normalised(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")) for c in (ref, hyp))
    return F.when(F.length(a) == 0, (F.length(b) > 0).cast("double")).otherwise(F.levenshtein(a, b) / F.length(a))


def slug(c: Column, default: str = "preset") -> Column:
    """STRF-18: lower case, runs of other characters than a-z and 0-9 as one _, none at the ends."""
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^_+|_+$", ""), F.lit("")), F.lit(default))


def short_value(c: Column) -> Column:
    """STRF-13: up to fourteen characters as they are, else the first twelve; blank is legacy."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(s == "", "legacy").when(F.length(s) <= 14, s).otherwise(F.substring(s, 1, 12))


def markdown_cell(c: Column) -> Column:
    """STRF-11: bars escaped, line ends as blanks, n/a for nulls."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\s*\n\s*", " "), F.lit("n/a"))


def percent_of(c: Column) -> Column:
    """STRF-12: a percentage before a bar, else a fraction a/b as percentage, else null."""
    bar = F.regexp_extract(c, r"(\d{1,3})%\|", 1)
    a, b = F.regexp_extract(c, r"(\d+)/(\d+)", 1), F.regexp_extract(c, r"(\d+)/(\d+)", 2)
    return F.when(bar != "", bar.try_cast("int")).otherwise(F.floor(F.try_divide(a.try_cast("double") * 100, b.try_cast("double"))).cast("int"))


def candidate(*cols: Column) -> Column:
    """PRJ-06: the first text that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def blocked_by_markers(label: Column, markers: list[str], safe: list[str]) -> Column:
    """STRF-10: some token is a marker, unless the whole label is on the safe list."""
    norm = F.trim(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", " "))
    return F.arrays_overlap(F.split(norm, " "), F.array(*map(F.lit, markers))) & ~norm.isin(*safe)


def ascii_json(c: Column) -> Column:
    """JSON whose characters from 127 up are written as escapes of their UTF-16 units."""
    unit = lambda n: F.concat(F.lit(r"\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escape(x: Column) -> Column:
        n = F.ascii(x)
        pair = F.concat(unit(F.lit(0xD800) + F.floor((n - 0x10000) / 0x400)), unit(F.lit(0xDC00) + F.pmod(n - 0x10000, F.lit(0x400))))
        return F.when(n < 127, x).when(n < 0x10000, unit(n)).otherwise(pair)

    return F.when(c.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), escape), "")).otherwise(c)


def canonical_json(m: Column) -> Column:
    """HSH-01: a flat map as JSON with sorted keys, ASCII."""
    return ascii_json(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))))


@F.pandas_udf(T.StringType())
def canonical_json_text(s: pd.Series) -> pd.Series:
    """HSH-01 for nested documents: sorted keys, no blanks, ASCII; malformed documents are null."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return s.map(one)


def fingerprint(m: Column, runtime: list[str]) -> Column:
    """HSH-02: digest of the canonical JSON of a map without its runtime fields."""
    return F.sha2(canonical_json(F.map_filter(m, lambda k, _: ~k.isin(*runtime))), 256)


def profile_id(prefix: str, m: Column) -> Column:
    """HSH-03: a prefix and sixteen hexadecimal digits."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(canonical_json(m), 256), 1, 16))


def sections(c: Column, headings: list[str]) -> dict[str, Column]:
    """STRF-08: the text after each ``Heading:`` line up to the next heading, null where it is missing."""
    names = "|".join(headings)
    got = {h: F.regexp_extract(c, rf"(?ms)^{h}:\s*(.*?)\s*(?=^(?:{names}):|\z)", 1) for h in headings}
    return {h: F.nullif(x, F.lit("")) for h, x in got.items()}


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


CAPTION_KEYS = ("caption", "captions", "cap", "prompt", "text", "description")


def caption_of(record: Column) -> Column:
    """STRF-14: the caption in a JSON record of unknown shape: the first known key that has one (lists are joined
    by comma and blank), else the longest string among its top-level values; null without any."""

    def text_at(key: str) -> Column:
        raw = F.get_json_object(record, f"$.{key}")
        listed = F.from_json(raw, "array<string>")
        return F.nullif(F.trim(F.when(F.startswith(raw, F.lit("[")) & listed.isNotNull(), F.array_join(listed, ", ")).otherwise(raw)), F.lit(""))

    values = F.map_values(F.from_json(record, "map<string,string>"))
    longest = F.array_max(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
    return F.coalesce(*map(text_at, CAPTION_KEYS), longest)
