"""Column functions for text, identity, URLs, dates and citations. All but ``trigram_vector`` stay inside the JVM."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, with the four separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squash(c: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(c, rf"{SPACE}+", "")


def collapse(c: Column) -> Column:
    """Stripped text with single blanks."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def terms(c: Column) -> Column:
    """Lower-cased word tokens in order, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))


def text_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.left(F.sha2(c, 256), F.lit(16)))


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, path without a final slash, query kept, no fragment."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), part(4))


def document_key(url: Column) -> Column:
    return F.left(F.sha2(url_key(url), 256), F.lit(12))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def iso_date(c: Column) -> Column:
    """A date where the text is one in full ISO form; null for ``unknown`` and anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def school_year(d: Column) -> Column:
    """The year in which the school year of a date began, on 1 September."""
    return F.year(d) - F.when(F.month(d) < 9, 1).otherwise(0)


def recency_weight(date_text: Column, year: int) -> Column:
    """0.85 for each year of age, at least 0.4; 0.7 where no year leads the text; future dates count as new."""
    found = F.regexp_extract(F.coalesce(date_text, F.lit("")), r"^(\d{4})", 1)
    age = F.greatest(F.lit(0), F.lit(year) - F.try_to_number(found, F.lit("9999")).cast("int"))
    return F.when(found == "", F.lit(0.7)).otherwise(F.greatest(F.lit(0.4), F.pow(F.lit(0.85), age)))


def excerpt(body: Column, point: Column) -> Column:
    """From 50 characters before the point to 110 after its start, else the first 160."""
    at = F.instr(body, point)
    return F.when(at > 0, body.substr(F.greatest(F.lit(1), at - 50), at + 110 - F.greatest(F.lit(1), at - 50))).otherwise(F.substring(body, 1, 160))


def citation_refs(text: Column) -> Column:
    """Sorted distinct numbers in square brackets; four-digit years 1900 to 2099 are no references."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\s*(\d+)\s*\]"), F.lit(1))
    kept = F.filter(raw, lambda d: ~((F.length(d) == 4) & d.between("1900", "2099")))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda d: d.cast("decimal(38,0)"))))


def invalid_refs(text: Column, n: Column) -> Column:
    return F.filter(citation_refs(text), lambda r: (r < 1) | (r > n))


def citations_ok(text: Column, n: Column) -> Column:
    return (F.size(citation_refs(text)) > 0) & (F.size(invalid_refs(text, n)) == 0)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys, a blank after each colon and comma, and non-ASCII characters as they are."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(value(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _gram_bucket(gram: str, dim: int) -> int:
    return hashlib.md5(gram.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[-1] % dim


#: A first line of at least ``HEAD`` characters is counted once for all texts of a slice that begin with it.
HEAD = 128
#: Grams of characters below ``NARROW`` have their buckets in a table, others are looked at once for every ``SLICE`` characters.
NARROW, SLICE = 256, 1 << 19


@cache
def _narrow_buckets(dim: int) -> np.ndarray:
    """Buckets plus one of the grams met so far, by their three characters; 0 is unknown."""
    return np.zeros(NARROW**3, np.uint16)


def _buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray, dim: int) -> np.ndarray:
    """The buckets of grams of the code points ``a``, ``b`` and ``c``."""
    of = lambda k, bits: _gram_bucket("".join(chr(k >> s & (1 << bits) - 1) for s in (2 * bits, bits, 0)), dim)
    out, wide = np.empty(len(a), np.int64), (a | b | c) >= NARROW
    at = np.flatnonzero(~wide)
    key, table = (a[at] * NARROW + b[at]) * NARROW + c[at], _narrow_buckets(dim)
    new = np.unique(key[table[key] == 0])
    table[new] = [of(int(k), 8) + 1 for k in new]
    out[at] = table[key].astype(np.int64) - 1
    if len(at) < len(a):
        keys, back = np.unique(a[wide] << 42 | b[wide] << 21 | c[wide], return_inverse=True)
        out[wide] = np.array([of(int(k), 21) for k in keys])[back]
    return out


def _gram_counts(texts: list[str], dim: int) -> np.ndarray:
    """One row of counts for each text."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams = np.maximum(size - 2, 0)
    row = np.repeat(np.arange(len(texts)), grams)
    first = np.arange(grams.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(grams) - grams), grams)
    found = _buckets(points[first], points[first + 1], points[first + 2], dim)
    counts = np.bincount(row * dim + found, minlength=len(texts) * dim).reshape(-1, dim).astype(float)
    for i in np.flatnonzero(size < 3):
        counts[i, _gram_bucket(texts[i], dim)] = 1
    return counts


def trigram_vector(text: Column, dim: int = 64) -> Column:
    """Unit vector of character 3-gram counts; the bucket is the last byte of a gram's MD5 modulo ``dim`` (at most 256).

    Arrow batches, as counting into buckets would evaluate every gram once for each bucket in a Column expression; a slice of a batch is counted
    in numpy. Null stays null; texts of fewer than three characters are one gram.
    """

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        held, heads, parts, n = [], {}, [], 0
        for i, t in enumerate(texts):
            if t is not None:
                # its grams are those of the first line, and those that begin in its last two characters or later
                end = t.find("\n") + 1
                end = end if end >= HEAD else 0
                head = t[:end]
                n += len(t) - end if head in heads else len(t)
                held.append((i, heads.setdefault(head, len(heads))))
                parts.append(t[max(end - 2, 0) :])
            if held and (n >= SLICE or i == len(texts) - 1):
                counts = _gram_counts(parts + list(heads), dim)
                whole, first, none = counts[: len(parts)], counts[len(parts) :], heads.get("")
                if none is not None:
                    first[none] = 0
                whole[[k for k, (_, h) in enumerate(held) if h != none and len(parts[k]) < 3]] = 0
                whole += first[[h for _, h in held]]
                for (k, _), v in zip(held, whole / np.sqrt((whole * whole).sum(axis=1, keepdims=True)), strict=True):
                    out[k] = v
                held, heads, parts, n = [], {}, [], 0
        return pd.Series(out, dtype=object)

    return vectors(text)
