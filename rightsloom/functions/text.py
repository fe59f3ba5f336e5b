"""Text functions on columns: XML pieces and comparison keys. A missing value is null, an empty one is ''."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as a character class of Java patterns.
SPACE = r"[\s\u0085   -     　]"
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def _replace_all(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_escape(c: Column) -> Column:
    return _replace_all(c, [(b, a) for a, b in _ENTITIES])


def xml_unescape(c: Column) -> Column:
    """Ampersands first: text that was escaped twice loses both layers, as readers of such notices do."""
    return _replace_all(c, _ENTITIES)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one ('' is a match of nothing)."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def attribute(c: Column, name: str) -> Column:
    """First name="value"; an empty value counts."""
    return first_match(c, re.escape(name) + r'="([^"]*)"')


def element(c: Column, tag: str) -> Column:
    """Text of the first <tag>text</tag> as it stands."""
    return first_match(c, f"(?s)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>")


def text_property(c: Column, tag: str) -> Column:
    """Text of the first element, unescaped; empty ones count as missing."""
    return F.nullif(xml_unescape(element(c, tag)), F.lit(""))


def list_items(c: Column, item: str) -> Column:
    """Texts of all <item ...>text</item>, unescaped, in order, without empty ones."""
    found = F.regexp_extract_all(c, F.lit(rf"(?s)<{re.escape(item)}(?:\s[^>]*)?>(.*?)</{re.escape(item)}>"), F.lit(1))
    return F.filter(F.transform(found, xml_unescape), lambda x: x != "")


def namespace_prefix(c: Column, uri: str) -> Column:
    return first_match(c, rf'xmlns:([A-Za-z_][\w.-]*)="{re.escape(uri)}"')


def max_depth(c: Column) -> Column:
    """Greatest depth of open elements: +1 for a tag, -1 for a closing one (not below 0), 0 for one that closes itself."""
    tags = F.regexp_extract_all(c, F.lit(r"<(/?[^>]*)>"), F.lit(1))
    step = lambda s, t: F.when(F.startswith(t, F.lit("/")), F.struct(F.greatest(s.depth - 1, F.lit(0)).alias("depth"), s.top.alias("top"))).when(F.endswith(F.rtrim(t), F.lit("/")), s).otherwise(F.struct((s.depth + 1).alias("depth"), F.greatest(s.top, s.depth + 1).alias("top")))
    return F.aggregate(tags, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")), step, lambda s: s.top)


def normalise_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def normalise_url(c: Column) -> Column:
    """Scheme and host in lower case, no slashes at the end; text without a scheme only loses those."""
    bare = F.regexp_replace(c, "/+$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/]*)(.*)$", 1)
    tail = F.regexp_extract(bare, r"(?s)^(.*?://[^/]*)(.*)$", 2)
    return F.when(F.contains(bare, F.lit("://")), F.concat(F.lower(head), tail)).otherwise(bare)


def normalise_creators(c: Column) -> Column:
    return F.filter(F.transform(c, normalise_space), lambda x: x != "")


def strip_copyright(c: Column) -> Column:
    return F.regexp_replace(c, r"^Copyright \(c\) ", "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no built-in for it."""
    return s.str.normalize("NFC")


def mostly_ascii_nfc(c: Column) -> Column:
    """NFC that leaves plain ASCII in the JVM."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(nfc(F.when(F.length(c) != F.octet_length(c), c)))
