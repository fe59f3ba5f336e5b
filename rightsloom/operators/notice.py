"""Rights notices: key/value lines, the policy ladder, fields with their precedence, strength of the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

FIELDS = tuple(vocab.NOTICE_KEYS.values())


def notice_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, key, field, value for every line "Key: value" with a notice key."""
    pattern = "(?s)^(" + "|".join(vocab.NOTICE_KEYS) + "): (.*)$"
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    key = F.regexp_extract("line", pattern, 1)
    value = F.regexp_extract("line", pattern, 2)
    field = F.element_at(F.create_map(*[F.lit(x) for kv in vocab.NOTICE_KEYS.items() for x in kv]), key)
    return lines.select(id_col, "pos", key.alias("key"), field.alias("field"), F.when(key == "Copyright", text.strip_copyright(value)).otherwise(value).alias("value"))


def notice_fields(pairs: DataFrame, id_col: str) -> DataFrame:
    """A row per id with every field: of text values the last one wins, and rights_url is the later of licence and statement."""
    last = lambda where: F.max_by(F.when(where, F.col("value")), F.when(where, F.col("pos")))
    own = [last(F.col("field") == f).alias(f) for f in FIELDS]
    return pairs.groupBy(id_col).agg(*own, last(F.col("field").isin("license_url", "web_statement_of_rights")).alias("rights_url"))


def policy_signals(xmp: Column) -> dict[str, Column]:
    """dmi, canonical_dmi, legacy_dmi, tdm_reserved, rights_signal_kind of a packet of rights text.

    Canonical: the plus:DataMining attribute, else the element under whatever prefix is bound to its namespace; its
    value is a URI (canonical) or a bare key (legacy). Then four legacy attributes, then the text-and-data-mining
    reservation. The first that is recognised names the kind; unknown values are passed over.
    """
    element = text.first_match(xmp, r'(?s)xmlns:([A-Za-z_][\w.-]*)="' + vocab.PLUS_NAMESPACE.replace(".", r"\.") + r'".*?<\1:DataMining>(.*?)</\1:DataMining>', 2)
    raw = F.coalesce(text.attribute(xmp, "plus:DataMining"), element)
    canonical, bare = vocab.policy_of_uri(raw), vocab.policy_of_key(raw)
    legacy_attr = F.coalesce(*[vocab.policy_of_label(text.attribute(xmp, a)) for a in vocab.LEGACY_ATTRIBUTES])
    tdm = text.attribute(xmp, "tdm:reserve_tdm")
    legacy = F.coalesce(bare, legacy_attr)
    kind = (
        F.when(canonical.isNotNull(), "canonical_data_mining")
        .when(bare.isNotNull(), "bare_vocabulary_key")
        .when(legacy_attr.isNotNull(), "legacy_attribute")
        .when(tdm.isNotNull(), "tdm_reservation")
    )
    return {"dmi": F.coalesce(canonical, legacy), "canonical_dmi": canonical, "legacy_dmi": legacy, "tdm_reserved": tdm == "1", "rights_signal_kind": kind, "dmi_conflict": canonical.isNotNull() & legacy.isNotNull() & (canonical != legacy)}


def has_notice(columns: list[str]) -> Column:
    """Any notice field or policy; a reservation alone is none."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns if c != "tdm_reserved"]).isNotNull()


def notice_strength(notice: Column, authenticated: Column, payload: Column) -> Column:
    return (
        F.when(notice & authenticated & payload, "MetadataNoticeAndAuthenticatedProvenance")
        .when(notice & payload, "MetadataNoticeAndBestEffortStego")
        .when(notice, "MetadataNoticeOnly")
        .otherwise("NoNoticeFound")
    )


def report_strength(rights: Column, marker_status: Column, hmac_status: Column, key_matched: Column) -> Column:
    """The report's own table: authenticated means a verified HMAC with a matching key, on top of a verified marker."""
    marker = marker_status == "Verified"
    authenticated = F.coalesce((hmac_status == "Verified") & key_matched, F.lit(False))
    return notice_strength(rights, authenticated & marker, marker)


def summary_status(marker_status: Column, rights: Column) -> Column:
    return F.when(marker_status != "NotFound", marker_status).when(rights, "Verified").otherwise("NotFound")


# ---- validation of legal fields

#: Fixed value: longest text of a legal field.
MAX_FIELD = 8192
_DATE = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?)?)?)?$"


def legal_violations(fields: dict[str, Column], urls: dict[str, Column], dates: dict[str, Column]) -> Column:
    """Array of what is wrong: too long, not an http(s) URL, not a date."""
    long = [F.when(F.octet_length(c) > MAX_FIELD, F.lit(f"{n}:too_long")) for n, c in fields.items()]
    url = [F.when((c != "") & ~c.rlike(r"^https?://[^\s/]+"), F.lit(f"{n}:bad_url")) for n, c in urls.items()]
    date = [F.when((c != "") & ~c.rlike(_DATE), F.lit(f"{n}:bad_date")) for n, c in dates.items()]
    return F.array_compact(F.array(*long, *url, *date))
