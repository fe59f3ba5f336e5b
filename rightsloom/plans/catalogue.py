"""Queries over the tables, by name, each with SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, ed25519, text, vocab
from ..operators import carrier, conformance, formats, jpeg, limits, manifests, merge, notice, payload, pixel_cost, resolve, verify, voting
from ..session import prepare
from ..sources import files, png

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- digests


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def digest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", conformance.typed_digest(F.col("text")).alias("digest"))


def derived_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture manifest made from the documents: every seventh digest is another's, every eleventh path is gone, ids repeat."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return d.select(
        "doc_id",
        F.concat(F.lit("f"), F.col("doc_id") % 900).alias("id"),
        F.concat(F.when(F.col("doc_id") % 13 == 0, "/abs/").when(F.col("doc_id") % 17 == 0, "../up/").otherwise("set/"), F.col("doc_id"), F.lit(".bin")).alias("path"),
        F.element_at(F.array(*map(F.lit, ("png", "jpeg", "webp", "gif"))), (n % 4 + 1)).alias("format"),
        F.element_at(F.array(*map(F.lit, vocab.CATEGORIES)), (F.col("doc_id") % 5 + 1).cast("int")).alias("category"),
        F.element_at(F.array(*map(F.lit, ("generated", "external", "unknown"))), (n % 3 + 1)).alias("source"),
        F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).when(F.col("doc_id") % 19 == 0, F.lit("abc")).otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(F.col("lang") == "en", "1.0").otherwise("").alias("authoring_tool_version"),
        F.concat(F.lit("tool-"), "lang").alias("authoring_tool"),
    )


MANIFEST_SQL = """manifest AS (SELECT doc_id, 'f' || (doc_id % 900) AS id,
  CASE WHEN doc_id % 13 = 0 THEN '/abs/' WHEN doc_id % 17 = 0 THEN '../up/' ELSE 'set/' END || doc_id || '.bin' AS path,
  (['png', 'jpeg', 'webp', 'gif'])[regexp_extract(source, '(\\d+)', 1)::INT % 4 + 1] AS format,
  (['canonical', 'legacy', 'conflicting', 'malformed', 'preservation'])[doc_id % 5 + 1] AS category,
  (['generated', 'external', 'unknown'])[regexp_extract(source, '(\\d+)', 1)::INT % 3 + 1] AS source,
  CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') WHEN doc_id % 19 = 0 THEN 'abc' ELSE sha256(text) END AS sha256,
  CASE WHEN lang = 'en' THEN '1.0' ELSE '' END AS authoring_tool_version, 'tool-' || lang AS authoring_tool FROM documents)"""


@query(f"""WITH {MANIFEST_SQL}, f AS (SELECT path, sha256(text) AS seen FROM manifest JOIN documents USING (doc_id) WHERE doc_id % 11 <> 0)
SELECT id, manifest.path, sha256 AS expected, coalesce(seen, '') AS observed, coalesce(seen, '') = sha256 AS matches FROM manifest LEFT JOIN f ON manifest.path = f.path""")
def digest_check_join(spark, sf_dir):
    m = derived_manifest(spark, sf_dir)
    found = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select("doc_id", F.col("text").alias("content"))
    return conformance.digest_check(m, m.select("doc_id", "path").join(found, "doc_id").select("path", "content"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def digest_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# ---- notices in text


def rights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with notice lines and a packet of rights text made from their numbers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    key = F.element_at(F.array(*[F.lit(k) for _, _, k, _ in vocab.POLICIES]), (F.col("doc_id") % 7 + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(n) for _, n, _, _ in vocab.POLICIES]), (F.col("doc_id") % 7 + 1).cast("int"))
    c = F.col("doc_id") % 8
    packet = (
        F.when(c == 0, F.concat(F.lit(f'<x plus:DataMining="{vocab.URI_PREFIX}'), key, F.lit('"/>')))
        .when(c == 1, F.concat(F.lit('<x plus:DataMining="'), key, F.lit('" tdm:reserve_tdm="1"/>')))
        .when(c == 2, F.concat(F.lit(f'<x xmlns:q="{vocab.PLUS_NAMESPACE}"><q:DataMining>{vocab.URI_PREFIX}'), key, F.lit("</q:DataMining></x>")))
        .when(c == 3, F.concat(F.lit('<x Iptc4xmpExt:DMI-Prohibited="'), label, F.lit('"/>')))
        .when(c == 4, F.concat(F.lit(f'<x plus:DataMining="{vocab.URI_PREFIX}'), key, F.lit('" Iptc4xmpExt:DMI="Prohibited"/>')))
        .when(c == 5, F.lit('<x tdm:reserve_tdm="0"/>'))
        .when(c == 6, F.lit('<x plus:DataMining="something" tdm:reserve_tdm="1"/>'))
    )
    lines = F.concat(
        F.lit("Copyright: Copyright (c) "), "source", F.lit("\nnothing here\nLicense: http://a.example/"), "lang", F.lit("\nCreator: "), "source",
        F.when(c < 3, F.lit("\nWebStatementOfRights: http://b.example/\nCreator: later")).otherwise(""), F.when(c == 7, F.lit("\nContact: ")).otherwise(""),
    )
    return d.select("doc_id", packet.alias("xmp"), lines.alias("notice"))


_KEYS = "[" + ", ".join(f"'{k}'" for _, _, k, _ in vocab.POLICIES) + "]"
_LABELS = "[" + ", ".join(f"'{n}'" for _, n, _, _ in vocab.POLICIES) + "]"
RIGHTS_SQL = f"""rights AS (SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN '<x plus:DataMining="{vocab.URI_PREFIX}' || ({_KEYS})[doc_id % 7 + 1] || '"/>'
  WHEN 1 THEN '<x plus:DataMining="' || ({_KEYS})[doc_id % 7 + 1] || '" tdm:reserve_tdm="1"/>'
  WHEN 2 THEN '<x xmlns:q="{vocab.PLUS_NAMESPACE}"><q:DataMining>{vocab.URI_PREFIX}' || ({_KEYS})[doc_id % 7 + 1] || '</q:DataMining></x>'
  WHEN 3 THEN '<x Iptc4xmpExt:DMI-Prohibited="' || ({_LABELS})[doc_id % 7 + 1] || '"/>'
  WHEN 4 THEN '<x plus:DataMining="{vocab.URI_PREFIX}' || ({_KEYS})[doc_id % 7 + 1] || '" Iptc4xmpExt:DMI="Prohibited"/>'
  WHEN 5 THEN '<x tdm:reserve_tdm="0"/>' WHEN 6 THEN '<x plus:DataMining="something" tdm:reserve_tdm="1"/>' END AS xmp,
  'Copyright: Copyright (c) ' || source || chr(10) || 'nothing here' || chr(10) || 'License: http://a.example/' || lang || chr(10) || 'Creator: ' || source
  || CASE WHEN doc_id % 8 < 3 THEN chr(10) || 'WebStatementOfRights: http://b.example/' || chr(10) || 'Creator: later' ELSE '' END || CASE WHEN doc_id % 8 = 7 THEN chr(10) || 'Contact: ' ELSE '' END AS notice FROM documents)"""
LINES_SQL = """lines AS (SELECT doc_id, unnest(string_split(notice, chr(10))) AS line, unnest(range(len(string_split(notice, chr(10))))) AS pos FROM rights),
pairs AS (SELECT doc_id, pos, split_part(line, ': ', 1) AS key, substring(line, position(': ' IN line) + 2) AS value FROM lines WHERE line LIKE '%: %')"""


@query(f"""WITH {RIGHTS_SQL}, {LINES_SQL} SELECT doc_id, pos::INT AS pos, key,
  CASE key WHEN 'Copyright' THEN 'copyright_holder' WHEN 'License' THEN 'license_url' WHEN 'Creator' THEN 'creator' WHEN 'Contact' THEN 'contact' ELSE 'web_statement_of_rights' END AS field,
  CASE WHEN key = 'Copyright' THEN regexp_replace(value, '^Copyright \\(c\\) ', '') ELSE value END AS value FROM pairs""")
def kv_notice_lines(spark, sf_dir):
    return notice.notice_lines(rights_text(spark, sf_dir), "doc_id", "notice")


@query(f"""WITH {RIGHTS_SQL}, {LINES_SQL} SELECT doc_id, regexp_replace(max(value) FILTER (key = 'Copyright'), '^Copyright \\(c\\) ', '') AS copyright_holder,
  arg_max(value, pos) FILTER (key = 'Creator') AS creator, arg_max(value, pos) FILTER (key = 'Contact') AS contact, arg_max(value, pos) FILTER (key IN ('License', 'WebStatementOfRights')) AS rights_url FROM pairs GROUP BY doc_id""")
def notice_fields_last_wins(spark, sf_dir):
    return notice.notice_fields(notice.notice_lines(rights_text(spark, sf_dir), "doc_id", "notice"), "doc_id").select("doc_id", "copyright_holder", "creator", "contact", "rights_url")


def _label_of(key: str) -> str:
    return f"({_LABELS})[list_position({_KEYS}, {key})]"


@query(f"""WITH {RIGHTS_SQL}, r AS (SELECT doc_id, xmp, CASE WHEN regexp_matches(xmp, 'plus:DataMining="') THEN regexp_extract(xmp, 'plus:DataMining="([^"]*)"', 1)
    WHEN xmp LIKE '%<q:DataMining>%' THEN regexp_extract(xmp, '<q:DataMining>(.*?)</q:DataMining>', 1) END AS raw,
    CASE WHEN xmp LIKE '%DMI-Prohibited="%' THEN regexp_extract(xmp, 'DMI-Prohibited="([^"]*)"', 1) WHEN xmp LIKE '%Iptc4xmpExt:DMI="%' THEN regexp_extract(xmp, 'Iptc4xmpExt:DMI="([^"]*)"', 1) END AS attr,
    CASE WHEN xmp LIKE '%tdm:%' THEN regexp_extract(xmp, 'reserve_tdm="([^"]*)"', 1) END AS tdm FROM rights),
 p AS (SELECT *, CASE WHEN raw LIKE '{vocab.URI_PREFIX}%' THEN {_label_of(f"substring(raw, {len(vocab.URI_PREFIX) + 1})")} END AS canonical_dmi, {_label_of("raw")} AS bare FROM r)
 SELECT doc_id, canonical_dmi, coalesce(bare, attr) AS legacy_dmi, coalesce(canonical_dmi, bare, attr) AS dmi, tdm = '1' AS tdm_reserved,
  CASE WHEN canonical_dmi IS NOT NULL THEN 'canonical_data_mining' WHEN bare IS NOT NULL THEN 'bare_vocabulary_key' WHEN attr IS NOT NULL THEN 'legacy_attribute' WHEN tdm IS NOT NULL THEN 'tdm_reservation' END AS rights_signal_kind,
  canonical_dmi IS NOT NULL AND coalesce(bare, attr) IS NOT NULL AND canonical_dmi <> coalesce(bare, attr) AS dmi_conflict FROM p""")
def rights_signal_scan(spark, sf_dir):
    signals = notice.policy_signals(F.col("xmp"))
    return rights_text(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in signals.items()])


@query("""SELECT page_id, CASE WHEN regexp_matches(html, 'href="') THEN regexp_extract(html, 'href="([^"]*)"', 1) END AS first_href,
  CASE WHEN regexp_matches(html, 'charset="') THEN regexp_extract(html, 'charset="([^"]*)"', 1) END AS charset, CASE WHEN regexp_matches(html, '(?s)<title>(.*?)</title>') THEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title FROM pages""")
def html_attr_extract(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.attribute(html, "href").alias("first_href"), text.attribute(html, "charset").alias("charset"), text.element(html, "title").alias("title"))


@query(r"""SELECT page_id, len(l) AS n_items, coalesce(array_to_string(l, '|'), '') AS items FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1),
  lambda x: replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''')), lambda x: x <> '') AS l FROM pages)""")
def html_list_extract(spark, sf_dir):
    items = text.list_items(F.col("html"), "p")
    return table(spark, sf_dir, "pages").select("page_id", items.alias("l")).select("page_id", F.size("l").cast("long").alias("n_items"), F.array_join("l", "|").alias("items"))


@query("""WITH e AS (SELECT doc_id, text, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents)
SELECT doc_id, sha256(escaped) AS escaped_sha256, replace(replace(replace(replace(replace(escaped, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') = text AS round_trip FROM e""")
def xml_escape_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("escaped", text.xml_escape(F.col("text")))
    return d.select("doc_id", F.sha2("escaped", 256).alias("escaped_sha256"), (text.xml_unescape(F.col("escaped")) == F.col("text")).alias("round_trip"))


@query(r"""WITH t AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(/?[^>]*)>', 1) AS l FROM pages)),
s AS (SELECT page_id, i, sum(CASE WHEN starts_with(tag, '/') THEN -1 WHEN ends_with(rtrim(tag), '/') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM t),
d AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS d FROM s)
SELECT page_id, coalesce(max(d), 0)::INT AS depth, coalesce(max(d), 0) <= 32 AS within_limit FROM pages LEFT JOIN d USING (page_id) GROUP BY page_id""")
def xml_depth_guard(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.max_depth(F.col("html")).alias("depth")).withColumn("within_limit", F.col("depth") <= 32)


@query(r"""SELECT page_id, CASE WHEN contains(b, '://') THEN lower(regexp_extract(b, '(?s)^(.*?://[^/]*)(.*)$', 1)) || regexp_extract(b, '(?s)^(.*?://[^/]*)(.*)$', 2) ELSE b END AS url
FROM (SELECT page_id, regexp_replace(replace(url, 'http', 'HTTP') || '//', '/+$', '') AS b FROM pages)""")
def url_normalize(spark, sf_dir):
    messy = F.concat(F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit("//"))
    return table(spark, sf_dir, "pages").select("page_id", text.normalise_url(messy).alias("url"))


@query(r"""SELECT doc_id, sha256(t) AS key FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)""")
def ws_normalize_compare(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalise_space(F.col("text")), 256).alias("key"))


@query("SELECT doc_id, sha256(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS key FROM documents")
def unicode_nfc(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.mostly_ascii_nfc(F.replace("text", F.lit("é"), F.lit("é"))), 256).alias("key"))


_TEXTS = ("Prohibited for AI/ML training", "Prohibited for Generative AI", "Prohibited except search engine indexing", "PROHIBITED", "prohibited, see terms", "is permitted", "DMI-ALLOWED", vocab.URI_PREFIX + "DMI-PROHIBITED", "other")


@query(f"""SELECT doc_id, v AS value, CASE WHEN k IN ({", ".join(f"'{k}'" for c, _, k, _ in vocab.POLICIES if c)}) THEN k WHEN l LIKE '%prohibited%search%' THEN 'DMI-PROHIBITED-EXCEPTSEARCHENGINEINDEXING'
  WHEN l LIKE '%prohibited%' AND l LIKE '%gen%' AND l LIKE '%ai%' THEN 'DMI-PROHIBITED-GENAIMLTRAINING' WHEN l LIKE '%prohibited%' AND l LIKE '%ai%' THEN 'DMI-PROHIBITED-AIMLTRAINING'
  WHEN l LIKE '%prohibited%' AND l LIKE '%see%' THEN 'DMI-PROHIBITED-SEECONSTRAINT' WHEN l LIKE '%prohibited%' THEN 'DMI-PROHIBITED' WHEN l LIKE '%allowed%' OR l LIKE '%permitted%' THEN 'DMI-ALLOWED' ELSE v END AS normal
  FROM (SELECT doc_id, v, lower(v) AS l, replace(v, '{vocab.URI_PREFIX}', '') AS k FROM (SELECT doc_id, ([{", ".join(f"'{t}'" for t in _TEXTS)}])[doc_id % {len(_TEXTS)} + 1] AS v FROM documents))""")
def dmi_normalize(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("doc_id") % len(_TEXTS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"), vocab.normalise_policy(value).alias("normal"))


# ---- corpus


def _coverage_sql() -> str:
    parts = []
    for name, least in conformance.MINIMUMS.items():
        rest = name.removeprefix("external_")
        category, _, kind = rest.partition("_")
        where = f"category = '{category}'" + (" AND source = 'external'" if rest != name else "")
        if kind == "formats":
            count = f"count(DISTINCT format) FILTER ({where})"
        else:
            count = f"count(*) FILTER ({where}" + (f" AND format = '{kind}')" if kind else ")")
        parts.append(f"SELECT '{name}' AS measure, {count} AS observed, {least}::BIGINT AS minimum FROM manifest")
    return f"WITH {MANIFEST_SQL} SELECT *, observed >= minimum AS met FROM ({' UNION ALL '.join(parts)})"


@query(_coverage_sql())
def coverage_counts(spark, sf_dir):
    return conformance.coverage(derived_manifest(spark, sf_dir))


@query(f"""WITH {MANIFEST_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) > 1 AS later FROM manifest)
SELECT id, path, rule FROM (SELECT id, path, unnest(list_filter([CASE WHEN later THEN 'duplicate_id' END, CASE WHEN path LIKE '/%' THEN 'absolute_path' END, CASE WHEN path LIKE '%..%' THEN 'path_traversal' END,
  CASE WHEN format = 'gif' THEN 'unsupported_format' END, CASE WHEN source = 'unknown' THEN 'unsupported_source' END, CASE WHEN sha256 = 'abc' THEN 'invalid_sha256' END,
  CASE WHEN source = 'external' AND authoring_tool_version = '' THEN 'missing_tool_version' END], lambda r: r IS NOT NULL)) AS rule FROM x)""")
def manifest_validate(spark, sf_dir):
    return conformance.manifest_violations(derived_manifest(spark, sf_dir), "doc_id")


@query(f"WITH {MANIFEST_SQL} SELECT authoring_tool, count(*) AS n FROM manifest GROUP BY 1")
def tool_counts(spark, sf_dir):
    return conformance.count_by_tool(derived_manifest(spark, sf_dir))


def extractions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields of documents as read by two parsers that differ in white space, in values and in what they find."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, "canonical_unicode").otherwise("fixture"), F.col("doc_id"))
    pairs = lambda a, u, w: F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("copyright", a), ("usage_terms", u), ("rights_url", w))])).alias("p")
    i = d.select(name.alias("fixture"), pairs(F.concat(F.lit(" "), "source", F.lit("  x ")), F.when(F.col("toxic") == 1, F.col("lang")), F.concat(F.lit("HTTP://Host/"), "lang", F.lit("/"))))
    e = d.select(name.alias("fixture"), pairs(F.concat("source", F.lit(" x"), F.when(F.col("doc_id") % 3 == 0, "yz").otherwise("")), F.when(F.col("quality") == 1, F.col("lang")), F.concat(F.lit("http://host/"), "lang")))
    return tuple(x.select("fixture", "p.field", "p.value") for x in (i, e))


COMPARE_SQL = """d AS (SELECT documents.doc_id, source, lang, toxic, quality, CASE WHEN documents.doc_id % 10 = 0 THEN 'canonical_unicode' ELSE 'fixture' END || documents.doc_id AS fixture FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id),
c AS (SELECT fixture, 'copyright' AS field, ' ' || source || '  x ' AS internal, source || ' x' || CASE WHEN doc_id % 3 = 0 THEN 'yz' ELSE '' END AS external, CASE WHEN doc_id % 3 <> 0 THEN 'Pass' WHEN doc_id % 10 = 0 THEN 'Warn' ELSE 'Fail' END AS severity FROM d
 UNION ALL SELECT fixture, 'usage_terms', CASE WHEN toxic = 1 THEN lang END, CASE WHEN quality = 1 THEN lang END, CASE WHEN (coalesce(toxic, 0) = 1) = (coalesce(quality, 0) = 1) THEN 'Pass' ELSE 'Warn' END FROM d
 UNION ALL SELECT fixture, 'rights_url', 'HTTP://Host/' || lang || '/', 'http://host/' || lang, 'Pass' FROM d)"""


@query(f"WITH {COMPARE_SQL} SELECT * FROM c")
def field_compare_full_outer(spark, sf_dir):
    prepare(spark)
    return conformance.compare_extractions(*extractions(spark, sf_dir))


@query(f"""WITH {COMPARE_SQL}, r AS (SELECT fixture, CASE WHEN fixture LIKE 'c%' THEN 'png' ELSE 'jpeg' END AS format, bool_and(severity <> 'Fail') AS passed FROM c GROUP BY ALL)
SELECT format, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY ROLLUP (format)""")
def summary_rollup(spark, sf_dir):
    prepare(spark)
    checks = conformance.compare_extractions(*extractions(spark, sf_dir))
    return conformance.summary(conformance.reports(checks.withColumn("format", F.when(F.col("fixture").startswith("c"), "png").otherwise("jpeg"))))


# ---- updates


def _fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "lineitem")
    old = o.select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("k"), F.col("l_partkey") % 5).alias("key"), F.col("l_shipmode" if "l_shipmode" in o.columns else "l_returnflag").alias("value"))
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"), F.lit(100).alias("pos"), F.concat(F.lit("k"), F.col("o_custkey") % 5).alias("key"), F.col("o_orderstatus").alias("value"))
    return old, new


_FIELDS_SQL = """old AS (SELECT l_orderkey AS asset, l_linenumber AS pos, 'k' || (l_partkey % 5) AS key, l_returnflag AS value FROM lineitem),
fresh AS (SELECT o_orderkey AS asset, 100 AS pos, 'k' || (o_custkey % 5) AS key, o_orderstatus AS value FROM orders)"""


@query(f"""WITH {_FIELDS_SQL} SELECT *, 'existing' AS origin, NULL::VARCHAR AS error FROM old WHERE key NOT IN ('k1', 'k2') UNION ALL SELECT *, 'new', NULL FROM fresh""")
def replace_merge(spark, sf_dir):
    return merge.merge_fields(*_fields(spark, sf_dir), ["k1", "k2"], merge.REPLACE_OWNED)


@query(f"""WITH {_FIELDS_SQL} SELECT *, 'existing' AS origin, NULL::VARCHAR AS error FROM old UNION ALL
SELECT *, 'new', NULL FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.asset = fresh.asset AND old.key = fresh.key)""")
def preserve_merge(spark, sf_dir):
    return merge.merge_fields(*_fields(spark, sf_dir), ["k1", "k2"], merge.PRESERVE_EXISTING)


@query(f"""WITH {_FIELDS_SQL}, c AS (SELECT DISTINCT asset FROM old WHERE key IN ('k1', 'k2'))
SELECT old.*, 'existing' AS origin, CASE WHEN c.asset IS NOT NULL THEN 'conflict' END AS error FROM old LEFT JOIN c USING (asset) UNION ALL SELECT fresh.*, 'new', NULL FROM fresh WHERE asset NOT IN (SELECT asset FROM c)""")
def conflict_merge(spark, sf_dir):
    return merge.merge_fields(*_fields(spark, sf_dir), ["k1", "k2"], merge.FAIL_ON_CONFLICT)


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY ALL")
def ordered_distinct(spark, sf_dir):
    return merge.ordered_distinct(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", ["system"])


# ---- votes and search


@query("SELECT l_suppkey AS group_id, l_partkey % 16 AS bit_idx, (sum(l_linenumber % 2) > count(*) // 2)::INT AS bit, count(*) AS replicas FROM lineitem GROUP BY ALL")
def majority_vote_bits(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group_id"), (F.col("l_partkey") % 16).alias("bit_idx"), (F.col("l_linenumber") % 2).alias("bit"))
    return voting.majority_bits(votes, "group_id")


@query("""WITH b AS (SELECT l_suppkey AS group_id, l_partkey % 16 AS bit_idx, (sum(l_linenumber % 2) > count(*) // 2)::INT AS bit FROM lineitem GROUP BY ALL)
SELECT group_id, bit_idx // 8 AS pos, sum(bit << (bit_idx % 8)::INT)::INT AS byte FROM b GROUP BY ALL""")
def vote_bytes(spark, sf_dir):
    return voting.bits_to_bytes(majority_vote_bits(spark, sf_dir), "group_id")


@query("""WITH c AS (SELECT l_orderkey AS pos, (l_partkey % 3)::INT AS byte, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT pos, byte, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, byte DESC) = 1""")
def ecc_mode_vote(spark, sf_dir):
    copies = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pos"), (F.col("l_partkey") % 3).cast("int").alias("byte"))
    return voting.byte_mode(copies, ["pos"])


_OUTCOMES = ("NotFound", "NotFound", "Malformed", "AuthFailed", "Valid")


@query(f"""WITH c AS (SELECT user_id, event_id AS ord, ([{", ".join(f"'{o}'" for o in _OUTCOMES)}])[event_id * 7 % 5 + 1] AS outcome FROM events),
b AS (SELECT user_id, min(ord) FILTER (outcome = 'Valid') AS v, min(ord) FILTER (outcome <> 'NotFound') AS o FROM c GROUP BY 1)
SELECT b.user_id, coalesce(c.outcome, 'NotFound') AS outcome, coalesce(v, o) AS ord FROM b LEFT JOIN c ON c.user_id = b.user_id AND c.ord = coalesce(v, o)""")
def candidate_search_first_valid(spark, sf_dir):
    outcome = F.element_at(F.array(*map(F.lit, _OUTCOMES)), (F.col("event_id") * 7 % 5 + 1).cast("int"))
    return voting.first_valid(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), outcome.alias("outcome")), "user_id")


# ---- payloads


@query()
def crc_frame(spark, sf_dir):
    framed = table(spark, sf_dir, "documents").select("doc_id", binary.frame(F.col("text").cast("binary")).alias("f"))
    return framed.select("doc_id", F.crc32(F.substring("f", 12, 1 << 30)).alias("crc"), F.octet_length("f").alias("length"), binary.unframe(F.col("f"))["status"].alias("status"))


_HMAC_KEY = b"test key"


@query(f"""SELECT doc_id, substr(sha256(unhex('{bytes(c ^ 0x5C for c in _HMAC_KEY.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(c ^ 0x36 for c in _HMAC_KEY.ljust(64, bytes(1))).hex()}') || encode(text)))), 1, 32) AS tag FROM documents""")
def hmac_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", payload.hmac_tag(_HMAC_KEY)(F.col("text").cast("binary")).alias("tag"))


def _payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all versions from the parts table: some cut short, some with an unknown policy."""
    k = F.col("p_partkey")
    body = F.lpad(F.hex(k * 1103515245 % 2147483647), 16, "0")
    v3 = F.concat(F.lit("534503"), F.lit("20240000000000"), F.lpad(F.hex(k % 9), 2, "0"), body, F.lit("3200"), body, F.lit("010400"), F.lit("00000000"))
    old = F.concat(F.when(k % 4 == 1, "01").otherwise("02"), F.lpad(F.hex(k % 5), 2, "0"), body, F.lit("6400"), body, F.lit("0000000000000000"), F.when(k % 4 == 1, "").otherwise("00000000"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, v3).when(k % 4 == 3, F.lit("FFFF00")).otherwise(old).alias("h")).withColumn("data", F.unhex(F.when(k % 10 == 9, F.substring("h", 1, 20)).otherwise(F.col("h"))))


@query("""WITH p AS (SELECT p_partkey AS k, lpad(hex(p_partkey * 1103515245 % 2147483647), 16, '0') AS body FROM part),
h AS (SELECT k, body, CASE WHEN k % 4 = 0 THEN 3 WHEN k % 4 = 1 THEN 1 WHEN k % 4 = 2 THEN 2 END AS version, k % 10 = 9 AS short FROM p),
s AS (SELECT *, ('0x' || substring(body, 15, 2) || substring(body, 13, 2) || substring(body, 11, 2) || substring(body, 9, 2) || '00000000')::UBIGINT AS seed FROM h)
SELECT k AS p_partkey, version, CASE WHEN version IS NULL THEN 'invalid_magic' WHEN short THEN 'too_short' WHEN version = 3 AND k % 9 > 6 THEN 'invalid_policy' END AS error,
  CASE WHEN NOT (version IS NULL) THEN CASE WHEN short AND version = 3 THEN NULL ELSE seed END END::DECIMAL(20, 0) AS seed, CASE WHEN version = 3 AND NOT short THEN k % 9 END AS dmi_policy FROM s""")
def v3_header_parse(spark, sf_dir):
    parsed = payload.parse_payload(F.col("data"))
    return _payload_bytes(spark, sf_dir).select("p_partkey", *[parsed[c].alias(c) for c in ("version", "error", "seed", "dmi_policy")])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{c}', '{p}', '{s}')" for w, c, by in vocab.WARNINGS for p, s in zip(vocab.PROFILES, by, strict=True)) + ") v(warning, category, profile, severity)")
def severity_matrix(spark, sf_dir):
    return vocab.severities(spark)


@query(f"""WITH r AS (SELECT o_orderkey AS request_id, ([{", ".join(f"'{p}'" for p in vocab.PROFILES)}])[o_orderkey % 4 + 1] AS profile, o_custkey % 3 AS preset, o_orderkey % 2 = 0 AS has_key, o_custkey % 7 AS pol, o_orderstatus = 'O' AS con FROM orders),
w AS (SELECT request_id, profile, 'MissingMacKey' AS warning FROM r WHERE preset = 2 AND NOT has_key UNION ALL SELECT request_id, profile, 'MetadataInjectionDisabled' FROM r WHERE preset = 0
 UNION ALL SELECT request_id, profile, 'MissingRightsConstraints' FROM r WHERE pol = 6 AND NOT con UNION ALL SELECT request_id, profile, 'ContradictoryLegalClaims' FROM r WHERE pol = 1 AND con),
m(warning, category, profile, severity) AS (VALUES {", ".join(f"('{w}', '{c}', '{p}', '{s}')" for w, c, by in vocab.WARNINGS for p, s in zip(vocab.PROFILES, by, strict=True))})
SELECT request_id, warning, category, severity FROM w JOIN m USING (warning, profile)""")
def plan_warnings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    requests = o.select(
        F.col("o_orderkey").alias("request_id"), pick(vocab.PROFILES, F.col("o_orderkey") % 4).alias("profile"), pick(tuple(resolve.PRESETS), F.col("o_custkey") % 3).alias("preset"),
        pick([n for _, n, _, _ in vocab.POLICIES], F.col("o_custkey") % 7).alias("policy"), F.when(F.col("o_orderstatus") == "O", "see terms").alias("constraints"), (F.col("o_orderkey") % 2 == 0).alias("has_key"),
        F.lit(False).alias("authenticated"), F.lit(None).cast("string").alias("format"), F.lit("png").alias("detected_format"), F.lit(None).cast("long").alias("seed"), F.col("o_orderkey").alias("fallback_seed"),
    )
    return resolve.graded_warnings(resolve.resolve(requests))


# ---- pixels and files


@query("""WITH g AS (SELECT (i // 1024)::INT AS image, (i % 32)::INT AS x, ((i // 32) % 32)::INT AS y FROM range(65536) r(i)), p AS (SELECT image, x, y, (x * 7 + y * y * (image + 1) + x * y) % 251 AS gray FROM g),
n AS (SELECT a.image, a.x, a.y, a.gray AS g, b.gray AS h, abs(a.x - b.x) + abs(a.y - b.y) = 1 AS side FROM p a JOIN p b ON a.image = b.image AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1),
c AS (SELECT image, x, y, sum(CASE WHEN side THEN (g - h) * (g - h) ELSE 0 END)::DOUBLE + (sum(h * h)::DOUBLE - sum(h)::DOUBLE * sum(h)::DOUBLE / count(*)) / count(*) AS complexity FROM n GROUP BY ALL)
SELECT image, x, y, round(CASE WHEN complexity < 1 THEN 10.0 ELSE 10.0 / sqrt(complexity) END, 9) AS cost FROM c""")
def pixel_cost_window(spark, sf_dir):
    i = F.col("id")
    g = spark.range(65536).select(F.floor(i / 1024).cast("int").alias("image"), (i % 32).cast("int").alias("x"), (F.floor(i / 32) % 32).cast("int").alias("y"))
    g = g.withColumn("gray", (F.col("x") * 7 + F.col("y") * F.col("y") * (F.col("image") + 1) + F.col("x") * F.col("y")) % 251)
    return pixel_cost.cost_table(g, 10.0).withColumn("cost", F.round("cost", 9))


@query("SELECT i AS slots, i AS distinct_slots, 0::BIGINT AS low, i - 1 AS high FROM range(1, 400) r(i)")
def permutation_bijection(spark, sf_dir):
    prepare(spark)

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            rows = []
            for n in f["id"]:
                p = carrier.permutation(np.arange(n), int(n), int(n) * 977)
                rows.append((n, len(set(p.tolist())), int(p.min()), int(p.max())))
            yield pd.DataFrame(rows, columns=["slots", "distinct_slots", "low", "high"])

    return spark.range(1, 400).mapInPandas(run, "slots long, distinct_slots long, low long, high long")


def synthetic_files(spark: SparkSession, n: int = 48) -> DataFrame:
    """path, content: images by formula; some with notices and payloads, some keyed, some of no format."""
    prepare(spark)

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for i in f["id"]:
                data = png.encode(png.synthetic(int(i)))
                if i % 4 == 1:
                    data = png.with_texts(data, [("Copyright", "Copyright (c) Holder " + str(i)), ("Creator", "Zoë")])
                elif i % 4 == 2:
                    data = verify.protect_png(data, [("Copyright", f"Holder {i}"), ("License", "http://l.example/")], int(i) + 1, 5, b"key" if i % 8 == 2 else None)
                elif i % 4 == 3 and i % 8 == 3:
                    data = b"not an image"
                out.append((f"/set/{i}.png", data))
            yield pd.DataFrame(out, columns=["path", "content"])

    return spark.range(n).repartition(4).mapInPandas(run, "path string, content binary")


@query("""SELECT '/set/' || i || '.png' AS path, CASE WHEN i % 8 = 3 THEN NULL ELSE 'png' END AS format, CASE WHEN i % 4 IN (1, 2) THEN 'Holder ' || i END AS copyright_holder, CASE WHEN i % 4 = 1 THEN 'Zoë' END AS creator,
  CASE WHEN i % 4 = 2 THEN 'Verified' ELSE 'NotFound' END AS payload_status, i % 8 = 2 AS authenticated,
  CASE WHEN i % 8 = 2 THEN 'MetadataNoticeAndAuthenticatedProvenance' WHEN i % 4 = 2 THEN 'MetadataNoticeAndBestEffortStego' WHEN i % 4 = 1 THEN 'MetadataNoticeOnly' ELSE 'NoNoticeFound' END AS evidence_strength FROM range(48) r(i)""")
def png_notice_roundtrip(spark, sf_dir):
    return verify.verify_notices(synthetic_files(spark), b"key").select("path", "format", "copyright_holder", "creator", "payload_status", "authenticated", "evidence_strength")


@query("SELECT i AS id, 'payload ' || i AS payload, TRUE AS changed FROM range(40) r(i)")
def lsb_embed_extract(spark, sf_dir):
    prepare(spark)

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for i in f["id"]:
                before = png.synthetic(int(i))
                body = f"payload {i}".encode()
                after = carrier.embed(before, body, int(i) * 31 + 7, 2)
                rows.append((i, carrier.extract(after, len(body), int(i) * 31 + 7, 2).decode(), bool((before != after).any())))
            yield pd.DataFrame(rows, columns=["id", "payload", "changed"])

    return spark.range(40).mapInPandas(run, "id long, payload string, changed boolean")


@query("""SELECT event_id % 500 AS n, CASE WHEN count(*) > 0 THEN 1 END AS one, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type <> 'click') AS others, bool_or(value > 50) AS any_large FROM events GROUP BY 1""")
def batch_summary(spark, sf_dir):
    click = F.col("event_type") == "click"
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 500).alias("n")).agg(F.lit(1).alias("one"), F.count_if(click).alias("clicks"), F.count_if(~click).alias("others"), F.bool_or(F.col("value") > 50).alias("any_large"))


@query(r"""WITH p AS (SELECT page_id, 'in/' || (page_id % 40) || '/shot' || (page_id % 60) || '.PNG' AS path FROM pages), n AS (SELECT path, 'shot' || (page_id % 60) AS stem, row_number() OVER (PARTITION BY page_id % 60 ORDER BY path) - 1 AS n FROM p)
SELECT path, 'out/' || stem || '_protected' || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.png' AS output FROM n""")
def output_path_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), F.col("page_id") % 40, F.lit("/shot"), F.col("page_id") % 60, F.lit(".PNG")).alias("path"))
    return files.disjoint(files.output_paths(p, "out/"))


_KEYS = {"61": bytes(range(32)), "62": bytes(range(1, 33))}


def _signed_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests over the suppliers' names, the files they are bound to, and the caller's keys.

    Real signatures by key a or b; some over another claim, of broken hex or by a key that isn't listed; some manifests
    list another key as a, are bound to another file, refer to a payload that isn't there, or aren't JSON.
    """
    prepare(spark)
    k = F.col("s_suppkey")
    public = {i: ed25519.public_key(v).hex() for i, v in _KEYS.items()}
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    own = {
        "claim_id": F.md5("s_name"), "content_code": F.concat(F.lit("local:"), F.sha2("s_name", 224)), "created_at": k + 1_700_000_000, "file_size": F.length("s_name").cast("long"), "format": F.lit("png"),
        "height": F.lit(480).cast("long"), "instance_digest": digest(F.when(k % 3 == 0, F.concat("s_name", F.lit("x"))).otherwise(F.col("s_name"))), "issuer_id": F.lit("aXNzdWVy"), "notice_digest": digest(F.concat("s_name", F.lit(" notice"))),
        "rights_policy": (k % 12).cast("int"), "schema_version": F.lit(1), "software": F.lit("catalogue/1"), "statement_uri": F.when(k % 2 == 0, F.concat(F.lit("https://rights.example/"), k)), "width": F.lit(640).cast("long"),
    }
    claim = lambda **other: F.struct(*[(own | other).get(c, F.lit(None).cast(t)).alias(c) for c, t in manifests.CLAIM.items()])
    signer = F.when((k % 2 == 0) | (k % 11 == 0), "61").otherwise("62")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", signer.alias("signer"), claim().alias("claim"))
    s = s.withColumn("message", F.when(k % 5 == 0, manifests.canonical_claim(claim(width=F.lit(641).cast("long")))).otherwise(manifests.canonical_claim(F.col("claim"))))

    def run(frames):
        for f in frames:
            yield f[["s_suppkey"]].assign(signature=[ed25519.sign(_KEYS[i], m.encode()).hex() for i, m in zip(f["signer"], f["message"], strict=True)])

    signed = s.select("s_suppkey", "signer", "message").repartition(spark.sparkContext.defaultParallelism, "s_suppkey").mapInPandas(run, "s_suppkey long, signature string").cache()
    s = s.join(signed, "s_suppkey")
    code = lambda i: F.array(F.conv(i, 16, 10).cast("int"))
    sig = F.struct(
        F.lit("ed25519").alias("algorithm"), code(F.when(k % 7 == 0, "6f").otherwise(F.col("signer"))).alias("key_id"),
        F.when(k % 17 == 0, F.concat(F.substring("signature", 1, 127), F.lit("z"))).otherwise(F.col("signature")).alias("signature"),
    )
    key = lambda i, v: F.struct(code(F.lit(i)).alias("key_id"), F.lit("ed25519").alias("algorithm"), v.alias("key_bytes"))
    keys = F.array(key("61", F.when(k % 11 == 0, public["62"]).otherwise(public["61"])), key("62", F.lit(public["62"])))
    reference = F.when(k % 19 == 0, F.struct(digest(F.lit("payload")).alias("payload_digest"), F.lit(3).alias("payload_version")))
    json = F.to_json(F.struct(F.lit(1).alias("schema_version"), "claim", F.array(sig).alias("signatures"), keys.alias("public_keys"), reference.alias("embedded_reference")))
    m = s.select("s_suppkey", F.concat(F.lit("p"), k).alias("path"), F.when(k % 13 == 0, F.substring(json, 1, 300)).otherwise(json).alias("json"))
    files_ = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k).alias("path"), F.col("s_name").alias("content"))
    return m, files_, spark.createDataFrame([("61", public["61"])], "key_id string, public_key string")


@query("""SELECT s_suppkey, path, status, CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 19 = 0 THEN 'Stripped' ELSE 'NotProvided' END AS embedded,
  CASE status WHEN 'VerifiedTrusted' THEN 0 WHEN 'VerifiedUntrusted' THEN 4 WHEN 'InvalidConfiguration' THEN 2 ELSE 3 END AS exit_code
FROM (SELECT s_suppkey, 'p' || s_suppkey AS path, CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 OR s_suppkey % 7 = 0 THEN 'InvalidConfiguration' WHEN s_suppkey % 3 = 0 THEN 'BindingFailure' WHEN s_suppkey % 11 = 0 THEN 'KeyMaterialMismatch'
  WHEN s_suppkey % 5 = 0 THEN 'SignatureFailure' WHEN s_suppkey % 19 = 0 THEN 'EmbeddedReferenceFailure' WHEN s_suppkey % 2 = 0 THEN 'VerifiedTrusted' ELSE 'VerifiedUntrusted' END AS status FROM supplier)""")
def detached_manifest_check(spark, sf_dir):
    m, f, trusted = _signed_manifests(spark, sf_dir)
    return manifests.check(manifests.parse(m), f, "s_suppkey", trusted)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown_key' END AS k, CASE WHEN s_suppkey % 17 = 0 THEN 'bad_signature' END AS s FROM supplier WHERE s_suppkey % 13 <> 0 AND (s_suppkey % 7 = 0 OR s_suppkey % 17 = 0)""")
def manifest_signature_antijoin(spark, sf_dir):
    v = manifests.violations(manifests.parse(_signed_manifests(spark, sf_dir)[0]), "s_suppkey")
    by = v.groupBy("s_suppkey").agg(F.max(F.when(F.col("rule") == "unknown_key", F.col("rule"))).alias("k"), F.max(F.when(F.col("rule") == "bad_signature", F.col("rule"))).alias("s"))
    return by.where("k is not null or s is not null")


@query("""SELECT s_suppkey, key_id, key_id = '61' AND s_suppkey % 11 <> 0 AS trusted, key_id <> '61' OR s_suppkey % 11 <> 0 AS key_material_matched, key_id <> '6f' AND s_suppkey % 5 <> 0 AND s_suppkey % 17 <> 0 AS valid
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '6f' WHEN s_suppkey % 2 = 0 OR s_suppkey % 11 = 0 THEN '61' ELSE '62' END AS key_id FROM supplier WHERE s_suppkey % 13 <> 0)""")
def manifest_signature_verify(spark, sf_dir):
    m, _, trusted = _signed_manifests(spark, sf_dir)
    return manifests.signature_results(manifests.parse(m), "s_suppkey", trusted)


@query("""SELECT doc_id, sha256('{"content_code":"local:' || md5(text) || '","created_at":' || (1700000000 + doc_id) || ',"file_size":' || strlen(text) || ',"format":"png","height":480,"instance_digest":"sha256:' || sha256(text)
  || '","issuer_id":"' || lang || '","notice_digest":"sha256:' || sha256(source) || CASE WHEN doc_id % 3 = 0 THEN '","parent_claim_id":"' || md5(source) ELSE '' END || '","rights_policy":' || (doc_id % 12)
  || ',"schema_version":1,"software":"catalogue/1"' || CASE WHEN doc_id % 2 = 0 THEN ',"statement_uri":"https://rights.example/' || doc_id || '"' ELSE '' END || ',"width":640}') AS digest
FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)""")
def claim_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    k = F.col("doc_id")
    own = {
        "claim_id": F.md5("text"), "content_code": F.concat(F.lit("local:"), F.md5("text")), "created_at": k + 1_700_000_000, "file_size": F.octet_length("text").cast("long"), "format": F.lit("png"), "height": F.lit(480).cast("long"),
        "instance_digest": conformance.typed_digest(F.col("text")), "issuer_id": F.col("lang"), "notice_digest": conformance.typed_digest(F.col("source")), "parent_claim_id": F.when(k % 3 == 0, F.md5("source")),
        "rights_policy": (k % 12).cast("int"), "schema_version": F.lit(1), "software": F.lit("catalogue/1"), "statement_uri": F.when(k % 2 == 0, F.concat(F.lit("https://rights.example/"), k)), "width": F.lit(640).cast("long"),
    }
    claim = F.struct(*[own[c].alias(c) for c in manifests.CLAIM])
    return d.select("doc_id", F.sha2(manifests.canonical_claim(claim), 256).alias("digest"))


@query(r"""SELECT o_orderkey, coalesce(array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'url:bad_url' END, CASE WHEN o_custkey % 4 = 0 THEN 'date:bad_date' END], lambda x: x IS NOT NULL), ','), '') AS violations FROM orders""")
def legal_validate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    url = F.when(F.col("o_orderkey") % 3 == 0, "ftp://x").otherwise("https://x.example/a")
    date = F.when(F.col("o_custkey") % 4 == 0, "2024-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    v = notice.legal_violations({"name": F.col("o_orderpriority")}, {"url": url}, {"date": date})
    return o.select("o_orderkey", F.array_join(v, ",").alias("violations"))


# ---- further carriers and similar images


_BITS = 64


@query(f"""WITH v AS (SELECT vec_id AS id, list_sum(list_transform(range({_BITS}), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT AS code FROM embeddings),
c AS (SELECT * FROM v UNION ALL SELECT id + 1000000, xor(xor(code, 1::HUGEINT << (id % 40)::INT), 1::HUGEINT << (id % 7)::INT) FROM v)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.code, y.code))::INT AS distance FROM c x JOIN c y ON x.id < y.id AND bit_count(xor(x.code, y.code)) <= 7""")
def phash_hamming_pairs(spark, sf_dir):
    signs = F.transform(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda i: F.when(F.get(F.col("embedding"), i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(signs, F.lit(0).cast("long"), lambda s, x: s + x)
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code.alias("code"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % n).cast("int"))
    changed = codes.select((F.col("id") + 1000000).alias("id"), F.col("code").bitwiseXOR(bit(40)).bitwiseXOR(bit(7)).alias("code"))
    return formats.hamming_pairs(codes.unionByName(changed))


@query("SELECT i AS id, 'jpeg payload ' || i AS payload, i * 31 + 5 AS table_seed FROM range(24) r(i)")
def jpeg_payload_roundtrip(spark, sf_dir):
    prepare(spark)

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for i in f["id"]:
                data = jpeg.embed_table_seed(jpeg.synthetic(int(i), 96, 64, bool(i % 2)), int(i) * 31 + 5)
                h, values = jpeg.decode(data)
                body = f"jpeg payload {i}".encode()
                out, used = jpeg.embed(values, body, int(i) + 1, 3)
                marked = jpeg.encode(data, h, out)
                rows.append((i, jpeg.extract(jpeg.decode(marked)[1], len(body), int(i) + 1, used).decode(), jpeg.extract_table_seed(marked)))
            yield pd.DataFrame(rows, columns=["id", "payload", "table_seed"])

    return spark.range(24).mapInPandas(run, "id long, payload string, table_seed long")


@query("""SELECT page_id, lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'webp') AS is_image, CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'jpeg' THEN 'jpeg' WHEN 'webp' THEN 'webp' END AS format
FROM (SELECT page_id, url || (['.PNG', '.jpeg', '.webp', '.html'])[page_id % 4 + 1] AS url FROM pages)""")
def image_path_formats(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".PNG", ".jpeg", ".webp", ".html"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ext).alias("path"))
    kind = binary.format_of_path(F.col("path"))
    return path.select("page_id", kind.isNotNull().alias("is_image"), kind.alias("format"))


@query("SELECT *, CASE code WHEN 0 THEN NULL ELSE '" + vocab.URI_PREFIX + "' || vocab_key END AS vocab_uri FROM (VALUES " + ", ".join(f"({c}, '{n}', '{k}', '{p}')" for c, n, k, p in vocab.POLICIES) + ") v(code, policy, vocab_key, property)")
def policy_vocabulary(spark, sf_dir):
    return vocab.policies(spark)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'MetadataNoticeAndAuthenticatedProvenance' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'MetadataNoticeAndBestEffortStego' WHEN doc_id % 2 = 0 THEN 'MetadataNoticeOnly' ELSE 'NoNoticeFound' END AS strength,
  CASE WHEN doc_id % 3 = 0 THEN 'Verified' WHEN doc_id % 3 = 1 THEN 'Invalid' WHEN doc_id % 2 = 0 THEN 'Verified' ELSE 'NotFound' END AS summary FROM documents""")
def report_strength_table(spark, sf_dir):
    n = F.col("doc_id")
    marker = F.element_at(F.array(*map(F.lit, ("Verified", "Invalid", "NotFound"))), (n % 3 + 1).cast("int"))
    hmac = F.when(n % 5 == 0, "Verified")
    strength = notice.report_strength(n % 2 == 0, marker, hmac, F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", strength.alias("strength"), notice.summary_status(marker, n % 2 == 0).alias("summary"))


# ---- limits


@query(r"""WITH f AS (SELECT page_id, strlen(html) AS bytes, len(regexp_extract_all(html, '<[^/>][^>]*>'))::BIGINT AS tags, strlen(url) AS field FROM pages),
v AS (SELECT page_id, 'max_input_bytes' AS "limit", bytes AS observed, 9000 AS allowed, 'InputTooLarge' AS error FROM f WHERE bytes > 9000
 UNION ALL SELECT page_id, 'max_xml_properties', tags, 256, 'ContainerLimitExceeded' FROM f WHERE tags > 256
 UNION ALL SELECT page_id, 'max_metadata_field_bytes', field, 30, 'MetadataLimitExceeded' FROM f WHERE field > 30)
SELECT page_id, "limit", observed::BIGINT AS observed, allowed::BIGINT AS allowed, error FROM v""")
def resource_limits(spark, sf_dir):
    """Pages whose size, tags or address are above limits, one row for each limit."""
    facts = {"max_input_bytes": F.octet_length("html"), "max_xml_properties": F.regexp_count("html", F.lit("<[^/>][^>]*>")), "max_metadata_field_bytes": F.octet_length("url")}
    own = limits.with_limits(max_input_bytes=9000, max_metadata_field_bytes=30)
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(limits.exceeded(facts, own)).alias("x"))
    return found.select("page_id", "x.limit", "x.observed", "x.allowed", "x.error")


@query("""SELECT lang, source, count(*) AS parts, sum(strlen(text))::BIGINT AS part_bytes, max(strlen(text))::BIGINT AS largest_part FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def resource_usage(spark, sf_dir):
    """Work seen by container: here each source's documents of a language are the parts of one."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    parts = d.select(F.struct("lang", "source").alias("path"), F.octet_length("text").cast("long").alias("length"))
    return limits.usage(parts).select("path.lang", "path.source", "parts", "part_bytes", "largest_part")


@query("SELECT doc_id, 'ok' AS status, text AS payload FROM documents WHERE strlen(text) <= 300")
def framed_pixels(spark, sf_dir):
    """Short documents through the pixels of an image each: framed, embedded, read back by the seed alone."""
    prepare(spark)

    def run(frames):
        import numpy as np

        for f in frames:
            rows = []
            for i, t in zip(f["doc_id"], f["text"], strict=True):
                pixels = np.random.default_rng(int(i)).integers(0, 256, (96, 96, 4), dtype=np.uint8)
                marked = carrier.embed_framed(pixels, t.encode(), int(i) + 1)
                status, payload_ = carrier.extract_framed(marked, int(i) + 1)
                rows.append((status, payload_.decode()))
            yield f[["doc_id"]].assign(status=[r[0] for r in rows], payload=[r[1] for r in rows])

    short = table(spark, sf_dir, "documents").where(F.octet_length("text") <= 300).select("doc_id", "text")
    return short.mapInPandas(run, "doc_id long, status string, payload string")
