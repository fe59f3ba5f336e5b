"""Mixing sources to target weights: document rates by entropy balancing, rounded into copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, discard, written

#: Sources whose plan (under 100 bytes each) is broadcast; more are joined by shuffle.
MAX_BROADCAST_SOURCES = 200_000


def token_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size -> adds target: shares by weight (sources by code point, null last), no target above cap sizes.

    What a cap cuts off is shared by weight among the others until none is above. That fixed point is a water
    level: with sources by cap / weight, each is capped or not by sums over those before it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * cap)
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("pos")).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("pos")).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    ranked = ranked.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return ranked.select("source", "source_size", target.alias("target"))


#: Newton steps until a source's words are within this part of its target, and how many there may be.
TOLERANCE, MAX_STEPS = 1e-9, 200
#: A rate that is a whole number but for rounding counts as that number.
NEAR = 1e-9


def rate_of(size: Column, multiplier: Column, scale: Column, cap: int) -> Column:
    """Copies of a document of that size, from 0 to cap, before rounding.

    The mix is the one closest, in relative entropy, to the documents as they are: each has cap places that are
    taken by chance, 1 / cap of them at first. A constraint on the words of a source tilts its documents' odds
    exponentially, by exp(multiplier * size / scale). cap 1 leaves no odds to tilt: the rate is 1.
    """
    return F.when(multiplier == float("inf"), F.when(size > 0, float(cap)).otherwise(1.0)).otherwise(cap / (1 + (cap - 1) * F.exp(-multiplier * size / scale)))


def newton_dual(sizes: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """sources with scale and multiplier: those for which the words taken come to each source's target.

    sizes: source, size, n (documents of that size), an exact histogram. The dual is convex; its gradient for a source is its
    target less sum(size * rate), its curvature sum(size * d rate / d multiplier), and as constraints of different
    sources share no document, the Hessian is diagonal. So every step is one aggregation over the histogram, by
    source, for all sources that are still open. A step that would leave the bracket of its root halves the
    bracket instead. Targets of cap times the source need no step: every document is taken cap times.
    """
    moments = sizes.groupBy(F.col("source").alias("m_source")).agg(F.try_divide(F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    plan = sources.join(moments, F.col("source").eqNullSafe(F.col("m_source")), "left").drop("m_source")
    share = F.try_divide(F.col("target"), cap * F.col("source_size"))
    begin = F.log(F.try_divide(share, 1 - share) * (cap - 1)) if cap > 1 else F.lit(0.0)
    full = (F.col("target") >= cap * F.col("source_size") * (1 - TOLERANCE)) | F.lit(cap == 1)
    idle = (F.col("source_size") == 0) | F.col("source_size").isNull()
    none = F.lit(None).cast("double")
    plan = plan.withColumn("multiplier", F.when(idle, none).when(full, float("inf")).otherwise(begin))
    plan = written(plan.withColumn("low", none).withColumn("high", none).withColumn("open", ~(idle | full)), "mix_dual")
    n = plan.count()
    for _ in range(MAX_STEPS):
        if not plan.where("open").limit(1).count():
            return plan.drop("low", "high", "open")
        now = bounded_broadcast(plan.where("open").select(F.col("source").alias("g_source"), "multiplier", "scale"), n, MAX_BROADCAST_SOURCES)
        rate = rate_of(F.col("size"), F.col("multiplier"), F.col("scale"), cap)
        words = F.col("n") * F.col("size")
        slope = rate * (1 - rate / cap) * F.col("size") / F.col("scale")
        sums = sizes.join(now, F.col("source").eqNullSafe(F.col("g_source"))).groupBy("g_source").agg(F.sum(words * rate).alias("taken"), F.sum(words * slope).alias("curve"))
        last, plan = plan, written(_stepped(plan.join(sums, F.col("source").eqNullSafe(F.col("g_source")), "left")).select(*plan.columns), "mix_dual")
        discard(last)
    raise RuntimeError(f"targets not met after {MAX_STEPS} Newton steps")


def _stepped(plan: DataFrame) -> DataFrame:
    """One guarded Newton step of each open source, from its taken words and curve."""
    miss = F.col("target") - F.col("taken")
    plan = plan.withColumn("miss", miss).withColumn("met", ~F.col("open") | (F.abs("miss") <= TOLERANCE * F.col("target")))
    plan = plan.withColumn("low", F.when(~F.col("met") & (F.col("miss") > 0), F.col("multiplier")).otherwise(F.col("low")))
    plan = plan.withColumn("high", F.when(~F.col("met") & (F.col("miss") < 0), F.col("multiplier")).otherwise(F.col("high")))
    most = F.greatest(F.lit(4.0), F.abs("multiplier"))
    plan = plan.withColumn("step", F.when(F.col("curve") > 0, F.col("miss") / F.col("curve")).otherwise(F.signum("miss") * most))
    plan = plan.withColumn("next", F.col("multiplier") + F.greatest(-most, F.least(most, F.col("step"))))
    out = (F.col("next") <= F.col("low")) | (F.col("next") >= F.col("high"))
    plan = plan.withColumn("next", F.when(F.coalesce(out, F.lit(False)), (F.col("low") + F.col("high")) / 2).otherwise(F.col("next")))
    stuck = F.coalesce(F.col("next") == F.col("multiplier"), F.lit(False))  # no number between the bracket's ends
    return plan.withColumn("open", ~F.col("met") & ~stuck).withColumn("multiplier", F.when(F.col("met"), F.col("multiplier")).otherwise(F.col("next")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {
        "_source": F.col(source_col).cast("string"),
        "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_key": F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text))),
    }


def _rounding(rows: DataFrame, cap: int, names: dict[str, str]) -> DataFrame:
    """rows with _rate, _base (whole copies) and _rank: the order in which documents get one copy more, null if never.

    The order is that of a hash of id and text in [0, 1) less the rate's fraction, so documents of a larger fraction come
    first more often, and a cut near 0 gives each its fraction as a chance.
    """
    size, multiplier, scale, key = (F.col(names[c]) for c in ("size", "multiplier", "scale", "key"))
    rows = rows.withColumn(names["rate"], F.coalesce(rate_of(size, multiplier, scale, cap), F.lit(0.0)))
    rate = F.col(names["rate"])
    rows = rows.withColumn(names["base"], F.least(F.floor(rate + NEAR), F.lit(cap)).cast("long"))
    base = F.col(names["base"])
    hashed = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0
    order = F.floor((hashed - F.greatest(rate - base, F.lit(0.0)) + 1) * 2147483648.0).cast("long")
    return rows.withColumn(names["rank"], F.when((size > 0) & (base < cap), F.concat(F.lpad(F.lower(F.hex(order)), 8, "0"), key)))


OWN = {"size": "_size", "key": "_key", "multiplier": "_p_multiplier", "scale": "_p_scale", "rate": "_rate", "base": "_base", "rank": "_rank"}


def _on_source(rows: DataFrame, plan: DataFrame, n: int, source: str = "_source") -> DataFrame:
    named = plan.select(*[F.col(c).alias(f"_p_{c}") for c in plan.columns])
    return rows.join(bounded_broadcast(named, n, MAX_BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("_p_source")))


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """From rows (_source, _size, _key), one row per source: source, source_size, target, scale, multiplier, cut.

    A document gets the whole part of its rate as copies, one more if its rank is at most cut. The cut through the
    rank order is found by sums over buckets of it; only the buckets that hold the cut are ordered by row, so no task
    sorts a hot source.
    """
    sizes = written(sized.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.count("*").alias("n")), "mix_histogram")
    sources = token_targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    plan = newton_dual(sizes, sources, cap)
    n = plan.count()
    whole = F.least(F.floor(F.coalesce(rate_of(F.col("size"), F.col("_p_multiplier"), F.col("_p_scale"), cap), F.lit(0.0)) + NEAR), F.lit(cap))
    have = _on_source(sizes, plan, n, "source").groupBy(F.col("_p_source").alias("n_source"), F.col("_p_target").alias("n_target")).agg(F.sum(F.col("n") * F.col("size") * whole).alias("have"))
    need = written(have.select("n_source", (F.col("n_target") - F.col("have")).alias("need")), "mix_need")
    plan = written(plan.join(need, F.col("source").eqNullSafe(F.col("n_source")), "left").drop("n_source"), "mix_plan")
    ranked = _rounding(_on_source(sized, plan.select("source", "multiplier", "scale", "need"), n), cap, OWN).where("_rank is not null")
    before = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.groupBy("_source", F.col("_p_need").alias("need"), F.substring("_rank", 1, 4).alias("bucket")).agg(F.sum("_size").alias("words"))
    at = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).where("before <= need and before + words >= need")
    at = written(at.groupBy(F.col("_source").alias("a_source"), "need").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.min("before").alias("before")), "mix_at")
    bucket = F.substring("_rank", 1, 4)
    inside = ranked.join(bounded_broadcast(at, n, MAX_BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("a_source")) & (bucket >= F.col("low")) & (bucket <= F.col("high")))
    keys = inside.groupBy("a_source", "need", "before", "_rank").agg(F.sum("_size").alias("words"))
    by_rank = Window.partitionBy("a_source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("so_far", F.col("before") + F.coalesce(F.sum("words").over(by_rank), F.lit(0)))
    last = keys.where("2 * so_far + words <= 2 * need").groupBy("a_source").agg(F.max("_rank").alias("last")).withColumnRenamed("a_source", "l_source")
    cuts = at.join(last, F.col("a_source").eqNullSafe(F.col("l_source")), "left").select(F.col("a_source").alias("c_source"), F.coalesce("last", "low").alias("cut"))
    return written(plan.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "need"), "mix_cuts")


def with_copies(rows: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """rows (with _source, _size, _key), each one's plan, _rate and _copies."""
    joined = _rounding(_on_source(rows, plan, plan.count()), cap, OWN)
    return joined.withColumn("_copies", F.col("_base") + F.coalesce((F.col("_rank") <= F.col("_p_cut")).cast("long"), F.lit(0)))


def _planned(docs: DataFrame, weights, cap, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame]:
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in _sized(docs, id_col, text_col, source_col).items()])
    sized = written(narrow, "mix_sizes")
    return sized, mix_plan(sized, weights, cap)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, rate.

    Entropy balancing: of all rates that take each source's target in words, those closest to the documents as they
    are (see rate_of) are found by Newton steps on the convex dual (newton_dual). A rate becomes whole copies: its
    whole part, and documents in the order of their ranks get one more while that brings the source's sum nearer to
    its target. So a source misses its target by half a document at most, and no document is taken more than cap times.

    Null texts have size 0; null is a source of its own (last in order). Rows that repeat an id with another text
    are documents of their own, rows that repeat both get the same number of copies. Documents without words have rate
    1; in a source without any word nothing is taken (target 0). Empty tables give empty results. Other columns
    are not read.
    """
    sized, plan = _planned(docs, weights, cap, id_col, text_col, source_col)
    out = with_copies(sized, plan, cap)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.col("_rate").alias("rate"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, each row as often as its copies say, with the columns of docs, whatever their names.

    Texts are not shuffled: each row finds its copies from its source's plan, which is broadcast. Nulls, repeated rows and
    empty tables are as for mix().
    """
    _, plan = _planned(docs, weights, cap, id_col, text_col, source_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), *[c.alias(k) for k, c in _sized(docs, id_col, text_col, source_col).items()])
    out = with_copies(whole, plan, cap).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_whole.*")


def oracle(steps: int = 60) -> str:
    """The same in SQL: the dual solved step by step over all documents, then whole copies in the order of ranks."""
    rate = "CASE WHEN g.l = 'infinity'::DOUBLE THEN CASE WHEN {size} > 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END ELSE 3 / (1 + 2 * exp(-g.l * {size} / g.scale)) END"
    parts = []
    for i in range(steps):
        parts.append(rf"""
q{i} AS MATERIALIZED (SELECT source, sum(n * size * r) AS taken, sum(n * size * (r * (1 - r / 3) * size / scale)) AS curve
        FROM (SELECT g.source, g.scale, h.size, h.n, {rate.format(size="h.size")} AS r FROM g{i} g JOIN h ON g.source IS NOT DISTINCT FROM h.source WHERE g.open) GROUP BY source),
u{i} AS (SELECT g.*, q.curve, g.target - q.taken AS miss, NOT g.open OR abs(g.target - q.taken) <= 1e-9 * g.target AS met FROM g{i} g LEFT JOIN q{i} q ON g.source IS NOT DISTINCT FROM q.source),
v{i} AS (SELECT * REPLACE (CASE WHEN NOT met AND miss > 0 THEN l ELSE low END AS low, CASE WHEN NOT met AND miss < 0 THEN l ELSE high END AS high), greatest(4.0, abs(l)) AS most FROM u{i}),
x{i} AS (SELECT *, l + greatest(-most, least(most, CASE WHEN curve > 0 THEN miss / curve ELSE sign(miss) * most END)) AS nx FROM v{i}),
y{i} AS (SELECT *, CASE WHEN coalesce(nx <= low OR nx >= high, false) THEN (low + high) / 2 ELSE nx END AS n2 FROM x{i}),
g{i + 1} AS MATERIALIZED (SELECT source, source_size, target, scale, CASE WHEN met THEN l ELSE n2 END AS l, low, high, NOT met AND NOT coalesce(n2 = l, false) AS open FROM y{i}),""")
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(concat(coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS key FROM documents),
h AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size::DOUBLE * size) / nullif(sum(size), 0) AS scale, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, scale, CASE WHEN cap <= w * level THEN cap::DOUBLE ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target FROM l),
g0 AS MATERIALIZED (SELECT source, source_size, target, scale, CASE WHEN source_size = 0 THEN NULL WHEN target >= 3 * source_size * (1 - 1e-9) THEN 'infinity'::DOUBLE
        ELSE ln(target / (3 * source_size) / (1 - target / (3 * source_size)) * 2) END AS l, NULL::DOUBLE AS low, NULL::DOUBLE AS high,
        NOT (source_size = 0 OR target >= 3 * source_size * (1 - 1e-9)) AS open FROM t),{"".join(parts)}
r AS (SELECT d.*, g.source_size, g.target, coalesce({rate.format(size="d.size")}, 0) AS rate FROM d JOIN g{steps} g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT *, least(floor(rate + 1e-9), 3)::BIGINT AS base FROM r),
z AS (SELECT *, CASE WHEN size > 0 AND base < 3 THEN floor((('0x' || key[1:8])::BIGINT::DOUBLE / 4294967296.0::DOUBLE - greatest(rate - base, 0) + 1) * 2147483648.0::DOUBLE)::BIGINT END AS rank FROM b),
e AS (SELECT source, target - sum(size * base) AS need FROM z GROUP BY source, target),
k AS (SELECT source, rank, key, sum(size) AS words FROM z WHERE rank IS NOT NULL GROUP BY ALL),
o AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rank, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM k),
m AS (SELECT o.source, o.rank, o.key FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source WHERE 2 * so_far + words <= 2 * need)
SELECT z.doc_id, z.size, z.source_size, z.target, ((z.base + (m.key IS NOT NULL)::BIGINT) * z.size)::BIGINT AS taken, (z.base + (m.key IS NOT NULL)::BIGINT)::BIGINT AS copies
FROM z LEFT JOIN m ON z.source IS NOT DISTINCT FROM m.source AND z.rank = m.rank AND z.key = m.key
"""


ORACLE = oracle()
