"""Registered queries of the engine over the fixture views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.fixtures import ctes, view
from strandweave.functions import columns as x
from strandweave.operators import calls, clips, cluster, consensus, depth, intervals, merge, reads, seqsearch
from strandweave.options import CallOptions
from strandweave.plans import call as command
from strandweave.plans import merge as merging
from strandweave.session import settled
from strandweave.sources import vcf

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
O = CallOptions()  # noqa: E741


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakpoint_cluster(spark, sf_dir)


# --- shared SQL -------------------------------------------------------------

_CLUSTERS = (
    ctes("evidence")
    + """,
s1 AS (SELECT *, CASE WHEN left_pos - 50 <= max(left_pos) OVER (PARTITION BY template_id, orientation ORDER BY left_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nl FROM evidence),
s2 AS (SELECT *, sum(nl) OVER (PARTITION BY template_id, orientation ORDER BY left_pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM s1),
s3 AS (SELECT *, CASE WHEN right_pos - 50 <= max(right_pos) OVER (PARTITION BY template_id, orientation, li ORDER BY right_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nr FROM s2),
s4 AS (SELECT *, sum(nr) OVER (PARTITION BY template_id, orientation, li ORDER BY right_pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ri FROM s3)"""
)

_BPS = (
    _CLUSTERS
    + """,
b0 AS (
  SELECT template_id, orientation, count(*) AS supp, count(*) FILTER (kind = 0) AS se, count(*) FILTER (kind = 1) AS pe, count(*) FILTER (kind = 2) AS ce,
    min(left_pos) AS min_left, max(left_pos) AS max_left, min(right_pos) AS min_right, max(right_pos) AS max_right,
    list_sort(list(left_pos) FILTER (kind <> 1)) AS ls, list_sort(list(right_pos) FILTER (kind <> 1)) AS rs
  FROM s4 GROUP BY template_id, orientation, li, ri),
b1 AS (
  SELECT *, se + ce = 0 AS imprecise,
    CASE WHEN se + ce > 0 THEN ls[len(ls) // 2 + 1] ELSE min_left END AS final_left,
    CASE WHEN se + ce > 0 THEN rs[len(rs) // 2 + 1] ELSE max_right END AS final_right
  FROM b0),
b2 AS (
  SELECT *, (template_id * 8 + orientation) * 1000000000000 + min_left * 1000000 + min_right AS bp_id,
    CAST(min_left % 13 AS DOUBLE) / 8.0 AS re, CAST(min_right % 50 AS DOUBLE) AS rd
  FROM b1),
bps AS (
  SELECT *, se + pe + ce AS score, CAST(se + ce >= 1 AS INT) + CAST(pe >= 1 AS INT) + CAST(re >= 1.0 AS INT) AS vt,
    NOT (se + pe + ce >= 4 OR (orientation <> 3 AND CAST(se + ce >= 1 AS INT) + CAST(pe >= 1 AS INT) + CAST(re >= 1.0 AS INT) >= 3)) AS filtered
  FROM b2)"""
)

_DELS = """,
dels AS (
  SELECT bp_id, 'DEL' AS sv_type, template_id, final_left AS begin_pos, final_right AS end_pos, imprecise, se, pe, ce, re, rd, vt,
    CASE WHEN filtered THEN 'FILTERED' ELSE 'PASS' END AS status
  FROM bps WHERE orientation = 0 AND final_left < final_right AND final_right - final_left + 1 >= 50)"""

_DUPS = (
    _DELS
    + """,
dup AS (SELECT bp_id AS dup_id, template_id, final_left AS lp, final_right AS rp, imprecise, se, pe, ce, re, rd, vt FROM bps WHERE orientation = 2 AND NOT filtered),
h AS (
  SELECT dup_id, bp_id AS del_id, begin_pos AS db, end_pos AS de, dels.imprecise AS rough, abs(begin_pos - lp) <= 50 AS lm, abs(end_pos - rp) <= 50 AS rm
  FROM dup JOIN dels USING (template_id) WHERE abs(begin_pos - lp) <= 50 OR abs(end_pos - rp) <= 50),
g AS (
  SELECT dup_id, list(db) FILTER (lm AND NOT rough) AS le, list(db) FILTER (lm AND rough) AS lr, list(de) FILTER (rm AND NOT rough) AS re_, list(de) FILTER (rm AND rough) AS rr,
    list(db) FILTER (rm AND NOT lm AND NOT rough) AS ce_,
    list_concat(coalesce(list(db) FILTER (rm AND NOT lm AND rough), []), coalesce(list(de) FILTER (lm AND NOT rm), [])) AS cr,
    bool_or(lm AND NOT rm) AS ol, bool_or(rm AND NOT lm) AS orr
  FROM h GROUP BY dup_id),
q AS (
  SELECT dup.*, list_sort(list_concat(coalesce(le, []), CASE WHEN NOT imprecise THEN [lp] ELSE [] END)) AS le2,
    list_sort(list_concat(coalesce(lr, []), CASE WHEN imprecise THEN [lp] ELSE [] END)) AS lr2,
    list_sort(list_concat(coalesce(re_, []), CASE WHEN NOT imprecise THEN [rp] ELSE [] END)) AS re2,
    list_sort(list_concat(coalesce(rr, []), CASE WHEN imprecise THEN [rp] ELSE [] END)) AS rr2,
    list_sort(coalesce(ce_, [])) AS ce2, list_sort(coalesce(cr, [])) AS cr2, coalesce(ol, false) AS ol, coalesce(orr, false) AS orr
  FROM dup LEFT JOIN g USING (dup_id)),
p AS (
  SELECT *, CASE WHEN len(le2) > 0 THEN le2[len(le2) // 2 + 1] ELSE lr2[len(lr2) // 2 + 1] END AS l,
    CASE WHEN len(re2) > 0 THEN re2[len(re2) // 2 + 1] ELSE rr2[len(rr2) // 2 + 1] END AS r,
    CASE WHEN len(ce2) > 0 THEN ce2[len(ce2) // 2 + 1] WHEN len(cr2) > 0 THEN cr2[len(cr2) // 2 + 1] END AS m,
    imprecise OR len(le2) = 0 OR len(re2) = 0 OR (len(ce2) = 0 AND len(cr2) > 0) AS rough2
  FROM q),
dups AS (
  SELECT * FROM (
    SELECT dup_id AS bp_id, 'DUP:TANDEM' AS sv_type, l AS begin_pos, r AS end_pos, CAST(NULL AS BIGINT) AS target_pos, 'PASS' AS status, template_id, se, pe, ce, re, rd, vt, rough2 AS imprecise FROM p WHERE m IS NULL
    UNION ALL SELECT dup_id, 'TRA', l, m, r, 'PASS', template_id, se, pe, ce, re, rd, vt, rough2 FROM p WHERE m IS NOT NULL AND ol AND orr
    UNION ALL SELECT dup_id, 'DUP', l, m, r, 'MERGED', template_id, se, pe, ce, re, rd, vt, rough2 FROM p WHERE m IS NOT NULL AND ol AND orr
    UNION ALL SELECT dup_id, 'DUP', m, r, l, 'PASS', template_id, se, pe, ce, re, rd, vt, rough2 FROM p WHERE m IS NOT NULL AND ol AND NOT orr
    UNION ALL SELECT dup_id, 'DUP', l, m, r, 'PASS', template_id, se, pe, ce, re, rd, vt, rough2 FROM p WHERE m IS NOT NULL AND NOT ol)
  WHERE sv_type = 'TRA' OR status = 'MERGED' OR (begin_pos <= end_pos AND end_pos - begin_pos + 1 >= 50))"""
)


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "evidence")


def _bps(spark: SparkSession, sf: str) -> DataFrame:
    out = cluster.breakpoints(_evidence(spark, sf), 50, 1)
    ident = (F.col("template_id") * 8 + F.col("orientation")).cast("long") * 1_000_000_000_000 + F.col("min_left") * 1_000_000 + F.col("min_right")
    out = out.withColumns({"bp_id": ident, "re": (F.col("min_left") % 13).cast("double") / 8.0, "rd": (F.col("min_right") % 50).cast("double")})
    return calls.voted(out, O, O.depth_threshold)


# --- reads ------------------------------------------------------------------


@query(ctes("reads") + " SELECT read_id, (flag & 4) = 4 AS unmapped, (flag & 2) = 2 AS proper, (flag & 16) = 16 AS reverse, (flag & 256) = 256 AS secondary, (flag & 512) = 512 AS qc_fail, (flag & 2048) = 2048 AS supplementary, (flag & 772) = 0 AS usable, concat(CAST(read_id AS STRING), CASE WHEN (flag & 64) = 64 THEN '/1' ELSE '/2' END) AS end_name FROM reads")
def read_routing_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = {"unmapped": x.UNMAPPED, "proper": x.PROPER, "reverse": x.REVERSE, "secondary": x.SECONDARY, "qc_fail": x.QC_FAIL, "supplementary": x.SUPPLEMENTARY}
    return view(spark, sf, "reads").select("read_id", *[x.has_flag("flag", m).alias(k) for k, m in flags.items()], x.usable("flag").alias("usable"), x.read_end_name("read_id", "flag").alias("end_name"))


_OPS = "regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) AS ns, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS os"


@query(
    ctes("cigars")
    + f""", o AS (SELECT read_id, {_OPS} FROM cigars)
SELECT read_id, CAST(list_sum(list_transform(range(1, len(os) + 1), lambda i: CASE WHEN os[i] IN ('S', 'H', 'I') THEN 0 ELSE CAST(ns[i] AS INT) END)) AS BIGINT) AS ref_len,
  (os[1] IN ('S', 'H') AND CAST(ns[1] AS INT) >= 20) OR (os[len(os)] IN ('S', 'H') AND CAST(ns[len(ns)] AS INT) >= 20) AS clipped,
  len(list_filter(range(2, len(os)), lambda i: os[i] IN ('P', 'I', 'D', 'N') AND CAST(ns[i] AS INT) >= 50)) > 0 AS gapped FROM o"""
)
def cigar_ref_length(spark: SparkSession, sf: str) -> DataFrame:
    ops = x.cigar_ops("cigar")
    return view(spark, sf, "cigars").select("read_id", x.ref_length(ops).cast("long").alias("ref_len"), x.edge_clip(ops, 20).alias("clipped"), x.inner_gap(ops, 50).alias("gapped"))


@query(
    ctes("cigars")
    + f""", o AS (SELECT read_id, begin_pos, {_OPS} FROM cigars),
u AS (SELECT read_id, begin_pos, unnest(range(1, len(os) + 1)) AS i, unnest(os) AS op, CAST(unnest(ns) AS BIGINT) AS n, len(os) AS k FROM o),
v AS (
  SELECT *, begin_pos + coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref_at FROM u)
SELECT read_id, 'deletion' AS what, CAST(ref_at AS BIGINT) AS left_pos, CAST(ref_at + n AS BIGINT) AS right_pos FROM v WHERE op IN ('D', 'N') AND n >= 50
UNION ALL SELECT read_id, 'clip', NULL, begin_pos FROM v WHERE op = 'S' AND n >= 20 AND i = 1
UNION ALL SELECT read_id, 'clip', CAST(ref_at - 1 AS BIGINT), NULL FROM v WHERE op = 'S' AND n >= 20 AND i = k AND i > 1"""
)
def cigar_fold_segments(spark: SparkSession, sf: str) -> DataFrame:
    return reads.cigar_evidence(view(spark, sf, "cigars"), O).select("read_id", "what", "left_pos", "right_pos")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "reads").withColumns({"ordinal": F.col("read_id"), "tlen": F.col("ref_len") * F.when(F.col("is_reverse"), -1).otherwise(1)})


@query(
    ctes("reads")
    + """, p AS (SELECT ref_len AS size FROM reads WHERE (flag & 772) = 0 AND (flag & 2) = 2 AND (flag & 2048) = 0 AND map_q >= 20 ORDER BY read_id LIMIT 100000),
m AS (SELECT list_sort(list(size))[count(*) // 2 + 1] AS median FROM p),
d AS (SELECT median, abs(size - median) AS off FROM p, m),
e AS (SELECT any_value(median) AS median, list_sort(list(off))[count(*) // 2 + 1] AS mad FROM d)
SELECT CAST(median AS DOUBLE) AS median, CAST(mad AS DOUBLE) AS mad, CAST(median - 9.0 * mad AS DOUBLE) AS low, CAST(median + 9.0 * mad AS DOUBLE) AS high FROM e"""
)
def insert_size_median_mad(spark: SparkSession, sf: str) -> DataFrame:
    return reads.insert_bounds(_sized(spark, sf), O.insert_deviations)


@query(
    ctes("reads")
    + """ SELECT read_id FROM reads WHERE (flag & 772) = 0 AND map_q >= 20 AND (flag & 8) = 0
AND (ref_len > 40 OR ((flag & 16) = 16) = ((flag & 32) = 32) OR (NOT is_reverse AND (flag & 16) = 16) OR (is_reverse AND (flag & 16) = 0))"""
)
def discordant_reads(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sized(spark, sf).where(x.usable("flag"))
    bad = x.discordant(F.col("flag"), x.has_flag("flag", x.MATE_REVERSE), x.has_flag("flag", x.REVERSE), F.col("tlen"), F.col("map_q"), O.min_map_q, F.lit(40))
    return rows.where(bad).select("read_id")


@query(
    ctes("reads")
    + """, s AS (SELECT list_sort(list(ref_len)) AS v, count(*) AS n FROM reads)
SELECT CAST(v[n // 4 + 1] AS DOUBLE) AS q1, CAST(v[n // 2 + 1] AS DOUBLE) AS median, CAST(v[(3 * n) // 4 + 1] AS DOUBLE) AS q3, v[(3 * n) // 4 + 1] + 1.5 * (v[(3 * n) // 4 + 1] - v[n // 4 + 1]) AS threshold FROM s"""
)
def quartile_iqr_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return depth.outlier_threshold(view(spark, sf, "reads"), "ref_len", 1.5).withColumn("threshold", F.col("threshold").cast("double"))


@query(
    ctes("mates")
    + """, l AS (SELECT * FROM mates WHERE tlen >= 0), r AS (SELECT * FROM mates WHERE tlen < 0)
SELECT l.qname, l.template_id AS left_template, r.template_id AS right_template, l.begin_pos AS left_begin, l.end_pos AS left_end, r.begin_pos AS right_begin, r.end_pos AS right_end,
  l.is_reverse AS left_reverse, r.is_reverse AS right_reverse,
  CASE WHEN l.is_reverse = r.is_reverse THEN 3 WHEN l.is_reverse THEN 2 WHEN abs(l.tlen) > 800 THEN 0 ELSE 1 END AS orientation
FROM l JOIN r USING (qname)"""
)
def mate_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return reads.paired(view(spark, sf, "mates"), 800)


@query(
    ctes("segments")
    + """, z AS (SELECT *, count(*) OVER w AS n, min(map_q) OVER w AS low_q, max(q_end) OVER w AS size FROM segments WINDOW w AS (PARTITION BY read_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY q_begin, seg_no) AS k FROM z WHERE n > 1 AND n <= 2 AND low_q >= 20),
j AS (
  SELECT a.read_id, a.template_id AS t1, b.template_id AS t2, a.ref_begin AS b1, a.ref_end AS e1, b.ref_begin AS b2, b.ref_end AS e2, a.is_reverse AS r1, b.is_reverse AS r2, a.q_begin AS q1, a.q_end AS p1,
    CASE WHEN a.is_reverse <> b.is_reverse THEN a.size - b.q_end ELSE b.q_begin END AS q2, CASE WHEN a.is_reverse <> b.is_reverse THEN a.size - b.q_begin ELSE b.q_end END AS p2
  FROM a JOIN a b ON a.read_id = b.read_id AND b.k = a.k + 1),
n AS (SELECT *, least(p1, p2) - greatest(q1, q2) AS shared FROM j)
SELECT read_id, t1 AS left_template, t2 AS right_template,
  CASE WHEN t1 = t2 AND r1 = r2 THEN CASE WHEN b1 < b2 THEN e1 ELSE b2 END
    WHEN t1 = t2 THEN CASE WHEN b1 <= b2 THEN CASE WHEN r1 THEN e1 ELSE b1 END ELSE CASE WHEN r2 THEN e2 ELSE b2 END END ELSE e1 END AS left_pos,
  CASE WHEN t1 = t2 AND r1 = r2 THEN CASE WHEN b1 < b2 THEN b2 - 1 ELSE e1 - 1 END
    WHEN t1 = t2 THEN CASE WHEN b1 <= b2 THEN CASE WHEN r1 THEN e2 - 1 ELSE b2 - 1 END ELSE CASE WHEN r2 THEN e1 - 1 ELSE b1 - 1 END END ELSE b2 - 1 END AS right_pos,
  CASE WHEN t1 = t2 AND r1 = r2 THEN CASE WHEN b1 < b2 THEN 0 ELSE 2 END WHEN t1 = t2 THEN 3 ELSE 4 END AS orientation,
  CASE WHEN t1 = t2 AND r1 <> r2 AND b1 > b2 THEN r2 ELSE r1 END AS left_reverse, CASE WHEN t1 = t2 AND r1 <> r2 AND b1 > b2 THEN r1 ELSE r2 END AS right_reverse
FROM n WHERE CASE WHEN shared > 0 THEN shared <= 20 ELSE -shared <= 50 END"""
)
def split_adjacent_segments(spark: SparkSession, sf: str) -> DataFrame:
    return reads.split_evidence(view(spark, sf, "segments"), O)


@query(ctes("segments") + " SELECT read_id, count(*) AS segments, min(map_q) AS low_q, max(q_end) AS query_size FROM segments GROUP BY read_id")
def read_segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "segments").groupBy("read_id").agg(F.count("*").alias("segments"), F.min("map_q").alias("low_q"), F.max("q_end").alias("query_size"))


@query(
    ctes("evidence")
    + """, w AS (
  SELECT *, greatest(left_pos - CASE orientation WHEN 3 THEN 500 WHEN 2 THEN 500 ELSE 50 END, 0) AS ll, left_pos + CASE orientation WHEN 3 THEN 500 WHEN 2 THEN 50 ELSE 500 END AS lh,
    greatest(right_pos - CASE orientation WHEN 3 THEN 500 WHEN 2 THEN 50 ELSE 500 END, 0) AS rl, right_pos + CASE orientation WHEN 3 THEN 500 WHEN 2 THEN 500 ELSE 50 END AS rh
  FROM evidence WHERE kind = 1)
SELECT ev_id, ll AS left_lo, CASE WHEN lh > right_pos THEN right_pos - 1 ELSE lh END AS left_hi, CASE WHEN rl < left_pos THEN left_pos + 1 ELSE rl END AS right_lo, rh AS right_hi FROM w"""
)
def pair_candidate_region(spark: SparkSession, sf: str) -> DataFrame:
    return reads.pair_regions(_evidence(spark, sf).where("kind = 1"), O).select("ev_id", "left_lo", "left_hi", "right_lo", "right_hi")


# --- intervals ----------------------------------------------------------------


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = view(spark, sf, "reads").select("template_id", "read_id", F.col("begin_pos").cast("long").alias("b1"), F.col("end_pos").cast("long").alias("e1"))
    b = _evidence(spark, sf).select("template_id", "ev_id", F.col("left_pos").alias("b2"), (F.col("left_pos") + 30).alias("e2"))
    return a, b


@query(ctes("reads", "evidence") + " SELECT r.template_id, count(*) AS pairs, CAST(sum(read_id * 31 + ev_id) AS BIGINT) AS checksum FROM reads r JOIN evidence e ON r.template_id = e.template_id AND r.begin_pos <= e.left_pos + 30 AND e.left_pos <= r.end_pos GROUP BY 1")
def interval_bin_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    hit = intervals.bin_join(a, b, ["template_id"], ("b1", "e1"), ("b2", "e2"))
    return hit.groupBy("template_id").agg(F.count("*").alias("pairs"), F.sum(F.col("read_id") * 31 + F.col("ev_id")).alias("checksum"))


@query(ctes("reads", "evidence") + " SELECT r.template_id, count(*) AS pairs, CAST(sum(read_id * 31 + ev_id) AS BIGINT) AS checksum FROM (SELECT template_id, read_id, begin_pos % 2000 AS b, begin_pos % 2000 + ref_len % 40 AS e FROM reads) r JOIN (SELECT template_id, ev_id, left_pos % 2000 AS p FROM evidence) x ON r.template_id = x.template_id AND b <= p + 3 AND p <= e WHERE (read_id + ev_id) % 64 = 0 GROUP BY 1")
def crowded_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """All reads and evidence folded into two bins a contig: crowded bins cut into cells and dealt; of the pairs, every 64th counts.

    Equal intervals whose ids leave the same rest are one row, with their number and the sum of their ids.
    """
    a = view(spark, sf, "reads").select("template_id", F.pmod("read_id", F.lit(64)).alias("rest"), "read_id", (F.col("begin_pos") % 2000).cast("long").alias("b1"), (F.col("begin_pos") % 2000 + F.col("ref_len") % 40).cast("long").alias("e1"))
    b = _evidence(spark, sf).select("template_id", F.pmod(-F.col("ev_id"), F.lit(64)).alias("rest"), "ev_id", (F.col("left_pos") % 2000).alias("b2"), (F.col("left_pos") % 2000 + 3).alias("e2"))
    a = a.groupBy("template_id", "rest", "b1", "e1").agg(F.count("*").alias("n1"), F.sum("read_id").alias("s1"))
    b = b.groupBy("template_id", "rest", "b2", "e2").agg(F.count("*").alias("n2"), F.sum("ev_id").alias("s2"))
    hit = intervals.dense_join(settled(a), settled(b), ["template_id", "rest"], ("b1", "e1"), ("b2", "e2"), crowd=200_000)
    return hit.groupBy("template_id").agg(F.sum(F.col("n1") * F.col("n2")).alias("pairs"), F.sum(F.col("s1") * F.col("n2") * 31 + F.col("s2") * F.col("n1")).alias("checksum"))


@query(ctes("reads", "evidence") + " SELECT read_id, count(*) AS near FROM reads r JOIN evidence e ON r.template_id = e.template_id AND NOT (r.begin_pos <= e.left_pos + 30 AND e.left_pos <= r.end_pos) AND greatest(r.begin_pos, e.left_pos) - least(r.end_pos, e.left_pos + 30) <= 50 GROUP BY 1")
def interval_adjacent_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    near = intervals.adjacent_counts(a, b, ["template_id"], ("b1", "e1"), ("b2", "e2"), 50, "near").select("read_id", "near")
    # reads that end before they begin, which none of the tables has
    odd = a.where("b1 > e1").withColumns({"w1": F.col("b1") - 50, "w2": F.col("e1") + 50})
    hit = intervals.bin_join(odd, b, ["template_id"], ("w1", "w2"), ("b2", "e2"), x.adjacent(F.col("b1"), F.col("e1"), F.col("b2"), F.col("e2"), 50))
    return near.unionByName(hit.select("read_id", F.lit(1).cast("long").alias("near"))).groupBy("read_id").agg(F.sum("near").alias("near"))


@query(
    ctes("evidence")
    + """ SELECT ev_id, greatest(left_pos - 50, 0) AS lo, left_pos + 50 AS hi, left_pos // 1000 AS bin, left_pos <= right_pos AS is_valid,
  left_pos <= right_pos + 100 AND right_pos <= left_pos + 100 AS meets, abs(left_pos - right_pos) <= 500 AS near,
  least(left_pos + 1000, right_pos + 900) - greatest(left_pos, right_pos) + 1 >= 0.8 * 1001 AND least(left_pos + 1000, right_pos + 900) - greatest(left_pos, right_pos) + 1 >= 0.8 * 901 AS mutual
FROM evidence"""
)
def interval_predicates(spark: SparkSession, sf: str) -> DataFrame:
    le, ri = F.col("left_pos"), F.col("right_pos")
    lo, hi = x.widened(le, le, 50)
    return _evidence(spark, sf).select(
        "ev_id", lo.alias("lo"), hi.alias("hi"), x.bin_of(le).alias("bin"), x.valid(le, ri).alias("is_valid"), x.overlaps(le, le + 100, ri, ri + 100).alias("meets"), x.adjacent_points(le, ri, 500).alias("near"), x.reciprocal(le, le + 1000, ri, ri + 900, 0.8).alias("mutual")
    )


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = _evidence(spark, sf)
    pairs = ev.where("kind = 1").select("template_id", "orientation", F.col("ev_id").alias("a"), (F.col("left_pos") - 50).alias("l1"), (F.col("left_pos") + 50).alias("l2"), F.col("right_pos").alias("pr"))
    others = ev.where("kind = 0").select("template_id", "orientation", F.col("ev_id").alias("b"), F.col("left_pos").alias("bl"), F.col("right_pos").alias("br"))
    return pairs, others


@query(ctes("evidence") + " SELECT a.ev_id AS a, b.ev_id AS b FROM evidence a JOIN evidence b ON a.kind = 1 AND b.kind = 0 AND a.template_id = b.template_id AND a.orientation = b.orientation AND abs(a.left_pos - b.left_pos) <= 50 AND abs(a.right_pos - b.right_pos) <= 50")
def two_sided_match(spark: SparkSession, sf: str) -> DataFrame:
    pairs, others = _matched(spark, sf)
    return intervals.dense_join(settled(pairs), settled(others), ["template_id", "orientation"], ("l1", "l2"), ("bl", "bl"), F.abs(F.col("pr") - F.col("br")) <= 50).select("a", "b")


@query(ctes("evidence") + " SELECT a.ev_id AS a, count(*) AS matches FROM evidence a JOIN evidence b ON a.kind = 2 AND b.kind = 0 AND a.template_id = b.template_id AND abs(a.left_pos - b.left_pos) <= 50 GROUP BY 1")
def one_sided_match(spark: SparkSession, sf: str) -> DataFrame:
    ev = _evidence(spark, sf)
    clips = ev.where("kind = 2").select("template_id", F.col("ev_id").alias("a"), (F.col("left_pos") - 50).alias("l1"), (F.col("left_pos") + 50).alias("l2"))
    others = ev.where("kind = 0").select("template_id", F.col("ev_id").alias("b"), F.col("left_pos").alias("bl"))
    return intervals.bin_join(clips, others, ["template_id"], ("l1", "l2"), ("bl", "bl")).groupBy("a").agg(F.count("*").alias("matches"))


@query(
    ctes("evidence")
    + " SELECT ev_id FROM evidence a WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM evidence b WHERE b.kind = 0 AND a.template_id = b.template_id AND a.orientation = b.orientation AND abs(a.left_pos - b.left_pos) <= 50 AND abs(a.right_pos - b.right_pos) <= 50)"
)
def unmatched_pairs_anti(spark: SparkSession, sf: str) -> DataFrame:
    pairs, others = _matched(spark, sf)
    near = intervals.near_points(pairs.withColumn("pl", F.col("l1") + 50), others, ["template_id", "orientation"], ("pl", "pr"), ("bl", "br"), 50)
    spot = ["template_id", "orientation", "pl", "pr"]
    return pairs.withColumn("pl", F.col("l1") + 50).join(near.select(*spot), spot, "left_anti").select(F.col("a").alias("ev_id"))


# --- clusters -----------------------------------------------------------------


@query(_BPS + " SELECT template_id, orientation, supp, min_left, max_left, min_right, max_right, final_left, final_right FROM bps WHERE supp >= 4")
def breakpoint_cluster(spark: SparkSession, sf: str) -> DataFrame:
    out = cluster.breakpoints(_evidence(spark, sf), 50, 1).where(F.col("supp") >= O.cutoff)
    return out.select("template_id", "orientation", "supp", "min_left", "max_left", "min_right", "max_right", "final_left", "final_right").orderBy("template_id", "min_left", "max_right")


@query(_CLUSTERS + ", c AS (SELECT template_id, orientation, li, ri, count(*) AS supp FROM s4 GROUP BY ALL) SELECT template_id, orientation, count(*) AS clusters, CAST(sum(supp) AS BIGINT) AS support, max(supp) AS largest FROM c GROUP BY 1, 2")
def breakpoint_cluster_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.breakpoints(_evidence(spark, sf), 50).groupBy("template_id", "orientation").agg(F.count("*").alias("clusters"), F.sum("supp").alias("support"), F.max("supp").alias("largest"))


@query()
def breakpoint_cluster_replay(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.replayed(_evidence(spark, sf), 50)


@query(_BPS + " SELECT bp_id, imprecise, final_left, final_right FROM bps")
def final_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _bps(spark, sf).select("bp_id", "imprecise", "final_left", "final_right")


@query(_BPS + " SELECT bp_id, score, vt, filtered FROM bps")
def filter_and_vote(spark: SparkSession, sf: str) -> DataFrame:
    return _bps(spark, sf).select("bp_id", "score", "vt", "filtered")


@query(_BPS + " SELECT template_id, orientation, count(*) AS n, count(*) FILTER (NOT filtered) AS passed, CAST(sum(se) AS BIGINT) AS se, CAST(sum(pe) AS BIGINT) AS pe, CAST(sum(ce) AS BIGINT) AS ce FROM bps GROUP BY 1, 2")
def breakpoint_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _bps(spark, sf).groupBy("template_id", "orientation").agg(F.count("*").alias("n"), F.count_if(~F.col("filtered")).alias("passed"), *[F.sum(k).alias(k) for k in ("se", "pe", "ce")])


# --- depth --------------------------------------------------------------------

_RLE = (
    ctes("reads", "evidence")
    + """, ok AS (SELECT * FROM reads WHERE (flag & 772) = 0),
dl AS (SELECT template_id, pos, sum(d) AS d FROM (SELECT template_id, CAST(begin_pos AS BIGINT) AS pos, 1 AS d FROM ok UNION ALL SELECT template_id, end_pos, -1 FROM ok) GROUP BY 1, 2),
rn AS (SELECT template_id, pos AS start, lead(pos) OVER w AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth FROM dl WINDOW w AS (PARTITION BY template_id ORDER BY pos)),
rle AS (SELECT template_id, start, stop, depth FROM rn WHERE depth > 0 AND stop IS NOT NULL),
len AS (SELECT template_id, CAST(max(end_pos) AS BIGINT) AS length FROM reads GROUP BY 1)"""
)


def _depth(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.coverage(view(spark, sf, "reads").where(x.usable("flag")), "template_id", "begin_pos", "end_pos")


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "reads").groupBy("template_id").agg(F.max("end_pos").cast("long").alias("length"))


@query(_RLE + " SELECT * FROM rle")
def coverage_rle(spark: SparkSession, sf: str) -> DataFrame:
    return _depth(spark, sf)


@query(_RLE + " SELECT template_id, CAST(sum((stop - start) * depth) AS BIGINT) AS bases, CAST(sum(stop - start) AS BIGINT) AS covered, max(depth) AS deepest FROM rle GROUP BY 1")
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("stop") - F.col("start")
    return _depth(spark, sf).groupBy("template_id").agg(F.sum(size * F.col("depth")).alias("bases"), F.sum(size).alias("covered"), F.max("depth").alias("deepest"))


@query(
    ctes("reads", "evidence")
    + """, ok AS (SELECT template_id, CAST(begin_pos AS BIGINT) AS b, CAST(end_pos AS BIGINT) AS e, 1 AS w FROM reads WHERE (flag & 772) = 0
  UNION ALL SELECT template_id, left_pos % 5000, left_pos % 5000 + 20, 1 + ev_id % 3 FROM evidence WHERE kind = 2),
dl AS (SELECT template_id, pos, sum(d) AS d FROM (SELECT template_id, b AS pos, w AS d FROM ok UNION ALL SELECT template_id, e, -w FROM ok) GROUP BY 1, 2),
rn AS (SELECT template_id, pos AS start, lead(pos) OVER w AS stop, CAST(sum(d) OVER w AS BIGINT) AS depth FROM dl WINDOW w AS (PARTITION BY template_id ORDER BY pos))
SELECT * FROM rn WHERE depth > 0 AND stop IS NOT NULL"""
)
def coverage_with_placed_clips(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "reads").where(x.usable("flag")).select("template_id", F.col("begin_pos").cast("long").alias("begin_pos"), F.col("end_pos").cast("long").alias("end_pos"))
    b = F.col("left_pos") % 5000
    placed = _evidence(spark, sf).where("kind = 2").select("template_id", b.alias("begin_pos"), (b + 20).alias("end_pos"), (1 + F.col("ev_id") % 3).alias("supp"))
    return depth.with_placements(rows, placed, "template_id", "begin_pos", "end_pos", "supp")


_MEANS = """, pt AS (SELECT ev_id, template_id, least(left_pos % 30000, length - 1) AS p, length FROM evidence JOIN len USING (template_id)),
wd AS (SELECT ev_id, template_id, p, CASE WHEN p > 20 THEN p - 20 ELSE 0 END AS b, CASE WHEN p < length - 6 THEN p + 6 ELSE length - 1 END AS e FROM pt),
sm AS (
  SELECT ev_id, sum(CASE WHEN least(p, stop) > greatest(b, start) THEN (least(p, stop) - greatest(b, start)) * depth ELSE 0 END) AS lt,
    sum(CASE WHEN least(e, stop) > greatest(p, start) THEN (least(e, stop) - greatest(p, start)) * depth ELSE 0 END) AS rt
  FROM wd JOIN rle ON wd.template_id = rle.template_id AND start < e AND b < stop GROUP BY 1),
mn AS (SELECT ev_id, coalesce(lt, 0) / (greatest(p - b, 0) + 1e-10) AS lm, coalesce(rt, 0) / (greatest(e - p, 0) + 1e-10) AS rm FROM wd LEFT JOIN sm USING (ev_id))"""


def _means(spark: SparkSession, sf: str) -> DataFrame:
    points = _evidence(spark, sf).select("ev_id", "template_id", (F.col("left_pos") % 30000).alias("pos"))
    return depth.window_means(_depth(spark, sf), points, _lengths(spark, sf), "template_id", "ev_id", "pos", O.depth_window, 5)


@query(_RLE + _MEANS + " SELECT ev_id, round(lm, 6) AS left_mean, round(rm, 6) AS right_mean FROM mn")
def window_depth_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).select("ev_id", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"))


@query(_RLE + _MEANS + ", k AS (SELECT ev_id, greatest(lm, rm) + 1e-10 AS a, least(lm, rm) + 1e-10 AS b FROM mn) SELECT ev_id, round(greatest(a - b + b * ln(b / a), 0), 5) AS re FROM k")
def kl_score(spark: SparkSession, sf: str) -> DataFrame:
    return _means(spark, sf).select("ev_id", F.round(depth.divergence(F.col("left_mean"), F.col("right_mean")), 5).alias("re"))


@query(ctes("reads") + " SELECT read_id, round(pow(2.5, map_q % 10) * exp(-2.5) / factorial(map_q % 10), 9) AS p FROM reads")
def poisson_pmf(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "reads").select("read_id", F.round(x.poisson_pmf((F.col("map_q") % 10), F.lit(2.5)), 9).alias("p"))


_BACKGROUND = """, sh AS (SELECT template_id, count(*) AS n FROM evidence GROUP BY 1), al AS (SELECT sum(n) AS a FROM sh),
sp AS (SELECT template_id, length, unnest(range(CAST(ceil(100000.0 * n / a) AS BIGINT))) AS i FROM sh JOIN len USING (template_id), al),
ps AS (SELECT DISTINCT template_id, (i * 48271 + 11) % length AS p, length FROM sp),
wd AS (SELECT template_id, p, CASE WHEN p > 20 THEN p - 20 ELSE 0 END AS b, CASE WHEN p < length - 21 THEN p + 21 ELSE length - 1 END AS e FROM ps),
sm AS (
  SELECT wd.template_id, p, b, e, sum(CASE WHEN least(p, stop) > greatest(b, start) THEN (least(p, stop) - greatest(b, start)) * depth ELSE 0 END) / (greatest(p - b, 0) + 1e-10) AS lm,
    sum(CASE WHEN least(e, stop) > greatest(p, start) THEN (least(e, stop) - greatest(p, start)) * depth ELSE 0 END) / (greatest(e - p, 0) + 1e-10) AS rm
  FROM wd JOIN rle ON wd.template_id = rle.template_id AND start < e AND b < stop GROUP BY wd.template_id, p, b, e),
bg AS (SELECT (lm + rm) / 2 AS depth, greatest(greatest(lm, rm) - least(lm, rm) + (least(lm, rm) + 1e-10) * ln((least(lm, rm) + 1e-10) / (greatest(lm, rm) + 1e-10)), 0) AS re FROM sm WHERE lm + rm > 0)"""


@query(
    _RLE
    + _BACKGROUND
    + """, q AS (SELECT 'depth' AS what, list_sort(list(depth)) AS v, count(*) AS n FROM bg UNION ALL SELECT 're', list_sort(list(re)), count(*) FROM bg)
SELECT what, round(v[n // 4 + 1], 5) AS q1, round(v[n // 2 + 1], 5) AS median, round(v[(3 * n) // 4 + 1], 5) AS q3, round(v[(3 * n) // 4 + 1] + 1.0 * (v[(3 * n) // 4 + 1] - v[n // 4 + 1]), 5) AS threshold FROM q"""
)
def depth_background_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Both thresholds of the command: of depth, for imprecise deletions, and of divergence, for votes."""
    shares = _evidence(spark, sf).groupBy("template_id").agg(F.count("*").alias("n"))
    rows = settled(depth.background(_depth(spark, sf), _lengths(spark, sf), shares, O.depth_samples, O.depth_window))
    found = [depth.outlier_threshold(rows, x, k).withColumn("what", F.lit(x)) for x, k in (("depth", O.depth_outlier), ("re", O.depth_threshold))]
    return found[0].unionByName(found[1]).select("what", *[F.round(x, 5).alias(x) for x in ("q1", "median", "q3", "threshold")])


# --- variants -----------------------------------------------------------------


@query(_BPS + " SELECT bp_id, template_id, final_left AS begin_pos, final_right AS end_pos, se, pe, ce FROM bps WHERE orientation = 3 AND NOT filtered AND final_left < final_right AND final_right - final_left + 1 >= 50")
def call_inversion(spark: SparkSession, sf: str) -> DataFrame:
    return calls.inversions(_bps(spark, sf), O).select("bp_id", "template_id", "begin_pos", "end_pos", "se", "pe", "ce")


@query(_BPS + _DELS + " SELECT bp_id, template_id, begin_pos, end_pos, status FROM dels")
def call_deletion(spark: SparkSession, sf: str) -> DataFrame:
    return calls.deletions(_bps(spark, sf), O).select("bp_id", "template_id", "begin_pos", "end_pos", "status")


@query(_BPS + " SELECT bp_id, CASE WHEN filtered OR (imprecise AND rd > 20.0) THEN 'FILTERED' ELSE 'PASS' END AS status FROM bps WHERE orientation = 0 AND final_left < final_right AND final_right - final_left + 1 >= 50")
def imprecise_del_filter(spark: SparkSession, sf: str) -> DataFrame:
    return calls.deletions(_bps(spark, sf), O, 20.0).select("bp_id", "status")


@query(_BPS + _DUPS + " SELECT bp_id, sv_type, begin_pos, end_pos, target_pos, status, imprecise FROM dups")
def call_duplication(spark: SparkSession, sf: str) -> DataFrame:
    bps = _bps(spark, sf)
    return calls.duplications(bps, calls.deletions(bps, O), O)[0].select("bp_id", "sv_type", "begin_pos", "end_pos", "target_pos", "status", "imprecise")


@query(_BPS + _DUPS + " SELECT bp_id, CASE WHEN bp_id IN (SELECT del_id FROM h) THEN 'MERGED' ELSE status END AS status FROM dels")
def merged_deletions(spark: SparkSession, sf: str) -> DataFrame:
    bps = _bps(spark, sf)
    return calls.duplications(bps, calls.deletions(bps, O), O)[1].select("bp_id", "status")


_TRA = """,
dd AS (SELECT *, row_number() OVER (ORDER BY template_id, begin_pos, end_pos, bp_id) AS ord FROM dups WHERE sv_type LIKE 'DUP%'),
pr AS (SELECT i.ord AS oi, j.ord AS oj FROM dd i JOIN dd j ON i.template_id = j.template_id AND i.ord < j.ord AND abs(i.begin_pos - j.target_pos) <= 50 AND abs(j.end_pos - i.target_pos) <= 50),
tr AS (
  SELECT bp_id, sv_type, begin_pos, end_pos, target_pos, status, template_id, se, pe, ce FROM dups WHERE sv_type = 'TRA'
  UNION ALL SELECT i.bp_id, 'TRA', i.begin_pos, i.end_pos, i.target_pos, CASE WHEN i.status = 'PASS' OR j.status = 'PASS' THEN 'PASS' ELSE i.status END, i.template_id, i.se + j.se, i.pe + j.pe, i.ce + j.ce
  FROM pr JOIN dd i ON i.ord = oi JOIN dd j ON j.ord = oj),
tn AS (SELECT *, row_number() OVER (ORDER BY template_id, begin_pos, end_pos, bp_id) AS t FROM tr),
d2 AS (SELECT dd.* REPLACE (CASE WHEN ord IN (SELECT oi FROM pr UNION SELECT oj FROM pr) THEN 'MERGED' ELSE status END AS status) FROM dd),
ab AS (
  SELECT d2.ord, min(t) AS t, any_value(d2.se) AS se, any_value(d2.pe) AS pe, any_value(d2.ce) AS ce FROM tn JOIN d2 ON tn.template_id = d2.template_id
    AND tn.status = 'PASS' AND d2.status <> 'MERGED' AND tn.begin_pos <= tn.end_pos AND d2.begin_pos <= d2.end_pos AND tn.begin_pos <= d2.end_pos AND d2.begin_pos <= tn.end_pos GROUP BY 1),
gn AS (SELECT t, sum(se) AS se, sum(pe) AS pe, sum(ce) AS ce FROM ab GROUP BY 1)
SELECT bp_id, sv_type, begin_pos, end_pos, target_pos, CASE WHEN ord IN (SELECT ord FROM ab) THEN 'MERGED' ELSE status END AS status, se, pe, ce FROM d2
UNION ALL SELECT bp_id, sv_type, begin_pos, end_pos, target_pos, status, CAST(tn.se + coalesce(gn.se, 0) AS BIGINT), CAST(tn.pe + coalesce(gn.pe, 0) AS BIGINT), CAST(tn.ce + coalesce(gn.ce, 0) AS BIGINT) FROM tn LEFT JOIN gn USING (t)"""


@query(_BPS + _DUPS + _TRA)
def call_translocation(spark: SparkSession, sf: str) -> DataFrame:
    bps = _bps(spark, sf)
    dups = calls.duplications(bps, calls.deletions(bps, O), O)[0]
    return calls.translocations(dups, O).select("bp_id", "sv_type", "begin_pos", "end_pos", "target_pos", "status", "se", "pe", "ce")


@query(
    _BPS
    + """, v AS (SELECT *, (min_left % 2 = 0) = (min_right % 3 = 0) AS same, concat('chr', CAST(template_id + 1 AS STRING)) AS ln, concat('chr', CAST((template_id + 1) % 3 + 1 AS STRING)) AS rn FROM bps WHERE orientation = 4 AND NOT filtered)
SELECT bp_id, 1 AS no, ln AS chrom, final_left AS begin_pos, CASE WHEN same THEN concat('N[', rn, ':', CAST(final_right + 1 AS STRING), '[') ELSE concat('N]', rn, ':', CAST(final_right + 1 AS STRING), ']') END AS alt FROM v
UNION ALL SELECT bp_id, 2, rn, final_right, CASE WHEN same THEN concat(']', ln, ':', CAST(final_left + 1 AS STRING), ']N') ELSE concat('[', ln, ':', CAST(final_left + 1 AS STRING), '[N') END FROM v"""
)
def call_breakend(spark: SparkSession, sf: str) -> DataFrame:
    bps = _bps(spark, sf).withColumns({"right_template": ((F.col("template_id") + 1) % 3).cast("int"), "left_reverse": F.col("min_left") % 2 == 0, "right_reverse": F.col("min_right") % 3 == 0})
    names = spark.range(3).select(F.col("id").cast("int").alias("template_id"), F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("name"))
    return calls.breakends(bps, names).select("bp_id", "no", "chrom", "begin_pos", "alt")


@query(_BPS + _DELS + " SELECT bp_id, CAST(se + pe + ce AS DOUBLE) AS sc FROM dels")
def order_evidence_sum(spark: SparkSession, sf: str) -> DataFrame:
    return calls.by_evidence(calls.deletions(_bps(spark, sf), O)).select("bp_id", "sc")


@query(
    _BPS
    + _DELS
    + """, r AS (
  SELECT bp_id, row_number() OVER (ORDER BY se + ce DESC, rd, bp_id) - 1 AS a, row_number() OVER (ORDER BY pe DESC, rd, bp_id) - 1 AS b, row_number() OVER (ORDER BY re DESC, rd, bp_id) - 1 AS c
  FROM dels WHERE status = 'PASS'),
m AS (SELECT bp_id, list_sort([a, b, c])[2] AS m FROM r),
k AS (SELECT bp_id, rank() OVER (ORDER BY m) AS r, count(*) OVER () AS n FROM m)
SELECT bp_id, round(CASE WHEN n = 1 THEN 100.0 ELSE (1 - CAST(r - 1 AS DOUBLE) / (n - 1)) * 100 END, 6) AS sc FROM k
UNION ALL SELECT bp_id, -1.0 FROM dels WHERE status <> 'PASS'"""
)
def order_rank_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    return calls.ranked(calls.deletions(_bps(spark, sf), O)).select("bp_id", F.round("sc", 6).alias("sc"))


@query(_BPS + _DELS + " SELECT bp_id, concat('DEL_', CAST(row_number() OVER (ORDER BY template_id, begin_pos, end_pos, bp_id) AS STRING)) AS sv_id FROM dels")
def variant_ids(spark: SparkSession, sf: str) -> DataFrame:
    return calls.numbered(calls.deletions(_bps(spark, sf), O)).select("bp_id", "sv_id")


# --- the call command -------------------------------------------------------------


def _islands(source: str, name: str, keys: str, begin: str, end: str, out: str) -> str:
    """CTEs ``name``_a and ``name``: ``source`` with ``out``, numbers of islands of intervals within 50 of one another."""
    by = f"PARTITION BY {keys} ORDER BY {begin}, {end}"
    return f""",
{name}_a AS (SELECT *, CASE WHEN {begin} - 50 <= max({end}) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS {out}_new FROM {source}),
{name} AS (SELECT *, sum({out}_new) OVER ({by} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {out} FROM {name}_a)"""


_SPLIT = """,
ev AS (
  SELECT template_id, CAST(CASE WHEN orientation = 4 THEN (template_id + 1) % 3 ELSE template_id END AS INT) AS right_template, orientation,
    CASE WHEN orientation = 2 THEN left_pos - 400 ELSE left_pos END AS lp, CASE WHEN orientation = 2 THEN left_pos - 1 ELSE right_pos - 1 END AS rp FROM evidence WHERE kind = 0 AND orientation <> 3)"""
_K = "template_id, right_template, orientation"
_MERGED = (
    ctes("evidence").replace("WITH ", "WITH RECURSIVE ", 1)
    + _SPLIT
    + _islands("ev", "v1", _K, "lp", "lp", "l1")
    + _islands("v1", "v2", f"{_K}, l1", "rp", "rp", "r1")
    + _islands("v2", "v3", f"{_K}, l1, r1", "lp", "lp", "l2")
    + _islands("v3", "v4", f"{_K}, l1, r1, l2", "rp", "rp", "r2")
    + f""",
e1 AS (SELECT *, dense_rank() OVER (ORDER BY {_K}, l1, r1, l2, r2) AS bp FROM v4),
hull AS (SELECT {_K}, bp, min(lp) AS b1, max(lp) AS b2, min(rp) AS c1, max(rp) AS c2 FROM e1 GROUP BY ALL),
ins AS (SELECT list_sort(list(300 + ev_id % 40)) AS v FROM (SELECT ev_id FROM evidence WHERE kind = 2 ORDER BY ev_id LIMIT 100000)),
dev AS (SELECT v[len(v) // 2 + 1] AS med, list_sort(list_transform(v, lambda x: abs(x - v[len(v) // 2 + 1]))) AS w FROM ins),
hi AS (SELECT med + 9.0 * w[len(w) // 2 + 1] AS high FROM dev),
prs AS (
  SELECT template_id, template_id AS right_template, CAST(CASE WHEN orientation IN (2, 3) THEN orientation ELSE 0 END AS INT) AS orientation, left_pos AS x1, left_pos + 99 AS x2, right_pos AS y1, right_pos + 99 AS y2,
    CASE WHEN orientation = 2 THEN true WHEN orientation = 3 THEN ev_id % 2 = 0 ELSE false END AS back
  FROM evidence, hi WHERE kind = 1 AND (orientation IN (2, 3) OR right_pos + 100 - left_pos > high))"""
    + _islands("prs", "p1", _K, "x1", "x2", "l1")
    + _islands("p1", "p2", f"{_K}, l1", "y1", "y2", "r1")
    + _islands("p2", "p3", f"{_K}, l1, r1", "x1", "x2", "l2")
    + _islands("p3", "p4", f"{_K}, l1, r1, l2", "y1", "y2", "r2")
    + f""",
pc AS (
  SELECT {_K}, count(*) AS supp, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2, min_by(back, (x1, y1, back)) AS back, row_number() OVER () AS pair
  FROM p4 GROUP BY {_K}, l1, r1, l2, r2),
pp AS (
  SELECT *, CASE WHEN orientation = 2 OR (orientation = 3 AND back) THEN x1 ELSE x2 END AS pl, CASE WHEN orientation = 2 OR (orientation = 3 AND NOT back) THEN y2 ELSE y1 END AS pq FROM pc),
pg AS (
  SELECT *, greatest(pl - CASE WHEN orientation IN (2, 3) THEN 500 ELSE 50 END, 0) AS ll, least(pl + CASE WHEN orientation = 2 THEN 50 ELSE 500 END, CASE WHEN pl + CASE WHEN orientation = 2 THEN 50 ELSE 500 END > pq THEN pq - 1 ELSE 9e18 END) AS lh,
    CASE WHEN greatest(pq - CASE WHEN orientation = 2 THEN 50 ELSE 500 END, 0) < pl THEN pl + 1 ELSE greatest(pq - CASE WHEN orientation = 2 THEN 50 ELSE 500 END, 0) END AS rl, pq + CASE WHEN orientation IN (2, 3) THEN 500 ELSE 50 END AS rh
  FROM pp),
ht AS (
  SELECT pair, supp, bp FROM pg JOIN hull h ON pg.template_id = h.template_id AND pg.right_template = h.right_template AND pg.orientation = h.orientation
    AND ll - 50 <= b2 AND b1 <= lh + 50 AND rl - 50 <= c2 AND c1 <= rh + 50),
lk AS (SELECT DISTINCT a.bp AS x, b.bp AS y FROM ht a JOIN ht b ON a.pair = b.pair),
rc AS (SELECT x, y FROM lk UNION SELECT rc.x, lk.y FROM rc JOIN lk ON rc.y = lk.x),
lb AS (SELECT x, min(y) AS root FROM rc GROUP BY 1),
e2 AS (SELECT e1.*, coalesce(root, bp) AS root FROM e1 LEFT JOIN lb ON bp = x),
gain AS (SELECT root, sum(supp) AS pe FROM (SELECT DISTINCT pair, supp, root FROM ht JOIN lb ON bp = x) GROUP BY 1),
b0 AS (SELECT {_K}, root, count(*) AS se, list_sort(list(lp)) AS ls, list_sort(list(rp)) AS rs FROM e2 GROUP BY {_K}, root),
bq AS (
  SELECT {_K}, CAST(se AS BIGINT) AS se, CAST(coalesce(pe, 0) AS BIGINT) AS pe, CAST(0 AS BIGINT) AS ce, ls[len(ls) // 2 + 1] AS final_left, rs[len(rs) // 2 + 1] AS final_right, false AS imprecise FROM b0 LEFT JOIN gain USING (root)
  UNION ALL SELECT {_K}, 0, CAST(supp AS BIGINT), 0, pl, pq, true FROM pg WHERE pair NOT IN (SELECT pair FROM ht))"""
)


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.when(F.col("tagged"), F.create_map(F.lit("SA"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = view(spark, sf, "aligned").withColumns({"qname": F.col("ev_id").cast("string"), "map_q": F.lit(60), "seq": F.lit(""), "qual": F.lit(""), "tags": tags})
    return rows.drop("tagged", "ev_id")


@query(_MERGED + f" SELECT {_K}, se, pe, ce, final_left, final_right, imprecise FROM bq")
def merged_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Breakpoints of the command: split reads clustered, pairs added by region, the rest imprecise."""
    bps = command.merged_breakpoints(settled(command.routed_reads(_aligned(spark, sf), _PLAIN)), _PLAIN)[0]
    return bps.select("template_id", "right_template", "orientation", "se", "pe", "ce", "final_left", "final_right", "imprecise")


#: Options of the end-to-end queries: votes of split reads and pairs, all variants reported.
_PLAIN = CallOptions(use_depth=False, rank_aggregation=False, report_filtered=True)

_CALLED = (
    _MERGED
    + """,
bz AS (
  SELECT *, row_number() OVER () AS bp_id, CAST(NULL AS DOUBLE) AS re, CAST(NULL AS DOUBLE) AS rd, CAST(se + ce >= 1 AS INT) + CAST(pe >= 1 AS INT) AS vt,
    NOT (se + pe + ce >= 4 OR (orientation <> 3 AND CAST(se + ce >= 1 AS INT) + CAST(pe >= 1 AS INT) >= 2)) AS filtered FROM bq),
bps AS (SELECT * FROM bz WHERE template_id = right_template)"""
    + _DELS
    + _DUPS.removeprefix(_DELS)
    + _TRA.rsplit("\nSELECT bp_id", 1)[0]
    + """,
every AS (
  SELECT sv_type, template_id, begin_pos, end_pos, target_pos, CASE WHEN ord IN (SELECT ord FROM ab) THEN 'MERGED' ELSE status END AS status, se, pe, ce, 0 AS no, '<' || sv_type || '>' AS alt, bp_id FROM d2
  UNION ALL SELECT sv_type, template_id, begin_pos, end_pos, target_pos, status, CAST(tn.se + coalesce(gn.se, 0) AS BIGINT), CAST(tn.pe + coalesce(gn.pe, 0) AS BIGINT), CAST(tn.ce + coalesce(gn.ce, 0) AS BIGINT), 0, '<TRA>', bp_id FROM tn LEFT JOIN gn USING (t)
  UNION ALL SELECT 'DEL', template_id, begin_pos, end_pos, NULL, CASE WHEN bp_id IN (SELECT del_id FROM h) THEN 'MERGED' ELSE status END, se, pe, ce, 0, '<DEL>', bp_id FROM dels
  UNION ALL SELECT 'INV', template_id, final_left, final_right, NULL, 'PASS', se, pe, ce, 0, '<INV>', bp_id FROM bps WHERE orientation = 3 AND NOT filtered AND final_left < final_right AND final_right - final_left + 1 >= 50
  UNION ALL SELECT 'BND', template_id, final_left, NULL, NULL, 'PASS', se, pe, ce, 1, 'N[chr' || (right_template + 1) || ':' || (final_right + 1) || '[', bp_id FROM bz WHERE orientation = 4 AND NOT filtered
  UNION ALL SELECT 'BND', right_template, final_right, NULL, NULL, 'PASS', se, pe, ce, 2, ']chr' || (template_id + 1) || ':' || (final_left + 1) || ']N', bp_id FROM bz WHERE orientation = 4 AND NOT filtered)"""
)


def _called(spark: SparkSession, sf: str) -> DataFrame:
    lengths = view(spark, sf, "aligned").groupBy(F.col("rid").alias("template_id")).agg((F.max("begin_pos") + 5000).alias("length"))
    contigs = lengths.select("template_id", F.concat(F.lit("chr"), (F.col("template_id") + 1).cast("string")).alias("name"), "length")
    return command.call(_aligned(spark, sf), contigs, _PLAIN)


@query(_CALLED + " SELECT sv_type, 'chr' || (template_id + 1) AS chrom, begin_pos, end_pos, target_pos, status, se, pe, ce, alt, CAST(se + pe + ce AS DOUBLE) AS sc FROM every")
def call_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    return _called(spark, sf).select("sv_type", "chrom", "begin_pos", "end_pos", "target_pos", "status", "se", "pe", "ce", "alt", "sc")


@query(
    _CALLED
    + """, kd AS (SELECT *, regexp_replace(sv_type, ':.*', '') AS k FROM every),
nm AS (SELECT k, count(*) FILTER (no <> 2) AS n FROM kd GROUP BY 1)
SELECT k || '_' || (i - CASE WHEN k = 'TRA' THEN 1 ELSE 0 END) || CASE WHEN k = 'BND' THEN '_' || no ELSE '' END AS sv_id
FROM (SELECT k, unnest(range(1, n + 1)) AS i FROM nm), (SELECT unnest([1, 2]) AS no) WHERE k = 'BND' OR no = 1"""
)
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all records: without gaps per type, tandem duplications among the others, two for each breakend."""
    return _called(spark, sf).select("sv_id")


# --- record text -----------------------------------------------------------------


@query(
    ctes("svtext")
    + """ SELECT ev_id, regexp_extract(info, 'SVTYPE=([A-Z:]+)', 1) AS sv_type, pos - 1 AS begin_pos, pos - 1 + abs(CAST(regexp_extract(info, 'SVLEN=(-?\\d+)', 1) AS BIGINT)) - 1 AS end_pos,
  CAST(regexp_extract(info, 'SE=(\\d+)', 1) AS BIGINT) AS se, CAST(regexp_extract(info, ';PE=(\\d+)', 1) AS BIGINT) AS pe, CAST(regexp_extract(info, ';CE=(\\d+)', 1) AS BIGINT) AS ce,
  CAST(regexp_extract(info, 'RD=([0-9.]+)', 1) AS DOUBLE) AS rd, CAST(regexp_extract(info, 'SC=([0-9.]+)', 1) AS DOUBLE) AS sc, contains(info, ';IMPRECISE') AS imprecise FROM svtext WHERE filter = 'PASS'"""
)
def info_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "svtext").where("filter = 'PASS'")
    return vcf.parse_info(rows).select("ev_id", "sv_type", "begin_pos", "end_pos", "se", "pe", "ce", "rd", "sc", "imprecise")


@query(
    _BPS
    + _DELS
    + """ SELECT bp_id, concat('SC=', CAST(se + pe + ce AS STRING), '.000000;VT=', CAST(vt AS STRING), ';SE=', CAST(se AS STRING), ';PE=', CAST(pe AS STRING), ';CE=', CAST(ce AS STRING), ';RE=', printf('%.6f', re), ';RD=', printf('%.6f', rd), ';SVLEN=-', CAST(end_pos - begin_pos + 1 AS STRING), ';SVTYPE=DEL') AS info FROM dels"""
)
def info_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = calls.by_evidence(calls.deletions(_bps(spark, sf), O))
    fields = {k: F.col(k.lower()) for k in ("SC", "VT", "SE", "PE", "CE", "RE", "RD")}
    return rows.select("bp_id", vcf.info_text(F.col("sv_type"), F.col("begin_pos"), F.col("end_pos"), F.col("target_pos"), fields).alias("info"))


# --- merging ------------------------------------------------------------------------


def _svs(spark: SparkSession, sf: str) -> DataFrame:
    rows = vcf.parse_info(view(spark, sf, "svtext").where("filter = 'PASS'")).where("sv_type <> 'BND'")
    gt = F.when(F.col("ev_id") % 4 == 0, "0/0").when(F.col("ev_id") % 4 == 1, "1/1").otherwise("0/1")
    return rows.select(F.col("ev_id").alias("sv"), "sv_type", "chrom", "begin_pos", "end_pos", "sc", "rd", "dataset_idx", F.col("ev_id").alias("ordinal"), gt.alias("gt"))


_SVS = (
    ctes("svtext")
    + """, svs AS (
  SELECT ev_id AS sv, regexp_extract(info, 'SVTYPE=([A-Z:]+)', 1) AS sv_type, chrom, pos - 1 AS b, pos - 1 + abs(CAST(regexp_extract(info, 'SVLEN=(-?\\d+)', 1) AS BIGINT)) - 1 AS e
  FROM svtext WHERE filter = 'PASS')"""
)


@query(_SVS + " SELECT x.sv AS a, y.sv AS b FROM svs x JOIN svs y ON x.sv_type = y.sv_type AND x.chrom = y.chrom AND x.sv < y.sv AND x.sv_type <> 'BND' AND x.b <= y.e AND y.b <= x.e AND least(x.e, y.e) - greatest(x.b, y.b) + 1 >= 0.8 * (x.e - x.b + 1) AND least(x.e, y.e) - greatest(x.b, y.b) + 1 >= 0.8 * (y.e - y.b + 1)")
def merge_reciprocal_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return merge.expanded_pairs(settled(_svs(spark, sf)), 0.8)


@query()
def merge_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return merge.cluster_summary(merge.first_fit(_svs(spark, sf), 0.8))


@query()
def genotype_matrix(spark: SparkSession, sf: str) -> DataFrame:
    members = merge.first_fit(_svs(spark, sf), 0.8)
    return merge.genotypes(members, spark.range(3).select(F.col("id").cast("int").alias("dataset_idx")))


# --- sequences --------------------------------------------------------------------------


@query(ctes("dna") + " SELECT seq_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc, left(seq, 20) AS head, right(seq, 20) AS tail, substr(seq, 5, 10) AS inner FROM dna")
def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "dna").select("seq_id", F.md5(x.revcomp("seq")).alias("rc"), F.left("seq", F.lit(20)).alias("head"), F.right("seq", F.lit(20)).alias("tail"), F.substring("seq", 5, 10).alias("inner"))


@query(
    ctes("dna")
    + """, n AS (SELECT seq_id, length(seq) AS n, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c, length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t FROM dna)
SELECT seq_id, CASE WHEN n > 0 THEN round((g + c) / n, 6) END AS gc,
  round(coalesce(CASE WHEN a > 0 THEN -(a / n) * log2(a / n) END, 0) + coalesce(CASE WHEN c > 0 THEN -(c / n) * log2(c / n) END, 0) + coalesce(CASE WHEN g > 0 THEN -(g / n) * log2(g / n) END, 0) + coalesce(CASE WHEN t > 0 THEN -(t / n) * log2(t / n) END, 0), 6) AS complexity FROM n"""
)
def gc_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "dna").select("seq_id", F.round(x.gc_content("seq"), 6).alias("gc"), F.round(x.base_entropy("seq"), 6).alias("complexity"))


@query(ctes("dna") + " SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(i AS INT), 4) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 2)) AS i FROM dna WHERE length(seq) >= 4)) GROUP BY 1")
def kmer_count(spark: SparkSession, sf: str) -> DataFrame:
    return seqsearch.kmers(view(spark, sf, "dna"), 4).groupBy("kmer").agg(F.count("*").alias("n"))


@query()
def fuzzy_infix_search(spark: SparkSession, sf: str) -> DataFrame:
    """Of each sequence a stretch with one letter changed, found again in it."""
    piece = F.substring("seq", 11, 40)
    needle = F.concat(F.substring(piece, 1, 15), F.translate(F.substring(piece, 16, 1), "ACGT", "CGTA"), F.substring(piece, 17, 24))
    pairs = view(spark, sf, "dna").select(F.col("seq_id").alias("qid"), F.col("seq_id").alias("rid"), needle.alias("needle"), F.col("seq").alias("hay"))
    return seqsearch.searched(pairs, O.clip_error_rate)


@query(
    ctes("dna")
    + """, q AS (SELECT item_id AS seq_id, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq FROM benchmark),
a AS (SELECT seq_id AS qid, i AS qp, substr(seq, CAST(i + 1 AS INT), 20) AS k FROM (SELECT seq_id, seq, unnest(range(length(seq) - 19)) AS i FROM q WHERE length(seq) >= 20)),
b AS (SELECT seq_id AS tid, i AS tp, substr(seq, CAST(i + 1 AS INT), 20) AS k FROM (SELECT seq_id, seq, unnest(range(length(seq) - 19)) AS i FROM dna WHERE length(seq) >= 20))
SELECT qid, tid, CAST(tp - qp AS INT) AS diagonal, count(*) AS seeds FROM a JOIN b USING (k) GROUP BY 1, 2, 3"""
)
def kmer_seed_search(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "benchmark").select(F.col("item_id").alias("seq_id"), F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))
    return seqsearch.seeded(items, view(spark, sf, "dna"), 20)


def _dna(spark: SparkSession, sf: str) -> DataFrame:
    """The sequences, made once and dealt evenly, for queries that read them more than once."""
    return settled(view(spark, sf, "dna").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq_id"))


def _chunks(dna: DataFrame) -> DataFrame:
    """Sequences in chunks of 64 letters, cut from pieces of 64 chunks, since a letter is reached by walking from the start."""

    def cut(rows: DataFrame, width: int, base: Column) -> DataFrame:
        n = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width).cast("int"))).alias("n")
        return rows.select("template_id", base.alias("base"), "seq", n).select("template_id", (F.col("base") * 64 + F.col("n")).alias("chunk_no"), F.substring(F.col("seq"), F.col("n") * width + 1, F.lit(width)).alias("seq"))

    pieces = cut(dna.where("seq <> ''").select(F.col("seq_id").cast("int").alias("template_id"), "seq"), 64 * 64, F.lit(0))
    return cut(pieces, 64, F.col("chunk_no"))


@query(
    ctes("dna")
    + """, p AS (SELECT seq_id, seq, length(seq) // 3 AS l, 2 * length(seq) // 3 AS r FROM dna WHERE seq <> ''),
f AS (SELECT seq_id, substr(seq, CAST(greatest(l - 1000, 0) + 1 AS INT), CAST(l - greatest(l - 1000, 0) AS INT)) || substr(seq, CAST(r + 1 AS INT), 1000) AS seq FROM p),
n AS (SELECT seq_id, length(seq) AS n, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c, length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t FROM f)
SELECT seq_id AS bp_id, CASE WHEN n > 0 THEN round((g + c) / n, 6) END AS gc,
  round(coalesce(CASE WHEN a > 0 THEN -(a / n) * log2(a / n) END, 0) + coalesce(CASE WHEN c > 0 THEN -(c / n) * log2(c / n) END, 0) + coalesce(CASE WHEN g > 0 THEN -(g / n) * log2(g / n) END, 0) + coalesce(CASE WHEN t > 0 THEN -(t / n) * log2(t / n) END, 0), 6) AS complexity FROM n"""
)
def sequence_features(spark: SparkSession, sf: str) -> DataFrame:
    """Content of the flanks of a breakpoint a third and two thirds into each sequence, read from the reference in pieces."""
    size = F.expr("length(seq)")
    dna = _dna(spark, sf)
    bps = dna.where("seq <> ''").select(F.col("seq_id").alias("bp_id"), F.col("seq_id").cast("int").alias("template_id"), F.col("seq_id").cast("int").alias("right_template"), F.floor(size / 3).alias("final_left"), F.floor(2 * size / 3).alias("final_right"))
    out = seqsearch.sequence_features(_chunks(dna), bps, 64)
    return out.select("bp_id", F.round("gc", 6).alias("gc"), F.round("complexity", 6).alias("complexity"))


@query(ctes("dna") + " SELECT seq_id AS rid, substr(seq, CAST(seq_id % 90 + 1 AS INT), 150) AS seq FROM dna")
def reference_region(spark: SparkSession, sf: str) -> DataFrame:
    dna = _dna(spark, sf)
    wanted = dna.select(F.col("seq_id").alias("rid"), F.col("seq_id").cast("int").alias("template_id"), (F.col("seq_id") % 90).alias("begin_pos"), (F.col("seq_id") % 90 + 150).alias("end_pos"))
    return seqsearch.regions(_chunks(dna), wanted, 64).select("rid", "seq")


@query(
    ctes("dna")
    + """, r AS (SELECT CAST(seq_id % 5 AS INT) AS template_id, seq_id % 50 AS b, seq FROM dna),
e AS (SELECT template_id, b + i AS pos, substr(seq, CAST(i + 1 AS INT), 1) AS base FROM (SELECT template_id, b, seq, unnest(range(length(seq))) AS i FROM r)),
c AS (SELECT template_id, pos, base, count(*) AS n FROM e GROUP BY ALL)
SELECT template_id, pos, arg_min(base, (-n, base)) AS base, CAST(sum(n) AS BIGINT) AS depth FROM c GROUP BY 1, 2"""
)
def consensus_pileup(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "dna").select((F.col("seq_id") % 5).cast("int").alias("template_id"), (F.col("seq_id") % 50).alias("begin_pos"), "seq")
    return seqsearch.pileup(rows)


@query(ctes("evidence") + " SELECT template_id, orientation, min_by(ev_id, (left_pos, ev_id)) AS first_ev, max_by(ev_id, (right_pos, ev_id)) AS last_ev FROM evidence GROUP BY 1, 2")
def representative_reads(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).groupBy("template_id", "orientation").agg(F.min_by("ev_id", F.struct("left_pos", "ev_id")).alias("first_ev"), F.max_by("ev_id", F.struct("right_pos", "ev_id")).alias("last_ev"))


@query(
    ctes("evidence")
    + " SELECT orientation, kind, count(*) AS n, CAST(grouping(orientation) AS INT) * 2 + CAST(grouping(kind) AS INT) AS level FROM evidence GROUP BY CUBE (orientation, kind)"
)
def evidence_cube(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).cube("orientation", "kind").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query(ctes("reads", "evidence") + " SELECT template_id, pos, last_value(depth IGNORE NULLS) OVER (PARTITION BY template_id ORDER BY pos, src, depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nearest, src FROM (SELECT template_id, CAST(begin_pos AS BIGINT) AS pos, read_id AS depth, 0 AS src FROM reads UNION ALL SELECT template_id, left_pos % 30000, NULL, 1 FROM evidence) QUALIFY src = 1")
def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The last read that begins at or before each point."""
    known = view(spark, sf, "reads").select("template_id", F.col("begin_pos").cast("long").alias("pos"), F.col("read_id").alias("nearest"))
    asked = _evidence(spark, sf).select("template_id", (F.col("left_pos") % 30000).alias("pos"), F.lit(1).alias("src"))
    return intervals.as_of(known, asked, "template_id", "pos", "nearest", coarse=4096).select("template_id", "pos", "nearest", "src")


@query()
def merge_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the merge command over three samples: ids by ranges, positions, bounds and genotypes as text."""
    rows = settled(_svs(spark, sf).withColumn("target_pos", F.lit(None).cast("long")))
    out = merging.records(rows, 3)
    return out.select("chrom", "begin_pos", "end_pos", "id", "alt", "filter", "info", F.array_join("genotypes", "\t").alias("genotypes"))


@query()
def clip_placed(spark: SparkSession, sf: str) -> DataFrame:
    """A stretch of each sequence that has room for it as a clip a quarter of the way in, found again 100 letters beyond: small deletions."""
    every = _dna(spark, sf)
    dna = every.where("length(seq) div 4 + 141 <= length(seq)").select(F.col("seq_id").cast("int").alias("template_id"), "seq", F.expr("length(seq) div 4").alias("at"))
    rows = dna.select(F.col("template_id").cast("long").alias("clip_id"), "template_id", F.lit(False).alias("is_left"), *[F.col("at").cast("long").alias(x) for x in ("lo", "hi", "mid")], F.lit(1).cast("long").alias("supp"), F.expr("substr(seq, cast(at + 102 as int), 40)").alias("seq"))
    known = spark.createDataFrame([], "template_id int, right_template int, orientation int, l1 long, l2 long, r1 long, r2 long")
    found = clips.clip_evidence(settled(rows), known, _chunks(every), 64, F.lit(300), O)
    return found.select("clip_id", "orientation", "left_pos", "right_pos", "placed_pos", "placed_size")


@query()
def clip_search(spark: SparkSession, sf: str) -> DataFrame:
    """The far sides of breakpoints at a clip's position, each an inversion: the clip turned round is found there."""
    every = _dna(spark, sf)
    dna = every.where("length(seq) >= 120").select(F.col("seq_id").cast("int").alias("template_id"), "seq", F.expr("length(seq) div 4").alias("at"))
    rows = dna.select(F.col("template_id").cast("long").alias("clip_id"), "template_id", F.lit(True).alias("is_left"), *[(3 * F.col("at")).cast("long").alias(x) for x in ("lo", "hi", "mid")], F.lit(1).cast("long").alias("supp"), x.revcomp(F.expr("substr(seq, cast(at + 1 as int), 30)")).alias("seq"))
    known = dna.select("template_id", F.col("template_id").alias("right_template"), F.lit(x.INVERTED).alias("orientation"), *[v.cast("long").alias(n) for n, v in (("l1", F.col("at") + 5), ("l2", F.col("at") + 15), ("r1", 3 * F.col("at") - 10), ("r2", 3 * F.col("at") - 5))])
    found = clips.partner_regions(settled(rows), known, O, False)
    return clips.best_hits(found, _chunks(every), 64, O.clip_error_rate).select("clip_id", "orientation", "begin_pos", "end_pos", "edits")


@query(ctes("dna") + " SELECT seq_id AS clip_id, true AS close, true AS found FROM dna WHERE length(seq) >= 60")
def clip_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty copies of the middle of each sequence, one letter in twenty changed; whether their consensus is the true stretch (but for one letter, as a run of one letter allows) and is found in the sequence."""
    dna = _dna(spark, sf).where("length(seq) >= 60").select(F.col("seq_id").alias("clip_id"), "seq")
    copies = dna.select("clip_id", F.expr("substr(seq, cast(length(seq) div 2 - 29 as int), 60)").alias("needle"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    noisy = F.expr("array_join(transform(split(needle, ''), (c, i) -> CASE WHEN pmod(xxhash64(clip_id, k, i), 20) = 0 THEN translate(c, 'ACGT', 'CGTA') ELSE c END), '')")
    made = settled(consensus.assembled(copies.select("clip_id", noisy.alias("seq")), "clip_id"))
    middle = F.expr("substr(hay, cast(length(hay) div 2 - 29 as int), 60)")
    hay = dna.withColumnRenamed("seq", "hay")
    tested = settled(hay.join(made, "clip_id", "left").select("clip_id", "seq", middle.alias("truth"), F.contains("hay", "seq").alias("exact")))
    # what stands there letter by letter needs no search with errors
    asked = tested.where("not exact").select("clip_id", F.col("seq").alias("needle")).join(hay, "clip_id")
    hits = seqsearch.searched(asked.select(F.col("clip_id").alias("qid"), F.col("clip_id").alias("rid"), "needle", "hay"), O.clip_error_rate)
    out = tested.join(hits.select(F.col("qid").alias("clip_id"), F.lit(True).alias("near")).distinct(), "clip_id", "left")
    return out.select("clip_id", (F.levenshtein("truth", F.coalesce("seq", F.lit(""))) <= 1).alias("close"), (F.coalesce("exact", F.lit(False)) | F.coalesce("near", F.lit(False))).alias("found"))


@query()
def local_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """A stretch of each sequence with a letter left out, aligned to the whole sequence."""
    needle = F.concat(F.substring("seq", 31, 20), F.substring("seq", 52, 20))
    pairs = view(spark, sf, "dna").where("length(seq) >= 100").select(F.col("seq_id").alias("qid"), F.col("seq_id").alias("rid"), needle.alias("needle"), F.col("seq").alias("hay"))
    return seqsearch.locally_aligned(pairs)


@query(
    ctes("dna")
    + """, q AS (SELECT seq_id + 1000000 AS qid, substr(seq, 11, 60) AS qs FROM dna WHERE length(seq) >= 100 AND seq_id % 10 = 0),
a AS (SELECT qid, i AS qp, substr(qs, CAST(i + 1 AS INT), 20) AS k FROM (SELECT qid, qs, unnest(range(length(qs) - 19)) AS i FROM q)),
b AS (SELECT seq_id AS tid, i AS tp, substr(seq, CAST(i + 1 AS INT), 20) AS k FROM (SELECT seq_id, seq, unnest(range(length(seq) - 19)) AS i FROM dna WHERE length(seq) >= 20)),
s AS (SELECT qid, tid, CAST(tp - qp AS INT) AS diagonal, count(*) AS seeds FROM a JOIN b USING (k) GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT qid, tid, diagonal, seeds, CAST(diagonal AS BIGINT) AS hit_begin, CAST(diagonal + length(qs) AS BIGINT) AS hit_end,
  CAST(len(list_filter(range(1, length(qs) + 1), lambda i: substr(qs, CAST(i AS INT), 1) <> substr(seq, CAST(i + diagonal AS INT), 1))) AS INT) AS edits
FROM s JOIN q USING (qid) JOIN dna ON seq_id = tid WHERE diagonal >= 0 AND diagonal + length(qs) <= length(seq)"""
)
def seed_extension(spark: SparkSession, sf: str) -> DataFrame:
    dna = settled(view(spark, sf, "dna"))
    asked = dna.where("length(seq) >= 100 and seq_id % 10 = 0").select((F.col("seq_id") + 1_000_000).alias("seq_id"), F.substring("seq", 11, 60).alias("seq"))
    return seqsearch.extended(asked, dna, 20, 5)
