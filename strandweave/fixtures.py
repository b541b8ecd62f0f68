"""Genomic views over the star-schema tables: the same expressions in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MINUTES = {
    "spark": "timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)",
    "duckdb": "date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts)",
}

_READS = """SELECT event_id AS read_id,
  CAST(user_id % 4 AS INT) AS template_id,
  CAST(@MIN@ AS INT) AS begin_pos,
  CAST(1 + floor(value) AS INT) AS ref_len,
  CAST(1 + floor(value) AS INT) + CAST(@MIN@ AS INT) AS end_pos, event_id % 2 = 1 AS is_reverse,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS map_q,
  CAST(1 + 2 * CAST(event_id % 5 <> 0 AS INT) + 16 * (event_id % 2) + 32 * (CAST(event_id % 3 = 0 AS INT)) + 64
    + CAST(CASE WHEN event_id % 37 = 0 THEN 4 WHEN event_id % 41 = 0 THEN 256 WHEN event_id % 43 = 0 THEN 512
      WHEN event_id % 29 = 0 THEN 2048 ELSE 0 END AS INT) AS INT) AS flag
FROM events"""

_EVIDENCE = """SELECT o_orderkey AS ev_id,
  CAST(o_custkey % 3 AS INT) AS template_id,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 4 WHEN o_custkey % 4 = 1 THEN 2 WHEN o_custkey % 4 = 2 THEN 3 ELSE 0 END AS INT) AS orientation,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS INT) AS kind,
  ((o_custkey * 7919) % 1000) * 400 + (o_orderkey % 40) AS left_pos,
  ((o_custkey * 7919) % 1000) * 400 + 60 + (o_custkey % 20) * 97 + (o_orderkey % 30) AS right_pos
FROM orders"""

_MATES = """SELECT ev_id AS qname, 1 AS mate_no, template_id, left_pos AS begin_pos, left_pos + 100 AS end_pos,
  CASE WHEN orientation = 2 THEN true WHEN orientation = 3 THEN ev_id % 2 = 0 ELSE false END AS is_reverse,
  CAST(right_pos + 100 - left_pos AS BIGINT) AS tlen, CAST(ev_id % 61 AS INT) AS map_q
FROM evidence
UNION ALL
SELECT ev_id, 2, template_id, right_pos, right_pos + 100,
  CASE WHEN orientation = 2 THEN false WHEN orientation = 3 THEN ev_id % 2 = 0 ELSE true END,
  CAST(left_pos - right_pos - 100 AS BIGINT), CAST((ev_id * 7) % 61 AS INT)
FROM evidence"""

_SEGMENTS = """SELECT ev_id AS read_id, 1 AS seg_no, template_id, left_pos - 60 AS ref_begin, left_pos AS ref_end, false AS is_reverse,
  CAST(0 AS BIGINT) AS q_begin, CAST(60 AS BIGINT) AS q_end, CAST(ev_id % 61 AS INT) AS map_q
FROM evidence
UNION ALL
SELECT ev_id, 2, CAST(CASE WHEN orientation = 4 THEN (template_id + 1) % 3 ELSE template_id END AS INT),
  CASE WHEN orientation = 2 THEN left_pos - 400 ELSE right_pos END,
  CASE WHEN orientation = 2 THEN left_pos - 360 ELSE right_pos + 40 END, orientation = 3,
  CAST(60 + ev_id % 90 - 30 AS BIGINT), CAST(100 + ev_id % 90 - 30 AS BIGINT), CAST((ev_id * 7) % 61 AS INT)
FROM evidence"""

_CIGARS = """SELECT ev_id AS read_id, template_id, left_pos AS begin_pos,
  concat(CASE WHEN ev_id % 3 = 0 THEN concat(CAST(5 + ev_id % 30 AS STRING), 'S') ELSE '' END,
  CAST(30 + ev_id % 50 AS STRING), 'M', CAST(1 + ev_id % 90 AS STRING),
  CASE WHEN ev_id % 4 = 0 THEN 'I' WHEN ev_id % 4 = 1 THEN 'N' ELSE 'D' END, CAST(20 + ev_id % 17 AS STRING), 'M',
  CASE WHEN ev_id % 5 = 0 THEN concat(CAST(5 + ev_id % 40 AS STRING), 'S') WHEN ev_id % 5 = 1 THEN concat(CAST(5 + ev_id % 40 AS STRING), 'H') ELSE '' END) AS cigar
FROM evidence"""

# Spark takes out runs of other letters at a time, which is the same
_DNA = """SELECT doc_id AS seq_id, upper(regexp_replace(lower(text), '[^acgt]@P@', ''@G@)) AS seq FROM documents"""

_SVTEXT = """SELECT ev_id, concat('chr', CAST(template_id + 1 AS STRING)) AS chrom, left_pos + 1 AS pos,
  CASE WHEN ev_id % 10 = 0 THEN 'FILTERED' ELSE 'PASS' END AS filter,
  concat('SE=', CAST(ev_id % 7 AS STRING), ';PE=', CAST(ev_id % 5 AS STRING), ';CE=', CAST(ev_id % 3 AS STRING),
  ';RD=', CAST(ev_id % 40 AS STRING), '.500000;SC=', CAST(ev_id % 100 AS STRING), '.000000',
  CASE WHEN ev_id % 6 = 0 THEN ';IMPRECISE' ELSE '' END, ';SVLEN=', CASE WHEN orientation = 0 THEN '-' ELSE '' END,
  CAST(right_pos - left_pos + 1 AS STRING), ';SVTYPE=', CASE orientation WHEN 0 THEN 'DEL' WHEN 2 THEN 'DUP' WHEN 3 THEN 'INV' ELSE 'BND' END) AS info,
  CAST(ev_id % 3 AS INT) AS dataset_idx
FROM evidence"""

# split reads of 60 and 40 bases, discordant pairs of 100, and proper pairs, as a coordinate file would hold them
_ALIGNED = """SELECT ev_id * 2 AS ordinal, template_id AS rid, left_pos - 60 AS begin_pos, 65 AS flag, template_id AS next_rid, right_pos AS next_pos, CAST(0 AS BIGINT) AS tlen, '60M40S' AS cigar, true AS tagged, ev_id
FROM evidence WHERE kind = 0 AND orientation <> 3
UNION ALL
SELECT ev_id * 2 + 1, CAST(CASE WHEN orientation = 4 THEN (template_id + 1) % 3 ELSE template_id END AS INT), CASE WHEN orientation = 2 THEN left_pos - 400 ELSE right_pos END, 65 + 2048, template_id, left_pos, 0, '60S40M', true, ev_id
FROM evidence WHERE kind = 0 AND orientation <> 3
UNION ALL
SELECT ev_id * 2, template_id, left_pos, 65 + CASE WHEN orientation = 2 THEN 16 WHEN orientation = 3 AND ev_id % 2 = 0 THEN 48 WHEN orientation = 3 THEN 0 ELSE 32 END, template_id, right_pos, right_pos + 100 - left_pos, '100M', false, ev_id
FROM evidence WHERE kind = 1
UNION ALL
SELECT ev_id * 2 + 1, template_id, right_pos, 129 + CASE WHEN orientation = 2 THEN 32 WHEN orientation = 3 AND ev_id % 2 = 0 THEN 48 WHEN orientation = 3 THEN 0 ELSE 16 END, template_id, left_pos, left_pos - right_pos - 100, '100M', false, ev_id
FROM evidence WHERE kind = 1
UNION ALL
SELECT ev_id * 2, template_id, left_pos, 99, template_id, left_pos + 200, 300 + ev_id % 40, '100M', false, ev_id FROM evidence WHERE kind = 2"""

#: View, the tables or views it reads, and its text.
VIEWS = {
    "reads": ("events", _READS),
    "evidence": ("orders", _EVIDENCE),
    "mates": ("evidence", _MATES),
    "segments": ("evidence", _SEGMENTS),
    "cigars": ("evidence", _CIGARS),
    "dna": ("documents", _DNA),
    "svtext": ("evidence", _SVTEXT),
    "aligned": ("evidence", _ALIGNED),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, or a table if there is no such view."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, text = VIEWS[name]
    text = text.replace("@MIN@", _MINUTES["spark"]).replace("@G@", "").replace("@P@", "+").replace(f"FROM {source}", "FROM {src}")
    return spark.sql(text, src=view(spark, sf_dir, source))


def ctes(*names: str) -> str:
    """The views as the start of a WITH clause in DuckDB, dependencies first."""
    order: list[str] = []
    for name in names:
        source = VIEWS[name][0]
        order += [n for n in ([source] if source in VIEWS else []) + [name] if n not in order]
    parts = (f"{n} AS ({VIEWS[n][1].replace('@MIN@', _MINUTES['duckdb']).replace('@P@', '').replace('@G@', chr(44) + chr(39) + 'g' + chr(39))})" for n in order)
    return "WITH " + ",\n".join(parts)
