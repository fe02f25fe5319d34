"""Alignment-shaped views of ordinary tables, in Spark SQL and in DuckDB SQL.

Orders stand for alignments, parts for annotation records, nations for read
groups. All values are whole numbers or text, by rule, so that both engines
see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REFERENCES = 6
LENGTH = 100_000

_FLAG = (
    "(CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 19 = 0 THEN 4 ELSE 0 END"
    " + CASE WHEN o_orderkey % 11 = 0 THEN 256 ELSE 0 END"
    " + CASE WHEN o_orderkey % 13 = 0 THEN 2048 ELSE 0 END"
    " + CASE WHEN o_orderkey % 17 = 0 THEN 1024 ELSE 0 END"
    " + CASE WHEN o_orderkey % 29 = 0 THEN 512 ELSE 0 END)"
)
_COLUMNS = f"""o_orderkey AS ordinal, concat('q', o_custkey) AS qname,
CAST(CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE o_custkey % 5 END AS INT) AS ref_id,
CAST(CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE (o_orderkey * 7919) % {LENGTH} END AS BIGINT) AS pos,
CAST({_FLAG} AS INT) AS flag,
CAST(CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_custkey % 5 END AS INT) AS next_ref_id,
CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat('rg', o_custkey % 30) END AS rg,
concat('chr', CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE o_custkey % 5 END) AS chrom,
CAST(100 + o_orderkey % 57 AS BIGINT) AS n_bytes"""

#: Operations by rule: matches; with a skip; with a deletion; an insertion alone; clipped, with an insertion.
_Q = "50 + o_orderkey % 100"
_CIGAR = (
    (0, ((_Q, 0),)),
    (1, ((_Q, 0), ("200 + o_orderkey % 900", 3), ("40", 0))),
    (2, ((_Q, 0), ("20", 2), ("60", 0))),
    (3, (("30", 1),)),
    (4, (("5", 4), (_Q, 0), ("3", 1), ("10", 7))),
)

_RECORD = f"""p_partkey AS ordinal, concat('chr', p_partkey % 5) AS chrom,
CAST((p_partkey * 977) % {LENGTH - 3000} AS BIGINT) AS start,
CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '.' ELSE concat('gene', p_partkey % 200) END AS name,
CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand"""
#: Blocks of a record: 0 (none told) to 3; each so long, and so far from the next one's begin.
_N, _LEN, _STEP = "p_size % 4", "(100 + p_size)", "(300 + 3 * p_size)"


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = " ".join(
        f"WHEN {i} THEN array({', '.join(f'named_struct({chr(39)}len{chr(39)}, CAST({n} AS BIGINT), {chr(39)}op{chr(39)}, {op})' for n, op in parts)})" for i, parts in _CIGAR
    )
    columns = [c for c in _split(_COLUMNS)]
    return _tables(spark, sf_dir, "orders").selectExpr(*columns, f"CASE o_orderkey % 5 {ops} END AS cigar")


def _split(columns: str) -> list[str]:
    """Select items, one for each line but for those that go on."""
    items, depth, item = [], 0, ""
    for c in columns.replace("\n", " "):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            items.append(item.strip())
            item = ""
        else:
            item += c
    return [*items, item.strip()]


def references(spark: SparkSession) -> DataFrame:
    return spark.range(REFERENCES).selectExpr("CAST(id AS INT) AS ref_id", "concat('chr', id) AS name", f"CAST({LENGTH} AS BIGINT) AS length")


def read_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, "nation").selectExpr(
        "concat('rg', n_nationkey) AS id",
        "CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE concat('sample', n_nationkey % 6) END AS sample",
        "concat('lib', n_nationkey % 3) AS library",
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tables(spark, sf_dir, "part").selectExpr(*_split(_RECORD), f"{_N} AS n", f"CAST({_LEN} AS BIGINT) AS len", f"CAST({_STEP} AS BIGINT) AS step", "p_partkey", "p_size")
    return rows.selectExpr(
        "ordinal", "chrom", "start", "start + greatest(n - 1, 0) * step + len AS end", "name", "strand",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE start + 40 END AS thick_start",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE start + greatest(n - 1, 0) * step + 60 + p_partkey % 30 - CASE WHEN n = 0 AND p_size > 40 THEN 70 ELSE 0 END END AS thick_end",
        "CASE WHEN n > 0 THEN transform(sequence(0, n - 1), i -> named_struct('start', start + i * step, 'end', start + i * step + len)) END AS blocks",
        "map('field13', concat('x', ordinal)) AS extras",
    )


# ---------------------------------------------------------------- the same in DuckDB


def _duck_cigar() -> str:
    return " ".join(f"WHEN {i} THEN [{', '.join(f'{{{chr(39)}len{chr(39)}: CAST({n} AS BIGINT), {chr(39)}op{chr(39)}: {op}}}' for n, op in parts)}]" for i, parts in _CIGAR)


def _duck_blocks(span: bool) -> str:
    """Blocks of the five rules, written out."""
    q = f"({_Q})"
    skip = "(200 + o_orderkey % 900)"
    one = lambda a, b: f"{{'start': pos + {a}, 'end': pos + {b}}}"
    if span:
        return f"CASE o_orderkey % 5 WHEN 0 THEN [{one(0, q)}] WHEN 1 THEN [{one(0, f'{q} + {skip} + 40')}] WHEN 2 THEN [{one(0, f'{q} + 80')}] WHEN 3 THEN [{one(0, 1)}] ELSE [{one(0, f'{q} + 10')}] END"
    return (
        f"CASE o_orderkey % 5 WHEN 0 THEN [{one(0, q)}] WHEN 1 THEN [{one(0, q)}, {one(f'{q} + {skip}', f'{q} + {skip} + 40')}]"
        f" WHEN 2 THEN [{one(0, q)}, {one(f'{q} + 20', f'{q} + 80')}] WHEN 3 THEN [{one(0, 1)}] ELSE [{one(0, f'{q} + 10')}] END"
    )


def duck(span: bool = False) -> str:
    """WITH clause items: aln, refs, rgs, ann."""
    return f"""aln0 AS (SELECT {_COLUMNS}, o_orderkey FROM orders),
aln AS (SELECT * EXCLUDE (o_orderkey), CASE o_orderkey % 5 {_duck_cigar()} END AS cigar, {_duck_blocks(span)} AS blocks FROM aln0),
refs AS (SELECT CAST(i AS INT) AS ref_id, concat('chr', i) AS name, CAST({LENGTH} AS BIGINT) AS length FROM range({REFERENCES}) t(i)),
rgs AS (
  SELECT concat('rg', n_nationkey) AS id, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE concat('sample', n_nationkey % 6) END AS sample,
    concat('lib', n_nationkey % 3) AS library FROM nation),
ann0 AS (SELECT {_RECORD}, {_N} AS n, CAST({_LEN} AS BIGINT) AS len, CAST({_STEP} AS BIGINT) AS step, p_partkey, p_size FROM part),
ann AS (
  SELECT ordinal, chrom, start, start + greatest(n - 1, 0) * step + len AS "end", name, strand, n,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE start + 40 END AS thick_start,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE start + greatest(n - 1, 0) * step + 60 + p_partkey % 30 - CASE WHEN n = 0 AND p_size > 40 THEN 70 ELSE 0 END END AS thick_end,
    list_transform(range(0, greatest(n, 1)), lambda i: {{'start': start + i * step, 'end': start + i * step + len}}) AS exons
  FROM ann0)"""
