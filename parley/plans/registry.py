"""Registry of checked queries: a Spark plan plus (optionally) its SQL twin.

Each query is ``(spark, sf_dir) -> DataFrame`` over the given tables.  The
SQL twin is written independently in plain SQL for DuckDB and must produce
the same column names; nested lists are rendered with ``to_json`` and floats
rounded to 6 places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


# Shared SQL fragments for the twins (DuckDB dialect).
SQL_CLEAN = "lower(regexp_replace(regexp_replace(coalesce({x}, ''), '\\p{{Nd}}', 'X', 'g'), '[^\\p{{L}} ]', '', 'g'))"
SQL_TOKENS = "list_filter(regexp_split_to_array(" + SQL_CLEAN + ", ' +'), lambda t: t <> '')"

SQL_CONV_TURNS = """
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS BIGINT) AS turn,
         CASE role WHEN 'assistant' THEN 'caller' ELSE 'victim' END AS channel, text
  FROM conversations WHERE role IN ('assistant', 'user')
"""

SQL_DOC_TURNS = """
  SELECT CAST(d.doc_id AS VARCHAR) AS conv_id, CAST(u.line_no - 1 AS BIGINT) AS turn,
         CASE WHEN (u.line_no - 1) % 2 = 0 THEN 'caller' ELSE 'victim' END AS channel,
         u.line AS text, CAST(l.quality AS INTEGER) AS label, d.lang
  FROM documents d JOIN labels l USING (doc_id),
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS line_no) u
"""


def sql_pairs(turns_sql: str, value_sql: str, carry: str = "") -> str:
    """Positional pairing twin: row_number per channel, inner join on (conv_id, seq)."""
    carry_sel = f", {carry}" if carry else ""
    return f"""
  s AS (SELECT conv_id, channel, {value_sql} AS v{carry_sel},
               CAST(row_number() OVER (PARTITION BY conv_id, channel ORDER BY turn NULLS LAST, {value_sql} NULLS LAST) - 1 AS INTEGER) AS seq
        FROM ({turns_sql}) t),
  p AS (SELECT c.conv_id, c.seq, c.v AS caller, v.v AS victim{', c.' + carry if carry else ''}
        FROM s c JOIN s v ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.seq = v.seq
        WHERE c.channel = 'caller' AND v.channel = 'victim')
"""
