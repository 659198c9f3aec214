"""Where queries register, with the SQL that gives the same rows; and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_sub(x: str, pattern: str, to: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', '{to}', 'g')"


def sql_strip(x: str) -> str:
    return sql_sub(x, r"^\s+|\s+$", "")


def sql_squeeze(x: str) -> str:
    return sql_strip(sql_sub(x, r"\s+", " "))


def sql_canonical(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = sql_sub(x, r"\{\s*\$\s*[\d,.]+\s*\}", "[AMOUNT]")
    x = sql_sub(x, r"(?i)X{2}/X{2}/(?:X{2,8}|\d{2,4}|year>)", "[DATE]")
    x = sql_sub(x, r"\bX{2,}\b", "[REDACTED]")
    return sql_strip(f"regexp_replace({sql_sub(x, '[ ' + chr(9) + ']+', ' ')}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_matching(x: str) -> str:
    return sql_squeeze(sql_sub(sql_sub(f"lower({x})", r"[0-9]+", " [number] "), r"[^a-z\[\] ]+", " "))


def sql_residue(x: str) -> str:
    return sql_squeeze(sql_sub(sql_sub(sql_matching(x), r"\[placeholder\]", " "), r"\[number\]", " "))


#: Documents with their canonical text and the residue of it.
SQL_VIEWS = f"""views AS (
  SELECT doc_id, lang, source, text, canonical, {sql_residue("canonical")} AS residue
  FROM (SELECT *, {sql_canonical("text")} AS canonical FROM documents)
), families AS (
  SELECT *, sha256(text) AS raw_sha256, sha256(canonical) AS canonical_sha256,
    length(residue) >= 40 AND len(string_split(residue, ' ')) >= 8 AS eligible,
    CASE WHEN length(residue) >= 40 AND len(string_split(residue, ' ')) >= 8 THEN sha256(residue) ELSE 'ineligible:' || CAST(doc_id AS VARCHAR) END AS family_signature
  FROM views
)"""


def sql_count(x: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"CAST(len(regexp_extract_all({x}, '{quoted}')) AS BIGINT)"


def sql_key(seed: int, namespace: str, x: str) -> str:
    """sha256 of the JSON list [seed, namespace, id]."""
    return f"""sha256('[{seed},"{namespace}","' || CAST({x} AS VARCHAR) || '"]')"""
