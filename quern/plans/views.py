"""Views of the driver's tables in the shapes of the data model. Their SQL is the same for Spark and
for the oracle; text has braces and backslashes by code, as both dialects read them alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS = "SELECT doc_id AS id, text, source AS subsource FROM documents"
EVALS = "SELECT concat('benchmark:', cast(item_id AS string)) AS eid, item_id AS ordinal, text FROM benchmark"

SOLUTIONS = """
SELECT p_partkey AS id, p_name AS problem, p_type AS source, CASE cast(p_partkey % 7 AS int)
    WHEN 0 THEN concat('it is ', p_name)
    WHEN 1 THEN concat('so ', chr(92), 'boxed', chr(123), cast(p_size AS string), chr(125))
    WHEN 2 THEN concat('a ', chr(92), 'boxed', chr(123), cast(p_size AS string), chr(125), ' b ', chr(92), 'boxed', chr(123), ' $', cast(p_size AS string), '$ ', chr(125))
    WHEN 3 THEN concat('a ', chr(92), 'boxed', chr(123), cast(p_size AS string), chr(125), ' b ', chr(92), 'boxed', chr(123), cast(p_size + 1 AS string), chr(125))
    WHEN 4 THEN concat(chr(92), 'boxed', chr(123), ' ', chr(125))
    WHEN 5 THEN concat(chr(92), 'boxed', chr(123), repeat('x', cast(p_size + 80 AS int)), chr(125))
    ELSE concat('then ', chr(92), 'boxed  ', chr(123), chr(92), 'left', cast(p_size AS string), chr(125), ' and ', chr(92), 'boxed 2') END AS solution
FROM part"""

ROLLOUTS = """
SELECT sample, idx, count(*) OVER (PARTITION BY sample) AS k, cast(t AS string) AS truth,
  CASE WHEN sample % 4 = 3 THEN 'math500' WHEN sample % 8 = 5 THEN 'other' ELSE 'openai/gsm8k' END AS data_source,
  CASE WHEN sample % 4 = 3 AND form < 3 THEN concat('so ', chr(92), 'boxed', chr(123), cast(a AS string), chr(125))
       WHEN sample % 4 = 3 AND form = 3 THEN concat('answer is ', cast(a AS string))
       WHEN sample % 4 = 3 THEN concat(chr(92), 'boxed  ', chr(123), cast(a AS string), chr(125), ' then ', chr(92), 'boxed 2')
       WHEN form = 0 THEN concat('reason', chr(10), '#### ', cast(a AS string))
       WHEN form = 1 THEN concat('the answer is ', cast(a AS string), '.')
       WHEN form = 2 THEN concat('I got ', cast(a AS string), ' apples, done')
       WHEN form = 3 THEN concat('#### 1 then #### ', cast(a AS string), ',.')
       ELSE 'no digits here' END AS text
FROM (SELECT l_orderkey AS sample, l_orderkey % 3 AS t, cast(floor(l_quantity) AS bigint) % 3 AS a, (l_linenumber + l_orderkey) % 5 AS form,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS idx
      FROM lineitem) base"""

PUZZLES = """
SELECT p_partkey AS id, a, b, c, (a + b) * c AS target, CASE cast(p_partkey % 5 AS int)
    WHEN 0 THEN concat('so ', chr(92), 'boxed', chr(123), '(', cast(a AS string), ' + ', cast(b AS string), ') ', chr(92), 'times ', cast(c AS string), chr(125))
    WHEN 1 THEN concat('so ', chr(92), 'boxed', chr(123), cast(a AS string), ' + ', cast(b AS string), ' + ', cast(c AS string), chr(125))
    WHEN 2 THEN concat(chr(92), 'boxed', chr(123), cast(a AS string), '*', cast(a AS string), '*', cast(a AS string), chr(125))
    WHEN 3 THEN concat(chr(92), 'boxed', chr(123), cast((a + b) * c AS string), ' = (', cast(a AS string), '+', cast(b AS string), ')*', cast(c AS string), chr(125))
    ELSE concat('(', cast(a AS string), '+', cast(b AS string), ')*', cast(c AS string)) END AS text
FROM (SELECT p_partkey, p_partkey % 9 + 1 AS a, cast(p_size AS bigint) AS b, p_partkey % 7 + 1 AS c FROM part) base"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: read(spark, sf_dir, table)})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CORPUS, "documents")


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVALS, "benchmark")


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SOLUTIONS, "part")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ROLLOUTS, "lineitem")


def puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PUZZLES, "part")
