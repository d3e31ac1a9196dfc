"""Listings, preferences and replies derived from the given tables.

Each derivation is one SQL text that both engines run: Spark on DataFrames, the oracle on its views. Table
names are ``{placeholders}``. Sizes follow the tables: a listing per order, a preference per customer, a
reply per preference that has candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTINGS = """
SELECT o.o_orderkey AS row_index,
  CASE WHEN o.o_orderkey % 97 = 0 THEN concat(' ', chr(160), chr(9))
       WHEN o.o_orderkey % 89 = 0 THEN concat(chr(9), chr(160), 'Café Ñandú ', CAST(o.o_orderkey % 300 AS STRING), chr(160))
       ELSE concat(' Place ', CAST(o.o_orderkey % 300 AS STRING), ' ') END AS name,
  concat(CAST(o.o_orderkey % 90 AS STRING), ' Main Road, ', n.n_name,
    CASE CAST(o.o_custkey % 8 AS INT) WHEN 0 THEN ', New Delhi' WHEN 1 THEN ', Mumbai' WHEN 2 THEN ', Gurugram'
         WHEN 3 THEN '' ELSE ', Bengaluru' END) AS address,
  CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE n.n_name END AS location,
  CASE WHEN o.o_orderkey % 41 = 0 THEN NULL
       ELSE concat(c.c_mktsegment, ', ', CASE o.o_orderstatus WHEN 'F' THEN 'North Indian' WHEN 'O' THEN 'Tex-Mex'
                                              ELSE 'Italian' END) END AS cuisines,
  CASE WHEN o.o_orderkey % 11 = 0 THEN 'NEW' WHEN o.o_orderkey % 13 = 0 THEN '-' WHEN o.o_orderkey % 17 = 0 THEN NULL
       WHEN o.o_orderkey % 83 = 0 THEN concat(CAST(10 + o.o_custkey % 9 AS STRING), '.5 of 20')
       WHEN o.o_orderkey % 19 = 0 THEN concat(CAST(6 + o.o_custkey % 4 AS STRING), '/10')
       ELSE concat(CAST(1 + o.o_orderkey % 4 AS STRING), '.', CAST(o.o_custkey % 10 AS STRING), '/5') END AS rate,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL
       WHEN o.o_orderkey % 79 = 0 THEN CASE CAST(o.o_custkey % 4 AS INT) WHEN 0 THEN '0' WHEN 1 THEN '100,001' WHEN 2 THEN '450.50'
         ELSE '100,000' END
       WHEN o.o_custkey % 3 = 0 THEN concat('1,', CAST(100 + o.o_orderkey % 900 AS STRING))
       ELSE CAST(100 + o.o_orderkey % 900 AS STRING) END AS `approx_cost(for two people)`
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

PREFERENCES = """
SELECT c.c_custkey AS pref_id,
  CASE WHEN c.c_custkey % 29 = 0 THEN '   '
       WHEN c.c_custkey % 31 = 0 THEN NULL
       ELSE CASE CAST(c.c_custkey % 8 AS INT)
         WHEN 0 THEN ' bengaluru ' WHEN 1 THEN 'New Delhi' WHEN 2 THEN lower(n.n_name) WHEN 3 THEN 'GURUGRAM'
         WHEN 4 THEN concat('nation_', CAST(c.c_custkey % 7 AS STRING)) WHEN 5 THEN 'bombay'
         WHEN 6 THEN concat('atlantis ', CAST(c.c_custkey % 5 AS STRING)) ELSE 'N' END END AS location,
  CASE WHEN c.c_custkey % 37 = 0 THEN 'luxury' WHEN c.c_acctbal < 2000 THEN 'low' WHEN c.c_acctbal < 6000 THEN 'medium'
       ELSE 'high' END AS budget,
  CASE WHEN c.c_custkey % 43 = 0 THEN ' '
       ELSE CASE CAST(c.c_custkey % 7 AS INT)
         WHEN 0 THEN 'Any' WHEN 1 THEN ' * ' WHEN 2 THEN lower(c.c_mktsegment) WHEN 3 THEN 'Indian'
         WHEN 4 THEN 'e, tex' WHEN 5 THEN 'sushi' ELSE 'MEX' END END AS cuisine,
  CASE WHEN c.c_custkey % 47 = 0 THEN CAST(6 AS DOUBLE) WHEN c.c_custkey % 53 = 0 THEN CAST(-1 AS DOUBLE)
       WHEN c.c_custkey % 59 = 0 THEN NULL ELSE CAST(c.c_custkey % 11 AS DOUBLE) / 2 END AS min_rating,
  CASE CAST(c.c_custkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '   '
       ELSE repeat(concat(' ', c.c_name, ' says "quiet"'), CAST(1 + c.c_custkey % 40 AS INT)) END AS additional_preferences
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# Addresses that name suppliers, nations and regions, and the dictionary of those names. A third names a supplier.
ADDRESSES = """
SELECT o.o_orderkey AS row_index,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 7 = 0 THEN concat('Plot ', CAST(o.o_orderkey AS STRING))
       WHEN o.o_orderkey % 3 = 0 THEN concat('Unit of ', coalesce(lower(s.s_name), 'nobody'), '5 House, ', n.n_name)
       WHEN o.o_orderkey % 5 = 0 THEN concat(CAST(o.o_orderkey % 90 AS STRING), ' Main Road', r.r_name)
       ELSE concat('No. ', CAST(o.o_orderkey % 40 AS STRING), ', ', r.r_name, ' Street, ', lower(n.n_name)) END AS address
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey LEFT JOIN {supplier} s ON s.s_suppkey * 15 = o.o_custkey - o.o_custkey % 15
"""

PLACES = """
SELECT n_name AS name, concat('nation ', CAST(n_nationkey AS STRING)) AS place, n_nationkey + 100 AS position FROM {nation}
UNION ALL SELECT r_name, concat('region ', CAST(r_regionkey AS STRING)), r_regionkey FROM {region}
UNION ALL SELECT s_name, concat('seller ', CAST(s_suppkey AS STRING)), s_suppkey + 1000 FROM {supplier}
UNION ALL SELECT upper(n_name), 'twice', n_nationkey + 200 FROM {nation}
"""

PLACE_TABLES = ["orders", "customer", "nation", "region", "supplier"]

# Replies built from the first four candidates; the remainder of pref_id picks the kind of reply.
RESPONSES = """
SELECT pref_id,
  CASE WHEN kind < 16 OR kind > 20 THEN
    CASE kind
    WHEN 0 THEN concat('{{"summary":" Top picks ","recommendations":[{{"id":"', b, '","rank":2,"explanation":"Second"}},{{"id":"', a, '","rank":1,"explanation":" First "}}]}}')
    WHEN 1 THEN concat('```json ', '{{"summary":"Fenced","recommendations":[{{"id":"', a, '","rank":1}}]}}', ' ```')
    WHEN 2 THEN concat('{{"recommendations":[{{"id":"ghost-', a, '","rank":1}},{{"id":" ', a, ' ","rank":2,"explanation":"Kept"}}]}}')
    WHEN 3 THEN '{{"recommendations":[{{"id":"ghost-1","rank":1}},{{"id":"ghost-2"}}]}}'
    WHEN 4 THEN concat('{{"recommendations":[{{"id":"', a, '","rank":10}},{{"id":"', b, '","rank":5}}]}}')
    WHEN 5 THEN concat('{{"summary":"","recommendations":[{{"id":"', a, '","rank":1,"name":"Fake","rating":1.0,"cost_for_two":1}}]}}')
    WHEN 6 THEN '{{ malformed json }}'
    WHEN 7 THEN '{{"summary":"no list"}}'
    WHEN 8 THEN concat('{{"recommendations":{{"id":"', a, '"}}}}')
    WHEN 9 THEN concat('{{"summary":7,"recommendations":[3,null,"x",["id"],{{"id":null}},{{"rank":1}},{{"id":42,"rank":1}},{{"id":"', a, '"}}]}}')
    WHEN 10 THEN concat('{{"recommendations":[{{"id":"', a, '"}},{{"id":"', b, '","rank":"2"}},{{"id":"', c, '","rank":"2.5"}},{{"id":"', d, '","rank":2.7}}]}}')
    WHEN 11 THEN concat('{{"recommendations":[{{"id":"', a, '","rank":0}}]}}')
    WHEN 12 THEN concat('{{"summary":[1],"recommendations":[{{"id":"', a, '","rank":true,"explanation":"  "}},{{"id":"', b, '","rank":2,"explanation":5}}]}}')
    WHEN 13 THEN concat('{{"recommendations":[{{"id":"', a, '","rank":3,"explanation":"again"}},{{"id":"', a, '","rank":3,"explanation":"once"}}]}}')
    WHEN 14 THEN concat('{{"recommendations":[{{"id":"', a, '","rank":1}}]}} Enjoy!')
    WHEN 21 THEN concat('{{"summary":"NaN, -Infinity","recommendations":[{{"id":"', a, '","rank":NaN}},{{"id":NaN}},{{"id":"', b, '","rank":2,"x":[-Infinity,NaN]}},{{"id":-Infinity}}]}}')
    WHEN 22 THEN concat('{{"recommendations":[{{"id":["', a, '",1,null,[true,{{"z":2,"b":"x"}}]]}},{{"id":{{"id":"', b, '"}}}},{{"id":[]}},{{"id":"', a, '"}}]}}')
    WHEN 23 THEN concat('{{"summary":NaN,"recommendations":', CASE WHEN pref_id % 2 = 0 THEN 'Infinity' ELSE '[NaN]' END, '}}')
    WHEN 24 THEN concat('{{"recommendations":[{{"id":"', a, '","rank":-NaN}}]}}')
    ELSE concat('[{{"id":"', a, '","rank":1}}]') END
  END AS raw_response,
  CASE kind WHEN 16 THEN 'LLMTimeoutError' WHEN 17 THEN 'LLMRateLimitError' WHEN 18 THEN 'LLMConfigurationError'
    WHEN 19 THEN 'LLMAPIError' WHEN 20 THEN 'SocketClosed' END AS error_type,
  CASE WHEN kind = 18 THEN 'no key configured' WHEN kind = 20 THEN 'connection reset' END AS error_message,
  CAST(pref_id AS DOUBLE) * 1.375 AS latency_ms
FROM (
  SELECT pref_id, CAST(pref_id % 25 AS INT) AS kind,
    max(CASE WHEN position = 1 THEN id END) AS a,
    coalesce(max(CASE WHEN position = 2 THEN id END), 'none') AS b,
    coalesce(max(CASE WHEN position = 3 THEN id END), 'none') AS c,
    coalesce(max(CASE WHEN position = 4 THEN id END), 'none') AS d
  FROM {candidates} GROUP BY pref_id
) picks
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["orders", "customer", "nation"]
    return spark.sql(LISTINGS, **{name: table(spark, sf_dir, name) for name in names})


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["customer", "nation"]
    return spark.sql(PREFERENCES, **{name: table(spark, sf_dir, name) for name in names})


def addresses_and_places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = {name: table(spark, sf_dir, name) for name in PLACE_TABLES}
    dictionary = {name: tables[name] for name in ["nation", "region", "supplier"]}
    return spark.sql(ADDRESSES, **tables), spark.sql(PLACES, **dictionary)


def responses(candidates: DataFrame) -> DataFrame:
    """No later candidate is in a reply, so only the first four of each preference are grouped."""
    first = candidates.where("position <= 4").select("pref_id", "position", "id")
    return candidates.sparkSession.sql(RESPONSES, candidates=first)


def for_oracle(sql: str, **tables: str) -> str:
    """The same text for the oracle, which quotes odd column names with double quotes."""
    return sql.format(**tables).replace("`approx_cost(for two people)`", '"approx_cost(for two people)"')
