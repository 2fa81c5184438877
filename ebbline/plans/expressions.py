"""Queries over the scalar expression language and JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import jsondoc
from ..functions.expressions import column
from ..sources import tables


def _select(table: str, key: str, **expressions: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.table(spark, sf_dir, table).select(key, *[column(text).alias(name) for name, text in expressions.items()])

    return run


def _register(name: str, sql: str, table: str, key: str, **expressions: str) -> None:
    query(name, sql)(_select(table, key, **expressions))


_register("exp1_precedence", "SELECT p_partkey, (p_size + 2 * 3 - 4) AS a, (p_size > 10 OR p_size < 5 AND p_partkey > 100) AS b, CAST(((p_size::BIGINT | 1) & 6) AS DECIMAL(20,0)) AS dummy FROM part", "part", "p_partkey", a="p_size + 2 * 3 - 4", b="p_size > 10 || p_size < 5 && p_partkey > 100", dummy="(p_size | 1) & 6")
_register("exp2_prefix", "SELECT p_partkey, -p_size AS a, NOT (p_size = 3) AS b, NOT (p_size BETWEEN 3 AND 9) AS c FROM part", "part", "p_partkey", a="-p_size", b="!(p_size = 3)", c="NOT p_size BETWEEN 3 AND 9")
_register("exp3_case", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS a, CASE WHEN p_size > 25 THEN p_size END AS b FROM part", "part", "p_partkey", a="case p_size when 1 then 'one' when 2 then 'two' else 'many' end", b="CASE WHEN p_size > 25 THEN p_size END")
_register("exp4_predicates", r"SELECT p_partkey, p_size IN (1, 2, 3) AS a, p_brand LIKE 'Brand#1%' AS b, regexp_matches(p_type, 'COPPER|STEEL') AS c, (nullif(p_size, 5) IS NULL) AS d, p_name NOT LIKE '%x_%' AS e FROM part", "part", "p_partkey", a="p_size IN (1,2,3)", b="p_brand LIKE 'Brand#1%'", c="p_type REGEXP 'COPPER|STEEL'", d="NULLIF(p_size, 5) IS NULL", e="p_name NOT LIKE '%x_%'")
_register("exp5_null_safe", "SELECT p_partkey, nullif(p_size, 5) IS NOT DISTINCT FROM NULL AS a, p_size IS NOT DISTINCT FROM 7 AS b FROM part", "part", "p_partkey", a="NULLIF(p_size,5) <=> NULL", b="p_size <=> 7")
_register("exp6_bits", "SELECT p_partkey, CAST(p_partkey & 12 AS DECIMAL(20,0)) AS a, CAST(xor(p_partkey, 5) AS DECIMAL(20,0)) AS b, CAST(p_partkey << 3 AS DECIMAL(20,0)) AS c, CAST(p_partkey >> 2 AS DECIMAL(20,0)) AS d, 18446744073709551615::DECIMAL(20,0) - p_partkey AS e FROM part", "part", "p_partkey", a="p_partkey & 12", b="p_partkey ^ 5", c="p_partkey << 3", d="p_partkey >> 2", e="~p_partkey")
_register("exp7_division", "SELECT p_partkey, p_partkey // 7 AS a, CASE WHEN p_size % 5 <> 0 THEN p_partkey % (p_size % 5) END AS b, round(p_partkey / 8, 4) AS c FROM part", "part", "p_partkey", a="p_partkey DIV 7", b="p_partkey MOD (p_size % 5)", c="ROUND(p_partkey / 8, 4)")
_register("exp7_wide_div", "SELECT p_partkey, 9007199254740993 + p_partkey AS a, (p_partkey - 100) // 7 + CASE WHEN p_partkey < 100 AND (p_partkey - 100) % 7 <> 0 THEN 0 ELSE 0 END AS b, CAST(trunc(p_partkey * 10 / 25) AS BIGINT) AS c FROM part", "part", "p_partkey", a="(9007199254740993 + p_partkey) DIV 1", b="(p_partkey - 100) DIV 7", c="p_partkey DIV 2.5")
_register("exp8_literals", "SELECT n_nationkey, 'it''s' AS a, 255 AS b, 5 AS c, DATE '2026-01-31' AS d, 'AB' AS e FROM nation", "nation", "n_nationkey", a=r"'it\'s'", b="b'11111111'", c="0b101", d="DATE '2026-01-31'", e="CAST(_utf8mb4 x'4142' AS CHAR)")
_register("exp9_casts", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(round(p_retailprice, 0) AS BIGINT) AS b, substring(p_name, 1, 4) AS c, CAST(p_size AS DECIMAL(8,2)) AS d FROM part", "part", "p_partkey", a="CAST(p_size AS CHAR)", b="CAST(p_retailprice AS SIGNED)", c="CAST(p_name AS CHAR(4))", d="CONVERT(p_size, DECIMAL(8,2))")
_register(
    "exp11_collate",
    "SELECT p_partkey, lower(p_brand) = 'brand#11' AS a, p_brand = 'Brand#11' AS b, lower(p_brand) IN ('brand#12', 'brand#13') AS c, lower(p_brand) >= 'brand#2' AND lower(p_brand) <= 'brand#33' AS d, CASE WHEN lower(p_brand) = 'brand#41' THEN 1 ELSE 0 END AS e, lower(p_brand) LIKE 'brand#5%' AS f, false AS g, true AS h FROM part",
    "part", "p_partkey", a="p_brand COLLATE utf8mb4_general_ci = 'BRAND#11'", b="'Brand#11' = p_brand COLLATE utf8mb4_bin", c="p_brand COLLATE utf8mb4_0900_ai_ci IN ('BRAND#12', 'bränd#13')", d="UPPER(p_brand) BETWEEN 'brand#2' COLLATE utf8mb4_unicode_ci AND 'Brand#33'",
    e="CASE p_brand COLLATE utf8mb4_0900_ai_ci WHEN 'BRAND#41' THEN 1 ELSE 0 END", f="p_brand COLLATE utf8mb4_general_ci LIKE 'BRAND#5%'", g="p_brand COLLATE utf8mb4_0900_as_ci = CONCAT('bränd', '#11')", h="CONCAT(p_brand, '  ') = LOWER(p_brand COLLATE utf8mb4_general_ci)",
)
_register("exp10_convert_using", "SELECT n_nationkey, n_name || '?' AS a, n_name || 'é' AS b, n_name || '?' AS c, n_name || '漢🙂' AS d FROM nation", "nation", "n_nationkey", a="CONVERT(CONCAT(n_name, 'é') USING ascii)", b="CONVERT(CONCAT(n_name, 'é') USING latin1)", c="CONVERT(CONCAT(n_name, '🙂') USING utf8)", d="CONVERT(CONCAT(n_name, '漢🙂') USING utf8mb4)")
_register("exp12_intervals", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR AS c, o_orderdate + INTERVAL 14 MONTH AS d FROM orders", "orders", "o_orderkey", a="o_orderdate + INTERVAL 3 DAY", b="DATE_SUB(o_orderdate, INTERVAL 2 MONTH)", c="o_orderdate + INTERVAL '1 2' DAY_HOUR", d="ADDDATE(o_orderdate, INTERVAL '1-2' YEAR_MONTH)")
_register("exp13_interval_function", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS a, CASE WHEN p_size = 5 THEN -1 WHEN p_size < 3 THEN 0 ELSE 1 END AS b FROM part", "part", "p_partkey", a="INTERVAL(p_size, 10, 20, 30)", b="INTERVAL(NULLIF(p_size,5), 3)")
_register("exp14_extract", "SELECT o_orderkey, year(o_orderdate) AS a, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS b, quarter(o_orderdate) AS c, (day(o_orderdate) * 100 + hour(o_orderdate))::BIGINT AS d FROM orders", "orders", "o_orderkey", a="EXTRACT(YEAR FROM o_orderdate)", b="EXTRACT(YEAR_MONTH FROM o_orderdate)", c="EXTRACT(QUARTER FROM o_orderdate)", d="EXTRACT(DAY_HOUR FROM o_orderdate)")
_register("exp15_timestamps", "SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE AS a, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS b FROM orders", "orders", "o_orderkey", a="TIMESTAMPADD(MINUTE, 90, o_orderdate)", b="TIMESTAMPDIFF(DAY, TIMESTAMP '1995-01-01 00:00:00', o_orderdate)")
_register("exp17_substring", "SELECT p_partkey, substring(p_type, 3, 4) AS a, substring(p_type, 2) AS b, right(p_type, 3) AS c, left(p_type, 2) AS d FROM part", "part", "p_partkey", a="SUBSTRING(p_type FROM 3 FOR 4)", b="MID(p_type, 2)", c="SUBSTR(p_type, -3)", d="LEFT(p_type, 2)")
_register("exp18_trim", "SELECT p_partkey, regexp_replace(repeat('ab', p_size % 3) || 'ba' || p_brand || repeat('ab', p_size % 2), '^(ab)+|(ab)+$', '', 'g') AS a, regexp_replace(repeat('ab', p_size % 3) || p_brand, '^(ab)+', '') AS b FROM part", "part", "p_partkey", a="TRIM(BOTH 'ab' FROM CONCAT(REPEAT('ab', p_size % 3), 'ba', p_brand, REPEAT('ab', p_size % 2)))", b="TRIM(LEADING 'ab' FROM CONCAT(REPEAT('ab', p_size % 3), p_brand))")
_register("exp19_position", "SELECT p_partkey, CAST(strpos(p_type, 'S') AS INTEGER) AS a, CAST(strpos(p_brand, '#') AS INTEGER) AS b FROM part", "part", "p_partkey", a="POSITION('S' IN p_type)", b="LOCATE('#', p_brand)")
_register("exp21_json", "SELECT event_id, json_extract_string(props, '$.k') AS a FROM events", "events", "event_id", a="props->>'$.k'")
_PROPS = "CONCAT('{\"k\": \"', event_type, '\", \"n\": [', event_id, ', null, {\"a b\": \"x\\\\\"y\"}], \"t\": true}')"
_register(
    "exp21_json_text",
    """
    SELECT event_id, '"' || event_type || '"' AS a, event_type AS b, event_id::VARCHAR AS c, 'null' AS d, NULL AS e, '["' || event_type || '",true]' AS f, '[1,"x",null,' || event_id || ',{"a":"' || event_type || '"}]' AS g,
      '{"b":' || event_id || ',"aa":"' || event_type || '","none":null}' AS h, 'x"y' AS i, '"x\\"y"' AS j FROM events
    """,
    "events", "event_id", a=f"JSON_EXTRACT({_PROPS}, '$.k')", b=f"JSON_UNQUOTE(JSON_EXTRACT({_PROPS}, '$.k'))", c=f"JSON_EXTRACT({_PROPS}, '$.n[0]')", d=f"JSON_EXTRACT({_PROPS}, '$.n[1]')", e=f"JSON_EXTRACT({_PROPS}, '$.no')",
    f=f"JSON_EXTRACT({_PROPS}, '$.k', '$.t')", g="JSON_ARRAY(1, 'x', NULL, event_id, JSON_OBJECT('a', event_type))", h="JSON_OBJECT('aa', event_type, 'b', 0, 'none', NULL, 'b', event_id)",
    i=f"JSON_UNQUOTE(JSON_EXTRACT({_PROPS}, '$.n[2].\"a b\"'))", j=f"JSON_EXTRACT({_PROPS}, '$.n[2].\"a b\"')",
)
_register("exp21_json_arrow", """SELECT event_id, (props::JSON -> '$.k')::VARCHAR AS a, json_extract_string(props, '$.k') AS b FROM events""", "events", "event_id", a="props->'$.k'", b="props->>'$.k'")
_register("exp22_functions", "SELECT p_partkey, power(p_size, 2)::DOUBLE AS a, lower(p_brand) AS b, length(p_name) AS c, ceil(p_retailprice)::BIGINT AS d FROM part", "part", "p_partkey", a="POWER(p_size, 2)", b="LCASE(p_brand)", c="CHARACTER_LENGTH(p_name)", d="CEIL(p_retailprice)")
_register("exp24_dates", "SELECT o_orderkey, date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 366 AS a, (dayofweek(o_orderdate) + 1) AS b, dayofyear(o_orderdate) AS c, (isodow(o_orderdate) - 1) AS d, epoch(o_orderdate)::BIGINT AS e FROM orders", "orders", "o_orderkey", a="TO_DAYS(o_orderdate)", b="DAYOFWEEK(o_orderdate)", c="DAYOFYEAR(o_orderdate)", d="WEEKDAY(o_orderdate)", e="UNIX_TIMESTAMP(o_orderdate)")
_register("exp28_greatest", "SELECT p_partkey, CASE WHEN p_size <> 5 THEN greatest(p_size, 10) END AS a, coalesce(nullif(p_size, 5), 0) AS b, nullif(p_size, 5) IS NULL AS c FROM part", "part", "p_partkey", a="GREATEST(NULLIF(p_size, 5), 10)", b="COALESCE(NULLIF(p_size, 5), 0)", c="ISNULL(NULLIF(p_size, 5))")


@query("exp25_concat_pipes", "SELECT p_partkey, p_brand || '/' || p_type AS a FROM part")
def exp25_concat_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", column("p_brand || '/' || p_type", pipes_concat=True).alias("a"))


@query("exp27_executable_comments", "SELECT p_partkey, p_size + 1 AS a, p_size AS b FROM part")
def exp27_executable_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select("p_partkey", column("p_size /*!50700 + 1 */").alias("a"), column("p_size /*!99999 + 1 */ /* plain */").alias("b"))


_DOC = "'{\"id\":' || event_id || ',\"tags\":[\"' || event_type || '\",' || (event_id % 3) || '],\"u\":{\"x\":' || user_id || '}}'"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"u":{"x":'), F.col("user_id").cast("string"), F.lit('},"tags":["'), F.col("event_type"), F.lit('",'), (F.col("event_id") % 3).cast("string"), F.lit('],"id":'), F.col("event_id").cast("string"), F.lit("}"))
    return tables.table(spark, sf_dir, "events").select("event_id", text.alias("doc"))


@query("jsn1_canonical", f"SELECT event_id, {_DOC} AS doc FROM events")
def jsn1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: jsondoc.dumps(jsondoc.loads(t)))

    return _documents(spark, sf_dir).select("event_id", canonical("doc").alias("doc"))


@query("jsn5_apply_changes", "SELECT event_id, '{\"id\":0,\"new\":true,\"tags\":[' || (event_id % 3) || ',\"end\"],\"u\":{\"x\":' || user_id || '}}' AS doc FROM events")
def jsn5_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = [(jsondoc.REPLACE, "$.id", 0), (jsondoc.INSERT, "$.tags[99]", "end"), (jsondoc.REMOVE, "$.tags[0]", None), (jsondoc.INSERT, "$.new", True)]

    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: jsondoc.dumps(jsondoc.apply_changes(jsondoc.loads(t), changes)))

    return _documents(spark, sf_dir).select("event_id", changed("doc").alias("doc"))


@query(
    "jsn8_match_fields",
    """
    SELECT event_id, unnest(['$', '$."id"', '$."tags"', '$."tags"[0]', '$."tags"[1]', '$."u"', '$."u"."x"']) AS path, unnest(['OBJECT', 'INTEGER', 'ARRAY', 'STRING', 'INTEGER', 'OBJECT', 'INTEGER']) AS kind,
      unnest([NULL, event_id::VARCHAR, NULL, event_type, (event_id % 3)::VARCHAR, NULL, user_id::VARCHAR]) AS text, unnest([3, NULL, 2, NULL, NULL, 1, NULL]) AS n FROM events
    """,
)
def jsn8_match_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<struct<path: string, kind: string, text: string, n: int>>")
    def fields(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("path", "kind", "text", "n"), f, strict=True)) for f in jsondoc.match_fields(jsondoc.loads(t))])

    return _documents(spark, sf_dir).select("event_id", F.explode(fields("doc")).alias("f")).select("event_id", "f.*")


@query("jsn12_opaque", "SELECT n_nationkey, 'base64:type15:' || to_base64(encode(n_name)) AS shown FROM nation")
def jsn12_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def shown(names: pd.Series) -> pd.Series:
        return names.map(lambda n: jsondoc.opaque_text(15, n.encode()))

    return tables.table(spark, sf_dir, "nation").select("n_nationkey", shown("n_name").alias("shown"))
