"""Scalar functions by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.plans.registry import frame, sql
from quillon.session import table

# strings
sql("fn_case", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
sql("fn_initcap", "SELECT initcap(lower(r_name)) AS i FROM region", "SELECT array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i FROM region")
sql("fn_split_part", "SELECT split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', 2) AS b, split_part(p_brand, '#', 5) AS c FROM part")
sql("fn_overlay", "SELECT overlay(p_brand PLACING '##' FROM 2 FOR 3) AS o FROM part", "SELECT substr(p_brand, 1, 1) || '##' || substr(p_brand, 5) AS o FROM part")
sql("fn_translate", "SELECT translate(n_name, 'AEI', '123') AS t FROM nation")
sql("fn_chr_ascii", "SELECT n_nationkey, chr(65 + n_nationkey) AS c, CAST(ascii(n_name) AS INT) AS a FROM nation")
sql("fn_md5", "SELECT md5(n_name) AS m FROM nation")
sql("fn_length", "SELECT CAST(length(p_name) AS BIGINT) AS a, CAST(char_length(p_brand) AS BIGINT) AS b FROM part", "SELECT length(p_name) AS a, length(p_brand) AS b FROM part")
sql("fn_position", "SELECT CAST(position('a' IN p_name) AS BIGINT) AS a, CAST(instr(p_brand, '#') AS BIGINT) AS b FROM part", "SELECT strpos(p_name, 'a') AS a, strpos(p_brand, '#') AS b FROM part")
sql("fn_concat_ws", "SELECT concat_ws('-', n_name, CAST(NULL AS STRING), CAST(n_nationkey AS STRING)) AS c FROM nation")
sql("fn_substr", "SELECT substring(n_name, 2, 3) AS a, substr(n_name, -3) AS b FROM nation")
sql("fn_replace", "SELECT replace(p_brand, '#', '--') AS r FROM part")
sql("fn_trim", "SELECT trim('  x  ') AS a, ltrim('  x  ') AS b, rtrim('  x  ') AS c")
sql("fn_left_right", "SELECT left(n_name, 2) AS a, right(n_name, 3) AS b FROM nation")
sql("fn_pad", "SELECT lpad(CAST(n_nationkey AS STRING), 4, '0') AS a, rpad(n_name, 12, '.') AS b FROM nation")
sql("fn_reverse_repeat", "SELECT reverse(n_name) AS a, repeat(n_name, 2) AS b FROM nation")
sql("fn_printf", "SELECT format_string('%s:%05d:%.2f', n_name, n_nationkey, CAST(n_regionkey AS DOUBLE)) AS p FROM nation", "SELECT printf('%s:%05d:%.2f', n_name, n_nationkey, CAST(n_regionkey AS DOUBLE)) AS p FROM nation")
sql("fn_regexp_extract_all", "SELECT doc_id, array_join(regexp_extract_all(text, '[0-9]+', 0), ',') AS m FROM documents", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS m FROM documents")
sql("fn_regexp_groups", "SELECT o_orderkey, regexp_extract(o_orderpriority, '([0-9])-(.*)', 1) AS a, regexp_extract(o_orderpriority, '([0-9])-(.*)', 2) AS b FROM orders")
sql("fn_regexp_count", "SELECT doc_id, CAST(regexp_count(text, '[0-9]') AS BIGINT) AS n FROM documents", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS n FROM documents")
sql("fn_regexp_replace_all", "SELECT regexp_replace(p_brand, '[0-9]', 'x') AS r FROM part", "SELECT regexp_replace(p_brand, '[0-9]', 'x', 'g') AS r FROM part")
sql("fn_unicode", "SELECT CAST(unicode(n_name) AS INT) AS u, concat(chr(72), chr(105)) AS c FROM nation".replace("unicode", "ascii"), "SELECT unicode(n_name) AS u, chr(72) || chr(105) AS c FROM nation")
sql("fn_hex", "SELECT hex(n_name) AS h, CAST(unhex(hex(n_name)) AS STRING) AS s FROM nation", "SELECT hex(n_name) AS h, decode(unhex(hex(n_name))) AS s FROM nation")
sql("fn_base64", "SELECT base64(CAST(n_name AS BINARY)) AS b, CAST(unbase64(base64(CAST(n_name AS BINARY))) AS STRING) AS s FROM nation", "SELECT to_base64(encode(n_name)) AS b, decode(from_base64(to_base64(encode(n_name)))) AS s FROM nation")


@frame("fn_concat_skip_null", "SELECT concat(n_name, NULL, '!') AS c FROM nation")
def fn_concat_skip_null(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(S.concat_skip_null(F.col("n_name"), F.lit(None).cast("string"), F.lit("!")).alias("c"))


@frame("fn_regexp_replace_first", "SELECT regexp_replace(p_brand, '[0-9]', 'x') AS r FROM part")
def fn_regexp_replace_first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(S.regexp_replace_first(F.col("p_brand"), "[0-9]", "x").alias("r"))


@frame("fn_quote", "SELECT coalesce('''' || replace(x, '''', '''''') || '''', 'NULL') AS q FROM (VALUES ('it''s'), ('a'), (NULL)) t(x)")
def fn_quote(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('it\\'s'), ('a'), (NULL) AS t(x)").select(S.quote(F.col("x")).alias("q"))


# numbers
sql("fn_abs_ceil_floor", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS b, CAST(floor(c_acctbal) AS BIGINT) AS c FROM customer")
sql("fn_round", "SELECT c_custkey, round(c_acctbal) AS a, round(c_acctbal, 1) AS b FROM customer")
sql("fn_power_sqrt", "SELECT p_partkey, round(power(p_size, 2), 6) AS a, round(sqrt(p_size), 6) AS b, round(exp(p_size / 10.0E0), 4) AS c FROM part")
sql("fn_logs", "SELECT p_partkey, round(ln(p_size), 6) AS a, round(log10(p_size), 6) AS b, round(log2(p_size), 6) AS c FROM part")
sql("fn_trig", "SELECT p_partkey, round(sin(p_size), 6) AS a, round(cos(p_size), 6) AS b, round(tan(p_size), 5) AS c, round(asin(p_size / 60.0E0), 6) AS d, round(acos(p_size / 60.0E0), 6) AS e, round(atan(p_size), 6) AS f, round(atan2(p_size, 3), 6) AS g FROM part")
sql("fn_angles", "SELECT round(pi(), 10) AS p, round(degrees(1.5E0), 6) AS d, round(radians(90.0E0), 6) AS r")
sql("fn_sign", "SELECT c_custkey, CAST(sign(c_acctbal) AS INT) AS s FROM customer")
sql("fn_greatest_least", "SELECT p_partkey, greatest(p_size, 10, CAST(NULL AS INT)) AS g, least(p_size, 10, CAST(NULL AS INT)) AS l FROM part")
sql("fn_cbrt", "SELECT p_partkey, round(cbrt(p_size), 6) AS c FROM part")
sql("fn_mod", "SELECT p_partkey, try_mod(p_size, p_size - 7) AS m FROM part", "SELECT p_partkey, p_size % nullif(p_size - 7, 0) AS m FROM part")
sql("fn_random", "SELECT n_nationkey, rand() AS r FROM nation", check=False)
sql("fn_uuid", "SELECT n_nationkey, uuid() AS u FROM nation", check=False)


@frame("fn_trunc", "SELECT c_custkey, round(trunc(c_acctbal * 10) / 10, 4) AS a FROM customer")
def fn_trunc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(S.trunc_number(F.col("c_acctbal"), 1), 4).alias("a"))


@frame("fn_gcd_lcm", "SELECT p_partkey, CAST(gcd(p_partkey, p_size * 6) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
def fn_gcd_lcm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.gcd(F.col("p_partkey"), F.col("p_size") * 6).alias("g"), S.lcm(F.col("p_partkey"), F.col("p_size")).alias("l"))


@frame("fn_log_base", "SELECT p_partkey, round(ln(p_size), 6) AS a, round(log(3, p_size), 6) AS b FROM part")
def fn_log_base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(S.log_any(F.col("p_size")), 6).alias("a"), F.round(S.log_any(F.col("p_size"), F.lit(3)), 6).alias("b"))


# nulls and types
sql("fn_coalesce_nullif", "SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS a, ifnull(nullif(p_size, 8), -2) AS b FROM part")
sql("fn_nvl_iif", "SELECT p_partkey, nvl(nullif(p_size, 7), 0) AS a, if(p_size > 25, 'big', 'small') AS b FROM part", "SELECT p_partkey, coalesce(nullif(p_size, 7), 0) AS a, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS b FROM part")
sql("fn_zeroblob", "SELECT CAST(repeat(chr(0), 4) AS BINARY) AS z", "SELECT '\\x00\\x00\\x00\\x00'::BLOB AS z")


@frame("fn_date_diff_units", "SELECT o_orderkey, date_diff('month', DATE '1995-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS months, CAST(date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) // 3600 AS BIGINT) AS hours, CAST(date_diff('second', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) // 604800 AS BIGINT) AS weeks FROM orders")
def fn_date_diff_units(spark: SparkSession, sf: str) -> DataFrame:
    d, zero = F.col("o_orderdate"), F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", *[S.date_diff(d, zero, u).alias(u) for u in ("months", "hours", "weeks")])


@frame("fn_date_weekday", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) + ((8 - dayofweek(ts)) % 7) * INTERVAL 1 DAY AS t FROM events")
def fn_date_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.date_modifier(F.col("ts"), "start of day", "weekday 1").alias("t"))


@frame("fn_typeof", "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d, 'blob' AS e FROM region")
def fn_typeof(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(S.type_name(F.col("r_regionkey")).alias("a"), S.type_name(F.lit(1.5)).alias("b"), S.type_name(F.col("r_name")).alias("c"), S.type_name(F.lit(None).cast("int")).alias("d"), S.type_name(F.col("r_name").cast("binary")).alias("e"))


# dates
sql("fn_now", "SELECT current_timestamp() AS a, current_date() AS b", check=False)
_PARTS = ("year", "month", "day", "hour", "minute", "quarter", "week", "doy")
sql("fn_extract", "SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS BIGINT) AS p_{p}" for p in _PARTS) + ", CAST(extract(second FROM ts) AS BIGINT) AS p_second FROM events", "SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS BIGINT) AS p_{p}" for p in _PARTS) + ", CAST(floor(extract(second FROM ts)) AS BIGINT) AS p_second FROM events")
sql("fn_epoch", "SELECT event_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS e FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events")
for _u in ("year", "quarter", "month", "week", "day", "hour", "minute"):
    sql(f"fn_date_trunc_{_u}", f"SELECT event_id, CAST(date_trunc('{_u}', ts) AS TIMESTAMP_NTZ) AS t FROM events", f"SELECT event_id, CAST(date_trunc('{_u}', ts) AS TIMESTAMP) AS t FROM events")
sql("fn_date_add", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '5' DAY AS a, add_months(CAST(o_orderdate AS DATE), 1) AS b FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 5 DAY AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS b FROM orders")
sql("fn_date_sub", "SELECT o_orderkey, o_orderdate - INTERVAL '3' HOUR AS a FROM orders")
sql("fn_date_diff", "SELECT l_orderkey, l_linenumber, CAST(datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') AS BIGINT) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS d FROM lineitem")
sql("fn_make_date", "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + n_regionkey, 15) AS d FROM nation")
sql("fn_make_timestamp", "SELECT n_nationkey, make_timestamp_ntz(2020, 1, 1 + n_nationkey, 3, 4, 5) AS t FROM nation", "SELECT n_nationkey, make_timestamp(2020, 1, 1 + n_nationkey, 3, 4, 5) AS t FROM nation")
sql("fn_to_timestamp", "SELECT CAST(timestamp_seconds(1700000000 + n_nationkey) AS TIMESTAMP_NTZ) AS t FROM nation", "SELECT CAST(make_timestamp((1700000000 + n_nationkey::BIGINT) * 1000000) AS TIMESTAMP) AS t FROM nation")
sql("fn_leap_month_end", "SELECT add_months(DATE '2024-01-31', 1) AS d", "SELECT CAST(DATE '2024-01-31' + INTERVAL 1 MONTH AS DATE) AS d")


@frame("fn_day_of_week", "SELECT event_id, CAST(extract(dow FROM ts) AS BIGINT) AS d FROM events")
def fn_day_of_week(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.day_of_week(F.col("ts")).alias("d"))


@frame("fn_to_char", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS a, strftime(ts, '%Y/%j') AS b FROM events")
def fn_to_char(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.to_char(F.col("ts"), "YYYY-MM-DD HH24:MI").alias("a"), S.strftime("%Y/%j", F.col("ts")).alias("b"))


@frame("fn_strftime", "SELECT event_id, strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H:%M:%S') || ' ' || strftime(ts, '%A %B %p %I %y') || ' ' || CAST(floor(epoch(ts)) AS BIGINT) || ' ' || dayofweek(ts) || ' 100%' AS s FROM events")
def fn_strftime(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.strftime("%FT%T %A %B %p %I %y %s %w 100%%", F.col("ts")).alias("s"))


@frame("fn_to_char_number", "SELECT p_partkey, trim(format('{:,.2f}', p_retailprice)) AS s FROM part")
def fn_to_char_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.trim(S.number_to_char(F.round("p_retailprice", 2), "999,999,990.00")).alias("s"))


@frame("fn_julian_day", "SELECT event_id, round(epoch(ts) / 86400 + 2440587.5, 5) AS j FROM events")
def fn_julian_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(S.julian_day(F.col("ts")), 5).alias("j"))


@frame("fn_date_modifiers", "SELECT event_id, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS t FROM events")
def fn_date_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.date_modifier(F.col("ts"), "start of month", "+1 month", "-1 day").alias("t"))


_AGE = "(year(DATE '2002-01-01') - year(o_orderdate)) * 12 + 1 - month(o_orderdate)"
_AGE_DAYS = "1 - day(o_orderdate)"


@frame(
    "fn_age",
    f"WITH d AS (SELECT o_orderkey, CASE WHEN {_AGE_DAYS} < 0 THEN {_AGE} - 1 ELSE {_AGE} END AS m, CASE WHEN {_AGE_DAYS} < 0 THEN {_AGE_DAYS} + 30 ELSE {_AGE_DAYS} END AS d FROM orders), "
    "p AS (SELECT o_orderkey, CASE WHEN m // 12 <> 0 THEN (m // 12) || ' year' || CASE WHEN abs(m // 12) = 1 THEN '' ELSE 's' END END AS y, CASE WHEN m % 12 <> 0 THEN (m % 12) || ' mon' || CASE WHEN abs(m % 12) = 1 THEN '' ELSE 's' END END AS mo, "
    "CASE WHEN d <> 0 THEN d || ' day' || CASE WHEN abs(d) = 1 THEN '' ELSE 's' END END AS da FROM d) SELECT o_orderkey, coalesce(nullif(concat_ws(' ', y, mo, da), ''), '0 days') AS a FROM p",
)
def fn_age(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", S.age(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("a"))


# arrays
sql("fn_array_literal", "SELECT n_nationkey, array_join(array(n_nationkey, n_regionkey), ',') AS a, CAST(size(array(1, 2, 3)) AS BIGINT) AS n FROM nation", "SELECT n_nationkey, array_to_string([n_nationkey, n_regionkey], ',') AS a, len([1, 2, 3]) AS n FROM nation")
sql("fn_array_edit", "SELECT array_join(array_append(array(1, 2), 3), ',') AS a, array_join(array_remove(array(1, 2, 1), 1), ',') AS b, array_join(concat(array(1), array(2)), ',') AS c", "SELECT array_to_string(list_append([1, 2], 3), ',') AS a, array_to_string(list_filter([1, 2, 1], lambda x: x <> 1), ',') AS b, array_to_string(list_concat([1], [2]), ',') AS c")


@frame("fn_array_position", "SELECT n_nationkey, CAST(nullif(list_position([3, 5, 7], n_nationkey), 0) AS BIGINT) AS p FROM nation")
def fn_array_position(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", S.array_position_or_null(F.array(F.lit(3), F.lit(5), F.lit(7)), F.col("n_nationkey")).alias("p"))


# JSON
sql("fn_json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("fn_json_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
sql("fn_json_array_length", "SELECT CAST(json_array_length('[1, 2, [3]]') AS BIGINT) AS n", "SELECT CAST(json_array_length('[1, 2, [3]]') AS BIGINT) AS n")
sql("fn_json_object", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS j FROM nation")
sql("fn_json_array", "SELECT n_nationkey, to_json(array(n_nationkey, n_regionkey)) AS j FROM nation", "SELECT n_nationkey, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS j FROM nation")
sql("fn_row_to_json", "SELECT to_json(struct(r.*)) AS j FROM region r", "SELECT CAST(to_json(r) AS VARCHAR) AS j FROM region r")
sql("fn_json_keys", "SELECT event_id, array_join(json_object_keys(props), ',') AS k FROM events", "SELECT event_id, array_to_string(json_keys(props), ',') AS k FROM events")
sql("fn_json_valid", "SELECT x, try_parse_json(x) IS NOT NULL AS ok FROM (VALUES ('{\"a\":1}'), ('{bad'), ('[1]')) t(x)", "SELECT x, json_valid(x) AS ok FROM (VALUES ('{\"a\":1}'), ('{bad'), ('[1]')) t(x)")


_ODD_JSON = "(VALUES ('{\"k\":1}'), ('{\"k\":1.5}'), ('{\"k\":\"x\"}'), ('{\"k\":true}'), ('{\"k\":false}'), ('{\"k\":null}'), ('{\"k\":[1]}'), ('{\"k\":{}}'), ('{}')) t(j)"


@frame("fn_json_type", f"SELECT j, CASE json_type(j, '$.k') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'real' WHEN 'BOOLEAN' THEN json_extract_string(j, '$.k') WHEN 'UBIGINT' THEN 'integer' END AS t FROM {_ODD_JSON}")
def fn_json_type(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT j FROM {_ODD_JSON}").select("j", S.json_type(F.col("j"), "$.k").alias("t"))


@frame("fn_json_contains", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 AS c FROM events")
def fn_json_contains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.json_contains({"k": 7})(F.col("props")).alias("c"))


@frame("fn_json_insert", "SELECT event_id, props::JSON ->> '$.k' AS kept, '1' AS made FROM events")
def fn_json_insert(spark: SparkSession, sf: str) -> DataFrame:
    j = S.json_insert(S.json_insert(F.col("props"), "$.k", -1), "$.z", 1)
    return table(spark, sf, "events").select("event_id", F.get_json_object(j, "$.k").alias("kept"), F.get_json_object(j, "$.z").alias("made"))




@frame("fn_json_set", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' AS a, '{\"k\":0}' AS b, '{}' AS c FROM events")
def fn_json_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.json_set(F.col("props"), "$.z", 1).alias("a"), S.json_replace(F.col("props"), "$.k", 0).alias("b"), S.json_remove(F.col("props"), "$.k").alias("c"))


@frame("fn_json_patch", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"n\":2}' AS j FROM events")
def fn_json_patch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.json_patch(F.col("props"), F.lit('{"n":2,"gone":null}')).alias("j"))


@frame("fn_json_path", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN '[' || json_extract_string(props, '$.k') || ']' ELSE '[]' END AS j FROM events")
def fn_json_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.json_path("$?(@.k > 50).k")(F.col("props")).alias("j"))
