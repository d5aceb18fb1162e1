"""Wide queries over scalar functions: each function beside the SQL that states its value, over whole tables."""

from __future__ import annotations

from collections.abc import Callable


def wide(match: str, key: str, source: str, pairs: dict[str, str]) -> tuple[str, str]:
    """(query, SQL) with a column for the key and one for each pair of expressions."""
    names = [f"f{i}" for i in range(len(pairs))]
    query = f"{match} RETURN {key} AS k, " + ", ".join(f"{x} AS {n}" for n, x in zip(names, pairs, strict=True))
    column = key.split(".")[1]
    sql = f"SELECT {column} AS k, " + ", ".join(f"{x} AS {n}" for n, x in zip(names, pairs.values(), strict=True)) + f" FROM {source}"
    return query, sql


_PART = ("MATCH (p:Part)", "p.p_partkey", "part")
_ORDER = ("MATCH (o:Order)", "o.o_orderkey", "orders")
_EVENT = ("MATCH (e:Event)", "e.event_id", "events")
_NATION = ("MATCH (n:Nation)", "n.n_nationkey", "nation")

NUMBERS = wide(*_PART, {
    "round(cbrt(p.p_retailprice), 8)": "round(cbrt(p_retailprice), 8)",
    "round(exp(p.p_size / 10.0), 6)": "round(exp(p_size / 10.0::DOUBLE), 6)",
    "square(p.p_size)": "p_size * p_size",
    "round(log2(p.p_retailprice), 9)": "round(log2(p_retailprice), 9)",
    "round(pi() * p.p_size, 9)": "round(pi() * p_size, 9)",
    "round(e() * p.p_size, 9)": "round(exp(1::DOUBLE) * p_size, 9)",
    "round(sin(p.p_size), 9)": "round(sin(p_size), 9)",
    "round(cos(p.p_size), 9)": "round(cos(p_size), 9)",
    "round(tan(p.p_size), 7)": "round(tan(p_size), 7)",
    "round(asin(p.p_size / 100.0), 9)": "round(asin(p_size / 100.0::DOUBLE), 9)",
    "round(acos(p.p_size / 100.0), 9)": "round(acos(p_size / 100.0::DOUBLE), 9)",
    "round(atan(p.p_size), 9)": "round(atan(p_size), 9)",
    "round(atan2(p.p_size, p.p_retailprice), 9)": "round(atan2(p_size, p_retailprice), 9)",
    "round(cot(p.p_size), 7)": "round(cot(p_size), 7)",
    "round(radians(p.p_retailprice), 9)": "round(radians(p_retailprice), 9)",
    "isinf(p.p_retailprice)": "isinf(p_retailprice)",
    "isinf(infinity() * p.p_retailprice)": "isinf('inf'::DOUBLE * p_retailprice)",
    "isnan(p.p_retailprice)": "isnan(p_retailprice)",
    "isnan(nan() + p.p_retailprice)": "isnan('nan'::DOUBLE + p_retailprice)",
    "isfinite(p.p_retailprice)": "isfinite(p_retailprice)",
    "isfinite(infinity())": "isfinite('inf'::DOUBLE)",
    "bitwise_or(p.p_size, 9)": "p_size | 9",
    "bitwise_xor(p.p_size, 9)": "xor(p_size, 9)",
    "xor(p.p_size, 12)": "xor(p_size, 12)",
    "~p.p_size": "~p_size",
    "negate(p.p_size)": "-p_size",
    "bit_count(p.p_size)": "bit_count(p_size)::BIGINT",
    "round(gamma(p.p_size / 7.0), 4)": "round(gamma(p_size / 7.0::DOUBLE), 4)",
    "round(lgamma(p.p_size / 3.0), 8)": "round(lgamma(p_size / 3.0::DOUBLE), 8)",
    "setseed(0.5)": "NULL::DOUBLE",
    "bitshift_right(p.p_size, 2)": "(p_size >> 2)::BIGINT",
    "p.p_size / 7": "(p_size // 7)::BIGINT",
    "p.p_retailprice / 7": "p_retailprice / 7",
    "p.p_size ^ 2": "pow(p_size, 2)",
})

TEXTS = wide(*_PART, {
    "starts_with(p.p_name, 'c')": "starts_with(p_name, 'c')",
    "prefix(p.p_name, 'co')": "starts_with(p_name, 'co')",
    "suffix(p.p_name, 't')": "ends_with(p_name, 't')",
    "regexp_full_match(p.p_name, 'c.* widget')": "regexp_full_match(p_name, 'c.* widget')",
    "ltrim(concat('  ', p.p_name))": "p_name",
    "rtrim(concat(p.p_name, '  '))": "p_name",
    "rpad(p.p_name, 20, '.')": "rpad(p_name, 20, '.')",
    "regexp_split_to_array(p.p_name, '[aeiou]')": "regexp_split_to_array(p_name, '[aeiou]')",
    "chr(65 + p.p_size % 26)": "chr((65 + p_size % 26)::INTEGER)",
    "string_agg(p.p_brand, p.p_type, '; ')": "p_brand || '; ' || p_type || '; ; '",
    "printf('%s has %d', p.p_name, p.p_size)": "p_name || ' has ' || p_size",
    "format('%s/%s', p.p_brand, p.p_type)": "p_brand || '/' || p_type",
    "base64_decode(base64_encode(p.p_name))": "p_name",
    "url_encode(concat(p.p_name, '/&'))": "url_encode(p_name || '/&')",
    "url_decode(url_encode(p.p_name))": "p_name",
    "from_hex(to_hex(p.p_partkey))": "p_partkey",
    "octet_length(encode(p.p_name))": "octet_length(p_name::BLOB)::BIGINT",
    "decode(encode(p.p_name))": "p_name",
    "decode(to_blob(p.p_name))": "p_name",
    "substring(p.p_name, -4)": "right(p_name, 4)",
    "string_split(p.p_name, ' ')": "string_split(p_name, ' ')",
    "editdistance(p.p_name, p.p_type)": "levenshtein(p_name, p_type)",
    "strlen(p.p_type)": "length(p_type)",
    "instr(p.p_name, 'i')": "instr(p_name, 'i')",
    "contains(p.p_name, 'dg')": "contains(p_name, 'dg')",
    "sha1(p.p_name)": "sha1(p_name)",
    "csv_escape(concat(p.p_name, '\"'))": "p_name || '\"\"'",
    "csv_quote(p.p_name)": "'\"' || p_name || '\"'",
    "csv_header('a', 'b')": "'a,b'",
    "format_csv_row(p.p_name, p.p_size, true)": "p_name || ',' || p_size || ',true'",
    "write_csv_line(concat(p.p_name, ','), p.p_size)": "'\"' || p_name || ',\",' || p_size",
})

DATES = wide(*_EVENT, {
    "hour(e.ts)": "hour(ts)",
    "minute(e.ts)": "minute(ts)",
    "second(e.ts)": "second(ts)",
    "millisecond(e.ts)": "millisecond(ts) % 1000",
    "microsecond(e.ts)": "microsecond(ts) % 1000000",
    "date(e.ts)": "ts::DATE",
    "to_date(to_string(date(e.ts)))": "ts::DATE",
    "datetime(e.ts)": "ts",
    "make_date(year(e.ts), month(e.ts), day(e.ts))": "ts::DATE",
    "make_timestamp(year(e.ts), month(e.ts), day(e.ts), hour(e.ts), minute(e.ts), second(e.ts))": "date_trunc('second', ts)",
    "date_part('hour', e.ts)": "date_part('hour', ts)",
    "extract('minute', e.ts)": "date_part('minute', ts)",
    "epoch_ms(e.ts)": "epoch_us(ts) // 1000",
    "epoch_ms(epoch_ms(e.ts))": "date_trunc('milliseconds', ts)",
    "from_epoch_ms(epoch_ms(e.ts))": "date_trunc('milliseconds', ts)",
    "epoch_secs(e.ts)": "floor(epoch(ts))::BIGINT",
    "from_epoch(epoch_secs(e.ts))": "date_trunc('second', ts)",
    "from_epoch_us(to_epoch_us(e.ts))": "date_trunc('milliseconds', ts)",
    "epoch_us(e.ts)": "epoch_us(ts) // 1000 * 1000",
    "strftime('yyyy-MM-dd HH:mm', e.ts)": "strftime(ts, '%Y-%m-%d %H:%M')",
    "date_format('%Y/%m', e.ts)": "strftime(ts, '%Y/%m')",
    "to_epoch_ms(e.ts)": "epoch_us(ts) // 1000",
    "epoch_ms_from_timestamp(e.ts)": "epoch_us(ts) // 1000",
    "ms_to_timestamp(to_epoch_ms(e.ts))": "date_trunc('milliseconds', ts)",
    "to_epoch_us(e.ts)": "epoch_us(ts)",
    "epoch_us_from_timestamp(e.ts)": "epoch_us(ts)",
    "us_to_timestamp(to_epoch_us(e.ts))": "ts",
    "to_epoch_s(e.ts)": "floor(epoch(ts))::BIGINT",
    "epoch_s_from_timestamp(e.ts)": "floor(epoch(ts))::BIGINT",
    "epoch_s(to_epoch_s(e.ts))": "date_trunc('second', ts)",
    "timestamp_add('hour', 5, e.ts)": "ts + INTERVAL 5 HOUR",
    "timestamp_add('month', 1, date(e.ts))": "ts::DATE + INTERVAL 1 MONTH",
    "timestamp_diff('day', e.ts, timestamp('2023-01-01'))": "floor(epoch_us(ts - TIMESTAMP '2023-01-01') / 86400000000)::BIGINT",
    "timestamp_year(e.ts)": "year(ts)",
    "timestamp_month(e.ts)": "month(ts)",
    "timestamp_day(e.ts)": "day(ts)",
    "timestamp_hour(e.ts)": "hour(ts)",
    "timestamp_minute(e.ts)": "minute(ts)",
    "timestamp_second(e.ts)": "second(ts)",
    "timestamp_millisecond(e.ts)": "millisecond(ts) % 1000",
    "e.ts + to_years(1)": "ts + INTERVAL 1 YEAR",
    "e.ts + to_months(2)": "ts + INTERVAL 2 MONTH",
    "e.ts + to_days(3)": "ts + INTERVAL 3 DAY",
    "e.ts - to_hours(4)": "ts - INTERVAL 4 HOUR",
    "e.ts + to_minutes(5)": "ts + INTERVAL 5 MINUTE",
    "e.ts + to_seconds(6)": "ts + INTERVAL 6 SECOND",
    "e.ts + to_milliseconds(7)": "ts + INTERVAL 7 MILLISECOND",
    "e.ts + to_microseconds(8)": "ts + INTERVAL 8 MICROSECOND",
    "e.ts + to_interval('2 days')": "ts + INTERVAL 2 DAY",
    "e.ts + duration('1 hour')": "ts + INTERVAL 1 HOUR",
    "now() >= e.ts": "true",
    "current_timestamp() >= getdate()": "true",
    "utc_timestamp() >= e.ts": "true",
    "today() = current_date()": "true",
    "date_diff('day', yesterday(), tomorrow())": "2::BIGINT",
    "size(current_time())": "8::BIGINT",
})

CASTS = wide(*_PART, {
    **{f"{f}(p.p_retailprice)": "trunc(p_retailprice)::BIGINT" for f in ("tointeger", "toint", "int", "to_int", "to_serial", "int64", "bigint", "to_int64")},
    **{f"{f}(p.p_retailprice)": "trunc(p_retailprice)::INTEGER" for f in ("to_int32", "int32", "integer")},
    **{f"{f}(p.p_size)": "p_size::SMALLINT" for f in ("to_int16", "int16", "smallint", "to_uint8", "uint8", "utinyint")},
    **{f"{f}(p.p_size)": "p_size::TINYINT" for f in ("to_int8", "int8", "tinyint")},
    **{f"to_string({f}(p.p_partkey))": "p_partkey::VARCHAR" for f in ("to_uint64", "uint64", "ubigint", "to_int128", "to_uint128")},
    **{f"{f}(p.p_partkey)": "p_partkey" for f in ("to_uint32", "uint32", "uinteger")},
    **{f"{f}(p.p_partkey)": "p_partkey::INTEGER" for f in ("to_uint16", "uint16", "usmallint")},
    **{f"{f}(p.p_size)": "p_size::FLOAT" for f in ("to_float32", "float32", "real32")},
    **{f"{f}(p.p_size)": "p_size::DOUBLE" for f in ("tofloat", "to_float", "todouble", "double", "decimal")},
    **{f"{f}(p.p_size)": "p_size::VARCHAR" for f in ("tostring", "str", "varchar", "string")},
    "to_uint128(0 - p.p_size)": "NULL::DECIMAL(38, 0)",
    "to_uuid('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11')": "'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11'",
    "string_to_uuid(p.p_name)": "NULL::VARCHAR",
    "uuid_to_string(to_uuid('a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11'))": "'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11'",
    "uuid_version(gen_random_uuid())": "4::BIGINT",
    "size(uuid())": "36::BIGINT",
    "pg_typeof(p.p_size)": "'INT32'",
    "octet_length(blob(p.p_name))": "octet_length(p_name::BLOB)::BIGINT",
})

_L = "[p.p_size, 5, 9, 5]"
_l = "[p_size, 5, 9, 5]"
_LISTS = {
    "list_creation(p.p_size, 5)": "[p_size, 5]",
    "list_element([1, p.p_size], 2)": "p_size",
    "list_extract([1, p.p_size], -1)": "p_size",
    f"list_slice_from({_L}, 3)": f"list_slice({_l}, 3, 4)",
    f"list_concat({_L}, [1])": f"list_concat({_l}, [1])",
    f"list_cat({_L}, [2])": f"list_concat({_l}, [2])",
    f"list_reverse_sort({_L})": f"list_reverse_sort({_l})",
    f"list_sort_desc({_L})": f"list_reverse_sort({_l})",
    f"list_has_all({_L}, [9, 5])": f"list_has_all({_l}, [9, 5])",
    f"list_has_any({_L}, [1, 24])": f"list_has_any({_l}, [1, 24])",
    "list_sort(list_union([p.p_size, 5], [5, 100]))": "list_sort(list_distinct([p_size, 5, 100]))",
    "list_intersect([p.p_size, 5], [5, 100])": "[5]",
    f"list_product({_L})": "p_size * 225.0::DOUBLE",
    f"list_prepend({_L}, 0)": f"list_prepend(0, {_l})",
    f"list_remove_all({_L}, 5)": f"list_filter({_l}, lambda x: x <> 5)",
    "list_flatten([[p.p_size], [1, 2]])": "[p_size, 1, 2]",
    "list_any_value([null, p.p_size])": "p_size",
    "array_value(p.p_size, 1)": "[p_size, 1]",
    f"array_extract({_L}, 1)": "p_size::DOUBLE",
    f"array_element({_L}, 3)": "9::DOUBLE",
    f"array_contains({_L}, 9)": "true",
    f"array_has({_L}, 50)": "p_size = 50",
    f"array_min({_L})": f"list_min({_l})::DOUBLE",
    f"array_max({_L})": f"list_max({_l})::DOUBLE",
    f"array_sum({_L})": "p_size + 19::DOUBLE",
    f"array_avg({_L})": "(p_size + 19) / 4",
    f"array_concat({_L}, [3])": f"list_concat({_l}, [3])",
    f"array_push_front({_L}, 3)": f"list_prepend(3, {_l})",
    f"array_append({_L}, 3)": f"list_append({_l}, 3)",
    f"array_push_back({_L}, 4)": f"list_append({_l}, 4)",
    f"array_pop_front({_L})": "[5, 9, 5]",
    f"array_pop_back({_L})": "[p_size, 5, 9]",
    f"array_reverse({_L})": f"list_reverse({_l})",
    "list_sort(array_unique([p.p_size, 5, 5]))": "list_sort(list_distinct([p_size, 5]))",
    f"list_apply({_L}, x -> x + 1)": f"list_transform({_l}, lambda x: x + 1)",
    f"array_apply({_L}, x -> x * 2)": f"list_transform({_l}, lambda x: x * 2)",
    "array_cross_product([1, 2, p.p_size], [4, 5, 6])": "[12.0 - 5 * p_size, 4.0 * p_size - 6, -3.0]::DOUBLE[]",
    "map_values(map(['a', 'b'], [p.p_size, 2]))": "[p_size, 2]",
    "map_entries(map(['a'], [p.p_size]))": "[{'key': 'a', 'value': p_size}]",
    "union_extract(union_value(p.p_size, 'num'), 'num')": "p_size",
    "list_has_any([p.p_size], [])": "false",
}
LISTS = wide(*_PART, {x: y for x, y in _LISTS.items() if not x.startswith("array")})
ARRAYS = wide(*_PART, {x: y for x, y in _LISTS.items() if x.startswith("array")})

VECTORS = wide("MATCH (v:Vector)", "v.vec_id", "embeddings", {
    "round(array_squared_distance(v.embedding, list_reverse(v.embedding)), 9)": "round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9)",
    "round(array_l1_distance(v.embedding, list_reverse(v.embedding)), 9)": "round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda x: abs(x[1] - x[2]))), 9)",
    "round(array_cosine_distance(v.embedding, list_reverse(v.embedding)), 9)": "round(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 9)",
})

UTILITY = wide(*_PART, {
    "ifnull(nullif(p.p_size, 5), 0)": "coalesce(nullif(p_size, 5), 0)",
    "nvl(nullif(p.p_size, 7), -1)": "coalesce(nullif(p_size, 7), -1)",
    "nvl2(nullif(p.p_size, 5), 'some', 'none')": "CASE WHEN p_size <> 5 THEN 'some' ELSE 'none' END",
    "random() < 1.0": "true",
    "rand() >= 0.0": "true",
    "random_int(p.p_size) < p.p_size": "true",
    "hash(p.p_name) = hash(p.p_name)": "true",
    "crc32('a')": "3904355907::BIGINT",
    "version()": "'0.1'",
    "db_version()": "'0.1'",
    "gds_version()": "'0.1'",
    "catalog_version()": "1::BIGINT",
    "sleep(p.p_size)": "p_size",
    "bool_and(p.p_size > 5, p.p_size < 20)": "p_size > 5 AND p_size < 20",
    "bool_or(p.p_size > 30, p.p_size < 20)": "p_size > 30 OR p_size < 20",
    "constant_or_null(p.p_name, nullif(p.p_size, 5))": "CASE WHEN p_size <> 5 THEN p_name END",
    "CASE WHEN p.p_size < 0 THEN error('negative') ELSE 'fine' END": "'fine'",
    "show_tables_count()": "17::BIGINT",
    "table_type('Part')": "'NODE'",
    "table_type('PLACED')": "'REL'",
    "show_functions_contains('cbrt')": "true",
    "show_functions_contains('nothing')": "false",
    "storage_info('Part')": "'parquet'",
    "struct_extract(file_info('/nowhere/at/all'), 'exists')": "false",
    "copy_to_csv('a.csv')": "'a.csv'",
    "copy_to_parquet('a')": "'a'",
    "copy_to_json('b')": "'b'",
    "export_csv('c')": "'c'",
    "export_parquet('d')": "'d'",
    "internal_id('Part', p.p_partkey)": "'Part:' || p_partkey",
    "tableid(p)": "'Part'",
    "table_id(internal_id('Part', p.p_partkey))": "'Part'",
    "offsetid(p)": "p_partkey::VARCHAR",
    "offset_id(p)": "p_partkey::VARCHAR",
    "nodeoffset(p)": "p_partkey::VARCHAR",
    "node_offset(id(p))": "p_partkey::VARCHAR",
    "internal_id_equal(id(p), internal_id('Part', p.p_partkey))": "true",
    "struct_extract(properties(p), 'p_brand')": "p_brand",
    "keys(properties(p))": "['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']",
})

SETTINGS = wide(*_NATION, {
    "set_setting('limit', 5)": "5",
    "current_setting('limit')": "5",
    "nextval('s')": "1::BIGINT",
    "currval('s')": "1::BIGINT",
    "setval('s', 10)": "10",
    "nextval('s') - 10": "1::BIGINT",
})

QUERIES: dict[str, tuple[str, str]] = {
    "functions_numbers_all": NUMBERS, "functions_texts_all": TEXTS, "functions_dates_all": DATES, "functions_casts_all": CASTS, "functions_lists_all": LISTS, "functions_arrays_all": ARRAYS,
    "functions_vectors_all": VECTORS, "functions_utility_all": UTILITY, "functions_settings": SETTINGS,
}


def register(text: Callable[..., None]) -> None:
    for name, (query, sql) in QUERIES.items():
        text(name, query, sql)
