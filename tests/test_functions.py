"""Scalar functions, value by value."""

from __future__ import annotations

import datetime
import math

import pytest

from pelagraph.session import GraphSession

D, TS = datetime.date, datetime.datetime
CASES = {
    # numbers
    "7 / 2": 3, "-7 / 2": -3, "7.0 / 2": 3.5, "round(2.5)": 2.0, "round(3.5)": 4.0, "sign(-3)": -1, "log(1000)": 3.0, "ln(e())": 1.0, "even(7)": 6, "cbrt(27)": 3.0,
    "gcd(12, 18)": 6, "lcm(4, 6)": 12, "factorial(5)": 120, "bit_count(7)": 3, "isnan(nan())": True, "isinf(infinity())": True, "isfinite(1.0)": True,
    "gamma(5)": 24.0, "lgamma(5)": math.log(24), "bitwise_xor(6, 3)": 5, "bitshift_right(8, 2)": 2, "2 ^ 10": 1024.0, "atan2(1, 1)": math.pi / 4, "square(3)": 9, "7 % -4": 3,
    # texts
    "substring('hello', 1, 3)": "ell", "substring('hello', -3)": "llo", "split_part('a-b-c', '-', 2)": "b", "split_part('a', '-', 5)": "", "position('hello', 'l')": 3,
    "lpad('ab', 5, '*')": "***ab", "rpad('ab', 5, '*')": "ab***", "concat('a', null)": "a", "concat_ws(',', 'a', null, 'b')": "a,,b", "regexp_extract('ab12', '[0-9]+')": "12",
    "regexp_extract('ab', '[0-9]+')": None, "regexp_full_match('abc', 'a.c')": True, "regexp_matches('xabc', 'b')": True, "regexp_extract_all('a1b2', '[0-9]')": ["1", "2"],
    "split('a.b', '.')": ["a", "b"], "size('abc')": 3, "ascii('A')": 65, "chr(66)": "B", "levenshtein('kitten', 'sitting')": 3, "initcap('ab cd')": "Ab Cd",
    "base64_decode(base64_encode('hi'))": "hi", "url_encode('a b/c')": "a%20b%2Fc", "url_decode('a%20b')": "a b", "to_hex(255)": "ff", "from_hex('ff')": 255, "repeat('ab', 2)": "abab",
    "trim('\\t x ')": "x", "reverse('abc')": "cba", "'a' STARTS WITH 'a'": True, "format('%s-%d', 'x', 3)": "x-3", "left('abc', 2)": "ab", "right('abc', 2)": "bc", "octet_length(encode('é'))": 2,
    "string_agg('a', 'b', '-')": "a-b--", "bit_length('ab')": 16,
    # dates
    "year('2024-02-29')": 2024, "dayofweek('2024-03-03')": 0, "week('2024-01-01')": 1, "quarter('2024-05-01')": 2, "date_diff('day', '2024-01-01', '2024-01-31')": 30,
    "date_diff('month', '2024-01-31', '2024-03-01')": 2, "timestamp_diff('hour', '2024-01-02', '2024-01-01')": 24, "date_part('year', '2024-01-01')": 2024,
    "date_trunc('month', '2024-05-17')": TS(2024, 5, 1), "date_add('month', '2024-01-31', 1)": TS(2024, 2, 29), "last_day('2024-02-10')": D(2024, 2, 29), "dayname('2024-03-03')": "Sunday",
    "monthname('2024-03-03')": "March", "century('2001-01-01')": 21, "make_date(2024, 2, 30)": None, "make_date(2024, 2, 3)": D(2024, 2, 3), "epoch('1970-01-02')": 86400, "epoch_ms('1970-01-01 00:00:01')": 1000,
    "from_epoch_ms(1500)": TS(1970, 1, 1, 0, 0, 1, 500000), "strftime('yyyy/MM', '2024-05-17')": "2024/05", "strftime('%Y-%m', '2024-05-17')": "2024-05", "date('nonsense')": None,
    "millisecond('2024-01-01 00:00:00.123')": 123, "make_timestamp(2024, 1, 2)": TS(2024, 1, 2), "interval('1 year 2 months 3 days 4 hours').months": 14, "interval('36 hours').micros": 129_600_000_000,
    "date('2024-01-31') + interval('1 month')": TS(2024, 2, 29), "(date('2024-03-01') - date('2024-02-01')).days": 29, "hour(to_hours(5))": 5,
    # casts
    "to_int64('12.7')": 12, "to_int64('x')": None, "to_int64(-3.9)": -3, "to_bool('false')": False, "to_bool('yes')": True, "to_string(5)": "5", "CAST('7' AS INT32)": 7, "cast('1.5', 'DOUBLE')": 1.5,
    "to_uuid('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11')": "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", "to_uuid('zz')": None, "uuid_version('a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11')": 4, "typeof(1.5)": "DOUBLE", "typeof([1])": "LIST",
    "decode(blob('6869'))": "hi", "to_uint128(-1)": None,
    # lists
    "list_extract([1, 2, 3], -1)": 3, "list_extract([1], 5)": None, "list_contains([1, null], null)": True, "list_position([5, 6], 7)": 0, "list_slice([1, 2, 3, 4], 2, 9)": [2, 3, 4], "range(5, 1)": [],
    "range(1, 5, 2)": [1, 3, 5], "list_sort([3, null, 1])": [None, 1, 3], "list_sort_desc([3, null, 1])": [3, 1, None], "list_sum([])": 0.0, "list_avg([])": None, "list_product([2, 3])": 6.0, "list_remove([1, 2, 1], 1)": [2, 1],
    "list_remove_all([1, 2, 1], 1)": [2], "list_except([1, 1, 2], [2])": [1, 1], "list_flatten([[1], [2, 3]])": [1, 2, 3], "list_to_string([1, null, 2], '-')": "1--2", "list_any_value([null, 4])": 4, "list_has_all([1, 2], [2])": True,
    "list_has_any([1], [2])": False, "array_pop_front([1, 2])": [2], "array_pop_back([1, 2])": [1], "[1, 2] + [3]": [1, 2, 3], "list_prepend([1], 0)": [0, 1], "array_cross_product([1, 0, 0], [0, 1, 0])": [0.0, 0.0, 1.0],
    "array_cosine_similarity([1, 0], [0, 0])": 0.0, "array_distance([0, 0], [3, 4])": 5.0, "array_inner_product([1, 2], [1])": None, "list_transform([1, 2], x -> x + 1)": [2, 3], "list_reduce([], (a, x) -> a)": None, "len([1, 2])": 2,
    # maps, structs, utility
    "map_extract(map(['a', 'a'], [1, 2]), 'a')": [1, 2], "map_keys(map(['a'], [1]))": ["a"], "map_size(map([], []))": 0, "struct_extract({a: 1}, 'a')": 1, "union_extract(union_value(3, 'n'), 'n')": 3, "coalesce(null, 2)": 2,
    "nullif(1, 1)": None, "greatest(1, null, 3)": 3, "constant_or_null(1, null)": None, "md5('a')": "0cc175b9c0f1b6a831c399e269772661", "crc32('a')": 3904355907, "csv_quote('a\"b')": '"a""b"', "format_csv_row('a,b', 1, true)": '"a,b",1,true',
    "if(true, 1, 2)": 1, "nvl2(null, 1, 2)": 2, "bool_and(true, null)": False, "equal_null(null, 1)": False, "internal_id('T', 5)": "T:5", "offset('T:5')": "5", "table_id('T:5')": "T", "db_version()": "0.1",
    # JSON
    "json_extract('{\"a\":[10,{\"b\":7}]}', '$.a[1].b')": "7", "json_type('[1]')": "ARRAY", "json_type('-2')": "BIGINT", "json_type('null')": "NULL", "json_valid('{')": False, "json_array_length('[1,2]')": 2, "json_keys('{\"x\":1,\"y\":2}')": ["x", "y"],
    "json_merge_patch('{\"a\":{\"b\":1}}', '{\"a\":{\"b\":null,\"c\":2}}')": '{"a":{"c":2}}', "json_contains('[1,[2]]', '2')": False, "json_structure('[{\"a\":1}]')": '[{"a":"UBIGINT"}]', "json('{ \"a\" : 1 }')": '{"a":1}', "to_json({a: 1})": '{"a":1}', "json_quote('x')": '"x"',
    # text search
    "tokenize('The cats are running')": ["cat", "run"], "stem('relational')": "relat", "stem('ponies')": "poni", "stem('happy')": "happi", "stem('sky')": "sky",
}


@pytest.fixture(scope="module")
def g(spark):
    return GraphSession(spark)


def test_values(g):
    names = {f"c{i}": k for i, k in enumerate(CASES)}
    got: dict = {}
    for at in range(0, len(names), 25):
        part = list(names.items())[at : at + 25]
        got |= g.cypher("RETURN " + ", ".join(f"{k} AS {n}" for n, k in part)).first().asDict()
    wrong = {}
    for n, k in names.items():
        a, b = got[n], CASES[k]
        same = math.isclose(a, b, rel_tol=1e-12) if isinstance(b, float) and a is not None else a == b
        if not same or isinstance(b, bool) != isinstance(a, bool):
            wrong[k] = (a, b)
    assert not wrong


def test_errors(g):
    for q in ("1 / 0", "factorial(21)", "error('x')"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            g.cypher(f"RETURN {q} AS x").collect()
    assert math.isnan(g.cypher("RETURN 1.0 / 0 AS x").first()[0])


def test_random_functions_have_the_right_shape(g):
    r = g.cypher("RETURN random() AS a, random_int(5) AS b, size(gen_random_uuid()) AS c, hash('x') AS d, nextval('s') AS e, nextval('s') AS f, currval('s') AS h").first()
    assert 0 <= r.a < 1 and 0 <= r.b < 5 and r.c == 36 and isinstance(r.d, int) and (r.e, r.f) == (1, 2)
