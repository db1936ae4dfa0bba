"""Computed expressions against Python's own evaluation of the same text."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from millrace.errors import SpecError
from millrace.functions.expr import compile_expression
from millrace.operators import compute_expression, filter_rows

SCHEMA = "i long, a long, b long, x double, s string, t string, f boolean"
ROWS = [
    (0, 7, 2, 1.5, "abc", "x", True),
    (1, -7, 2, -2.5, " Pad\t", "", False),
    (2, 7, -2, 0.0, "", "bc", True),
    (3, -7, -2, 1e300, "Ünï", "ï", None),
    (4, 0, 0, float("nan"), "aXbX", "X", True),
    (5, None, 3, float("inf"), None, "q", False),
    (6, 5, None, None, "hello world", None, True),
    (7, 10**12, 3, 2.0, "1", "1", False),
    (8, 3, 10**12, -0.1, "bc", "abc", None),
]
EXPRESSIONS = [
    "a + b", "a - b", "a * b", "a / b", "a // b", "a % b", "x // b", "x % b", "a // x", "a % x", "-a", "+a", "-x",
    "a ** 2", "b ** 3", "x ** 2", "a ** -1", "x ** 0.5", "2.0 ** b", "a + x", "x * 2", "a / 2 + x", "f + 1", "a + f",
    "s + t", "s + 'z'", "s + a", "s * 2", "a == b", "a != b", "a < b", "a >= b", "x > 0", "x == x", "x != x", "x < a",
    "a == s", "a != s", "a < s", "s < t", "s == t", "a == None", "a != None", "a is None", "s is not None", "0 < a < 10",
    "a < b < x", "a in [7, -7]", "a not in (0, 5)", "s in ['abc', None]", "a in ['abc']", "t in s", "t not in s",
    "'a' in s", "not a", "not s", "not f", "not x", "f and a > 0", "a > 0 and b > 0", "a > 0 or b > 0", "b > 0 and a / b > 1",
    "b == 0 or a / b > 1", "a or b", "s or t", "a and b", "s and t", "s or 'none'", "a if b else 0", "a if f else x",
    "'pos' if a > 0 else 'neg'", "1 if a / b > 1 else 2", "s[0]", "s[-1]", "s[1:3]", "s[:2]", "s[-2:]", "s[2]", "s.upper()",
    "s.lower()", "s.strip()", "s.lstrip()", "s.rstrip()", "s.strip('ab')", "s.lstrip('a')", "s.rstrip('cX')",
    "s.replace('X', '-')", "s.startswith('a')", "s.endswith('c')", "s.startswith(('a', 'h'))", "s.upper() + t",
    "s.split('b')[0]", "s.split('b')[-1]", "s.split()[0]", "s.split('X')[1]", "s.find('b')", "s.count('X')", "s.capitalize()",
    "f'{a}-{s}'", "f'{x}|{f}'", "f'k{a // b}'", "f''", "s.year", "'b' in s.split('a')", "s.find('b') > 0 and s.count('b') == 1",
    "missing", "missing + 1", "1", "'k'", "None", "True", "2.5", "a > 2.5", "(a + b) * 2 - x / 4", "a.upper()", "s - t",
]


def expected(expression, row):
    """(value, failed) by Python's rules."""
    try:
        return eval(expression, {"__builtins__": {}}, dict(row)), False
    except Exception:
        return None, True


def same(got, want):
    if isinstance(want, complex) or (type(want) is int and abs(want) >= 2**63):
        return got is None  # neither fits a column
    if isinstance(want, float) and isinstance(got, float):
        return (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want, rel=1e-12)
    return got == want


def names():
    return [part.split()[0] for part in SCHEMA.split(",")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_values_match_python(spark, frame):
    compiled = [compile_expression(e, frame.schema)[0].alias(f"r{n}") for n, e in enumerate(EXPRESSIONS)]
    wrong = []
    for got in frame.select("i", *compiled).collect():
        row = dict(zip(names(), ROWS[got["i"]]))
        for n, e in enumerate(EXPRESSIONS):
            want, failed = expected(e, row)
            if not same(got[f"r{n}"], None if failed else want):
                wrong.append((e, row, got[f"r{n}"], want))
    assert not wrong, '\n'.join(map(str, wrong))


def test_failed_rows_keep_the_old_value(frame):
    got = {r["i"]: r["x"] for r in compute_expression(frame, "x", "a / b").collect()}
    assert got[0] == 3.5
    assert math.isnan(got[4])  # division by zero: old value
    assert got[6] is None  # b is missing and so was x


def test_unknown_name_changes_nothing(frame):
    assert compute_expression(frame, "x", "nope + 1").collect()[0]["x"] == 1.5
    for text in ("nope * 2", "-nope", "nope > 1", "a.upper()", "s - 1"):
        assert compute_expression(frame, "a", text).schema["a"] == frame.schema["a"]
    assert compute_expression(frame, "new", "nope + 1").collect()[0]["new"] is None


@pytest.mark.parametrize(
    "text",
    ["len(s)", "__import__('os')", "s.format(a)", "[c for c in s]", "lambda: 1", "a +", "s.replace('', 'x')", "a & b", "f'{a:>5}'", "f'{a!r}'", "s.split('')", "s.upper('x')", "s.count('')", "a + 99999999999999999999", "b'x'"],
)
def test_unsupported_expressions_are_refused_when_built(frame, text):
    with pytest.raises(SpecError):
        compute_expression(frame, "new", text)


def test_large_powers_stay_exact(spark):
    frame = spark.createDataFrame([(2,), (-2,), (-1,), (3,), (None,)], "a long")
    for power in (17, 39, 62, 63, 64, 101):
        out = compute_expression(frame, "p", f"a ** {power}")
        assert dict(out.dtypes)["p"] == "bigint"
        want = {a: a**power if -(2**63) <= a**power < 2**63 else None for a in (2, -2, -1, 3)}
        assert {r["a"]: r["p"] for r in out.collect()} == {**want, None: None}


@pytest.mark.parametrize("text", ["a > 2", "s", "f", "a / b > 1", "s and a > 0", "not f", "x", "a == None", "s.startswith('a') or a < 0"])
def test_filters_keep_what_python_keeps(frame, text):
    kept = {r["i"] for r in filter_rows(frame, text).collect()}
    want = set()
    for row in ROWS:
        value, failed = expected(text, dict(zip(names(), row)))
        if not failed and value:
            want.add(row[0])
    assert kept == want


def test_nested_fields(spark):
    df = spark.sql(
        "SELECT named_struct('k', 3, 'n', named_struct('z', 'q')) AS p, map('u', 1.5D) AS m, array(4, 5) AS v, "
        "TIMESTAMP_NTZ'2024-02-03 04:05:06' AS t, DATE'2023-01-09' AS d"
    )
    for text, want in (("m.get('u')", 1.5), ("m.get('gone')", None), ("m.get('gone') or 2.5", 2.5), ("p.get('k')", 3), ("t.year * 100 + t.month", 202402), ("t.hour", 4), ("d.day", 9), ("d.hour", None), ("t > t", False), ("t.year - d.year", 1),
        ("p['k'] + 1", 4), ("p['n']['z']", "q"), ("m['u']", 1.5), ("m['gone']", None), ("v[0]", 4), ("v[-1]", 5), ("v[9]", None), ("4 in v", True)):
        assert compute_expression(df, "r", text).first()["r"] == want


numbers = st.one_of(st.none(), st.integers(-(10**6), 10**6))
leaf = st.sampled_from(["a", "b", "x", "1", "-3", "0", "2.5"])
arithmetic = st.recursive(
    leaf, lambda inner: st.tuples(inner, st.sampled_from(["+", "-", "*", "/", "//", "%"]), inner).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), max_leaves=5
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(arithmetic, st.lists(st.tuples(numbers, numbers, st.one_of(st.none(), st.floats(-1e6, 1e6))), min_size=1, max_size=6))
def test_random_arithmetic(spark, text, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, a long, b long, x double")
    got = {r["i"]: r["v"] for r in df.select("i", compile_expression(text, df.schema)[0].alias("v")).collect()}
    for i, (a, b, x) in enumerate(data):
        want, failed = expected(text, {"a": a, "b": b, "x": x})
        if failed or want is None:
            assert got[i] is None, (text, data[i])
        elif abs(want) < 2**62:
            assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9), (text, data[i])
