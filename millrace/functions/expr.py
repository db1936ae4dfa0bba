"""Computed-field expressions in Python notation, expressed as Spark columns.

``ast.parse`` reads the text once on the driver; each node becomes a Column, so the expression runs inside
generated JVM code. A row on which the Python expression would raise yields NULL.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from .casts import python_str, truthy

_LITERAL_TYPES = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
_NUMERIC = (T.LongType, T.DoubleType, T.BooleanType)
_SPACES = r"[\s\x1c-\x1f\x85   -     　]+"


@dataclass(frozen=True)
class _Value:
    column: Column
    type: T.DataType
    field: bool = False  # a plain field: NULL is the value None, not an error
    literal: bool = False

    def truth(self) -> Column:
        test = truthy(self.column, self.type)
        return F.coalesce(test, F.lit(False)) if self.field else test


def _widen(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    if isinstance(data_type, (T.FloatType, T.DecimalType)):
        return T.DoubleType()
    return data_type


def _is(value: _Value, *classes) -> bool:
    return isinstance(value.type, classes)


def _null(data_type: T.DataType | None = None) -> _Value:
    data_type = data_type or T.NullType()
    return _Value(F.lit(None).cast(data_type), data_type)


def _as_number(value: _Value) -> _Value:
    if _is(value, T.BooleanType):
        return _Value(value.column.cast("bigint"), T.LongType(), value.field)
    return value


def _as_double(value: _Value) -> Column:
    return value.column.cast("double")


def _sign_differs(a: Column, b: Column) -> Column:
    return (a < 0) != (b < 0)


def _floor_mod(a: _Value, b: _Value) -> Column:
    """Remainder with the sign of the divisor."""
    divisor = F.nullif(b.column, F.lit(0).cast(b.type))
    rest = a.column % divisor
    return F.when((rest != 0) & _sign_differs(rest, b.column), rest + b.column).otherwise(rest)


def _floor_div(a: _Value, b: _Value) -> Column:
    if _is(a, T.LongType) and _is(b, T.LongType):
        # -1 is handled apart: the smallest long has no positive counterpart
        safe = F.when(~b.column.isin(0, -1), b.column)
        quotient = F.call_function("div", a.column, safe)
        inexact = (a.column % safe != 0) & _sign_differs(a.column, b.column)
        return F.when(b.column == -1, F.try_subtract(F.lit(0).cast("bigint"), a.column)).otherwise(
            F.when(inexact, quotient - 1).otherwise(quotient)
        )
    return F.rint((_as_double(a) - _floor_mod(a, b)) / F.nullif(_as_double(b), F.lit(0.0)))


def _power(a: _Value, b: _Value, exponent: object) -> _Value:
    if _is(a, T.LongType) and isinstance(exponent, int) and exponent >= 0:
        one = F.lit(1).cast("bigint")
        if exponent > 63:  # only -1, 0 and 1 stay within 64 bits
            sign = F.lit(-1 if exponent % 2 else 1).cast("bigint")
            return _Value(F.when(a.column.isin(0, 1), a.column).when(a.column == -1, sign), T.LongType())
        result, square = F.when(a.column.isNotNull(), one), a.column
        while exponent:
            if exponent % 2:
                result = F.try_multiply(result, square)
            exponent //= 2
            if exponent:
                square = F.try_multiply(square, square)
        return _Value(result, T.LongType())
    base, power = _as_double(a), _as_double(b)
    result = F.pow(base, power)
    undefined = ((base == 0) & (power < 0)) | (F.isnan(result) & ~F.isnan(base) & ~F.isnan(power)) | (
        (F.abs(result) == float("inf")) & (F.abs(base) != float("inf")) & (F.abs(power) != float("inf"))
    )
    return _Value(F.when(~undefined, result), T.DoubleType())


def _arithmetic(op: ast.operator, left: _Value, right: _Value, right_node: ast.expr) -> _Value:
    if isinstance(op, ast.Add) and _is(left, T.StringType) and _is(right, T.StringType):
        return _Value(F.concat(left.column, right.column), T.StringType())
    if isinstance(op, ast.Mult):
        for text, times in ((left, right), (right, left)):
            if _is(text, T.StringType) and _is(times, T.LongType, T.BooleanType):
                return _Value(F.repeat(text.column, times.column.cast("int")), T.StringType())
    if not (_is(left, *_NUMERIC) and _is(right, *_NUMERIC)):
        return _null()  # an error on every row
    a, b = _as_number(left), _as_number(right)
    if isinstance(op, ast.Div):
        return _Value(F.try_divide(_as_double(a), _as_double(b)), T.DoubleType())
    whole = _is(a, T.LongType) and _is(b, T.LongType)
    if not whole and not isinstance(op, ast.Pow):
        a, b = _Value(_as_double(a), T.DoubleType()), _Value(_as_double(b), T.DoubleType())
    kind = T.LongType() if whole else T.DoubleType()
    if isinstance(op, ast.Add):
        return _Value(F.try_add(a.column, b.column), kind)
    if isinstance(op, ast.Sub):
        return _Value(F.try_subtract(a.column, b.column), kind)
    if isinstance(op, ast.Mult):
        return _Value(F.try_multiply(a.column, b.column), kind)
    if isinstance(op, ast.Mod):
        return _Value(_floor_mod(a, b), kind)
    if isinstance(op, ast.FloorDiv):
        return _Value(_floor_div(a, b), kind)
    if isinstance(op, ast.Pow):
        try:
            exponent = ast.literal_eval(right_node)
        except ValueError:
            exponent = None
        return _power(a, b, exponent)
    raise SpecError(f"operator {type(op).__name__} is not supported in expressions")


def _same_family(left: _Value, right: _Value) -> bool:
    if _is(left, *_NUMERIC) and _is(right, *_NUMERIC):
        return True
    return type(left.type) is type(right.type)


def _comparable(left: _Value, right: _Value) -> tuple[Column, Column]:
    """Both columns on one type."""
    if _is(left, T.DoubleType) or _is(right, T.DoubleType):
        return _as_double(left), _as_double(right)
    return _as_number(left).column, _as_number(right).column


def _unless_nan(test: Column, value: _Value) -> Column:
    """False where ``value`` is NaN: Python's NaN equals and orders with nothing, Spark's is the greatest number."""
    if not _is(value, T.DoubleType) or value.literal:
        return test
    return test & ~F.isnan(value.column)


def _equal(left: _Value, right: _Value) -> Column:
    for one, other in ((left, right), (right, left)):
        if _is(one, T.NullType):
            return other.column.isNull() if other.field or _is(other, T.NullType) else F.lit(False)
    if not _same_family(left, right):
        result = left.column.isNull() & right.column.isNull()  # None equals None whatever the columns hold
    else:
        a, b = _comparable(left, right)
        result = a.eqNullSafe(b)
        if not left.literal and not right.literal:
            result = _unless_nan(_unless_nan(result, left), right)
    for value in (left, right):
        if not value.field and not value.literal:
            result = F.when(value.column.isNotNull(), result)
    return result


_ORDERINGS = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def _all_of(tests: list[Column]) -> Column:
    """Left-to-right conjunction: a NULL test hides everything after it."""
    result = tests[-1]
    for test in reversed(tests[:-1]):
        result = F.when(test, result).when(~test, F.lit(False))
    return result


class _Known(ast.expr):
    """A node whose value has been worked out already."""

    def __init__(self, value: _Value):
        super().__init__()
        self.known = value


def _strip(pattern: str, by_characters):
    def build(text, characters=None):
        if characters is None:
            return F.regexp_replace(text, pattern.format(_SPACES), "")
        return by_characters(text, F.lit(characters)) if isinstance(characters, str) else None

    return build


def _replace(text, old=None, new=None):
    return F.replace(text, F.lit(old), F.lit(new)) if old and isinstance(new, str) else None


def _affix(test):
    def build(text, options=None):
        if options is None:
            return None
        options = options if isinstance(options, tuple) else (options,)
        found = reduce(lambda a, b: a | b, [getattr(text, test)(F.lit(o)) for o in options], F.lit(False))
        return F.when(text.isNotNull(), found)

    return build


def _split(text, separator=None):
    if separator is None:
        bare = F.regexp_replace(text, "^{0}|{0}$".format(_SPACES), "")
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))
    return F.split(text, rf"\Q{separator}\E") if separator and "\\E" not in separator else None


def _find(text, part=None):
    return (F.locate(part, text) - 1).cast("bigint") if isinstance(part, str) else None


def _count(text, part=None):
    if not part:
        return None
    gone = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return (gone / len(part)).cast("bigint")


_TEXT, _FLAG, _WHOLE = T.StringType(), T.BooleanType(), T.LongType()
# Result type and builder of each string method; a builder returns None for arguments it has no use for.
_METHODS = {
    "upper": (_TEXT, lambda text: F.upper(text)),
    "lower": (_TEXT, lambda text: F.lower(text)),
    "capitalize": (_TEXT, lambda text: F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))),
    "strip": (_TEXT, _strip("^{0}|{0}$", F.btrim)),
    "lstrip": (_TEXT, _strip("^{0}", F.ltrim)),
    "rstrip": (_TEXT, _strip("{0}$", F.rtrim)),
    "replace": (_TEXT, _replace),
    "startswith": (_FLAG, _affix("startswith")),
    "endswith": (_FLAG, _affix("endswith")),
    "split": (T.ArrayType(_TEXT), _split),
    "find": (_WHOLE, _find),
    "count": (_WHOLE, _count),
}

_DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}
_TIME_PARTS = {"hour": F.hour, "minute": F.minute, "second": F.second}


class _Compiler(ast.NodeVisitor):
    def __init__(self, schema: T.StructType, strict: bool = False):
        self.strict = strict  # refuse what would be an error on every row
        self.types = {f.name: _widen(f.dataType) for f in schema.fields}
        self.raw = {f.name: f.dataType for f in schema.fields}

    def generic_visit(self, node):
        raise SpecError(f"{type(node).__name__} is not supported in expressions")

    def visit_Constant(self, node):
        value = node.value
        if value is None:
            return _Value(F.lit(None), T.NullType(), field=True)
        data_type = _LITERAL_TYPES.get(type(value))
        if data_type is None or (type(value) is int and abs(value) >= 2**63):
            raise SpecError(f"literal {value!r} is not supported in expressions")
        return _Value(F.lit(value).cast(data_type), data_type, literal=True)

    def visit_Name(self, node):
        if node.id not in self.types:
            if self.strict:
                raise SpecError(f"unknown field {node.id!r}; one of {', '.join(self.types)}")
            return _null()  # an unknown name is an error on every row
        column = col(node.id)
        widened = self.types[node.id]
        return _Value(column if widened == self.raw[node.id] else column.cast(widened), widened, field=True)

    def visit_BinOp(self, node):
        return _arithmetic(node.op, self.visit(node.left), self.visit(node.right), node.right)

    def visit_UnaryOp(self, node):
        value = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return _Value(~value.truth(), T.BooleanType())
        if not _is(value, *_NUMERIC):
            return _null()
        number = _as_number(value)
        if isinstance(node.op, ast.UAdd):
            return _Value(number.column, number.type)
        if isinstance(node.op, ast.USub):
            if _is(number, T.DoubleType):
                return _Value(-number.column, number.type)
            return _Value(F.try_subtract(F.lit(0).cast("bigint"), number.column), number.type)
        raise SpecError(f"operator {type(node.op).__name__} is not supported in expressions")

    def visit_BoolOp(self, node):
        values = [self.visit(v) for v in node.values]
        keep_left = isinstance(node.op, ast.Or)
        result = values[-1]
        for left in reversed(values[:-1]):
            try:
                left, result = self._unify(left, result)
            except SpecError:  # no common type: only the truth of each side matters
                left, result = (_Value(v.truth(), T.BooleanType()) for v in (left, result))
            first, second = (left, result) if keep_left else (result, left)
            test = left.truth()
            result = _Value(F.when(test, first.column).when(~test, second.column), result.type, left.field and result.field)
        return result

    def visit_IfExp(self, node):
        test = self.visit(node.test).truth()
        then, otherwise = self._unify(self.visit(node.body), self.visit(node.orelse))
        return _Value(F.when(test, then.column).when(~test, otherwise.column), then.type, then.field and otherwise.field)

    def _unify(self, left: _Value, right: _Value) -> tuple[_Value, _Value]:
        if type(left.type) is type(right.type):
            return left, right
        for one, other, flip in ((left, right, False), (right, left, True)):
            if _is(one, T.NullType):
                cast = _Value(one.column.cast(other.type), other.type, one.field)
                return (other, cast) if flip else (cast, other)
        if _is(left, *_NUMERIC) and _is(right, *_NUMERIC):
            target = T.DoubleType() if _is(left, T.DoubleType) or _is(right, T.DoubleType) else T.LongType()
            return tuple(_Value(v.column.cast(target), target, v.field) for v in (left, right))
        raise SpecError(f"branches of types {left.type.simpleString()} and {right.type.simpleString()} do not fit one column")

    def visit_Compare(self, node):
        operands = [self.visit(node.left)]
        tests = []
        for op, right in zip(node.ops, node.comparators):
            left = operands[-1]
            if isinstance(op, (ast.In, ast.NotIn)):
                test = self._contains(left, right)
                tests.append(~test if isinstance(op, ast.NotIn) else test)
                continue
            operands.append(self.visit(right))
            tests.append(self._compare(op, left, operands[-1]))
        if any(_is(o, T.NullType) and not o.field for o in operands):
            return _null()
        return _Value(_all_of(tests), T.BooleanType())

    def _compare(self, op, left: _Value, right: _Value) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not _is(right, T.NullType):
                raise SpecError("'is' is supported only with None")
            test = _equal(left, right)
            return ~test if isinstance(op, ast.IsNot) else test
        if isinstance(op, ast.Eq):
            return _equal(left, right)
        if isinstance(op, ast.NotEq):
            return ~_equal(left, right)
        if _is(left, T.NullType) or _is(right, T.NullType) or not _same_family(left, right):
            if self.strict and not _is(left, T.NullType) and not _is(right, T.NullType):
                raise SpecError(f"{left.type.simpleString()} and {right.type.simpleString()} have no order")
            return F.lit(None).cast("boolean")
        greater = left if isinstance(op, (ast.Gt, ast.GtE)) else right
        return _unless_nan(_ORDERINGS[type(op)](*_comparable(left, right)), greater)

    def _contains(self, left: _Value, right: ast.expr) -> Column:
        if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
            found = F.lit(False)
            for item in right.elts:
                found = found | _equal(left, self.visit(item))
            return found
        box = self.visit(right)
        if _is(box, T.StringType) and _is(left, T.StringType):
            return F.contains(box.column, left.column)
        if _is(box, T.ArrayType):
            return F.array_contains(box.column, left.column)
        if _is(box, T.MapType):
            return F.map_contains_key(box.column, left.column)
        return F.lit(None).cast("boolean")

    def visit_JoinedStr(self, node):
        pieces = []
        for part in node.values:
            if isinstance(part, ast.Constant):
                pieces.append(F.lit(part.value))
                continue
            if part.format_spec is not None or part.conversion != -1:
                raise SpecError("format specifications are not supported in expressions")
            value = self.visit(part.value)
            text = python_str(value.column, value.type)
            pieces.append(F.coalesce(text, F.lit("None")) if value.field else text)
        return _Value(F.concat(*pieces) if pieces else F.lit(""), T.StringType())

    def visit_Attribute(self, node):
        value = self.visit(node.value)
        parts = _DATE_PARTS if _is(value, T.DateType) else {**_DATE_PARTS, **_TIME_PARTS}
        if node.attr not in parts or not _is(value, T.DateType, T.TimestampType, T.TimestampNTZType):
            return _null()  # no such attribute: an error on every row
        return _Value(parts[node.attr](value.column).cast("bigint"), T.LongType())

    def visit_Subscript(self, node):
        value = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            return self._slice(value, node.slice)
        try:
            key = ast.literal_eval(node.slice)
        except ValueError as error:
            raise SpecError("only literal indexes are supported in expressions") from error
        if _is(value, T.StructType) and isinstance(key, str):
            if key not in value.type.names:
                return _null()
            inner = value.type[key].dataType
            return _Value(value.column.getField(key).cast(_widen(inner)), _widen(inner), field=value.field)
        if _is(value, T.MapType) and isinstance(key, str):
            inner = _widen(value.type.valueType)
            return _Value(F.try_element_at(value.column, F.lit(key)).cast(inner), inner)
        if type(key) is not int:
            return _null()
        if _is(value, T.ArrayType):
            inner = _widen(value.type.elementType)
            position = key + 1 if key >= 0 else key
            return _Value(F.try_element_at(value.column, F.lit(position)).cast(inner), inner)
        if _is(value, T.StringType):
            position = key + 1 if key >= 0 else key
            inside = F.length(value.column) >= (position if position > 0 else -position)
            return _Value(F.when(inside, F.substring(value.column, position, 1)), T.StringType())
        return _null()

    def _slice(self, value: _Value, node: ast.Slice) -> _Value:
        try:
            low, high, step = (None if p is None else ast.literal_eval(p) for p in (node.lower, node.upper, node.step))
        except ValueError as error:
            raise SpecError("only literal slices are supported in expressions") from error
        if not _is(value, T.StringType) or step not in (None, 1):
            raise SpecError("only string slices with step 1 are supported in expressions")
        length = F.length(value.column)

        def bound(position, default):
            if position is None:
                return default
            if position < 0:
                return F.greatest(length + F.lit(position), F.lit(0))
            return F.least(length, F.lit(position))

        start, stop = bound(low, F.lit(0)), bound(high, length)
        return _Value(F.substr(value.column, start + 1, F.greatest(stop - start, F.lit(0))), T.StringType())

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Attribute) or node.keywords:
            raise SpecError("only string methods can be called in expressions")
        value = self.visit(node.func.value)
        arguments = []
        for argument in node.args:
            literal = ast.literal_eval(argument) if isinstance(argument, (ast.Constant, ast.Tuple)) else None
            if not isinstance(literal, (str, tuple)):
                raise SpecError("string methods take literal text arguments in expressions")
            arguments.append(literal)
        return self._method(node.func.attr, value, arguments)

    def _method(self, name: str, value: _Value, arguments: list) -> _Value:
        if name == "get" and len(arguments) == 1 and _is(value, T.MapType, T.StructType):
            item = self.visit_Subscript(ast.Subscript(_Known(value), ast.Constant(arguments[0])))
            return _Value(item.column, item.type, field=True)
        if name not in _METHODS:
            raise SpecError(f"method {name!r} is not supported in expressions")
        kind, build = _METHODS[name]
        if not _is(value, T.StringType):
            return _null()
        try:
            result = build(value.column, *arguments)
        except TypeError:  # more arguments than the builder takes
            result = None
        if result is None:
            raise SpecError(f"these arguments of {name!r} are not supported in expressions")
        return _Value(result, kind)

    def visit__Known(self, node):
        return node.known

    def predicate(self, node: ast.expr) -> Column:
        """Truth of a node where only true counts, in a form whose parts Spark can push into a scan."""
        if isinstance(node, ast.BoolOp):
            if isinstance(node.op, ast.And):
                return reduce(lambda a, b: a & b, [self.predicate(v) for v in node.values])
            result = self.predicate(node.values[-1])
            for value in reversed(node.values[:-1]):
                test = self.visit(value).truth()
                result = (test | result) & test.isNotNull()  # a side that fails hides the ones after it
            return result
        if isinstance(node, ast.Compare) and len(node.ops) > 1:
            operands = [node.left, *node.comparators]
            pairs = [ast.Compare(a, [op], [b]) for a, op, b in zip(operands, node.ops, operands[1:])]
            return reduce(lambda a, b: a & b, [self.predicate(p) for p in pairs])
        return self.visit(node).truth()


def _parse(expression: str) -> ast.expr:
    try:
        return ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as error:
        raise SpecError(f"cannot parse expression {expression!r}: {error.msg}") from error


def compile_expression(expression: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    """(column, type) of a Python-notation expression over the fields of ``schema``."""
    value = _Compiler(schema).visit(_parse(expression))
    return value.column, value.type


def compile_predicate(expression: str, schema: T.StructType) -> Column:
    """Truth of an expression; rows on which it raises or is None do not pass.

    Unknown fields and orderings of types that have none would fail on every row and are refused.
    """
    return _Compiler(schema, strict=True).predicate(_parse(expression))
