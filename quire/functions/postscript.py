"""Calculator functions: a stack program compiled to one Column per result, at planning time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F




def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _bits(f, a: Column, b: Column) -> Column:
    return f(a.cast("long"), b.cast("long")).cast("double")


def _shift(a: Column, n: Column) -> Column:
    k = n.cast("int")
    return F.when(k >= 0, F.call_function("shiftleft", a.cast("long"), F.greatest(k, F.lit(0)))).otherwise(F.call_function("shiftright", a.cast("long"), F.greatest(-k, F.lit(0)))).cast("double")


def _atan(num: Column, den: Column) -> Column:
    deg = F.degrees(F.atan2(num, den))
    return F.when(deg < 0, deg + 360.0).otherwise(deg)


_ONE = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "sqrt": lambda a: F.sqrt(F.greatest(a, F.lit(0.0))),
    "sin": lambda a: F.sin(F.radians(a)),
    "cos": lambda a: F.cos(F.radians(a)),
    "ln": lambda a: F.log(F.greatest(a, F.lit(1e-300))),
    "log": lambda a: F.log10(F.greatest(a, F.lit(1e-300))),
    "ceiling": lambda a: F.ceil(a).cast("double"),
    "floor": lambda a: F.floor(a).cast("double"),
    "round": lambda a: F.floor(a + 0.5).cast("double"),
    "truncate": _trunc,
    "cvi": _trunc,
    "cvr": lambda a: a,
}
_TWO = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)),
    "idiv": lambda a, b: F.coalesce(_trunc(F.try_divide(_trunc(a), _trunc(b))), F.lit(0.0)),
    "mod": lambda a, b: F.coalesce(F.try_mod(_trunc(a), _trunc(b)), F.lit(0.0)),
    "atan": _atan,
    "exp": F.pow,
    "bitshift": _shift,
}
_COMPARE = {"eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "ge": Column.__ge__, "lt": Column.__lt__, "le": Column.__le__}
_LOGIC = {"and": (Column.__and__, Column.bitwiseAND), "or": (Column.__or__, Column.bitwiseOR), "xor": (Column.__ne__, Column.bitwiseXOR)}


def parse(program: str) -> list:
    """Nested lists of words and numbers; braces nest."""
    stack: list[list] = [[]]
    for t in re.findall(r"[{}]|[^\s{}]+", program):
        if t == "{":
            stack.append([])
        elif t == "}":
            block = stack.pop()
            stack[-1].append(block)
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("braces don't match")
    out = stack[0]
    return out[0] if len(out) == 1 and isinstance(out[0], list) else out


def calculate(program: str, *inputs: Column) -> list[Column]:
    """The program's results, from the bottom of the stack, for inputs (doubles). Booleans live on the planner's stack.

    Division by zero gives 0. if and ifelse must leave stacks of equal height; index and roll take literal counts, and an index beyond the stack gives 0.
    """
    stack = _run(parse(program), [(x.cast("double"), "n") for x in inputs])
    return [x if kind == "n" else x.cast("double") for x, kind in stack]


def _literal(item) -> int:
    value, kind = item
    if not isinstance(kind, tuple):
        raise ValueError("a literal count is needed")
    return int(kind[1])


def _run(code: list, stack: list) -> list:
    stack = list(stack)
    k = 0
    while k < len(code):
        op = code[k]
        k += 1
        if isinstance(op, list):
            then, other = op, None
            if k < len(code) and isinstance(code[k], list):
                other = code[k]
                k += 1
            word = code[k]
            k += 1
            test, _ = stack.pop()
            yes = _run(then, stack)
            no = _run(other, stack) if word == "ifelse" else list(stack)
            if len(yes) != len(no):
                raise ValueError("branches of unequal height")
            stack = [a if a is b else (F.when(test, a[0]).otherwise(b[0]), "b" if a[1] == "b" else "n") for a, b in zip(yes, no)]
        elif re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)", op):
            stack.append((F.lit(float(op)), ("lit", float(op))))
        elif op in _ONE:
            a, _ = stack.pop()
            stack.append((_ONE[op](a), "n"))
        elif op in _TWO:
            b, a = stack.pop(), stack.pop()
            stack.append((_TWO[op](a[0], b[0]), "n"))
        elif op in _COMPARE:
            b, a = stack.pop(), stack.pop()
            stack.append((_COMPARE[op](a[0], b[0]), "b"))
        elif op in _LOGIC:
            b, a = stack.pop(), stack.pop()
            if a[1] == "b":
                stack.append((_LOGIC[op][0](a[0], b[0]), "b"))
            else:
                stack.append((_bits(_LOGIC[op][1], a[0], b[0]), "n"))
        elif op == "not":
            a, kind = stack.pop()
            stack.append((~a, "b") if kind == "b" else (F.bitwise_not(a.cast("long")).cast("double"), "n"))
        elif op in ("true", "false"):
            stack.append((F.lit(op == "true"), "b"))
        elif op == "pop":
            stack.pop()
        elif op == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif op == "dup":
            stack.append(stack[-1])
        elif op == "copy":
            n = _literal(stack.pop())
            stack += stack[len(stack) - n :] if n else []
        elif op == "index":
            n = _literal(stack.pop())
            stack.append(stack[-1 - n] if 0 <= n < len(stack) else (F.lit(0.0), ("lit", 0.0)))
        elif op == "roll":
            j, n = _literal(stack.pop()), _literal(stack.pop())
            if n > 0:
                top = stack[len(stack) - n :]
                j = ((j % n) + n) % n
                stack[len(stack) - n :] = top[n - j :] + top[: n - j]
        else:
            raise ValueError(f"unknown word {op}")
    return stack
