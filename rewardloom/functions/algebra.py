"""Algebraic equality of two answers: a grammar compiled to postfix, exact numbers, then identity testing.

An answer is an expression, or a relation, list, tuple, interval, set or union of expressions. An expression without
variables has a value, a fraction where that is exact and else a double. Expressions with variables are compared by
their values at fixed points in prime fields. The primes are one less than a multiple of 8 and of every odd prime below
100, so in each of these fields those primes and 2 are squares, -1 is none, and every root of a degree made of those
primes has one principal value, for which sqrt(ab) = sqrt(a) sqrt(b) holds as it does for positive numbers. A point at
which some radicand is no square is passed over. Exponents are taken modulo half the group's order, so 2^(x+1) equals
2 * 2^x. Other functions are unknowns that depend on their argument's value only. Two expressions are equal when they
agree at ``POINTS`` points; with numbers of about 130 bits unequal ones do not.

Runs of three or more letters that name no function are words: such a text is no expression and equals only itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction
from functools import lru_cache
from math import gcd, prod

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = 2
TRIES = 64  # points per prime that are tried before a comparison is given up
FIELDS = 6
EXACT_BITS = 1 << 14  # larger powers are doubles, and beyond these residues
RELATIVE_TOLERANCE = Fraction(1, 10**9)
MAX_FACTORIAL = 1000

# Names of the notation.
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "ln", "log", "exp")
LETTERS = (
    "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi",
    "rho", "sigma", "tau", "phi", "chi", "psi", "omega", "varphi", "Gamma", "Delta", "Theta", "Lambda", "Sigma", "Phi", "Psi", "Omega", "infty",
)
TIMES = ("cdot", "times", "ast")
RELATIONS = {r"\leq": "<=", r"\le": "<=", r"\geq": ">=", r"\ge": ">=", r"\lt": "<", r"\gt": ">", r"\neq": "!=", r"\ne": "!=", "≤": "<=", "≥": ">=", "≠": "!="}
SIGNS = {"−": "-", "–": "-", "×": "*", "·": "*", "÷": "/", "π": r"\pi", "√": r"\sqrt", "∞": r"\infty", "∪": r"\cup", "±": r"\pm"}


def _names(known: tuple[str, ...]) -> str:
    """The longest name that a command starts with; a space after it is not there any more."""
    return "|".join(sorted(known, key=len, reverse=True))


_TOKEN = re.compile(
    r"(?P<num>[0-9]+\.[0-9]+|[0-9]+\.?|\.[0-9]+)"
    r"|\\log_\{?(?P<base>[0-9]+)\}?"
    r"|(?:\\(?P<fn>" + _names(FUNCTIONS) + r")|(?P<bare>" + _names(FUNCTIONS) + r")(?![A-Za-z]))(?:\^(?:\{(?P<to>-?[0-9]+)\}|(?P<to1>[0-9])))?"
    r"|(?:\\sqrt|(?P<root>sqrt)(?![A-Za-z]))(?P<sqrt>)(?:\[(?P<degree>[0-9]+)\])?"
    r"|\\(?P<frac>frac)"
    r"|\\(?P<name>" + _names((*LETTERS, *TIMES, "div", "pi")) + r")(?P<sub1>_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]))?"
    r"|(?P<word>[A-Za-z]+)(?P<sub>_(?:\{[A-Za-z0-9]+\}|[A-Za-z0-9]))?"
    r"|\\(?P<escaped>[%{}|])"
    r"|(?P<mark>\*\*|[-+*/^()\[\]{}|!%])"
)
_CLOSES = {")": "(", "]": "[", "}": "{"}
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "apply": 2.5, "neg": 2.7, "juxt": 3, "^": 4}


class NoValueError(ArithmeticError):
    """No value at this point, or none at all."""


def postfix(text: str) -> list[tuple]:
    """Constants ('num', value) and ('var', name), and operations (name, number of operands, parameter), in order."""
    out: list[tuple] = []
    waiting: list[tuple] = []  # (kind, parameter): operators, pending prefixes and open groups
    operand, at = False, 0

    def reduce(rank: float, right: bool = False) -> None:
        while waiting and waiting[-1][0] in _RANK and (_RANK[waiting[-1][0]] > rank or (_RANK[waiting[-1][0]] == rank and not right)):
            emit(*waiting.pop())

    def emit(kind: str, parameter=None) -> None:
        if kind == "apply":
            apply(*parameter)
        else:
            out.append(("*" if kind == "juxt" else kind, 1 if kind == "neg" else 2, None))

    def apply(name: str, parameter) -> None:
        if name == "root":
            out.append(("root", 1, parameter))
            return
        out.append(("fn", 1, name))
        if parameter is not None:
            out.extend([("num", parameter), ("^", 2, None)])

    def complete() -> None:
        """The operand that has just ended is what tight prefixes wait for."""
        nonlocal operand
        operand = True
        while waiting and waiting[-1][0] == "tight":
            apply(*waiting.pop()[1])

    def product() -> None:
        """An operand follows an operand."""
        nonlocal operand
        if operand:
            loose = False
            for kind, _ in reversed(waiting):
                if kind not in _RANK:
                    break
                loose = loose or kind == "apply"
            kind = "juxt" if loose else "*"
            reduce(_RANK[kind])
            waiting.append((kind, None))
            operand = False

    def binary(name: str) -> None:
        nonlocal operand
        if not operand:
            if name == "-":
                waiting.append(("neg", None))
                return
            if name == "+":
                return
            raise SyntaxError(name)
        reduce(_RANK[name], right=name == "^")
        waiting.append((name, None))
        operand = False

    def close(kind: str) -> None:
        while waiting and waiting[-1][0] in _RANK:
            emit(*waiting.pop())
        if not operand or not waiting or waiting[-1][0] != "open" or waiting[-1][1] != kind:
            raise SyntaxError(kind)
        waiting.pop()

    while at < len(text):
        token = _TOKEN.match(text, at)
        if not token:
            raise SyntaxError(text[at : at + 20])
        at = token.end()
        part = token.groupdict()
        expects_group = waiting and waiting[-1][0] in ("frac1", "frac2")
        if expects_group and part["mark"] != "{":
            raise SyntaxError(text[at : at + 20])
        if part["num"]:
            mixed = re.compile(r"\\frac\{([0-9]+)\}\{([0-9]+)\}").match(text, at) if part["num"].isdigit() else None
            product()
            value = Fraction(part["num"].rstrip("."))
            if mixed and 0 < int(mixed[1]) < int(mixed[2]):  # a mixed number
                value, at = value + Fraction(int(mixed[1]), int(mixed[2])), mixed.end()
            out.append(("num", value))
            complete()
        elif part["base"] or part["fn"] or part["bare"]:
            name = part["fn"] or part["bare"] or f"log{int(part['base'])}"
            to = part["to"] or part["to1"]
            if operand:  # the argument of a function before ends here
                reduce(_RANK["apply"])
            product()
            if to == "-1":
                name, to = "arc" + name, None
            kind = "tight" if text[at : at + 1] in ("(", "{", "[") else "apply"
            waiting.append((kind, (name, Fraction(to) if to else None)))
        elif part["sqrt"] is not None:
            product()
            waiting.append(("tight", ("root", int(part["degree"] or 2))))
        elif part["frac"]:
            product()
            waiting.append(("frac1", None))
        elif part["name"]:
            name = part["name"]
            if name in TIMES:
                binary("*")
            elif name == "div":
                binary("/")
            else:
                product()
                out.append(("var", name + (part["sub1"] or "").replace("{", "").replace("}", "")))
                complete()
        elif part["word"]:
            word = part["word"]
            if word == "pi":
                names = ["pi"]
            elif len(word) > 2:
                raise SyntaxError(word)
            else:
                names = list(word)
            names[-1] += (part["sub"] or "").replace("{", "").replace("}", "")  # x_1 and x_{1} are one name
            for name in names:
                product()
                out.append(("var", name))
                complete()
        else:
            mark = part["mark"] or part["escaped"]
            if mark in ("(", "[", "{") and not (part["escaped"]):
                if expects_group:
                    waiting.append(("open", mark))
                    continue
                if not (waiting and waiting[-1][0] == "tight" and not operand):
                    product()
                waiting.append(("open", mark))
            elif mark in _CLOSES and not part["escaped"]:
                close(_CLOSES[mark])
                if waiting and waiting[-1][0] == "frac1":
                    waiting[-1] = ("frac2", None)
                    operand = False
                    continue
                if waiting and waiting[-1][0] == "frac2":
                    waiting.pop()
                    out.append(("/", 2, None))
                complete()
            elif mark == "|":
                opened = next((p for k, p in reversed(waiting) if k == "open"), None)
                if operand and opened == "|":
                    close("|")
                    out.append(("abs", 1, None))
                    complete()
                else:
                    product()
                    waiting.append(("open", "|"))
            elif mark in ("!", "%"):
                if not operand:
                    raise SyntaxError(mark)
                if mark == "%":
                    out.extend([("num", Fraction(100)), ("/", 2, None)])
                else:
                    out.append(("fn", 1, "!"))
            elif mark in ("**", "^"):
                binary("^")
            elif mark in ("+", "-", "*", "/"):
                binary(mark)
            else:
                raise SyntaxError(mark)
    while waiting and waiting[-1][0] in _RANK:
        emit(*waiting.pop())
    if waiting or not operand:
        raise SyntaxError(text[:20])
    return out


# ---- values of expressions without variables ------------------------------------------------------------------------

_DOUBLES = {
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan,
    "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "ln": math.log, "log": math.log10, "exp": math.exp,
    "cot": lambda x: 1 / math.tan(x), "sec": lambda x: 1 / math.cos(x), "csc": lambda x: 1 / math.sin(x),
}
_CONSTANTS = {"pi": math.pi, "e": math.e}


def _exact_root(x: Fraction, degree: int) -> Fraction | None:
    def whole(n: int) -> int | None:
        r = math.isqrt(n) if degree == 2 else round(n ** (1 / degree)) if n < 1 << 900 else 0
        return r if r**degree == n else None

    if x < 0:
        root = _exact_root(-x, degree) if degree % 2 else None
        return None if root is None else -root
    top, bottom = whole(x.numerator), whole(x.denominator)
    return None if top is None or bottom is None else Fraction(top, bottom)


def _root(x: Fraction | float, degree: int) -> Fraction | float:
    if degree < 1 or (x < 0 and degree % 2 == 0):
        raise NoValueError
    exact = _exact_root(x, degree) if isinstance(x, Fraction) else None
    if exact is not None:
        return exact
    return math.copysign(abs(float(x)) ** (1 / degree), x)


def _numeric_power(base: Fraction | float, to: Fraction | float) -> Fraction | float:
    if isinstance(base, Fraction) and isinstance(to, Fraction):
        if to.denominator == 1:
            n = to.numerator
            if base == 0 and n < 0:
                raise NoValueError
            bits = max(base.numerator.bit_length(), base.denominator.bit_length())
            if abs(base) in (0, 1) or bits * abs(n) <= EXACT_BITS:
                return base ** (n if abs(base) not in (0, 1) else (n % 2 + 2 * (n != 0)))
        elif to.denominator < 100:
            return _numeric_power(_root(base, to.denominator), Fraction(to.numerator))
    found = float(base) ** float(to)
    if isinstance(found, complex):
        raise NoValueError
    return found


def _numeric_function(name: str, x: Fraction | float) -> Fraction | float:
    if name == "!":
        if not isinstance(x, Fraction) or x.denominator != 1 or not 0 <= x <= MAX_FACTORIAL:
            raise NoValueError
        return Fraction(math.factorial(int(x)))
    if name in _DOUBLES:
        return _DOUBLES[name](float(x))
    if name.startswith("log"):
        return math.log(float(x)) / math.log(int(name[3:]))
    raise NoValueError


def value(code: list[tuple]) -> Fraction | float | None:
    """The value of an expression without variables; None where it has variables, no real value, or one too large."""
    stack: list[Fraction | float] = []
    try:
        for kind, *rest in code:
            if kind == "num":
                stack.append(rest[0])
            elif kind == "var":
                stack.append(_CONSTANTS[rest[0]])
            elif rest[0] == 1:
                x = stack.pop()
                if kind == "neg":
                    x = -x
                elif kind == "abs":
                    x = abs(x)
                else:
                    x = _root(x, rest[1]) if kind == "root" else _numeric_function(rest[1], x)
                stack.append(x)
            else:
                y, x = stack.pop(), stack.pop()
                if not (isinstance(x, Fraction) and isinstance(y, Fraction)) and kind != "^":
                    x, y = float(x), float(y)
                stack.append(x + y if kind == "+" else x - y if kind == "-" else x * y if kind == "*" else x / y if kind == "/" else _numeric_power(x, y))
        found = stack[0]
        return found if isinstance(found, Fraction) or math.isfinite(found) else None
    except (ArithmeticError, KeyError, ValueError):
        return None


def near(a: Fraction | float, b: Fraction | float) -> bool:
    if isinstance(a, Fraction) and isinstance(b, Fraction):
        return abs(a - b) <= RELATIVE_TOLERANCE * max(1, abs(b))
    return abs(float(a) - float(b)) <= float(RELATIVE_TOLERANCE) * max(1.0, abs(float(b)))


# ---- values in prime fields -----------------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    low = (n - 1) & (1 - n)  # the power of two in n - 1
    for base in range(2, 42):
        x = pow(base, (n - 1) // low, n)
        if x in (1, n - 1):
            continue
        k = low
        while k > 2 and x != n - 1:
            x, k = x * x % n, k // 2
        if x != n - 1:
            return False
    return True


@lru_cache(maxsize=1)
def fields() -> tuple[int, ...]:
    """The first primes that are one less than a multiple of 8 and of every odd prime below 100."""
    step = 8 * prod(q for q in range(3, 100) if all(q % d for d in range(2, q)))
    found, n = [], step - 1
    while len(found) < FIELDS:
        if _is_prime(n):
            found.append(n)
        n += step
    return tuple(found)


@lru_cache(maxsize=4096)
def _hashed(name: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=12).digest(), "big")


def _is_square(x: int, p: int) -> bool:
    return pow(x, (p - 1) // 2, p) == 1


def _field_power(base: tuple, to: tuple, p: int, q: int) -> tuple:
    """Powers with an exponent that is known exactly, or known modulo ``q``, the order of the squares."""
    x, w, _ = base
    _, e, exact = to
    if exact is not None and exact.denominator == 1:
        n = exact.numerator
        if x == 0 and n <= 0:
            raise NoValueError
        return pow(x, n, p), pow(w, n, q) if w is not None and (n >= 0 or gcd(w, q) == 1) else None, None
    if exact is not None and exact.denominator % 2 and gcd(exact.denominator, p - 1) == 1:
        return pow(x, exact.numerator * pow(exact.denominator, -1, p - 1) % (p - 1), p), None, None
    if e is None:
        return _hashed(f"{x}^{to[0]}", p) % p, None, None
    if x == 0 or not _is_square(x, p):
        raise NoValueError
    return pow(x, e, p), None, None


def residue(code: list[tuple], p: int, seed: int) -> int:
    """The value at the point ``seed`` modulo ``p``. A stack entry is the residue, the residue modulo q if known, and the
    number itself if it is a constant."""
    q = (p - 1) // 2
    stack: list[tuple] = []
    for kind, *rest in code:
        if kind == "num":
            n = rest[0]
            stack.append((n.numerator * pow(n.denominator, -1, p) % p, n.numerator * pow(n.denominator, -1, q) % q if gcd(n.denominator, q) == 1 else None, n))
        elif kind == "var":
            n = _hashed(rest[0], seed)
            stack.append((n % p, n % q, None))
        elif rest[0] == 1:
            x, w, exact = stack.pop()
            if kind == "neg":
                stack.append((-x % p, None if w is None else -w % q, None if exact is None else -exact))
            elif kind == "abs":
                stack.append((x if x == 0 or _is_square(x, p) else -x % p, None, None))
            elif kind == "root":
                degree = rest[1]
                if degree < 1 or gcd(degree, q) != 1:
                    raise NoValueError
                to = Fraction(1, degree)
                stack.append((0, None, None) if x == 0 else _field_power((x, w, exact), (0, pow(degree, -1, q), to), p, q))
            else:
                stack.append((_hashed(f"{rest[1]}({x})", p) % p, None, None))
        else:
            b, a = stack.pop(), stack.pop()
            if kind == "^":
                stack.append(_field_power(a, b, p, q))
                continue
            known = a[1] is not None and b[1] is not None
            exact = a[2] is not None and b[2] is not None
            if kind == "/":
                if b[0] == 0:
                    raise NoValueError
                known = known and gcd(b[1], q) == 1
                stack.append((a[0] * pow(b[0], -1, p) % p, a[1] * pow(b[1], -1, q) % q if known else None, a[2] / b[2] if exact and b[2] else None))
            else:
                step = int.__add__ if kind == "+" else int.__sub__ if kind == "-" else int.__mul__
                number = (a[2] + b[2] if kind == "+" else a[2] - b[2] if kind == "-" else a[2] * b[2]) if exact else None
                stack.append((step(a[0], b[0]) % p, step(a[1], b[1]) % q if known else None, number))
    return stack[0][0]


def _points(*codes: list[tuple]) -> list[tuple[int, list[int]]]:
    """The first points at which every expression has a value: (prime, the values)."""
    found = []
    for p in fields():
        for seed in range(TRIES):
            try:
                found.append((p, [residue(code, p, seed) for code in codes]))
            except NoValueError:
                if not any(kind == "var" for code in codes for kind, *_ in code):
                    break  # constants are the same at every point
                continue
            if len(found) % POINTS == 0:
                break
        if len(found) >= 2 * POINTS:
            break
    return found


def same_expression(a: str, b: str) -> bool:
    """Equality of two texts as expressions; texts that are none are equal when they are the same."""
    if a == b:
        return True
    try:
        first, second = compiled(a), compiled(b)
    except SyntaxError:
        return False
    known = value(first), value(second)
    if None not in known:
        return near(*known)
    points = _points(first, second)
    return bool(points) and all(x == y for _, (x, y) in points)


@lru_cache(maxsize=4096)
def compiled(text: str) -> list[tuple]:
    return postfix(text)


# ---- relations, lists, intervals, sets, unions ----------------------------------------------------------------------

_RELATION = re.compile(r"(<=|>=|!=|<|>|=)")
_TURNED = {"<": ">", "<=": ">="}


def _split(text: str, marks: tuple[str, ...]) -> list[str]:
    """Parts between the marks that stand outside all brackets."""
    parts, depth, begin, at = [], 0, 0, 0
    while at < len(text):
        if text[at] in "([{":
            depth += 1
        elif text[at] in ")]}":
            depth -= 1
        elif depth <= 0:
            mark = next((m for m in marks if text.startswith(m, at)), None)
            if mark:
                parts.append(text[begin:at])
                begin = at = at + len(mark)
                continue
        at += 1
    return [*parts, text[begin:]]


def _whole_bracket(text: str) -> bool:
    """Whether the first bracket closes at the end of the text."""
    depth = 0
    for at, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            return at == len(text) - 1
    return False


def _all_match(a: list[str], b: list[str]) -> bool:
    """Both ways: every element of one equals one of the other."""
    return all(any(same(x, y) for y in b) for x in a) and all(any(same(x, y) for x in a) for y in b)


def _signs(text: str) -> list[str]:
    """Both readings of a text with plus-minus signs."""
    if r"\pm" not in text:
        return [text]
    return [text.replace(r"\pm", "+").lstrip("+"), text.replace(r"\pm", "-")]


def _same_relation(a: list[str], b: list[str]) -> bool:
    """``left mark right`` of both; an equation may be multiplied by a number and may have its sides exchanged."""
    (left, mark, right), (other_left, other_mark, other_right) = a, b
    if mark in _TURNED:
        left, mark, right = right, _TURNED[mark], left
    if other_mark in _TURNED:
        other_left, other_mark, other_right = other_right, _TURNED[other_mark], other_left
    if mark != other_mark:
        return False
    if same_expression(left, other_left) and same_expression(right, other_right):
        return True
    try:
        sides = [postfix(f"({x})-({y})") for x, y in ((left, right), (other_left, other_right))]
    except SyntaxError:
        return False
    points = _points(*sides)
    if any(not x or not y for _, (x, y) in points) or len(points) < 2:
        return False
    if mark in (">", ">="):  # the factor would have to be positive, which a field does not tell
        return all(x == y for _, (x, y) in points)
    ratios: dict[int, set[int]] = {}
    for p, (x, y) in points:
        ratios.setdefault(p, set()).add(x * pow(y, -1, p) % p)
    return all(len(r) == 1 for r in ratios.values())


def _solved(relation: list[str], expression: str) -> bool:
    """Whether an equation says that one of its variables is ``expression``; canonical answers drop a lone left side."""
    if relation[1] != "=":
        return False
    try:
        here, there = ({c[1] for c in compiled(x) if c[0] == "var"} for x in (f"({relation[0]})-({relation[2]})", expression))
    except SyntaxError:
        return False
    return any(_same_relation([name, "=", expression], relation) for name in sorted(here - there) if re.fullmatch("[A-Za-z]", name))


def same(a: str, b: str) -> bool:
    """Equality of two answers without white space."""
    if a == b:
        return True
    parts = [_split(x, (r"\cup",)) for x in (a, b)]
    if max(map(len, parts)) > 1:
        return len(parts[0]) == len(parts[1]) and _all_match(*parts)
    parts = [_split(x, (",", ";")) for x in (a, b)]
    readings = [[y for x in p for y in _signs(x)] for p in parts]
    if max(map(len, readings)) > 1:
        return _all_match(*readings)
    sides = [_split_relation(x) for x in (a, b)]
    if sides[0] and sides[1]:
        return _same_relation(*sides)
    if sides[0] or sides[1]:
        return _solved(*((sides[0], b) if sides[0] else (sides[1], a)))
    ends = [(x[:1], x[-1:]) if x[:1] in ("(", "[") and x[-1:] in (")", "]") and _whole_bracket(x) else None for x in (a, b)]
    inner = [_split(x[1:-1], (",",)) if e else [] for x, e in zip((a, b), ends)]
    if max(map(len, inner)) > 1:  # a tuple or an interval
        return ends[0] == ends[1] and len(inner[0]) == len(inner[1]) and all(map(same, *inner))
    sets = [_split(x[2:-2], (",",)) if x.startswith(r"\{") and x.endswith(r"\}") else None for x in (a, b)]
    if sets[0] is not None or sets[1] is not None:
        return None not in sets and _all_match(*sets)
    return same_expression(a, b)


def _split_relation(text: str) -> list[str] | None:
    parts = _RELATION.split(text)
    return parts if len(parts) == 3 and parts[0] and parts[2] else None


def plain_notation(text: str) -> str:
    """A text with one spelling for signs, relations and set braces."""
    for sign, form in SIGNS.items():
        text = text.replace(sign, form)
    for sign in sorted(RELATIONS, key=len, reverse=True):
        text = text.replace(sign, RELATIONS[sign])
    return text


def answers_equal(a: str | None, b: str | None) -> bool:
    """Algebraic equality of two canonical answers; false where one is missing or no comparison can be made."""
    if a is None or b is None:
        return False
    try:
        return same(plain_notation(a), plain_notation(b))
    except (RecursionError, OverflowError, ValueError):  # also numbers of thousands of digits
        return False


def number_of(text: str | None) -> float | None:
    """The value of a canonical answer without variables, as a double."""
    try:
        found = value(compiled(plain_notation(text))) if text else None
        return None if found is None else float(found)
    except (SyntaxError, OverflowError, ValueError):
        return None


def equal_answers(a: Column, b: Column) -> Column:
    """``answers_equal`` per row, Arrow-batched; each distinct pair of a batch is compared once. Null pairs are false."""

    def compare(first: pd.Series, second: pd.Series) -> pd.Series:
        found: dict[tuple, bool] = {}
        out = []
        for pair in zip(first, second):
            if not isinstance(pair[0], str) or not isinstance(pair[1], str):
                out.append(False)
                continue
            if pair not in found:
                found[pair] = answers_equal(*pair)
            out.append(found[pair])
        return pd.Series(out, dtype="bool")

    return F.pandas_udf(compare, "boolean")(a, b)


def answer_value(text: Column) -> Column:
    """``number_of`` per row, Arrow-batched."""

    def evaluate(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts, use_na_sentinel=True)
        found = [number_of(t) for t in distinct] + [None]
        return pd.Series([found[c] for c in codes], dtype="float64")

    return F.pandas_udf(evaluate, "double")(text)
