"""Model formulas: `y ~ x*f + offset(o) + (x | g) + (1 | a/b) + cs(x | g)`, parsed by recursive descent into plain data."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*)|([A-Za-z_.][\w.]*)|(\|\||[~+\-*/:^|(),=]))")
STRUCTURES = ("us", "diag", "cs", "ar1")


@dataclass(frozen=True)
class Bar:
    """A random-effects term: effects (each a tuple of variables, () is the intercept) by the interaction of groups."""

    effects: tuple[tuple[str, ...], ...]
    groups: tuple[str, ...]
    structure: str = "us"
    hom: bool | None = None

    @property
    def name(self) -> str:
        return ":".join(self.groups)


@dataclass(frozen=True)
class Formula:
    response: tuple[str, ...]
    terms: tuple[tuple[str, ...], ...]
    intercept: bool
    bars: tuple[Bar, ...]
    offset: str | None = None


class FormulaError(ValueError):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at]!r} in {text!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def _product(a, b):
    return tuple(dict.fromkeys(tuple(dict.fromkeys(x + y)) for x in a for y in b))


_PART = re.compile(r"\s*(\d+\.?\d*(?:[eE][-+]?\d+)?|[A-Za-z_.][\w.]*|[-+*/^(),]|==|>=|<=|[<>])")


def arithmetic(text: str) -> str:
    """An arithmetic expression as Spark SQL: ^ is the power, binds tightest and to the right; a sign binds looser."""
    parts, at = [], 0
    while at < len(text.rstrip()):
        m = _PART.match(text, at)
        if not m:
            return text  # quoted or other syntax is left to Spark
        parts.append(m[1])
        at = m.end()
    parts.append("")
    i = 0

    def atom() -> str:
        nonlocal i
        x = parts[i]
        i += 1
        if x == "(":
            inner = level(0)
            i += 1
            return f"({inner})"
        if parts[i] == "(" and re.match(r"[A-Za-z_.]", x):
            i += 1
            args = []
            while parts[i] != ")":
                args.append(level(0))
                i += parts[i] == ","
            i += 1
            return f"{x}({', '.join(args)})"
        return x

    def power() -> str:
        nonlocal i
        base = atom()
        if parts[i] == "^":
            i += 1
            return f"power({base}, {unary()})"
        return base

    def unary() -> str:
        nonlocal i
        if parts[i] in ("-", "+") and parts[i]:
            i += 1
            return parts[i - 1] + unary()
        return power()

    def level(k: int) -> str:
        nonlocal i
        ops = (("<", ">", "==", ">=", "<="), ("+", "-"), ("*", "/"))
        if k == len(ops):
            return unary()
        left = level(k + 1)
        while parts[i] and parts[i] in ops[k]:
            op = parts[i]
            i += 1
            left = f"{left} {op} {level(k + 1)}"
        return left

    out = level(0)
    return out if i == len(parts) - 1 else text


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0
        self.bars: list[Bar] = []
        self.offset: str | None = None

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str = "") -> str:
        x = self.peek()
        if not x or want and x != want:
            raise FormulaError(f"expected {want or 'more'}, found {x or 'the end'}")
        self.i += 1
        return x

    def sum(self) -> tuple[list[tuple[str, ...]], bool | None]:
        """Terms of a sum and whether it sets the intercept (None if it doesn't say)."""
        terms: list[tuple[str, ...]] = []
        one: bool | None = None
        sign = "+"
        if self.peek() in ("+", "-"):
            sign = self.take()
        while True:
            got, said = self.interaction()
            for t in got:
                if sign == "+" and t not in terms:
                    terms.append(t)
                elif sign == "-" and t in terms:
                    terms.remove(t)
            if said is not None:
                one = said == (sign == "+")
            if self.peek() not in ("+", "-"):
                return terms, one
            sign = self.take()

    def interaction(self):
        left, said = self.power()
        while self.peek() in (":", "*", "/"):
            op = self.take()
            right, _ = self.power()
            both = _product(left, right)
            if op == "*":
                left = [*left, *(x for x in right if x not in left), *(x for x in both if x not in left and x not in right)]
            elif op == "/":
                whole = tuple(dict.fromkeys(v for x in left for v in x))
                left = [*left, *(tuple(dict.fromkeys(whole + x)) for x in right)]
            else:
                left = list(both)
        return list(left), said

    def power(self):
        base, said = self.atom()
        if self.peek() == "^":
            self.take()
            out = list(base)
            for _ in range(int(self.take()) - 1):
                out += [x for x in _product(out, base) if x not in out]
            return out, said
        return base, said

    def atom(self):
        x = self.take()
        if x in ("0", "1"):
            return [], x == "1"
        if x == "(":
            return self.inside("us", None)
        if re.fullmatch(r"[A-Za-z_.][\w.]*", x):
            if self.peek() == "(" and x in STRUCTURES:
                self.take("(")
                return self.inside(x, None)
            if self.peek() == "(":
                self.take("(")
                depth, parts = 1, []
                while depth:
                    y = self.take()
                    depth += (y == "(") - (y == ")")
                    parts.append(y)
                inner = "".join(parts[:-1])
                if x == "offset":
                    self.offset = inner
                    return [], None
                return [(arithmetic(inner if x == "I" else f"{x}({inner})"),)], None
            return [(x,)], None
        raise FormulaError(f"unexpected {x!r}")

    def inside(self, structure: str, hom: bool | None):
        terms, one = self.sum()
        if self.peek() not in ("|", "||"):
            self.take(")")
            return terms, one
        bar = self.take()
        groups, _ = self.interaction()
        while self.peek() == ",":
            self.take()
            if self.take() != "hom":
                raise FormulaError("only hom= is known here")
            self.take("=")
            hom = self.take().upper() in ("TRUE", "T", "1")
        self.take(")")
        effects = ([()] if one is not False else []) + list(terms)
        for g in groups:
            if bar == "||":
                self.bars += [Bar((e,), g, structure, hom) for e in effects]
            else:
                self.bars.append(Bar(tuple(effects), g, structure, hom))
        return [], None


def parse(text: str) -> Formula:
    """The formula's parts. The left side may be one name or cbind(successes, failures)."""
    left, _, right = text.partition("~")
    if not right.strip():
        raise FormulaError("a formula needs a right-hand side")
    m = re.fullmatch(r"\s*cbind\(\s*([\w.]+)\s*,\s*([\w.]+)\s*\)\s*", left)
    p = _Parser(right)
    terms, one = p.sum()
    if p.peek():
        raise FormulaError(f"unexpected {p.peek()!r}")
    return Formula((m[1], m[2]) if m else ((left.strip(),) if left.strip() else ()), tuple(terms), one is not False, tuple(p.bars), p.offset)


def _bar_text(b: Bar) -> str:
    e = " + ".join((["1"] if () in b.effects else ["0"]) + [":".join(x) for x in b.effects if x])
    return f"{'' if b.structure == 'us' else b.structure}({e} | {b.name})"


def deparse(f: Formula) -> str:
    right = [*(() if f.intercept else ("0",)), *(":".join(t) for t in f.terms), *(("offset(" + f.offset + ")",) if f.offset else ()), *map(_bar_text, f.bars)]
    left = f"cbind({f.response[0]}, {f.response[1]})" if len(f.response) == 2 else "".join(f.response)
    return f"{left} ~ {' + '.join(right) or '1'}"


def findbars(text: str) -> list[str]:
    return [_bar_text(b) for b in parse(text).bars]


def nobars(text: str) -> str:
    return deparse(replace(parse(text), bars=()))


def subbars(text: str) -> str:
    """Bars turned into plain sums, for collecting variables."""
    f = parse(text)
    extra = tuple(dict.fromkeys(x for b in f.bars for x in (*(e for e in b.effects if e), *((g,) for g in b.groups))))
    return deparse(replace(f, bars=(), terms=f.terms + tuple(x for x in extra if x not in f.terms)))


def re_only(text: str, response: bool = False) -> str:
    """The random-effects terms alone, each in brackets; with the response if asked."""
    f = parse(text)
    return deparse_left(f) * response + ("~ " if response else "~") + " + ".join(map(_bar_text, f.bars))


def deparse_left(f: Formula) -> str:
    return (f"cbind({f.response[0]}, {f.response[1]})" if len(f.response) == 2 else "".join(f.response)) + " " * bool(f.response)


def rhs(text: str) -> str:
    """The right-hand side as written."""
    left, tilde, right = text.rpartition("~")
    return right.strip() if tilde else left.strip() or right.strip()


def with_rhs(text: str, new: str) -> str:
    """The formula with another right-hand side."""
    left = text.partition("~")[0].strip() if "~" in text else ""
    return f"{left} ~ {new}".strip()


def no_lhs(text: str) -> str:
    """The formula without its response."""
    return f"~{rhs(text)}"


def expand_double_bars(text: str, option: str = "split") -> str:
    """Double bars as independent terms (split), or as one term with a diagonal structure (diag)."""
    if option == "split":
        return deparse(parse(text))
    if option != "diag":
        raise FormulaError(f"unknown option {option!r}")
    return re.sub(r"\(([^()|]*)\|\|([^()]*)\)", lambda m: f"diag({m[1].strip()} | {m[2].strip()})", text)


def occurs(text: str, name: str) -> bool:
    """Whether a variable or function stands in the formula."""
    return re.search(rf"(?<![\w.]){re.escape(name)}(?![\w.])", text) is not None


def replace_variable(text: str, old: str, new: str) -> str:
    """Every use of a variable replaced; calls of that name are left."""
    return re.sub(rf"(?<![\w.]){re.escape(old)}(?![\w.(])", lambda _: new, text)


def group_names(text: str) -> list[str]:
    return list(dict.fromkeys(b.name for b in parse(text).bars))


def bar_names(text: str) -> list[str]:
    """The grouping side of each bar."""
    return [b.name for b in parse(text).bars]


def split_formula(text: str, sep: str = "/") -> list[str]:
    """A right-hand side cut at a separator outside brackets, each part as a one-sided formula."""
    depth, parts = 0, [""]
    for c in rhs(text):
        depth += (c == "(") - (c == ")")
        if c == sep and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [f"~{p.strip()}" for p in parts]


def as_one(*texts: str) -> str:
    """One one-sided formula of all variables of several."""
    names = dict.fromkeys(v for t in texts for v in all_vars(t if "~" in t else "~" + t))
    return "~" + " + ".join(names) if names else "~1"


def fixed_formula(text: str) -> str:
    return nobars(text)


def random_formula(text: str) -> str:
    """The response against the random-effects terms alone."""
    return re_only(text, True)


def response_formula(text: str) -> str:
    return "~" + deparse_left(parse(text)).strip()


def covariate_formula(text: str) -> str:
    """What stands before a conditioning bar, or the whole right-hand side: y ~ x | g gives ~x."""
    return "~" + rhs(text).partition("|")[0].strip().lstrip("(")


def groups_formula(text: str) -> str | None:
    """What stands behind a conditioning bar (y ~ x | g gives ~g), or the groups of all bars."""
    right = rhs(text)
    if "|" in right and not right.lstrip().startswith("(") and "(" not in right.partition("|")[0]:
        return "~" + right.partition("|")[2].strip()
    names = group_names(text)
    return "~" + " + ".join(names) if names else None


@dataclass(frozen=True)
class Nonlinear:
    """response ~ curve ~ random effects of the curve's parameters."""

    response: str
    curve: str
    parameters: tuple[str, ...]
    bars: tuple[Bar, ...]


def parse_nonlinear(text: str, parameters: list[str]) -> Nonlinear:
    """A three-part formula; random effects are for parameters, so an intercept there is an error unless it is taken out."""
    parts = text.split("~")
    if len(parts) != 3:
        raise FormulaError("a nonlinear formula has three parts: response ~ curve ~ random effects")
    bars = []
    for b in parse("~ " + parts[2]).bars:
        effects = tuple(e for e in b.effects if e)
        bad = [e for e in effects if len(e) != 1 or e[0] not in parameters]
        if bad or not effects:
            raise FormulaError("random effects must be for parameters of the curve")
        bars.append(replace(b, effects=effects))
    return Nonlinear(parts[0].strip(), arithmetic(parts[1].strip()), tuple(parameters), tuple(bars))


def update(old: str, change: str) -> str:
    """A formula changed by another in which . stands for the old side: update("y ~ x + (1 | g)", ". ~ . - x")."""
    left, _, right = change.partition("~")
    f = parse(old)
    left = deparse_left(f).strip() if left.strip() in (".", "") else left.strip()
    if re.search(r"(?<![\w.])\.(?![\w.])", right) is None:
        return deparse(parse(f"{left} ~ {right}"))
    gone = [m.replace(" ", "") for m in re.findall(r"-\s*(\([^()]*\))", right)]
    fixed = deparse(replace(f, response=(), bars=())).partition("~")[2].strip()
    bars = [b for b in f.bars if _bar_text(b).replace(" ", "") not in gone and _bar_text(b).replace("(1 + ", "(").replace(" ", "") not in gone]
    rest = re.sub(r"-\s*\([^()]*\)", "", right)
    new = parse(f"{left} ~ " + re.sub(r"(?<![\w.])\.(?![\w.])", lambda _: fixed, rest, count=1))
    added = [b for b in new.bars if b not in bars]
    return deparse(replace(new, bars=(*bars, *added)))


def all_vars(text: str) -> list[str]:
    f = parse(text)
    names = [*f.response, *(v for t in f.terms for v in t), *(v for b in f.bars for e in b.effects for v in e), *(g for b in f.bars for g in b.groups), *([f.offset] if f.offset else [])]
    return list(dict.fromkeys(v for n in names for v in re.findall(r"[A-Za-z_.][\w.]*(?!\w*\()", n)))
