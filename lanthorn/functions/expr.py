"""Boolean expressions of rules compiled to columns.

Grammar: ``||`` over ``&&`` over ``!`` over comparisons (== != < <= > >=) over calls, names, numbers, strings and
parentheses. Names are resolved by the caller: rule labels, or the fields of a parsed response. An unknown label is
false. Functions: contains, icontains, startswith, endswith, regex(pattern, text), len (bytes), tolower, toupper.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(\|\||&&|==|!=|<=|>=|[!<>(),])|(\d+(?:\.\d+)?)|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([A-Za-z_][\w.\-]*))""")


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        at = m.end()
        if m[1]:
            out.append(("op", m[1]))
        elif m[2]:
            out.append(("num", m[2]))
        elif m[5]:
            out.append(("name", m[5]))
        else:
            out.append(("str", re.sub(r"\\(.)", r"\1", m[3] if m[3] is not None else m[4])))
    return out


def parse(text: str) -> tuple:
    """Tree of ("or" | "and" | "not" | "cmp" | "call" | "name" | "num" | "str", ...)."""
    toks = tokenize(text)
    at = 0

    def peek() -> str | None:
        return toks[at][1] if at < len(toks) and toks[at][0] == "op" else None

    def take(op: str) -> None:
        nonlocal at
        if peek() != op:
            raise ValueError(f"{op!r} expected in {text!r}")
        at += 1

    def chain(op: str, name: str, inner: Callable) -> tuple:
        nonlocal at
        parts = [inner()]
        while peek() == op:
            at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else (name, *parts)

    def unary() -> tuple:
        nonlocal at
        if peek() == "!":
            at += 1
            return "not", unary()
        left = atom()
        if peek() in ("==", "!=", "<", "<=", ">", ">="):
            op = toks[at][1]
            at += 1
            return "cmp", op, left, atom()
        return left

    def atom() -> tuple:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = either()
            take(")")
            return inner
        if at >= len(toks) or toks[at][0] == "op":
            raise ValueError(f"value expected in {text!r}")
        kind, value = toks[at]
        at += 1
        if kind == "name" and peek() == "(":
            at += 1
            args = []
            while peek() != ")":
                args.append(either())
                if peek() == ",":
                    at += 1
            take(")")
            return ("call", value, *args)
        return kind, value

    both = lambda: chain("&&", "and", unary)
    either = lambda: chain("||", "or", both)
    tree = either()
    if at != len(toks):
        raise ValueError(f"left over in {text!r}")
    return tree


def to_column(tree: tuple, name: Callable[[str], Column]) -> Column:
    kind = tree[0]
    sub = lambda t: to_column(t, name)
    if kind in ("or", "and"):
        out = sub(tree[1])
        for t in tree[2:]:
            out = (out | sub(t)) if kind == "or" else (out & sub(t))
        return out
    if kind == "not":
        return ~sub(tree[1])
    if kind == "cmp":
        a, b = sub(tree[2]), sub(tree[3])
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree[1]]
    if kind == "num":
        return F.lit(float(tree[1]) if "." in tree[1] else int(tree[1]))
    if kind == "str":
        return F.lit(tree[1])
    if kind == "name":
        return name(tree[1])
    fn, args = tree[1].lower(), [sub(t) for t in tree[2:]]
    if fn == "contains":
        return F.contains(*args)
    if fn == "icontains":
        return F.contains(F.lower(args[0]), F.lower(args[1]))
    if fn in ("startswith", "endswith"):
        return (F.startswith if fn == "startswith" else F.endswith)(*args)
    if fn == "regex":
        pattern = tree[2][1] if tree[2][0] == "str" else None
        if pattern is not None:
            try:
                re.compile(pattern)
            except re.error:
                return F.lit(False)
        return F.regexp_like(args[1], args[0])
    if fn == "len":
        return F.octet_length(args[0])
    if fn in ("tolower", "toupper"):
        return (F.lower if fn == "tolower" else F.upper)(args[0])
    raise ValueError(f"unknown function {tree[1]!r}")


def evaluate(tree: tuple, get: Callable[[str], object]) -> object:
    """Value of a tree in Python, as ``to_column`` gives it; null makes a comparison or call null, which counts as false."""
    kind = tree[0]
    if kind in ("or", "and"):
        return (any if kind == "or" else all)(bool(evaluate(t, get)) for t in tree[1:])
    if kind == "not":
        return not evaluate(tree[1], get)
    if kind == "num":
        return float(tree[1]) if "." in tree[1] else int(tree[1])
    if kind == "str":
        return tree[1]
    if kind == "name":
        return get(tree[1])
    if kind == "cmp":
        a, b = evaluate(tree[2], get), evaluate(tree[3], get)
        if a is None or b is None:
            return None
        if isinstance(a, str) != isinstance(b, str):
            a, b = str(a), str(b)
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree[1]]
    fn, args = tree[1].lower(), [evaluate(t, get) for t in tree[2:]]
    if any(a is None for a in args):
        return None
    if fn == "contains":
        return args[1] in args[0]
    if fn == "icontains":
        return args[1].lower() in args[0].lower()
    if fn in ("startswith", "endswith"):
        return getattr(args[0], fn)(args[1])
    if fn == "regex":
        try:
            return re.search(args[0], args[1]) is not None
        except re.error:
            return False
    if fn == "len":
        return len(args[0].encode("utf-8", "surrogatepass"))
    if fn in ("tolower", "toupper"):
        return args[0].lower() if fn == "tolower" else args[0].upper()
    raise ValueError(f"unknown function {tree[1]!r}")


def triggers(tree: tuple, regex_literal: Callable[[str], str | None], least: int = 3) -> set[str] | None:
    """Texts of which a message must hold one for the tree to be true, or None where there is no such set."""
    kind = tree[0]
    if kind == "or":
        each = [triggers(t, regex_literal, least) for t in tree[1:]]
        return None if None in each else set().union(*each)
    if kind == "and":
        each = [x for t in tree[1:] if (x := triggers(t, regex_literal, least)) is not None]
        return min(each, key=lambda x: (len(x), -min(map(len, x), default=0))) if each else None
    if kind == "call":
        fn, args = tree[1].lower(), tree[2:]
        text = None
        if fn in ("contains", "icontains", "startswith", "endswith") and len(args) == 2 and args[1][0] == "str":
            text = args[1][1].lower()
        elif fn == "regex" and args and args[0][0] == "str":
            text = regex_literal(args[0][1])
        return {text} if text and len(text) >= least else None
    return None


#: Methods of a field, and the functions that they are (fixed names).
METHODS = {"contains": "contains", "bcontains": "contains", "icontains": "icontains", "ibcontains": "icontains", "startswith": "startswith", "bstartswith": "startswith", "endswith": "endswith"}
#: Fields of a response and the names that rules give them (fixed names).
FIELDS = {
    "body": "body", "body_string": "body", "raw_header": "all_headers", "status": "status_code", "content_type": "header_content_type", "raw": "all", "title": "title", "title_string": "title",
}
_STRING = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""


def from_methods(text: str) -> str:
    """A rule written with methods on fields of ``response`` as an expression of this grammar.

    Byte strings become strings, ``response.headers["X-Y"]`` the name header_x_y, ``field.contains(x)`` a function of
    two arguments, and ``"pattern".matches(field)`` regex("pattern", field). Strings are left as they are.
    """
    strings: list[str] = []

    def keep(m: re.Match) -> str:
        strings.append(m[0].removeprefix("b"))
        return f"\0{len(strings) - 1}\0"

    s = re.sub(rf"(?:\bb(?=[\"']))?{_STRING}", keep, text)
    unquote = lambda i: strings[int(i)][1:-1]
    s = re.sub(r"response\.headers\[\0(\d+)\0\]", lambda m: "header_" + re.sub(r"\W", "_", unquote(m[1]).lower()), s)
    s = re.sub(r"\bresponse\.(\w+)", lambda m: FIELDS.get(m[1], m[1]), s)
    s = re.sub(r"(\0\d+\0)\.b?(?:sub)?matches\(", r"regex(\1, ", s)
    s = re.sub(r"\b(\w+)\.(\w+)\(", lambda m: f"{METHODS[m[2].lower()]}({m[1]}, " if m[2].lower() in METHODS else m[0], s)
    return re.sub(r"\0(\d+)\0", lambda m: strings[int(m[1])], s)


def compose(top: str, rules: dict[str, str]) -> tuple:
    """Tree of a top expression over calls of named rules; an empty top means any rule, an empty rule is true."""
    trees = {k: parse(from_methods(v)) if v.strip() else ("cmp", "==", ("num", "1"), ("num", "1")) for k, v in rules.items()}

    def fill(t: tuple) -> tuple:
        if t[0] == "call" and len(t) == 2:
            if t[1] not in trees:
                raise ValueError(f"no rule {t[1]!r}")
            return trees[t[1]]
        return tuple(fill(x) if isinstance(x, tuple) else x for x in t)

    if not top.strip():
        return ("or", *trees.values()) if len(trees) != 1 else next(iter(trees.values()))
    return fill(parse(top))


def dnf(tree: tuple, negate: bool = False) -> list[dict[str, bool]]:
    """Disjunctive normal form over labels: a list of {label: wanted truth}; contradictions are left out."""
    kind = tree[0]
    if kind == "name":
        return [{tree[1]: not negate}]
    if kind == "not":
        return dnf(tree[1], not negate)
    if kind not in ("or", "and"):
        raise ValueError("only labels, !, && and || have a normal form")
    parts = [dnf(t, negate) for t in tree[1:]]
    if (kind == "or") != negate:
        return [c for p in parts for c in p]
    out = []
    for choice in product(*parts):
        merged: dict[str, bool] = {}
        if all(merged.setdefault(k, v) == v for c in choice for k, v in c.items()):
            out.append(merged)
    return out
