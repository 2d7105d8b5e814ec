"""The formula language: ``y ~ x + i.g + lag(z, 1:2) + fe(a + b:c)``, instrument clauses and options."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import boot as B
from plumbline.operators import graph, panel
from plumbline.operators import linear as L
from plumbline.operators.iv import GMM, IV
from plumbline.operators.ols import OLS


@dataclass
class Parsed:
    y: str
    terms: list[str]
    intercept: bool = True
    fes: list[str] = field(default_factory=list)
    endog: list[str] = field(default_factory=list)
    instruments: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)


def split_top(text: str, mark: str = "+") -> list[str]:
    """Splits at ``mark`` outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if depth < 0:
            raise ValueError(f"unbalanced brackets in {text!r}")
        if c == mark and not depth:
            out.append(text[at:i])
            at = i + 1
    if depth:
        raise ValueError(f"unbalanced brackets in {text!r}")
    return [t.strip() for t in [*out, text[at:]] if t.strip()]


def _call(term: str) -> tuple[str, str] | None:
    m = re.fullmatch(r"([A-Za-z_]\w*)\((.*)\)", term.strip(), re.S)
    return (m[1], m[2]) if m else None


def read_terms(rhs: str) -> tuple[list[str], bool, list[str]]:
    """(terms, intercept, absorbed effects) of a right-hand side; ``0 +``, ``+ 0`` and ``- 1`` take the intercept out."""
    depth, plain = 0, []
    for c in rhs:  # only outside brackets does "- 1" stand for no intercept
        depth += (c in "([") - (c in ")]")
        plain.append(" " if depth else c)
    for m in reversed(list(re.finditer(r"-\s*1(?![\w.])", "".join(plain)))):
        rhs = rhs[: m.start()] + "+ 0" + rhs[m.end() :]
    terms, intercept, fes = [], True, []
    for t in split_top(rhs):
        if t in ("0", "-1"):
            intercept = False
        elif t == "1":
            intercept = True
        elif (c := _call(t)) and c[0] == "fe":
            fes += [f.replace(" ", "") for f in split_top(c[1])]
        else:
            terms.append(t)
    return terms, intercept, fes


def read_options(text: str | None) -> dict:
    """``cluster(a + b)``, ``constraints(...)``, ``gmm(W=key)``."""
    out: dict = {}
    for t in re.findall(r"[A-Za-z_]\w*\((?:[^()]|\([^()]*\))*\)", text or ""):
        name, body = _call(t)
        if name == "cluster":
            out["cluster"] = tuple(split_top(body))
        elif name == "constraints":
            out["constraints"] = body
        elif name == "gmm":
            out["weight"] = body.split("=")[-1].strip()
        else:
            raise ValueError(f"unknown option {name!r}")
    return out


def read_instruments(clause: str, rhs: str) -> tuple[list[str], list[str], list[str]]:
    """(endogenous, user's instruments, all instruments) of ``(x ~ z1 + z2)``, sums of such clauses, or bar syntax.

    Exogenous regressors become instruments too; an instrument built from an endogenous variable is an error.
    """
    exog = read_terms(rhs.split("|")[0])[0]
    if "|" in clause:
        parts = [p.strip() for p in clause.split("|")]
        inst = read_terms(parts[-1])[0]
        regressors = read_terms(parts[0].split("~")[-1])[0]
        endog = read_terms(parts[1])[0] if len(parts) == 3 else [t for t in regressors if t not in inst]
        user, exog, lead = inst, [t for t in regressors if t not in endog and t not in inst], ""
    else:
        endog, user, lead = [], [], ""
        for c in split_top(clause):
            c = c.strip()
            c = c[1:-1] if c.startswith("(") and c.endswith(")") else c
            left, right = c.split("~")
            endog += [e for e in split_top(left) if e not in endog]
            terms, intercept, _ = read_terms(right)
            lead = lead if intercept else "0"
            user += [t for t in terms if t not in user]
    for t in user:
        if any(re.search(rf"(?<![\w.]){re.escape(e)}(?![\w.])", t) for e in endog):
            raise ValueError(f"instrument {t!r} depends on an endogenous variable")
    included = [t for t in exog if t not in endog and t not in user and not any(re.search(rf"(?<![\w.]){re.escape(e)}(?![\w.])", t) for e in endog)]
    return endog, user, [*([lead] if lead else []), *user, *included]


def parse(formula: str, iv: str | None = None, options: str | None = None) -> Parsed:
    left, right = formula.split("~", 1)
    bars = [b.strip() for b in right.split("|")]
    terms, intercept, fes = read_terms(bars[0])
    out = Parsed(left.strip(), terms, intercept, fes, options=read_options(options))
    if iv or len(bars) > 1:
        out.endog, _, full = read_instruments(iv or formula, bars[0])
        out.instruments = [t for t in full if t != "0" and t not in terms or t in out.endog]
        out.terms = [t for t in terms if t not in out.endog]
    return out


#: Functions of one column that a formula may name, with or without ``np.``.
FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "log1p": F.log1p, "log10": F.log10, "log2": F.log2, "expm1": F.expm1,
             "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "square": lambda c: c * c}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: F.pow(a, b), ast.Mod: lambda a, b: F.pmod(a, b)}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def expression(text: str, df: DataFrame) -> Column:
    """A column of arithmetic, comparisons and FUNCTIONS over columns: ``x ** 2``, ``np.log(x + 1)``, ``(x > 3)``."""

    def at(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](at(node.left), at(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -at(node.operand) if isinstance(node.op, ast.USub) else at(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](at(node.left), at(node.comparators[0])).cast("double")
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str)):
            return F.lit(node.value if isinstance(node.value, str) else float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in df.columns:
                raise ValueError(f"unknown column {node.id!r}")
            return F.col(node.id)
        if isinstance(node, ast.Call) and len(node.args) in (1, 2):
            name = node.func.attr if isinstance(node.func, ast.Attribute) and getattr(node.func.value, "id", "") in ("np", "numpy") else getattr(node.func, "id", None)
            if name == "I" and len(node.args) == 1:
                return at(node.args[0])
            if name in FUNCTIONS and len(node.args) == 1:
                return FUNCTIONS[name](at(node.args[0])).cast("double")
            if name in ("power", "maximum", "minimum") and len(node.args) == 2:
                return {"power": F.pow, "maximum": F.greatest, "minimum": F.least}[name](*map(at, node.args))
            raise ValueError(f"unknown function {name!r}")
        raise ValueError(f"can't read {text!r}")

    return at(ast.parse(text.strip(), mode="eval").body).cast("double")


def _transform(term: str) -> bool:
    """Whether a term is an expression over columns rather than an operator of the language."""
    m = re.match(r"\s*(?:(np|numpy)\.)?([A-Za-z_]\w*)\(", term)
    return bool(m and term.strip().endswith(")") and (m[1] or m[2] == "I" or m[2] in FUNCTIONS or m[2] in ("power", "maximum", "minimum")))


#: Levels of a factor that become columns, at most: absorb larger ones with fe().
MOST_LEVELS = 1000


def _levels(df: DataFrame, col: str) -> list:
    found = sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(MOST_LEVELS + 1).collect())
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{col!r} has more than {MOST_LEVELS} levels: absorb it with fe({col})")
    return found


def build(df: DataFrame, terms: list[str], unit: str | None = None, time: str | None = None, weights: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """Adds a column per term: names, expressions (``I(x ** 2)``, ``np.log(x)``), products (``a:b``, ``a#b``), ``a*b`` and ``a##b``, ``i.g`` and ``ib3.g`` and C(g), lags, differences, spatial lags."""
    cols: list[str] = []

    def factor(d, t) -> tuple[DataFrame, list[str]]:
        t = t.strip()
        t = t.removeprefix("c.")
        if m := re.fullmatch(r"(?:i|ib(\w+))\.(\w+)|C\((\w+)(?:\s*,\s*Treatment(?:\(\s*(?:reference\s*=\s*)?['\"]?([^'\")]*)['\"]?\s*\))?)?\)", t):
            col, wanted = m[2] or m[3], m[1] or m[4]
            levels = _levels(d, col)
            base = next((v for v in levels if str(v) == wanted), None if wanted else levels[0]) if levels else None
            if wanted and base is None:
                raise ValueError(f"{col!r} has no level {wanted!r}")
            made = {f"{col}[{v}]": F.when(F.col(col) == F.lit(v), 1.0).otherwise(0.0) for v in levels if v != base}
            return d.withColumns(made), list(made)
        if _transform(t):
            name = re.sub(r"\s+", " ", t)
            return d.withColumn(name, expression(t, d)), [name]
        if m := re.fullmatch(r"([LFD])(\d*)\.(\w+)", t):
            t = f"{ {'L': 'lag', 'F': 'lead', 'D': 'diff'}[m[1]]}({m[3]},{m[2] or 1})".replace(" ", "")
        if c := _call(t):
            name, args = c[0], [a.strip() for a in split_top(c[1], ",")]
            if name in ("lag", "lead", "L", "F", "diff", "D"):
                if unit is None or time is None:
                    raise ValueError("lags need the unit and time columns")
                steps = args[1] if len(args) > 1 else "1"
                first, _, last = steps.partition(":")
                names = []
                for k in range(int(first), int(last or first) + 1):
                    if k < 1:
                        raise ValueError("lags start at 1")
                    n = f"__{'L' if name in ('lag', 'L') else 'F' if name in ('lead', 'F') else 'D'}{'' if k == 1 and name not in ('diff', 'D') else k}__:{args[0]}"
                    if n not in d.columns:
                        d = panel.difference(d, args[0], k, unit, time, n) if name in ("diff", "D") else panel.lag(d, args[0], k if name in ("lag", "L") else -k, unit, time, n)
                    names.append(n)
                return d, names
            if name == "slag":
                opts = dict(a.replace(" ", "").split("=") for a in args[1:])
                key, style = opts["W"], opts.get("normalize", "row")
                if style not in ("row", "none"):
                    raise ValueError("slag takes normalize=row or none")
                e = weights[key]
                graph.check_weights(e)
                n = f"slag({args[0]})[{key},{style}]"
                return graph.spatial_lag(d, graph.normalised(e, "W" if style == "row" else "raw"), args[0], unit, [time] if time else None, n), [n]
            raise ValueError(f"unknown function {name!r}")
        if t not in d.columns:
            raise ValueError(f"unknown column {t!r}")
        return d, [t]

    def product(d, parts):
        groups = []
        for p in parts:
            d, names = factor(d, p)
            groups.append(names)
        names = groups[0]
        for g in groups[1:]:
            made = {f"{a}:{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for a in names for b in g}
            d, names = d.withColumns(made), list(made)
        return d, names

    for t in terms:
        if _transform(t):
            df, names = factor(df, t)
        elif "##" in t or ("*" in t and not _call(t)):
            parts = re.split(r"##|\*", t)
            for p in parts:
                df, names = factor(df, p)
                cols += names
            df, names = product(df, parts)
        elif "#" in t or (":" in t and not _call(t)):
            df, names = product(df, re.split(r"#|:", t))
        else:
            df, names = factor(df, t)
        cols += names
    return df, list(dict.fromkeys(cols))


def _plain(df: DataFrame, cols: list[str], prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """Column names that need no quoting: new name -> term."""
    names = {c if re.fullmatch(r"\w+", c) else f"{prefix}{i}": c for i, c in enumerate(cols)}
    return df.withColumns({n: F.col(f"`{c}`") for n, c in names.items() if n != c}), names


def estimate(formula: str, df: DataFrame, iv: str | None = None, options: str | None = None, boot: B.Boot | None = None, unit: str | None = None, time: str | None = None,
             weights: dict[str, DataFrame] | None = None, method: str | None = None, dialect: str = "stata"):
    """Fits the formula by least squares, instrumental variables or GMM; parameters carry the terms' names."""
    p = parse(formula, iv, options)
    if cluster := p.options.get("cluster"):
        b = boot or B.Boot()
        boot = B.Boot(b.n, b.dist, b.seed, cluster, b.policy, b.ssc, b.enumerate)
    if _transform(p.y):
        df, p.y = df.withColumn("_y", expression(p.y, df)), "_y"
    df, exog = build(df, p.terms, unit, time, weights)
    df, names = _plain(df, exog, "_x")
    if not p.endog:
        fit = OLS(p.y, list(names), df, p.fes, boot, p.options.get("constraints"), p.intercept, dialect).fit()
    else:
        absorbed = 0
        df, en = build(df, p.endog, unit, time, weights)
        df, zs = build(df, p.instruments, unit, time, weights)
        df, en = _plain(df, en, "_e")
        df, zs = _plain(df, [z for z in zs if z not in exog], "_z")
        names |= en
        if p.fes:
            from plumbline.operators import fe

            df, keys = fe.interact(fe.drop_missing(df, [f for t in p.fes for f in t.split(":")])[0], p.fes)
            keys = fe.prune_nested(df, keys)
            df, _ = fe.drop_singletons(df.where(L.finite([p.y, *names, *zs])), keys)
            absorbed = fe.absorbed(fe.degrees_of_freedom(df, keys, boot.cluster if boot else ())) if boot and boot.ssc.get("fixef.K", "none") in ("full", "nested") else 0
            df = fe.demean(df, [p.y, *names, *zs], keys)
        cls, extra = (GMM, {"weight": p.options.get("weight", "identity")}) if method == "gmm" else (IV, {})
        fit = cls(p.y, list(en), [n for n in names if n not in en], list(zs), df, boot, p.intercept and not p.fes, absorbed=absorbed, **extra).fit()
    fit.params = {names.get(k, k): v for k, v in fit.params.items()}
    fit.se = {names.get(k, k): v for k, v in fit.se.items()}
    return fit
