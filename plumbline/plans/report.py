"""Reports: tables of several fits as frames, text or LaTeX, and the data behind plots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.boot import type1_quantile
from plumbline.operators.rct import balance
from plumbline.operators.result import Result


def order_names(names: list[str], by: str = "none") -> list[str]:
    """``alpha``: by name; ``tau``: by the event time in the name, others last; ``none``: as given."""
    if by == "alpha":
        return sorted(names)
    if by == "tau":
        tau = lambda n: (0, int(m[1])) if (m := re.search(r"tau_(-?\d+)$", n)) else (1, 0)
        return sorted(names, key=tau)
    return list(names)


def summary(fits: dict[str, Result], by: str = "none") -> DataFrame:
    """(param, one ``<fit>_estimate`` and ``<fit>_se`` pair a fit), joined on names."""
    out = None
    for name, fit in fits.items():
        one = fit.coef().select("param", F.col("estimate").alias(f"{name}_estimate"), F.col("se").alias(f"{name}_se"))
        out = one if out is None else out.join(one, "param", "full")
    rank = {n: i for i, n in enumerate(order_names(list(dict.fromkeys(k for f in fits.values() for k in f.params)), by))}
    position = F.coalesce(*[F.when(F.col("param") == n, F.lit(i)) for n, i in rank.items()], F.lit(len(rank)))
    return out.orderBy(position)


def escape(text: str) -> str:
    return re.sub(r"([&%$#_{}])", r"\\\1", text)


def render(fits: dict[str, Result], digits: int = 4, latex: bool = False, by: str = "none", groups: dict[str, int] | None = None, stats: tuple[str, ...] = (), notes: tuple[str, ...] = (),
           bands: bool = False) -> str:
    """Estimates over standard errors in brackets, and the number of rows; no stars and no p-values.

    ``groups``: heading -> number of neighbouring fits under it; ``stats``: metrics of the diagnostics block; ``bands``: uniform
    bands in square brackets where a fit has them; ``notes`` follow the table.
    """
    names = order_names(list(dict.fromkeys(k for f in fits.values() for k in f.params)), by)
    show = lambda x: "" if x is None or x != x else f"{x:.{digits}f}"
    lines = [["", *fits]]
    for n in names:
        lines.append([n, *[show(f.params.get(n)) for f in fits.values()]])
        if any(n in f.se for f in fits.values()):
            lines.append(["", *[f"({show(f.se[n])})" if n in f.se else "" for f in fits.values()]])
        if bands and any(n in _bands(f) for f in fits.values()):
            lines.append(["", *[f"[{show(_bands(f)[n][0])}, {show(_bands(f)[n][1])}]" if n in _bands(f) else "" for f in fits.values()]])
    block = [["N", *[str(f.n_obs) for f in fits.values()]]]
    block += [[m, *[show(f.diagnostics.get(m)) for f in fits.values()]] for m in stats if any(m in f.diagnostics for f in fits.values())]
    head = []
    if groups:
        if sum(groups.values()) != len(fits):
            raise ValueError("the groups must cover all fits")
        head = [(g, n) for g, n in groups.items()]
    if latex:
        row = lambda cells: " & ".join(map(escape, cells)) + " \\\\"
        top = [" & ".join(["", *[f"\\multicolumn{{{n}}}{{c}}{{{escape(g)}}}" for g, n in head]]) + " \\\\"] if head else []
        body = "\n".join([*top, row(lines[0]), "\\hline", *map(row, lines[1:]), "\\hline", *map(row, block), *(f"\\multicolumn{{{len(fits) + 1}}}{{l}}{{{escape(t)}}} \\\\" for t in notes)])
        return f"\\begin{{tabular}}{{l{'r' * len(fits)}}}\n{body}\n\\end{{tabular}}"
    every = [*lines, *block]
    width = [max(len(row[i]) for row in every) for i in range(len(lines[0]))]
    put = lambda row: "  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(row, width))).rstrip()
    out, at = [], 1
    if head:
        cells = [" " * width[0]]
        for g, n in head:
            cells.append(g.center(sum(width[at : at + n]) + 2 * (n - 1)))
            at += n
        out.append("  ".join(cells).rstrip())
    rule = "-" * (sum(width) + 2 * (len(width) - 1))
    return "\n".join([*out, put(lines[0]), *map(put, lines[1:]), rule, *map(put, block), *notes])


def _bands(fit: Result) -> dict[str, tuple[float, float]]:
    named = fit.extra.get("band_names")
    return {named[i] if named else f"tau_{t}" if s in ("pre", "post") else f"{s}_tau_{t}": (lo, hi) for i, (s, t, _, _, lo, hi) in enumerate(fit.bands)}


def diagnostics(fits: dict[str, Result]) -> DataFrame:
    """(fit, metric, value)."""
    out = None
    for name, fit in fits.items():
        one = fit.facts().withColumn("fit", F.lit(name)).select("fit", "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def weak_instruments(fits: dict[str, Result]) -> DataFrame:
    """Only what tells of weak instruments: partial, robust and effective F, rank statistics, over-identification."""
    return diagnostics(fits).where("metric LIKE 'partial_f%' OR metric LIKE 'kp_%' OR metric IN ('mop_effective_f', 'robust_f', 'cragg_donald', 'sargan', 'sargan_df', 'hansen', 'j', 'j_df')")


def event_plot(fit: Result) -> DataFrame:
    """What an event-study figure shows: (tau, estimate, lower, upper, side) by event time."""
    return fit.band().select("tau", "estimate", "lower", "upper", "side").orderBy("tau")


def coefficient_plot(fits: dict[str, Result]) -> DataFrame:
    """(fit, param, estimate, se) of all fits."""
    out = None
    for name, fit in fits.items():
        one = fit.coef().withColumn("fit", F.lit(name)).select("fit", "param", "estimate", "se")
        out = one if out is None else out.unionByName(one)
    return out


def spatial_plot(fit: Result) -> DataFrame:
    """What a figure of direct and spill paths shows: (path, tau, estimate, lower, upper)."""
    return fit.band().select(F.col("side").alias("path"), "tau", "estimate", "lower", "upper").orderBy("path", "tau")


def percentile_plot(fit: Result, levels: tuple[float, ...] = (0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975)) -> DataFrame:
    """(tau, estimate, level, value): type-1 percentiles of the draws around each event time's estimate."""
    rows = [(int(t), float(fit.extra["att"][t]), float(p), float(fit.extra["att"][t] + type1_quantile(fit.extra["draws"][:, i], p))) for i, t in enumerate(fit.extra["taus"]) for p in levels]
    return fit.spark.createDataFrame(rows, "tau int, estimate double, level double, value double")


def balance_plot(df: DataFrame, arm: str, covariates: list[str], weight: str | None = None) -> DataFrame:
    """(covariate, sample, smd): standardised differences as they are and, with a weight, weighted; the largest first."""
    out = balance(df, arm, covariates).select("covariate", F.lit("raw").alias("sample"), "smd")
    if weight:
        out = out.unionByName(balance(df, arm, covariates, weight).select("covariate", F.lit("weighted").alias("sample"), "smd"))
    return out.orderBy(F.abs("smd").desc(), "covariate")
