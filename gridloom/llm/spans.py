"""Character spans of regular-expression matches, in DataFrame functions only.

Spark's functions give matches but not where they are. The pieces between matches do: the text split at the same expression.
Starts are running sums of the lengths of pieces and matches. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
_NONE = f"array<{SPAN}>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with m_<kind>, all leftmost non-overlapping matches of each pattern."""
    return df.withColumns({f"m_{kind}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for kind, p in patterns.items()})


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda n, y: n + y)


#: Matches whose lengths are summed at a time: the work is k * BLOCK + (k / BLOCK)^2 for k matches in a text.
BLOCK = 64


def located(text: Column, matches: Column, pattern: str) -> Column:
    """The matches with their places."""

    def places(lens: Column) -> Column:
        whole = F.transform(lens, lambda x: x["gap"] + x["own"])
        blocks = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(w, b * BLOCK + 1, F.lit(BLOCK))))
        firsts = lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b)))

        def span(w: Column, first: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                start = F.get(first, b) + _sum(F.slice(w, b * BLOCK + 1, i - b * BLOCK)) + x["gap"]
                return F.struct(start.alias("start"), (start + x["own"]).alias("end"), x["value"].alias("value"))

            return F.transform(lens, one)

        return let(whole, lambda w: let(let(blocks(w), firsts), lambda first: span(w, first)))

    def lens(m: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own"), b.alias("value")))

    return F.when(F.size(matches) > 0, let(lens(matches), places)).otherwise(F.array().cast(_NONE))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], holds: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """df with s_<kind>, the located matches for which the kind's rule holds; the matches' columns go."""
    df = with_matches(df, text, patterns)
    df = df.withColumns({f"s_{kind}": located(F.col(text), F.col(f"m_{kind}"), p) for kind, p in patterns.items()})

    def kept(kind: str, rule: Callable[[Column], Column]) -> Column:
        return F.filter(F.col(f"s_{kind}"), lambda s: rule(s["value"]))

    df = df.withColumns({f"s_{kind}": kept(kind, rule) for kind, rule in holds.items()})
    return df.drop(*(f"m_{kind}" for kind in patterns))


def tagged(kinds: list[str], of: Callable[[str], Column]) -> Column:
    """All spans in the kinds' order as structs (rank, kind, start, end, value)."""

    def marked(rank: int, kind: str) -> Column:
        return F.transform(of(kind), lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*(marked(i, k) for i, k in enumerate(kinds)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    """Sorted by start, then the kind's rank."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s.alias("s")))), lambda x: x["s"])


def redacted(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with each span (sorted by start; overlaps are merged) replaced by mask(kind)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), mask(s["kind"])).alias("out"), s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def matches_sql(patterns: dict[str, str]) -> str:
    """SQL for the matches of each pattern in the rows d(r, t): r, rank, kind, k (which match), value, first and past, code points."""
    one = """SELECT r, {rank} AS rank, '{kind}' AS kind, k, value, past - length(value) AS first, past
  FROM (SELECT r, k, value, sum(length(gap) + length(value)) OVER (PARTITION BY r ORDER BY k) AS past
        FROM (SELECT r, unnest(g) AS gap, unnest(m) AS value, generate_subscripts(g, 1) AS k FROM (SELECT r, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m FROM d) WHERE len(m) > 0)
        WHERE value IS NOT NULL)"""
    return "\n  UNION ALL ".join(one.format(rank=rank, kind=kind, p=quoted(p)) for rank, (kind, p) in enumerate(patterns.items()))
