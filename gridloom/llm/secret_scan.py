"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are first-order over the token alphabet with add-one counts, trained from labelled samples. A long token is held
for a secret if the log-likelihood ratio, summed over its neighbouring characters, exceeds MARGIN. The table of ratios becomes one literal; scanning is DataFrame functions only.

A null text is empty and has no spans. Texts are scanned whole. Repeated rows give repeated results; an empty table gives
none; extra columns pass through ``scan``; those named as its columns (base_spans, spans) are replaced, and those named as its
working columns (text_, m_<kind>, s_<kind>) dropped.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .spans import by_start, let, matches_sql, quoted, redacted, tagged, with_spans, written

KINDS = ["assign", "access", "hex"]
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
#: Nats by which the random model must lead.
MARGIN = 12.0


# Words that identifiers and paths are made of.
WORDS = (
    "access account action add address admin all alpha append apply args array assert async auth base batch begin binary bind block body bool "
    "buffer build button byte cache call cancel case catch channel char check child class clean clear client clone close code color column "
    "command commit compare config connect const content context control copy core count create current cursor data date debug decode "
    "default delete depth device dict digest dir disable disk display domain done double draw drop edit else email enable encode end engine "
    "entry enum error event exception execute exists export extend factory field file filter final find first flag float flush folder format "
    "frame from function get global group handle hash header height hidden host html image import index info init input insert int item join "
    "json kernel key label last layer layout length level library limit line link list load local lock log"
).split()


def default_samples(seed: int = 7) -> list[tuple[str, bool]]:
    """Labelled samples: keys drawn from the usual alphabets (True); names made of WORDS as code and paths make them (False). The same on every machine and version of Python."""
    rng = random.Random(seed)
    pick = lambda x: x[int(rng.random() * len(x))]  # noqa: E731  random() alone draws alike in all versions
    some = lambda x, n: [pick(x) for _ in range(n)]
    letters, digits = string.ascii_letters, string.digits
    alphabets = ("0123456789abcdef", letters + digits, letters + digits + "+/", string.ascii_uppercase + digits, letters + digits + "-_")
    made = [("".join(some(a, pick(range(20, 65)))), True) for a in alphabets for _ in range(300)]
    names = ["_".join(some(WORDS, 3)) for _ in range(1500)] + ["/".join(some(WORDS, 3)) for _ in range(500)]
    names += ["-".join(some(WORDS, 2)) + str(pick(range(100))) for _ in range(500)]
    names += ["".join(w.capitalize() for w in some(WORDS, 3)) for _ in range(500)] + ["_".join(some(WORDS, 3)).upper() for _ in range(500)]
    return made + [(x, False) for x in WORDS + names]


def train(samples: list[tuple[str, bool]]) -> list[float]:
    """Log-likelihood ratio (random against identifier) of each pair of neighbouring characters, row by row of ALPHABET."""
    n, place = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [[1.0] * n for _ in range(n)], False: [[1.0] * n for _ in range(n)]}
    for text, secret in samples:
        for a, b in zip(text, text[1:], strict=False):
            if a in place and b in place:
                counts[secret][place[a]][place[b]] += 1
    return [math.log(t / sum(r1)) - math.log(f / sum(r0)) for r1, r0 in zip(counts[True], counts[False], strict=True) for t, f in zip(r1, r0, strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """The token's summed log-likelihood ratio."""
    lit = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    place = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(place, F.lit(1), F.greatest(F.size(place) - 1, F.lit(0))), F.slice(place, F.lit(2), F.greatest(F.size(place) - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, at: acc + F.coalesce(F.get(lit, at), F.lit(0.0)))


def scan(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, margin: float = MARGIN) -> DataFrame:
    """docs with base_spans and spans: arrays of (rank, kind, start, end, value) by start, then kind; spans also has what the models find outside the base ones."""
    table = train(default_samples() if samples is None else samples)
    docs = docs.withColumn("text_", F.coalesce("text", F.lit("")))
    found = with_spans(docs, "text_", PATTERNS, {"assign": lambda v: F.length(F.regexp_extract(v, _ASSIGN, 1)) >= 8})
    found = found.withColumn("base_spans", by_start(tagged(KINDS, lambda k: F.col(f"s_{k}"))))
    told = let(F.col("base_spans"), lambda base: F.filter("s_random", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (ratio(s["value"], table) > margin)))
    found = found.withColumn("s_random", F.when(F.size("s_random") > 0, told).otherwise(F.col("s_random")))
    found = found.withColumn("spans", by_start(tagged([*KINDS, "random"], lambda k: F.col(f"s_{k}"))))
    return found.drop("text_", *(f"s_{k}" for k in PATTERNS))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found secret replaced by <secret:kind> in text."""
    return scan(docs).withColumn("text", redacted(F.col("text"), F.col("spans"), lambda k: F.concat(F.lit("<secret:"), k, F.lit(">")))).drop("base_spans", "spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, [*KINDS, "random"]), F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The patterns as they are asked for, with no look around; the token and model tables are those of ``train``.
_SQL_PATTERNS = {
    "assign": "(?:" + _NAMES + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "random": "[A-Za-z0-9+/_=-]{20,}",
}
_PLACE = f"(instr({quoted(ALPHABET)}, substr(value, {{}}, 1)) - 1)"
OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED ({matches_sql(_SQL_PATTERNS)}),
base AS MATERIALIZED (
  SELECT * FROM m
  WHERE (kind = 'assign' AND length(regexp_extract(value, '^(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?(.*)$', 1)) >= 8) OR (kind = 'access' AND length(value) >= 16) OR (kind = 'hex' AND length(value) >= 32)),
told AS (SELECT string_split('{",".join(f"{x:.6f}" for x in train(default_samples()))}', ',')::DOUBLE[] AS ratio),
apart AS (SELECT * FROM m WHERE kind = 'random' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.first < m.past AND m.first < b.past)),
pairs AS (SELECT r, k, {_PLACE.format("i")} * {len(ALPHABET)} + {_PLACE.format("i + 1")} + 1 AS cell FROM (SELECT r, k, value, unnest(range(1, length(value))) AS i FROM apart)),
drawn AS (SELECT r, k FROM pairs, told GROUP BY r, k HAVING sum(ratio[cell]) > {MARGIN}),
spans AS (SELECT * FROM base UNION ALL SELECT apart.* FROM apart JOIN drawn USING (r, k)),
by_doc AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'random') AS n_random,
         string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank) FILTER (kind <> 'random') AS base, string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (r)
"""
