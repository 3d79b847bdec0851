"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give protected entities away.

The protected entities are the values the patterns find. Terms near an entity (CONTEXT characters to either side) are counted
with it; P(entity | term) against P(entity), both from counts over the whole corpus, gives the share of the entity's information
content that the term discloses: (log N/c_e - log n_t/n_et) / (log N/c_e), 1 if the term occurs with the entity only. Terms seen with
it in at least SUPPORT different texts that disclose more than GENERALISE are generalised wherever they occur; beyond REMOVE they are removed.

All in DataFrame functions. Pairs grow with the entities (each has one context of bounded length), never with the square of a
group. Counts of terms are partial aggregates; a term of a third of all rows is one number per task.

A null text is empty. Rows that share doc_id and text share one result; a null doc_id is a value like any other. An empty
table gives none. Extra columns pass through ``sanitise``; those named as the working columns (base, near, spans, term_spans,
text_key, text_, m_<kind>, s_<kind>) are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, read, small, text_key
from .spans import by_start, matches_sql, redacted, tagged, with_spans, written

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. Possessive runs and looks around change nothing in what is kept: they pass over what a rule would drop anyway, and
#: keep long runs from being tried again at each character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){15})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}"
CONTEXT = 120
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
#: Candidate terms up to which their counting is a broadcast lookup; beyond, all terms are counted and joined.
BROADCAST_TERMS = 100_000


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _is_ip(v: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 3) | (F.length(part(p)) == 3) & (part(p) <= "255"))


def _is_card(v: Column) -> Column:
    d = _digits(v)
    each = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c >= "5", 9).otherwise(0)))
    return F.length(d).between(16, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _is_phone(v: Column) -> Column:
    return F.length(_digits(v)).between(8, 15)


RULES = {"ip": _is_ip, "card": _is_card, "phone": _is_phone}


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with base, the array of (rank, kind, start, end, value) by kind, then start."""
    docs = docs.withColumn("text_", F.coalesce("text", F.lit("")))
    found = with_spans(docs, "text_", PATTERNS, RULES)
    return found.withColumn("base", tagged(KINDS, lambda k: F.col(f"s_{k}"))).drop("text_", *(f"s_{k}" for k in KINDS))


def contexts(text: Column, base: Column) -> Column:
    """For each span the protected entity and the whole terms near it."""

    def near(s: Column) -> Column:
        left = text.substr(F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        right = text.substr(s["end"] + 1, F.lit(CONTEXT))
        left = F.when(s["start"] > CONTEXT, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
        right = F.when(F.length(text) > s["end"] + CONTEXT, F.regexp_replace(right, r"\p{L}+\z", "")).otherwise(right)
        terms = F.regexp_extract_all(F.concat(left, F.lit(" "), right), F.lit(TERM), F.lit(0))
        return F.struct(F.md5(F.concat_ws(":", s["kind"], F.lower(s["value"])).cast("binary")).alias("entity"), F.transform(terms, lambda t: F.lower(t)).alias("terms"))

    return F.transform(base, near)


def _terms(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TERM), F.lit(0))).alias("t")).withColumn("t", F.lower("t"))


def disclosing(docs: DataFrame, near: DataFrame, stage: Stage, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """Terms and the largest share of an entity's information that each discloses. near: rows (text_key, entity, terms). Copies of a text are one witness of a term, however many there are."""
    by_text = near.select("text_key", "entity", F.explode("terms").alias("t")).groupBy("entity", "t", "text_key").agg(F.count("*").alias("n"))
    each = stage.put(by_text.groupBy("entity", "t").agg(F.sum("n").alias("n_et"), F.count("*").alias("n_texts")))
    entities = each.groupBy("entity").agg(F.sum("n_et").alias("c_e"))
    pairs = stage.put(each.where(F.col("n_texts") >= support).drop("n_texts"))
    known = pairs.select(F.col("t").alias("k")).distinct()
    if known.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        counts = stage.put(_terms(docs).join(F.broadcast(known), F.col("t") == F.col("k"), "left").groupBy(F.col("k").alias("t")).agg(F.count("*").alias("n_t")))
    else:
        every = _terms(docs).groupBy("t").agg(F.count("*").alias("n_t"))
        counts = stage.put(every.join(known, F.col("t") == F.col("k"), "left").groupBy(F.col("k").alias("t")).agg(F.sum("n_t").alias("n_t")))
    total = counts.agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]
    content = F.log(F.lit(float(max(total, 1))) / F.col("c_e"))
    share = F.when(content > 0, 1 - F.log(F.greatest(F.col("n_t"), F.col("n_et")) / F.col("n_et")) / content)
    return pairs.join(entities, "entity").join(counts.where("t IS NOT NULL"), "t").withColumn("share", share).where(F.col("share") >= least).groupBy("t").agg(F.max("share").alias("share"))


def term_spans(docs: DataFrame, terms: DataFrame, stage: Stage) -> DataFrame:
    """Rows (doc_id, text_key, term_spans) for the documents that hold disclosing terms. Only those are taken apart term by term."""
    terms = small(terms.select(F.col("t").alias("k"), "share"))
    docs = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    keys = stage.put(_terms(docs, "doc_id", "text_key").join(terms, F.col("t") == F.col("k"), "left_semi").select("doc_id", "text_key").distinct())
    keys = small(keys).withColumnsRenamed({"doc_id": "d", "text_key": "h"})
    mine = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("h")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    tokens = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    parts = mine.select("doc_id", "text_key", F.posexplode(F.zip_with(F.slice(F.split("text", TERM, -1), F.lit(1), F.size(tokens)), tokens, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own"), b.alias("t")))).alias("pos", "x"))
    end = F.sum(F.col("x.gap") + F.col("x.own")).over(Window.partitionBy("doc_id", "text_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = parts.withColumns({"end": end, "low": F.lower("x.t")}).join(terms, F.col("low") == F.col("k"))
    span = F.struct((F.col("end") - F.col("x.own")).alias("start"), "end", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("value"))
    return placed.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(span)).alias("term_spans"))


def find(docs: DataFrame, stage: Stage, keep: list[str]) -> DataFrame:
    """The columns keep of docs with base (by kind, then start) and spans (base and disclosing terms, in the same order)."""
    keep = [c for c in keep if c not in ("text_key", "base", "near", "spans", "term_spans")]
    key = text_key(F.col("text"))
    first = base_spans(docs).withColumn("text_key", key)
    first = stage.put(first.withColumn("near", contexts(F.coalesce("text", F.lit("")), F.col("base"))).select(*dict.fromkeys([*keep, "doc_id"]), "text_key", "base", "near"))
    terms = stage.put(disclosing(docs, first.select("text_key", F.explode("near").alias("x")).select("text_key", "x.*"), stage))
    extra = term_spans(docs, terms, stage).withColumnsRenamed({"doc_id": "gl_d", "text_key": "gl_h"})
    out = first.join(extra, F.col("doc_id").eqNullSafe(F.col("gl_d")) & (F.col("text_key") == F.col("gl_h")), "left")
    apart = F.filter(F.coalesce("term_spans", F.array().cast("array<struct<start:int,end:int,value:string>>")), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.withColumn("spans", F.concat("base", F.transform(apart, lambda s: F.struct(F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))).select(*keep, "base", "spans")


def sanitise(docs: DataFrame, stage: Stage) -> DataFrame:
    """docs with text sanitised: entities become [kind], generalised terms [term], and removed terms go."""
    found = find(docs, stage, docs.columns)
    kinds = F.transform(by_start(F.col("spans")), lambda s: F.struct(F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["value"] == "remove", "").otherwise("[term]").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.withColumn("text", redacted(F.col("text"), kinds, lambda k: k)).drop("base", "spans")


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark, "op2"), ["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, [*KINDS, "term"]), F.size("base").cast("long").alias("n_personal"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: The patterns as they are asked for, with no look around.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "term": TERM,
}
OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED ({matches_sql(_SQL_PATTERNS)}),
digits AS (SELECT r, k, reverse(regexp_replace(value, '[^0-9]', '', 'g')) AS n FROM m WHERE kind = 'card'),
cards AS (
  SELECT r, k FROM (SELECT r, k, n, unnest(range(1, length(n) + 1)) AS i FROM digits WHERE length(n) BETWEEN 16 AND 19)
  GROUP BY r, k HAVING sum(CASE WHEN i % 2 = 1 THEN substr(n, i, 1)::INT ELSE 2 * substr(n, i, 1)::INT - CASE WHEN substr(n, i, 1)::INT > 4 THEN 9 ELSE 0 END END) % 10 = 0),
base AS MATERIALIZED (
  SELECT m.* FROM m LEFT JOIN cards ON cards.r = m.r AND cards.k = m.k
  WHERE kind = 'email' OR (kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255')) = 0) OR (kind = 'card' AND cards.r IS NOT NULL)
     OR (kind = 'phone' AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)),
sides AS (
  SELECT r, t, kind || ':' || lower(value) AS entity, first > {CONTEXT} AS cut, length(t) > past + {CONTEXT} AS cut_after, substr(t, greatest(first - {CONTEXT}, 0)::BIGINT + 1, least(first, {CONTEXT})::BIGINT) AS before, substr(t, past::BIGINT + 1, {CONTEXT}) AS after
  FROM base JOIN d USING (r)),
near AS (
  SELECT t AS witness, entity, lower(unnest(regexp_extract_all(CASE WHEN cut THEN regexp_replace(before, '^\\p{{L}}+', '') ELSE before END || ' ' || CASE WHEN cut_after THEN regexp_replace(after, '\\p{{L}}+$', '') ELSE after END, '{TERM}'))) AS term
  FROM sides),
counted AS (SELECT entity, term, count(*) AS n_et, count(DISTINCT witness) AS n_texts FROM near GROUP BY entity, term),
entities AS (SELECT entity, sum(n_et) AS c_e FROM counted GROUP BY entity),
terms AS (SELECT lower(value) AS term, count(*) AS n_t FROM m WHERE kind = 'term' GROUP BY lower(value)),
content AS (SELECT entity, ln((SELECT sum(n_t) FROM terms)::DOUBLE / c_e) AS bits FROM entities),
telling AS (
  SELECT DISTINCT term FROM counted JOIN content USING (entity) JOIN terms USING (term)
  WHERE n_texts >= {SUPPORT} AND bits > 0 AND 1 - ln(greatest(n_t, n_et)::DOUBLE / n_et) / bits >= {GENERALISE}),
added AS (SELECT m.* FROM m WHERE kind = 'term' AND lower(value) IN (SELECT term FROM telling) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.first < m.past AND m.first < b.past)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM added),
by_doc AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_term,
         string_agg(kind || ':' || first || ':' || past, ',' ORDER BY rank, first) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || first || ':' || past, ',' ORDER BY rank, first) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_term, 0) AS n_term, coalesce(n_email + n_ip + n_card + n_phone, 0) AS n_personal, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (r)
"""
