"""Redaction of the test documents, as they are and with letters that hold names and phone numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.checks.base import quote, register, select, table
from maskflow.operators.redact import (
    CANDIDATE_WORD,
    DENY_START,
    NAME_WORD,
    PARTICLES,
    PHONE_BODY,
    Redaction,
    Operator,
    entity_counts,
    entity_spans,
    plausible_person,
    redact_table,
    redact_text,
)

BLANK = r"[\t\n\f\r \x0B\p{Z}]"
# Word edges become characters of their own, since \b knows ASCII letters only.
OPEN, CLOSE = "", ""
# Words that no candidate begins with open with another one.
DENIED = "\ue002"
ANY_OPEN = f"[{OPEN}{DENIED}]"
TAIL = f"(?:-{ANY_OPEN}{CANDIDATE_WORD}{CLOSE})*"
PERSON_SQL = (
    f"{OPEN}{CANDIDATE_WORD}{CLOSE}{TAIL}"
    f"(?:{BLANK}+(?:{OPEN}(?:{'|'.join(PARTICLES)}){CLOSE}{BLANK}+)*{ANY_OPEN}{CANDIDATE_WORD}{CLOSE}{TAIL})+"
)
SIMPLE_SQL = f"{ANY_OPEN}{NAME_WORD}{CLOSE}(?:{BLANK}+{ANY_OPEN}{NAME_WORD}{CLOSE})+"

LETTER = [
    "doc_id",
    "CASE doc_id % 8 WHEN 0 THEN 'Frau Anna Meier, Tel. +41 79 123 45 67, und Hans von Allmen. ' WHEN 1 THEN 'Der Kunde Max ruft 061 267 87 27 an. ' "
    "WHEN 2 THEN 'Anna Meier2 und Anne-Marie Keller; CHF Franken ' WHEN 3 THEN '0041791234567 oder +41 (61) 267-87-27x oder +41 (61) 267-87-27. ' "
    "WHEN 4 THEN NULL WHEN 5 THEN 'Ein Haus. Éva Müller Zoë Öhri ' WHEN 6 THEN 'Der Anna Meier dankt René Müller, Den Haag und Meier-Huber Zoë. ' ELSE '' END || text AS text",
]
LETTER_SQL = select("documents", LETTER)


def edges(text: str) -> str:
    marked = f"regexp_replace({text}, '([\\p{{L}}\\p{{N}}_]+)', '{OPEN}\\1{CLOSE}', 'g')"
    return f"regexp_replace({marked}, '{OPEN}({'|'.join(DENY_START)}){CLOSE}', '{DENIED}\\1{CLOSE}', 'g')"


def unmark(text: str) -> str:
    return f"translate({text}, '{OPEN}{CLOSE}{DENIED}', '')"


PARTICLES_SQL = ", ".join(quote(p) for p in PARTICLES)
DENY_SQL = ", ".join(quote(d) for d in DENY_START)


def plausible_sql(span: str) -> str:
    """The pattern implies capitals; what is left is the first word, and two words that are no particles."""
    words = f"string_split(regexp_replace({span}, '{BLANK}+', ' ', 'g'), ' ')"
    return f"({words}[1] NOT IN ({DENY_SQL}) AND length(list_filter({words}, lambda w: lower(w) NOT IN ({PARTICLES_SQL}))) >= 2)"


def rebuild_sql(text: str, pattern: str, new: str) -> str:
    """Text pieces and hits in turn; `new` is an expression of the lambda's `x`."""
    hits = f"regexp_extract_all({text}, '{pattern}')"
    rest = f"regexp_split_to_array({text}, '{pattern}')"
    zipped = f"list_zip({rest}, list_transform({hits}, lambda x: {new}))"
    return f"array_to_string(list_transform({zipped}, lambda z: z[1] || coalesce(z[2], '')), '')"


PERSON_NEW = f"CASE WHEN {plausible_sql(unmark('x'))} THEN '<PERSON>' ELSE x END"


def person_sql(text: str, pattern: str = PERSON_SQL, new: str = PERSON_NEW) -> str:
    return f"CASE WHEN {text} IS NOT NULL THEN {unmark(rebuild_sql(edges(text), pattern, new))} END"


# The phone pattern must not run into a word; without look-ahead the last digit pair and a closing edge do it.
PHONE_SQL = PHONE_BODY.replace("\\s", "[\\t\\n\\f\\r \\x0B]").replace("[[\\t\\n\\f\\r \\x0B]\\-]", "[\\t\\n\\f\\r \\x0B\\-]")
FOLLOWED = f"({PHONE_SQL})([^\\p{{L}}\\p{{N}}_]|$)"


@register("redact_persons", f"SELECT doc_id, {person_sql('text')} AS text FROM ({LETTER_SQL})")
def redact_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", LETTER).withColumn("text", redact_text(F.col("text")))


@register("redact_documents", f"SELECT doc_id, {person_sql('text')} AS text FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_table(table(spark, sf_dir, "documents", ["doc_id", "text"]), ["text"])


@register(
    "redact_conversations",
    f"SELECT cast(conv_id AS varchar) AS conv_id, cast(turn AS varchar) AS turn, role, {person_sql('text')} AS text FROM conversations",
)
def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_table(table(spark, sf_dir, "conversations"), keep_types=False)


@register(
    "redact_with_deny_list",
    f"SELECT doc_id, {person_sql('text', new=PERSON_NEW.replace('THEN', 'AND ' + unmark('x') + ''' NOT IN ('Anna Meier', 'Apache License') THEN''', 1))} AS text FROM ({LETTER_SQL})",
)
def redact_with_deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Redaction(deny=("Anna Meier", "Apache License"))
    return redact_table(table(spark, sf_dir, "documents", LETTER), rule=rule)


@register(
    "redact_phones",
    f"SELECT doc_id, regexp_replace(text, '{FOLLOWED}', '[Telefon]\\2', 'g') AS text FROM ({LETTER_SQL})",
)
def redact_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Redaction(("PHONE_NUMBER",), {"PHONE_NUMBER": Operator(new_value="[Telefon]")})
    return redact_table(table(spark, sf_dir, "documents", LETTER), rule=rule)


MASKED_SQL = f"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '{FOLLOWED}', 1) AS hits,
  regexp_split_to_array(regexp_replace(text, '{FOLLOWED}', '{OPEN}\\2', 'g'), '{OPEN}') AS rest FROM ({LETTER_SQL}))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(list_zip(rest, list_transform(hits, lambda x: left(x, length(x) - 10) || '**********')),
  lambda z: z[1] || coalesce(z[2], '')), '') END AS text FROM p
"""


@register("mask_phones", MASKED_SQL)
def mask_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_table(table(spark, sf_dir, "documents", LETTER), rule=Redaction(("PHONE_NUMBER",)))


@register(
    "redact_persons_and_phones",
    f"WITH m AS ({MASKED_SQL}) SELECT doc_id, {person_sql('text')} AS text FROM m",
)
def redact_persons_and_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_table(table(spark, sf_dir, "documents", LETTER), rule=Redaction(("PERSON", "PHONE_NUMBER")))


@register(
    "simple_person_recogniser",
    f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all({edges('text')}, '{SIMPLE_SQL}')) AS x FROM ({LETTER_SQL}))
SELECT doc_id, {unmark('x')} AS text, count(*) AS n FROM m WHERE {plausible_sql(unmark('x'))} GROUP BY ALL
""",
)
def simple_person_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Its score of 0.40 needs a lower threshold than the default.
    spans = entity_spans(table(spark, sf_dir, "documents", LETTER), "doc_id", "text", Redaction(("PERSON_SIMPLE",), threshold=0.4))
    return spans.groupBy("doc_id", "text").agg(F.count("*").alias("n"))


SPANS_SQL = f"""
WITH t AS (SELECT doc_id, {edges('text')} AS t FROM ({LETTER_SQL})),
p AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '{PERSON_SQL}'), lambda x: {unmark('x')}) AS rest,
  list_transform(regexp_extract_all(t, '{PERSON_SQL}'), lambda x: {unmark('x')}) AS hits FROM t),
e AS (SELECT doc_id, rest, hits, unnest(range(1, length(hits) + 1)) AS i FROM p),
s AS (SELECT doc_id, hits[i] AS text,
  cast(list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS integer) AS "start" FROM e)
SELECT doc_id, 'PERSON' AS entity, "start", cast("start" + length(text) AS integer) AS "end", text, 0.85::double AS score FROM s WHERE {plausible_sql('text')}
"""


@register("entity_spans", SPANS_SQL)
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_spans(table(spark, sf_dir, "documents", LETTER), "doc_id", "text")


@register(
    "entity_counts",
    f"""
SELECT 'PERSON' AS entity, count(*) AS n FROM ({SPANS_SQL})
UNION ALL SELECT 'PHONE_NUMBER', sum(length(regexp_extract_all(text, '{FOLLOWED}'))) FROM ({LETTER_SQL})
""",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", LETTER)
    return entity_counts(entity_spans(df, "doc_id", "text", Redaction(("PERSON", "PHONE_NUMBER"))))


SPAN = (
    "CASE c_custkey % 11 WHEN 0 THEN 'Anna Meier' WHEN 1 THEN 'Der Kunde' WHEN 2 THEN 'Hans von Allmen' WHEN 3 THEN 'CHF Franken' "
    "WHEN 4 THEN 'Anna Meier2' WHEN 5 THEN 'Anne-Marie Keller' WHEN 6 THEN 'Anna' WHEN 7 THEN NULL WHEN 8 THEN ' Zoë Öhri ' "
    "WHEN 9 THEN 'von Allmen' ELSE c_name || ' ' || c_mktsegment END AS span"
)


@register(
    "plausible_person",
    f"SELECT c_custkey, coalesce(span IN ('Anna Meier', 'Hans von Allmen', ' Zoë Öhri '), false) AS plausible FROM (SELECT c_custkey, {SPAN} FROM customer)",
)
def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer", ["c_custkey", SPAN])
    return df.select("c_custkey", plausible_person(F.col("span")).alias("plausible"))
