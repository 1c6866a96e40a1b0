"""Find and replace person names and Swiss phone numbers in free text.

One regular expression finds candidates, plain expressions decide which are plausible, and the text is put
together again around them. No language model takes part: recall is lower and the result is reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.functions.names import column as named
from maskflow.functions.running import placed

# Particles inside a name, and first words that no name begins with.
PARTICLES = ["von", "van", "de", "der", "den", "di", "du", "le", "la"]
DENY_START = ["Der", "Die", "Das", "Dem", "Den", "Ein", "Eine", "Einem", "Einen"]

# The word shape of a name, the phone pattern, the scores and the score threshold.
NAME_WORD = "[A-ZÄÖÜ][a-zäöüß]+"
PHONE_BODY = r"(?:(?:\+41|0041)\s?\(?[0-9]{1,2}\)?|0[0-9]{2})[\s\-]?[0-9]{3}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2}"
SCORES = {"PERSON": 0.85, "PHONE_NUMBER": 0.85, "PERSON_SIMPLE": 0.40}
SCORE_THRESHOLD = 0.70

# Word edges spelled out, since the meaning of \b differs between regular expression engines.
_BLANK = r"[\s\p{Z}]"
_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"

# A look at the first character rules out most places at once.
_CAPITAL, _PHONE_START = "(?=[A-ZÄÖÜ])", "(?=[0+])"

# A word of a candidate is any capitalised word, hyphenated ones as a whole; no candidate begins with a denied word.
CANDIDATE_WORD = r"\p{Lu}\p{Ll}+"
_WORD = f"{CANDIDATE_WORD}(?:-{CANDIDATE_WORD})*"
_NOT_DENIED = f"(?!(?:{'|'.join(DENY_START)}){_NOT_BEFORE_WORD})"

SIMPLE_PERSON = f"{_CAPITAL}{_NOT_AFTER_WORD}{NAME_WORD}(?:{_BLANK}+{NAME_WORD})+{_NOT_BEFORE_WORD}"
PERSON = (
    rf"(?=\p{{Lu}}){_NOT_AFTER_WORD}{_NOT_DENIED}{_WORD}"
    f"(?:{_BLANK}+(?:(?:{'|'.join(PARTICLES)}){_BLANK}+)*{_WORD})+{_NOT_BEFORE_WORD}"
)
PHONE = f"{_PHONE_START}{PHONE_BODY}{_NOT_BEFORE_WORD}"
PATTERNS = {"PERSON": PERSON, "PERSON_SIMPLE": SIMPLE_PERSON, "PHONE_NUMBER": PHONE}


@dataclass(frozen=True)
class Operator:
    """What happens to a found span: replaced by a text, or its last characters masked."""

    kind: str = "replace"
    new_value: str = "<ANONYMIZED>"
    masking_char: str = "*"
    chars_to_mask: int = 10
    from_end: bool = True

    def apply(self, span: Column) -> Column:
        if self.kind == "replace":
            return F.lit(self.new_value)
        if self.kind != "mask":
            raise ValueError(f"unknown operator {self.kind!r}")
        hidden = F.least(F.length(span), F.lit(self.chars_to_mask))
        stars = F.repeat(F.lit(self.masking_char), hidden)
        if self.from_end:
            return F.concat(F.substring(span, F.lit(1), F.length(span) - hidden), stars)
        return F.concat(stars, F.substring(span, hidden + 1, F.length(span)))


OPERATORS = {
    "DEFAULT": Operator(),
    "PERSON": Operator(new_value="<PERSON>"),
    "PHONE_NUMBER": Operator(kind="mask"),
}


@dataclass(frozen=True)
class Redaction:
    """Which entities to look for, what to do with them, and words that are no names."""

    entities: tuple[str, ...] = ("PERSON",)
    operators: dict[str, Operator] = field(default_factory=lambda: dict(OPERATORS))
    deny: tuple[str, ...] = ()
    threshold: float = SCORE_THRESHOLD

    def operator(self, entity: str) -> Operator:
        name = "PERSON" if entity == "PERSON_SIMPLE" else entity
        return self.operators.get(name, self.operators.get("DEFAULT", Operator()))

    def active(self) -> list[str]:
        """Entities whose recogniser scores high enough."""
        for entity in self.entities:
            if entity not in PATTERNS:
                raise ValueError(f"unknown entity {entity!r}; known are {sorted(PATTERNS)}")
        return [e for e in self.entities if SCORES[e] >= self.threshold]


def plausible_person(span: Column) -> Column:
    """At least two capitalised words besides particles; no digit, no all-capitals word, no article in front."""
    trimmed = F.regexp_replace(span, rf"^{_BLANK}+|{_BLANK}+$", "")
    parts = F.split(trimmed, rf"{_BLANK}+", -1)
    names = F.filter(parts, lambda w: ~F.lower(w).isin(PARTICLES))
    clean = ~span.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉]")
    no_article = ~F.element_at(parts, 1).isin(DENY_START)
    no_capitals = ~F.exists(parts, lambda w: w.rlike("^[A-ZÄÖÜ]{2,}$"))
    title_case = F.forall(names, lambda w: w.rlike(r"^\p{Lu}(?=.*\p{Ll})[^\p{Lu}\p{Lt}]+$"))
    return F.coalesce(clean & no_article & no_capitals & title_case & (F.size(names) >= 2), F.lit(False))


def _keep_span(entity: str, span: Column, rule: Redaction) -> Column:
    if entity == "PHONE_NUMBER":
        return F.lit(True)
    # The parts of a hyphenated name count as one word.
    good = plausible_person(F.regexp_replace(span, r"-\p{Lu}", "") if entity == "PERSON" else span)
    return good & ~span.isin(list(rule.deny)) if rule.deny else good


def _redact_entity(value: Column, entity: str, rule: Redaction) -> Column:
    pattern = PATTERNS[entity]
    hits = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
    rest = F.split(value, pattern, -1)
    operator = rule.operator(entity)

    def piece(between: Column, hit: Column) -> Column:
        # There is one text piece more than there are hits.
        new = F.when(_keep_span(entity, hit, rule), operator.apply(hit)).otherwise(hit)
        return F.when(hit.isNotNull(), F.concat(between, new)).otherwise(between)

    rebuilt = F.array_join(F.zip_with(rest, hits, piece), "")
    # Most texts have no candidate and pass with a single scan.
    return F.when(value.rlike(pattern), rebuilt).otherwise(value)


def redact_text(value: Column, rule: Redaction | None = None) -> Column:
    """The text with its entities replaced; null stays null."""
    rule = rule or Redaction()
    for entity in rule.active():
        value = _redact_entity(value, entity, rule)
    return value


def redact_table(
    df: DataFrame,
    columns: list[str] | None = None,
    rule: Redaction | None = None,
    keep_types: bool = True,
    errors: str = "log",
) -> DataFrame:
    """Redact every text cell of the chosen columns (all by default).

    With `keep_types=False` other columns are cast to text and redacted too. Columns that do not exist are an
    error only with `errors="raise"`.
    """
    if errors not in ("raise", "log", "ignore"):
        raise ValueError("errors must be raise, log or ignore")
    missing = [c for c in columns or [] if c not in df.columns]
    if missing and errors == "raise":
        raise ValueError(f"no such columns: {missing}")
    rule = rule or Redaction()
    chosen = set(df.columns if columns is None else columns)
    texts = [
        f.name for f in df.schema.fields if f.name in chosen and (isinstance(f.dataType, T.StringType) or not keep_types)
    ]
    if not keep_types:
        df = df.select(*[(named(c).cast("string") if c in texts else named(c)).alias(c) for c in df.columns])
    # One projection per entity, so that each pattern reads a column and not the work of the one before it.
    for entity in rule.active():
        df = df.select(
            *[(_redact_entity(named(c), entity, rule) if c in texts else named(c)).alias(c) for c in df.columns]
        )
    return df


def entity_spans(df: DataFrame, id_column: str, text_column: str, rule: Redaction | None = None) -> DataFrame:
    """One row per entity: id, entity, zero-based start and end, text, score.

    Places are summed inside each row, so that nothing is shuffled and ids may repeat.
    """
    rule = rule or Redaction()
    found = None
    for entity in rule.active():
        pattern = PATTERNS[entity]
        value = named(text_column)
        hits = F.filter(placed(value, pattern), lambda p: p["whole"].isNotNull())
        rows = df.filter(value.rlike(pattern)).select(named(id_column).alias(id_column), F.explode(hits).alias("hit"))
        rows = rows.select(
            named(id_column), (F.col("hit.at") + F.length("hit.before")).alias("start"), F.col("hit.whole").alias("text")
        )
        spans = rows.filter(_keep_span(entity, F.col("text"), rule)).select(
            named(id_column).alias(id_column),
            F.lit("PERSON" if entity == "PERSON_SIMPLE" else entity).alias("entity"),
            "start",
            (F.col("start") + F.length("text")).alias("end"),
            "text",
            F.lit(SCORES[entity]).alias("score"),
        )
        found = spans if found is None else found.unionByName(spans)
    if found is None:
        raise ValueError("no entity reaches the score threshold")
    return found


def entity_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity").agg(F.count("*").alias("n"))
