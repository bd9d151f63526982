"""Personal data: patterns, and terms that give a protected entity away.

Base spans are e-mail and IP addresses, card and phone numbers found by
pattern and checked (number ranges, digit counts, check digit). Each value is
a protected entity. From the corpus the operator then estimates how strongly a
term reveals an entity. Everything is counted in documents: of M different
texts n_e hold the entity, n_et of them with the term among the ``REACH`` words
before or after it, and cf rows hold the term anywhere;

    PMI(e, t) = ln(n_et * M / (n_e * cf))     IC(e) = ln(M / n_e)
    disclosure = PMI / IC * n_et / (n_et + 1) * m / (m + 1),  m = min(n_e, cf)

PMI / IC is the share of the entity's information that the term gives away: 1
for a term that stands only beside that entity, near 0 for a common word. The
last two factors discount what little support cannot prove: an exclusive term
reaches 0.25 by one document, 0.44 by two, 0.56 by three, 0.69 by five. Terms
of any length, numbers too, compete under the same ``threshold``: 0.4 asks for
proof by two documents, 0.25 is the strict policy under which a word that the
whole corpus holds only beside that entity is disclosing, seen once or often.
Terms at or above it are marked wherever they stand in a text that holds the entity.
``sanitize`` replaces base spans by their kind, generalises disclosing terms,
and removes those at ``removal`` or above.

Copies prove nothing: texts with an entity that are equal or near copies count
as one, by sketches, in n_e, n_et and in the part of cf beside an entity. Each of ``SKETCHES`` hash functions names a text by the
smallest hash of its words, which edited copies mostly share; n_e and n_et are
the smallest number of different names that any of the functions gives.

Only DataFrame functions are used. Counts cover all texts. Pairs of entity and
term are aggregated map-side, so that a frequent entity is spread over its
terms; only terms with enough documents beside one entity to reach the
threshold at all (two for the default of 0.4) are looked up in the corpus's
word counts, which are combined map-side. Texts are shuffled only where they hold a disclosing term.

Defined results: a null text is empty and has no span; rows with equal texts
get equal spans; of overlapping terms the longest that begins first is marked;
a very long text is searched whole and a very long word is a word; columns
named like an output are replaced, others pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, staged

REACH = 5  # words of context on either side
SKETCHES = 4
BROADCAST_ROWS = 100_000
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Possessive forms of the contract's patterns: a match begins where a run of
# its first class begins, so a failed run is not tried again from its middle
# (a long run without a match would cost the square of its length).
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of fewer than 13 digits would be dropped anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_TERM = r"[\p{L}\p{N}]+"
_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.when(n.between(13, 19), F.call_function("luhn_check", digits)).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _placed(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with their code point positions: what stands between two
    matches tells how far apart they are."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    step = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    return F.aggregate(step, start, add, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """Checked spans of all kinds, by kind as listed and then by start."""
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for kind, pattern in PATTERNS.items():
        hint = F.instr(text, _NEEDS[kind]) > 0 if _NEEDS[kind] else text.rlike("[0-9]")
        spans = F.filter(_placed(text, F.lit(pattern), kind), _checked(kind))
        parts.append(F.when(hint, spans).otherwise(none))
    return F.concat(*parts)


def _entity(span: Column) -> Column:
    """Kind and value in one spelling."""
    plain = F.when(
        span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")
    ).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _contexts(text: Column, spans: Column) -> Column:
    """For each span its entity and the whole words beside it, up to ``REACH``
    on either side; words that the span touches are left out."""

    def around(words: Column) -> Column:
        def one(s: Column) -> Column:
            before = F.substring(text, F.lit(1), s["start"])
            ended = before.rlike(r"(^|[\x20\x09-\x0D])$")
            left = F.regexp_count(before, F.lit(WORD)) - F.when(ended, 0).otherwise(1)
            right = F.regexp_count(F.substring(text, F.lit(1), s["end"]), F.lit(WORD))
            begin = F.greatest(left - REACH, F.lit(0))
            return F.struct(
                _entity(s).alias("entity"),
                F.concat(F.slice(words, begin + 1, left - begin), F.slice(words, right + 1, REACH)).alias("words"),
            )

        return F.transform(spans, one)

    # an array of one, so that the words are made once for all spans
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(F.size(spans) > 0, F.transform(words, around)[0]).otherwise(
        F.array().cast("array<struct<entity:string,words:array<string>>>")
    )


def _names(text: Column) -> Column:
    """The names of a text: smallest word hash by each function."""

    def smallest(words: Column) -> Column:
        return F.array(*[F.array_min(F.transform(words, lambda w, i=i: F.xxhash64(w, F.lit(i)))) for i in range(SKETCHES)])

    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), smallest)[0]


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, text_key, spans, contexts and names
    (of texts with a span), one pass over the texts, staged once as several
    readers follow."""
    text = F.coalesce("text", F.lit(""))
    found = (
        docs.select("doc_id", text.alias("text"))
        .withColumn("spans", base_spans(F.col("text")))
        .select(
            "doc_id",
            F.md5("text").alias("text_key"),
            "spans",
            _contexts(F.col("text"), F.col("spans")).alias("contexts"),
            F.when(F.size("spans") > 0, _names(F.col("text"))).alias("names"),
        )
    )
    return staged(found, "pii")


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _terms_of(words: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.regexp_extract_all(F.lower(w), F.lit(_TERM), F.lit(0)))))


def disclosing_terms(docs: DataFrame, found: DataFrame, threshold: float = 0.4, removal: float = 0.6) -> DataFrame:
    """(entity, term, disclosure, removed) at or above ``threshold``."""
    # the fewest documents beside the entity that can reach the threshold
    fewest = next((n for n in range(1, 1000) if (n / (n + 1)) ** 2 >= threshold), 1000)
    beside = (
        found.select("names", F.explode("contexts").alias("c"))
        .select("names", "c.entity", _terms_of(F.col("c.words")).alias("terms"))
        .dropDuplicates(["entity", "names", "terms"])
    )
    # different names by each function; the least is counted
    support = F.least(*[F.countDistinct(F.col("names")[i]) for i in range(SKETCHES)])
    n_e = beside.groupBy(F.col("entity").alias("e")).agg(support.alias("n_e"))
    n_et = beside.select("names", "entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(support.alias("n_et"))
    pairs = staged(n_et.filter(F.col("n_et") >= fewest).join(n_e, F.col("entity") == F.col("e")).drop("e"), "pii-pairs")
    # rows that hold a term, counted map-side; of those beside an entity, copies count once
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_TERM), F.lit(0))
    rows_of = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    near = F.array_distinct(F.flatten(F.transform("contexts", lambda c: _terms_of(c["words"]))))
    copies = (
        found.filter(F.size("contexts") > 0)
        .select("names", F.explode(near).alias("near"))
        .groupBy("near")
        .agg((F.count(F.lit(1)) - support).alias("copies"))
    )
    frequency = rows_of.join(copies, F.col("term") == F.col("near")).select(
        "term", (F.col("rows") - F.col("copies")).alias("cf")
    )
    m = max(found.select("text_key").distinct().count(), 1)  # one number
    pmi = F.log(F.col("n_et") * F.lit(float(m)) / (F.col("n_e") * F.col("cf")))
    ic = F.log(F.greatest(F.lit(float(m)) / F.col("n_e"), F.lit(1.0 + 1e-9)))
    least = F.least("n_e", "cf")
    discount = F.col("n_et") / (F.col("n_et") + 1) * (least / (least + 1))
    return (
        pairs.join(frequency, "term")
        .select("entity", "term", (pmi / ic * discount).alias("disclosure"))
        .filter(F.col("disclosure") >= threshold)
        .withColumn("removed", F.col("disclosure") >= removal)
    )


def _term_spans(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(t_key, t_spans): where disclosing terms stand, by text."""
    held = (
        found.select("text_key", F.explode(F.array_distinct(F.transform("contexts", lambda c: c["entity"]))).alias("entity"))
        .distinct()
        .join(terms, "entity")
        .groupBy(F.col("text_key").alias("__t_key"))
        .agg(
            # bounded: the terms beside the entities of one text
            F.collect_set("term").alias("terms"),
            F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("removed"),
        )
    )
    held = staged(held, "pii-terms")
    texts = (
        docs.select(F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("__t_key", F.md5("text"))
        .join(_bounded(held), "__t_key")
        .dropDuplicates(["__t_key"])
    )
    longest_first = F.array_sort("terms", lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(
        F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])")
    )
    spans = _placed(F.col("text"), pattern, "term")
    return texts.select(
        "__t_key",
        F.transform(
            spans,
            lambda s: F.struct(
                s["kind"].alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.array_contains("removed", F.lower(s["value"])).alias("removed"),
            ),
        ).alias("__t_spans"),
    )


def detect(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per document: doc_id, text_key, base (spans) and terms (spans
    of disclosing terms, each with ``removed``)."""
    rows = docs.select("doc_id", "text")
    found = find(rows)
    marked = staged(_term_spans(rows, found, disclosing_terms(rows, found, **thresholds)), "pii-spans")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,removed:boolean>>")
    return (
        found.select("doc_id", "text_key", F.col("spans").alias("base"))
        .join(_bounded(marked), F.col("text_key") == F.col("__t_key"), "left")
        .select("doc_id", "text_key", "base", F.coalesce("__t_spans", none).alias("terms"))
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans replaced by ``<KIND>``, disclosing terms by
    ``<TERM>`` or nothing; of overlapping spans the first one's sign stands."""
    marks = F.concat(
        F.transform(
            base,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("minus_end"),
                F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("sign"),
            ),
        ),
        F.transform(
            terms,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("minus_end"),
                F.when(s["removed"], F.lit("")).otherwise(F.lit("<TERM>")).alias("sign"),
            ),
        ),
    )
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(gap, s["sign"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], -s["minus_end"]).alias("at"), out.alias("out"))

    done = F.aggregate(
        F.array_sort(marks),
        state,
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(marks) > 0, done).otherwise(text)


def sanitize(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (a null stays null);
    ``n_chars`` is brought up to date where there is one."""
    rows = docs.select("doc_id", "text")
    found = find(rows)
    marked = staged(_term_spans(rows, found, disclosing_terms(rows, found, **thresholds)), "pii-spans")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,removed:boolean>>")
    # base spans are found again in the row's own text, so texts need no
    # shuffle; what is joined is as large as the texts with disclosing terms
    keyed = F.md5(text) == F.col("__t_key")
    out = docs.join(_bounded(marked), keyed, "left")
    clean = F.when(F.col("text").isNotNull(), masked(text, base_spans(text), F.coalesce("__t_spans", none)))
    out = out.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
