"""Toxicity scores from a weighted lexicon.

Matching. Words are lower-cased and stripped of signs, and words spelled out
letter by letter are joined; the text is then searched once with an
Aho-Corasick automaton that holds the lexicon and its exception phrases. Of
the terms that begin at one word the longest decides, and a hit inside an
exception phrase does not count. A word without a hit that has accents,
look-alike letters of other scripts, full-width letters, invisible characters,
digits, signs or separators in it, or that was spelled out with some, is folded
to plain letters and searched again. The
weights of the hits are normalised by the number of words and turned into a
probability by a small logistic fit.

Learning. The lexicon, its weights, the exceptions and the logistic curve come
from labelled rows: at most ``max_rows`` of them, chosen by a hash of the id
(the bound of the fit; everything else covers all rows). Candidates are whole
words and beginnings of words, which catches inflected forms that were never
seen. Their support is counted in different contexts (neighbouring words), so
that copies of one text count once. A term enters if its log-likelihood ratio
beats what the best of that many candidates would reach by chance. A word that
also stands in harmless phrases (with one word before or after) is judged
without them: a phrase found in label-0 rows only, in so many contexts that the
word's other uses would hardly all have missed label 1, becomes an exception
and leaves the word's counts before the weight is looked at. Words that
begin with a term and have support of their own are listed with their own
weight (0 for harmless ones), and the term speaks for the rest.

Defined results: null and empty texts have no hit and get the score of a text
without hits; without labelled rows of both classes the lexicon is empty and
every score is the share of label 1 (0 without labels); repeated rows score
alike; extra columns pass through and those named like an output are replaced;
an empty table gives an empty result; of terms that begin at one place the
longest decides, so there is no tie; a very long text is searched whole.
Bounds of the fit, none of which touches the texts that are scored:
``max_rows`` labelled rows, words of 3 to 40 characters as candidates,
``max_terms`` terms (the strongest first), 20 times as many words that begin
with one, and ``max_phrases`` exceptions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hold, labelled_sample, staged

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ℓ": "l",
}
# Digits and signs written for letters (1 and ! also for l).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for low, high in ((0xC0, 0x2100), (0x2100, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for code in range(low, high):
            base = unicodedata.normalize("NFKD", chr(code)).lower()
            plain = "".join(c for c in base if not unicodedata.combining(c))
            if plain != chr(code) and plain and all(c.isascii() or c in LOOK_ALIKES for c in plain):
                table[code] = "".join(LOOK_ALIKES.get(c, c) for c in plain)
    table |= {ord(k): v for k, v in LOOK_ALIKES.items()}
    table |= {c: None for c in [0xAD, 0x2060, 0xFEFF, 0x180E, *range(0x200B, 0x2010), *range(0x300, 0x370)]}
    return table


_FOLD = _table()
_SIGN_I = str.maketrans(SUBSTITUTES)
_SIGN_L = str.maketrans(SUBSTITUTES | {"1": "l", "!": "l", "|": "l"})
_DOTTED = re.compile(r"[^\W_](?:[.\-_*·][^\W_]){3,}")
_SPACED = re.compile(r"(?<= )[^\W_](?: [^\W_]){3,}(?= )")
_SIGNS = re.compile(r"[\W_]+")


_SEPARATORS = re.compile(r"(?<=\w)[.\-_*·](?=\w)")


def _fold_word(word: str) -> str:
    low = word.lower()
    if low.isalpha():
        return low
    if _DOTTED.fullmatch(low):
        return _SIGNS.sub("", low)
    return _SIGNS.sub(" ", low).strip()


def plain_forms(word: str) -> list[str]:
    """What a disguised word may stand for, in plain letters."""
    low = word.lower().strip(".,;:?\"'()[]")
    if low.isascii() and low.isalpha():
        return []
    low = low.translate(_FOLD)
    made = []
    for form in dict.fromkeys((low, _SEPARATORS.sub("", low))):
        made += [form.translate(t).strip("#*%&+-=~^_ ") for t in (_SIGN_I, _SIGN_L)]
        made += [form.rstrip("!|$@#*%&").translate(t) for t in (_SIGN_I, _SIGN_L)]
    return [w for w in dict.fromkeys(made) if w.isascii() and w.isalpha()]


class _Folded(dict):
    """Word -> folded word, as words repeat; bounded."""

    def __missing__(self, word: str) -> str:
        found = _fold_word(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = found
        return found


_FOLDED = _Folded()


def _unfold() -> None:
    _FOLDED.clear()


def fold(text: str | None, spelled: list[str] | None = None) -> str:
    """Folded words, each between single spaces: `` one two ``. ``spelled``
    gets the words that were spelled out and are not plain letters."""
    if not text:
        return " "
    known = _FOLDED
    joined = " ".join(["", *filter(None, [known[w] for w in text.split()]), ""])
    joined = joined if len(joined) > 1 else " "

    def whole(m: re.Match) -> str:
        word = m[0].replace(" ", "")
        if spelled is not None and not (word.isascii() and word.isalpha()):
            spelled.append(word)
        return word

    return _SPACED.sub(whole, joined)


@dataclass
class Lexicon:
    """Terms (`` begin`` matches word beginnings, `` word `` whole words) with
    weights, exception phrases, and the logistic curve of the score."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    def matcher(self):
        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        for term, weight in self.terms.items():
            if term not in self.exceptions:
                machine.add_word(term, (len(term), weight))
        if len(machine):
            machine.make_automaton()
        return machine


def hits(folded: str, machine) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon hits outside exception phrases: of
    terms that begin at the same place the longest decides."""
    if not len(machine):
        return []
    found: dict[int, tuple[int, float]] = {}
    spared = []
    for last, (n, weight) in machine.iter(folded):
        start = last - n + 1
        if weight is None:
            spared.append((start, last + 1))
        elif start not in found or found[start][0] < last + 1:
            found[start] = (last + 1, weight)
    return [
        (s, e, w)
        for s, (e, w) in sorted(found.items())
        if w > 0 and not any(a <= s and e <= b for a, b in spared)
    ]


class Matcher:
    """The automaton of a lexicon with a bounded table of disguised words."""

    def __init__(self, lexicon: Lexicon):
        self.machine = lexicon.matcher()
        self.disguised: dict[str, float] = {}

    def _unmasked(self, word: str) -> float:
        if not hits(f" {_fold_word(word)} ", self.machine):
            for plain in plain_forms(word):
                if got := hits(f" {plain} ", self.machine):
                    return got[0][2]
        return 0.0

    def features(self, text: str | None) -> tuple[float, int, list[str]]:
        """Total weight of the hits, number of words, and the matched words."""
        spelled: list[str] = []
        folded = fold(text, spelled)
        got = hits(folded, self.machine)
        weight = sum(w for _, _, w in got)
        words = [folded[s + 1 : folded.index(" ", s + 1)] for s, _, _ in got]
        if len(self.machine):
            known = self.disguised
            for word in (text or "").split() + spelled:
                if word.isascii() and word.isalpha():
                    continue
                if (w := known.get(word)) is None:
                    if len(known) > 200_000:
                        known.clear()
                    w = known[word] = self._unmasked(word)
                if w:
                    weight += w
                    words.append(word)
        return float(weight), max(folded.count(" ") - 1, 0), words


def _inputs(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Inputs of the curve: any evidence, and evidence by length."""
    return np.stack([np.log1p(weight), np.log1p(weight * 100.0 / (100.0 + n))], axis=1)


def score(weight: np.ndarray, n: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    if not lexicon.terms:
        return np.full(len(weight), lexicon.prior)
    a, b, c = lexicon.curve
    x = _inputs(weight, n)
    return 1.0 / (1.0 + np.exp(-np.clip(a + x[:, 0] * b + x[:, 1] * c, -40, 40)))


def fit_curve(weight: np.ndarray, n: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are kept at 0 or above."""
    x = np.hstack([np.ones((len(weight), 1)), _inputs(weight, n)])
    used = [0, 1, 2]
    while True:
        beta = np.zeros(3)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (label - p) - ridge * beta * [0, 1, 1]
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
            step = np.zeros(3)
            step[used] = np.linalg.solve(hess[np.ix_(used, used)], grad[used])
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k in used if k and beta[k] < 0]
        if not bad:
            return tuple(float(b) for b in beta)
        used = [k for k in used if k not in bad]


def _g2(p, n, pos, neg):
    """Signed log-likelihood ratio of p : n against pos : neg."""
    share = pos / (pos + neg)
    total = p + n
    expected = total * share
    part = F.when(p > 0, p * F.log(p / expected)).otherwise(0.0) + F.when(
        n > 0, n * F.log(n / (total - expected))
    ).otherwise(0.0)
    return F.when(p > expected, 2.0 * part).otherwise(-2.0 * part)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 4,
    held_out: int = 2,
    max_rows: int = 20_000,
    max_terms: int = 5_000,
    min_stem: int = 4,
    max_stem: int = 12,
    min_weight: float = 2.0,
    max_phrases: int = 1_000,
) -> Lexicon:
    """Lexicon from the labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, folds, held_out, max_rows).select("text", "label")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_unfold)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                words = fold(text.as_py()).split()
                # the first row of a word stands for the document, all rows for their contexts
                rows = {}
                for a, w, b in zip(["", *words[:-1]], words, [*words[1:], ""]):
                    if 2 < len(w) <= 40:
                        rows.setdefault(w, []).append(f"{a} {b}")
                if rows:
                    out = [(w, c, k == 0) for w, cs in rows.items() for k, c in enumerate(dict.fromkeys(cs))]
                    w, c, k = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(w, pa.string()),
                            pa.array(c, pa.string()),
                            pa.array(k, pa.bool_()),
                            pa.array([y.as_py()] * len(w), pa.int32()),
                        ],
                        names=["word", "context", "doc", "label"],
                    )

    contexts_of = F.least(F.col("docs"), F.col("contexts")).cast("double")
    seen = staged(
        sample.mapInArrow(contexts, "word string, context string, doc boolean, label int")
        .groupBy("word", "label", F.xxhash64("context").alias("context"))
        .agg(F.sum(F.col("doc").cast("int")).alias("docs"))
        .groupBy("word", "label")
        .agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("contexts"))
        .groupBy("word")
        .agg(
            F.sum(F.when(F.col("label") == 1, contexts_of).otherwise(0.0)).alias("p"),
            F.sum(F.when(F.col("label") == 1, 0.0).otherwise(contexts_of)).alias("n"),
        ),
        "words",
    )
    begins = F.transform(
        F.sequence(F.lit(min_stem), F.greatest(F.least(F.length("word"), F.lit(max_stem)), F.lit(min_stem))),
        lambda k: F.concat(F.lit(" "), F.col("word").substr(F.lit(1), k)),
    )
    whole = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    forms = F.when(F.length("word") >= min_stem, F.array_append(begins, whole)).otherwise(F.array(whole))
    counted = (
        seen.select(F.explode(forms).alias("term"), "p", "n").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    pos, neg, tried = seen.agg(
        F.coalesce(F.sum("p"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0)), F.count(F.lit(1))
    ).first()
    if not pos or not neg:
        share = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        return Lexicon(prior=float(share))
    chance = 2.0 * np.log(tried + 1.0) + 4.0
    strong = (
        counted.withColumn("g2", _g2(F.col("p"), F.col("n"), F.lit(pos), F.lit(neg)))
        .filter(F.col("g2") >= float(chance))
        .orderBy(F.desc("g2"), F.desc(F.length("term")), "term")
        .limit(max_terms)
        .collect()
    )
    roots = [r.term for r in strong if _weight(r.p, r.n, pos, neg) >= min_weight]
    # whole words that are toxic too often by chance, though not by their weight
    torn = {r.term: (r.p, r.n) for r in strong if r.term.endswith(" ") and r.term not in set(roots) and r.p > 0}
    torn = _without_phrases(sample, torn, max_phrases)
    torn = {t: c for t, c in torn.items() if _weight(*c, pos, neg) >= min_weight}
    roots += torn
    stems = [t for t in roots if not t.endswith(" ")]
    below = F.lit(False)
    for k in sorted({len(t) for t in stems}):
        below |= F.col("term").substr(1, k).isin(*[t for t in stems if len(t) == k])
    family = (
        counted.filter(below & (F.col("p") + F.col("n") >= 3))
        .orderBy(F.desc(F.col("p") + F.col("n")), "term")
        .limit(20 * max_terms)
        .collect()
        if stems
        else []
    )
    chosen = set(roots)
    counts = {r.term: (r.p, r.n) for r in family} | {r.term: (r.p, r.n) for r in strong if r.term in chosen} | torn
    lexicon = Lexicon(_weights(counts, pos, neg, min_weight))
    if lexicon.terms:
        lexicon.exceptions = tuple(_exceptions(_hit_contexts(sample, lexicon), max_phrases))
    return _calibrated(sample, lexicon)


def _weight(p: float, n: float, pos: float, neg: float) -> float:
    return float(np.log((p + 0.5) / (pos + 1.0)) - np.log((n + 0.5) / (neg + 1.0)))


def _weights(counts: dict[str, tuple[float, float]], pos: float, neg: float, min_weight: float) -> dict[str, float]:
    """Weight of each term from the support that no longer listed term has;
    0 (harmless) below ``min_weight``. Terms that change nothing are left out."""
    rest = {t: list(c) for t, c in counts.items()}
    above: dict[str, str | None] = {}
    for term, (p, n) in counts.items():
        above[term] = up = next((term[:k] for k in range(len(term) - 1, 0, -1) if term[:k] in counts), None)
        if up:
            rest[up][0] -= p
            rest[up][1] -= n
    out: dict[str, float] = {}
    for term in sorted(counts, key=len):
        p, n = max(rest[term][0], 0.0), max(rest[term][1], 0.0)
        if p + n < 3:  # next to nothing of its own: as its whole family
            p, n = counts[term]
        weight = _weight(p, n, pos, neg)
        weight = weight if weight >= min_weight else 0.0
        if weight or above[term]:
            out[term] = weight
    return out if any(out.values()) else {}


def _hit_contexts(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(term, context, before, after, doc, label): the surroundings of the
    hits, each once per document; ``doc`` marks a term's first row there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_unfold)
        machine = lexicon.matcher()
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0), batch.column(1)):
                folded, rows = fold(text.as_py()), {}
                for s, e, _ in hits(folded, machine):
                    end = folded.index(" ", s + 1) + 1
                    left, right = max(folded.rfind(" ", 0, s), 0), folded.find(" ", end)
                    right = len(folded) if right < 0 else right + 1
                    rows.setdefault(folded[s:e], {})[folded[left:right]] = (folded[left:end], folded[s:right])
                for term, around in rows.items():
                    out += [(term, c, *x, k == 0, y.as_py()) for k, (c, x) in enumerate(around.items())]
            if out:
                kinds = [pa.string()] * 4 + [pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                    names=["term", "context", "before", "after", "doc", "label"],
                )

    return sample.mapInArrow(run, "term string, context string, before string, after string, doc boolean, label int")


def _exceptions(contexts: DataFrame, max_phrases: int, min_contexts: int = 5) -> list[str]:
    """Phrases of a hit and the word before or after it that are harmless: in
    no label-1 row, and in so many label-0 contexts (``min_contexts`` at least)
    that, if the term were there as often toxic as elsewhere, this would happen
    to one of a thousand phrases."""
    phrases = (
        contexts.select("term", "context", "label", F.explode(F.array("before", "after")).alias("phrase"))
        .filter(F.col("phrase").rlike(r"^ \S+ \S+ $"))
        .groupBy("term", "phrase")
        .agg(F.max("label").alias("toxic"), F.countDistinct("context").alias("contexts"))
        .filter((F.col("toxic") == 0) & (F.col("contexts") >= min_contexts))
    )
    uses = contexts.groupBy("term").agg(
        F.countDistinct(F.when(F.col("label") == 1, F.col("context"))).alias("p"),
        F.countDistinct(F.when(F.col("label") != 1, F.col("context"))).alias("n"),
    )
    elsewhere = F.greatest(F.col("n") - F.col("contexts"), F.lit(0))
    share = (F.col("p") + 0.5) / (F.col("p") + elsewhere + 1.0)
    counted = (
        phrases.join(uses, "term")
        .filter(F.col("contexts") * -F.log(F.greatest(1.0 - share, F.lit(1e-9))) >= float(np.log(1000.0)))
        .groupBy("phrase")
        .agg(F.max("contexts").alias("contexts"))
        .orderBy(F.desc("contexts"), "phrase")
        .limit(max_phrases)
    )
    return [r.phrase for r in counted.collect()]


def _without_phrases(
    sample: DataFrame, words: dict[str, tuple[float, float]], max_phrases: int
) -> dict[str, tuple[float, float]]:
    """The words that have exceptions, with their support outside of them."""
    if not words:
        return {}
    contexts = staged(_hit_contexts(sample, Lexicon(dict.fromkeys(words, 1.0))), "torn")
    phrases = _exceptions(contexts, max_phrases)
    if not phrases:
        return {}
    outside = ~(F.col("before").isin(phrases) | F.col("after").isin(phrases))
    touched = F.max(F.when(outside, 0).otherwise(1)) == 1
    clear = F.when(outside & (F.col("label") != 1), F.col("context"))
    left = (
        contexts.groupBy("term")
        .agg(touched.alias("touched"), F.countDistinct(clear).alias("contexts"))
        .filter("touched")
        .collect()
    )
    # at most ``max_terms`` words
    return {r.term: (words[r.term][0], min(words[r.term][1], float(r.contexts))) for r in left if r.term in words}


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The curve from (weight, words, label) of the sample's rows: three
    numbers a row, at most ``max_rows`` rows."""
    rows = scored_inputs(sample, lexicon).select("weight", "n_words", "label").toArrow()
    weight, n, y = (np.asarray(rows.column(k), dtype=np.float64) for k in range(3))
    lexicon.prior = float(y.mean()) if len(y) else 0.0
    lexicon.curve = fit_curve(weight, n, y)
    return lexicon


def scored_inputs(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with weight, n_words and the matched words (``hits``)."""
    made = ("weight", "n_words", "hits")
    kept = docs.select(*[c for c in docs.columns if c not in made])
    at = kept.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_unfold)
        matcher = Matcher(sent.value)
        for batch in batches:
            got = [matcher.features(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([g[0] for g in got], pa.float64()),
                    pa.array([g[1] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, *made],
            )

    schema = kept.withColumns(
        {
            "weight": F.lit(0.0),
            "n_words": F.lit(0).cast("long"),
            "hits": F.array(F.lit("")),
        }
    ).schema
    return kept.mapInArrow(run, schema)


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with weight, n_words, hits and ``score`` (0 to 1)."""
    found = scored_inputs(docs.select(*[c for c in docs.columns if c != "score"]), lexicon)
    if not lexicon.terms:
        return found.withColumn("score", F.lit(float(lexicon.prior)))
    a, b, c = lexicon.curve
    weight, n = F.col("weight"), F.col("n_words")
    z = F.lit(a) + F.log1p(weight) * b + F.log1p(weight * 100.0 / (F.lit(100.0) + n)) * c
    z = F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))
    return found.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below ``threshold``."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_unfold)
        known = sent.value
        matcher = Matcher(known)
        for batch in batches:
            got = [matcher.features(x.as_py())[:2] for x in batch.column(at)]
            weight, n = (np.array([g[k] for g in got], dtype=np.float64) for k in (0, 1))
            yield batch.filter(pa.array(score(weight, n, known) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
