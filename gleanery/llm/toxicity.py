"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton after folding.

*Folding* keeps every character at its place: case, homoglyphs (Cyrillic and Greek letters that look Latin, wide
and styled forms), and digits or signs that stand for a letter next to letters ("1d10t" reads "idiot").

*Lexicon*: terms with weights. A term is a whole word or a beginning of words. A word counts once, with the
largest weight of the terms that begin where it begins. *Exceptions* are phrases in which terms do not count.
Score: the logistic of `slope * log1p(sum of weights / characters ** power) + base`, so a long text needs more.

*Learning*: from labelled documents, at most `SAMPLE` of each label chosen by a hash of the id (the bound of the fit;
only its counts reach the driver). Candidates are all words and their beginnings of three to eight
letters. Of near copies in the sample (equal least hashes of three words in line, twice) one teaches, or else every word of a
passage copied ten times would look toxic. A candidate becomes a term if it leans to toxic documents beyond chance
(binomial large deviation bound, `CHANCE` terms expected by chance over all candidates) and by a factor of
`LEAST_LEAN`; its weight is the log of the factor. Words holding a term, and pairs of
words around one, that lean to clean documents as surely become exceptions. Power, slope and base are fitted to the sample's sums.

Defined cases: null and empty texts have no matches and get the score of a text without any. Repeated rows and null
ids are scored each on their own; null labels and labels without a document teach nothing; of several labels of one id the
largest counts. Where nothing can be learned, scores are the share of toxic documents in the sample, 0 without one. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.llm.common import slices, stored, table

#: Labelled documents of each label that a fit reads at most.
SAMPLE = 10_000
#: Letters of beginnings that are tried as terms, and the least factor by which a term leans to its side.
SHORTEST, LONGEST, LEAST_LEAN = 3, 8, 4.0
#: Candidates that may pass for terms by chance alone.
CHANCE = 4
#: Powers of the length tried in the fit.
POWERS = (0.0, 0.125, 0.25, 0.5, 0.75, 1.0)
#: Letters of other scripts that look like Latin ones, and signs that stand for letters (fixed values).
LOOKALIKES = dict(zip("аеорсхуікѕјһԁԛԝмтвнαβεικνορτυχωγ", "aeopcxyiksjhdqwmtbhabeiknoptuxwy"))
SIGNS = dict(zip("013457@$", "oieastas"))

_ODD = re.compile("[^\x00-ɏ]")
_SIGNS = re.compile("[" + re.escape("".join(SIGNS)) + "]+")
_WORD = re.compile(r"[^\W\d_]+")


def _same_place(match: re.Match) -> str:
    char = match[0]
    for form in (LOOKALIKES.get(char), unicodedata.normalize("NFKC", char).lower()):
        if form and len(form) == 1:
            return LOOKALIKES.get(form, form)
    return char


def fold(text: str) -> str:
    """The text as the lexicon reads it, as long as the text itself."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals grow when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not low.isascii():
        low = _ODD.sub(_same_place, low)
    parts, done = [], 0
    for run in _SIGNS.finditer(low):
        start, end = run.span()
        before, after = low[start - 1 : start].isalpha(), low[end : end + 1].isalpha()
        # Between letters any run stands for letters, at an end of a word only a single sign does.
        if (before and after) or ((before or after) and end - start == 1 and not low[start - 1 : start].isdigit() and not low[end : end + 1].isdigit()):
            parts += [low[done:start], "".join(SIGNS[c] for c in run[0])]
            done = end
    return "".join([*parts, low[done:]]) if parts else low


@dataclass
class Lexicon:
    """Terms: folded words, or beginnings of words written with a final `*`. Exceptions: folded phrases."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.0
    slope: float = 1.0
    base: float = 0.0

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        found: dict[str, list] = {}
        for term, weight in self.terms.items():
            text = fold(term.removesuffix("*"))
            found.setdefault(text, []).append((not term.endswith("*"), weight, term))
        for phrase in self.exceptions:
            found.setdefault(fold(phrase), []).append(None)
        made = ahocorasick.Automaton()
        for text, kinds in found.items():
            if text:
                made.add_word(text, (len(text), kinds))
        if len(made):
            made.make_automaton()
        return made

    def matches(self, automaton, folded: str) -> list[tuple[int, int, str, float]]:  # noqa: ANN001
        """Start, end, term and weight of the words that count, in order."""
        best: dict[int, tuple] = {}
        masked: list[tuple[int, int]] = []
        for last, (size, kinds) in automaton.iter(folded) if len(automaton) else ():
            end, start = last + 1, last + 1 - size
            if start and folded[start - 1].isalpha():
                continue
            closed = not folded[end : end + 1].isalpha()
            for kind in kinds:
                if kind is None:
                    if closed:
                        masked.append((start, end))
                    continue
                whole, weight, term = kind
                if (closed or not whole) and (start not in best or (weight, size) > (best[start][3], best[start][1] - start)):
                    best[start] = (start, end, term, weight)
        kept = sorted(best.values())
        if masked and kept:
            covered, reach, at = [], -1, 0
            masked.sort()
            for hit in kept:
                while at < len(masked) and masked[at][0] <= hit[0]:
                    reach = max(reach, masked[at][1])
                    at += 1
                if reach < hit[1]:
                    covered.append(hit)
            kept = covered
        return kept

    def score(self, total: np.ndarray, size: np.ndarray) -> np.ndarray:
        feature = np.log1p(np.maximum(total, 0) / np.maximum(size, 1) ** self.power)
        return 1 / (1 + np.exp(-np.clip(self.slope * feature + self.base, -500, 500)))


def _candidates(folded: str) -> set[str]:
    words = set(_WORD.findall(folded))
    return {w[:n] + "*" for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {w for w in words if len(w) >= SHORTEST}


def _contexts(lexicon: Lexicon, automaton, folded: str) -> set[str]:  # noqa: ANN001
    """Whole words that hold a counted term, and the pairs they stand in with a neighbour."""
    found = set()
    for start, end, term, _ in lexicon.matches(automaton, folded):
        while end < len(folded) and folded[end].isalpha():
            end += 1
        word = folded[start:end]
        if word != term:
            found.add(f"{term}\t{word}")
        left = re.search(r"[^\W\d_]{1,40}[^\w\n]{1,2}$", folded[max(0, start - 42) : start])
        right = re.match(r"[^\w\n]{1,2}[^\W\d_]{1,40}", folded[end : end + 42])
        found |= {f"{term}\t{x}" for x in ((left[0] + word if left else ""), (word + right[0] if right else "")) if x}
    return found


def _counted(rows: DataFrame, make: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """(found, toxic, clean): documents of each label that hold what make()(folded text) finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in slices(batches, "text", 4 << 20):
            sides = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sides[label].update(find(fold(text or "")))
            names = list({**sides[0], **sides[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([side[n] for n in names], pa.int64()) for side in (sides[1], sides[0])]], names=["found", "toxic", "clean"]
            )

    return rows.mapInArrow(run, "found string, toxic long, clean long").groupBy("found").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _leaning(counts: DataFrame, side: str, other: str, total: int, rest: int, limit: float) -> DataFrame:
    """Rows whose count on one side goes beyond chance: n * KL(share, share of all) over `limit`; with their lean."""
    a, b = F.col(side).cast("double"), F.col(other).cast("double")
    n, p = a + b, total / (total + rest)
    share = a / n
    kl = share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    lean = F.log((a + 0.5) / (total + 1)) - F.log((b + 0.5) / (rest + 1))
    return counts.withColumn("lean", lean).where((a > 0) & (share > p) & (n * kl > limit) & (F.col("lean") > math.log(LEAST_LEAN)))


def sample_of(docs: DataFrame, labels: DataFrame, taught: Callable[[Column], Column] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents of each label; `taught` says which ids may teach."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if taught is not None:
        known = known.where(taught(F.col("doc_id")))
    pick = F.xxhash64("doc_id", F.lit(11))
    sides = [known.where(F.col("toxic") == side).orderBy(pick, "doc_id").limit(sample) for side in (0, 1)]
    chosen = F.broadcast(sides[0].union(sides[1]))  # 2 * sample rows of two numbers
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(_taught_once(texts.join(chosen, "doc_id").select("text", "toxic")), "toxicity-sample")


def _taught_once(rows: DataFrame) -> DataFrame:
    """One text of those that share a label and the least hash of three words in line, for each of two hashes."""
    words = F.split(F.lower("text"), r"\s+")
    for seed in (1, 2):
        trios = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice(F.col("words"), i + 1, 3), F.lit(seed)))
        keyed = rows.withColumn("words", words).withColumn("least", F.array_min(trios))
        rows = keyed.groupBy("toxic", "least").agg(F.min("text").alias("text")).select("text", "toxic")
    return rows


def learn(docs: DataFrame, labels: DataFrame, taught: Callable[[Column], Column] | None = None, sample: int = SAMPLE) -> Lexicon | None:
    """A lexicon fitted to labelled documents; None without any."""
    rows = sample_of(docs, labels, taught, sample)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic + clean:
        return None
    share = (toxic + 0.5) / (toxic + clean + 1) if toxic and clean else float(bool(toxic))
    plain = Lexicon({}, base=math.log(share / (1 - share)) if 0 < share < 1 else 500.0 * (2 * share - 1))
    if not toxic or not clean:
        return plain
    counts = stored(_counted(rows, lambda: _candidates), "toxicity-candidates")
    limit = math.log(max(2.0, counts.count() / CHANCE))
    # Each term takes at least a few of the sample's words, so the sample's bound is the lexicon's too.
    lexicon = Lexicon(_telling(_leaning(counts, "toxic", "clean", toxic, clean, limit).collect(), toxic, clean, limit))
    if not lexicon.terms:
        return plain

    def around() -> Callable[[str], set[str]]:
        automaton = lexicon.automaton()
        return lambda folded: _contexts(lexicon, automaton, folded)

    held = stored(_counted(rows, around), "toxicity-contexts")
    limit = math.log(max(2, held.count()))
    lexicon.exceptions = sorted({r.found.split("\t", 1)[1] for r in _leaning(held, "clean", "toxic", clean, toxic, limit).collect()})
    return _calibrated(lexicon, rows, plain)


def _telling(found: list, toxic: int, clean: int, limit: float) -> dict[str, float]:
    """Weights of the terms that say something of their own: of those about equally sharp the longest, none that a sharper
    beginning finds already, and none that leans only through the sharper terms it begins."""
    kept: dict[str, float] = {}
    begun: dict[str, list] = {}  # kept terms by their beginnings
    for r in sorted(found, key=lambda r: (-round(10 * r.lean), -len(r.found), r.found)):
        text = r.found.removesuffix("*")
        starts = [text[:n] + "*" for n in range(SHORTEST, len(text) + (not r.found.endswith("*")))]
        mine = begun.get(r.found, [])
        rest = _surprise(r.toxic - sum(x.toxic for x in mine), r.clean - sum(x.clean for x in mine), toxic / (toxic + clean))
        if not any(s in kept for s in starts) and (not mine or rest > limit):
            kept[r.found] = float(r.lean)
            for start in starts:
                begun.setdefault(start, []).append(r)
    return kept


def _surprise(a: int, b: int, p: float) -> float:
    """n * KL(a / n, p) where a lies above its share, else 0."""
    a, b = max(0, a), max(0, b)
    if a <= p * (a + b):
        return 0.0
    share = a / (a + b)
    return (a + b) * (share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if b else 0.0))


def _calibrated(lexicon: Lexicon, rows: DataFrame, plain: Lexicon) -> Lexicon:
    """Power, slope and base by Newton's method on the sample's sums, three numbers a document."""
    got = totals(rows, lexicon, keep=("toxic",)).select("toxic", "total", "n_chars").toPandas()
    y, total, size = (got[c].to_numpy(float) for c in ("toxic", "total", "n_chars"))
    best = (math.inf, plain)
    for power in POWERS:
        x = np.log1p(total / np.maximum(size, 1) ** power)
        scale = x.max() or 1.0
        design, w = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
            # A weak pull to zero keeps parted sides from running away.
            step = np.linalg.solve((design.T * (p * (1 - p))) @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
            w += np.clip(step, -4, 4)
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -500, 500))), 1e-12, 1 - 1e-12)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if loss < best[0] - 1e-9:
            best = (loss, Lexicon(lexicon.terms, lexicon.exceptions, power, float(w[0] / scale), float(w[1])))
    return best[1]


def totals(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", keep: tuple[str, ...] = (), hits: bool = False) -> DataFrame:
    """The columns in `keep`, total, n_chars, and with `hits` the counted words (start, end, term, weight), one row per row of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("keep"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("weight", pa.float64())]))
    schema = f"keep {rows.schema['keep'].dataType.simpleString()}, total double, n_chars long, matches array<struct<start:bigint,end:bigint,term:string,weight:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            found = [lexicon.matches(automaton, fold(t)) for t in texts]
            total = [math.fsum(h[3] for h in x) for x in found]
            listed = [[dict(zip(("start", "end", "term", "weight"), h)) for h in x] if hits else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("keep"), pa.array(total, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(listed, kind)], names=["keep", "total", "n_chars", "matches"]
            )

    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col("keep")[c].alias(c) for c in keep], "total", "n_chars", *(["matches"] if hits else []))


def toxicity(docs: DataFrame, lexicon: Lexicon | None, text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `keep`, then score (0 to 1) and the words that count, one row per row of docs."""
    lexicon = lexicon or Lexicon({}, base=-500.0)
    feature = F.log1p(F.greatest(F.col("__t"), F.lit(0.0)) / F.pow(F.greatest(F.col("__n"), F.lit(1)).cast("double"), F.lit(lexicon.power)))
    score = 1 / (1 + F.exp(-(lexicon.slope * feature + lexicon.base)))
    made = totals(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("kept"), F.col(f"`{text_column}`").alias("text")), lexicon, keep=("kept",), hits=True)
    made = made.withColumnsRenamed({"total": "__t", "n_chars": "__n"})
    return made.select(*[F.col("kept")[c].alias(c) for c in keep], score.alias("score"), "matches")


def in_held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; a null id does not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"), lambda i: ~in_held_out(i))
    scored = toxicity(docs, lexicon, keep=("doc_id",))
    score = F.col("score")
    return scored.select("doc_id", in_held_out(F.col("doc_id")).alias("held_out"), score, (score >= 0.5).cast("int").alias("predicted"))
