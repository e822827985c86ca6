"""Per-document text quality statistics, and which documents are natural prose.

Statistics are Catalyst expressions over the whole text. A text is cut into parts (a line's pieces up to a full stop,
question mark, colon or the like, or the line's end), every part is counted once (words, common words, signs, digits,
enumerating ends, word lengths), and what is said of a document is added up from its parts.

Two ordered rule lists are induced by incremental reduced-error pruning on documents labelled by hand (at most
MAX_LABELS, the only sample, with at most MAX_PARTS of their parts) and exported as SQL CASE expressions, which are
then applied natively to all documents. The first tells the parts that are running sentences: it is fitted on the
parts of the labelled documents, each with its document's label, and then once more with the labels that it gave to
parts of documents it got right, as a document may be mixed. The second tells the documents that are not natural
prose, from prose_share (characters in running sentences) and the other statistics. All thresholds come from the
labels. held_out() gives the accuracy on labelled documents that were left out, by kind.

Common words are a parameter; those built in are of English, German, French and Spanish, and prose in a language
without a list is not told from junk.

Defined cases: a null or empty text, or one of blanks only, has zero words and is not natural prose; ratios over
nothing are 0. Without labels of both kinds the rules are DEFAULT_PARTS and DEFAULT. Repeated documents get a row each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.shared import forget, written

MAX_LABELS, MAX_PARTS = 50_000, 400_000
MAX_CUTS = 32

#: Common function words of English, German, French and Spanish.
COMMON = (
    "a about after again all almost also although an and another any are as at be because been before but by can could did do does down each ever every few for from had has have he her here him his how "
    "i if in into is it its just like may me more most much must my neither no nobody nor not of off on once one only or other our out over own said same she should since so some still such than that the "
    "their them then there these they this those through to too under unless until up us very was we were what when where which while who whom why will with would yet you your "
    "aber alle als am an auch auf aus bei bis da dann das dass dem den der des die dies diese diesem dieses doch ein eine einem einen einer eines er erst es für hat hatte hier ich ihr im in ist ja jede kein keine "
    "man mehr mit nach nicht noch nur ob oder ohne sehr sich sie sind so über um und uns vom von vor war wenn werden wie wir wird wo zu zum zur zwischen "
    "au aux avec avons ce ces cette comme dans de des deux du elle elles en est et été être il ils je la le les leur lui mais même moins ne nous on ou où par pas peu plus pour près que qui sa sans se ses si "
    "son sont sous sur tous tout très trouve un une vers vous "
    "al algo como con cuando de del desde donde el ella ellas en entre era es esa ese esta está este esto fue ha han hasta hay hemos la las lo los más me muy ni no nos o otra otro para pero poco por porque "
    "que se según ser si sin sobre son su sus también tan todo todos un una viene y ya"
).split()

FEATURES = ("prose_share", "common_share", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "alpha_words", "distinct_share", "letter_ratio", "mean_line_words")
#: Of a part: words, common words, their share, share of words that end as in an enumeration, signs and digits by
#: characters, characters by word, share of words that are letters only.
PART_FEATURES = ("part_words", "part_common", "part_common_share", "part_enders", "part_signs", "part_digits", "part_word_length", "part_plain")
SENTENCE = r"(?<=[.!?;:])\s+|[\r\n]+"


def _filled(a: Column) -> Column:
    return F.filter(a, lambda s: F.btrim(s) != "")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def parts(text: Column, common: list[str] = COMMON) -> Column:
    """ARRAY<STRUCT> of the counts of every part of a text, each made in one pass over it."""
    strip = r"[^\p{L}\p{N}\s]++(?!\S)|(?<!\S)[^\p{L}\p{N}\s]+"  # the signs around words
    words = lambda p: F.array_remove(F.split(p, r"\s+"), "")
    cut = F.transform(_filled(F.split(text, SENTENCE)), lambda p: F.struct(p.alias("p"), F.lower(F.regexp_replace(p, strip, "")).alias("clean"), F.regexp_replace(p, r"[\p{L}\s]++", "").alias("rest")))
    cut = F.transform(cut, lambda s: F.struct(s["p"].alias("p"), s["clean"].alias("clean"), s["rest"].alias("rest"), words(s["clean"]).alias("bare")))
    return F.transform(cut, lambda s: F.struct(
        F.length(s["p"]).alias("size"),
        F.regexp_count(s["p"], F.lit(r"\S++")).alias("n"),
        F.length(F.translate(s["p"], " \t\n\x0b\f\r", "")).alias("n_chars"),
        F.size(F.filter(s["bare"], lambda w: w.isin(common))).alias("n_common"),
        F.regexp_count(s["p"], F.lit(r"[,;|](?!\S)")).alias("n_enders"),
        (F.size(s["bare"]) - F.regexp_count(s["clean"], F.lit(r"[^\p{L}\s'’-]\S*+"))).alias("n_plain"),
        F.length(s["rest"]).alias("n_rest"),
        F.length(F.regexp_replace(s["rest"], r"[.,;:!?'’\-()]+|\p{N}+", "")).alias("n_signs"),
        F.length(F.regexp_replace(s["rest"], r"\P{N}+", "")).alias("n_digits"),
        s["bare"].alias("bare"),
    ))


def part_features(s: Column) -> dict[str, Column]:
    """The PART_FEATURES of a part."""
    whole = F.greatest(s["size"], F.lit(1))
    n = F.greatest(s["n"], F.lit(1))
    values = (s["n"].cast("double"), s["n_common"].cast("double"), s["n_common"] / n, s["n_enders"] / n, s["n_signs"] / whole, s["n_digits"] / whole, s["n_chars"] / n, s["n_plain"] / n)
    return dict(zip(PART_FEATURES, values, strict=True))


def _holds(rules: list[Rule], value: dict[str, Column]) -> Column:
    """Does any rule hold? As a native expression."""
    one = [reduce(lambda x, y: x & y, [value[c.feature] <= c.cut if c.below else value[c.feature] > c.cut for c in r]) for r in rules]
    return reduce(lambda x, y: x | y, one) if one else F.lit(False)


def statistics(documents: DataFrame, sentences: list[Rule] | None = None, common: list[str] = COMMON) -> DataFrame:
    """(doc_id, n_characters, n_words, n_lines, FEATURES...): one row for each document. sentences: the rules that tell
    the parts that are running sentences, else DEFAULT_PARTS."""
    return _summed(_counted(documents, common), DEFAULT_PARTS if sentences is None else sentences)


def _counted(documents: DataFrame, common: list[str]) -> DataFrame:
    base = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    lines = _filled(F.split("t", r"[\r\n]+"))
    punctuated = F.size(F.filter(lines, lambda s: F.rlike(s, F.lit(r"[.!?;:…]['\"”»)]?\s*$"))))
    return base.select("doc_id", F.length("t").cast("long").alias("n_characters"), F.length(F.btrim("t")).alias("length"), F.size(lines).cast("long").alias("n_lines"), punctuated.alias("n_punctuated"), parts(F.col("t"), common).alias("parts"))


def _summed(counted: DataFrame, sentences: list[Rule]) -> DataFrame:
    zero = F.struct(*(F.lit(0).alias(n) for n in ("size", "prose", "n", "n_chars", "n_common", "n_plain", "n_rest", "n_signs", "n_digits")))
    names = ("size", "n", "n_chars", "n_common", "n_plain", "n_rest", "n_signs", "n_digits")

    def add(t: Column, s: Column) -> Column:
        prose = F.when(_holds(sentences, part_features(s)), s["size"]).otherwise(0)
        whole = {n: t[n] + s[n] for n in names} | {"prose": t["prose"] + prose}
        return F.struct(*(whole[n].alias(n) for n in ("size", "prose", *names[1:])))

    bare = F.flatten(F.transform("parts", lambda s: s["bare"]))
    rows = counted.select("doc_id", "n_characters", "length", "n_lines", "n_punctuated", F.aggregate("parts", zero, add).alias("s"), F.size(bare).alias("n_bare"), F.size(F.array_distinct(bare)).alias("n_distinct"))
    nw, length = F.col("s.n"), F.col("length")
    signs_only = (F.col("n_bare") < nw).cast("int")  # words of signs alone are one more distinct word, an empty one
    return rows.select(
        "doc_id",
        "n_characters",
        nw.cast("long").alias("n_words"),
        "n_lines",
        _ratio(F.col("s.prose"), F.col("s.size")).alias("prose_share"),
        _ratio(F.col("s.n_common"), nw).alias("common_share"),
        _ratio(F.col("s.n_chars"), nw).alias("mean_word_length"),
        _ratio(F.col("s.n_signs"), length).alias("symbol_ratio"),
        _ratio(F.col("s.n_digits"), length).alias("digit_ratio"),
        _ratio(F.col("n_punctuated"), F.col("n_lines")).alias("punctuated_lines"),
        _ratio(F.col("s.n_plain"), nw).alias("alpha_words"),
        _ratio(F.col("n_distinct") + signs_only, nw).alias("distinct_share"),
        _ratio(F.col("s.n_chars") - F.col("s.n_rest"), length).alias("letter_ratio"),
        _ratio(nw, F.col("n_lines")).alias("mean_line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    below: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        c = x[:, (FEATURES if self.feature in FEATURES else PART_FEATURES).index(self.feature)]
        return c <= self.cut if self.below else c > self.cut

    def sql(self) -> str:
        return f"{self.feature} {'<=' if self.below else '>'} {self.cut!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cuts(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values where the class changes; of more than MAX_CUTS, those at even places."""
    values, start, times = np.unique(np.sort(v), return_index=True, return_counts=True)
    pure = np.add.reduceat(y[np.argsort(v, kind="stable")].astype(int), start) / times
    change = np.nonzero((pure[1:] != pure[:-1]) | ((pure[1:] > 0) & (pure[1:] < 1)))[0]
    if len(change) > MAX_CUTS:
        change = change[np.linspace(0, len(change) - 1, MAX_CUTS).astype(int)]
    return (values[change] + values[change + 1]) / 2


def _grow(x: np.ndarray, y: np.ndarray, features: tuple[str, ...]) -> Rule:
    """Add conditions by information gain until the rule covers no negative."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while (inside & ~y).any() and len(rule) < 6:
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        best = None
        for j, f in enumerate(features):
            v = x[inside, j]
            for cut in _cuts(v, y[inside]):
                for below in (True, False):
                    hit = v <= cut if below else v > cut
                    p, n = (hit & y[inside]).sum(), (hit & ~y[inside]).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, Condition(f, below, float(cut)))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drop final conditions while the worth (p - n) / (p + n) on held-out rows doesn't fall."""

    def worth(r: Rule) -> float:
        c = _covers(r, x)
        p, n = (c & y).sum(), (c & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), -len(r))) if rule else rule


def induce(x: np.ndarray, y: np.ndarray, seed: int = 0, features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """Ordered rules for class True: each grown on two thirds of what is left, pruned on the rest, kept while it errs on less than half."""
    x, y = np.asarray(x, float), np.asarray(y, bool)
    rng, rules, left = np.random.Generator(np.random.PCG64(seed)), [], np.arange(len(y))
    while y[left].any() and len(rules) < 20:
        parts = []
        for cls in (True, False):  # stratified
            own = rng.permutation(left[y[left] == cls])
            parts.append((own[: -(-2 * len(own) // 3)], own[-(-2 * len(own) // 3) :]))
        grow, prune = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        rule = _prune(_grow(x[grow], y[grow], features), x[prune], y[prune])
        if not rule:
            break
        c = _covers(rule, x[prune])
        if len(prune) and c.any() and (c & ~y[prune]).sum() >= (c & y[prune]).sum():
            break
        covered = _covers(rule, x[left])
        if not (covered & y[left]).any():
            break
        rules.append(rule)
        left = left[~covered]
    return rules


DEFAULT: list[Rule] = [(Condition("prose_share", True, 0.5),)]
#: Common words enough, not enumerated, few signs and digits.
DEFAULT_PARTS: list[Rule] = [(Condition("part_common", False, 1.5), Condition("part_common_share", False, 0.2), Condition("part_enders", True, 0.3), Condition("part_signs", True, 0.2), Condition("part_digits", True, 0.2))]


def case_sql(rules: list[Rule]) -> str:
    """The rule list as a SQL CASE: the number of the first rule that holds, else 0."""
    whens = " ".join(f"when {' and '.join(c.sql() for c in r)} then {i}" for i, r in enumerate(rules, 1))
    return f"case when n_words = 0 then -1 {whens} else 0 end"


@dataclass(frozen=True)
class Model:
    """Rules for running sentences among parts, and for documents that aren't natural prose."""

    sentences: list[Rule]
    documents: list[Rule]


def sample(documents: DataFrame, labels: DataFrame, common: list[str] = COMMON) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(documents, parts) that are labelled, on the driver: doc_id, kind and statistics, and every part's features.

    Of more than MAX_LABELS labels those first by hash of the id; of more than MAX_PARTS parts likewise.
    """
    known = labels.where("text_kind is not null and doc_id is not null").groupBy("doc_id").agg(F.lower(F.btrim(F.min("text_kind"))).alias("kind"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    counted = written(_counted(documents.select("doc_id", "text").join(F.broadcast(few), "doc_id"), common).join(F.broadcast(few), "doc_id"))
    rows = counted.where("size(parts) > 0")
    split = rows.select("doc_id", F.posexplode("parts").alias("place", "s")).select("doc_id", "place", F.col("s.size").alias("size"), *(v.alias(n) for n, v in part_features(F.col("s")).items()))
    split = split.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(MAX_PARTS).toPandas()
    stats = _summed(rows, DEFAULT_PARTS).drop("prose_share").join(F.broadcast(few), "doc_id").toPandas()
    forget(counted)
    return stats.sort_values("doc_id", kind="stable").reset_index(drop=True), split.sort_values(["doc_id", "place"], kind="stable").reset_index(drop=True)


def fit_rows(docs: pd.DataFrame, split: pd.DataFrame, prose: str = "prose", seed: int = 0) -> Model:
    """The model of labelled documents and their parts, as sample() gives them."""
    y = (docs["kind"] != prose).to_numpy(bool)
    if not y.any() or y.all():
        return Model(DEFAULT_PARTS, DEFAULT)
    split = split[split["doc_id"].isin(docs["doc_id"])]
    x, sentence = split[list(PART_FEATURES)].to_numpy(float), ~split["doc_id"].map(dict(zip(docs["doc_id"], y, strict=True))).to_numpy(bool)
    sentences = induce(x, sentence, seed, PART_FEATURES) or DEFAULT_PARTS
    told = _any(sentences, x)
    share = prose_share(split, told)
    right = split["doc_id"].map(share).to_numpy(float) > 0.5
    sentences = induce(x, np.where(right == sentence, told, sentence), seed, PART_FEATURES) or sentences
    at = docs.assign(prose_share=docs["doc_id"].map(prose_share(split, _any(sentences, x))).fillna(0.0))
    return Model(sentences, induce(at[list(FEATURES)].to_numpy(float), y, seed) or DEFAULT)


def _any(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([_covers(r, x) for r in rules]) if rules else np.zeros(len(x), bool)


def prose_share(split: pd.DataFrame, told: np.ndarray) -> pd.Series:
    """By doc_id the share of characters in parts that are told to be sentences."""
    sums = split.assign(prose=split["size"] * told).groupby("doc_id")[["prose", "size"]].sum()
    return sums["prose"] / sums["size"]


def fit(documents: DataFrame, labels: DataFrame, prose: str = "prose", seed: int = 0, common: list[str] = COMMON) -> Model:
    return fit_rows(*sample(documents, labels, common), prose, seed)


def held_out(documents: DataFrame, labels: DataFrame, folds: int = 5, prose: str = "prose", seed: int = 0, common: list[str] = COMMON) -> pd.DataFrame:
    """(text_kind, n_documents, n_right): labelled documents judged by models that were fitted without them."""
    docs, split = sample(documents, labels, common)
    fold = docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % folds)
    out = []
    for k in range(folds):
        test, model = docs[fold == k], fit_rows(docs[fold != k].reset_index(drop=True), split, prose, seed)
        if not len(test):
            continue
        own = split[split["doc_id"].isin(test["doc_id"])]
        at = test.assign(prose_share=test["doc_id"].map(prose_share(own, _any(model.sentences, own[list(PART_FEATURES)].to_numpy(float)))).fillna(0.0))
        out.append(pd.DataFrame({"text_kind": test["kind"], "right": _any(model.documents, at[list(FEATURES)].to_numpy(float)) == (test["kind"] != prose)}))
    whole = pd.concat(out) if out else pd.DataFrame({"text_kind": pd.Series([], dtype=str), "right": pd.Series([], dtype=bool)})
    return whole.groupby("text_kind")["right"].agg(n_documents="size", n_right="sum").reset_index()


def judged(documents: DataFrame, labels: DataFrame, common: list[str] = COMMON) -> DataFrame:
    """statistics() and `rule` (the rule that tells it isn't prose; -1 no words, 0 prose) and natural_prose."""
    model = fit(documents, labels, common=common)
    out = statistics(documents, model.sentences, common).withColumn("rule", F.expr(case_sql(model.documents)))
    return out.withColumn("natural_prose", F.col("rule") == 0)
