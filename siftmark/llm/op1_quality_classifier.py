"""Quality classifier: a weak-label model turns overlapping heuristic votes into posterior labels, which train a hashed linear scorer.

Two aspects are learned side by side, each with labellers of its own: quality (is the text prose?) and toxicity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, frugal, materialise
from .op9_quality_rules import STOP_WORDS

ABSTAIN, NO, YES = 0, 1, 2
#: The scorer is fitted on a sample: at most so many distinct pairs of id and text, those of the least hashes, with at most so
#: many features together.  Both bound the one task that fits it, whatever the table holds.
TRAIN_ROWS, TRAIN_FEATURES = 40_000, 60_000_000
#: Weights of the hashed scorer, for each aspect.
DIMENSIONS = 1 << 18
#: A feature counts if so many training documents have it.
LEAST_DOCS = 5
CLEAR = 3.0
EPOCHS, BATCH, RATE = 12, 512, 0.05
#: Insults by language.  English has two lists without a word in common, of nouns and of adjectives, which tell of toxicity
#: independently of each other; what these lists miss is learned from the label votes.
INSULTS = {
    "en_nouns": "idiot moron loser trash scum clown imbecile bastard".split(),
    "en_adjectives": "stupid worthless pathetic disgusting brainless".split(),
    "de": "idiot dummkopf arschloch trottel abschaum vollpfosten wichser blödmann".split(),
    "fr": "idiot imbécile connard salaud crétin abruti ordure minable".split(),
    "es": "idiota imbécil estúpido basura escoria pendejo cabrón inútil".split(),
}
_STOPS = {w.encode() for w in STOP_WORDS}
#: Words that tell a text's language: insults count in their language alone, and only there their absence could tell anything.
_TELLING = {k: set(v.encode().split()) for k, v in {"en": "the of and to that is it was with", "de": "der die und das ist nicht ein", "fr": "les et une est dans pour que", "es": "los las el por con una es"}.items()}
_INSULTS = {k: {w.encode() for w in v} for k, v in INSULTS.items()}
_EDGE = b".,;:!?\"'()[]{}"


class Profile(NamedTuple):
    """What the labellers look at.  Counts are of bytes; bytes beyond ASCII count as letters."""

    words: int
    distinct: int
    stops: int
    languages: dict[str, int]
    insults: dict[str, int]
    symbols: float
    upper: float
    letters: float
    same_lines: float


_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
_LETTERS = _LOWER + _UPPER + bytes(range(128, 256))


def profile(text: str) -> tuple[Profile, set[bytes]]:
    """The profile of a text and its distinct words, A-Z in lower case and without punctuation at the ends."""
    raw = text.encode()
    words = raw.lower().split()
    known = {w.strip(_EDGE) for w in set(words)}
    n, letters, upper = max(1, len(raw)), len(raw) - len(raw.translate(None, _LETTERS)), len(raw) - len(raw.translate(None, _UPPER))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return Profile(
        len(words), len(known), len(known & _STOPS), {k: len(known & v) for k, v in _TELLING.items()}, {k: len(known & v) for k, v in _INSULTS.items()}, (n - len(raw.translate(None, b"#*$%&|<>"))) / n,
        upper / max(1, letters), letters / n, 1 - len(set(lines)) / max(1, len(lines)),
    ), known


def _vote(no: bool, yes: bool) -> int:
    return NO if no else YES if yes else ABSTAIN


#: Labellers of the aspect "quality" (YES: prose) and of the aspect "toxic" (YES: toxic).  The last vote of each aspect is
#: the label table's, where it has one.
QUALITY: dict[str, Callable[[Profile], int]] = {
    "length": lambda p: _vote(False, 100 <= p.words <= 50_000),
    "symbols": lambda p: _vote(p.symbols > 0.02, p.symbols < 0.002),
    "stop_words": lambda p: _vote(p.words >= 30 and p.stops < 2, p.stops >= 3),
    "variety": lambda p: _vote(50 <= p.words <= 20_000 and p.distinct < 0.3 * p.words, p.words >= 50 and p.distinct > 0.45 * p.words),
    "capitals": lambda p: _vote(p.upper > 0.5, p.words >= 20 and p.upper < 0.2),
    "letters": lambda p: _vote(p.letters < 0.6, p.letters > 0.75),
    "lines": lambda p: _vote(p.same_lines > 0.4, False),
}
TOXIC: dict[str, Callable[[Profile], int]] = {
    "nouns": lambda p: _vote(p.languages["en"] >= 3 and not p.insults["en_nouns"], p.insults["en_nouns"] > 0),
    "adjectives": lambda p: _vote(p.languages["en"] >= 3 and not p.insults["en_adjectives"], p.insults["en_adjectives"] > 0),
    "german": lambda p: _vote(p.languages["de"] >= 3 and not p.insults["de"], p.languages["de"] >= 3 and p.insults["de"] > 0),
    "french": lambda p: _vote(p.languages["fr"] >= 3 and not p.insults["fr"], p.languages["fr"] >= 3 and p.insults["fr"] > 0),
    "spanish": lambda p: _vote(p.languages["es"] >= 3 and not p.insults["es"], p.languages["es"] >= 3 and p.insults["es"] > 0),
}
ASPECTS = (QUALITY, TOXIC)


def votes_of(p: Profile) -> tuple[int, ...]:
    """Votes of each aspect as a number in base 3, the first labeller's first."""
    out = []
    for aspect in ASPECTS:
        code = 0
        for f in aspect.values():
            code = 3 * code + f(p)
        out.append(code)
    return tuple(out)


def _vote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        v = [votes_of(profile(t)[0]) for t in pdf["t"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality_votes": [x[0] for x in v], "toxic_votes": [x[1] for x in v]})


def unpacked(codes: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(labellers - 1, -1, -1)], 1)


def label_model(codes: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of YES for each pattern of votes; accuracies (labellers x {NO, YES}: how often a vote is right); the prior.

    EM over the patterns and their counts.  A labeller that abstains says nothing.  It starts from the share of YES votes
    and keeps every accuracy a little from 0 and 1, as if it had erred and been right once more."""
    votes = unpacked(codes, labellers)
    cast = votes > ABSTAIN
    post = (votes == YES).sum(1) / np.maximum(1, cast.sum(1))
    post = np.where(cast.any(1), post, 0.5)
    for _ in range(rounds):
        n_yes, n_no = counts * post, counts * (1 - post)
        prior = (n_yes.sum() + 1) / (counts.sum() + 2)
        right = np.empty((labellers, 2))
        for k in range(labellers):
            yes, no = votes[:, k] == YES, votes[:, k] == NO
            right[k] = (n_no[no].sum() + 2) / (n_no[no | yes].sum() + 3), (n_yes[yes].sum() + 2) / (n_yes[no | yes].sum() + 3)
        odds = np.full(len(codes), np.log(prior / (1 - prior)))
        for k in range(labellers):
            odds += np.where(votes[:, k] == YES, np.log(right[k, 1] / (1 - right[k, 0])), 0) + np.where(votes[:, k] == NO, np.log((1 - right[k, 1]) / right[k, 0]), 0)
        post = 1 / (1 + np.exp(-odds))
    return post, right, prior


def _index(feature: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(feature) & (DIMENSIONS - 1)


#: Bytes of the stems that a longer word has as features.
STEMS = (4, 6)


def word_features(word: bytes) -> tuple[int, ...]:
    """A word and, if it is longer than they are, its stems."""
    return (_index(word), *(_index(b"^" + word[:n]) for n in STEMS if len(word) > n))


def shape_features(p: Profile) -> list[int]:
    """The profile in steps, as features among the words."""
    steps = {
        "symbols": int(p.symbols * 50), "upper": int(p.upper * 10), "letters": int(p.letters * 20), "lines": int(p.same_lines * 5),
        "stops": min(p.stops, 5), "variety": int(10 * p.distinct / max(1, p.words)), "insults": min(sum(p.insults.values()), 2),
    }
    return [_index(f"#{k}={v}".encode()) for k, v in steps.items()]


def fit(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their log odds in the two soft classes: (weights, bias).

    Features whose log odds are within CLEAR standard errors of even odds are left out, so that a long text's many words
    that tell nothing don't drown a few that do."""
    lengths = np.array([len(r) for r in rows])
    flat, doc = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)
    inside = lambda w: np.bincount(flat, w[doc], DIMENSIONS)
    docs, yes, no = np.bincount(flat, minlength=DIMENSIONS), inside(weight * target), inside(weight * (1 - target))
    n_yes, n_no = (weight * target).sum(), (weight * (1 - target)).sum()
    odds = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    error = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    scale = np.where((docs >= LEAST_DOCS) & (np.abs(odds) > CLEAR * error), odds, 0)
    w, bias, gw, gb = np.full(DIMENSIONS, 0.1), np.log((n_yes + 1) / (n_no + 1)), np.full(DIMENSIONS, 1e-8), 1e-8
    used = scale[flat] != 0
    flat, doc = flat[used], doc[used]
    order = np.random.default_rng(7).permutation(len(rows))
    at = np.searchsorted(doc, np.arange(len(rows) + 1))
    for _ in range(EPOCHS):
        for b in range(0, len(order), BATCH):
            ids = order[b : b + BATCH]
            f = np.concatenate([flat[at[i] : at[i + 1]] for i in ids])
            d = np.repeat(np.arange(len(ids)), at[ids + 1] - at[ids])
            z = np.bincount(d, w[f] * scale[f], len(ids)) + bias
            error = weight[ids] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[ids]) / len(ids)
            touched, back = np.unique(f, return_inverse=True)
            g = np.bincount(back, error[d] * scale[f]) + 1e-6 * w[touched]
            gw[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(gw[touched])
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
    return (w * scale).astype(np.float32), float(bias)


SAMPLE = "doc_id long, place long, n long, features binary, quality_votes long, toxic_votes long"
MODEL = "aspect long, bias double, weights binary"


def features_of(p: Profile, known: set[bytes], memory: dict[bytes, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct features of a text; memory keeps those of words."""
    out = set(shape_features(p))
    for w in known:
        if w not in memory:
            memory[w] = word_features(w)
        out.update(memory[w])
    return np.sort(np.fromiter(out, np.int32, len(out)))


def _sample_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, memory = [c.split()[0] for c in SAMPLE.split(", ")], {}
    for pdf in batches:
        rows = []
        for doc_id, place, text in zip(pdf["doc_id"], pdf["place"], pdf["t"], strict=True):
            if len(memory) > 300_000:
                memory.clear()
            p, known = profile(text)
            f = features_of(p, known, memory)
            rows.append((doc_id, place, len(f), f.tobytes(), *votes_of(p)))
            if len(rows) == 256:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


def fit_aspect(rows: list[np.ndarray], target: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The scorer of one aspect from the posterior labels of rows with a vote (others: -1).  Where only one class is there,
    nothing can be told apart: all weights are 0 and the bias is the label model's prior."""
    have = np.flatnonzero(target >= 0)
    if not ((target[have] > 0.5).any() and (target[have] < 0.5).any()):
        return np.zeros(DIMENSIONS, np.float32), float(np.log(prior / (1 - prior)))
    return fit([rows[i] for i in have], target[have], np.abs(2 * target[have] - 1))


def counts_for(aspect: int, codes: np.ndarray) -> np.ndarray:
    """Which patterns of votes make a row one to learn from.  Any vote does, but for toxicity a list that finds nothing in a
    text says little: where the label table has both kinds, rows without a label count only if a list has found something."""
    if aspect == 0 or not {NO, YES} <= set((codes % 3).tolist()):
        return codes > 0
    return (codes % 3 > 0) | (unpacked(codes // 3, len(TOXIC)) == YES).any(1)


def _train(posteriors: list[np.ndarray], priors: list[float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, patterns = [], [[] for _ in posteriors]
        for pdf in batches:
            rows += [np.frombuffer(b, np.int32) for b in pdf["features"]]
            for k, name in enumerate(("quality", "toxic")):
                patterns[k] += (pdf[f"{name}_votes"] * 3 + pdf[f"{name}_label"]).tolist()
        for k, codes in enumerate(patterns):
            codes = np.array(codes, np.int64)
            target = np.where(counts_for(k, codes), posteriors[k][codes], -1.0)
            w, bias = fit_aspect(rows, target, priors[k])
            yield pd.DataFrame({"aspect": [k], "bias": [bias], "weights": [w.tobytes()]})

    return train


SCORED = "doc_id long, p_quality double, p_toxic double"


def _scorer(model: list[tuple[float, bytes]], most: int = 300_000) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (bias0, w0), (bias1, w1) = [(b, np.frombuffer(w, np.float32)) for b, w in model]
        memory: dict[bytes, complex] = {}  # both aspects' sums as one number
        sums = lambda at: complex(sum(float(w0[i]) for i in at), sum(float(w1[i]) for i in at))
        for pdf in batches:
            out = []
            for text in pdf["t"]:
                p, known = profile(text)
                if len(memory) > most:
                    memory.clear()
                total, stems = sums(shape_features(p)), set()
                for w in known:
                    one = memory.get(w)
                    if one is None:
                        one = memory[w] = sums(word_features(w)[:1])
                    total += one
                    if len(w) > STEMS[0]:
                        stems.add(w[: STEMS[0]])
                        if len(w) > STEMS[1]:
                            stems.add(w[: STEMS[1]])
                for s in stems:
                    key = b"^" + s
                    one = memory.get(key)
                    if one is None:
                        one = memory[key] = sums((_index(key),))
                    total += one
                out.append(total)
            z = np.array(out, complex)
            squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "p_quality": squash(z.real + bias0), "p_toxic": squash(z.imag + bias1)})

    return score


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("t"))


def weak_labels(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the votes of each aspect, the label table's last (abstaining where it has no row).

    Labels must be unique by doc_id; where one is repeated, its least values count.  Null ids have no label."""
    return _with_labels(materialise(_read(docs, id_col, text_col).mapInPandas(frugal(_vote_rows), "doc_id long, quality_votes long, toxic_votes long")), labels)


def _with_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumns({"quality_label": F.lit(ABSTAIN), "toxic_label": F.lit(ABSTAIN)})
    vote = lambda c: F.coalesce(F.min(c).cast("int") + 1, F.lit(ABSTAIN))
    one = labels.groupBy(F.col("doc_id").alias("__id")).agg(vote("quality").alias("quality_label"), vote("toxic").alias("toxic_label"))
    joined = rows.join(one, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return joined.fillna(ABSTAIN, ["quality_label", "toxic_label"])


def sample(docs: DataFrame, total: int, rows: int, features: int = TRAIN_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the scorer is fitted on, with features and votes: at most `rows` distinct pairs of id and text, of at most
    `features` features together, by the least hashes.  Features are made where the texts lie; only places in the order of
    hashes, and how many features each has, go to one task to find the bound."""
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("t")), F.lit(10**15))
    share = min(1.0, rows / max(1, total))
    near = _read(docs, id_col, text_col).withColumn("place", place).where(F.col("place") < F.lit(round(share * 10**15)))
    made = materialise(near.mapInPandas(frugal(_sample_rows), SAMPLE))
    sizes = made.select("place", "n").distinct().orderBy("place").limit(rows)
    upto = sizes.select("place", F.sum("n").over(Window.orderBy("place")).alias("upto")).where(F.col("upto") <= features).agg(F.max("place")).first()[0]
    return made.where(F.col("place") <= F.lit(-1 if upto is None else upto)).dropDuplicates(["place"])


def train(docs: DataFrame, labels: DataFrame | None, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[float, bytes]], dict]:
    """The two scorers, and what the label models found: accuracies and priors.

    The label model is fitted on the votes of all rows: they are counted by pattern, at most 3 ** 8 and 3 ** 6 rows.  Which
    rows count for a scorer is told by counts_for.  An aspect of which the sample has one class alone
    gives every text the prior; so does an empty table."""
    voted = weak_labels(docs, labels, id_col, text_col)
    posteriors, priors, report = [], [], {}
    for name, aspect in (("quality", QUALITY), ("toxic", TOXIC)):
        n = len(aspect) + 1
        seen = voted.groupBy((F.col(f"{name}_votes") * 3 + F.col(f"{name}_label")).alias("code")).count().toPandas()
        codes = np.arange(3**n)
        counts = np.zeros(3**n)
        counts[seen["code"].to_numpy(np.int64)] = seen["count"]
        post, right, prior = label_model(codes, counts, n)
        posteriors.append(post)
        priors.append(float(prior))
        report[name] = {"prior": float(prior), "right": dict(zip([*aspect, "label"], right.tolist(), strict=True))}
    chosen = _with_labels(sample(docs, voted.count(), rows, id_col=id_col, text_col=text_col), labels).drop("doc_id")
    fitted = chosen.repartition(1).sortWithinPartitions("place").mapInPandas(frugal(_train(posteriors, priors)), MODEL)
    none = [(float(np.log(p / (1 - p))), bytes(4 * DIMENSIONS)) for p in priors]
    return [(r["bias"], bytes(r["weights"])) for r in sorted(fitted.collect(), key=lambda r: r["aspect"])] or none, report


def classify(docs: DataFrame, model: list[tuple[float, bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_quality, p_toxic and kept (p_quality >= 0.5 and p_toxic < 0.5) of every row.

    One pass with the two weight vectors (1 MB each, of fixed size).  A null text is empty and gets what the bias and the
    profile of an empty text give; an empty table gives no rows."""
    return _read(docs, id_col, text_col).mapInPandas(frugal(_scorer(model)), SCORED).withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by scorers that the table's own votes and labels have trained; a null text is empty, repeated rows
    are scored each."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, _ = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model)


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
#: Training isn't SQL: tests hold it against labels that it hasn't seen.
ORACLES: dict[str, str] = {}
