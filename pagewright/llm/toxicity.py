"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression.

Defined results: null and empty texts get the score of a text without any feature; labels of null and repeated labels of one
document count once, by their maximum; without enough labels of both kinds the score is a fixed logistic of the lexicon's hits;
rows with a null id are scored and aren't held out; an empty table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import gbt
from pagewright.llm.common import bounded_batches

SAMPLE_ROWS = 20_000  # labelled rows that the classifier is fitted on, the least by a hash of their id
LEARNED_TERMS = 400
STEMS = (3, 4, 5, 6, 7)  # lengths of word beginnings that are learned beside whole words, written with a trailing *
LEAST_ODDS, STRONG_ODDS = 1.2, 3.5  # log odds of the label that a learned term has at least, and that of strong ones
# Common insults and slurs of contempt in four languages, lower case, without accents.
LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin loser losers clown clowns pathetic worthless disgusting "
    "trash garbage scum vermin filth filthy jerk bastard bitch fool fools foolish ugly hate hateful despicable useless brainless braindead "
    "degenerate parasite coward creep pig swine rat freak retard retarded shit shitty crap asshole ass fuck fucking fucker damn dickhead prick slut whore "
    "idioten idiotin trottel dummkopf blodmann dumm bloed versager abschaum arschloch scheisse mistkerl widerlich ekelhaft wertlos erbarmlich drecksau "
    "imbecil estupido estupida idiota idiotas basura escoria asqueroso patetico inutil mierda cabron gilipollas tonto perdedor payaso "
    "idiote idiotes cretin debile abruti ordure salaud connard merde pathetique minable degoutant inutile bouffon".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tus vosotros".split())
_fold = {ord(a): b for a, b in zip("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")}
SPACED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))  # of lower-cased bytes
LEET = bytes.maketrans(b"013457@$!|+", b"oieastasiit")
INNER = b"*.-_'~^`\"#%&"
LETTERS_APART = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?=\s|$|[.,!?])")
STRETCHED = re.compile(r"([a-z])\1{2,}")
FEATURES = (
    "log_words hits hit_rate distinct_hits near_second second_rate learned_hits learned_rate learned_distinct learned_weight learned_weight_rate learned_strong hidden_hits hidden_rate apart_hits stretched_hits "
    "upper_rate shouted_rate bang_rate question_rate punctuation_rate symbol_rate digit_rate mixed_rate non_ascii_rate mean_word max_hit_cluster"
).split()


class Terms(dict):
    """Log odds of learned words, and of learned word beginnings (with a trailing *)."""

    def __init__(self, odds: dict[str, float]):
        super().__init__(odds)
        self.starts = frozenset(t[: STEMS[0]] for t in odds)

    def found(self, words: list[str]) -> list[tuple[str, float]]:
        """(word, the greatest log odds of it or its beginnings) of each word that has any."""
        out, starts, get = [], self.starts, self.get
        for w in words:
            if w[: STEMS[0]] in starts:
                best = max(get(w, 0.0), *(get(w[:k] + "*", 0.0) for k in STEMS if k < len(w)), 0.0)
                if best:
                    out.append((w, best))
        return out


def plain(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else low.translate(_fold)


def features(text: str | None, learned: Terms | None = None) -> list[float]:
    text = text or ""
    low = plain(text)
    raw = low.encode()
    words = raw.translate(SPACED).decode(errors="replace").split()
    n = len(words)
    if not n and not text.strip():
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in LEXICON]
    second = [i for i, w in enumerate(words) if w in SECOND]
    known = learned.found(words) if learned else []
    weight = sum(x for _, x in known)
    near = 0
    if second and hits:
        h, at = np.array(hits), np.array(second)
        near = int((np.searchsorted(at, h + 6) > np.searchsorted(at, h - 5)).sum())
    bare = raw.translate(LEET, INNER).split()
    hidden = sum(w.strip(b",;:?()[]").decode(errors="replace") in LEXICON for w in bare) - len(hits) if len(bare) else 0
    apart = sum("".join(c for c in m.group() if c.isalpha()) in LEXICON for m in LETTERS_APART.finditer(low))
    stretched = 0
    if STRETCHED.search(low):
        stretched = sum(STRETCHED.sub(r"\1", w) in LEXICON for w in words if STRETCHED.search(w) and w not in LEXICON)
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, counts.sum())
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    letters = max(1, counts[97:123].sum() + upper)
    symbols = counts[[35, 36, 37, 38, 42, 64, 94, 126]].sum()
    punctuation = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    cluster = 0
    if hits:
        h = np.array(hits)
        cluster = int((np.searchsorted(h, h + 20) - np.arange(len(h))).max())
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if upper > 0.1 * letters else 0
    mixed = len(set(w for w in words if w.isalnum() and not w.isalpha() and not w.isdigit()))
    per = 1 / max(1, n)
    return [
        float(np.log1p(n)), len(hits), len(hits) * per, len({words[i] for i in hits}), near, len(second) * per, len(known), len(known) * per, len(set(known)),
        weight, weight * per, sum(x >= STRONG_ODDS for _, x in known),
        max(0, hidden), max(0, hidden) * per, apart, stretched, upper / letters, shouted * per, counts[33] / size, counts[63] / size, punctuation / size,
        symbols / size, digits / size, mixed * per, counts[128:].sum() / size, size * per, cluster,
    ]


def table(docs: DataFrame, learned: Terms, keep: list[str]) -> DataFrame:
    """The kept columns and the features of each text, batch by batch."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                x = [features(t, learned) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(keep))), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return bounded_batches(docs.select("text", *keep)).mapInArrow(run, f"{kinds}, x array<double>")


def stem(words: Column, k: int) -> Column:
    """The first k letters of each longer word, with a *."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("*")))


def learn_terms(sample: DataFrame) -> Terms:
    """Words and word beginnings of the labelled sample with raised log odds of the label 1, the LEARNED_TERMS surest of them.

    Beginnings stand for inflected forms, which whole words miss in languages that inflect. Weaker terms are kept with their odds: a stem
    that clean texts hold now and then still tells by how often it comes.
    """
    words = F.filter(F.array_distinct(F.split(F.translate(F.lower("text"), "".join(map(chr, _fold)), "".join(_fold.values())), r"[^\p{L}0-9]+")), lambda w: F.length(w) > 2)
    words = F.array_distinct(F.concat(words, *(stem(words, k) for k in STEMS)))
    n = sample.agg(F.count("*"), F.sum("y")).first()
    pos, neg = int(n[1] or 0), int((n[0] or 0) - (n[1] or 0))
    if pos < 20 or neg < 20:
        return Terms({})
    by_word = sample.select("y", F.explode(words).alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1) / ((F.col("n") - F.col("p") + 0.5) / (neg + 1)))
    top = by_word.where(f"p >= {max(8, pos // 40)}").withColumn("o", odds).where(F.col("o") > LEAST_ODDS)
    top = top.orderBy(F.desc(F.col("o") * F.sqrt("p")), "w").limit(LEARNED_TERMS)
    return Terms({r.w: r.o for r in top.select("w", "o").collect()})


class Model:
    """Fitted trees with isotonic knots, or the fixed logistic where labels were too few."""

    def __init__(self, x: np.ndarray | None, y: np.ndarray | None, learned: Terms):
        self.learned, self.trees = learned, None
        if x is None or min(y.sum(), len(y) - y.sum()) < 20:
            return
        fold = np.arange(len(y)) % 4
        out = np.zeros(len(y))
        for k in range(4):
            out[fold == k] = gbt.fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots = gbt.isotonic(out, y)
        self.trees = gbt.fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return 1 / (1 + np.exp(4 - 3 * np.minimum(x[:, FEATURES.index("hits")] + x[:, FEATURES.index("hidden_hits")], 5)))
        m = self.trees.margin(x)
        # Isotonic steps tie; a thousandth of the raw probability keeps the order within a step.
        return 0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows whose crc32(id as text) mod 3 is not 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most sample_rows ids, and one text of each: repeated ids combine before anything is gathered.
    sample = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    learned = learn_terms(sample)
    got: pd.DataFrame = table(sample, learned, ["id", "y"]).toPandas()
    if got.empty:
        return Model(None, None, learned)
    got = got.sort_values("id", kind="stable")
    return Model(np.array(got["x"].tolist(), float), got["y"].to_numpy(float), learned)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs, with score and predicted beside them (replacing columns of those names).

    Columns pass through in the same bounded batches as the texts, so nothing is shuffled or joined back and no text is sent twice.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    at = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else len(keep)
    if at == len(keep):
        sent.append(F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                x = np.array([features(t, shared.value.learned) for t in part.column(at).to_pylist()], float)
                s = np.clip(shared.value.score(x), 0, 1)
                out = [*part.columns[: len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=[*(f"c{i}" for i in range(len(keep))), "score", "predicted"])

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return bounded_batches(docs.select(*sent)).mapInArrow(run, f"{kinds}{', ' if keep else ''}score double, predicted int").toDF(*keep, "score", "predicted")
