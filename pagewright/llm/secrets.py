"""Secret scans: fixed patterns plus character Markov models of random strings and ordinary identifiers.

Defined results: a null text counts as empty; offsets are code points of the whole text, end exclusive; a text without findings
has counts of 0, an empty list of spans and the hash of the empty string; repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_RUN = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.zeros(256, np.uint8)  # 0: not part of a candidate
for _i, _c in enumerate(SYMBOLS):
    CODE[ord(_c)] = _i + 1
CODE[128:] = len(SYMBOLS) + 1  # the bytes of letters beyond ASCII: part of words, never of a random string
SMOOTH = 40.0  # transitions that a character's own frequencies count as, beside those seen
MIN_MEAN = 0.35  # nats a character by which the random model must win
MIN_GAIN = 20.0  # nats beyond that, over a whole stretch: about one in as many places as half a gigabyte has
# Common parts of identifiers, from which ordinary samples are composed.
PARTS = (
    "user name file path index count value table column row query text page order item list map set get put add remove update delete create read write "
    "open close start stop next previous first last max min sum mean total size length width height color style class object method function module package "
    "import export config setting option default global local static public private account customer product price date time year month day hour minute "
    "second number string integer float double boolean array buffer stream input output error warning message handler listener event action state status "
    "result response request client server service session cookie header body title author version release build test sample example document section chapter "
    "the and that with from this have which their would there could other about these people should because through between another without information"
).split()


# Common words of four languages, from which ordinary words are composed.
WORDS = (
    "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec tout être ce mais comme il sont cette aux été ont même fait où très après peut déjà français élève "
    "el que los se del las por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante año español información"
).split()
VOWELS = set("aeiouyäöüéèêáíóúAEIOUY")


def syllables(word: str) -> list[str]:
    """A word cut before each consonant that a vowel follows."""
    cuts = [0] + [i for i in range(1, len(word) - 1) if word[i] not in VOWELS and word[i + 1] in VOWELS] + [len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (1), n ordinary identifiers and 3 n words of several languages (0), made from a seed."""
    r, out = random.Random(seed), []
    pools = (SYMBOLS[:62], SYMBOLS[:62] + "+/", SYMBOLS[:26] + SYMBOLS[52:62], SYMBOLS[26:62], "0123456789abcdef", SYMBOLS[:62] + "_-", SYMBOLS[:52])
    parts_of = [p for w in WORDS for p in syllables(w)]
    for _ in range(n):
        out.append(("".join(r.choices(r.choice(pools), k=r.randint(20, 64))), 1))
        parts = [r.choice(PARTS) for _ in range(r.randint(2, 7))]
        style = r.randrange(7)
        word = ("_".join(parts), "-".join(parts), "/".join(parts), "".join(p.title() for p in parts), "".join(parts), "_".join(parts).upper(), "=".join(parts[:2]))[style]
        out.append((word + (str(r.randint(0, 2030)) if r.random() < 0.3 else ""), 0))
        for _ in range(3):
            # Words of words and syllables, as in languages and texts that the lists don't hold.
            word = "".join(r.choice(parts_of if r.random() < 0.7 else WORDS) for _ in range(r.choice((1, 2, 2, 3, 4))))
            word = r.choice((word, word, word, word.title(), word.upper()))
            tail = r.random()
            out.append((word + ("-" + r.choice(WORDS) if tail < 0.03 else str(r.randint(0, 2030)) if tail < 0.06 else "---" if tail < 0.08 else ""), 0))
        if r.random() < 0.1:
            out.append((f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" if r.random() < 0.5 else str(r.randint(0, 10 ** r.randint(1, 12))), 0))
    return out


def train(samples: list[tuple[str, int]], smooth: float = SMOOTH) -> np.ndarray:
    """Log ratios of first-order transitions, random over ordinary; row 0 holds the first character's.

    A transition that samples lack has its characters' own frequencies, of a weight of smooth transitions, so that a rare pair of common letters
    is little evidence. A character that repeats the one before is no evidence for a random string.
    """
    k = len(SYMBOLS) + 2
    counts = np.zeros((2, k, k))
    for text, label in samples:
        c = CODE[np.frombuffer(text.encode(), np.uint8)]
        np.add.at(counts[label], (np.concatenate(([0], c[:-1])), c), 1)
    alone = counts.sum(axis=1, keepdims=True) + 1
    alone /= alone.sum(axis=2, keepdims=True)
    p = np.log((counts + smooth * alone) / (counts.sum(axis=2, keepdims=True) + smooth))
    out = p[1] - p[0]
    np.fill_diagonal(out, np.minimum(out.diagonal(), 0))
    out[:, -1] = np.minimum(out[:, -1], -4)  # a letter beyond ASCII
    out[-1] = np.minimum(out[-1], 0)
    return out


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns. The cheap tests before each pattern only skip texts that can't match it."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"\x01" * 32 in raw.translate(HEX_RUN):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[0], x[2]))


def stretches(gains: list[float]):
    """(first, end) of each stretch whose sum is the greatest around it and at least MIN_GAIN, in one scan.

    A stretch begins where the sum before it has fallen to zero, and ends before the sum falls by MIN_GAIN under its height.
    """
    total = best = 0.0
    first = end = 0
    for i, x in enumerate([*gains, -math.inf]):
        if total <= 0:
            total, best, first = 0.0, 0.0, i
        total += x
        if total > best:
            best, end = total, i + 1
        elif best >= MIN_GAIN and best - total >= MIN_GAIN:
            yield first, end
            total = best = 0.0


def markov_spans(raw: bytes, ascii_only: bool, ratios: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches of SYMBOLS that the random model explains better, at any length; base spans are cut out of what is scored."""
    out = []
    c = np.concatenate(([0], CODE[np.frombuffer(raw, np.uint8)], [0]))
    text = None if ascii_only or not taken else raw.decode()
    for s, e, _ in taken:
        lo, hi = (s, e) if text is None else (len(text[:s].encode()), len(text[:e].encode()))
        c[lo + 1 : hi + 1] = 0
    gains = ratios[c[:-1], c[1:]] - MIN_MEAN
    edge = np.flatnonzero(np.diff((c != 0).astype(np.int8)))
    if not len(edge):
        return out
    # No stretch of a run sums to more than the run's gains above zero.
    most = np.add.reduceat(np.maximum(gains, 0), edge)[::2]
    for k in np.flatnonzero(most >= MIN_GAIN).tolist():
        lo, hi = int(edge[2 * k]), int(edge[2 * k + 1])
        for first, end in stretches(gains[lo:hi].tolist()):
            start = lo + first if ascii_only else len(raw[: lo + first].decode())
            out.append((start, start + (end - first if ascii_only else len(raw[lo + first : lo + end].decode())), 3))
    return out


def random_bases(text: str, spans: list[tuple[int, int, int]], ratios: np.ndarray) -> int:
    """How many base spans hold a stretch that the random model explains better; the others look like ordinary words or one repeated symbol."""
    return sum(bool(markov_spans(text[s:e].encode(), False, ratios, [])) for s, e, _ in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, n_random_base, base_sha256, spans) of each row; one pass over the texts, nothing is shuffled.

    n_random_base: base spans that the Markov models take for random too.
    """
    ratios = train(samples or labelled_samples())
    shown = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    raw = text.encode()
                    base = base_spans(text, raw)
                    more = markov_spans(raw, len(raw) == len(text), ratios, base)
                    n = [sum(x[2] == k for x in base) for k in range(3)]
                    rows.append((*n, len(more), random_bases(text, base, ratios), hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + more, key=lambda x: (x[0], x[2])))))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])],
                    names=["id", "n_assign", "n_access", "n_hex", "n_markov", "n_random_base", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = bounded_batches(rows).mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, n_markov long, n_random_base long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
