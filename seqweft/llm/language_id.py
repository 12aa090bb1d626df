"""Language identification by hierarchical discrimination: first the family, then the language within it.

A text is a vector of hashed byte n-grams (orders 1 to 4) of its words, A-Z and the accented capitals lower-cased, each
count replaced by its square root and the whole scaled to length 1. A linear support vector machine for each family, it
against all others, gives the family; within it one for each pair of languages votes for the language. Families are looked up
by language code; a code that is not listed is a family of its own, so machines grow in proportion to such labels.

Every label is learned. The machines are fitted on the driver on at most SAMPLE_PER_LANG labelled texts of each language, fewer
where there are so many languages that all would have over SAMPLE_ROWS, those with the
smallest hashes of id and text (a share of the hash range, then a rank limit). Rows alike in both count once, and the smallest hash
is always in, so every language gives rows. The sample reaches the driver as vectors of fixed length, whatever the texts'
lengths. A family's machine sees all its own rows and RIVALS of the others', dealt evenly. Predictions read whole texts and nothing else.

A null text or one without a letter is `und` with score 0. A text with letters always gets a learned language. With no
labelled rows at all every text is `und`. A null id counts as the empty string in the hash. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweft.llm.common import doc_hash, small_batches, table

BINS, ORDERS, SAMPLE_PER_LANG, SAMPLE_ROWS, RIVALS, FOLDS, HELD_OUT = 1 << 12, 4, 500, 24_000, 3000, 3, 1
CHUNK = 1 << 18
UND = "und"
#: Stands in where there is nothing to learn from: a text with letters is of an unknown language, others are UND.
UNLEARNED = {"families": ["unknown"], "between": {}, "stacked": np.empty((0, BINS + 1)), "within": {"unknown": (["unknown"], {})}}

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn pa mr gu ur ne",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER_BYTES = np.zeros(256, bool)
_LETTER_BYTES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~_LETTER_BYTES] = 32


def features(text: str) -> np.ndarray:
    """The text's vector; zero if it has no letter bytes. Codes are made a chunk at a time, whatever the length."""
    raw = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep]
    counts = np.zeros(BINS)
    for at in range(0, len(raw), CHUNK):
        for order in range(1, ORDERS + 1):
            part = raw[max(0, at - order + 1) : at + CHUNK].astype(np.uint32)
            code = part[: max(0, len(part) - order + 1)].copy()
            for j in range(1, order):
                code = code << np.uint32(8) | part[j : len(part) - order + 1 + j]
            if order == 1:
                code = code[code != 32]
            code = (code + np.uint32(order)) * np.uint32(2654435761)
            counts += np.bincount((code ^ code >> np.uint32(15)) & np.uint32(BINS - 1), minlength=BINS)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return (counts / norm if norm else counts).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights and, last, bias of the hinge-loss machine, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    diagonal, alpha, w, rng = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1], np.float64), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / diagonal[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    return w


def _pairs(x: np.ndarray, names: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    return {(a, b): fit_svm(x[(names == a) | (names == b)], np.where(names[(names == a) | (names == b)] == a, 1.0, -1.0)) for a, b in combinations(sorted(set(names)), 2)}


def _against_rest(x: np.ndarray, family: np.ndarray, rivals: int = RIVALS) -> dict[str, np.ndarray]:
    """A machine for each family; of two families the second's is the first's turned round."""
    names, out = sorted(set(family)), {}
    if len(names) < 2:
        return out
    place = {}  # the how-manieth row of its family each row is, so that rivals are dealt evenly
    turn = np.array([place.setdefault(f, []).append(0) or len(place[f]) for f in family])
    for name in names if len(names) > 2 else names[:1]:
        other = np.flatnonzero(family != name)
        other = other[np.argsort(turn[other], kind="stable")][:rivals]
        rows = np.sort(np.concatenate((np.flatnonzero(family == name), other)))
        out[name] = fit_svm(x[rows], np.where(family[rows] == name, 1.0, -1.0))
    if len(names) == 2:
        out[names[1]] = -out[names[0]]
    return out


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The model: family machines, and language machines by family."""
    names = np.array(langs, dtype=object)
    family = np.array([FAMILY_OF.get(n, n) for n in langs], dtype=object)
    within = {f: (sorted(set(names[family == f])), _pairs(x[family == f], names[family == f])) for f in sorted(set(family))}
    between = _against_rest(x, family)
    return {"families": sorted(set(family)), "between": between, "stacked": np.array([between[f] for f in sorted(between)]), "within": within}


def _family(v: np.ndarray, model: dict) -> tuple[str, float]:
    """The family with the greatest margin; half its lead over the next as a logistic score."""
    names = model["families"]
    if len(names) == 1:
        return names[0], 1.0
    margins = model["stacked"][:, :-1] @ v + model["stacked"][:, -1]
    best = int(margins.argmax())
    lead = margins[best] - np.delete(margins, best).max()
    return names[best], float(1 / (1 + np.exp(-1.5 * lead)))


def _vote(v: np.ndarray, names: list[str], machines: dict) -> tuple[str, float]:
    """The name with most pairwise wins, then the greatest margin; its weakest pair as a logistic score."""
    if len(names) == 1:
        return names[0], 1.0
    wins, margin, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for (a, b), w in machines.items():
        m = float(v @ w[:-1] + w[-1])
        wins[a if m >= 0 else b] += 1
        for name, side in ((a, m), (b, -m)):
            margin[name] += side
            least[name] = min(least[name], side)
    best = max(names, key=lambda n: (wins[n], margin[n]))
    return best, float(1 / (1 + np.exp(-3 * least[best])))


def predict(text: str | None, model: dict | None) -> tuple[str, float]:
    if not text or not model or not model["families"] or not any(map(str.isalpha, text)):
        return UND, 0.0
    v = features(text).astype(np.float64)
    family, p = _family(v, model)
    names, machines = model["within"][family]
    lang, q = _vote(v, names, machines)
    return lang, p * q


def training_rows(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    return docs.where((doc_hash(doc_id) % FOLDS != HELD_OUT) & F.col(lang).isNotNull())


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> dict | None:
    """The model of the labelled rows outside the held-out fold; every label is learned."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, doc_id, lang).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    kinds = [F.approx_count_distinct(share).alias("kinds"), F.min(share).alias("least")]
    sizes = rows.groupBy("lang").agg(*kinds).collect()
    if not sizes:
        return None
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // len(sizes)))
    bounds = [(r["lang"], max(r["least"], min(1.0, 1.2 * per_lang / max(1, r["kinds"])))) for r in sizes]
    marked = rows.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound double")), "lang")
    chosen = marked.where(share <= F.col("bound")).select(F.coalesce("text", F.lit("")).alias("text"), "lang", share.alias("share")).dropDuplicates(["lang", "share"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["v", "lang", "share"])

    first = Window.partitionBy("lang").orderBy("share", "v")
    sample = chosen.mapInArrow(vectors, "v binary, lang string, share double").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_lang)
    used = sorted(sample.collect(), key=lambda r: (r["lang"], r["rank"]))
    if not used:
        return None
    return fit(np.stack([np.frombuffer(r["v"], np.float16).astype(np.float32) for r in used]), [r["lang"] for r in used])


def identify(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, then the predicted language and its score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at, width = keep.index(text) if text in keep else len(keep), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), shared.value) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                schema=pa.schema([*list(batch.schema)[:width], (names[0], pa.string()), (names[1], pa.float64())]),
            )

    rows = docs.select(*[F.col(c) for c in keep], *([] if text in keep else [F.col(text).alias("__body")]))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:width])
    return rows.mapInArrow(run, f"{fields}`{names[0]}` string, `{names[1]}` double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", (doc_hash() % FOLDS == HELD_OUT).alias("held_out"))
    return identify(rows, train(docs), ["doc_id", "held_out"])
