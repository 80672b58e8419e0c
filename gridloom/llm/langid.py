"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (n = 1 to 3, by presence, over
lower-cased letters with all else as one space) that both hold, over the
geometric mean of how many each holds.  Landmark texts give Nyström features;
kernel ridge regression on those, one language against the rest, gives a weight
for each landmark.  The kernel is linear in the n-grams a text holds, so the
weights fold into one row per n-gram and a batch of texts is scored by one
matrix product.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDERS, SLOT_BITS = (1, 2, 3), 18
#: Labelled texts per language that the classifier is fitted on, and those of them that are landmarks.
TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, RIDGE, LANGUAGES = 400, 64, 1e-2, 1000
#: Labelled texts and landmarks of all languages together: with more than 15 languages each gets fewer.
TRAIN_ROWS, LANDMARKS = 20_000, 1_000
#: Texts scored by one matrix product.
BLOCK = 128
#: A text with so many different n-grams can be told to be in none of the languages, if so many such texts were fitted on.
EVIDENCE, EVIDENT = 150, 50
_letters = None


def slots(text: str):
    """Sorted slots of the n-grams that a whole text holds (n-grams hashed to 2^18 slots)."""
    import numpy as np

    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(1 << 16)] + [True])
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_letters[np.minimum(c, 1 << 16)], c, 32)
    c = np.concatenate(([32], c, [32]))
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]].astype(np.uint64)
    seen = np.zeros(1 << SLOT_BITS, bool)
    h = np.zeros(len(c) + 1, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(1 << 21) + c[n - 1 :] if n > 1 else c
        if n in ORDERS:
            seen[((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)] = True
        if len(h) < 2:
            break
    return np.flatnonzero(seen)


class Model(NamedTuple):
    """Feature of each slot or -1, weights of features by language, and the response that a text of a known language has at least."""

    languages: list
    feature: object
    weights: object
    bias: object
    floor: float


def _training(docs: DataFrame, text: str, key: str, label: str, held_out, rows: int) -> dict[str, list]:
    """At most rows slot sets per language and TRAIN_ROWS in all, of the labelled documents first in a seeded order of keys and texts.

    Of more than LANGUAGES labels those with the most documents are learned.
    """
    import pyarrow as pa

    usable = docs.where(~held_out & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    usable = usable.withColumn("draw", F.pmod(F.xxhash64(F.lit("langid"), "k", "text"), F.lit(1 << 62)))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"))  # repeated rows count once
    counts = {r.lang: r.n for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    rows = max(1, min(rows, TRAIN_ROWS // len(counts)))
    limit = F.element_at(F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, (1.2 * rows + 40) / n) * (1 << 62))))]), F.col("lang"))
    # about 1.2 * rows + 40 a language pass the draw; repeated rows share theirs
    chosen = usable.where(F.col("draw") < limit).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("draw")
    chosen = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows).select("lang", "draw", "text")

    def run(batches):
        import numpy as np

        for batch in batches:
            found = [slots(t.as_py()).astype(np.int32).tobytes() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "draw", "slots"])

    by: dict[str, list] = {}
    for r in sorted(chosen.mapInArrow(run, "lang string, draw bigint, slots binary").collect(), key=lambda r: (r.lang, r.draw)):  # at most TRAIN_ROWS
        by.setdefault(r.lang, []).append(bytes(r.slots))
    return by


def fit(by_language: dict[str, list], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on the Nyström features of the slot sets, folded into weights of n-grams.

    The floor lies half way between the least best response of the fitted texts
    with EVIDENCE n-grams or more and that of a text without any known n-gram.
    """
    import numpy as np

    languages = sorted(by_language)
    landmarks = max(1, min(landmarks, LANDMARKS // len(languages)))
    sets = [np.frombuffer(s, np.int32) for lang in languages for s in by_language[lang]]
    truth = [i for i, lang in enumerate(languages) for _ in by_language[lang]]
    marks = [np.frombuffer(s, np.int32) for lang in languages for s in by_language[lang][:landmarks]]
    used = np.unique(np.concatenate(marks))
    feature = np.full(1 << SLOT_BITS, -1, np.int32)
    feature[used] = np.arange(len(used))

    def presence(some):
        x = np.zeros((len(some), len(used)), np.float32)
        for row, s in zip(x, some, strict=True):
            f = feature[s]
            row[f[f >= 0]] = 1
            row /= max(1.0, len(s)) ** 0.5
        return x

    m = presence(marks)
    values, vectors = np.linalg.eigh((m @ m.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: features of x are k(x, landmarks) @ root
    z = np.concatenate([(presence(sets[lo : lo + 256]) @ m.T).astype(np.float64) @ root for lo in range(0, len(sets), 256)])
    y = np.where(np.array(truth)[:, None] == np.arange(len(languages)), 1.0, -1.0)
    size = np.bincount(truth, minlength=len(languages))
    w = (len(sets) / len(languages) / size)[truth][:, None]  # each language weighs the same
    z1 = np.concatenate([z, np.ones((len(z), 1))], 1)
    lam = ridge * len(z) * np.eye(z1.shape[1])
    lam[-1, -1] = 1e-9
    beta = np.linalg.solve(z1.T @ (w * z1) + lam, z1.T @ (w * y))
    best = (z1 @ beta).max(1)[[len(x) >= EVIDENCE for x in sets]]
    nothing = float(beta[-1].max())
    floor = (float(best.min()) + nothing) / 2 if len(best) >= EVIDENT and best.min() > nothing else -np.inf
    return Model(languages, feature, (m.T.astype(np.float64) @ (root @ beta[:-1])).astype(np.float32), beta[-1].astype(np.float32), floor)


def responses(texts: list[str], model: Model):
    """Response of each language to each text, by one matrix product, and the number of n-grams of each text."""
    import numpy as np

    x, size = np.zeros((len(texts), len(model.weights)), np.float32), np.empty(len(texts), np.int64)
    for row, t in enumerate(texts):
        s = slots(t)
        f = model.feature[s]
        x[row, f[f >= 0]] = 1
        size[row] = len(s)
    return (x @ model.weights) / np.sqrt(size, dtype=np.float32)[:, None] + model.bias, size


def predict(texts: list, model: Model):
    """Languages and scores of texts, and whether each is in a language that was learned as far as can be told."""
    import numpy as np

    names, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    for lo in range(0, len(texts), BLOCK):
        part = [(i, t) for i, t in enumerate(texts[lo : lo + BLOCK], lo) if lettered(t)]
        if not part:
            continue
        y, size = responses([t for _, t in part], model)
        order = np.argsort(-y, axis=1, kind="stable")
        top = np.take_along_axis(y, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(y, order[:, 1:2], 1)[:, 0] if len(model.languages) > 1 else np.full(len(y), -1.0)
        sure = 1 / (1 + np.exp(-4.0 * (top - second).astype(np.float64)))
        ours = (top >= model.floor) | (size < EVIDENCE)
        for (i, _), k, p, here in zip(part, order[:, 0], sure, ours, strict=True):
            names[i], scores[i], known[i] = model.languages[k], float(p), bool(here)
    return names, scores, known


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", train_per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """docs with held_out, lang_pred, score and known added (columns of those names are replaced).

    Fitted on labelled documents whose crc32 of the key as text is not 2 modulo
    4, at most train_per_language of each language and TRAIN_ROWS in all; only the text is an input
    of a prediction.  Null texts and texts without a letter are "und" with score
    0, as is every text if nothing is labelled.  Rows with a null key are
    neither held out nor learned from.  known is false for texts without a
    letter, and for texts of EVIDENCE different n-grams or more to which no
    language responds as its fitted texts make it do; too short a text is known.
    Ties go to the smaller label; rows that repeat are predicted alike and
    learned from once.  Of more than LANGUAGES labels those with the most
    documents are learned.  An empty table gives an empty result.
    """
    import pyarrow as pa

    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))
    learned = _training(docs, text, key, label, F.coalesce(fold == 2, F.lit(True)), train_per_language)
    model = fit(learned) if learned else None
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "known")]
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)

    def run(batches):
        for batch in batches:
            langs, scores, known = [], [], []
            for lo in range(0, len(batch), BLOCK):  # few texts at a time are Python strings
                texts = batch.column(at).slice(lo, BLOCK).to_pylist()
                found = predict(texts, model) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts), [*map(lettered, texts)])
                for column, values in zip((langs, scores, known), found, strict=True):
                    column += values
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "known"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields) + ", lang_pred string, score double, known boolean"
    out = inner.mapInArrow(run, schema)
    held = F.coalesce(F.pmod(F.crc32(F.col(f"c{names.index(key)}").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], held.alias("held_out"), "lang_pred", "score", "known")


def keep_identified(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Documents in a language that was learned, as far as can be told, with all their own columns.

    Null, empty and letterless texts go, and texts of EVIDENCE different n-grams
    or more in no learned language; with no label to learn from, every text with
    a letter stays.  A null label becomes the predicted one, other labels stay as
    they are.  Rows that repeat stay or go together; a null key is a key like any
    other.  An empty table gives an empty result.
    """
    plain = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    kept = identify(docs.toDF(*plain.values()), plain[text], plain[key], plain[label]).where("known")
    named = F.coalesce(plain[label], F.nullif(F.col("lang_pred"), F.lit(UNKNOWN)).cast(docs.schema[label].dataType))
    return kept.select(*[(named if c == label else F.col(k)).alias(c) for c, k in plain.items()])
