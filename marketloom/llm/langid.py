"""Language ID by a string kernel: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge.

A text is folded to an alphabet of 64 symbols (0: anything but a letter; the most frequent lower-cased letters of the
training rows; the last symbol: any other letter). Its set holds the distinct n-grams of 1 to 3 symbols of the whole
text. The kernel of two texts is the size of their sets' intersection over the geometric mean of their sizes. Landmarks
are training texts; the kernel with them, whitened, is the feature map in which one ridge regression per language is
fitted. A batch of texts is scored by matrix products: presence x landmarks, then x weights.

The model is fitted on at most ``per_language`` distinct (id, text) of each of the at most ``LANGUAGES`` most frequent
languages, by a hash; its size does not depend on the corpus. Edges: a null text and a text without a letter get ``und``
with score 0, as does everything where no row teaches a language; a null id teaches nothing; repeated rows are each scored
but teach once; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import bounded_sample, slices, text_key

#: Rows of a language that may be used for fitting; landmarks of a language; ridge penalty; steepness of the score.
PER_LANGUAGE, LANDMARKS, PENALTY, STEEPNESS = 400, 24, 0.05, 3.0
#: Languages that may be learned (the most frequent ones).
LANGUAGES = 256
SYMBOLS, ORDERS = 64, 3
CODES = sum(SYMBOLS**n for n in range(1, ORDERS + 1))
UNKNOWN = "und"

_tables: dict = {}


def fold_table(alphabet: tuple[str, ...]):
    """Symbol of every code point."""
    import numpy as np

    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    if alphabet not in _tables:
        table = np.where(_tables["letters"], SYMBOLS - 1, 0).astype(np.int32)
        for k, letter in enumerate(alphabet, 1):
            table[ord(letter)] = k
            if len(letter.upper()) == 1:
                table[ord(letter.upper())] = k
        _tables[alphabet] = table
    return _tables[alphabet]


def presence(text: str | None, table, flags):
    """Sorted codes of the distinct n-grams of the whole text; none without a letter. ``flags``: zeros, left as zeros."""
    import numpy as np

    c = table[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    if not c.any():
        return c[:0]
    base = 0
    grams = c
    for n in range(1, ORDERS + 1):
        if n > 1:
            grams = grams[:-1] * SYMBOLS + c[n - 1 :]
        flags[base + grams] = True
        flags[base] = False  # an n-gram without any letter
        base += SYMBOLS**n
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class KernelModel:
    alphabet: tuple[str, ...]
    languages: list[str]
    columns: object  # int32 per code: its column, or -1
    landmarks: object  # columns x landmarks, 0/1
    sizes: object  # n-grams of each landmark
    weights: object  # (landmarks + 1) x languages

    def kernel(self, sets):
        """Normalised kernel with the landmarks, a batch of sets at a time."""
        import numpy as np

        x = np.zeros((len(sets), self.landmarks.shape[0]), np.float32)
        for row, s in zip(x, sets):
            at = self.columns[s]
            row[at[at >= 0]] = 1
        n = np.array([max(1, len(s)) for s in sets], np.float32)
        return (x @ self.landmarks) / np.sqrt(n[:, None] * self.sizes[None, :])

    def scores(self, sets):
        import numpy as np

        f = np.hstack([self.kernel(sets), np.ones((len(sets), 1), np.float32)]) @ self.weights
        e = np.exp(STEEPNESS * (f - f.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(sets: list, languages: list[str], alphabet: tuple[str, ...], landmarks: int = LANDMARKS,
        penalty: float = PENALTY) -> KernelModel:
    """Landmarks: the first rows of each language; all rows fit the regression."""
    import numpy as np

    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    used = np.unique(np.concatenate([sets[i] for i in chosen]))
    columns = np.full(CODES, -1, np.int32)
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[columns[sets[i]], j] = 1
    model = KernelModel(alphabet, names, columns, marks, marks.sum(0), None)
    k = np.vstack([model.kernel(sets[i : i + 256]) for i in range(0, len(sets), 256)]).astype(float)
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ whiten
    counts = np.bincount(y, minlength=len(names))
    balance = (len(y) / (len(names) * counts))[y][:, None]
    z1 = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    beta = np.linalg.solve(z1.T @ (balance * z1) + penalty * len(y) / 100 * np.eye(z1.shape[1]), z1.T @ (balance * target))
    model.weights = np.vstack([whiten @ beta[:-1], beta[-1:]]).astype(np.float32)
    return model


def train(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> KernelModel | None:
    """Fit on a bounded number of rows per language among those that ``may_learn``."""
    import pyarrow as pa

    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    keys = rows.select("doc_id", "lang", text_key())
    sample, _ = written(bounded_sample(rows, keys, "lang", per_language, LANGUAGES), "langid-sample")

    def letters(batches):
        from collections import Counter

        n = Counter()
        for _, texts in slices(batches):
            for t in texts:
                n.update(t.lower() if t else "")
        found = {c: k for c, k in n.items() if c.isalpha()}
        yield pa.RecordBatch.from_pydict({"letter": pa.array(list(found), pa.string()),
                                          "n": pa.array(list(found.values()), pa.int64())})

    top = (sample.select("text").mapInArrow(letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "letter").limit(SYMBOLS - 2).collect())
    alphabet = tuple(r["letter"] for r in top)

    def sets(batches):
        import numpy as np

        table, flags = fold_table(alphabet), np.zeros(CODES, bool)
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1),
                pa.array([presence(t, table, flags).astype("<i4").tobytes() for t in texts], pa.binary())],
                names=["doc_id", "lang", "codes"])

    import numpy as np

    got = sample.select("doc_id", "lang", "text").mapInArrow(sets, "doc_id long, lang string, codes binary").filter(
        F.length("codes") > 0).orderBy(F.xxhash64("doc_id"), "doc_id", "codes").collect()
    if not got:
        return None
    return fit([np.frombuffer(r["codes"], "<i4") for r in got], [r["lang"] for r in got], alphabet)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """The input with lang_pred and score appended (columns of these names are replaced)."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", lang_pred string, score double"

    def score(batches):
        import numpy as np

        m = shared.value
        flags = np.zeros(CODES, bool)
        table = m and fold_table(m.alphabet)
        for part, texts in slices(batches):
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i in range(0, len(texts) if m else 0, 128):
                sets = [presence(t, table, flags) for t in texts[i : i + 128]]
                p = m.scores(sets)
                for j, (s, best) in enumerate(zip(sets, p.argmax(1))):
                    if len(s):
                        names[i + j], scores[i + j] = m.languages[best], float(p[j, best])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(score, schema)
