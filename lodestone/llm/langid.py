"""Language identification by a small convolutional network over bytes, trained here in numpy.

Filters of two, three and four bytes slide over fixed-length windows of the lower-cased UTF-8 bytes; each filter's maximum
in the window goes through a rectifier to a softmax over the languages. A text's prediction is the mean over all of its
windows, weighted by their bytes. For application the filters' tables are folded into tables over byte pairs, so that a
window needs lookups, sums and a maximum only.

Training reads a sample of labelled rows that is bounded for each language (ROWS_PER_LANG) and chosen by a hash of the id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import text_batches
from lodestone.llm.common import id_text

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 192
ROWS_PER_LANG = 400
STEPS, BATCH, RATE = 500, 128, 0.01
HELD_OUT = 5
UNKNOWN = "und"
REJECT_BELOW = 0.35
LANGUAGES = 200  # the most languages that the network learns, those of the most rows
CROP = 4096  # characters of a text that training may draw from
WORD_MARK = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numbers such as fractions, which patterns take for word marks, are none."""
    return any(m.group().isalpha() for m in WORD_MARK.finditer(text))


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype("float32") for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype("float32")
        self.bias = np.zeros(len(languages), "float32")

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, places = [], []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            y = sum(t[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
            at = y.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(y, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(tops, axis=1), places

    def train(self, texts: list[bytes], labels: np.ndarray, seed: int = 0) -> None:
        """Adam on cross-entropy; each step draws the languages evenly and crops of different lengths."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by_label = [b for b in by_label if len(b)]
        params = [*self.tables, self.out, self.bias]
        means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            chosen = np.array([rng.choice(by_label[k % len(by_label)]) for k in range(BATCH)])
            x = np.zeros((BATCH, WINDOW), "uint8")
            for row, i in enumerate(chosen):
                size = int(rng.choice([12, 24, 48, 96, WINDOW]))
                at = rng.integers(0, max(1, len(texts[i]) - size + 1))
                crop = np.frombuffer(texts[i][at : at + size], "uint8")
                x[row, : len(crop)] = crop
            tops, places = self.pooled(x)
            hidden = np.maximum(tops, 0)
            p = softmax(hidden @ self.out + self.bias)
            p[np.arange(BATCH), labels[chosen]] -= 1
            p /= BATCH
            back = (p @ self.out.T) * (tops > 0)
            grads = []
            for k, (w, at) in enumerate(zip(WIDTHS, places, strict=True)):
                g, own = np.zeros_like(self.tables[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, at + j, axis=1), np.arange(FILTERS)[None, :]), own)
                g[:, 0] = 0
                grads.append(g)
            grads += [hidden.T @ p, p.sum(axis=0)]
            for q, g, m, s in zip(params, grads, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def fold(self) -> None:
        """Tables over byte pairs: width two, the first pair of widths three and four together; the rest apart."""
        t2, t3, t4 = self.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.first = np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])], axis=1)
        self.third, self.second = np.ascontiguousarray(t3[2]), pair(t4[2], t4[3])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for windows of bytes, a row each."""
        n, f = len(x), FILTERS
        p = x[:, :-1].astype("int32") * 256 + x[:, 1:]
        y = self.first.take(p.ravel(), axis=0).reshape(n, WINDOW - 1, 3 * f)
        tops = np.empty((n, 3 * f), "float32")
        tops[:, :f] = y[:, :, :f].max(axis=1)
        tops[:, f : 2 * f] = (y[:, :-1, f : 2 * f] + self.third[x[:, 2:]]).max(axis=1)
        tops[:, 2 * f :] = (y[:, :-2, 2 * f :] + self.second[p[:, 2:]]).max(axis=1)
        return softmax(np.maximum(tops, 0) @ self.out + self.bias)

    def predict(self, texts: list[str], batch: int = 64) -> tuple[list[str], list[float]]:
        """The language and its mean probability for each text; texts without a letter are UNKNOWN with score 0."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        sums = np.zeros((len(texts), len(self.languages)))

        def flush() -> None:
            if held:
                rows, x, weight = (np.concatenate([h[k] for h in held]) for k in range(3))
                for at in range(0, len(x), batch):
                    np.add.at(sums, rows[at : at + batch], self.windows(x[at : at + batch]) * weight[at : at + batch, None])
                held.clear()

        count = 0
        for row, text in enumerate(texts):
            if self.languages and has_letter(text):
                data = np.frombuffer(text.encode("utf-8", "replace").lower(), "uint8")
                n = max(1, -(-(len(data) - 3) // (WINDOW - 3)))  # windows share three bytes, so that no filter misses a place
                padded = np.zeros(n * (WINDOW - 3) + 3, "uint8")
                padded[: len(data)] = data[: len(padded)]
                x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[:: WINDOW - 3]
                weight = np.full(n, WINDOW - 3.0)
                weight[-1] = len(data) - (n - 1) * (WINDOW - 3)
                held.append((np.full(n, row), x, weight))
                count += n
                if count >= 2048:
                    flush()
                    count = 0
        flush()
        for row in np.flatnonzero(sums.sum(axis=1)):
            p = sums[row] / sums[row].sum()
            names[row], scores[row] = self.languages[int(p.argmax())], float(p.max())
        return names, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(id_col: str = "doc_id"):
    """Whether a row may not be learnt from; false for a row without an id, which is never learnt from either."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string")) % HELD_OUT) == 0, F.lit(False))


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, languages: int = LANGUAGES) -> ByteNet:
    """Train on a sample of labelled rows, never on held-out ones, nor on rows without an id, a text with a letter or a lang.

    The bounds: the `languages` most frequent languages, 2 * rows_per_lang rows of each on average, chosen by a hash of the id,
    and of each text CROP characters from a place that the hash chooses. They alone come to the driver. Without any such row
    the network knows no language.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    known = sorted(counts)
    if not known:
        return ByteNet([])
    share = F.create_map(*(F.lit(v) for lang in known for v in (lang, min(1.0, 1.5 * rows_per_lang / counts[lang]))))
    hashed = F.xxhash64("doc_id")
    place = F.pmod(hashed, F.lit(1_000_003)) / F.lit(1_000_003.0) / share[F.col("lang")]
    start = F.pmod(F.shiftright(hashed, 20), F.greatest(F.length("text") - CROP, F.lit(0)) + 1) + 1
    chosen = rows.withColumn("place", place).where("place < 1").orderBy("place", "doc_id").limit(2 * rows_per_lang * len(known))
    chosen = chosen.select(F.substring("text", start.cast("int"), F.lit(CROP)).alias("text"), "lang").collect()
    kept = [(r["text"].encode("utf-8", "replace").lower(), known.index(r["lang"])) for r in chosen if r["text"].strip()]
    if not kept:
        return ByteNet([])
    net = ByteNet(known)
    net.train([t for t, _ in kept], np.array([k for _, k in kept]))
    net.fold()
    return net


def identify(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; lang, source and ids play no part in a prediction.

    A null text, or one without a letter, is UNKNOWN with score 0; so is every text if no row with a letter is labelled. A row
    without an id is not held out. Repeated rows are handled each; other columns are not read; an empty table gives no rows.
    """
    net = net or fit(docs)

    def run(batches):
        for ids, texts in text_batches(batches, 200):
            names, scores = net.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: ByteNet | None = None, least: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs, all columns, whose text has a known language with a score of `least` or more."""
    net = net or fit(docs)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                names, scores = net.predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
