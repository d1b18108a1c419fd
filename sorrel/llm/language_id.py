"""Language identification by a byte convolutional network trained in numpy.

A text's UTF-8 bytes are cut into fixed-length windows; byte embeddings pass through filters of several
widths, each filter's maximum over the window feeds a softmax. A document's prediction is the mean
of its windows' probabilities, weighted by their bytes: all windows of the whole text count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

WINDOW = 128
WIDTHS = (2, 3, 4)
DIM, FILTERS = 8, 16
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """Weights of the network; ``langs`` are its classes in order."""

    langs: list[str]
    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _tables: list = field(default_factory=list)

    @staticmethod
    def fresh(langs: list[str], seed: int = 0) -> ByteCNN:
        rng = np.random.default_rng(seed)
        conv = [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return ByteCNN(
            langs, rng.normal(0, 1, (256, DIM)).astype(np.float32), conv, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
        )

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 3e-3, seed: int = 0) -> None:
        """Adam on the cross entropy of windows ``x`` (n, WINDOW bytes) with class numbers ``y``."""
        rng = np.random.default_rng(seed)
        params = [self.emb, *self.conv, *self.bias, self.out, self.out_bias]
        m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        # Rare classes weigh as much as frequent ones.
        share = np.bincount(y, minlength=len(self.langs)) / len(y)
        weight = (1 / np.maximum(share, 1e-9) / len(self.langs)).astype(np.float32)
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                t += 1
                for p, g, a, b in zip(params, self._gradients(x[at], y[at], weight[y[at]]), m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        e = self.emb[x]
        pooled, places = [], []
        for w, c, b in zip(WIDTHS, self.conv, self.bias, strict=True):
            seen = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * DIM)
            r = seen @ c + b
            best = r.argmax(1)
            places.append((seen, best))
            pooled.append(np.take_along_axis(r, best[:, None, :], 1)[:, 0])
        top = np.concatenate(pooled, 1)
        h = np.maximum(top, 0)
        p = _softmax(h @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        d = p * weight[:, None] / n
        g_out, g_ob = h.T @ d, d.sum(0)
        dh = (d @ self.out.T) * (top > 0)
        g_emb, g_conv, g_bias = np.zeros_like(self.emb), [], []
        rows = np.arange(n)[:, None]
        for i, (w, (seen, best)) in enumerate(zip(WIDTHS, places, strict=True)):
            dk = dh[:, i * FILTERS : (i + 1) * FILTERS]
            at = seen[rows, best]
            g_conv.append(np.einsum("nfk,nf->kf", at, dk))
            g_bias.append(dk.sum(0))
            back = (dk[:, :, None] * self.conv[i].T[None]).reshape(n, FILTERS, w, DIM)
            for j in range(w):
                np.add.at(g_emb, x[rows, best + j].ravel(), back[:, :, j].reshape(-1, DIM))
        return [g_emb, *g_conv, *g_bias, g_out, g_ob]

    def _pairs(self) -> list[list[np.ndarray]]:
        """By width, what each pair of bytes (and a last single byte) adds to the filters: the embedding and the convolution in one look-up."""
        if not self._tables:
            for w, c in zip(WIDTHS, self.conv, strict=True):
                part = [self.emb @ c[j * DIM : (j + 1) * DIM] for j in range(w)]
                two = [(part[j][:, None] + part[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
                self._tables.append(two + ([part[-1]] if w % 2 else []))
        return self._tables

    def window_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax by window of ``x`` (n, WINDOW bytes)."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 512):
            b = x[at : at + 512]
            pair = b[:, :-1].astype(np.intp) * 256 + b[:, 1:]
            tops = []
            for w, parts, bias in zip(WIDTHS, self._pairs(), self.bias, strict=True):
                steps, r = WINDOW - w + 1, None
                for j, look in enumerate(parts):
                    index = pair[:, 2 * j : 2 * j + steps] if len(look) == 65536 else b[:, 2 * j : 2 * j + steps]
                    got = look.take(index, axis=0)
                    r = got if r is None else np.add(r, got, out=r)
                tops.append(r.max(1) + bias)
            out[at : at + 512] = _softmax(np.maximum(np.concatenate(tops, 1), 0) @ self.out + self.out_bias)
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class number and mean probability of each non-empty text."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts])
        x = np.frombuffer(b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
        weight = np.full(len(x), WINDOW, np.float64)
        last = np.cumsum(counts) - 1
        weight[last] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, counts.tolist(), strict=True)]
        summed = np.add.reduceat(self.window_probabilities(x) * weight[:, None], last - counts + 1, axis=0)
        mean = summed / np.add.reduceat(weight, last - counts + 1)[:, None]
        best = mean.argmax(1)
        return best, mean[np.arange(len(best)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _windows(texts: list[str]) -> np.ndarray:
    cut = [t.encode("utf-8", "surrogatepass")[:WINDOW].ljust(WINDOW, b"\0") for t in texts]
    return np.frombuffer(b"".join(cut), np.uint8).reshape(-1, WINDOW)


def train(labelled: DataFrame, per_lang: int = 1500, per_doc: int = 4, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """Fit a network on a bounded sample of rows with labels: at most ``per_lang`` of each language, and of all together about ``max_rows``, shared evenly among them, or one of
    each where there are more languages; ``per_doc`` windows of each row. Every language that has a text is learned. Rows with a null language or without a letter teach
    nothing; None if no row is left. The sample is by a hash of the id, so it is the same on every run.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = materialize(labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count(), "languages")
    n = sizes.count()
    if not n:
        return None
    per_lang = max(1, min(per_lang, max_rows // n))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    odds = sizes.select("lang", F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.col("count")).alias("odds"))
    picked = usable.withColumn("draw", draw).join(odds, "lang").where("draw <= odds")
    room = F.greatest(F.length("text") - WINDOW + 1, F.lit(1)).cast("long")
    cuts = F.array(*[F.substring("text", (1 + F.pmod(F.xxhash64("id", F.lit(i)), room)).cast("int"), F.lit(WINDOW)) for i in range(per_doc)])
    ranked = picked.select("id", "lang", "draw", cuts.alias("cuts")).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("at") <= per_lang)
    rows = sorted((r["lang"], r["draw"], list(r["cuts"])) for r in ranked.select("lang", "draw", "cuts").collect())
    if not rows:
        return None
    langs = sorted({lang for lang, _, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    x = _windows([c for _, _, cuts in rows for c in cuts])
    y = np.array([number[lang] for lang, _, cuts in rows for _ in cuts])
    model = ByteCNN.fresh(langs)
    model.fit(x, y, epochs=max(4, min(40, 60_000 // len(x))))
    return model


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``(id, *keep, lang_pred, score)``, one row per input row; ``keep`` names further columns to carry.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    An empty table gives none; repeated rows and null ids keep a row each. A carried column whose name
    is taken (``lang_pred``, ``score``, ``_text`` or one before it) gets underscores before its name until it is free; others are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    taken, carried = ["lang_pred", "score", "_text"], []
    for name in (id_col, *keep):
        free = name
        while free.lower() in taken:
            free = f"_{free}"
        taken.append(free.lower())
        carried.append(F.col(name).alias(free))
    rows = docs.select(*carried, F.when(text.rlike(r"\p{L}"), text).alias("_text"))
    kept = rows.drop("_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    names = [*kept.columns, "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if some:
                best, prob = model.predict([texts[i].encode() for i in some])
                for i, b in zip(some, best.tolist(), strict=True):
                    lang[i] = model.langs[b]
                score[some] = np.clip(prob, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(score)], names)

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of training: CRC-32 of its id as text leaves 1 modulo 3 (a null id reads as empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` over ``documents`` with a network fitted on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
