"""Hierarchical language identification: family first, then pairs within the family.

A text is its character 1- to 3-grams, hashed into `DIMS` counts (square roots, unit
length).  One linear support vector machine for each language family tells it from the
others; within a family, one for each pair of its languages votes.  The machines are
trained in parallel, each in a task of its own, on a bounded sample of labelled rows:
at most `PER_LANG` rows a language for a pair, and for a family, which all languages
enter, as many of them as keep it at `FAMILY_ROWS` rows in all (one a language at least).
Every language in the labels is learned; machines and driver memory grow with the number
of languages (some 32 kB a machine), not with the corpus.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .pieces import mix

DIMS = 1 << 13
PER_LANG, FAMILY_ROWS = 400, 12_000
#: Characters that are turned into features at a time, and rows.
CHARS, ROWS = 1 << 19, 64

#: Families of common languages by ISO 639-1 code (fixed values); others stand alone.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def _letters() -> np.ndarray:
    """For each code point: its own value if it is a letter, else 0 (made from the rule, not a list)."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


_table: list[np.ndarray] = []


def _grams(codes: np.ndarray, of: np.ndarray, fresh: int, out: np.ndarray) -> None:
    """Add to out the grams of codes (rows `of`) that end at or after place `fresh`."""
    for n in (1, 2, 3):
        if len(codes) < n:
            continue
        gram = np.full(len(codes) - n + 1, np.uint64(n))
        letters = np.zeros(len(gram), bool)
        for k in range(n):
            part = codes[k : len(codes) - n + 1 + k]
            gram = gram * np.uint64(0x1F7D5F9B) + part
            letters |= part > 0
        same = (of[: len(gram)] == of[n - 1 :]) & letters
        same[: max(0, fresh - n + 1)] = False
        spot = (mix(gram[same]) & np.uint64(DIMS - 1)).astype(np.int64)
        out += np.bincount(of[: len(gram)][same] * DIMS + spot, minlength=out.size).reshape(out.shape)


def features(texts: list[str | None]) -> np.ndarray:
    """Unit feature rows (float32) of the texts; all zero without letters.

    Texts are read in slices of about CHARS characters, so a long one takes no more memory.
    """
    if not _table:
        _table.append(_letters())
    out = np.zeros((len(texts), DIMS), np.float32)
    at = 0
    while at < len(texts):
        group, size = [at], len(texts[at] or "")
        while group[-1] + 1 < len(texts) and size + len(texts[group[-1] + 1] or "") <= CHARS:
            group.append(group[-1] + 1)
            size += len(texts[group[-1]] or "")
        # the last character read, and the last two kept, go on into the next slice of a long text
        before, kept, rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        here = np.zeros((len(group), DIMS), np.float32)
        for lo in range(0, max(1, size) if len(group) == 1 else 1, CHARS):
            parts = [(texts[i] or "").lower() if len(group) > 1 else (texts[i] or "")[lo : lo + CHARS].lower() for i in group]
            # a space before and after each text, so that what stands beside it tells nothing
            first, end = "\0" * (lo == 0), "\0" * (lo + CHARS >= size)
            joined = "".join(f"{first}{p}{end}" for p in parts)
            codes = _table[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
            of = np.repeat(np.arange(len(group)), [len(p) + len(first) + len(end) for p in parts])
            last = np.r_[before, codes[:-1]] if lo else np.r_[np.uint64(1), codes[:-1]]
            keep = (codes > 0) | (last > 0) | (np.r_[-1, of[:-1]] != of if lo == 0 else False)  # one space between words
            before = codes[-1:] if len(codes) else before
            fresh = len(kept)
            kept, rows = np.r_[kept, codes[keep]], np.r_[rows, of[keep]]
            _grams(kept, rows, fresh, here)
            kept, rows = kept[-2:], rows[-2:]
        out[group] = here
        at = group[-1] + 1
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine: squared hinge, dual coordinate descent."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    w, alpha, extra = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), 0.5 / c
    square = np.einsum("ij,ij->i", x, x) + extra
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + extra * alpha[i]
            new = max(0.0, alpha[i] - g / square[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most per_lang rows (text, lang, k) of each language, by hash; k numbers those of a language from 1."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    # a row a language: its true size decides the join
    rows = labelled.withColumn("h", F.xxhash64("doc_id", "text", F.lit(3))).join(counts, "lang")
    # thinned by hash first, so that the window below sees about twice the rows it keeps
    thin = rows.where(F.pmod("h", F.lit(1 << 40)) < F.least(F.lit(1.0), 2.0 * per_lang / F.col("n")) * (1 << 40))
    return thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_lang).select("text", "lang", "k")


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> list[dict]:
    """The machines: dicts of kind ('family' or 'pair'), a, b and weights (bytes, float32).

    labelled: doc_id, text, lang.  Without labels there are none, with one language there
    is nothing to tell apart: both are handled by `classify`.
    """
    spark = labelled.sparkSession

    def vectors(parts):
        for batch in parts:
            for lo in range(0, batch.num_rows, ROWS):
                x = features(batch.column(0).slice(lo, ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float16)]), *(batch.column(c).slice(lo, ROWS) for c in (1, 2))], ["x", "lang", "k"])

    rows = stored(sample(labelled, per_lang).mapInArrow(vectors, "x binary, lang string, k int"), "language-sample")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families = sorted({family(c) for c in langs})
    jobs = [("family", f, "", c, 1.0 if family(c) == f else -1.0) for f in families for c in langs if len(families) > 1]
    jobs += [("pair", a, b, c, y) for a, b in itertools.combinations(langs, 2) if family(a) == family(b) for c, y in ((a, 1.0), (b, -1.0))]
    if not jobs:
        return [{"kind": "only", "a": c, "b": "", "w": b""} for c in langs]
    wanted = spark.createDataFrame(jobs, "kind string, a string, b string, lang string, y double")

    def fit(group):
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
        y = group.column("y").to_numpy()
        w = train_svm(x, y)
        margin = (np.c_[x, np.ones(len(x), np.float32)] @ w) * y
        scale = 4.0 / max(0.1, float(np.quantile(margin, 0.25)))  # a margin's worth in the score
        first = group.slice(0, 1)
        return pa.table({"kind": first.column("kind"), "a": first.column("a"), "b": first.column("b"), "w": pa.array([w.astype(np.float32).tobytes()]), "scale": pa.array([scale], pa.float64())})

    of_family = (F.col("kind") == "pair") | (F.col("k") <= max(1, FAMILY_ROWS // len(langs)))
    # the machines and their languages: their true size decides the join
    fitted = rows.join(stored(wanted, "machines"), "lang").where(of_family).groupBy("kind", "a", "b").applyInArrow(fit, "kind string, a string, b string, w binary, scale double")
    # a row a machine: bounded by the languages
    return [r.asDict() for r in fitted.collect()] + [{"kind": "only", "a": c, "b": "", "w": b""} for c in langs]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def classify(docs: DataFrame, machines: list[dict], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred and score of every row of docs, from its text alone.

    `und` with score 0 where the text is null or has no letters, or nothing was learned.
    Repeated rows get one answer each; an empty table gives no rows; other columns are
    left out; a kept column called lang_pred or score makes way for the new one.
    """
    keep = tuple(c for c in keep if c.lower() not in ("lang_pred", "score"))
    langs = sorted(m["a"] for m in machines if m["kind"] == "only")
    families = sorted({family(c) for c in langs})
    weights = lambda kind: {(m["a"], m["b"]): (np.frombuffer(m["w"], np.float32), m["scale"]) for m in machines if m["kind"] == kind}
    by_family, by_pair = weights("family"), weights("pair")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def predict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        full = np.c_[x, np.ones(n, np.float32)]
        if by_family:
            margins = np.stack([full @ by_family[f, ""][0] for f in families], axis=1)
            of = margins.argmax(axis=1)
            top = np.sort(margins, axis=1)
            sure = _sigmoid((top[:, -1] - top[:, -2]) * 1.0 * by_family[families[0], ""][1])
        else:
            of, sure = np.zeros(n, np.int64), np.ones(n)
        pred, score = np.zeros(n, np.int64), np.zeros(n)
        for i, f in enumerate(families):
            rows = np.flatnonzero(of == i)
            own = [k for k, c in enumerate(langs) if family(c) == f]
            if not len(rows):
                continue
            chance = np.zeros((len(rows), len(own)))
            for p, q in itertools.combinations(range(len(own)), 2):
                w, scale = by_pair[langs[own[p]], langs[own[q]]]
                s = _sigmoid((full[rows] @ w) * scale)
                chance[:, p] += s
                chance[:, q] += 1 - s
            chance = chance / (len(own) - 1) if len(own) > 1 else np.ones_like(chance)
            best = chance.argmax(axis=1)
            pred[rows], score[rows] = np.array(own)[best], chance[np.arange(len(rows)), best] * sure[rows]
        return pred, score

    def run(parts):
        for batch in parts:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = features(part.column(len(keep)).to_pylist())
                known = x.any(axis=1)
                pred, score = predict(x) if langs else (np.zeros(len(x), np.int64), np.zeros(len(x)))
                known &= bool(langs)
                names = [langs[k] if ok else "und" for k, ok in zip(pred.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    machines = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return classify(docs, machines).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
