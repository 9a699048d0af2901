"""Quality rules and robust multivariate outliers.

`text_statistics` reads whole texts, a batch at a time.  `robust_verdicts` then fits a
minimum-covariance-determinant estimate to the transformed statistics of each language
and source, of each language, and of all rows.  From each of several starts,
concentration steps keep the three quarters of the rows nearest to the current centre
and fit mean and covariance to them again, until the determinant falls no more; the
start with the least determinant wins.  A step is an aggregation of distances in fine
classes and one of sums and cross-products, both combined on the map side, so a hot
source costs a row a class and task; rows are never gathered.  Documents beyond the
cut-off Mahalanobis distance are rejected.

Covariances have least variances added to them (a regularised determinant), as most
statistics are zero in clean text.  A source's estimate is drawn towards that of its
language, and this one towards that of all rows, by the number of rows: with n rows its
own weight is n / (n + PRIOR_ROWS), at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, by_group, hidden, salted_join, stored, table
from .pieces import PieceTable, plain_table, runs, same_windows

#: Rows that the estimate of the level above counts for.
PRIOR_ROWS = 50
#: Part of a group's rows that an estimate keeps, and that the first step of each start
#: does: from medians and quartiles, from all rows, from the nearest half.
KEPT, STARTS = 0.75, (0.75, 1.0, 0.5)
#: Classes of squared distances in a factor of two.
FINE = 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _of(at: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, at, "right") - 1


def _counts(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks there are from each place to the next."""
    return np.add.reduceat(marks, at, dtype=np.int64)


def statistics(texts, words_of: PieceTable | None = None) -> dict[str, np.ndarray]:
    """The five statistics, and n_lines with a word, of each text of an Arrow array or list.

    Lines and words are told apart by their bytes.  A text over a megabyte stands alone,
    with some 40 bytes of memory for each of its bytes.
    """
    table = words_of or plain_table()
    out = {k: np.zeros(len(texts), np.int64) for k in [*STATS, "n_lines"]}
    for lo, hi, raw, borders in runs(texts):
        n = hi - lo
        if not raw:
            continue
        table.trim()
        data = np.frombuffer(raw, np.uint8)
        ends = np.r_[borders[1:], len(raw)]
        full = np.flatnonzero(ends > borders)  # texts with bytes, so that starts are unique
        begin = borders[full]
        solid = ~_SPACE[data]
        first = np.zeros(len(data), bool)
        first[begin] = True
        starts = np.flatnonzero(solid & (np.r_[False, ~solid[:-1]] | first))
        stops = np.flatnonzero(solid & (np.r_[~solid[1:], True] | np.r_[first[1:], True])) + 1
        words = full[_of(starts, begin)]
        out["n_words"][lo:hi] = np.bincount(words, minlength=n)
        out["word_chars"][lo + full] = _counts(solid & ((data & 0xC0) != 0x80), begin)
        out["n_symbols"][lo + full] = _counts(_SYMBOL[data], begin)
        # lines: from a text's start or after a line feed
        feed = np.flatnonzero(data == 10)
        at = np.unique(np.r_[begin, feed + 1])
        at = at[at < len(data)]
        real = _counts(solid, at) > 0
        till = np.r_[at[1:], len(data)]
        till = np.where(data[till - 1] == 10, till - 1, till)
        at, till = at[real], till[real]
        line_of = full[_of(at, begin)]
        out["n_lines"][lo:hi] = np.bincount(line_of, minlength=n)
        lines = table.find(raw, at, till) * n + line_of
        new = np.zeros(len(lines), bool)
        new[np.unique(lines, return_index=True)[1]] = True
        out["n_dup_lines"][lo:hi] = np.bincount(line_of[~new], minlength=n)
        # windows of three words of one text
        if len(starts) > 2:
            windows = same_windows(table.find(raw, starts, stops), 3) * n + words[:-2]
            inside = np.flatnonzero(words[:-2] == words[2:])
            _, back, count = np.unique(windows[inside], return_inverse=True, return_counts=True)
            again = inside[count[back] > 1]
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[again + k] = True
            out["n_repeat_words"][lo:hi] = np.bincount(words[covered], minlength=n)
    return out


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and the statistics of every row of docs (text); null texts have no words."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(parts):
        words = plain_table()
        for batch in parts:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                got = statistics(part.column(len(keep)), words)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(v) for v in got.values())], [*keep, *got])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*([fields] if keep else []), *(f"{k} bigint" for k in [*STATS, "n_lines"])]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics on scales where clean text is about normal."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


#: Least standard deviation of each transformed statistic: those that are zero in most
#: clean texts would have none, and any text with one symbol would be an outlier.
FLOOR = [0.35, 0.08, 0.06, 0.25, 0.2]
#: Mahalanobis distance, squared, beyond which a document is rejected.  Of normal
#: vectors in five dimensions fewer than one in a million lie beyond it.
CUT = 40.0
#: Makes the covariance of the nearest three quarters agree with that of all rows, for
#: normal vectors in five dimensions: 0.75 / P(chi2(7) <= 75 % quantile of chi2(5)).
_CONSISTENT = 1.42
_P = len(FLOOR)


_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_X, _M, _C, _I = ([f"x{i}" for i in range(_P)], [f"m{i}" for i in range(_P)], [f"c{i}{j}" for i, j in _PAIRS], [f"i{i}{j}" for i, j in _PAIRS])


def _distance() -> Column:
    """Squared Mahalanobis distance of the x to the m and inverse covariance of its row."""
    off = [F.col(x) - F.col(m) for x, m in zip(_X, _M, strict=True)]
    return sum((F.col(f"i{i}{j}") * off[i] * off[j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _full(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    out = np.zeros((len(upper), _P, _P))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = upper[:, k]
    return out


def _upper(full: np.ndarray) -> np.ndarray:
    return np.stack([full[:, i, j] for i, j in _PAIRS], axis=1)


def _arrow(keys: dict, **columns: np.ndarray) -> pa.RecordBatch:
    """keys, and the columns of matrices by their names (m, c, i) and of vectors."""
    names = {"m": _M, "c": _C, "i": _I}
    out = dict(keys)
    for name, v in columns.items():
        out |= dict(zip(names[name], (pa.array(np.ascontiguousarray(x)) for x in v.T), strict=True)) if name in names else {name: pa.array(v)}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _take(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() for n in names], axis=1).astype(float) if batch.num_rows else np.zeros((0, len(names)))


_DOUBLES = ", ".join(f"{c} double" for c in [*_M, *_C, *_I, "det"])


def _estimates(sums: DataFrame) -> DataFrame:
    """g, s, n, mean, covariance, inverse and determinant from the sums (m, c) of each group's kept rows."""

    def run(parts):
        for batch in parts:
            n = batch.column("n").to_numpy().astype(float)[:, None]
            mean, square = _take(batch, _M) / n, _full(_take(batch, _C) / n)
            cov = _CONSISTENT * (square - mean[:, :, None] * mean[:, None, :]) + np.diag(np.square(FLOOR))
            yield _arrow({k: batch.column(k) for k in ("g", "s", "n")}, m=mean, c=_upper(cov), i=_upper(np.linalg.inv(cov)), det=np.linalg.det(cov))

    return sums.mapInArrow(run, f"g string, s int, n bigint, {_DOUBLES}")


def _sums(rows: DataFrame) -> DataFrame:
    """g, s, n and the sums of x and of their products over rows (g, s, x)."""
    return rows.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(m) for x, m in zip(_X, _M, strict=True)), *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(c) for (i, j), c in zip(_PAIRS, _C, strict=True)))


def _concentrated(rows: DataFrame, est: DataFrame, kept: Column) -> DataFrame:
    """One concentration step: est of the part `kept` of each group's rows (g, x) nearest to est (g, s)."""
    d = F.greatest(_distance(), F.lit(1e-12))
    far = by_group(rows, est.select("g", "s", *_M, *_I), ["g"], "x0").select("g", "s", *_X, F.floor(F.log2(d) * FINE).cast("int").alias("class"))
    classes = far.groupBy("g", "s", "class").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "s").orderBy("class")
    marked = classes.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("g", "s"))})
    most = stored(marked.where(F.col("upto") - F.col("n") < F.ceil(kept * F.col("all"))).groupBy("g", "s").agg(F.max("class").alias("most")), "nearest")
    return _estimates(_sums(by_group(far, most, ["g", "s"], "x0").where(F.col("class") <= F.col("most"))))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group of rows (g string, x0 ... double).

    g, n (rows kept), mean m, covariance c, inverse i and det; a table without rows gives none.
    """
    quartiles = rows.groupBy("g").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(x) for x in _X))
    scale = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(f)) for x, f in zip(_X, FLOOR, strict=True)]
    diagonal = {f"i{i}{j}": 1 / (scale[i] * scale[i]) if i == j else F.lit(0.0) for i, j in _PAIRS}
    medians = quartiles.select("g", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"), *(F.col(x)[1].alias(m) for x, m in zip(_X, _M, strict=True)), *(v.alias(k) for k, v in diagonal.items()))
    first = F.element_at(F.array(*map(F.lit, STARTS)), F.col("s") + 1)
    starts = stored(_concentrated(rows, stored(medians, "medians"), first), "starts")
    # determinants are compared among estimates of equally many rows only
    est = stored(_concentrated(rows, starts, F.lit(KEPT)).withColumn("falls", F.lit(True)), "mcd")
    while not (now := est.where("falls")).isEmpty():
        # a determinant falls at each step or the estimate stays; it can't fall forever
        new = _concentrated(rows, now, F.lit(KEPT))
        old = est.select("g", "s", *(F.col(c).alias(f"old_{c}") for c in ("n", *_M, *_C, *_I, "det")))
        both = old.join(new, ["g", "s"], "left")
        better = F.coalesce(F.col("det") < F.col("old_det") * (1 - 1e-6), F.lit(False))
        est = stored(both.select("g", "s", *(F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("n", *_M, *_C, *_I, "det")), better.alias("falls")), "mcd")
    order = Window.partitionBy("g").orderBy("det", "s")
    return est.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "falls", "s")


def _drawn(own: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """own (rows, m, c, key of the level above) drawn towards above (g, m, c) by their rows."""
    w = F.col("rows") / (F.col("rows") + PRIOR_ROWS)
    both = own.join(above.select(F.col("g").alias(key), *(F.col(c).alias(f"up_{c}") for c in (*_M, *_C))), key)
    return both.withColumns({c: w * F.col(c) + (1 - w) * F.col(f"up_{c}") for c in (*_M, *_C)}).select("g", *own.drop("g", *_M, *_C).columns, *_M, *_C)


def _inverted(est: DataFrame) -> DataFrame:
    def run(parts):
        for batch in parts:
            yield _arrow({"g": batch.column("g")}, m=_take(batch, _M), i=_upper(np.linalg.inv(_full(_take(batch, _C)))))

    return est.select("g", *_M, *_C).mapInArrow(run, "g string, " + ", ".join(f"{c} double" for c in [*_M, *_I]))


def robust_verdicts(stats: DataFrame) -> DataFrame:
    """stats (lang, source and the statistics) with base_failed, distance and kept.

    Null languages and sources are values of their own.  A source without a row that
    passes the base rules has no estimate, and none of its rows is kept, as all fail.
    Repeated rows are judged each; an empty table gives no rows; columns of stats stay,
    but for one called base_failed, distance or kept, which is replaced.
    """
    rest = [c for c in stats.columns if c.lower() not in ("base_failed", "distance", "kept")]
    name = lambda level, *by: F.to_json(F.struct(F.lit(level).alias("level"), *by))
    whole, failed, dist, g = F.struct(*rest), base_failed(), F.col("distance"), name("source", "lang", "source")
    scored = stats.select(whole.alias("row"), failed.alias("base_failed"), g.alias("g"), name("lang", "lang").alias("l"), F.xxhash64(*STATS).alias("spread"), *(t.alias(x) for t, x in zip(transformed(), _X, strict=True)))
    fit = stored(scored.where("not base_failed").select("g", "l", *_X), "fit")
    vectors = stored(fit.select(F.explode(F.array("g", "l", F.lit("all"))).alias("g"), *_X), "vectors")
    est = stored(robust_estimates(vectors), "mcd")
    sizes = fit.groupBy("g", "l").agg(F.count(F.lit(1)).alias("rows"))
    langs = sizes.groupBy(F.col("l").alias("g")).agg(F.sum("rows").alias("rows")).withColumn("a", F.lit("all"))
    moments = est.select("g", *_M, *_C)
    langs = _drawn(langs.join(moments, "g"), moments, "a")
    drawn = stored(_inverted(_drawn(sizes.join(moments, "g"), langs, "l")), "drawn")
    if drawn.count() <= SMALL:
        out = scored.join(F.broadcast(drawn), "g", "left")
    else:
        out = salted_join(scored, drawn, ["g"], "spread")
    out = out.withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(dist <= CUT, F.lit(False))
    return out.select("row.*", "base_failed", "distance", kept.alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source) that the rules keep, with all their columns.

    A null or empty text has no words and fails the base rules; repeated rows stay or go
    together.
    """
    key = F.xxhash64("text", F.lit(1))
    stats = stored(text_statistics(docs.select("doc_id", "text", "lang", "source", key.alias("_key")), ("doc_id", "lang", "source", "_key")), "statistics")
    names = {c: hidden(docs, f"{c}_of_rules") for c in ("doc_id", "lang", "source", "_key")}
    good = robust_verdicts(stats).where("kept").select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    same = key == F.col(names.pop("_key"))
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return docs.join(good, same, "left_semi")


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics, base rules and verdict of all documents."""
    stats = stored(text_statistics(table(spark, sf_dir, "documents"), ("doc_id", "lang", "source")), "statistics")
    return robust_verdicts(stats).select("doc_id", *STATS, "base_failed", "kept", "distance")
