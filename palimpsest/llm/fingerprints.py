"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs by its own content: at line ends and at sentence ends of any
script; a longer stretch without either is cut after words (characters, in scripts without
spaces) that their hashes pick, and where none is picked at a fixed length.  Edits move no
cut of another stretch.  The set
of their 64-bit digests goes into three tables of cells; a cell holds how many digests
fell into it, their exclusive or, and the exclusive or of their check values.  The
sketches of two versions subtract cell by cell, so what both share is gone; cells that
hold one digest are peeled until nothing is left, which gives every differing digest.
If cells stay, the pair is tried again with larger tables.  The first of these is made for
all pairs at once, as rows: a digest is three rows of (pair, cell), which a hash aggregate adds
up in the task that has the pair's digests, and only cells in use are there.  It is so wide
that most digests are alone in a cell, so it is peeled in one turn; the cells' sums
tell whether that gave all.  Pairs that are stuck there get wider tables as sorted lists of the
cells in use, and are peeled in turns.

Likeness: shared paragraphs / all paragraphs of both texts.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Cells of one table of the base sketch, which is the fingerprint.
BASE = 6
#: Cells of one table of the second try, for each character of both texts, and cells (rows) of a task about.
WIDTH, CELLS = 2, 1 << 20
#: Cells of one table of later tries, for each digest of both texts, and at least.
WIDER, LEAST = (1, 4, 32), 16
#: Rounds of peeling; a table of these widths is empty, or stuck, after ten or so.
_ROUNDS = 64
#: Line ends, and sentence ends: full stops of scripts that set no space after them cut by themselves.
#: A look-ahead, or one at a range, comes before what looks back, as most characters can't be a cut.
_CUTS = r"[\r\n]+|(?=[ \t\u00a0])(?<=[.!?\u2026\u061f\u06d4\u0589\u1362][\"')\]\u2019\u201d\u00bb]{0,2})[ \t\u00a0]+|(?<=[\u0964-\uff61])(?<=[\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u17d4\u104b\u0f0d])"
#: After a space, or a character of a script without spaces.
_UNITS = r"(?<=\s)|(?<=[\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff])"
#: Characters of a stretch that is cut after words too; one unit in so many ends a part, and a part has PART characters at most.
LONG, UNITS, PART = 120, 8, 200


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text; those without a visible character are none."""
    marked = lambda u: F.when(F.pmod(F.xxhash64(F.trim(u)), F.lit(UNITS)) == 0, F.concat(u, F.lit("\n"))).otherwise(u)
    cut = lambda p: F.split(F.regexp_replace(F.array_join(F.transform(F.split(p, _UNITS), marked), ""), f"([^\n]{{{PART}}})", "$1\n"), "\n")
    whole = F.split(text, _CUTS)
    parts = F.flatten(F.transform(whole, lambda p: F.when(F.length(p) > LONG, cut(p)).otherwise(F.array(p))))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _check(digest: Column) -> Column:
    return F.hash(digest, F.lit(11))


def _spread(digests: Column, sign: Column, width: Column) -> Column:
    """The cells (i, n, k, c) that digests fall into, three for each; tables lie one after the other."""
    cell = lambda d, t: F.struct((F.pmod(F.xxhash64(d, F.lit(t)), width) + width * t).alias("i"), sign.alias("n"), d.alias("k"), _check(d).alias("c"))
    return F.flatten(F.transform(digests, lambda d: F.array(*(cell(d, t) for t in range(3)))))


def _merged(cells: Column) -> Column:
    """Cells (i, n, k, c) in order of i, those of one place as one; cells that nothing is left in are gone."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("c"))
    both = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))
    one = lambda g: F.struct(g[0]["i"].alias("i"), F.aggregate(g, empty, both).alias("v"))

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["i"] != F.get(s, j - 1)["i"]))
        return _bind(heads, lambda h: F.transform(h, lambda at, q: _bind(F.slice(s, at + 1, F.coalesce(F.get(h, q + 1), F.size(s)) - at), one)))

    flat = lambda x: F.struct(x["i"].alias("i"), x["v"]["n"].alias("n"), x["v"]["k"].alias("k"), x["v"]["c"].alias("c"))
    used = lambda x: (x["v"]["n"] != 0) | (x["v"]["k"] != 0) | (x["v"]["c"] != 0)
    return F.when(F.size(cells) == 0, cells).otherwise(_bind(F.array_sort(cells), lambda s: F.transform(F.filter(runs(s), used), flat)))


def _spots(digest: Column, width: Column) -> list[Column]:
    """Its cell in each table; tables lie one after the other."""
    return [(F.pmod(F.xxhash64(digest, F.lit(t)), width.cast("long")) + width * t).cast("int") for t in range(3)]


def sketch(digests: Column, width: Column) -> Column:
    """array<struct<n, k, c>> of 3 * width cells."""
    spread = F.transform(digests, lambda d: F.struct(d.alias("k"), _check(d).alias("c"), *(s.alias(f"s{t}") for t, s in enumerate(_spots(d, width)))))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("c"))
    add = lambda a, q: F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(q["k"]).alias("k"), a["c"].bitwiseXOR(q["c"]).alias("c"))

    def one(items: Column, t: int) -> Column:
        return F.transform(F.sequence(width * t, width * (t + 1) - 1), lambda i: F.aggregate(F.filter(items, lambda q: q[f"s{t}"] == i), empty, add))

    return _bind(spread, lambda items: F.concat(*(one(items, t) for t in range(3))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, width: Column) -> Column:
    """How many digests the difference holds; null if cells are left that can't be peeled."""

    def single(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))

    def taken(all_cells: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(all_cells, single), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), *(s.alias(f"s{t}") for t, s in enumerate(_spots(x["k"], width))))))

    def without(all_cells: Column, found: Column) -> Column:
        here = lambda q, i: (q["s0"] == i) | (q["s1"] == i) | (q["s2"] == i)
        return F.transform(all_cells, lambda x, i: F.aggregate(F.filter(found, lambda q: here(q, i)), F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c")), lambda a, q: F.struct((a["n"] - q["n"]).alias("n"), a["k"].bitwiseXOR(q["k"]).alias("k"), a["c"].bitwiseXOR(q["c"]).alias("c"))))

    def turn(state: Column, _: Column) -> Column:
        step = lambda found: F.struct(F.when(F.size(found) == 0, state["cells"]).otherwise(without(state["cells"], found)).alias("cells"), (state["found"] + F.size(found)).alias("found"))
        return F.when(state["open"], _bind(taken(state["cells"]), lambda found: _bind(step(found), lambda s: F.struct(s["cells"].alias("cells"), s["found"].alias("found"), (F.size(found) > 0).alias("open"))))).otherwise(state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("open"))
    rest = lambda s: F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, turn, lambda s: F.when(~rest(s), s["found"]))


def peel_list(cells: Column, width: Column) -> Column:
    """How many digests the difference holds; null if cells are left that can't be peeled."""

    def single(all_cells: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.filter(all_cells, lambda x: (x["n"] == n) & (x["c"] == _check(x["k"]))), lambda x: x["k"]))

    def turn(state: Column, _: Column) -> Column:
        found = F.struct(single(state["cells"], 1).alias("more"), single(state["cells"], -1).alias("less"))

        def without(f: Column) -> Column:
            n = F.size(f["more"]) + F.size(f["less"])
            taken = F.concat(state["cells"], _spread(f["more"], F.lit(-1), width), _spread(f["less"], F.lit(1), width))
            return F.struct(F.when(n == 0, state["cells"]).otherwise(_merged(taken)).alias("cells"), (state["found"] + n).alias("found"), (n > 0).alias("open"))

        return F.when(state["open"], _bind(found, without)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), (F.size(cells) > 0).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, turn, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def _wider(a: Column, b: Column, times: int) -> Column:
    width = F.greatest(F.lit(LEAST), F.lit(times) * (F.size(a) + F.size(b))).cast("long")
    return _bind(width, lambda w: peel_list(_merged(F.concat(_spread(a, F.lit(1), w), _spread(b, F.lit(-1), w))), w))


def differing(a: Column, b: Column, base_a: Column, base_b: Column, second: Column) -> Column:
    """Number of digests in one of a and b, from ever larger sketches (second: the result of the second try)."""
    return F.coalesce(
        peel(subtract(base_a, base_b), F.lit(BASE)),
        second,
        *(_wider(a, b, times) for times in WIDER),
        # two digests in the same three cells of every try: not to be told apart by peeling
        F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)),
    )


def likeness(a: Column, b: Column, base_a: Column, base_b: Column, second: Column) -> Column:
    d, n = differing(a, b, base_a, base_b, second), F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(_bind(d, lambda x: (n - x).cast("double") / (n + x)))


def as_text(cells: Column) -> Column:
    """A base sketch as a string: count, digests and checks of each cell in hexadecimal."""
    return F.concat_ws(".", F.transform(cells, lambda c: F.concat_ws("-", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["c"].bitwiseAND(0xFFFF)))))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """id, guest, doc_id, text, next (text) and prev (id, guest, text's length): rows beside each other in descending doc_id, round at the end.

    Rows are dealt to ranges of doc_id; each range also gets the first row of the range
    below as a guest, so a window over one range finds every next row and no range is read twice.
    Null doc_ids come last, ties in descending order of a hash of the text; all rows of
    one doc_id, or without one, are in one range.  The id is that of a row of docs; a guest
    has its row's.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = base.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("b")).first()["b"] or []
    # as many bounds as ranges, a number that the settings give
    bounds = sorted(set(bounds))
    spot = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    ranged = base.withColumns({"range": F.when(F.col("doc_id").isNull(), -1).otherwise(spot), "tie": F.xxhash64("text")})
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie")
    tops = sorted((r["range"], r["top"]["id"], r["top"]["tie"]) for r in ranged.groupBy("range").agg(F.max(order).alias("top")).collect())
    above = {tops[i]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    guests = spark.createDataFrame([(r, i, t, to) for (r, i, t), to in above.items()], "range int, id long, top long, host int")
    same = (F.col("r.range") == F.col("g.range")) & (F.coalesce("r.doc_id", F.lit(-(1 << 63))) == F.col("g.id")) & (F.col("r.tie") == F.col("g.top"))
    met = ranged.withColumn("row", F.monotonically_increasing_id()).alias("r").join(F.broadcast(guests.coalesce(1)).alias("g"), same, "left")
    places = F.array_compact(F.array(F.struct(F.col("r.range").alias("range"), F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))))
    spread = met.select("row", "doc_id", "text", "tie", F.explode(places).alias("place")).select(F.col("row").alias("id"), "doc_id", "text", "tie", "place.range", "place.guest")
    window = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tie"))
    beside = spread.withColumns({"next": F.lead("text").over(window), "prev": F.lag(F.struct("id", "guest", F.length("text").cast("long").alias("n"))).over(window)})
    return beside.select("id", "guest", "doc_id", "text", "next", "prev")


def _second(moved: DataFrame) -> DataFrame:
    """id and d0, d1: the number of digests in one text alone, for both pairs of a text; null where the second try is stuck.

    moved has digests of one side (id, digests, w0, w1: widths of the pairs that they are in; both for the text itself).
    """
    side = lambda pair, sign: F.struct(F.lit(pair).alias("pair"), F.lit(sign).alias("sign"), F.col(f"w{pair}").alias("width"))
    sides = F.when(F.col("w1").isNull(), F.array(side(0, -1))).when(F.col("w0").isNull(), F.array(side(1, -1))).otherwise(F.array(side(0, 1), side(1, 1)))
    each = moved.select("id", "digests", F.explode(sides).alias("p")).select("id", "p.*", F.explode_outer("digests").alias("k")).where("k is not null")
    spots = F.array(*(F.pmod(F.xxhash64("k", F.lit(t)), F.col("width")) * 3 + t for t in range(3)))
    cells = each.select("id", "pair", "sign", "k", _check(F.col("k")).alias("c"), F.explode(spots).alias("i"))
    cells = cells.groupBy("id", "pair", "i").agg(F.sum("sign").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where("n <> 0 or k <> 0 or c <> 0")
    alone = (F.abs("n") == 1) & (F.col("c") == _check(F.col("k")))
    # every digest lies in one cell of the first table: its cells sum up to what is to be found
    all_ = {f"{x}_all": F.when(F.col("i") % 3 == 0, F.col(x)).otherwise(F.lit(0)) for x in "nkc"}
    found = cells.select("id", "pair", F.when(alone, F.col("k")).alias("digest"), F.when(alone, F.col("n")).alias("sign"), *(v.alias(k) for k, v in all_.items()))
    found = found.groupBy("id", "pair", "digest").agg(F.max("sign").alias("sign"), F.sum("n_all").alias("n_all"), F.bit_xor("k_all").alias("k_all"), F.bit_xor("c_all").alias("c_all"))

    def count(pair: int) -> Column:
        of = lambda x: F.when(F.col("pair") == pair, x)
        digest = F.col("digest")
        got = [F.sum(of(F.coalesce("sign", F.lit(0)))), F.bit_xor(of(F.coalesce(digest, F.lit(0)))), F.bit_xor(of(F.when(digest.isNotNull(), _check(digest)).otherwise(F.lit(0))))]
        want = [F.sum(of(F.col("n_all"))), F.bit_xor(of(F.col("k_all"))), F.bit_xor(of(F.col("c_all")))]
        return F.when(got[0].eqNullSafe(want[0]) & got[1].eqNullSafe(want[1]) & got[2].eqNullSafe(want[2]), F.count(of(digest)).cast("int"))

    return found.groupBy("id").agg(count(0).alias("d0"), count(1).alias("d1"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, that of its edited text, and their likeness.

    The edited text has its last floor(n / 2) characters replaced by the first as many of
    the next text.  Null texts are empty; an empty text has no paragraphs, and two such
    texts are alike (1.0); repeated rows give a row each; an empty table gives none; other
    columns are left out, whatever their names.  A text's digests stand in one array, so a
    text may have as many paragraphs as fit one value (some ten million), and one task has
    the cells of its pairs, and may spill them.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next", F.lit(1), half))))
    width = lambda *n: F.greatest(F.lit(LEAST).cast("long"), WIDTH * sum(n))
    n = F.col("n_chars")
    made = rows.select(
        *("id", "guest", "doc_id", "n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("pa"),
        paragraphs(F.col("edited")).alias("pe"),
        F.when(~F.col("prev.guest"), F.col("prev.id")).alias("prev"),
        *(width(*x).alias(w) for w, x in (("w_edited", (n, n)), ("w_next", (n, F.length("next"))), ("w_prev", (n, F.col("prev.n"))))),
    )
    kept = stored(made.select("*", (3 * F.size("pa") + F.greatest(F.lit(0), F.size("pe"))).alias("n_sides")), "digests")

    # digests go to the texts whose pairs they are in: a text's own, its edited text's, and those of the text before which it comes next
    parts = 1 + (kept.agg(F.sum(F.col("n_sides").cast("long") * 3).alias("n")).first()["n"] or 0) // CELLS
    none, side = F.lit(None).cast("long"), lambda i, p, w0, w1: F.struct(F.col(i).alias("id"), F.col(p).alias("digests"), w0.alias("w0"), w1.alias("w1"))
    own = F.array(side("id", "pa", F.col("w_edited"), F.col("w_next")), side("id", "pe", F.col("w_edited"), none))
    other = F.when(F.col("prev").isNotNull(), F.array(side("prev", "pa", none, F.col("w_prev"))))
    empty = F.slice(own, 1, 0)
    moved = kept.select(F.explode(F.concat(F.when(~F.col("guest"), own).otherwise(empty), F.coalesce(other, empty))).alias("s")).select("s.*").where("id is not null").repartition(parts, "id")
    texts = {"pa": F.col("w0").isNotNull() & F.col("w1").isNotNull(), "pe": F.col("w1").isNull(), "pn": F.col("w0").isNull()}
    met = moved.groupBy("id").agg(*(F.first(F.when(here, F.col("digests")), ignorenulls=True).alias(p) for p, here in texts.items()))
    met = met.join(_second(moved), "id", "left").join(kept.where(~F.col("guest")).select("id", "doc_id", "n_chars", "edited_sha256"), "id")
    met = met.select("*", *(sketch(F.col(p), F.lit(BASE)).alias(k) for p, k in (("pa", "sa"), ("pe", "se"), ("pn", "sn"))))
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sa")).alias("fingerprint"),
        as_text(F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("pa"), F.col("pe"), F.col("sa"), F.col("se"), F.col("d0")).alias("near_edited"),
        likeness(F.col("pa"), F.col("pn"), F.col("sa"), F.col("sn"), F.col("d1")).alias("near_next"),
    )


def op5_lookup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents and of their edited texts, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))
