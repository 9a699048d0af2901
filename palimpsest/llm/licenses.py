"""License scans by diagonal voting.

Every window of `K` words of a text is hashed and joined with the windows of license
templates.  A hit votes for its diagonal, the offset between the text's and the template's
words.  Votes are added up for each text, template and diagonal; diagonals that differ by
at most `NEAR` are one span, so that inserted and left-out words don't break it.  Spans with
`VOTES` of the template's windows are verified by their words: a word of the template counts
if it stands in the text on a diagonal of the span.  Of spans that lie on each other the one
with the most words stays, so a text isn't told to be under every license with like wording.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, hidden, salted_join, stored, table
from .periodic import _Words
from .pieces import mix, runs

#: Words of a window.
K = 3
#: Diagonals that belong to one span differ by at most so much.
NEAR = 4
#: Share of a template's windows that have to vote for a span, and of its words (or the span's, if more) that have to be there.
VOTES, LIKE = 0.3, 0.7
#: Gram rows that a task gives out at a time.
ROWS = 1 << 16

# Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of public licenses and of usual statements, with labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "licensed under the 3 clause bsd license"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu gpl version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl", "licensed under the mozilla public license version 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)

#: ASCII capitals to small letters, what separates words to a space.
_LETTERS = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))
_NAME = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPAN = "label string, template int, start long, words long, likeness double"


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the windows of K words."""
    out = hashes
    for k in range(1, K):
        out = mix(out[: max(0, len(hashes) - k)] + hashes[k:])
    return out


@cache
def _templates() -> list[list[bytes]]:
    return [_NAME.findall(text.encode()) for _, text in TEMPLATES]


def template_grams(spark: SparkSession) -> DataFrame:
    """gram, template, place, least: a row for each window of each template; least is the votes that a span needs.

    As many rows as the templates have words, whatever the input: they are sent to every task.
    """
    rows = []
    for i, words in enumerate(_templates()):
        grams = _grams(np.array([_word_hash(w) for w in words], np.uint64)).view(np.int64).tolist()
        rows += [(g, i, p, max(1, int(np.ceil(VOTES * len(grams))))) for p, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, place int, least int")


class _Hashed(_Words):
    """Numbers of words with their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(0, np.uint64)

    def of_text(self, raw: bytes) -> np.ndarray:
        return self.of(raw.translate(_LETTERS))

    def hash_of(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.hashes) < len(self.names):
            self.hashes = np.r_[self.hashes, np.array([_word_hash(w) for w in self.names[len(self.hashes) :]], np.uint64)]
        return self.hashes[numbers]


def _texts(column):
    """(row, bytes) of the texts of an Arrow column."""
    for lo, _, raw, borders in runs(column):
        ends = np.r_[borders[1:], len(raw)].tolist()
        for i, (a, b) in enumerate(zip(borders.tolist(), ends, strict=True)):
            yield lo + i, raw[a:b]


def _gram_rows(batches):
    words = _Hashed()
    for batch in batches:
        if len(words.names) > 1 << 18:
            words = _Hashed()
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "g")]
        rows, places, grams, held = [], [], [], 0
        for row, raw in _texts(batch.column("text")):
            made = _grams(words.hash_of(words.of_text(raw))).view(np.int64)
            for lo in range(0, len(made), ROWS):
                part = made[lo : lo + ROWS]
                rows.append(np.full(len(part), row))
                places.append(np.arange(lo, lo + len(part)))
                grams.append(part)
                held += len(part)
                if held >= ROWS:
                    yield _gram_batch(keys, rows, places, grams)
                    rows, places, grams, held = [], [], [], 0
        if held:
            yield _gram_batch(keys, rows, places, grams)


def _gram_batch(keys, rows, places, grams):
    at = np.concatenate(rows)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[0][at], keys[1][at], np.concatenate(places), np.concatenate(grams))], ["h", "g", "pos", "gram"])


def spans(keyed: DataFrame) -> DataFrame:
    """h, g and the spans (template, lo, hi: first and last diagonal) with enough votes of texts with the key (h, g)."""
    hits = keyed.mapInArrow(_gram_rows, "h long, g long, pos long, gram long").join(F.broadcast(template_grams(keyed.sparkSession)), "gram")
    # rows that repeat vote once
    hits = hits.select("h", "g", "template", "least", (F.col("pos") - F.col("place")).alias("diagonal"), "pos").distinct()
    votes = hits.groupBy("h", "g", "template", "least", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    # within a text and template: no more rows than the text has words
    order = Window.partitionBy("h", "g", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)).cast("int")
    merged = votes.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    found = merged.groupBy("h", "g", "template", "span").agg(F.sum("votes").alias("votes"), F.first("least").alias("least"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"))
    return found.where("votes >= least").groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("template", "lo", "hi"))).alias("spans"))


def verify(words: np.ndarray, template: np.ndarray, lo: int, hi: int) -> tuple[int, int, int]:
    """(first word, words from it to the last one, words of the template met) on the diagonals lo to hi."""
    met, first, last = np.zeros(len(template), bool), None, None
    for d in range(lo, hi + 1):
        a, b = max(0, -d), min(len(template), len(words) - d)
        at = np.flatnonzero(words[a + d : b + d] == template[a:b]) + a if a < b else []
        if len(at):
            met[at] = True
            first = int(at[0]) + d if first is None else min(first, int(at[0]) + d)
            last = int(at[-1]) + d if last is None else max(last, int(at[-1]) + d)
    return (first, last - first + 1, int(met.sum())) if first is not None else (0, 0, 0)


def apart(found: list[tuple]) -> list[tuple]:
    """Of (start, words, met, likeness, template), those that don't lie by half or more on one with more words met."""
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[2], -x[3], x[4], x[0])):
        if all(2 * (min(x[0] + x[1], y[0] + y[1]) - max(x[0], y[0])) < x[1] for y in out):
            out.append(x)
    return sorted(out)


def _verified(batches):
    words = _Hashed()
    for batch in batches:
        if len(words.names) > 1 << 18:
            words = _Hashed()
        lists, out = batch.column("spans"), []
        for row, raw in _texts(batch.column("text")):
            numbers, found = words.of_text(raw), []
            for s in lists[row].as_py():
                template = np.array([words.numbers.get(w, -1) for w in _templates()[s["template"]]])
                start, size, met = verify(numbers, template, s["lo"], s["hi"])
                likeness = met / max(len(template), size)
                if likeness >= LIKE:
                    found.append((start, size, met, likeness, s["template"]))
            out.append([{"label": TEMPLATES[t][0], "template": t, "start": a, "words": n, "likeness": x} for a, n, _, x, t in apart(found)])
        kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("likeness", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), pa.array(out, kind)], ["h", "g", "licenses"])


def _base(batches):
    words = _Hashed()
    for batch in batches:
        if len(words.names) > 1 << 18:
            words = _Hashed()
        out = []
        for _, raw in _texts(batch.column("text")):
            numbers = words.of_text(raw)
            at, labels = [], []
            for phrase, label in PHRASES:
                want = [words.numbers.get(w, -1) for w in phrase.encode().split()]
                here = np.flatnonzero(numbers == want[0])
                here = here[here + len(want) <= len(numbers)]
                for k, w in enumerate(want[1:], 1):
                    here = here[numbers[here + k] == w]
                if len(here):
                    at.append(here)
                    labels.append(label)
            all_at = np.concatenate(at) if at else None
            out.append((len(numbers), 0 if all_at is None else len(all_at), None if all_at is None else int(all_at.min()), None if all_at is None else int(all_at.max()), sorted(labels)))
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in out], pa.list_(pa.string()))]
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + columns, [n for n, _ in rest] + ["n_words", "n_base", "first_word", "last_word", "base"])


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels of the phrases), licenses (label, template, start, words, likeness).

    Null and empty texts have no words and no labels; repeated rows give a row each, with
    equal results; ties between templates go to the first one; an empty table gives none;
    other columns are left out, whatever their names.  Long texts are split in slices, and
    their windows given out by 65,536.  A text is found again by 128 bits of two hashes.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(13), "doc_id", F.length("text"), F.hash("text"))})
    spanned = stored(spans(keyed.select("h", "g", "text")), "licenses")
    few = spanned.count() <= SMALL
    # texts without a span are not moved
    texts = keyed.select("h", "g", "text").join(F.broadcast(spanned) if few else spanned, ["h", "g"])
    seen = texts.mapInArrow(_verified, f"h long, g long, licenses array<struct<{_SPAN}>>").dropDuplicates(["h", "g"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = keyed.mapInArrow(_base, f"doc_id {kind}, h long, g long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    if few:
        out = base.join(F.broadcast(seen), ["h", "g"], "left")
    else:
        row = hidden(base, "row")
        out = salted_join(base.withColumn(row, F.monotonically_increasing_id()), seen, ["h", "g"], row).drop(row)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("licenses", F.array().cast(f"array<struct<{_SPAN}>>")).alias("licenses"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents: places and labels of the phrases, labels with the method's, and a score.

    score: likeness of the best verified span; 1 where a phrase stands in the text, as all of it is there; else 0.
    """
    rows = licenses(table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda s: s["likeness"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("licenses", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )
