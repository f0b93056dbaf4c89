"""Operator 10: licence notices by a positional index of rare words.

Words of licence templates are counted over the whole corpus. Of each template its words of highest IDF are indexed, with
their places. A file's words of the index vote, by their weight, for where each template would start; where votes for
starts that agree hold most of a template's weight, its mandatory key phrases are looked for at their places. The words
are chosen for each template, so what else a file holds, or how long it is, makes no difference to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import table
from ._words import chunks, text_words, words

#: Phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, notice, key phrases of which each must stand at its place). A parameter. Wordings of public licences and their notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission is hereby granted free of charge"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["has waived all copyright and related or neighboring rights"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify and or distribute this software for any purpose"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", ["permission is granted to anyone to use this software for any purpose"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
]

#: Words of a template that are indexed: its rarest, at most so many, and none with under this share of its rarest word's IDF.
INDEXED_WORDS, LEAST_WEIGHT = 16, 0.1
#: Share of a template's indexed weight that must stand at places that agree.
LEAST_SHARE = 0.75
#: Places by which words and key phrases may be off: as many words may be put in or left out.
SLACK = 4

PLACE = pa.struct([("label", pa.string()), ("start", pa.int64())])
MATCH = pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())])
SCHEMA = "n_words long, places array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,score:double>>"


class _Vocabulary:
    """Numbers for the words of templates and phrases, and the number of each word of a run of texts (-1: another word)."""

    def __init__(self, texts: list[str]):
        self.hashes = np.unique(np.concatenate([text_words(t) for t in texts] or [np.zeros(0, np.uint64)]))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def text(self, text: str) -> np.ndarray:
        return self.of(text_words(text))


def _phrase_places(ids: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word places where the phrase starts, within one text."""
    n = len(phrase)
    at = np.flatnonzero(ids == phrase[0])
    at = at[at + n <= len(ids)]
    for k in range(1, n):
        at = at[ids[at + k] == phrase[k]]
    return at[owner[at] == owner[at + n - 1]]


def word_frequencies(docs: DataFrame, texts: list[str], text: str = "text") -> tuple[int, dict[int, int]]:
    """Over all documents: their number, and for each licence word (by its number) how many have it. Its size is that of the templates."""
    vocabulary = _Vocabulary(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                found = words(data, offsets)
                ids = vocabulary.of(found.hashes)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(found.bounds))
                pairs = np.unique(owner[ids >= 0] * len(total) + ids[ids >= 0]) if len(total) else ids[:0]
                total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
                n += len(offsets) - 1
        yield pa.RecordBatch.from_pydict({"word": [-1, *range(len(total))], "n": [n, *total.tolist()]}, schema=pa.schema([("word", pa.int64()), ("n", pa.int64())]))

    counted = docs.select(text).mapInArrow(count, "word long, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {r.word: r.n for r in counted}
    return by_word.pop(-1, 0), by_word


class _Index:
    """Postings (template, place, weight) of the indexed words of notices, by word; and each notice's whole weight."""

    def __init__(self, notices: list[np.ndarray], idf: np.ndarray):
        rows = []
        for t, notice in enumerate(notices):
            distinct = sorted(set(notice.tolist()), key=lambda w: (-idf[w], w))[:INDEXED_WORDS]
            top = idf[distinct[0]]
            # words that are in every file tell nothing; if all of a notice's are, each counts alike
            chosen = {w: idf[w] if top > 0 else 1.0 for w in distinct if idf[w] >= LEAST_WEIGHT * top}
            rows += [(w, t, place, chosen[w]) for place, w in enumerate(notice.tolist()) if w in chosen]
        rows.sort()
        self.word, self.template, self.place = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.weight = np.array([r[3] for r in rows], np.float64)
        self.first, self.n = np.searchsorted(self.word, np.arange(len(idf) + 1)), np.bincount(self.word, minlength=len(idf) + 1)
        self.total = np.bincount(self.template, self.weight, minlength=len(notices)) if rows else np.zeros(len(notices))

    def votes(self, ids: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, template, starts, places, weights) of the pairs of which enough words are in the text at all. Starts count from the run's first word."""
        hits = np.flatnonzero(self.n[ids])
        times = self.n[ids[hits]]
        post = np.repeat(self.first[ids[hits]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(hits) else hits
        at = np.repeat(hits, times)
        pair = owner[at] * len(self.total) + self.template[post]
        # each posting counts once for a text
        once = np.unique(np.column_stack([pair, post]), axis=0)
        names, of = np.unique(once[:, 0], return_inverse=True)
        enough = np.bincount(of, self.weight[once[:, 1]], minlength=len(names)) >= (LEAST_SHARE - 1e-9) * self.total[names % len(self.total)]
        keep = np.isin(pair, names[enough])
        pair, at, post = pair[keep], at[keep], post[keep]
        order = np.lexsort((at - self.place[post], pair))
        pair, at, post = pair[order], at[order], post[order]
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pair)], strict=True) if len(pair) else ():
            text, template = divmod(int(pair[low]), len(self.total))
            part = post[low:high]
            yield text, template, at[low:high] - self.place[part], self.place[part], self.weight[part]


def _windows(starts: np.ndarray, places: np.ndarray, weights: np.ndarray) -> Iterator[tuple[float, int]]:
    """(weight, start) of the votes within SLACK of each start, a place counting once; of the window the start with most votes. Starts ascend."""
    starts, places, weights = starts.tolist(), places.tolist(), weights.tolist()
    held: dict[int, int] = {}
    by_start: dict[int, float] = {}
    total, low, high = 0.0, 0, 0
    while low < len(starts):
        begin = starts[low]
        while high < len(starts) and starts[high] <= begin + SLACK:
            held[places[high]] = held.get(places[high], 0) + 1
            total += weights[high] if held[places[high]] == 1 else 0.0
            by_start[starts[high]] = by_start.get(starts[high], 0.0) + weights[high]
            high += 1
        yield total, max(by_start, key=lambda s: (round(by_start[s], 9), -s))
        while low < high and starts[low] == begin:
            held[places[low]] -= 1
            total -= weights[low] if not held[places[low]] else 0.0
            low += 1
        del by_start[begin]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list | None = None, text: str = "text") -> DataFrame:
    """docs and n_words, places (of phrases: label, first word), matches (of templates: label, first word, share of its weight in place).

    Of a label's templates and places the largest share counts, of equal ones the first place.

    Columns of docs with these names are replaced. Null text: no words, empty lists. An empty table gives an empty
    result. Repeated rows give repeated results. All words of a text count, however long it is.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    texts = [*phrases, *(t[1] for t in templates), *(p for t in templates for p in t[2])]
    n_docs, seen = word_frequencies(docs, texts, text)
    vocabulary = _Vocabulary(texts)
    idf = np.array([np.log((n_docs + 1) / (seen.get(i, 0) + 1)) for i in range(len(vocabulary.hashes))])
    rules = [(label, vocabulary.text(p)) for p, label in phrases.items()]
    forms = [(label, vocabulary.text(notice), [vocabulary.text(p) for p in keys]) for label, notice, keys in templates]
    forms = [(label, notice, [key for key in keys if len(key)]) for label, notice, keys in forms if len(notice)]
    index = _Index([notice for _, notice, _ in forms], idf)

    def found_in(ids: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> dict[int, list[dict]]:
        """The templates of each text of a run."""
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for text_no, template, starts, places, weights in index.votes(ids, owner):
            label, notice, keys = forms[template]
            own, begin = ids[bounds[text_no] : bounds[text_no + 1]], int(bounds[text_no])
            for weight, start in _windows(starts - begin, places, weights):
                share = min(1.0, weight / index.total[template])
                name = (text_no, label)
                if share >= LEAST_SHARE - 1e-9 and (round(share, 9), -max(start, 0)) > best.get(name, (-1.0, 0)) and all(_near(own, key, start + _index(notice, key)) for key in keys):
                    best[name] = (round(share, 9), -max(start, 0))
        out: dict[int, list[dict]] = {}
        for (text_no, label), (share, start) in sorted(best.items()):
            out.setdefault(text_no, []).append({"label": label, "start": -start, "score": share})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            n_words, places, matches = np.zeros(size, np.int64), [[] for _ in range(size)], [[] for _ in range(size)]
            for first, data, offsets in chunks(batch.column(batch.schema.names.index("__text"))):
                found = words(data, offsets)
                n_words[first : first + len(offsets) - 1] = np.diff(found.bounds)
                ids = vocabulary.of(found.hashes)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(found.bounds))
                for label, phrase in rules:
                    for at in _phrase_places(ids, owner, phrase).tolist():
                        places[first + owner[at]].append({"label": label, "start": at - int(found.bounds[owner[at]])})
                for i, listed in found_in(ids, owner, found.bounds).items():
                    matches[first + i] = listed
            keep = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(n_words), pa.array(places, pa.list_(PLACE)), pa.array(matches, pa.list_(MATCH))], names=[*keep.schema.names, "n_words", "places", "matches"])

    kept = docs.select(*[c for c in docs.columns if c not in ("n_words", "places", "matches", "__text")], F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    return kept.mapInArrow(run, StructType([*fields, *StructType.fromDDL(SCHEMA).fields]))


def _near(ids: np.ndarray, phrase: np.ndarray, start: int) -> bool:
    low, high = max(0, start - SLACK), start + SLACK
    return any(np.array_equal(ids[i : i + len(phrase)], phrase) for i in range(low, high + 1))


def _index(notice: np.ndarray, phrase: np.ndarray) -> int:
    """Where the phrase stands in the notice; 0 if it doesn't."""
    return next((i for i in range(len(notice) - len(phrase) + 1) if np.array_equal(notice[i : i + len(phrase)], phrase)), 0)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, base = F.expr("transform(places, x -> x.start)"), F.expr("transform(places, x -> x.label)")
    added = F.expr("transform(matches, x -> x.label)")
    listed = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, added)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.expr("transform(matches, x -> x.score)")), F.lit(0.0))).alias("score"),
    )


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE_SQL: dict[str, str] = {}
