"""License scans: exact set-similarity join of text blocks with license templates.

A block is any window of consecutive words, line ends or not, as long as a template of that many words
may be spread at the threshold: length / ``threshold``. A block meets a template if it holds at least
``threshold`` of the template's distinct tokens, a of them, and if no near-equal template of another
label explains it better: it holds all tokens that the template has and such a one lacks, and not all that
a larger one has besides. Near-equal are two templates one of which would meet the other.

Template tokens are ordered by their frequency over all documents, rarest first. A block that meets a
template holds a token of its prefix (all but the a-1 most frequent tokens), so only the neighbourhoods
of such tokens are looked at; these hold a tokens at least (length), and at a shared token enough may
still follow on both sides (position). What passes is counted in full, window by window. Phrases that
must stand word for word are labelled besides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, per_row, table, texts, to_arrow
from graphloom.llm.toxicity import TOKEN_TABLE

THRESHOLD = 0.8
#: Phrases with the labels that they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public notices that are looked for as sets of words, with the labels that they give.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license version 3": "lgpl-3",
    "licensed under the gnu affero general public license version 3": "agpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}


def block_tokens(line: bytes) -> list[bytes]:
    return line.translate(TOKEN_TABLE).split()


class Template:
    """Distinct tokens, label, the least number of them, the window, and what sets it apart from near-equal ones."""

    def __init__(self, words: list[bytes], label: str, threshold: float):
        self.words, self.label = frozenset(words), label
        self.least = least_of(len(self.words), threshold)
        self.window = window_of(len(words), threshold)
        self.must: frozenset[bytes] = frozenset()
        self.must_not: list[frozenset[bytes]] = []

    def set_apart(self, others: list[Template]) -> None:
        near = [o.words for o in others if o.label != self.label and len(o.words & self.words) >= min(o.least, self.least)]
        self.must = frozenset().union(*(self.words - o for o in near))
        self.must_not = [o - self.words for o in near if o > self.words]


def least_of(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def window_of(n: int, threshold: float) -> int:
    return math.ceil(n / threshold - 1e-9)


def all_templates(templates: dict[str, str], threshold: float) -> list[Template]:
    out = [Template(w, label, threshold) for t, label in templates.items() if (w := block_tokens(t.encode()))]
    for t in out:
        t.set_apart(out)
    return out


class Index:
    """Templates by the tokens of their prefixes, for texts met one at a time."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.templates = all_templates(templates, threshold)
        order = lambda w: (frequency.get(w, 0), w)
        self.place = {w: i for i, w in enumerate(sorted({w for t in self.templates for w in t.words}, key=order))}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for j, w in enumerate(sorted(t.words, key=order)[: len(t.words) - t.least + 1]):
                self.prefix.setdefault(w, []).append((k, j))
        self.rare = frozenset(self.prefix)

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Label and largest containment of each template that some window meets."""
        if self.rare.isdisjoint(words):
            return
        met: dict[int, list[tuple[int, int]]] = {}
        for p, w in enumerate(words):
            for k, j in self.prefix.get(w, ()):
                met.setdefault(k, []).append((p, j))
        for k, places in met.items():
            t, best, done = self.templates[k], 0, 0
            for p, j in places:
                lo, hi = max(0, p - t.window + 1), min(len(words), p + t.window)
                block = sorted(t.words.intersection(words[lo:hi]), key=self.place.__getitem__)
                if len(block) < t.least or len(t.words) - j + block.index(words[p]) < t.least:  # of the j rarer ones, those are missing that the block lacks
                    continue
                for i in range(max(lo, done), max(lo, min(p, len(words) - t.window)) + 1):  # windows that begin before ``done`` were seen
                    window = words[i : i + t.window]
                    found = t.words.intersection(window)
                    if len(found) > best and len(found) >= t.least and t.must <= found and not any(m.issubset(window) for m in t.must_not):
                        best = len(found)
                done = max(done, p + 1)
                if best == len(t.words):
                    break
            if best:
                yield t.label, best / len(t.words)


def token_frequency(docs: DataFrame, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each of these few tokens stands; every document is read."""
    bound_batches(docs.sparkSession)
    arrow = to_arrow(docs.sparkSession, "token binary, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in texts(b):
                seen.update(tokens.intersection(block_tokens(t)))
        yield pa.RecordBatch.from_pydict({"token": list(seen), "n": list(seen.values())}, schema=arrow)

    return {bytes(r[0]): r[1] for r in docs.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n")).collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    score: the largest containment that meets the threshold, 1 where a phrase stands, else 0. Null texts
    have no words and no labels; null ids and repeated rows are kept. Ids are whole numbers (others raise).
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text")
    index = Index(templates, token_frequency(rows.select("text"), frozenset(w for t in templates for w in block_tokens(t.encode()))), threshold)
    wanted = [(block_tokens(p.encode()), label) for p, label in phrases.items()]
    ends = frozenset(p[-1] for p, _ in wanted)

    def one(text: bytes) -> tuple:
        words = block_tokens(text)
        starts, base = [], set()
        if not ends.isdisjoint(words):
            for at, w in enumerate(words):
                if w in ends:
                    for phrase, label in wanted:
                        first = at - len(phrase) + 1
                        if first >= 0 and words[first : at + 1] == phrase:
                            starts.append(first)
                            base.add(label)
        labels, score = set(base), float(bool(base))
        for label, share in index.matches(words):
            labels.add(label)
            score = max(score, share)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def run(b: pa.RecordBatch) -> dict:
        return {id_col: b.column("id")} | dict(zip(names, map(list, zip(*map(one, texts(b)), strict=True)), strict=True))

    return per_row(rows, run, f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def licenses_sql() -> str:
    """The rule written out: templates are set against each other, then every window of every text that has enough of a template's tokens is counted."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    temps = ", ".join(f"({k}, '{label}', string_split('{t}', ' '))" for k, (t, label) in enumerate(TEMPLATES.items()))
    phr = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, {word}) AS w FROM d),
p(label, ws) AS (VALUES {phr}),
places AS (SELECT r, label, i - 1 AS i FROM (SELECT r, w, label, ws, unnest(range(1, len(w) - len(ws) + 2)) AS i FROM w, p WHERE len(w) >= len(ws)) WHERE w[i:i + len(ws) - 1] = ws),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY 1),
t0(k, label, ws) AS (VALUES {temps}),
t1 AS (SELECT k, label, list_distinct(ws) AS s, CAST(ceil({THRESHOLD} * len(list_distinct(ws)) - 1e-9) AS BIGINT) AS need, CAST(ceil(len(ws) / {THRESHOLD} - 1e-9) AS BIGINT) AS span FROM t0),
near AS (SELECT a.k, list_filter(a.s, lambda x: NOT list_contains(b.s, x)) AS own, list_filter(b.s, lambda x: NOT list_contains(a.s, x)) AS more FROM t1 a, t1 b WHERE a.label <> b.label AND len(list_intersect(a.s, b.s)) >= least(a.need, b.need)),
apart AS (SELECT k, flatten(list(own)) AS must, coalesce(list(more) FILTER (len(own) = 0 AND len(more) > 0), []) AS must_not FROM near GROUP BY 1),
t AS (SELECT t1.*, coalesce(must, []) AS must, coalesce(must_not, []) AS must_not FROM t1 LEFT JOIN apart USING (k)),
toks AS (SELECT k, need, unnest(s) AS x FROM t),
words AS (SELECT DISTINCT r, unnest(w) AS x FROM w),
cand AS (SELECT r, k FROM words JOIN toks USING (x) GROUP BY r, k HAVING count(*) >= any_value(need)),
win AS (SELECT r, t.*, w.w AS w, unnest(range(0, greatest(len(w.w) - span, 0) + 1)) AS i FROM cand JOIN t USING (k) JOIN w USING (r)),
blocks AS (SELECT r, label, s, need, must, must_not, list_distinct(w[i + 1:i + span]) AS b FROM win),
found AS (SELECT r, label, len(list_intersect(b, s)) / len(s) AS c FROM blocks WHERE len(list_intersect(b, s)) >= need AND list_has_all(b, must) AND len(list_filter(must_not, lambda m: list_has_all(b, m))) = 0),
alll AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM found UNION ALL SELECT r, label FROM places) GROUP BY 1),
best AS (SELECT r, max(c) AS c FROM found GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, base.lo AS first_word, base.hi AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(alll.l, '') AS labels, CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(best.c, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN alll USING (r) LEFT JOIN best USING (r)
"""
