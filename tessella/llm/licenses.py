"""License scans: an exact set-similarity join of text blocks and license templates.

A text's words are cut into overlapping blocks, of a width for each size of
template, so that a copy of a template lies whole in some block.  A block is the
set of its distinct words that any template has (no other word counts towards a
template's containment), in one global order: rarest first by the number of
documents that hold the word, counted over the whole corpus.  A block and a
template join where the block holds at least the template's share of its words.
Pairs are found through an index of the templates' prefixes, kept to pairs whose
length and position still allow the wanted overlap, and then counted in full, so
the join is exact.  A phrase is a template whose words must all be there and
which, in a block that joins, must stand consecutively.

The templates are a parameter (at most ``MOST_WORDS`` words of them, checked),
so the index and the counted order have a bound that doesn't depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import LOWER, UPPER, encode

#: Bytes that end a word; A-Z become a-z first.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Word pattern of the same rule, for SQL.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WORDS = 1 << 20


@dataclass(frozen=True)
class Template:
    """``percent`` of the distinct words must be in a block; a ``phrase`` must stand there as it is."""

    label: str
    text: str
    percent: int = 80
    phrase: bool = False


#: The phrases, and usual wordings of license statements and notices.
PHRASES = (
    Template("gpl", "gnu general public license", 100, True),
    Template("apache", "apache license", 100, True),
    Template("cc-by", "cc by", 100, True),
    Template("mit", "mit license", 100, True),
)
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2.0", 85),
    Template("mit-statement", "released under the mit license", 100),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", 80),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4.0", 100),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license", 80),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", 80),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", 80),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 80),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 80),
)
TEMPLATES = PHRASES + NOTICES


def words(text: str | None) -> list[bytes]:
    """Words of the lower-cased text: runs of digits, letters a-z and everything beyond ASCII."""
    return encode(text).translate(_TABLE).split()


def block_width(template: Template) -> int:
    """The least power of two, 16 at least, of which half holds the whole template."""
    n = len(words(template.text))
    return max(16, 1 << (2 * n - 1).bit_length())


class _Index:
    """Templates by the words of their prefixes, in the global order of words."""

    def __init__(self, templates: Sequence[Template], order: Sequence[bytes]):
        self.id = {w: k for k, w in enumerate(order)}
        self.texts = [[self.id[w] for w in words(t.text)] for t in templates]
        self.sets = [sorted(set(x)) for x in self.texts]
        self.need = [max(1, -(-t.percent * len(s) // 100)) for t, s in zip(templates, self.sets)]
        self.widths: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.rare = np.zeros(len(order) + 1, bool)  # the last entry stands for words of no template
        for k, t in enumerate(templates):
            prefixes = self.widths.setdefault(block_width(t), {})
            for place, w in enumerate(self.sets[k][: len(self.sets[k]) - self.need[k] + 1]):
                prefixes.setdefault(w, []).append((k, place))
                self.rare[w] = True

    def joined(self, block: list[int], prefixes: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
        """(template, shared words) of every template that the block (ascending) joins."""
        seen, whole = set(), None
        for place, w in enumerate(block):
            for k, at in prefixes.get(w, ()):
                need, size = self.need[k], len(self.sets[k])
                if k in seen or len(block) < need or place > len(block) - need or 1 + min(len(block) - place, size - at) - 1 < need:
                    continue  # length, the block's prefix, and what can still follow the first shared word
                seen.add(k)
                whole = whole or set(block)
                shared = sum(x in whole for x in self.sets[k])
                if shared >= need:
                    yield k, shared


def _scan(text: str | None, index: _Index, templates: Sequence[Template]) -> tuple[int, list[dict], list[dict]]:
    """Words, phrases' places, and blocks that join a template."""
    tokens = words(text)
    none = len(index.rare) - 1
    ids = np.fromiter((index.id.get(w, none) for w in tokens), np.int64, len(tokens))
    hits = np.flatnonzero(index.rare[ids])
    places, blocks = set(), []
    if len(hits):
        for width, prefixes in index.widths.items():
            stride = width // 2
            near = np.unique(np.concatenate([hits // stride, hits // stride - 1]))
            for start in near[near >= 0] * stride:
                part = ids[start : start + width]
                block = np.unique(part)
                for k, shared in index.joined(block[block != none].tolist(), prefixes):
                    if templates[k].phrase:
                        wanted = index.texts[k]
                        ok = np.ones(max(0, len(part) - len(wanted) + 1), bool)
                        for j, w in enumerate(wanted):
                            ok &= part[j : j + len(ok)] == w
                        places |= {(int(start + p), k) for p in np.flatnonzero(ok)}
                    else:
                        blocks.append({"label": templates[k].label, "template": k, "start": int(start), "n": len(part), "shared": shared, "of": len(index.sets[k])})
    found = [{"label": templates[k].label, "start": p, "n": len(index.texts[k])} for p, k in sorted(places)]
    return len(tokens), found, sorted(blocks, key=lambda b: (b["start"], b["template"]))


_PLACE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("n", pa.int32())])
_BLOCK = pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("shared", pa.int32()), ("of", pa.int32())])


def word_order(docs: DataFrame, templates: Sequence[Template]) -> list[bytes]:
    """All words of the templates, rarest first by documents of the corpus, ties by bytes."""
    wanted = {w for t in templates for w in words(t.text)}
    if len(wanted) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} different words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in batch["text"]:
                for w in wanted.intersection(words(text.as_py())):
                    seen[w] += 1
        held = [(w, n) for w, n in seen.items() if n]
        yield pa.record_batch({"word": pa.array([w for w, _ in held], pa.binary()), "n": pa.array([n for _, n in held], pa.int64())})

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # as many rows as the templates have words
    n = {bytes(r["word"]): r["n"] for r in found}
    return sorted(wanted, key=lambda w: (n.get(w, 0), w))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, blocks) of every row of docs(doc_id, text).

    ``places``: every place of a phrase (label, start, n), starts in words from 0.
    ``blocks``: every block that joins another template (label, template's number,
    start, n words, shared and all distinct words of the template).

    A null or empty text has no words and empty arrays; ids, null or repeated, go
    through as they are, a row for each row; other columns are never read.  A text
    of any length is scanned whole.  Equal texts have equal results; a template
    that comes twice gives its blocks twice.  A template without words is an
    error; without templates or rows there is nothing to find.
    """
    if any(not words(t.text) for t in templates):
        raise ValueError("a template needs words")
    index = _Index(templates, word_order(docs, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scan(t.as_py(), index, templates) for t in batch["text"]]
            columns = {"n_words": pa.array([f[0] for f in found], pa.int64()), "places": pa.array([f[1] for f in found], pa.list_(_PLACE)), "blocks": pa.array([f[2] for f in found], pa.list_(_BLOCK))}
            yield pa.record_batch({"doc_id": batch["doc_id"]} | columns)

    place, block = "struct<label:string,start:long,n:int>", "struct<label:string,template:int,start:long,n:int,shared:int,of:int>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, places array<{place}>, blocks array<{block}>")


def labelled(scanned: DataFrame) -> DataFrame:
    """The scan's digest: counts, first and last place, labels, and the best containment (1 where a phrase stands)."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own = F.col("places.label"), F.col("blocks.label")
    best = F.array_max(F.transform("blocks", lambda b: b["shared"] / b["of"]))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, own)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """DuckDB SQL of the digest: every block against every template, by brute force."""
    quoted = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    phrases = ", ".join(f"({k}, '{t.label}', {quoted(words(t.text))})" for k, t in enumerate(templates) if t.phrase)
    notices = ", ".join(f"({k}, '{t.label}', {quoted(sorted(set(words(t.text))))}, {max(1, -(-t.percent * len(set(words(t.text))) // 100))}, {block_width(t)})" for k, t in enumerate(templates) if not t.phrase)
    return f"""with w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') as ws from documents),
phrases(k, label, ps) as (values {phrases}), notices(k, label, ts, need, width) as (values {notices}),
t as (select rid, unnest(ws) as word, unnest(range(len(ws))) as p from w),
places as (select t.rid, x.label, t.p from t join phrases x on x.ps[1] = t.word join w on w.rid = t.rid where list_slice(w.ws, t.p + 1, t.p + len(x.ps)) = x.ps),
widths as (select distinct width from notices),
cut as (select w.rid, v.width, list_distinct(list_slice(w.ws, s.b * v.width // 2 + 1, s.b * v.width // 2 + v.width)) as bs
  from w, widths v, lateral (select unnest(range((2 * len(w.ws) + v.width - 1) // v.width)) as b) s),
blocks as (select c.rid, x.label, len(list_intersect(c.bs, x.ts)) / cast(len(x.ts) as double) as share from cut c join notices x on x.width = c.width where len(list_intersect(c.bs, x.ts)) >= x.need),
one as (select rid, count(*) as n, min(p) as lo, max(p) as hi, list(distinct label) as ls from places group by rid),
two as (select rid, max(share) as share, list(distinct label) as ls from blocks group by rid)
select w.doc_id, len(w.ws) as n_words, coalesce(one.n, 0) as n_base, one.lo as first_word, one.hi as last_word,
 coalesce(array_to_string(list_sort(one.ls), ','), '') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(one.ls, []), coalesce(two.ls, [])))), ',') as labels,
 case when one.n > 0 then cast(1 as double) else coalesce(two.share, cast(0 as double)) end as score
from w left join one on one.rid = w.rid left join two on two.rid = w.rid"""
