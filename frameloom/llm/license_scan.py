"""Licence scan with a positional rare-token index, in DataFrame functions only.

Each template is a phrase with a mandatory key phrase inside it. The index posts a template under the two words of its
key phrase that are rarest in the corpus (highest inverse document frequency, counted over all documents), as (template,
offset). A file's words are looked up in it: of all words that the file shares with a template's key phrase, those two
have the highest inverse document frequency in the file too, as it must hold the whole phrase. Each place of a posted
word implies a start, its position less the offset; the starts that both postings of a template imply stay. There the
key phrase must stand word by word, and SHARE of the template's words must stand at their positions. A base template is
its key phrase. The templates are data to the plan, which has the same size for any number of them.

Defined results: a null text is empty; a file without words has no places, empty labels and score 0; overlapping
places all count; equal frequencies go to the earlier word of the phrase; rows with the same doc_id are scanned each
by itself; no rows give no rows.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.storage import text_column

SHARE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # first word of the key phrase, and the word after it
    base: bool = False


def base(label: str, phrase: str) -> Template:
    words = tuple(phrase.split())
    return Template(label, words, (0, len(words)), True)


def notice(label: str, before: str, key: str, after: str = "") -> Template:
    head, middle, tail = (tuple(p.split()) for p in (before, key, after))
    return Template(label, head + middle + tail, (len(head), len(head) + len(middle)))


BASE = (
    base("mit", "under the mit license"),
    base("apache-2", "apache license version 2"),
    base("cc-by-nc", "cc by nc"),
)
NOTICES = (
    notice("gpl-3", "licensed under the", "gnu general public license version 3"),
    notice("gpl-2", "licensed under the", "gnu general public license version 2"),
    notice("lgpl", "licensed under the", "gnu lesser general public license"),
    notice("agpl", "licensed under the", "gnu affero general public license"),
    notice("mpl-2", "subject to the terms of the", "mozilla public license v 2 0"),
    notice("mit", "", "permission is hereby granted free of charge", "to any person obtaining a copy"),
    notice("bsd", "", "redistribution and use in source and binary forms", "with or without modification are permitted"),
    notice("isc", "", "permission to use copy modify and or distribute this software", "for any purpose"),
    notice("cc-by-sa", "", "creative commons attribution sharealike"),
    notice("cc-by-nc", "", "creative commons attribution noncommercial"),
    notice("cc0", "", "cc0 1 0 universal"),
    notice("unlicense", "", "released into the public domain"),
    notice("all-rights-reserved", "", "all rights reserved"),
)
# Whole licence texts, as words.
WHOLE = (
    notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation",
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    notice(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1",
        "the origin of this software must not be misrepresented",
        "you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    ),
)
TEMPLATES = BASE + NOTICES + WHOLE
#: Starts are kept with their template in one number; a text has fewer words than this, and a template too.
STARTS = 1 << 40


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """Documents that have each word of a key phrase; one row for each such word, however many documents."""
    vocabulary = sorted({w for t in templates for w in t.words[slice(*t.key)]})
    found = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_offsets(template: Template, frequency: dict[str, int]) -> list[int]:
    """Positions in the template of its key phrase's two rarest words; of a single word, twice the same."""
    key = range(*template.key)
    return (sorted(key, key=lambda k: (frequency.get(template.words[k], 0), k)) * 2)[:2]


def postings(templates: tuple[Template, ...], frequency: dict[str, int], nth: int) -> dict[str, list[dict]]:
    """The index on the templates' rarest words (``nth`` 0) or second rarest (1): word to templates and offsets."""
    index: dict[str, list[dict]] = {}
    for k, t in enumerate(templates):
        at = rare_offsets(t, frequency)[nth]
        index.setdefault(t.words[at], []).append({"t": k, "at": at})
    return index


def constant(value: object, kind: str) -> Column:
    """A literal of any type; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def implied(words: Column, index: dict[str, list[dict]]) -> Column:
    """Array of template * STARTS + start (and start may be negative) for each place of a posted word."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(sorted(index)))
    found = constant(index, "map<string,array<struct<t:bigint,at:bigint>>>")
    return F.flatten(F.transform(at, lambda i: F.transform(F.element_at(found, F.get(words, i)), lambda p: p["t"] * STARTS + STARTS // 2 + i - p["at"])))


def places(words: Column, templates: tuple[Template, ...], frequency: dict[str, int]) -> Column:
    """Array of (label, start, base, share) of the templates' places in a file of one word or more."""
    table = [{"label": t.label, "words": t.words, "key": t.words[slice(*t.key)], "at": t.key[0], "base": t.base} for t in templates]
    every = constant(table, "array<struct<label:string,words:array<string>,key:array<string>,at:bigint,base:boolean>>")
    both = F.array_intersect(*[implied(words, postings(templates, frequency, nth)) for nth in (0, 1)])

    def found(code: Column) -> Column:
        template, start = F.get(every, F.shiftright(code, 40).cast("int")), code % STARTS - STARTS // 2
        stands = lambda j: F.coalesce(F.get(words, (start + j).cast("int")) == F.get(template["words"], j), F.lit(False))
        n = F.size(template["words"])
        share = F.size(F.filter(F.sequence(F.lit(0), n - 1), stands)) / n
        begin = start + template["at"]
        key = F.when(begin >= 0, F.slice(words, (begin + 1).cast("int"), F.size(template["key"])) == template["key"])
        return F.struct(template["label"].alias("label"), start.alias("start"), template["base"].alias("base"), share.alias("share"), F.coalesce(key, F.lit(False)).alias("key"))

    kept = F.filter(F.transform(both, found), lambda p: p["key"] & (p["share"] >= SHARE))
    return F.transform(kept, lambda p: F.struct(p["label"].alias("label"), p["start"].alias("start"), p["base"].alias("base"), p["share"].alias("share")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places."""
    words = text_column(docs, {"doc_id": "long", "text": "string"}).select("doc_id", words_of(F.col("text")).alias("words"))
    frequency = document_frequencies(words, templates)
    none = F.array().cast("array<struct<label:string,start:bigint,base:boolean,share:double>>")
    every = F.when(F.size("words") > 0, places(F.col("words"), templates, frequency)).otherwise(none)
    found = words.select("doc_id", F.size("words").cast("long").alias("n_words"), every.alias("places"))
    of_base = F.filter("places", lambda p: p["base"])
    starts = F.transform(of_base, lambda p: p["start"])

    def labels(part: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(of_base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        "places",
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for the digest columns of scan() over ``documents``: every start of every template is tried."""
    rows = ", ".join(f"({k}, '{t.label}', {list(t.words)}, {t.key[0]}, {t.key[1]}, {str(t.base).lower()})" for k, t in enumerate(templates))
    return rf"""
WITH t(k, label, tw, ka, kb, base) AS (VALUES {rows}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, t.*, unnest(range(len(ws))) - ka AS start, ws FROM w, t WHERE list_has_all(ws, tw[ka + 1:kb])),
h AS (SELECT doc_id, label, base, start, len([1 FOR j IN range(len(tw)) IF start + j >= 0 AND ws[start + j + 1] = tw[j + 1]]) / len(tw) AS share
      FROM s WHERE ws[start + ka + 1:start + kb] = tw[ka + 1:kb]),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM h WHERE share >= {SHARE} GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM w LEFT JOIN g USING (doc_id)
"""
