"""Licence scan by sentence rules: known sentences become identifiers, ordered identifier runs become licences.

A text is split into parts, each is normalised (lower case, runs of other characters than a-z and 0-9 become one
space), and runs of parts that join to the words of a known licence sentence become its identifier. What is not
known drops out only where it has no letter or digit or is a bare list number; an unknown part stays as a gap, so
that a rule matches consecutive sentences only.
A rule matches where its identifiers occur in order without a gap. Of matched rules, those whose run is part
of a longer matched rule's run are left out.

All of it is one projection: no shuffle and no Python. Texts without any of the anchor words, one of which
every known sentence holds, skip the lookup; that changes no result.

Defined results: a null or empty text has no licence; repeated rows each get a row; an empty table gives no rows; a very
long text is split once and takes time in proportion; further columns are kept, but those of scan()'s own names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import fresh_name

#: Known licence sentences, normalised, as identifier and sentence: fixed values from the public licence texts.
SENTENCES = (
    ("mit-short", "released under the mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2-short", "licensed under the apache license version 2 0"),
    ("apache2-head", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl3-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc4", "licensed under cc by nc 4 0"),
    ("cc-by4", "licensed under cc by 4 0"),
    ("cc-by-sa4", "licensed under cc by sa 4 0"),
    ("cc0", "licensed under cc0 1 0"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Licence rules, as identifier, licence, class and the ordered sentence identifiers: fixed values.
RULES = (
    ("mit.notice", "MIT", "permissive", ("mit-short",)),
    ("mit.text", "MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty")),
    ("mit.titled", "MIT", "permissive", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("apache2.notice", "Apache-2.0", "permissive", ("apache2-short",)),
    ("apache2.header", "Apache-2.0", "permissive", ("apache2-head", "apache2-copy", "apache2-basis", "apache2-see")),
    ("apache2.head", "Apache-2.0", "permissive", ("apache2-head",)),
    ("gpl3.notice", "GPL-3.0", "copyleft", ("gpl3-short",)),
    ("gpl3.header", "GPL-3.0-or-later", "copyleft", ("gpl-grant", "gpl-warranty", "gpl-see")),
    ("gpl3.grant", "GPL-3.0-or-later", "copyleft", ("gpl-grant",)),
    ("bsd2.text", "BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd3.text", "BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ccbync4.notice", "CC-BY-NC-4.0", "noncommercial", ("cc-by-nc4",)),
    ("ccby4.notice", "CC-BY-4.0", "permissive", ("cc-by4",)),
    ("ccbysa4.notice", "CC-BY-SA-4.0", "copyleft", ("cc-by-sa4",)),
    ("cc0.notice", "CC0-1.0", "public domain", ("cc0",)),
    ("mpl2.notice", "MPL-2.0", "copyleft", ("mpl2",)),
)
#: Every known sentence holds one of these words.
ANCHORS = ("licen", "redistribut", "copyright", "permission", "warrant", "endorse")
#: Known sentences of at most so many words count only where they are whole sentences of a text.
NOTICE_WORDS = 12
#: Ends of sentences: a stop before white space or the end, or the end of a line unless it goes on in lower case.
BOUNDARY = r"[.!?:;]+(?=\s|$)|\n\s*\n|\n(?=\s*[A-Z0-9*#-])"


def _norm(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def _let(value: Column, then) -> Column:
    """then(value) with value evaluated once: a lambda's variable is bound, where a column's expression would be repeated."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _found(sentence: str) -> str:
    """A pattern of the sentence's words after a list number, if there is one, whatever ends are among them.

    A notice is bounded by ends; a longer official sentence may follow a title or a copyright line on the same line.
    """
    words = sentence.split(" ")
    edge = r"[| ]" if len(words) > NOTICE_WORDS else r"\|"
    return rf"(?:(?<=\|)(?:[0-9]{{1,2}}|[a-z])[| ]|(?<={edge})){'[| ]'.join(words)}(?={edge})"


def identifiers(text: Column, sentences: tuple[tuple[str, str], ...] = SENTENCES) -> Column:
    """The text's sentence identifiers in order, like ' mit-grant mit-notice ', with '-' for each unknown sentence.

    Official texts are cut by BOUNDARY inside their sentences as well (at '(the "License");' or where a wrapped line
    goes on in capitals), elsewhere in each copy. So a known sentence is any run of parts that joins to its words.
    """
    longest_first = sorted(sentences, key=lambda x: -len(x[1]))
    known = F.array(*[F.struct(F.lit(s).alias("sentence"), F.lit(_found(s)).alias("pattern"), F.lit(f"|={i}|").alias("id")) for i, s in longest_first])

    def mark(parts: Column) -> Column:
        ended = F.concat(F.lit("|"), F.array_join(parts, "|"), F.lit("|"))
        return _let(F.array_join(parts, " "), lambda flat: F.aggregate(F.filter(known, lambda k: flat.contains(k["sentence"])), ended, lambda acc, k: F.regexp_replace(acc, k["pattern"], k["id"])))

    marked = _let(F.filter(F.transform(F.split(text, BOUNDARY), _norm), lambda s: s != ""), mark)
    # a bare list number is no sentence; known sentences that were found begin with '='
    parts = F.filter(F.transform(F.split(marked, r"\|"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike("^[0-9]{1,2}$"))
    ids = F.transform(parts, lambda s: F.when(s.startswith("="), F.substring(s, 2, 1000)).otherwise("-"))
    return F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))


def scan(docs: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """docs' columns and sentence_ids, matched (array of rule, licence, kind, run), n_matches and licences (comma-joined, sorted).

    Columns of those names in docs are replaced.
    """
    anchors = [*ANCHORS, *(s.split(" ")[0] for _, s in sentences if not any(a in s for a in ANCHORS))]
    all_rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(lic).alias("licence"), F.lit(c).alias("kind"), F.lit(f" {' '.join(ids)} ").alias("run")) for i, lic, c, ids in rules])

    def longest(found: Column) -> Column:
        return F.filter(found, lambda r: ~F.exists(found, lambda q: q["run"].contains(r["run"]) & (q["run"] != r["run"])))

    def recognise(ids: Column) -> Column:
        return _let(F.filter(all_rules, lambda r: ids.contains(r["run"])), lambda found: F.struct(ids.alias("ids"), longest(found).alias("matched")))

    # lower() maps A-Z as the lookup does, and only adds letters beyond ASCII, so no known sentence is missed
    possible = _let(F.lower(F.col(text)), lambda low: reduce(or_, [low.contains(a) for a in anchors]))
    keep = [c for c in docs.columns if c.lower() not in ("sentence_ids", "matched", "n_matches", "licences")]
    found = fresh_name("found", docs.columns)
    out = docs.select(*keep, F.when(possible, _let(identifiers(F.col(text), sentences), recognise)).alias(found))
    nothing = F.filter(all_rules, lambda r: F.lit(False))
    out = out.select(*keep, F.coalesce(F.col(found)["ids"], F.lit(" ")).alias("sentence_ids"), F.coalesce(F.col(found)["matched"], nothing).alias("matched"))
    return out.withColumns({"n_matches": F.size("matched").cast("long"), "licences": F.array_join(F.array_sort(F.array_distinct(F.transform("matched", lambda r: r["licence"]))), ",")})


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    return found.select("doc_id", "n_matches", "licences", F.array_join(F.array_sort(F.transform("matched", lambda r: r["rule"])), ",").alias("rules"), F.array_join(F.array_sort(F.array_distinct(F.transform("matched", lambda r: r["kind"]))), ",").alias("kinds"))


def op7_sql() -> str:
    sentences = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
    rules = ", ".join(f"('{i}', '{lic}', '{c}', ' {' '.join(ids)} ')" for i, lic, c, ids in RULES)
    return rf"""
with known(id, sentence) as (values {sentences}), rules(rule, licence, kind, run) as (values {rules}),
rows as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, coalesce(text, '') as text from documents),
possible as (select rid, text from rows where regexp_matches(low, '{"|".join(ANCHORS)}')),
lines as (select rid, pos, regexp_replace(line, '([.!?:;]+)(\s|$)', chr(1) || '\2', 'g') as line from (select rid, generate_subscripts(a, 1) as pos, unnest(a) as line from (select rid, string_split(regexp_replace(text, '\n(\s*\n|\s*[A-Z0-9*#-])', chr(1) || '\1', 'g'), chr(1)) as a from possible))),
parts as (select rid, pos, generate_subscripts(a, 1) as sub, trim(regexp_replace(translate(unnest(a), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) as s from (select rid, pos, string_split(line, chr(1)) as a from lines)),
ids as (select p.rid, ' ' || string_agg(coalesce(k.id, '-'), ' ' order by p.pos, p.sub) || ' ' as seq from parts p left join known k on k.sentence = p.s where p.s <> '' group by p.rid),
m as (select ids.rid, r.rule, r.licence, r.kind, r.run from ids join rules r on contains(ids.seq, r.run)),
best as (select * from m where not exists (select 1 from m q where q.rid = m.rid and contains(q.run, m.run) and q.run <> m.run)),
g as (select rid, count(*) as n, string_agg(distinct licence, ',' order by licence) as licences, string_agg(rule, ',' order by rule) as rules, string_agg(distinct kind, ',' order by kind) as kinds from best group by rid)
select rows.doc_id, coalesce(g.n, 0) as n_matches, coalesce(licences, '') as licences, coalesce(g.rules, '') as rules, coalesce(g.kinds, '') as kinds from rows left join g on g.rid = rows.rid
"""
