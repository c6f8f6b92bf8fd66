"""License scans by sparse TF-IDF cosine, inherited along directories (DataFrame functions only).

Lines are compared with notice templates in the space of their terms. A line
can reach the threshold only if it holds one of the templates' leading terms:
without those, what is left of a template is shorter than the threshold. That
exact test drops almost all lines before any term is counted.

Whole texts are compared with licence texts, and leading comment blocks and
joined neighbouring lines with licence headers, with logarithmic counts. They
must hold one of HINTS. Again a text with too few of a template's terms is
dropped exactly: no passage can score more than the length of the part of the
template whose terms the text has.

Term weights come from the templates alone (a fixed table), so no statistic has
to be gathered first.

Files without a notice of their own inherit that of the nearest ancestor
directory with a licence file, by equi-joins of directories with their prefixes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, filled, stored
from .license_texts import FULL, HEADERS, SPDX

# Short notices as published by the licences' stewards or in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8
TERM = "[a-z0-9]+"
#: A file of no more words, with a notice, is its directory's licence file (in the registered query), and so is a whole licence text.
LICENSE_FILE_WORDS = 60
SALTS = 16
#: Numbers of neighbouring lines that are joined.
SPANS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 18, 22, 27, 33)
#: Characters of a passage, white space and marks counted as one; the longest header has 1500, and twice as much foreign text is far below the threshold.
PASSAGE = 5000
#: A copyright statement with its year, which no template holds.
COPYRIGHT = r"(?:copyright|\(c\)|©)(?=[^\n]{0,60}(?:19|20)[0-9]{2})(?:(?!permission|redistrib|licen|all rights)[^\n.]){0,80}\.?"
#: Lines with comment marks and blank lines at the start.
MARKED = r"\A((?:[ \t]*(?:#|//|--|;|%|\*|rem\b|dnl\b)[^\n]*(?:\n|\z)|[ \t\r]*\n)*+)"
#: A block comment at the start, after a first line of "#!" or "<?".
ENCLOSED = r"\A(?:(?:#!|<\?)[^\n]*\n)?\s*(?:/\*|<!--|\"\"\"|\(\*|\{-)((?s:.*?))(?:\*/|-->|\"\"\"|\*\)|-\})"
#: What a licence text or header holds one of, as all templates do: texts without are not looked at.
HINTS = ("licen", "copyright", "warrant")
IDENTIFIER = r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)"


def idf(templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """Weight of each term, and of terms that no template has."""
    terms = [set(re.findall(TERM, t.lower())) for t in templates.values()]
    weight = lambda df: math.log((1 + len(terms)) / (1 + df)) + 1
    return {t: weight(sum(t in s for s in terms)) for t in sorted(set().union(*terms))}, weight(0)


def vectors(templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """Unit TF-IDF vectors."""
    weights, _ = idf(templates)
    out = {}
    for name, text in templates.items():
        found = re.findall(TERM, text.lower())
        raw = {t: found.count(t) * weights[t] for t in sorted(set(found))}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out[name] = {t: v / norm for t, v in raw.items()}
    return out


def leading(templates: dict[str, str], threshold: float) -> list[str]:
    """Terms without which no line reaches the threshold: the rest of each template is too short."""
    chosen: set[str] = set()
    for vector in vectors(templates).values():
        # longest terms first: they are rarest in running text
        order = sorted(vector, key=lambda t: (-len(t), t))
        rest = sum(v * v for t, v in vector.items() if t not in chosen)
        for term in order:
            if rest < threshold * threshold - 1e-9:
                break
            if term not in chosen:
                chosen.add(term)
                rest -= vector[term] ** 2
    return sorted(chosen)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Space:
    """Templates as unit vectors of weighted logarithmic term counts, and the cosines of passages with them."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.names, self.threshold = [name for name, _ in templates], threshold
        counts = [re.findall(TERM, re.sub(COPYRIGHT, " ", text.lower())) for _, text in templates]
        weights, self.outside = idf({str(i): " ".join(terms) for i, terms in enumerate(counts)})
        self.unit = []
        for terms in counts:
            raw = {t: (1 + math.log(terms.count(t))) * weights[t] for t in sorted(set(terms))}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.unit.append({t: v / norm for t, v in raw.items()})
        # by term: its weight, then its share in each template; a literal that is folded once
        table = {t: [w, *(u.get(t, 0) for u in self.unit)] for t, w in weights.items()}
        self.table = F.from_json(F.lit(json.dumps(table)), "map<string,array<double>>")
        self.zeros = F.array(*[F.lit(0.0)] * (len(self.names) + 1))

    def _sum(self, entries: Column, scaled: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(entries, self.zeros, lambda acc, x: F.zip_with(acc, x["entry"], lambda a, s: a + scaled(x, s)))

    def possible(self, low: Column) -> Column:
        """Whether the text has enough of a template's terms for any of its passages to reach the threshold."""
        entries = F.transform(F.array_intersect(found(low), F.map_keys(self.table)), lambda t: F.struct(F.try_element_at(self.table, t).alias("entry")))
        mass = self._sum(entries, lambda x, s: s * s)
        return F.array_max(F.slice(mass, 2, len(self.names))) >= self.threshold**2 - 1e-9

    def known(self, terms: Column) -> Column:
        """Terms with their weight in the templates, if they have one."""
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.try_element_at(self.table, t)[0].alias("weight")))

    def reachable(self, known: Column) -> Column:
        """Whether a passage of these terms can reach the threshold.

        The part of its vector in the templates' terms must outweigh the rest. A
        term that stands c times weighs (1 + ln c) ** 2 <= 4 c / e times its
        weight's square, and one that no template has its weight's square at least.
        """
        inside = F.aggregate(known, F.lit(0.0), lambda a, x: a + F.coalesce(x["weight"] * x["weight"], F.lit(0.0)))
        strange = F.size(F.array_distinct(F.transform(F.filter(known, lambda x: x["weight"].isNull()), lambda x: x["term"])))
        return strange * self.outside**2 <= inside * (4 / math.e * (1 / self.threshold**2 - 1)) + 1e-9

    def best(self, terms: Column) -> Column:
        """``(minus, license)`` of a passage's terms: the least of the negative cosines, then of the names."""

        def counted(terms: Column) -> Column:
            count = lambda t: F.size(terms) - F.size(F.array_remove(terms, t))
            return F.transform(F.array_distinct(terms), lambda t: F.struct((1 + F.log(count(t))).alias("count"), F.try_element_at(self.table, t).alias("entry")))

        def scored(terms: Column) -> Column:
            weight = lambda x: x["count"] * F.coalesce(x["entry"][0], F.lit(self.outside))
            norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + weight(x) * weight(x)))
            return bound(norm, lambda n: bound(self._sum(F.filter(terms, lambda x: x["entry"].isNotNull()), lambda x, s: s * weight(x)), lambda dots: self._least(dots, n)))

        return bound(terms, lambda terms: bound(counted(terms), scored))

    def _least(self, dots: Column, norm: Column) -> Column:
        minus = lambda d: -F.coalesce(F.round(F.try_divide(d, norm), 6), F.lit(0.0))
        names = F.array(*[F.lit(n) for n in self.names])
        return F.array_min(F.zip_with(F.slice(dots, 2, len(self.names)), names, lambda d, n: F.struct(minus(d).alias("minus"), n.alias("license"))))


def found(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"({TERM})"), F.lit(1))


def hinted(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(h) for h in HINTS])


def passages(low: Column, space: Space) -> Column:
    """Terms of the leading comment block, and of all runs of SPANS neighbouring lines.

    Of these, passages that have a hint, have at most PASSAGE characters and can reach the threshold.
    """
    plain = lambda t: F.regexp_replace(t, "[^a-z0-9\n]+", " ")
    terms = lambda known: F.transform(known, lambda x: x["term"])
    blocks = F.array(plain(F.regexp_extract(low, MARKED, 1)), plain(F.regexp_extract(low, ENCLOSED, 1)))
    blocks = F.transform(F.filter(blocks, lambda t: (F.length(t) <= PASSAGE) & hinted(t)), found)

    # each line's terms are looked up once, and only runs around lines with a hint are made
    line = lambda t: F.struct(space.known(found(t)).alias("known"), F.length(t).alias("size"), hinted(t).alias("hint"))

    def runs(lines: Column) -> Column:
        n, hints = F.size(lines), F.filter(F.transform(lines, lambda x, i: F.when(x["hint"], i + 1)), lambda i: i.isNotNull())
        starts = lambda k: F.array_distinct(F.flatten(F.transform(hints, lambda i: F.sequence(F.greatest(F.lit(1), i - (k - 1)), F.least(i, n - (k - 1))))))
        fits = lambda run, k: F.aggregate(run, F.lit(k - 1), lambda a, x: a + x["size"]) <= PASSAGE
        known = lambda k: F.transform(F.filter(F.transform(starts(k), lambda i: F.slice(lines, i, F.lit(k))), lambda run: fits(run, k)), lambda run: F.flatten(F.transform(run, lambda x: x["known"])))
        none = F.array().cast("array<array<string>>")
        return F.flatten(F.array(*[F.when(n >= k, F.transform(F.filter(known(k), space.reachable), terms)).otherwise(none) for k in SPANS]))

    return F.concat(blocks, bound(F.transform(F.split(plain(low), "\n", -1), line), runs))


def licensed(low: Column, full: Space, headers: Space) -> Column:
    """``(minus, license, whole)`` of a lower-case text: a whole licence text, else the best header or SPDX identifier."""
    of = lambda best, whole: F.struct(best["minus"].alias("minus"), best["license"].alias("license"), F.lit(whole).alias("whole"))
    clean = F.regexp_replace(low, COPYRIGHT, " ")
    text = F.when(hinted(low) & full.possible(low), bound(full.best(found(clean)), lambda b: F.when(-b["minus"] >= full.threshold, of(b, True))))
    header = F.when(hinted(low) & headers.possible(low), bound(F.array_min(F.transform(passages(clean, headers), headers.best)), lambda b: F.when(-b["minus"] >= headers.threshold, of(b, False))))
    known = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    names = F.filter(F.transform(F.regexp_extract_all(low, F.lit(IDENTIFIER), F.lit(1)), lambda i: F.try_element_at(known, i)), lambda n: n.isNotNull())
    named = F.when(low.contains("spdx-license-identifier"), bound(F.array_min(names), lambda n: F.when(n.isNotNull(), F.struct(F.lit(-1.0).alias("minus"), n.alias("license"), F.lit(False).alias("whole")))))
    return F.coalesce(text, F.array_min(F.array_compact(F.array(header, named))))


def scan(files: DataFrame, path_column: str = "path", text_column: str = "text", license_file_column: str | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, keep_text: bool = True, texts_are_files: bool = False) -> DataFrame:
    """``files`` plus ``license, how`` (own, inherited, none), ``score`` and ``from_dir``.

    A file's own licence is that of the whole licence text it holds, else the one
    with the best cosine over its lines, joined neighbouring lines and leading
    comment block, at least ``threshold``; ties go to the first name, and a known
    SPDX identifier scores 1. Copyright statements don't count but in lines.
    With ``templates``, lines alone are compared, with these.
    A directory's licence is that of its files for which ``license_file_column``
    is true (default: base name LICENSE, LICENCE or COPYING; with
    ``texts_are_files`` also whole licence texts), the best score first, then the
    first path.
    Null paths have no directory and inherit nothing; null and empty texts have
    no notice. Result columns replace columns of the same names; rows with
    equal paths are treated alike, and repeated rows stay repeated. Texts of any
    length are scored whole (passages as PASSAGE says); an empty table gives no
    rows. Without
    ``keep_text`` the text is left out, and notices are written to the shared
    folder first, so that texts are read once.
    """
    more = not templates
    templates = templates or TEMPLATES
    weights, outside = idf(templates)
    text, path = filled(text_column), F.col(path_column).cast("string")
    cues = leading(templates, threshold)
    lines = F.split(F.lower(text), "\n", -1)
    cue = rf"(?<![a-z0-9])(?:{'|'.join(cues)})(?![a-z0-9])"
    # a text has a leading term if and only if one of its lines has: most texts end at this test
    holds = reduce(lambda a, b: a | b, [F.lower(text).contains(c) for c in cues])
    some = F.filter(lines, lambda line: line.rlike(cue))
    tests = F.transform(some, lambda line: F.regexp_extract_all(line, F.lit(f"({TERM})"), F.lit(1)))

    # each step has its own lambda, so that the expression grows with the number of steps only
    numbers = lambda pairs: "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in pairs.items()) + ")"
    weight_of = F.expr(numbers(weights))
    unit = F.expr("array(" + ", ".join(f"struct('{name}' AS license, {numbers(v)} AS shares)" for name, v in vectors(templates).items()) + ")")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def weighted(terms: Column) -> Column:
        weight = lambda t: F.size(F.filter(terms, lambda x: x == t)) * F.coalesce(F.try_element_at(weight_of, t), F.lit(outside))
        return F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), weight(t).alias("weight")))

    def products(line: Column) -> Column:
        dot = lambda u: total(F.transform(line, lambda x: x["weight"] * F.coalesce(F.try_element_at(u["shares"], x["term"]), F.lit(0.0))))
        norm = F.sqrt(total(F.transform(line, lambda x: x["weight"] * x["weight"])))
        return F.struct(norm.alias("norm"), F.transform(unit, lambda u: F.struct(u["license"].alias("license"), dot(u).alias("dot"))).alias("dots"))

    def best(line: Column) -> Column:
        # largest score, first name: smallest of (-score, name)
        minus = lambda d: -F.coalesce(F.round(F.try_divide(d["dot"], line["norm"]), 6), F.lit(0.0))
        return F.array_min(F.transform(line["dots"], lambda d: F.struct(minus(d).alias("minus"), d["license"].alias("license"), F.lit(False).alias("whole"))))

    own = F.array_min(F.transform(F.transform(F.transform(tests, weighted), products), best))
    wider = F.lit(None).cast("struct<minus:double,license:string,whole:boolean>")
    if more:
        wider = licensed(F.lower(text), Space([*FULL.items()], threshold), Space([(name, t) for name, several in HEADERS.items() for t in several], threshold))
    result = ("license", "how", "score", "from_dir")
    kept = [c for c in files.columns if c not in result and (keep_text or c != text_column)]
    is_file = F.col(license_file_column).cast("boolean") if license_file_column else F.regexp_extract(path, "([^/]*)$", 1).rlike("^(LICENSE|LICENCE|COPYING)(\\.|$)")
    directory = F.when(path.isNotNull(), F.regexp_replace(path, "/?[^/]*$", ""))
    noticed = files.select(
        *[F.col(c) for c in kept], path.alias("__path"), directory.alias("__dir"), F.coalesce(is_file, F.lit(False)).alias("__file"), F.when(holds & F.lower(text).rlike(cue), own).alias("__own"), wider.alias("__wider")
    ).withColumn("__own", F.when(-F.col("__own.minus") >= threshold, F.col("__own")))
    noticed = noticed.withColumn("__own", F.when(F.col("__wider.whole"), F.col("__wider")).otherwise(F.array_min(F.array_compact(F.array("__own", "__wider"))))).drop("__wider")
    if texts_are_files:
        noticed = noticed.withColumn("__file", F.col("__file") | F.coalesce("__own.whole", F.lit(False)))
    if not keep_text:
        noticed = stored(noticed, "notices")

    licences = (
        noticed.filter("__file AND __own IS NOT NULL AND __dir IS NOT NULL")
        .groupBy(F.col("__dir").alias("__from"))
        .agg(F.min(F.struct(F.col("__own.minus").alias("minus"), F.col("__path"), F.col("__own.license").alias("license"))).alias("__held"))
    )
    # every directory with each of its ancestors, the root being ''
    parts = F.split("__dir", "/", -1)
    ancestors = (
        noticed.filter("__dir IS NOT NULL AND __own IS NULL")
        .select("__dir")
        .distinct()
        .withColumn("__depth", F.explode(F.sequence(F.lit(0), F.size(parts))))
        .withColumn("__from", F.array_join(F.slice(parts, F.lit(1), F.col("__depth")), "/"))
    )
    # one ancestor may be that of most directories, and one directory may hold most files: both are salted
    salted = lambda df: df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    inherited = (
        ancestors.withColumn("__salt", salt("__dir"))
        .join(salted(licences), ["__from", "__salt"])
        .groupBy("__dir")
        .agg(F.max(F.struct("__depth", "__from", "__held")).alias("__near"))
    )
    return noticed.withColumn("__salt", salt("__path")).join(salted(inherited), ["__dir", "__salt"], "left").select(
        *kept,
        F.coalesce("__own.license", "__near.__held.license").alias("license"),
        F.when(F.col("__own").isNotNull(), "own").when(F.col("__near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(F.col("__own").isNotNull(), -F.col("__own.minus")).otherwise(-F.col("__near.__held.minus")).alias("score"),
        F.when(F.col("__own").isNull(), F.col("__near.__from")).alias("from_dir"),
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents under ``source/lang/group``, short ones counting as licence files if they hold a notice."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    group = F.concat(F.lit("g"), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none")))
    words = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), group, part("doc_id")).alias("path"), "text", (words <= LICENSE_FILE_WORDS).alias("is_license_file"))


def oracle() -> str:
    """The same over ``documents``, by joins of exploded terms."""
    weights, outside = idf(TEMPLATES)
    rows = ", ".join(f"('{name}', '{t}', {v!r}::DOUBLE)" for name, vector in vectors(TEMPLATES).items() for t, v in vector.items())
    idfs = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in weights.items())
    return f"""
WITH unit(license, term, share) AS (VALUES {rows}), idf(term, weight) AS (VALUES {idfs}),
f AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/g' || coalesce(floor(doc_id / 100)::BIGINT::VARCHAR, 'none') AS dir,
  coalesce(doc_id::VARCHAR, 'none') AS base, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) <= {LICENSE_FILE_WORDS} AS is_file FROM documents),
l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) AS place FROM f),
t AS (SELECT doc_id, place, unnest(regexp_extract_all(line, '{TERM}')) AS term FROM l),
c AS (SELECT doc_id, place, t.term, count(*) * coalesce(any_value(weight), {outside!r}::DOUBLE) AS w FROM t LEFT JOIN idf ON t.term = idf.term GROUP BY ALL),
n AS (SELECT doc_id, place, sqrt(sum(w * w)) AS norm FROM c GROUP BY ALL),
s AS (SELECT c.doc_id, c.place, license, round(sum(w * share) / any_value(norm), 6) AS score FROM c JOIN unit ON c.term = unit.term JOIN n ON n.doc_id = c.doc_id AND n.place = c.place GROUP BY ALL),
o AS (SELECT doc_id, min({{'minus': -score, 'license': license}}) AS own FROM s WHERE score >= {THRESHOLD} GROUP BY doc_id),
h AS (SELECT dir, min({{'minus': own.minus, 'path': dir || '/' || base, 'license': own.license}}) AS held FROM f JOIN o USING (doc_id) WHERE is_file GROUP BY dir),
d AS (SELECT DISTINCT dir FROM f),
a AS (SELECT dir, unnest(range(0, 4)) AS depth FROM d),
p AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS up FROM a),
i AS (SELECT p.dir, max({{'depth': depth, 'up': up, 'held': held}}) AS near FROM p JOIN h ON h.dir = p.up GROUP BY p.dir)
SELECT f.doc_id, f.dir || '/' || f.base AS path, coalesce(own.license, near.held.license) AS license,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own IS NOT NULL THEN -own.minus ELSE -near.held.minus END AS score,
  CASE WHEN own IS NULL THEN near.up END AS from_dir
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN i USING (dir)
"""


ORACLE = oracle()
