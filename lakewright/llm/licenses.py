"""Licence scans by Dice's coefficient over word bigrams.

A text and its lines and paragraphs are normalised (lower-case a-z and 0-9 words) and compared with licence templates, which are
usual notices and whole licence texts, by 2 |A n B| / (|A| + |B|), A and B being the sets of word bigrams. A unit can only reach
the threshold t with a template of size b if its own size is from b t / (2 - t) to b (2 - t) / t: other templates are pruned by
size, before any set is made where the word count shows it.

A template that no unit matches is sought in windows: runs of the whole text's words, over lines and paragraphs, with at most
(2 - t) / t times as many bigrams as the template has; the best window counts. So notices inside longer lines or over wrapped
lines are found, while a unit that matches keeps its own coefficient unless a window equals the template. All of it is expressions on a row: no shuffle, no Python.

Null text, empty text and text without a match get null licence and dice 0. Ties go to the first licence by id. A unit of
one word has no bigram and matches nothing. Repeated rows get equal results; texts are scanned whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """Usual notices of a GNU licence."""
    grant = _GNU.format(name, version)
    only = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."
    return (f"This work is licensed under the GNU {name}, version {version}.", grant, grant + _WARRANTY.format(name), only, f"Licensed under the GNU {name} v{version}.", f"Released under the GNU {name}, version {version}.")


def _short(name: str) -> tuple[str, ...]:
    """Usual one-line notices of a licence."""
    return (f"Released under the {name}.", f"Licensed under the {name}.", f"Distributed under the {name}.", f"Available under the terms of the {name}.", f"Use of this source code is governed by the {name}.")


def _cc(name: str, code: str) -> tuple[str, ...]:
    """Usual notices of a Creative Commons licence."""
    return (f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Licensed under CC {code} 4.0.", f"Licensed under the Creative Commons {name} 4.0 International License.")


#: Notices of public licences, by SPDX identifier.
NOTICES = {
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        *_short("Apache License 2.0"),
    ),
    "BSD-2-Clause": _short("BSD 2-Clause License"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", *_short("BSD 3-Clause License")),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", *_short("Boost Software License 1.0")),
    "CC-BY-4.0": _cc("Attribution", "BY"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", *_cc("Attribution-NonCommercial", "BY-NC")),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "BY-SA"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    # "Released under the ISC License." is found by these; as a template of four bigrams it would near match "released under the" of any licence
    "ISC": _short("ISC License")[1:],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", *_short("MIT License")),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        *_short("Mozilla Public License 2.0"),
    ),
}
#: Whole licence texts, by SPDX identifier; also parts of those of which a document often holds one paragraph.
TEXTS = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
PARTS = {"MIT": (TEXTS["MIT"].split("\n\n")[0],)}
TEMPLATES = {k: tuple(dict.fromkeys((*NOTICES.get(k, ()), *PARTS.get(k, ()), *((TEXTS[k],) if k in TEXTS else ())))) for k in sorted({*NOTICES, *TEXTS})}
#: Words that much prose has: poor anchors, taken where other words cover little. What matches doesn't depend on them.
COMMON = frozenset(
    "about above after against available below cause certain change choose complete different either event except express following general given holder however include included including information interface international"
    " itself large later least making means necessary number object offer option original other otherwise particular parties party person place product program provided public published purpose reasonable received required"
    " rights section shall should special standard subject system their these those through title under unless users using version where whether which whole within without works".split()
)
#: Least Dice coefficient of a match.
THRESHOLD = 0.8


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))


def bigrams(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates(given: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(licence, bigrams) of each variant, in order of licence."""
    return [(k, bigrams(t)) for k in sorted(given) for t in given[k] if bigrams(t)]


def spans(given: dict[str, tuple[str, ...]]) -> list[int]:
    """Bigrams of each variant with repeats, in the order of ``templates``."""
    return [len(_words(t)) - 1 for k in sorted(given) for t in given[k] if bigrams(t)]


def anchors(known: list[tuple[str, list[str]]], t: float) -> tuple[list[str], list[str]]:
    """(words, bigrams) of which any unit that matches some template holds at least one.

    A match at ``t`` holds t / (2 - t) of a template's bigrams or more, so one at least of any set that is larger than the rest. Words
    of five letters or more that cover most such sets come first; what they leave open takes its longest bigrams.
    """
    words, pairs, open_ = [], [], [(int(len(b) * (1 - t / (2 - t)) + 1e-9) + 1, set(b)) for _, b in known]
    long = sorted({w for _, b in known for x in b for w in x.split() if len(w) > 4})
    while open_:
        gain: Counter = Counter()
        for need, b in open_:
            gain.update({w: min(need, n) for w, n in Counter(w for x in b for w in set(x.split())).items()})
        word = max(long, key=lambda w: (gain[w] / (20 if w in COMMON else 1), len(w)), default=None)
        if word is not None and gain[word]:
            words.append(word)
            split = [(b, {x for x in b if word in x.split()}) for _, b in open_]
        else:
            pairs.append(max(sorted(open_[0][1]), key=len))
            split = [(b, b & {pairs[-1]}) for _, b in open_]
        open_ = [(need - len(met), b - met) for (need, _), (b, met) in zip(open_, split, strict=True) if need > len(met)]
    return sorted(words), sorted(pairs)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: a one-element array binds it to a name."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pairs(w: Column) -> Column:
    """Word bigrams by position."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


_HITS = "array<struct<dice:double,license:string,k:int>>"


def _table(known: list[tuple[str, list[str]]], lengths: list[int], t: float) -> Column:
    """The templates as one literal: number, licence, size, least common bigrams, most bigrams of a window, bigrams."""
    least = lambda n: int(n * t / (2 - t) - 1e-9) + 1
    rows = [{"k": i, "license": k, "n": len(b), "need": least(len(b)), "most": int(lengths[i] * (2 - t) / t + 1e-9), "b": b} for i, (k, b) in enumerate(known)]
    # text that the optimizer folds to one value: as an expression for each string the plan would take minutes
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,license:string,n:int,need:int,most:int,b:array<string>>>")


def _hits(words: Column, known: list[tuple[str, list[str]]], table: Column, t: float) -> Column:
    """Matches of one unit's words: array of (dice, licence, template), pruned by size."""
    low, top = min(len(b) for _, b in known) * t / (2 - t), max(len(b) for _, b in known) * (2 - t) / t

    def against(a: Column) -> Column:
        n = F.size(a)
        sized = F.filter(table, lambda x: (n >= x["n"] * F.lit(t / (2 - t))) & (n <= x["n"] * F.lit((2 - t) / t)))
        scored = F.transform(sized, lambda x: F.struct((F.lit(2.0) * F.size(F.array_intersect(a, x["b"])) / (n + x["n"])).alias("dice"), x["license"].alias("license"), x["k"].alias("k")))
        return F.filter(scored, lambda x: x["dice"] >= F.lit(t))

    made = _bound(F.array_distinct(_pairs(words)), against)
    # a set is no smaller than that of its unit's beginning: one that is too large there is pruned before it is made
    fits = (F.size(words) - 1 <= top) | (F.size(F.array_distinct(_pairs(F.slice(words, 1, 4 * int(top) + 2)))) <= top)
    return F.when((F.size(words) - 1 >= low) & fits, made).otherwise(F.array().cast(_HITS))


def _best_window(at: Column, x: Column) -> Column:
    """Highest Dice of any window of ``at``, the text's (bigram, last position before), with the template ``x``.

    The best window begins and ends with bigrams of the template, as others only enlarge its set. From each beginning that has enough of them
    within reach the window grows by one bigram at a time, and one that is new in it is one whose last position lies before the beginning.
    """

    def grown(marks: Column, start: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            new = e["last"] < start
            both, size = s["both"] + (new & e["hit"]).cast("int"), s["size"] + new.cast("int")
            dice = F.when(e["hit"], F.greatest(s["best"], F.lit(2.0) * both / (size + x["n"]))).otherwise(s["best"])
            return F.struct(both.alias("both"), size.alias("size"), dice.alias("best"))

        none = F.struct(F.lit(0).alias("both"), F.lit(0).alias("size"), F.lit(0.0).alias("best"))
        return F.aggregate(F.slice(marks, start + 1, x["most"]), none, step, lambda s: s["best"])

    def of_marks(marks: Column) -> Column:
        held = F.filter(F.transform(marks, lambda e, i: F.when(e["hit"], i)), lambda i: i.isNotNull())
        # the template's least number of common bigrams must lie within one window
        near = lambda p: F.filter(p, lambda i, j: F.coalesce(F.get(p, j + x["need"] - 1) - i < x["most"], F.lit(False)))
        return _bound(held, lambda p: F.array_max(F.transform(near(p), lambda start: grown(marks, start))))

    return _bound(F.transform(at, lambda e: F.struct(F.array_contains(x["b"], e["g"]).alias("hit"), e["last"].alias("last"))), of_marks)


def _window_hits(words: Column, found: Column, table: Column, vocabulary: Column, t: float) -> Column:
    """Matches of the text's windows with templates of which no unit is in ``found``, and windows that equal their template."""

    def of_pairs(p: Column) -> Column:
        rows = F.sort_array(F.transform(p, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        # equal bigrams are neighbours once sorted, so each finds the one before it there
        linked = lambda r: F.transform(r, lambda e, j: F.struct(e["i"].alias("i"), e["g"].alias("g"), F.when((j > 0) & (F.get(r, j - 1)["g"] == e["g"]), F.get(r, j - 1)["i"]).otherwise(F.lit(-1)).alias("last")))

        def of_common(common: Column) -> Column:
            left = F.filter(table, lambda x: ~F.exists(found, lambda h: (h["k"] == x["k"]) & (h["dice"] == 1)) & (F.size(common) >= x["need"]) & (F.size(F.array_intersect(common, x["b"])) >= x["need"]))

            def of_left(some: Column) -> Column:
                scored = lambda at: F.transform(some, lambda x: F.struct(F.coalesce(_best_window(at, x), F.lit(0.0)).alias("dice"), x["license"].alias("license"), x["k"].alias("k")))
                return F.when(F.size(some) > 0, _bound(F.sort_array(_bound(rows, linked)), scored)).otherwise(F.array().cast(_HITS))

            return _bound(left, of_left)

        return _bound(F.array_intersect(vocabulary, p), of_common)

    new = lambda h: (h["dice"] == 1) | ~F.exists(found, lambda x: x["k"] == h["k"])
    return F.filter(_bound(_pairs(words), of_pairs), lambda h: (h["dice"] >= F.lit(t)) & new(h))


@cache
def _prepared(given: tuple[tuple[str, tuple[str, ...]], ...], t: float) -> tuple:
    """Templates, lengths and anchors, which take a while for whole licence texts."""
    known = templates(dict(given))
    return known, spans(dict(given)), anchors(known, t)


def scan(docs: DataFrame, given: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with license string, license_dice double and license_hits array<struct<dice, license>> (distinct).

    Columns of ``docs`` with those names are replaced.
    """
    given = TEMPLATES if given is None else given
    known, lengths, (marks, pairs) = _prepared(tuple((k, tuple(v)) for k, v in given.items()), threshold)
    table, vocabulary = _table(known, lengths, threshold), F.split(F.lit("\n".join(sorted({x for _, b in known for x in b}))), "\n")
    docs = docs.drop(*(c for c in ("license", "license_dice", "license_hits") if c in docs.columns))
    none = F.array().cast("array<struct<dice:double,license:string>>")

    def held(words: Column, text: Column) -> Column:
        """Whether a text or unit, its words told apart by blanks, has an anchor; without one nothing in it matches."""
        some = F.exists(words, lambda w: w.isin(*marks)) if marks else F.lit(False)  # one look-up in a hash set a word
        return reduce(lambda c, m: c | F.contains(text, F.lit(m)), pairs, some)

    split = lambda x: F.split(x, " ")

    def of_text(plain: Column) -> Column:
        # units: lines, paragraphs and the text; of equal units one is compared
        paragraphs = F.transform(F.split(plain, "\n *\n"), lambda b: F.translate(b, "\n", " "))
        every = F.array_distinct(F.concat(F.split(plain, "\n"), paragraphs, F.array(F.translate(plain, "\n", " "))))
        units = F.filter(every, lambda u: held(split(u), u))
        words = F.transform(units, lambda u: F.filter(split(u), lambda w: w != ""))
        whole = F.filter(split(F.translate(plain, "\n", " ")), lambda w: w != "")
        of_units = F.flatten(F.transform(words, lambda w: _hits(w, known, table, threshold)))
        both = _bound(of_units, lambda h: F.concat(h, _window_hits(whole, h, table, vocabulary, threshold)))
        return F.array_distinct(F.transform(both, lambda h: F.struct(h["dice"].alias("dice"), h["license"].alias("license"))))

    # one-element arrays bind the normalised text and its one-line form to names, so each is made once
    def of_plain(plain: Column) -> Column:
        line = F.translate(plain, "\n", " ")
        some = F.flatten(F.transform(F.array(line), lambda x: F.array(held(split(x), x))))
        return F.when(F.get(some, F.lit(0)), of_text(plain)).otherwise(none)

    lower = F.lower(F.coalesce(docs["text"], F.lit("")))
    hits = F.flatten(F.transform(F.array(F.regexp_replace(lower, "[^a-z0-9\n]+", " ")), of_plain))
    # a generator of one row, so that the plan doesn't copy the expression to each place that reads it
    out = docs.select("*", F.inline(F.array(F.struct(hits.alias("license_hits")))))
    out = out.withColumn("_best", F.get(F.array_sort(F.transform("license_hits", lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("license")))), F.lit(0)))
    return out.select(*(out[c] for c in docs.columns), F.col("_best.license").alias("license"), F.coalesce(-F.col("_best.d"), F.lit(0.0)).alias("license_dice"), "license_hits")
