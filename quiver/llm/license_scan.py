"""License statements by ordered signature rules, with a keyword prefilter and suppression of contained detections."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import lower_ascii, text_of
from quiver.llm.spans import find_spans

#: Word characters of the contract, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases of the contract and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label: (keyword that every match of the name holds, the family's name in words, its identifier in words), all as regular expressions but the keyword.
FAMILIES = {
    "mit": ("mit", "(?:the )?mit", "mit"),
    "apache": ("apache", "apache(?: software)?", "apache(?: [12] [01])?"),
    "gpl": ("general public", "(?:gnu )?general public", "gpl(?: [123] 0)?(?: only| or later)?"),
    "lgpl": ("lesser general", "(?:gnu )?lesser general public", "lgpl(?: [23] [01])?(?: only| or later)?"),
    "agpl": ("affero", "(?:gnu )?affero general public", "agpl(?: 3 0)?(?: only| or later)?"),
    "bsd": ("bsd", "(?:(?:new|modified|simplified|revised|[0234] clause) )?bsd(?: [0234] clause)?", "bsd [0234] clause"),
    "isc": ("isc", "isc", "isc"),
    "mpl": ("mozilla", "mozilla public", "mpl [12] [01]"),
    "epl": ("eclipse", "eclipse public", "epl [12] 0"),
    "cddl": ("common development", "common development and distribution", "cddl 1 [01]"),
    "cpl": ("common public", "common public", "cpl 1 0"),
    "cc-by": ("attribution", "creative commons attribution(?: [1-4] 0)?(?: international)?", "cc by [1-4] 0"),
    "cc-by-sa": ("sharealike", "creative commons attribution sharealike(?: [1-4] 0)?(?: international)?", "cc by sa [1-4] 0"),
    "cc-by-nc": ("noncommercial", "creative commons attribution noncommercial(?: [1-4] 0)?(?: international)?", "cc by nc [1-4] 0"),
    "cc0": ("cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    "unlicense": ("unlicense", "(?:the )?unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl"),
    "zlib": ("zlib", "zlib(?: libpng)?", "zlib"),
    "boost": ("boost", "boost software", "bsl 1 0"),
    "artistic": ("artistic", "(?:perl )?artistic", "artistic [12] 0"),
    "eupl": ("european union", "european union public", "eupl 1 [012]"),
    "ofl": ("open font", "(?:sil )?open font", "ofl 1 [01]"),
    "psf": ("python", "python(?: software foundation)?", "python 2 0"),
    "php": ("php", "php", "php 3 0[01]?"),
    "ruby": ("ruby", "ruby", "ruby"),
    "w3c": ("w3c", "w3c(?: software)?", "w3c"),
    "x11": ("x11", "x11", "x11"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "openssl": ("openssl", "openssl", "openssl"),
    "ms-pl": ("microsoft public", "microsoft public", "ms pl"),
    "ms-rl": ("microsoft reciprocal", "microsoft reciprocal", "ms rl"),
    "odbl": ("open database", "open database", "odbl 1 0"),
    "cecill": ("cecill", "cecill", "cecill(?: [12] [01])?"),
    "afl": ("academic free", "academic free", "afl [123] [012]"),
    "osl": ("open software", "open software", "osl [123] [01]"),
    "ecl": ("educational community", "educational community", "ecl [12] 0"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    "vim": ("vim", "vim", "vim"),
    "tcl": ("tcl", "tcl(?: tk)?", "tcl"),
    "beerware": ("beerware", "beerware", "beerware"),
    "libpng": ("libpng", "libpng", "libpng(?: 2 0)?"),
    "sleepycat": ("sleepycat", "sleepycat", "sleepycat"),
    "qpl": ("q public", "q public", "qpl 1 0"),
    "sspl": ("server side public", "server side public", "sspl 1 0"),
    "bsl": ("business source", "business source", "busl 1 1"),
}

_VERSION = "(?: (?:version|v) ?[0-9]+(?: [0-9]+)?)?"
#: Words that make a statement of their own, without the word licence.
_GIVEN = "released|distributed|published|provided|available|covered|governed"
_LICENSE = "(?: licen[sc]e)(?: agreement)?"
_UNDER = f"(?:licen[sc]ed|{_GIVEN}) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?N(?:{_LICENSE})?{_VERSION}"
#: Rules of a family in the order in which they win: template, weight. A weight of 0 denies: what the match contains
#: counts for nothing. N stands for the name and, in a rule of its own, for the identifier; I for the identifier only.
TEMPLATES = (
    (f"(?:not|never|no longer) {_UNDER}", 0.0),
    ("spdx licen[sc]e identifier I", 1.0),
    (f"(?:dual )?{_UNDER}", 0.95),
    (f"under (?:the )?(?:terms|conditions) (?:and conditions )?of (?:the )?N{_LICENSE}{_VERSION}", 0.95),
    (f"subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?N{_LICENSE}{_VERSION}", 0.9),
    (f"permission is (?:hereby )?granted under (?:the )?N{_LICENSE}{_VERSION}", 0.9),
    (f"(?:a|any) copy of (?:the )?N{_LICENSE}{_VERSION}", 0.85),
    (f"N{_LICENSE}{_VERSION}", 0.8),
    (f"licen[sc]e (?:type )?(?:is )?(?:the )?N{_VERSION}", 0.6),
)

#: Sentences of license texts that don't name their license: label, words that every match holds, pattern, weight.
SENTENCES = (
    ("mit", "obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.9),
    ("mit", "this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.8),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?: subject to the limitations in the disclaimer below)?(?: provided that the following conditions are met)?", 0.9),
    ("bsd", "may be used to endorse or promote", "neither the name of (?:[^ ]+ ){1,12}(?:nor the names of (?:its|their) contributors )?may be used to endorse or promote products derived from this software", 0.8),
    ("isc", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.9),
    ("apache", "you may not use this file except", "you may not use this file except in compliance with the licen[sc]e", 0.8),
    ("boost", "any person or organization obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.9),
    ("zlib", "this software is provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", 0.8),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.9),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain", 0.9),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", 0.8),
    ("wtfpl", "do what the fuck you want to", "(?:you just )?do what the fuck you want to(?: public licen[sc]e)?", 0.9),
    ("gpl", "it under the terms of the gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation(?: either version [0-9](?: or at your option any later version)?)?", 0.95),
    ("lgpl", "it under the terms of the gnu", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e(?: as published by the free software foundation)?", 0.95),
    ("agpl", "it under the terms of the gnu", "(?:you can )?redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e(?: as published by the free software foundation)?", 0.95),
    ("beerware", "buy me a beer", "(?:if we meet some day and you think this stuff is worth it )?you can buy me a beer in return", 0.9),
    ("vim", "distribute unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim|distribute unmodified copies of vim", 0.9),
    ("ofl", "reserved font name", "with reserved font name", 0.7),
)

#: Texts without any of these hold no signature: every template has the word licence, but for the statements of _UNDER, and every sentence has its own words.
KEYWORDS = f"(?i)licen[sc]e|spdx|(?:{_GIVEN}){_GAP}(?:under|by)|" + "|".join(dict.fromkeys(re.sub(" ", lambda _: _GAP, words) for _, words, _, _ in SENTENCES))


def rules() -> list[dict]:
    """Families with their signatures: hundreds of regular expressions over words joined by single spaces.

    A family stands twice, with the rules of its name and those of its identifier, each behind a keyword that all their
    matches hold; that of an identifier is its leading words, from the space in front of them.
    """
    out = []
    for label, (keyword, name, code) in FAMILIES.items():
        leading = " " + re.match("[a-z][a-z0-9]*(?: [a-z]+)*", code)[0]
        for word, what, letters in ((keyword, name, "N"), (leading, code, "NI")):
            signatures = [{"priority": i, "weight": w, "pattern": f"(?<= )(?:{re.sub(f'[{letters}]', lambda _: what, t)})(?= )"} for i, (t, w) in enumerate(TEMPLATES) if re.search(f"[{letters}]", t)]
            out.append({"label": label, "keyword": word, "signatures": signatures})
    for label, words, pattern, weight in SENTENCES:
        out.append({"label": label, "keyword": words, "signatures": [{"priority": len(TEMPLATES), "weight": weight, "pattern": f"(?<= )(?:{pattern})(?= )"}]})
    return out


_RULES = "array<struct<label:string,keyword:string,signatures:array<struct<priority:int,weight:double,pattern:string>>>>"
_STATE = "struct<reach:int,labels:array<string>,score:double>"


def detections(joined: Column) -> Column:
    """All matches of all signatures whose keyword the text holds, in the order start, longest, priority."""
    families = F.filter(F.from_json(F.lit(json.dumps(rules())), _RULES), lambda f: F.contains(joined, f["keyword"]))

    def of_family(f: Column) -> Column:
        def of_signature(s: Column) -> Column:
            return F.transform(
                find_spans(joined, s["pattern"]),
                lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), s["priority"].alias("priority"), f["label"].alias("label"), s["weight"].alias("weight")),
            )

        return F.flatten(F.transform(f["signatures"], of_signature))

    return F.array_sort(F.flatten(F.transform(families, of_family)))


def survivors(found: Column) -> Column:
    """Labels and best weight of the detections that no earlier one contains; one sweep in order of start. A denial contains what it denies and gives no label."""
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")).cast(_STATE)

    def add(acc: Column, x: Column) -> Column:
        end = -x["minus_end"]
        new = end > acc["reach"]
        return F.struct(
            F.greatest(acc["reach"], end).alias("reach"),
            F.when(new & (x["weight"] > 0) & ~F.array_contains(acc["labels"], x["label"]), F.concat(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(new, F.greatest(acc["score"], x["weight"])).otherwise(acc["score"]).alias("score"),
        ).cast(_STATE)

    return F.aggregate(found, start, add)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License labels of every document.

    Words are runs of lower-cased letters, digits and characters beyond ASCII. The phrases of the contract are looked
    for word by word; signatures run on the words joined by spaces, only in texts that hold a keyword. A detection
    inside another one is suppressed, and of equal ones the first rule wins; so a denial ("not licensed under") takes
    away what it denies. Labels of phrases always stay.

    Null or empty text: no words, no labels, score 0. Null doc_id and repeated rows: like any other row. Empty table:
    no rows. Columns besides doc_id and text are ignored. Returns doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    counted = F.length(F.regexp_replace(F.regexp_replace("text", f"{WORD}+", "x"), _GAP, "")).cast("long")
    no_words = F.array().cast("array<string>")
    words = F.when(F.col("text").rlike(KEYWORDS), F.filter(F.split(lower_ascii(F.col("text")), _GAP), lambda x: x != "")).otherwise(no_words)
    cut = texts.select("doc_id", counted.alias("n_words"), words.alias("w"))
    at = lambda i, j: F.coalesce(F.get("w", i + j), F.lit(""))

    def phrase_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            here = F.lit(True)
            for j, word in enumerate(phrase.split()):
                here = here & (at(i, j) == word)
            out = F.when(here, F.lit(label)).otherwise(out)
        return out

    every = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), phrase_at(i).alias("label"))), lambda p: p["label"].isNotNull())
    joined = F.when(F.size("w") > 0, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    based = cut.select("doc_id", "n_words", places.alias("places"), joined.alias("joined"))
    found = F.when(F.col("joined").isNull(), F.lit(None)).otherwise(survivors(detections(F.col("joined"))))
    swept = based.select("doc_id", "n_words", "places", found.alias("found"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return swept.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["i"].cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1)["i"].cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found.labels", no_words))), ",").alias("labels"),
        F.coalesce("found.score", F.lit(0.0)).alias("score"),
    )
