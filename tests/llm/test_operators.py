"""Every operator on awkward tables and on empty ones, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiver.llm.common import materialise
from quiver.llm import decontamination, license_scan, line_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, quotation, sharding
from tests.llm import data


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    data.frame(spark, data.awkward()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return data.frame(spark, [])


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# 1


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 2**64, 300, np.uint64)
    for n in (1, 2, 7, 40):
        shard, grown = sharding.jump_hash(keys, n)
        assert shard.tolist() == [jump(int(k), n) for k in keys]
        assert grown.tolist() == [jump(int(k), n + 1) for k in keys]


def test_sharding(docs, nothing):
    rows = sharding.shard_documents(docs, 7).collect()
    assert len(rows) == len(data.awkward())
    slots, shard_of = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard
        assert r.law == "key" and r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data.awkward())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sizes
    assert sharding.shard_documents(nothing, 7).count() == 0


def test_sharding_in_sql(docs):
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    got = sharding.shard_documents(docs, 7, runs=3).select(columns).collect()
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in data.awkward()], pa.int64()), "text": [r[1] for r in data.awkward()]}))
    wanted = db.sql(f"SELECT {', '.join(columns)} FROM ({sharding.oracle(7, 3)})").fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got)


# 2


def test_decontamination(spark, nothing):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for n in (6, 14, 30, 59, 200)] + ["", None, "too short"]
    texts = []
    for i in range(120):
        body = [word() for _ in range(rng.choice([0, 5, 100, 3000]))]
        if i % 3 == 0:
            item = rng.choice(items[:5]).split()
            share = rng.choice([1.0, 0.9, 0.8, 0.4])
            at = rng.randrange(len(body) + 1)
            body[at:at] = item[: math.ceil(share * len(item))]
        texts.append((i, "\n".join(body).title() if i % 2 else " , ".join(body), "en", "a"))
    texts += [(500, None, None, None), (501, "Too, SHORT!", "en", "a"), (502, " ".join([*items[4].split(), "too short", *items[4].split()]), "en", "a"), (None, items[1], "en", "a")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_contained) for r in decontamination.find_items(data.frame(spark, texts), bench).collect()}

    def shingles(t, width=5):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    want = {}
    for i, t, *_ in texts:
        for j, item in enumerate(items):
            a, b = shingles(item), shingles(t, min(5, len((item or "").split())))
            if a and 100 * len(a & b) >= 75 * len(a):
                want[i, j] = (len(a), len(a & b))
    assert got == want and len(want) > 20 and {d for d, i in want if i == 7} == {501, 502}
    assert decontamination.find_items(nothing, bench).count() == 0
    assert decontamination.find_items(data.frame(spark, texts), bench.limit(0)).count() == 0


# 3


def test_quality_classifier(spark, docs, nothing):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        body = [word() + ("" if good or rng.random() < 0.3 else rng.choice(["###", "$$$"])) for _ in range(rng.randint(3, 200))]
        texts.append((i, " ".join(body), "en", "a"))
        # labels of the held-out third are turned round: reading them would ruin the model
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(good != held)))
    table = spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, quality int")
    rows = quality_classifier.score_quality(data.frame(spark, texts), table).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert 150 < len(held) < 250
    assert sum(r.predicted != truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    edge = quality_classifier.score_quality(docs, table).collect()
    assert len(edge) == len(data.awkward()) and all(0 <= r.score <= 1 for r in edge)
    assert {r.score for r in quality_classifier.score_quality(docs, table.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_quality(nothing, table).count() == 0


# 4


def test_quotation(spark):
    first = "Shall we meet on Monday?\nI have time.\n\nBring the book."
    second = "On Monday A wrote:\n> Shall we meet on  Monday?\n> I have TIME.\n\nYes.\nNoon is fine."
    third = "> > Shall we meet on Monday?\n> > I have time.\n> Yes.\n> Noon is fine.\nGood."
    rows = [(1, 0, "u", first), (1, 1, "v", second), (1, 2, "u", third), (1, 3, "w", "> Bring the book.\nI will."), (1, 4, "w", "> never said\nHm."), (2, 0, "u", "> Bring the book."), (2, 1, "v", None), (None, 0, "u", "x"), (3, None, "u", "> x"), (2, 0, "u", "> Bring the book.")]
    got = quotation.link_quotations(spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, level string, key int")).collect()
    assert len(got) == len(rows)
    one = {(r.conv_id, r.turn): r for r in got}
    assert [one[1, t].parent_turn for t in range(5)] == [None, 0, 1, 0, None]
    assert [one[1, t].depth for t in range(5)] == [0, 1, 2, 1, 0]
    assert [one[1, t].root_turn for t in range(5)] == [0, 0, 0, 0, 4]
    assert [one[1, t].position for t in range(5)] == [0, 1, 2, 3, 4]
    assert [one[1, t].text for t in (1, 2, 4)] == ["Yes.\nNoon is fine.", "Good.", "Hm."]
    assert (one[1, 2].n_quotes, one[1, 2].n_linked) == (2, 2) and one[1, 4].n_linked == 0
    assert sorted(r.position for r in got if r.conv_id == 2) == [0, 1, 2]
    assert quotation.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_partial_quotations(spark):
    first = "Shall we meet on Monday?\nI have time.\nBring the book."
    texts = [
        first, "> I have TIME.\nGood.", "> Shall we meet on Monday?\n> [...]\n> Bring the  book.\nYes.", "Yes, noon is fine.\nOn Monday A wrote:\n> Bring the book.", "> Yes, noon is fine.\nSee you.",
        "> Yes, noon is fine.\n> On Monday A wrote:\n> > Bring the book.\nFine.", "> I have time.\n> but never said this\nHm.", "> See you.\n> I have time.\nOK.", "> ...\nWhat?",
    ]
    got = quotation.link_quotations(spark.createDataFrame([(1, i, "u", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    one = {r.turn: r for r in got}
    assert [one[t].parent_turn for t in range(9)] == [None, 0, 0, 0, 3, 3, None, 4, None]
    assert [(one[t].n_quotes, one[t].n_linked) for t in range(9)] == [(0, 0), (1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (1, 0), (1, 1), (1, 0)]
    assert one[3].text == "Yes, noon is fine." and one[5].text == "Fine."


def test_generated_threads(spark):
    """Replies that quote a whole passage, some lines of it, or a quotation with what it quotes find the message they answer."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, parent = [], {}
    for conv in range(15):
        own, quoted = {}, {}
        for t in range(14):
            own[t] = [" ".join(word() for _ in range(rng.randint(2, 8))) for _ in range(3)]
            p = rng.randrange(t) if t and rng.random() < 0.8 else None
            parent[conv, t], quoted[t] = p, []
            if p is not None:
                mode = rng.choice(["whole", "part", "nested"])
                lines = own[p] if mode != "part" else sorted(rng.sample(own[p], rng.randint(1, 2)), key=own[p].index)
                quoted[t] = [*(f"> {x}" for x in quoted[p] if mode == "nested"), *(f"> {x.upper() if rng.random() < 0.3 else x}" for x in lines)]
            rows.append((conv, t, "u", "\n".join([*(["On Monday somebody wrote:"] if quoted[t] and rng.random() < 0.5 else []), *quoted[t], *own[t]])))
    rng.shuffle(rows)
    got = quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == parent
    for conv in range(15):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(14))


# 5


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(6, 1), (6, 0), (10, 1), (None, 1)], "doc_id long, quality int")
    got = by_id(quality_rules.apply_rules(docs, labels))
    for i, t, *_ in data.awkward():
        w = data.words(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), data.repeats(w))
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want for r in got[i])
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept) for r in got[i])
    assert quality_rules.apply_rules(nothing, labels).count() == 0


def test_repeated_words(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))), "en", "a") for i in range(200)]
    for r in quality_rules.base_counts(data.frame(spark, texts)).collect():
        assert r.n_repeat_words == data.repeats(data.words(texts[r.doc_id][1]))


def test_cutoffs_hold_their_promise(spark):
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (17, 900, 0.01), (0, 0, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n), p).alias("x")).first().x
        assert got == pytest.approx(exact, rel=1e-9)
    # 3000 good documents in one stratum, 40 in the other: only the first can justify a cutoff
    rng = random.Random(6)
    texts = []
    for i in range(3040):
        body = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if i % 100 == 0:
            body = [w + "###" for w in body]
        texts.append((i, " ".join(body), "en" if i < 3000 else "xx", "a"))
    labels = spark.createDataFrame([(i, 1) for i in range(3040)], "doc_id long, quality int")
    counts = materialise(quality_rules.base_counts(data.frame(spark, texts)), "counts")
    cuts = {r.stratum: r for r in quality_rules.select_cutoffs(counts, labels).collect()}
    assert cuts["xx"].cut_symbols is None and cuts["en"].cut_symbols == cuts["en"].cut_capitals == 0
    fallen = sum((quality_rules.rule_shares()[r] > cuts["en"][f"cut_{r}"]).cast("int") for r in quality_rules.RULES) > 0
    rejected = counts.filter("stratum = 'en'").filter(fallen).count()
    assert rejected / 3000 <= quality_rules.FALSE_REJECTIONS


def test_kept_by_rules(spark):
    """Junk falls, good documents stay within the promise, and every verdict follows from the cutoffs."""
    rng = random.Random(13)
    texts, labels = [], []
    for i in range(1200):
        good = i % 5 > 0
        body = [f"w{rng.randrange(10**6)}" + ("" if good or rng.random() < 0.5 else "#$%") for _ in range(rng.randint(55, 80))]
        texts.append((i, " ".join(body), "en" if i % 2 else "de", "a"))
        if rng.random() < 0.7:
            labels.append((i, int(good)))
    frame, table = data.frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    counts = materialise(quality_rules.base_counts(frame), "counts")
    cuts = {r.stratum: r for r in quality_rules.select_cutoffs(counts, table).collect()}
    shares = {r.doc_id: r for r in counts.select("doc_id", "stratum", *(c.alias(n) for n, c in quality_rules.rule_shares().items())).collect()}
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(frame, table).collect()}
    assert set(cuts) == {"en", "de"}
    for i, kept in got.items():
        assert kept == all(cuts[shares[i].stratum][f"cut_{r}"] is None or shares[i][r] <= cuts[shares[i].stratum][f"cut_{r}"] for r in quality_rules.RULES)
    assert not any(got[i] for i in range(0, 1200, 5)) and sum(got[i] for i in range(1200) if i % 5) > 0.95 * 960


# 6


def scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for i in range(len(w)) for p, label in license_scan.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    labels, score = set(base), 0.0
    # all rules on all texts: neither the keywords of rules nor the gate of texts are used
    joined = f" {' '.join(w)} "
    hits = sorted((m.start(), -m.end(), s["priority"], f["label"], s["weight"]) for f in license_scan.rules() for s in f["signatures"] for m in re.finditer(s["pattern"], joined))
    reach = -1
    for _, end, _, label, weight in hits:
        if -end > reach:
            reach, score = -end, max(score, weight)
            labels |= {label} if weight else set()
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score


SENTENCES = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\")",
    "The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.",
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:",
    "Neither the name of the University of Nowhere nor the names of its contributors may be used to endorse or promote products derived from this software",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "you may not use this file except in compliance with the License.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages",
    "This is free and unencumbered software released into the public domain.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public Licence",
    "It is not licensed under the Boost Software License.",
    "This code was never released under the BSD 3-Clause.",
    "It is not released under the Vim license but under the MIT License.",
    "It is not licensed under the GNU General Public License.",
)


def test_license_scan(spark, docs, nothing):
    texts = [*data.awkward(), (100, "Released under the GNU Lesser General Public License version 2 1.", "en", "a"), (101, "SPDX-License-Identifier: MIT\nmit license, MIT License", "en", "a"), (102, "Licensed under the Apache License, Version 2.0 and the 3-clause BSD license", "en", "a"), (103, "mit license " * 300, "en", "a"), (104, "general public license", None, None)]
    texts += [(110 + i, t, "en", "a") for i, t in enumerate(SENTENCES)]
    got = by_id(license_scan.scan_licenses(data.frame(spark, texts)))
    for i, t, *_ in texts:
        want = scan(t)
        assert any((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want for r in got[i]), (i, want, got[i])
    assert [got[110 + i][0].labels for i in range(len(SENTENCES))] == ["mit", "mit", "bsd", "bsd", "isc", "apache", "boost", "zlib", "unlicense", "gpl", "agpl", "", "", "mit", "gpl"]
    assert got[100][0].labels == "gpl,lgpl" and got[102][0].labels == "apache,bsd"
    assert len([s for f in license_scan.rules() for s in f["signatures"]]) >= 300
    assert license_scan.scan_licenses(nothing).count() == 0


#: A text of each rule, with N for a name or an identifier and I for an identifier.
RULE_SAMPLES = ("SPDX-License-Identifier: I", "Licensed under the terms of the N", "under the conditions of the N License", "Subject to the N License", "Permission is hereby granted under the N License", "a copy of the N License", "the N License", "License: N")
FAMILY_SAMPLES = {
    "mit": ("MIT", "MIT"), "apache": ("Apache Software", "Apache-2.0"), "gpl": ("GNU General Public", "GPL-3.0-or-later"), "lgpl": ("GNU Lesser General Public", "LGPL-2.1"), "agpl": ("GNU Affero General Public", "AGPL-3.0-only"), "bsd": ("3-clause BSD", "BSD-3-Clause"), "isc": ("ISC", "ISC"),
    "mpl": ("Mozilla Public", "MPL-2.0"), "epl": ("Eclipse Public", "EPL-2.0"), "cddl": ("Common Development and Distribution", "CDDL-1.0"), "cpl": ("Common Public", "CPL-1.0"), "cc-by": ("Creative Commons Attribution 4.0 International", "CC-BY-4.0"), "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"), "cc0": ("Creative Commons CC0", "CC0-1.0"), "unlicense": ("Unlicense", "Unlicense"), "wtfpl": ("WTFPL", "WTFPL"), "zlib": ("zlib/libpng", "Zlib"), "boost": ("Boost Software", "BSL-1.0"), "artistic": ("Perl Artistic", "Artistic-2.0"),
    "eupl": ("European Union Public", "EUPL-1.2"), "ofl": ("SIL Open Font", "OFL-1.1"), "psf": ("Python Software Foundation", "Python-2.0"), "php": ("PHP", "PHP-3.01"), "ruby": ("Ruby", "Ruby"), "w3c": ("W3C Software", "W3C"), "x11": ("X11", "X11"), "postgresql": ("PostgreSQL", "PostgreSQL"), "openssl": ("OpenSSL", "OpenSSL"),
    "ms-pl": ("Microsoft Public", "MS-PL"), "ms-rl": ("Microsoft Reciprocal", "MS-RL"), "odbl": ("Open Database", "ODbL-1.0"), "cecill": ("CeCILL", "CECILL-2.1"), "afl": ("Academic Free", "AFL-3.0"), "osl": ("Open Software", "OSL-3.0"), "ecl": ("Educational Community", "ECL-2.0"), "ncsa": ("University of Illinois/NCSA Open Source", "NCSA"),
    "vim": ("Vim", "Vim"), "tcl": ("Tcl/Tk", "TCL"), "beerware": ("Beerware", "Beerware"), "libpng": ("libpng", "libpng-2.0"), "sleepycat": ("Sleepycat", "Sleepycat"), "qpl": ("Q Public", "QPL-1.0"), "sspl": ("Server Side Public", "SSPL-1.0"), "bsl": ("Business Source", "BUSL-1.1"),
}


def test_every_license_rule_fires(spark):
    assert FAMILY_SAMPLES.keys() == license_scan.FAMILIES.keys()
    want, texts = {}, []
    for label, (name, code) in FAMILY_SAMPLES.items():
        for sample, (_, weight) in zip(RULE_SAMPLES, [t for t in license_scan.TEMPLATES if t[1]], strict=True):
            for what in (code,) if "I" in sample.replace("License-Identifier", "") else (name, code):
                want[len(texts)] = (label, weight, sample, what)
                texts.append((len(texts), re.sub(r"\b[NI]\b", what, sample) + ".", "en", "a"))
    texts.append((-1, "Licensed under CC BY-NC 4.0.", "en", "a"))
    got = by_id(license_scan.scan_licenses(data.frame(spark, texts)))
    wrong = [(w, got[i][0].labels, got[i][0].score) for i, w in want.items() if w[0] not in got[i][0].labels.split(",") or got[i][0].score < w[1]]
    assert not wrong
    assert got[-1][0].labels == "cc-by-nc" and got[-1][0].score == 0.95


def test_license_gate_passes_every_rule(spark):
    """The words of each rule, without the word licence where it may be left out; line breaks and marks between words."""
    verbs = ("Released", "DISTRIBUTED", "published", "Provided", "available", "covered", "governed")
    texts = [(i, f"{v}\n* under the BSD 3-Clause.", "en", "a") for i, v in enumerate(verbs)] + [(20 + i, f"This is {v} by the Boost Software", "en", "a") for i, v in enumerate(verbs)]
    texts += [(50, "Released under the Beerware", "en", "a"), (51, "available under pressure, by the BSD", "en", "a"), (52, "Subject to the Vim licence", "en", "a")]
    got = by_id(license_scan.scan_licenses(data.frame(spark, texts)))
    assert {(got[i][0].labels, got[i][0].score) for i in range(len(verbs))} == {("bsd", 0.95)}
    assert {(got[20 + i][0].labels, got[20 + i][0].score) for i in range(len(verbs))} == {("boost", 0.95)}
    assert [got[i][0].labels for i in (50, 51, 52)] == ["beerware", "", "vim"]


# 7


def targets(sizes):
    """By resharing, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full, left = 1.5 * sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(full.values())
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in left}
        full |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return full


def test_mixing(docs, nothing):
    rows = mixing.mix_sources(docs).collect()
    sizes, source = defaultdict(int), {}
    for i, t, _, src in data.awkward():
        sizes[src] += len(data.words(t))
        source.setdefault(i, src)
    want = targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 2 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        taken[r.source_size, r.target] += r.taken
    assert all(t == math.floor(target) for (_, target), t in taken.items())
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix_sources(nothing).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    part = {r.doc_id: r.taken for r in rows if r.doc_id is not None and r.doc_id != 12}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(data.words(r.text))
    assert all(words[i] == n for i, n in part.items())
    assert mixing.apply_mix(nothing).count() == 0


# 8


def spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            twice = [2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
            return 14 <= len(d) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "", re.ASCII) if holds(k, m[0]))


def test_pii_patterns(spark, docs, nothing):
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y@z-w.co.uk@", "d_e@f.g.h@i.j", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (706) 555-3138", "+12", "é", "中", " ", "\n", "-", "12 34", "@", "+"]
    texts = [*data.awkward(), *((1000 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))), "en", "a") for i in range(300))]
    got = by_id(pii.find_personal_data(data.frame(spark, texts)))
    for i, t, *_ in texts:
        want = spans(t)
        assert any([(s.start, s.order, s.kind, s.end) for s in r.spans if s.order < 4] == want for r in got[i]), (t, want, got[i])
    assert pii.find_personal_data(nothing).count() == 0


def test_pii_terms(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for i in range(60):
        body = [word() for _ in range(30)]
        if i % 10 == 0:  # the nickname stands near the address only, "the" stands everywhere
            body[10:10] = ["Zorro", "the", "boss@corp.example", word()]
        texts.append((i, " ".join([*body, "the"]), "en", "a"))
    copies = " ".join([word(), "lonely@copy.example", "unique", word()])
    texts += [(100 + i, copies, "en", "a") for i in range(5)]  # copies of one text prove nothing
    texts.append((200, "Zorro was here.", "en", "a"))
    got = {r.doc_id: r for r in pii.find_personal_data(data.frame(spark, texts)).collect()}
    assert [s.kind for s in got[0].spans] == ["term", "email"]
    assert "[TERM] the [EMAIL]" in got[0].sanitised and got[1].spans == []
    assert [s.kind for s in got[100].spans] == ["email"]
    assert len(got[200].term) == 0 or got[200].sanitised == "[TERM] was here."


def test_pii_terms_of_two_texts(spark):
    """Two different texts are enough, and whole words at the ends of a text and of a window count."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts = [(i, " ".join(word() for _ in range(30)), "en", "a") for i in range(60)]
    texts += [(100 + i, f"Zorro {word()} boss@corp.example {word()} Tornado", "en", "a") for i in range(2)]
    gap = lambda n: "," * n
    texts += [(200 + i, f"{word()} Garcia{gap(60)}{word()}{gap(7)}two@corp.example{gap(75)}Diego {word()} Sancho", "en", "a") for i in range(2)]
    texts += [(300 + i, f"xGarcilaso{gap(60)}{word()}{gap(7)}cut@corp.example{gap(75)}Quixote {word()}", "en", "a") for i in range(2)]
    got = {r.doc_id: r for r in pii.find_personal_data(data.frame(spark, texts)).collect()}
    named = lambda i: [texts_of[i][s.start : s.end] for s in got[i].spans]
    texts_of = {i: t for i, t, *_ in texts}
    assert named(100) == named(101) == ["Zorro", "boss@corp.example", "Tornado"]
    assert [x for x in named(200) if "@" not in x] == ["Garcia", "Diego"]
    assert all("@" in x for x in named(300)) and got[0].spans == []


def test_pii_secrets(spark):
    texts = [(0, 'und token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" wie', "en", "a"), (1, "the token = a sign, API_KEY: ab12cd34ef56ab78cd", "en", "a"), (2, "token = abcdefghijklmnopqrstuvwxyz", "en", "a")]
    got = {r.doc_id: [texts[r.doc_id][1][s.start : s.end] for s in r.secret] for r in pii.find_personal_data(data.frame(spark, texts)).collect()}
    assert got == {0: ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962'], 1: ["API_KEY: ab12cd34ef56ab78cd"], 2: []}


# 9


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64))
    phf = line_dedup.PerfectHash.build(keys)
    assert sorted(phf(keys).tolist()) == list(range(len(keys)))
    again = line_dedup.PerfectHash.from_bytes(phf.to_bytes())
    assert (again(keys) == phf(keys)).all() and len(phf.to_bytes()) < len(keys)
    assert line_dedup.PerfectHash.build(keys[:0])(keys[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("small", [False, True])
def test_line_dedup(spark, docs, nothing, monkeypatch, small):
    if small:  # many shards with many copies each
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3), monkeypatch.setattr(line_dedup, "PROBES_OF_COPY", 2)
    texts = data.awkward()
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in texts:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                holders[key(x)].add(i)
    got = by_id(line_dedup.dedup_lines(docs))
    dropped = 0
    for i, t, *_ in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        assert any((r.n_lines, r.n_dropped, r.text) == (len(lines), len(lines) - len(stay), "\n".join(stay)) for r in got[i])
        dropped += len(lines) - len(stay)
    assert dropped == 18
    assert line_dedup.dedup_lines(nothing).count() == 0


# 10


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    a, b = near_dedup._functions(near_dedup.SAMPLES, 1)
    for shared, passes in ((900, True), (860, True), (300, False)):
        pool = rng.integers(0, 2**64, 2000, np.uint64)
        x, y = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        odd = near_dedup.odd_sketch(near_dedup._minima(x, a, b)) ^ near_dedup.odd_sketch(near_dedup._minima(y, a, b))
        assert (sum(bin(int(v) & 0xFFFFFFFFFFFFFFFF).count("1") for v in odd) <= near_dedup.most_odd_bits()) == passes


def test_near_duplicates(docs, nothing):
    want = data.components(data.awkward())
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(data.awkward())
    assert want[7] == want[8] == 6 and want[9] == 9
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_of_one_large_group(spark, monkeypatch, small):
    """Copies with many edits each: most links pass through others. Small limits cut buckets into many blocks and make many keys hot."""
    if small:
        for name, value in {"BLOCK_MEMBERS": 20, "BLOCK_SHINGLES": 3000, "LEAST_HOT": 3, "RAYS_OF_COPY": 10}.items():
            monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(250):
        edited = [w if rng.random() > 0.018 else f"e{rng.randrange(10**6)}" for w in base]
        texts.append((i, " ".join(edited), "en", "a"))
    texts += [(1000 + i, texts[0][1], "en", "a") for i in range(20)] + [texts[0]] * 5
    want = data.components(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(data.frame(spark, texts)).collect()}
    assert got == want and len(set(want.values())) < 250


def test_rows_of_a_group_grow_linearly(spark, monkeypatch):
    """Four times the near copies give about four times the rows that any step writes, and no link is lost."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = [(i, " ".join(w if rng.random() > rng.choice((0.003, 0.02)) else f"e{rng.randrange(10**6)}" for w in base), "en", "a") for i in range(640)]
    written = []
    monkeypatch.setattr(near_dedup, "materialise", lambda df, tag: [x := materialise(df, tag), written.append(x.count())][0])
    most = []
    for n in (160, 640):
        written.clear()
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(data.frame(spark, texts[:n])).collect()}
        assert got == data.components(texts[:n])
        most.append(max(written))
    assert most[1] <= 6 * most[0]


def test_hash_of_kept_text_in_query(spark, tmp_path):
    from quiver.llm import queries

    data.frame(spark, data.awkward()).write.parquet(f"{tmp_path}/documents.parquet")
    r = {x.doc_id: x for x in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert r[4].kept_sha256 == hashlib.sha256(b"one two").hexdigest()
    p = {x.doc_id: x for x in queries.op8_pii(spark, str(tmp_path)).collect()}
    assert p[4].base_sha256 == hashlib.sha256(b"").hexdigest() and p[4].spans == ""


# texts that are long in one respect


def test_long_runs(spark):
    """Digits, dots, marks of quotation, addresses and terms by the hundred thousand end in seconds and without a deep stack."""
    n = 1_000_000
    texts = ["1" * n, "a@b" + ".c" * (n // 2), "." * n, "1." * (n // 2), "a@" * (n // 2), "+" * n, "+1" + "." * n, "4111 1111 1111 1111," * 20_000, "x@y.zz " * 100_000, "-1" * (n // 2), "token" * 100_000, "token = " + "a" * n]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = by_id(pii.find_personal_data(data.frame(spark, rows).repartition(4)))
    assert [(s.start, s.end) for s in got[8][0].email] == [(7 * k, 7 * k + 6) for k in range(100_000)] and got[8][0].sanitised == "[EMAIL] " * 100_000
    assert [len(got[i][0].email) for i in range(8)] == [0, 1, 0, 0, 0, 0, 0, 0] and len(got[7][0].card) == 20_000 and len(got[3][0].ip) == n // 8
    assert got[7][0].sanitised == "[CARD]," * 20_000
    quoted = spark.createDataFrame([(1, 0, "u", ">" * n), (1, 1, "u", " " * n + "x" + " " * n + "y"), (1, 2, "u", "> " * (n // 2) + "x"), (1, 3, "u", "\n".join(["> a", "b"] * 5000))], "conv_id long, turn long, role string, text string")
    assert sorted((r.turn, len(r.text)) for r in quotation.link_quotations(quoted).collect()) == [(0, 0), (1, n + 2), (2, 0), (3, 9999)]


def test_spans_apart(spark):
    """Spans outside others, and texts with their spans replaced, against brute force."""
    from quiver.llm.spans import SPAN, outside, replaced

    rng = random.Random(21)
    rows = []
    for _ in range(200):
        spans = sorted({(a, a + rng.randint(1, 6)) for a in rng.sample(range(3000), rng.randint(0, 40))})
        others = [(a, a + rng.randint(1, 40)) for a in rng.sample(range(3000), rng.randint(0, 20))]
        rows.append(("".join(rng.choice("abéß中 \n") for _ in range(3100)), [(a, b, "v") for a, b in spans], [(a, b, "o") for a, b in others], [(a, b, "k") for a, b in spans]))
    frame = spark.createDataFrame(rows, f"text string, spans {SPAN}, others {SPAN}, kinds array<struct<start:int,end:int,kind:string>>")
    for text, spans, _, others, free, out in frame.select("text", "spans", "kinds", "others", outside(F.col("spans"), F.col("others")).alias("free"), replaced(F.col("text"), F.col("kinds")).alias("out")).collect():
        assert [(s.start, s.end) for s in free] == [(a, b) for a, b, _ in spans if not any(a < d and c < b for c, d, _ in others)]
        want, at = "", 0
        for a, b, _ in spans:
            if a >= at:
                want += text[at:a] + "[K]"
            at = max(at, b)
        assert out == want + text[at:]
