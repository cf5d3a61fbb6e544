"""Operators on texts against plain Python."""

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vaultspark.llm import shingles
from vaultspark.llm.byte_bpe import Codec, PerfectHash, encode_texts, load_ranks
from vaultspark.llm.components import connected_components
from vaultspark.llm.license_rules import SIGNATURES
from vaultspark.llm.license_scan import BASE_PHRASES, rule, rules, scan_licenses
from vaultspark.llm.ngram_join import ngram_jaccard_classes
from vaultspark.llm.packing import Packer, pack_documents
from vaultspark.llm.quality_model import quality_classes
from vaultspark.llm.quality_rules import MEASURES, fences, measure, quality_rules, quantile_fences, sketch
from vaultspark.llm.queries import BYTE_BPE, WORD_BPE, queries
from vaultspark.llm.syncmers import START, fingerprint_pairs
from vaultspark.llm.word_tokens import WordTokenizer

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    long = "lorem ipsum dolor " * 4000
    rows = [(1, None, None, None, "a"), (2, "", "en", "s", "b"), (3, "x", "en", "s", "c"), (3, "x", "en", "s", "c"), (None, "no id at all here", "en", None, "d"), (5, long, "en", "s", "e"), (6, "\n \t", None, "s", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    clash = ["_t", "_w", "_n", "_norm", "_found", "_row", "_lang", "_host", "_id", "_chars", "N_Words", "m_symbols", "f_symbols", "key", "bands", "head", "want", "P_text"]
    return df.withColumns({c: F.lit(k) for k, c in enumerate(clash)})


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def brute_classes(texts, n=5, threshold=0.8):
    words = {k: tuple(words_of(t or "")) for k, t in texts.items()}
    first = {}
    for k in sorted(words):
        if words[k]:
            first.setdefault(words[k], k)
    grams = {}
    for w, k in first.items():
        m = min(n, len(w))
        grams[k] = {w[i : i + m] for i in range(len(w) - m + 1)}
    linked, parent = defaultdict(set), {k: k for k in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(grams, 2):
        common = len(grams[a] & grams[b])
        if common and common >= threshold * (len(grams[a]) + len(grams[b]) - common):
            linked[a].add(b)
            linked[b].add(a)
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (find(first.get(w, k)), first.get(w, k), len(linked[first.get(w, k)])) for k, w in words.items()}


def test_ngram_join_equals_brute_force(docs, texts):
    found = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in ngram_jaccard_classes(docs).collect()}
    assert found == brute_classes(texts)


@pytest.mark.parametrize("block", [3, 512])
def test_ngram_join_of_a_large_group_needs_no_pairs(spark, block):
    random.seed(1)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for k in range(40):
        own = list(base)
        for _ in range(random.randint(0, 2)):
            own[random.randrange(60)] = f"z{k}"
        texts[k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in ngram_jaccard_classes(df, block=block).collect()}
    assert found == brute_classes(texts)


def test_ngram_join_of_a_chain_and_of_repeated_ids(spark):
    """A chain whose ends are far apart goes through many blocks; an id with several texts links each of them by itself."""
    words = [f"w{i}" for i in range(400)]
    texts = {100 - k: " ".join(words[3 * k : 3 * k + 60]) for k in range(100)}
    df = spark.createDataFrame([(k, t) for k, t in texts.items() for _ in range(2)], "doc_id long, text string")
    want = brute_classes(texts)
    found = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in ngram_jaccard_classes(df, block=4).collect()}
    assert found == want and len({c for c, _, _ in want.values()}) == 1
    apart = " ".join(f"z{i}" for i in range(30))
    rows = [(1, texts[50]), (1, apart), (2, texts[49]), (3, apart), (3, texts[48]), (4, apart + " more")]
    for _ in range(2):
        got = sorted((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in ngram_jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(1, 1, 1, 1), (1, 1, 1, 2), (2, 1, 2, 2), (3, 1, 1, 1), (3, 1, 3, 2), (4, 1, 4, 1)]


def test_ngram_join_of_odd_rows(odd):
    rows = ngram_jaccard_classes(odd).collect()
    assert len(rows) == 7 and all(r.n_links == 0 for r in rows)
    assert {r.doc_id: r.class_id for r in rows}[3] == 3
    assert ngram_jaccard_classes(odd.limit(0)).count() == 0


def test_word_hashes_follow_words():
    a, b = shingles.word_hashes(b"Foo bar, foo!"), shingles.word_hashes("x FOO-é".encode())
    assert len(a) == 3 and a[0] == a[2] == b[1] and a[0] != a[1] and len(b) == 3
    assert 1 - (1 - 0.8**7) ** shingles.choose_bands(0.8, 0.9999, 7) >= 0.9999


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges + [(500, 500)], "u long, v long")).collect()
    lonely = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.comp for r in found} == {x: find(x) for x in parent if x not in lonely}


def test_unsettled_components_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    assert {r.comp for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="settled"):
        connected_components(chain, max_rounds=2)


def test_license_base_equals_brute_force(docs, texts):
    for r in queries()["op2_license_scan"](docs.sparkSession, "/root/testdata/sf0.001").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(LOW))
        at = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def brute_license(text, chosen):
    """(labels, score) by trying each rule at each of its anchors' places and comparing all pairs of matches."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    found = []
    for no, r in enumerate(chosen):
        for i, w in enumerate(words):
            if w == r["anchor"]:
                left = re.search(f"(?: |^){r['before']}$", "".join(x + " " for x in words[:i])) if r["before"] else re.match("", "")
                right = re.match(r["after"], "".join(x + " " for x in words[i + 1 :]))
                if left and right:
                    found.append((i - left[0].lstrip().count(" "), -(i + 1 + right[0].count(" ")), -r["priority"], no))
    found.sort()
    kept = [m for k, m in enumerate(found) if not any(o[1] <= m[1] and o[2] <= m[2] for o in found[:k])]
    base = [m for m in found if chosen[m[3]]["base"]]
    return ",".join(sorted({chosen[m[3]]["label"] for m in kept + base})), max((chosen[m[3]]["confidence"] for m in kept), default=0.0)


LICENSES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "SPDX-License-Identifier: BSD 3": "bsd-3",
    "SPDX-License-Identifier: Apache-2.0": "apache-2",
    "// SPDX-License-Identifier: GPL-2.0-only": "gpl-2",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "Under the MIT License, under the mit license": "mit",
    "Distributed under the Mozilla Public License v 2.0": "mpl-2",
    "creative commons attribution share alike": "cc-by-sa",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "all rights reserved": "all-rights-reserved",
    "Apache-License version 2 and cc by-nc": "apache-2,cc-by-nc",
    "permit license": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.": "apache-2",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later": "gpl-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "He was hereby granted a licence to drive; the mit and the gpl stood in the general public": "",
    "The general public, a mozilla, an eclipse and an artistic boost under the domain": "",
    "GNU AGPLv3 or the GNU Lesser General Public Licence 2.1": "agpl-3,lgpl-2.1",
}


def test_license_rules_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")
    assert [r.labels for r in scan_licenses(df).orderBy("doc_id").collect()] == list(LICENSES.values())


def test_license_labels_equal_brute_force(spark, docs, texts):
    """All documents, and texts of the signatures' own words in random order, in which matches overlap and nest."""
    random.seed(11)
    chosen = rules()
    pool = [re.sub(r"[{}|@?*]|\[[^]]*\]", " ", x).split() for _, _, x in SIGNATURES]
    some = [" ".join(w for p in random.choices(pool, k=random.randint(1, 6)) for w in p[: random.randint(1, len(p) + 3)]) for _ in range(300)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(some)], "doc_id long, text string"))
    every = texts | {10**6 + k: t for k, t in enumerate(some)}
    for r in scan_licenses(more).collect():
        assert (r.labels, r.score) == brute_license(every[r.doc_id], chosen)


def test_license_suppression_and_order(spark):
    """An inner match of no higher priority goes; one of a higher priority stays."""
    made = [*rule("inner-high", "@b", 3, 0.9), *rule("outer", "a @b c", 2, 0.5), *rule("inner-low", "@c", 1, 1.0), *rule("same", "a b @c", 2, 0.7)]
    df = spark.createDataFrame([(1, "a b c"), (2, "c")], "doc_id long, text string")
    rows = scan_licenses(df, rule_list=made).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in rows] == [("inner-high,outer", 0.9), ("inner-low", 1.0)]
    assert len(rules()) > 200 and all(r.labels == "" for r in scan_licenses(df, rule_list=[]).collect())


def test_license_of_odd_rows(odd):
    rows = scan_licenses(odd.withColumnRenamed("kept", "score")).collect()
    assert len(rows) == 7 and {r.n_words for r in rows} == {0, 1, 5, 12000}
    assert scan_licenses(odd.limit(0)).count() == 0


def test_quality_base_equals_brute_force(docs, texts):
    rows = quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def brute_fences(rows):
    """(lang, source, measure) -> fence, and the raw ones by level, from rows with _lang, _source and m_*."""
    groups = defaultdict(list)
    for r in rows:
        for key in ((0, r["_lang"], r["_source"]), (1, r["_lang"], ""), (2, "", "")):
            for name in MEASURES:
                groups[(*key, name)].append(r[f"m_{name}"])

    def raw(v):
        v = sorted(v)
        mid, top = (next(x for k, x in enumerate(v, 1) if k >= len(v) * p) for p in (0.5, 0.75))
        return len(v), top + 3 * (top - mid)

    own = {k: raw(v) for k, v in groups.items()}
    drawn = lambda a, to: (a[0] * a[1] + 100 * to) // (a[0] + 100)
    return {(l, s, m): drawn(x, drawn(own[1, l, "", m], own[2, "", "", m][1])) for (level, l, s, m), x in own.items() if level == 0}, own


def test_quality_fences_equal_brute_force(docs):
    held = measure(docs, docs["text"], {"doc_id": docs["doc_id"], "_lang": docs["lang"], "_source": docs["source"]})
    rows = held.collect()
    want, own = brute_fences(rows)
    raw = quantile_fences(sketch(held, "_lang", "_source"))
    assert {(r.level, r._lang, r._source, r.m): (r.n_docs, r.raw) for r in raw.collect()} == own
    assert {(r._lang, r._source, r.m): r.fence for r in fences(raw).collect()} == want
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    for r in rows:
        inside = not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        for m, (count, trials, scale) in MEASURES.items():
            expected = r[trials] * want[r._lang, r._source, m] / scale
            inside &= (r[count] - expected) <= 4 * (expected + 1) ** 0.5 + 1e-9
        assert kept[r.doc_id] == inside


def test_quality_fences_follow_the_group(spark):
    """The same text passes where its like is usual, and fails where it is not: no fixed cutoff gives both."""
    rng = random.Random(7)
    text = lambda share: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(1000)) + ("#" if rng.random() < share else "") for _ in range(120))
    rows = [(k, text(0.0), "en", "prose", 0) for k in range(400)] + [(1000 + k, text(0.3), "en", "code", 0) for k in range(400)]
    rows += [(5000, rows[400][1], "en", "prose", 0), (5001, rows[400][1], "en", "code", 0), (5002, rows[400][1], "en", "tiny", 0), (5003, rows[0][1], "en", "tiny", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    assert all(kept[k] for k in range(400)) and sum(kept[1000 + k] for k in range(400)) >= 396
    assert not kept[5000] and kept[5001] and kept[5002] and kept[5003]
    held = measure(df, df["text"], {"_lang": df["lang"], "_source": df["source"]})
    found = {(r._source, r.m): r.fence for r in fences(quantile_fences(sketch(held, "_lang", "_source"))).collect()}
    assert found["prose", "symbols"] < found["code", "symbols"] and found["prose", "symbols"] != found["tiny", "symbols"]


def test_quality_of_odd_rows(odd):
    rows = quality_rules(odd).collect()
    assert len(rows) == 7 and not any(r.kept for r in rows) and odd.drop("kept", "N_Words").columns == quality_rules(odd).columns[:-7]
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 5), (1, 0), (2, 0), (3, 1), (3, 1), (5, 12000), (6, 0)]
    assert quality_rules(odd.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classes(docs, labels.where("doc_id % 2 = 0"), keep=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r.accepted == (r.quality == 1) for r in rows)
    assert right >= 0.97 * len(rows)
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.accepted for r in clean) >= 0.99 * len(clean)


def test_classifier_shrinks_small_sites(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "'big' as source")
    bad = docs.join(labels.where("quality = 0"), "doc_id").selectExpr("doc_id + 200000 as doc_id", "text", "lang", "if(doc_id % 7 = 0, concat('one', doc_id), 'poor') as source")
    rows = quality_classes(good.union(bad).union(bad), labels.selectExpr("doc_id + 100000 as doc_id", "quality").union(labels.selectExpr("doc_id + 200000", "quality"))).collect()
    p = {r.source: r.p_path for r in rows}
    share = sum(r.p_text for r in rows) / len(rows)
    ones = [v for k, v in p.items() if k.startswith("one")]
    assert p["poor"] < share < p["big"] and all(p["poor"] < x < share for x in ones)


def brute_posteriors(rows, weight):
    """(p_path, p_quality) of rows (p_text, host, path), from the definitions: each document without itself."""
    total = sum(r[0] for r in rows) / len(rows)
    paths, hosts = defaultdict(list), defaultdict(list)
    for p, h, k in rows:
        paths[h, k].append(p)
        hosts[h].append(p)

    def strength(groups, towards):
        n, g = sum(map(len, groups.values())), len(groups)
        within = sum(np.var(v) * len(v) for v in groups.values()) / (n - g)
        spread = sum(len(v) * (np.mean(v) - towards(k)) ** 2 for k, v in groups.items())
        between = (spread - (g - 1) * within) / (n - sum(len(v) ** 2 for v in groups.values()) / n)
        return min(max(within / between, 1.0), 1e6) if between > 0 else 1e6

    kh = strength(hosts, lambda h: total)
    kp = strength(paths, lambda k: (sum(hosts[k[0]]) + kh * total) / (len(hosts[k[0]]) + kh))
    odds = lambda p: np.log(p / (1 - p))
    out = []
    for p, h, k in rows:
        p_host = (sum(hosts[h]) - p + kh * total) / (len(hosts[h]) - 1 + kh)
        p_path = (sum(paths[h, k]) - p + kp * p_host) / (len(paths[h, k]) - 1 + kp)
        own = min(max(p, 1e-6), 1 - 1e-6)
        out.append((p_path, 1 / (1 + np.exp(-(odds(own) + weight * (odds(min(max(p_path, 1e-6), 1 - 1e-6)) - odds(total)))))))
    return out


def sites(spark, sf_dir):
    """Documents dealt out by their labels: a host of mostly poor ones, one of good ones, and hosts of one document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = docs.join(labels, "doc_id")
    return both.selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'a', 'b') as lang", "case when doc_id % 11 = 0 then concat('one', doc_id) when quality = 0 or doc_id % 9 = 0 then 'poor' else 'good' end as source"), labels


def test_classifier_equals_brute_force(spark, sf_dir):
    docs, labels = sites(spark, sf_dir.replace("0.001", "0.01"))
    rows = quality_classes(docs, labels).collect()
    want = brute_posteriors([(r.p_text, r.source, r.lang) for r in rows], 0.5)
    assert [(r.p_path, r.p_quality) for r in rows] == [pytest.approx(w, rel=1e-6) for w in want]
    assert all(r.accepted == (r.p_quality >= 0.5) for r in rows)


def test_site_evidence_decides_between_like_texts(spark, sf_dir):
    """The same doubtful text is accepted on a good site and rejected on a poor one; on a site of its own, its text alone decides."""
    docs, labels = sites(spark, sf_dir.replace("0.001", "0.01"))
    symbols = lambda k: " ".join(["alpha", "beta", "gamma", "delta"] * 3 + ["word#"] * k + ["omega", "sigma"] * 5)
    tried = [(100_000 + 10 * k + j, symbols(k), "b", host) for k in range(12) for j, host in enumerate(["good", "poor", f"own{k}"])]
    rows = quality_classes(docs.unionByName(spark.createDataFrame(tried, "doc_id long, text string, lang string, source string")), labels).collect()
    by = {r.doc_id: r for r in rows}
    assert all(by[100_000 + 10 * k].p_quality > by[100_001 + 10 * k].p_quality for k in range(12))
    plain = {r.doc_id: r for r in quality_classes(docs, labels, site_weight=0.0).collect()}
    assert all(plain[k].accepted == (plain[k].p_text >= 0.5) for k in plain)
    # Labels of which many are wrong leave the text's evidence weak; then the site's decides where the text's is even.
    noisy = labels.selectExpr("doc_id", "if(doc_id % 20 < 9, 1 - quality, quality) as quality")
    weak = quality_classes(docs, noisy).collect()
    up, down = ([r for r in weak if r.accepted == x and (r.p_text >= 0.5) != x] for x in (True, False))
    assert up or down
    assert all(r.source != "poor" for r in up) and all(r.source != "good" for r in down)


def test_classifier_of_odd_rows(odd, spark, sf_dir):
    none = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, quality int")
    rows = quality_classes(odd.withColumnRenamed("kept", "accepted"), none).collect()
    assert len(rows) == 7 and all(0 <= r.p_quality <= 1 for r in rows)
    assert quality_classes(odd.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def codec():
    return Codec(load_ranks(public_tokenizers.path(BYTE_BPE)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(codec.tokens)}, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.hash.slot(t) for t in codec.tokens) == list(range(len(codec.tokens)))
    assert PerfectHash([b"a"]).slot(b"zzz") == 0


def test_bpe_equals_the_library(codec, reference_encoding):
    random.seed(4)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x301, 0x180E, 0xFEFF]]
    for _ in range(1500):
        t = "".join(random.choice(pool if random.random() < 0.4 else " \n\tabcdeghist'012") for _ in range(random.randint(0, 50)))
        ids = codec.encode_batch([t])[0]
        assert ids.tolist() == reference_encoding.encode_ordinary(t) and codec.decode(ids) == t.encode()
    t = "ab" * 20000 + " " * 3000 + "x"
    assert codec.encode_batch([t, "", t])[2].tolist() == reference_encoding.encode_ordinary(t)
    assert max(map(len, codec.cache)) <= 48


def test_bpe_query(spark, sf_dir, texts, reference_encoding):
    rows = queries()["op5_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_of_odd_rows(odd):
    rows = encode_texts(odd, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN).collect()
    assert len(rows) == 7 and all(len(r.ids) == r.n_tokens for r in rows) and sum(r.n_tokens == 0 for r in rows) == 2
    assert encode_texts(odd.limit(0), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN).count() == 0


def test_word_tokens_equal_the_library():
    path = public_tokenizers.path(WORD_BPE)
    own, other = WordTokenizer(path), Tokenizer.from_file(path)
    other.encode_special_tokens = True
    random.seed(5)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x2000, 0x2070), 0x4E00, 0x1F600, 0x301, 0x3A3, 0x130]]
    some = ["".join(random.choice(pool if random.random() < 0.2 else " \n\tabcdefgh'st12É<>/w|") for _ in range(random.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> </w>"]
    assert [x.tolist() for x in own.encode_batch(some)] == [other.encode(t, add_special_tokens=False).ids for t in some]


def test_known_words_are_bounded_by_their_size():
    own, other = WordTokenizer(public_tokenizers.path(WORD_BPE)), Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for k in range(12):
        t = chr(97 + k) * 1_500_000 + " end"
        assert own.encode_batch([t])[0].tolist() == other.encode(t, add_special_tokens=False).ids and own.chars < 20_000_000


def check_pieces(rows, ids):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length > 0 and r.ids_crc32 == zlib.crc32(own.tobytes())
    for k, v in ids.items():
        at = 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(v)
    padding = 0
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and len(v) <= 512
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing_query(spark, sf_dir, texts):
    other = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    ids = {k: np.array([*other.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    assert check_pieces(queries()["op6_vector_packing"](spark, sf_dir).collect(), ids) == 0


def test_packing_of_odd_rows(odd):
    rows = pack_documents(odd, public_tokenizers.path(WORD_BPE)).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total[1] == total[2] == 1 and total[3] == 4 and pack_documents(odd.limit(0), public_tokenizers.path(WORD_BPE)).count() == 0


def test_packing_of_instruction_data(spark, sf_dir):
    """Answers after the user's turns, on which no loss is taken: tokens, segments and loss each end sequences, and none is padded."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").selectExpr("conv_id", "turn + 1 as turn", "text as prompt")
    data = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").selectExpr("conv_id * 1000 + turn as doc_id", "text", "prompt")
    more = spark.createDataFrame([(10**6 + k, "word " * (10 + 40 * (k % 9)), "ask " * (300 if k % 3 else 0)) for k in range(150)], "doc_id long, text string, prompt string")
    data = data.union(more).repartition(1)
    other = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    given = data.collect()
    own = {r.doc_id: [other.encode(x or "", add_special_tokens=False).ids for x in (r.prompt, r.text)] for r in given}
    ids = {k: np.array([*a, *b, 2], "<u4") for k, (a, b) in own.items()}
    rows = pack_documents(data, public_tokenizers.path(WORD_BPE), prompt_col="prompt", segments=12, loss=2048).collect()
    assert len(given) == len(ids) and check_pieces(rows, ids) == 0
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        first = max(1, len(own[r.doc_id][0]))
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, first))
    total = [(sum(r.length for r in v), len(v), sum(r.loss_tokens for r in v)) for v in sequences.values()]
    assert all(n <= 4096 and k <= 12 and x <= 2048 for n, k, x in total)
    assert any(k == 12 for _, k, _ in total)
    count = lambda **limits: pack_documents(data, public_tokenizers.path(WORD_BPE), prompt_col="prompt", **limits).select("sequence_id").distinct().count()
    assert count() < count(segments=12) and count() < count(loss=2048)


def test_packer_keeps_all_limits():
    random.seed(6)
    packer = Packer(tokens=100, segments=4, loss=50, pool=16)
    items = [np.random.default_rng(k).random(random.randint(1, 250)) < 0.5 for k in range(300)]
    pieces = [p for k, m in enumerate(items) for p in packer.add(k, m)] + list(packer.finish())
    sequences, got = defaultdict(list), defaultdict(list)
    for k, start, n, s, offset in pieces:
        sequences[s].append((offset, n, int(items[k][start : start + n].sum())))
        got[k].append((start, n))
    for v in sequences.values():
        assert sum(n for _, n, _ in v) <= 100 and len(v) <= 4 and sum(x for _, _, x in v) <= 50
        at = 0
        for offset, n, _ in sorted(v):
            assert offset == at
            at += n
    for k, m in enumerate(items):
        at = 0
        for start, n in sorted(got[k]):
            assert start == at
            at += n
        assert at == len(m)


def chained(values):
    """Spark's xxhash64 of several numbers, as a signed one."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text):
    """[(place, hash)] by the definition: windows of eight units whose smallest inner pair is the first or the last."""
    units = [START] * 7 + [chained([u]) for u in re.findall(r"[^\x20\x09-\x0D\u2E80-\U0010FFFF]{1,24}|[\u2E80-\U0010FFFF]", text)]
    pairs = [chained(units[i : i + 2]) for i in range(len(units) - 1)]
    return [(i, chained(units[i : i + 8]) & 0x7FFFFFFF) for i in range(len(units) - 7) if min(pairs[i : i + 7]) in (pairs[i], pairs[i + 6])]


def brute_fingerprint(text):
    found = brute_anchors(text)
    return " ".join(f"{i - (found[k - 1][0] if k else 0):x}{h:08x}" for k, (i, h) in enumerate(found))


def brute_likeness(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries()["op9_syncmer_fingerprints"](spark, sf_dir).collect()}
    order = sorted(texts)
    for k, after in zip(order, order[1:] + order[:1], strict=True):
        t, r = texts[k], rows[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        own, changed, other = map(brute_fingerprint, (t, edited, texts[after]))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed)
        assert r.near_edited == pytest.approx(brute_likeness(own, changed)) and r.near_next == pytest.approx(brute_likeness(own, other))
    large = [r for k, r in rows.items() if len(texts[k]) >= 100]
    assert sum(r.near_edited > r.near_next for r in large) >= 0.98 * len(large)


def test_fingerprints_of_any_length_and_script(spark):
    """A short text inside a long one shares anchors with it; ideographs and unbroken texts have as many anchors as others; ties do no harm."""
    random.seed(8)
    word = lambda: "".join(random.choice(string.ascii_lowercase) for _ in range(6))
    short = " ".join(word() for _ in range(40))
    rows = [(1, " ".join([*(word() for _ in range(100)), short, *(word() for _ in range(30))])), (2, short), (3, "".join(chr(0x4E00 + random.randrange(3000)) for _ in range(200)))]
    rows += [(4, "".join(random.choice(string.ascii_letters) for _ in range(2000))), (5, "same " * 50), (6, "one two"), (7, "  \n")]
    found = {r.doc_id: r for r in fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k].fingerprint == brute_fingerprint(t) for k, t in rows) and found[7].fingerprint == ""
    assert found[1].near_next > 0.03 and all(found[k].near_edited > 0.1 for k in (1, 2, 3, 4)) and len(found[3].fingerprint.split()) > 40
    assert 0 < found[6].near_edited < 1 and found[5].near_edited > 0


def test_fingerprints_share_passages(spark):
    words = [f"word{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(["other"] * 7 + words[100:300] + [f"x{i}" for i in range(50)])
    rows = fingerprint_pairs(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].fingerprint == rows[2].fingerprint and rows[2].near_next == 1.0 and 0.2 < rows[0].near_next < 0.8


def test_fingerprints_of_odd_rows(odd):
    rows = fingerprint_pairs(odd).collect()
    assert len(rows) == 7 and sum(r.doc_id is None for r in rows) == 1 and fingerprint_pairs(odd.limit(0)).count() == 0
