"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, no rows."""

import base64
import gzip
import hashlib
import itertools
import json
import random
import re
import unicodedata
import urllib.parse
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, fingerprints, langid, licenses, linededup, neardup, packing, secretscan, sharding, shingles, topk
from graphloom.llm.components import components
from graphloom.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, ids string, key string"
ODD = [None, "", " ", "\n\n", "a", "Ünïcödé 中文 😀 \x1c\x85 x", "z" * 3000, "w " * 3000]


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_set(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    v = bpe.load_vocabulary(BYTE_VOCABULARY)
    assert bpe.PATTERN == P.PATTERN
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})
    rng = random.Random(1)
    alphabet = "aab 'strell\n\t  éß中文\x1c\x85123😀!?#"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)] + ["<|endoftext|>"]
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(table(spark, texts), BYTE_VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.bpe_encode(table(spark, texts), BYTE_VOCABULARY)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.bpe_decode(ids, BYTE_VOCABULARY).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert bpe.bpe_encode(table(spark, []), BYTE_VOCABULARY).count() == 0


def near_texts(rng):
    texts = list(ODD)
    for _ in range(12):
        base = words(rng, rng.randrange(5, 150)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts + texts[8:20]


@pytest.mark.parametrize(("percent", "bands"), [(85, 24), (80, 40)])
def test_near_duplicates_equal_brute_force(spark, percent, bands):
    texts = near_texts(random.Random(percent))
    sets = [brute_set(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    df = table(spark, texts)
    extra = spark.createDataFrame([(None, texts[9], "en", "s", 1, "", "", "", "")], SCHEMA)
    rows = neardup.near_duplicates(df.union(extra), percent=percent, bands=bands).collect()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i), i
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]


def test_near_copies_meet_once_in_a_round(spark, monkeypatch):
    """Near copies share most of their buckets; a pair comes from one of them, and what is not linked in the end was compared."""
    rng, found, promising = random.Random(11), [], neardup._promising
    monkeypatch.setattr(neardup, "_promising", lambda *a: found.append(promising(*a)) or found[-1])
    base = words(rng, 150).split()
    texts = [" ".join(f"x{rng.random()}" if rng.random() < rate else w for w in base) for rate in (0.0, 0.005, 0.02, 0.03) for _ in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, texts), percent=85, bands=28).collect()}
    sets, label = [brute_set(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            least, most = sorted((label[a], label[b]))
            label = [least if x == most else x for x in label]
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 100
    for pairs in found:
        rows = [(r["hub"], r["node"]) for r in pairs.collect()]
        assert len(rows) == len({frozenset(r) for r in rows})


def test_near_duplicates_without_rows_and_with_repeated_rows(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    one = table(spark, ["a b c d e f g"])
    assert {tuple(r) for r in neardup.near_duplicates(one.union(one)).collect()} == {(0, 3, 0, True)}


def test_bayesian_bounds_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    steps = neardup.least_matches(0.85, neardup.HASHES, neardup.MISS)
    hits = rng.random((20_000, neardup.HASHES)) < 0.85 + 0.15 / 256
    assert np.mean([(hits[:, :n].sum(axis=1) < m).any() for n, m in [steps[0]]]) == 0
    assert sum((hits[:, :n].sum(axis=1) < m).sum() for n, m in steps) <= 8
    low = rng.random((2000, neardup.HASHES)) < 0.6
    assert (low.sum(axis=1) >= steps[-1][1]).mean() < 0.01


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (50, 60), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}
    assert components(links.limit(0)).count() == 0


def test_components_of_many_parts(spark, monkeypatch):
    from graphloom.llm import components as module

    monkeypatch.setattr(module, "LINKS_PER_TASK", 5)
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + rng.randrange(40)) for _ in range(40)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)]
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    while any(want[a] != want[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    links = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in pairs], "a binary, b binary").repartition(6)
    got = {int(r["node"]): int(r["component"]) for r in components(links).collect()}
    assert got == want


def secret_cases():
    s = "x password = 'hunter2hunter2' y"
    q = lambda t: urllib.parse.quote(t, safe="")
    b = lambda t: base64.b64encode(t).decode()
    return s, ["".join("\\u%04x" % ord(c) for c in s), q(s), q(q(s)), b(s.encode()), b(gzip.compress(s.encode())), b(b(("é " + s).encode()).encode()), b(zlib.compress(s.encode())), q(b(s.encode()))]


def test_secret_scan_base_and_layers(spark):
    import re

    s, wrapped = secret_cases()
    texts = ODD + [s, "token=abc token: abcdefgh", "AKIA" + "A" * 11 + " AKIA" + "B" * 12, "f" * 31 + " " + "e" * 32, "PASSWD\"  :  'a/b+c.d_e-f=='", "ſecret=abcdefgh1"] + ["é pre " + w + " post" for w in wrapped]
    got = {r["doc_id"]: r for r in secretscan.scan_secrets(table(spark, texts)).collect()}
    patterns = [(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    for i, t in enumerate(texts):
        base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in re.finditer(p, t or "", re.ASCII) if ok(m))
        assert [got[i][n] for n in ("n_assign", "n_access", "n_hex")] == [sum(b[1] == k for b in base) for k in range(3)], t
        text = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))
    for i in range(len(texts) - len(wrapped), len(texts)):
        assert got[i]["spans"].startswith("assign:") and "hunter2" not in secretscan.redact(texts[i], secretscan.find_secrets(texts[i])[1])
    clean = secretscan.redact_secrets(table(spark, texts)).collect()
    assert [r["text"] for r in clean if r["doc_id"] < len(ODD)] == ODD
    assert not any("hunter2" in (r["text"] or "") for r in clean)


def test_every_copy_of_an_encoded_secret_counts(spark):
    b = lambda t: base64.b64encode(t).decode()
    one, squeezed = b(b"password=hunter2hunter2"), b(zlib.compress(b"password=hunter2hunter2"))
    texts = [f"a {one} b {one} c", f"a {one} b {b(one.encode())} c {one}", f"a {squeezed} b {squeezed} c", f"a {one} b {urllib.parse.quote('é ' + one, safe='')}"]
    for text, n in zip(texts, (2, 3, 2, 2)):
        spans = secretscan.find_secrets(text)[1]
        blobs = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/=]{30,}", text)]
        assert len(spans) == n and all(any(x <= a and b <= y for a, b, _ in spans for x, y in [blob]) for blob in blobs), text
    clean = [r["text"] for r in secretscan.redact_secrets(table(spark, texts)).orderBy("doc_id").collect()]
    assert clean[0] == "a [SECRET]= b [SECRET]= c" and clean[2].count("[SECRET]") == 2 and not any(one[:12] in c or squeezed[:12] in c for c in clean)


def test_encoded_layers_are_read_to_their_end():
    import bz2

    secret = b"password=hunter2hunter2"
    b = lambda t: base64.b64encode(t).decode()
    long = b"some words again, " * 1_200_000  # over 20 MB
    wrapped = lambda t, end: end.join(b(t)[i : i + 64] for i in range(0, len(b(t)), 64))
    noise = bytes(random.Random(5).randrange(256) for _ in range(200))
    blobs = [
        b(zlib.compress(long + secret)), b(gzip.compress(gzip.compress(long + secret))), b(bz2.compress(long + secret)),
        b(gzip.compress(b"one") + gzip.compress(secret)), b(bz2.compress(b"one") + bz2.compress(secret)), b(gzip.compress(b"one") + b"\0" * 9 + gzip.compress(secret)),
        *(b(("é" + odd + " ").encode() + secret) for odd in "\u00a0\ufeff\u200b\u00ad\f\u3000\0"), b(b"\xff\xfe " + secret),
        *("path/to/x"[:n] + "/" + b(b"some " + secret + b" more") for n in range(5, 9)), "path/to/xy/" + b(gzip.compress(secret)),
        wrapped(b"first " * 20 + secret + b" last" * 20, "\n"), wrapped(noise + secret + noise, "\r\n\t "), wrapped(gzip.compress(noise + secret), "\n"), "word\n" + wrapped(gzip.compress(noise + secret), "\n"),
        b(zlib.compress(b"some words, " * 30_000 + b(zlib.compress(secret)).encode())),
    ]
    for blob in blobs:
        text = f"é {blob} post"
        spans = secretscan.find_secrets(text)[1]
        assert spans and all(2 <= x < y <= 2 + len(blob) and kind == 0 for x, y, kind in spans), blob[:80]
    assert secretscan.find_secrets("é " + b(zlib.compress(long)) + " post")[1] == []


def test_cuts_change_nothing():
    rng = random.Random(6)
    parts = ["password", " ", "  ", ":", "=", "%3D", "%20", "\\u003d", "'", '"', "hunter2hunter2", "z a", "e a", ",", "\n", "k", "AKIA", "B" * 12, "0a" * 16, base64.b64encode(b"token=abcdefgh").decode()]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(12))
        data = text.encode()
        pieces = list(secretscan._pieces(iter([data[i : i + 9] for i in range(0, len(data), 9)])))
        kinds = lambda t: {k for *_, k in secretscan.find_secrets(t)[1]}
        assert "".join(pieces) == text and set().union(*map(kinds, pieces)) == kinds(text), text


def test_licenses(spark):
    mit = licenses.LICENSES[0][1]
    texts = ODD + [mit, "Copyright (c) 2020 Someone\n" + mit.upper().replace("license", "licence"), "text\nReleased under the MIT Licence!\nmore", mit + " extra"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, texts)).collect()}
    n = len(ODD)
    assert [got[n + i]["whole"] for i in range(4)] == ["MIT", "MIT", None, None]
    assert got[n + 2]["licenses"] == "MIT" and got[n + 3]["licenses"] == ""
    assert got[0]["text_digest"] is None and all(got[i]["licenses"] == "" for i in range(n))
    assert licenses.scan_licenses(table(spark, [])).count() == 0
    copies = table(spark, [mit, "x"]).withColumn("doc_id", F.lit(1)).where("text <> 'x'")
    assert [r["whole"] for r in licenses.scan_licenses(reduce(lambda x, y: x.union(y), [copies] * 3)).collect()] == ["MIT"] * 3
    twice = table(spark, ["Some licence licence here", "some license LICENSE here"]).select("doc_id", licenses.canonical(F.col("text")).alias("c")).collect()
    assert {r["c"] for r in twice} == {"some license license here"}
    ties = licenses.scan_licenses(table(spark, ["one notice"]), [("B", "One notice!"), ("A", "one  NOTICE")]).first()
    assert (ties["whole"], ties["licenses"]) == ("A", "A")


def test_public_licenses(spark):
    texts = {name: text for name, text in licenses.LICENSES if "\n" in text}
    bsd = texts["BSD-2-Clause"].replace("\nTHIS SOFTWARE IS PROVIDED", licenses.BSD3)
    apache = (licenses.Path(licenses.__file__).parent / "license_texts" / "Apache-2.0").read_text()
    cases = [
        ("MIT License\n\nCopyright (c) 2020 X\n\n" + texts["MIT"], "MIT"), ("The MIT License (MIT)\nCopyright (c) <holder>\n" + texts["MIT"], "MIT"), ("Copyright Some One\n" + texts["MIT"], "MIT"),
        ("BSD 3-Clause License\nCopyright (c) 2021, X\nAll rights reserved.\n" + bsd, "BSD-3-Clause"), (apache, "Apache-2.0"), (" ".join(apache.split()), "Apache-2.0"), (apache.partition("END OF TERMS")[0], "Apache-2.0"),
    ]
    lines = [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("licensed under CC BY", ""), ("copyright notice", "")]
    scan = lambda x: {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, x), licenses.public(), copyright_line=licenses.ANY_COPYRIGHT_LINE).collect()}
    got = scan([t for t, _ in cases] + [f"some text\n{t}\nmore" for t, _ in lines])
    assert [got[i]["whole"] for i in range(len(cases))] == [name for _, name in cases]
    assert [got[len(cases) + i]["licenses"] for i in range(len(lines))] == [name for _, name in lines]
    assert dict(licenses.public()).keys() >= {"GPL-2.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}


def brute_lines(texts, least):
    owner = {}
    for i, t in enumerate(texts):
        if t is not None:
            owner.setdefault(t, i)
    size = lambda ls: sum(len(x.split()) for x in ls)
    seen, gone = {}, {i: set() for i in range(len(texts))}
    for t, i in sorted(owner.items(), key=lambda x: x[1]):
        ls = t.split("\n")
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if size(ls[a:b]) >= least:
                    if tuple(ls[a:b]) in seen:
                        gone[i] |= set(range(a, b))
                    else:
                        seen[tuple(ls[a:b])] = (i, a)
    out = []
    for i, t in enumerate(texts):
        if t is None or size([t]) < least:
            out.append(t)
        elif owner[t] != i:
            out.append("")
        else:
            out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [words(rng, rng.choice([0, 1, 2, 3, 5, 12])) for _ in range(14)]
    texts = ODD + ["\n".join(rng.choice(pool) if rng.random() < 0.8 else words(rng, 4, 9999) for _ in range(rng.randrange(1, 15))) for _ in range(40)]
    texts += texts[10:14] + ["\n".join(["same line of three"] * 20)]
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df, 10).collect()}
    want = brute_lines(texts, 10)
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert got[3]["source"] == "s"
    assert linededup.dedup_lines(table(spark, [])).count() == 0
    twice = linededup.dedup_lines(df.where("doc_id = 20").union(df.where("doc_id = 20"))).collect()
    assert len(twice) == 2 and twice[0]["text"] == twice[1]["text"]


def test_line_dedup_replaces_clashing_names(spark):
    df = table(spark, ["a b c\nd", None]).withColumn("n_lines", F.lit("x")).withColumn("n_removed", F.lit(9.5))
    rows = linededup.dedup_lines(df).orderBy("doc_id").collect()
    assert rows[0].asDict().keys() == {*df.columns} and [(r["n_lines"], r["n_removed"]) for r in rows] == [(2, 0), (0, 0)]


def test_very_long_texts(spark):
    """Several MB in one text, among short ones, in every operator that reads texts."""
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(21)
    lines = [words(rng, 12, 4000) for _ in range(30_000)]
    long = "\n".join(lines) + "\npassword=hunter2hunter2 " + "x" * 2_000_000
    texts = ["short one", long, long + " more", "\n".join(lines[5:9]), None]
    df = table(spark, texts)
    v = bpe.load_vocabulary(BYTE_VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(df, BYTE_VOCABULARY).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    head = "\n".join(lines)
    assert v.encode(head) == enc.encode_ordinary(head)
    spans = {r["doc_id"]: r["spans"] for r in secretscan.scan_secrets(df).collect()}
    at = long.index("password")
    assert spans[1] == f"assign:{at}:{at + 23}" and spans[0] == ""
    lined = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert lined[1]["n_removed"] == 0 and lined[2]["n_removed"] == 30_000 and lined[3]["text"] == ""
    pieces = packing.pack_documents(df, WORD_VOCABULARY).where("doc_id = 1").agg(F.sum("length"), F.max("piece")).first()
    n = len(Tokenizer.from_file(WORD_VOCABULARY).encode(head + "\npassword=hunter2hunter2", add_special_tokens=False).ids)
    assert pieces[0] > n and pieces[1] == -(-pieces[0] // 2048) - 1
    found = langid.identify(df, langid.train(df)).where("doc_id = 1").first()
    assert found["lang_pred"] == "en"
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert groups == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
    prints = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert prints[2]["near_next"] > 0.95 and prints[1]["n_chars"] == len(long)
    placed = sharding.assign_shards(df, shards=2).collect()
    assert sorted(r["doc_id"] for r in placed) == [0, 1, 2, 3, 4]


def test_sharding(spark, tmp_path):
    texts = ODD + ["copy"] * 100 + [str(i) for i in range(55)]
    df = table(spark, texts)
    rows = sharding.assign_shards(df, shards=8, bucket_bytes=1024).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts))) and all(texts[r["doc_id"]] == r["text"] for r in rows)
    for k in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (len(texts) // 8, len(texts) // 8 + 1)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order)
    other = sharding.assign_shards(df.repartition(5, "text").orderBy(F.rand(3)), shards=8, bucket_bytes=1024).collect()
    place = lambda rs: {r["doc_id"]: (r["shard"], r["slot"]) for r in rs}
    assert place(other) == place(rows)  # other files, same shards
    assert place(sharding.assign_shards(df, shards=8, seed=1, bucket_bytes=1024).collect()) != place(rows)
    sharding.write_shards(df, str(tmp_path / "out"), shards=3, rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts)) and {r["shard"] for r in back} == {0, 1, 2}
    assert sharding.assign_shards(table(spark, [])).count() == 0
    one = table(spark, ["x"])
    assert sharding.assign_shards(one.union(one)).count() == 2


def test_external_shuffle_is_a_two_pass_shuffle(spark):
    """Buckets, their sizes and their beginnings by a plain loop over the same hashes."""
    df = table(spark, [str(i) for i in range(300)])
    rows = sharding.external_shuffle(df, bucket_bytes=800).collect()
    sizes = {}
    for r in rows:
        sizes[r["__bucket"]] = sizes.get(r["__bucket"], 0) + 1
    begins, total = {}, 0
    for b in sorted(sizes):
        begins[b], total = total, total + sizes[b]
    assert len(sizes) > 20 and max(sizes.values()) < 30 and total == 300
    assert all(r["__place"] == begins[r["__bucket"]] + r["__slot"] and 0 <= r["__slot"] < sizes[r["__bucket"]] for r in rows)
    assert len({r["__place"] for r in rows}) == 300


def test_sharding_of_equal_rows_clashing_names_and_maps(spark):
    same = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    shuffled = sharding.external_shuffle(same, bucket_bytes=1000).groupBy("__bucket").count().collect()
    assert sum(r["count"] for r in shuffled) == 5000 and max(r["count"] for r in shuffled) < 100
    odd = spark.range(9).select("id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("shard"), F.lit("x").alias("law"), F.lit(5).alias("slot"), F.create_map(F.lit("a"), "id").alias("m"))
    rows = sharding.assign_shards(odd, shards=2).collect()
    assert rows[0].asDict().keys() == {"id", "text", "m", "law", "shard", "slot", "grown_shard"}
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, i) for i in range(5)] + [(1, i) for i in range(4)] and all(r["m"] == {"a": r["id"]} for r in rows)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6)).round(2)
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (950, [float("nan")] * 6), (951, [1.0, None] * 3), (1000, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array((list(v) + [0.0] * 6)[:6])).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    assert set(got) == {i for i in whole if i % 50 == 0}
    for q in got:
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    few = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_sorted_lists_equal_brute_force():
    rng = np.random.default_rng(6)
    for n, d, k, spread in ((3000, 24, 5, 100), (40, 3, 5, 2), (3, 2, 5, 9), (700, 8, 1, 1), (1, 1, 2, 3)):
        x = (rng.normal(size=(n, d)) * np.linspace(spread, 1, d)).astype(np.int64)
        x[n // 2 :: 7] = x[0]  # ties
        ids = rng.permutation(n) * 3
        block = topk.SortedLists(ids, x)
        found = block.top(x[:20], ids[:20], k)
        for i, (got, scores) in enumerate(found):
            exact = sorted((-int(s), int(v)) for s, v in zip(x @ x[i], ids, strict=True) if v != ids[i])[:k]
            assert [(-s, int(v)) for s, v in zip(scores, got, strict=True)] == exact
        assert 0 <= block.read <= block.entries


def test_sorted_lists_stop_early_where_few_can_qualify():
    x = np.concatenate([np.full((5, 4), 1000), np.arange(4000).reshape(1000, 4) % 7])
    block = topk.SortedLists(np.arange(1005), x)
    got, scores = block.top(np.full((1, 4), 3), np.array([-1]), 5)[0]
    assert got.tolist() == [0, 1, 2, 3, 4] and scores == [12_000] * 5 and block.read < 0.3 * block.entries


def test_top_k_of_large_numbers_and_many_blocks(spark):
    big = spark.createDataFrame([(i, [float(2**40 + i), float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    for scale in (1, 1 << 23):  # scores and components beyond 64 bits
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(big, F.col("vec_id") == 0, scale=scale).collect()
    small = [(i, [float(2**28 + i), float(i % 3)]) for i in range(60)]
    rows = topk.top_k(spark.createDataFrame(small, "vec_id long, embedding array<double>"), F.col("vec_id") == 2, scale=2, block_rows=7).orderBy("rank").collect()
    exact = sorted((-((2**29 + 4) * (2**29 + 2 * i) + 4 * 2 * (i % 3)), i) for i in range(60) if i != 2)[:5]
    assert [(-r["score"], r["vec_id"]) for r in rows] == exact


def test_edited_fingerprints(spark):
    rng = random.Random(7)
    texts = ODD + [words(rng, 80) for _ in range(30)] + [words(random.Random(1), 60)] * 5
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table(spark, texts)).collect()}
    family = shingles.MinHash(fingerprints.HASHES)
    prints = family.signatures(shingles.shingle_lists([(t or "").encode() for t in texts], 5))
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""  # descending ids; the first follows the last
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == fingerprints.fingerprint_hex(prints[i])
        assert got[i]["near_next"] == pytest.approx(fingerprints.likeness(prints[i], prints[i - 1]))
        a, b = brute_set(t), brute_set(edited)
        if a and b:
            assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.25
    assert fingerprints.edited_fingerprints(table(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(table(spark, ["one two"])).first()["near_next"] == 1.0


def test_similar_documents(spark):
    rng = random.Random(8)
    base = words(rng, 100)
    texts = [base, base, base + " " + words(rng, 10, 9999), words(rng, 100), None]
    got = {r["doc_id"]: r["component_id"] for r in fingerprints.similar_documents(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}  # 96 of 106 shingles


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "date"])
def test_edited_fingerprints_of_other_ids(spark, kind):
    rng = random.Random(17)
    texts = [words(rng, 30) for _ in range(40)] + [None, "", "é" * 5]
    number = F.col("doc_id") * 7 % 43
    df = table(spark, texts).withColumn("doc_id", F.date_add(F.lit("2020-01-01"), number.cast("int")) if kind == "date" else F.lpad(number.cast("string"), 3, "0").cast(kind))
    df = df.union(df.where("text is null").withColumn("doc_id", F.lit(None).cast(kind)).withColumn("text", F.lit("none none none")))
    rows = df.select("doc_id", "text").collect()
    order = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"], reverse=True) + [r for r in rows if r["doc_id"] is None]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert len(got) == len(rows) == 44
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, following = r["text"] or "", after["text"] or ""
        n = len(t) // 3
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()


def test_edited_fingerprints_of_repeated_rows(spark):
    same = table(spark, ["a b c"] * 1).select(F.lit(7).alias("doc_id"), "text")
    rows = fingerprints.edited_fingerprints(reduce(lambda x, y: x.union(y), [same] * 5)).collect()
    assert len(rows) == 5 and {r["edited_sha256"] for r in rows} == {hashlib.sha256(b"a b a").hexdigest()}


def test_shingles_do_not_depend_on_grouping():
    rng = random.Random(9)
    texts = [words(rng, n).encode() for n in (0, 1, 4, 5, 6, 300)] + [b"", b" \t", b"x" * 2_000_000 + b" y z w v u"]
    together = shingles.shingle_lists(texts, 5)
    assert all((a == shingles.shingle_list(t, 5)).all() for a, t in zip(together, texts, strict=True))
    assert [len(set(a.tolist())) for a in together[:6]] == [len(brute_set(t.decode())) for t in texts[:6]]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_VOCABULARY)
    rng = random.Random(10)
    texts = ODD + [words(rng, rng.randrange(1, 1500)) for _ in range(60)] + ["Σίσυφος ΣΑΣ é", "a<|endoftext|>b", "İx"]
    rows = packing.pack_documents(table(spark, texts), WORD_VOCABULARY).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 2048))
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= total / 2048 * 1.05 + 1
    assert packing.pack_documents(table(spark, []), WORD_VOCABULARY).count() == 0


def best_fit(lengths, capacity):
    """One piece after another, the longest first, into the smallest gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize(("capacity", "rows"), [(100, 60), (2048, 10**6), (5, 7), (1, 4)])
def test_packing_rounds_equal_best_fit(spark, monkeypatch, capacity, rows):
    monkeypatch.setattr(packing, "ROWS", rows)
    rng = random.Random(capacity)
    lengths = [min(capacity, max(1, rng.choice([rng.randrange(1, capacity + 1), capacity // 3, capacity // 2 + 1, rng.randrange(1, capacity // 20 + 2), 1]))) for _ in range(400)]
    df = spark.createDataFrame([(i if i % 50 else None, n, 7, "x") for i, n in enumerate(lengths)], "doc_id long, length long, offset int, `odd.name` string")
    out = packing.pack(df.repartition(3), capacity).collect()
    assert sorted(r["length"] for r in out) == sorted(lengths) and out[0].asDict().keys() == {"doc_id", "length", "odd.name", "sequence_id", "offset"}
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= best_fit(lengths, capacity) * 1.02 + 1
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(df.withColumn("length", F.lit(capacity + 1)), capacity)
    assert packing.pack(df.limit(0), capacity).count() == 0


def test_packing_of_equal_rows(spark):
    df = spark.range(700).select(F.lit(1).alias("doc_id"), F.lit(300).cast("long").alias("length"))
    out = packing.pack(df).collect()
    assert len(out) == 700 and len({r["sequence_id"] for r in out}) == 117  # six in each


def test_tokenizer_keeps_to_its_memory(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    t = packing.WordTokenizer(WORD_VOCABULARY)
    rng = random.Random(3)
    for _ in range(30):
        texts = [words(rng, 40, 5000) + " 'll don't É12 中文 \x00\x7f\xad", "", "İx"]
        assert t.ids(texts) == [t.plain(x) for x in texts]
        assert len(t.chunks) < 100


def test_tokenizer_keeps_what_comes_again(monkeypatch):
    import tokenizers

    class Counted:
        """The tokenizer as its own model, which counts the pieces that go through its merges."""

        def __init__(self, real):
            self.real, self.model, self.merged = real, self, Counter()

        def tokenize(self, piece):
            self.merged[piece] += 1
            return self.real.model.tokenize(piece)

        def __getattr__(self, name):
            return getattr(self.real, name)

    real = tokenizers.Tokenizer.from_file(WORD_VOCABULARY)
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Files", (), {"from_file": lambda path: Counted(real)}))
    monkeypatch.setattr(packing, "CACHE_BYTES", 40_000)
    t = packing.WordTokenizer(WORD_VOCABULARY)
    rng = random.Random(4)
    rare = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(2000)]
    for k in range(0, len(rare), 20):
        text = f"frequent words, frequent (words). {' '.join(rare[k : k + 20])} {rare[k]}, {rare[k]}."
        assert t.ids([text]) == [t.plain(text)]
        kept = {**t.chunks.before, **t.chunks}
        assert sum(2 * len(c) + len(ids) + packing.ENTRY_BYTES for c, ids in kept.items()) < packing.CACHE_BYTES + 10_000
    assert set(t.tokenizer.merged.values()) == {1}  # frequent ones stay, punctuation makes no new word
    long = " ".join(f"{a}{b}" for a, b in zip(rare, rare[1:]))
    assert t.ids([long, "after it"]) == [t.plain(long), t.plain("after it")]
    assert len(t.chunks) == 2 and not t.chunks.before


def test_tokenizer_on_every_letter_before_punctuation():
    t = packing.WordTokenizer(WORD_VOCABULARY)
    letters = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and not c.isspace()]
    for k in range(0, len(letters), 500):
        text = " ".join(f"{c}. x{c}'s,{c}!? ({c})-{c}{c}" for c in letters[k : k + 500])
        text = unicodedata.normalize("NFC", text)
        assert t.ids([text]) == [t.plain(text)], k


def test_language_id(spark):
    rng = random.Random(12)
    stems = {"aa": ["ting", "wor", "ly", "the"], "bb": ["keit", "ung", "ßen", "der"], "cc": ["ción", "ñas", "los", "que"]}
    texts, langs = list(ODD) + ["123 !!!"], {}
    for name, parts in stems.items():
        for _ in range(60):
            langs[len(texts)] = name
            texts.append(" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(8, 30))))
    df = table(spark, texts, langs).withColumn("lang", F.when(F.col("doc_id") >= 9, F.col("lang")))
    model = langid.train(df.where(langid.fold() != 1), per_language=40)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [i for i in langs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.97 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.train(df, per_language=40, most_rows=30).languages == ["aa", "bb", "cc"]
    with pytest.raises(ValueError, match="labels"):
        langid.train(df, most_rows=2)
    files = langid.train(df.where(langid.fold() != 1).repartition(7).orderBy(F.rand(1)), per_language=40)
    assert (files.weights == model.weights).all()  # other files, same model
    clash = langid.identify(df.withColumn("__lang", F.lit(1)).withColumn("score", F.lit(7)), model)
    assert clash.columns.count("score") == 1 and clash.where("doc_id = 20").first()["__lang"] == 1
    twice = df.where("doc_id = 20")
    assert langid.identify(twice.union(twice), model).count() == 2 and langid.identify(df.limit(0), model).count() == 0
    one = langid.train(df.where("lang = 'aa'"))
    assert langid.identify(df, one).where("doc_id = 20").first()["lang_pred"] == "aa"


def test_codewords_are_far_apart():
    for n in (2, 4, 6, 12):
        code = langid.codewords(n)
        apart = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
        assert min(apart) >= (1 if n == 2 else code.shape[1] // 4)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(13)
    base = [words(rng, 120, 99999) for _ in range(6)]
    near = base[0].split()
    near[60] = "changed"
    texts = [*base, base[1], " ".join(near), "12345 678", base[2] + " password = hunter2hunter2", None]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    (tmp_path / "sf").mkdir()
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept = [r["doc_id"] for r in cp.language_id(spark, docs, "").collect()]
    assert sorted(kept) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    lined = cp.line_dedup(spark, docs, "")
    assert lined.columns == docs.columns and 6 not in [r["doc_id"] for r in lined.collect()]
    assert sorted(r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 5, 8, 10]
    assert "hunter2" not in json.dumps([r["text"] for r in cp.secret_scan(spark, docs, "").collect()])
    packed = cp.run(spark, str(tmp_path / "sf")).collect()
    assert {r["doc_id"] for r in packed} == {0, 1, 2, 3, 4, 5}
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]


def test_pipeline_stages_on_odd_tables(spark):
    """No rows; repeated rows, rows without an id or a text, and a long text."""
    import corpus_pipeline as cp

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rng = random.Random(23)
    body = words(rng, 60, 9999)
    rows = [(1, body, "en", "s", 9), (1, body, "en", "s", 9), (None, body, "en", None, None), (2, None, None, None, None), (3, words(rng, 40_000, 9999), "en", "s", 9), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {"language_id": 4, "line_dedup": 6, "near_dedup": 6, "secret_scan": 6}
    for name, stage in cp.STAGES:
        none = stage(spark, odd.limit(0), "")
        out = stage(spark, odd, "")
        assert none.count() == 0
        if name == "best_fit_packing":
            assert out.groupBy("doc_id").count().where("doc_id = 3").first()["count"] > 10 and out.where("doc_id is null").count() == 2
        else:
            assert none.columns == out.columns == columns and out.count() == kept[name]
