"""Each operator against a plain version of its contract, on the small tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from freightgraph.llm import chunk_dedup, near_dedup, registry
from freightgraph.llm.blocks import blocks, gram_hashes
from freightgraph.llm.chunk_dedup import dedup_substrings, repeated_spans
from freightgraph.llm.decontaminate import contaminated
from freightgraph.llm.fingerprint import fingerprint_documents, likeness, sketches
from freightgraph.llm.language_id import LanguageModel, identify_languages
from freightgraph.llm.license_scan import BASE, TEMPLATES, scan_licenses
from freightgraph.llm.packing import Encoder, lengths, pack_documents
from freightgraph.llm.sharding import feistel, shard_rows
from freightgraph.llm.near_dedup import Sets, drop_near_duplicates, exact_forest, near_duplicate_groups, shingle_sets
from freightgraph.llm.simhash import fingerprint, forest, near_duplicates
from freightgraph.llm.toxicity import VOTERS, LabelModel, ToxicityModel, classes_of, feature_counts, fit_toxicity, labelled, score_toxicity
from freightgraph.llm.url_filter import Rule, filter_urls, split_url

DATA = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


# 1 — URL filter

def test_url_parts():
    assert split_url("http://Sub.Example.ORG:80/A/b?x#y") == ("sub.example.org:80", "/A/b")
    assert split_url("a://b?c/d") == ("b", "") and split_url("x://h#/p") == ("h", "")
    assert split_url(None) == ("", "") and split_url("no scheme/at all") == ("", "") and split_url("a://") == ("", "")
    assert split_url("u://a://b/c") == ("a:", "//b/c")


def test_url_verdicts(spark):
    rows = [
        (1, "https://a.example.org/es/x"), (2, "https://notexample.org/es/"), (3, "https://example.org/en/12"), (4, "http://org/"),
        (5, "http://org"), (6, "http://x.com/fr/free-sex"), (7, "http://x.com/de/"), (8, "http://x.net/porn"), (9, "http://x.net/pornography"),
        (10, "http://x.net/casino-poker"), (11, "http://x.net/casino/casino"), (12, None), (13, ""), (14, "http://X.NET/PoRn"), (14, "http://X.NET/PoRn"),
        (15, "http://x.net/wetten-und-erotik"), (16, "http://x.net/rencontres"), (17, "http://x.net/citas/apuestas?x=1"), (18, "http://x.net/sexe-rencontres"), (19, "http://x.net/nutten"), (20, "http://x.net/essex/adultery"),
    ]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("example.org/es/", "block"), 2: ("org/", "allow"), 3: ("example.org/en/1", "block"), 4: ("org/", "allow"), 5: (None, "allow"),
        6: ("com/fr/", "allow"), 7: ("com/de/", "block"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "allow"),
        12: (None, "allow"), 13: (None, "allow"), 14: (None, "block"),
        15: (None, "block"), 16: (None, "allow"), 17: (None, "block"), 18: (None, "block"), 19: (None, "block"), 20: (None, "allow"),
    }
    own = filter_urls(spark.createDataFrame([(1, "http://a.b.net/x")], "page_id long, url string"), rules=[Rule("net/", True), Rule("b.net/x", False)])
    assert own.first()["rule"] == "b.net/x"
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, host string, key int")).count() == 0


# 2 — packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_paths()[0])


@pytest.mark.parametrize("special", [True, False])
def test_encoder_equals_tokenizer(texts, odd, special):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_paths()[0])
    tokenizer.encode_special_tokens = not special
    e = Encoder(*registry.tokenizer_paths(), special)
    tricky = ["", " ", "  a", "a  b", "a b ", "a \n b", "a\u00a0b c", " lead", "x's y'll  z", "tab\t x", "é ü 🙂 🙂", "a b\r\nc d", "<|endoftext|> x", "1 22 333 a1", "\u2003a b", "a \u2003b", "a. b, c.", "a., b", "3.5 x", "don't. no,", "é. ñ, ×. ÷,", "a .b", "a.\nb\n\nc", "a\n", "\na", ".", "a,b", "two <|endoftext|> words", "a<|endoftext|>", "<|endoftext|><|endoftext|>"]
    for group in (tricky, [t for t in texts.values() if t], [r["text"] or "" for r in odd.collect()]):
        block = next(blocks([pa.RecordBatch.from_arrays([pa.array(group)], ["text"])], "text", 1 << 30))
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(block, group)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in group]
    probe = next(blocks([pa.RecordBatch.from_arrays([pa.array(["<|endoftext|> two"])], ["text"])], "text"))
    assert (np.frombuffer(e.encode(probe, ["<|endoftext|> two"])[0], "<u4").tolist() == [50256, 734]) == special


def test_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        got = lengths(n, 2048)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)


def check_packing(df, table, tokenizer):
    want = Counter()
    for r in table.select("doc_id", "text").collect():
        ids = np.asarray(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        start = 0
        for n in lengths(len(ids), 2048):
            want[(r["doc_id"], start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
            start += n
    got = df.collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and all(r["offset"] == 0 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["bucket"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_packing(docs, odd, empty, tokenizer):
    check_packing(pack_documents(docs, *registry.tokenizer_paths()), docs, tokenizer)
    check_packing(pack_documents(odd, *registry.tokenizer_paths()), odd, tokenizer)
    assert pack_documents(empty, *registry.tokenizer_paths()).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, *registry.tokenizer_paths(), longest=1000)


# 3 — fingerprints

WORD_MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD_MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD_MASK
    return x ^ x >> 31


def plain_parse(symbols):
    """One level by the letter: runs become one symbol, four coin tosses, phrases begin at local maxima."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    value = [x if n == 1 else plain_mix((x + n * 0xD6E8FEB86659FD93) & WORD_MASK) for x, n in runs]
    labels = value
    for _ in range(4):
        tossed = []
        for i, x in enumerate(labels):
            unlike = x ^ labels[i - 1] if i else WORD_MASK
            place = (unlike & -unlike).bit_length() - 1
            tossed.append(place << 1 | x >> place & 1)
        labels = tossed
    starts = [i for i in range(len(value)) if not i or i < len(value) - 1 and labels[i - 1] < labels[i] > labels[i + 1]]
    return [plain_mix(sum((x + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, x in enumerate(value[a:b])) & WORD_MASK) for a, b in zip(starts, [*starts[1:], len(value)])]


def plain_sketch(text):
    symbols, out = [ord(c) for c in text], []
    for level, bins in enumerate((32, 64, 64), 1):
        symbols, least = plain_parse(symbols), {}
        for x in symbols:
            name = plain_mix((x + level) & WORD_MASK)
            least[name % bins] = min(least.get(name % bins, WORD_MASK), name // bins)
        out += [plain_mix(least[b]) % 65535 + 1 if b in least else 0 for b in range(bins)]
    return out


def test_sketches_equal_plain_parsing(texts, odd):
    group = [*sorted((t for t in texts.values() if t), key=len)[:120], *(r["text"] or "" for r in odd.where("length(text) < 5000 or text is null").collect()), "a", "aa", "ab", "aab" * 9]
    assert sketches(group).tolist() == [plain_sketch(t) for t in group]


def test_likeness_is_smooth_in_length(texts):
    """One more character never changes a short text's description abruptly: no switch by length."""
    body = max(texts.values(), key=lambda t: len(t or ""))
    steps = [likeness(*(x[None] for x in sketches([body[:n], body[: n + 1]])))[0] for n in range(100, 260)]
    assert min(steps) > 0.6 and np.mean(steps) > 0.8


def check_fingerprints(df, table):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0]))
    got = defaultdict(list)
    for r in df.collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    keys = [k for k, _ in rows]
    for i, (k, t) in enumerate(rows):
        r = got[k][0]
        assert r["n_chars"] == len(t)
        if keys.count(k) == 1:
            n = rows[(i + 1) % len(rows)][1]
            edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = sketches([t, edited, n])
            assert (r["fingerprint"], r["edited_fingerprint"]) == (a.tobytes().hex(), b.tobytes().hex())
            assert r["near_edited"] == likeness(a[None], b[None])[0] and r["near_next"] == likeness(a[None], c[None])[0]
    return got


def test_fingerprints(docs, odd, empty, texts):
    got = check_fingerprints(fingerprint_documents(docs), docs)
    clear = [r[0]["near_edited"] > r[0]["near_next"] for k, r in got.items() if texts[k] and len(texts[k]) >= 40]
    assert np.mean(clear) > 0.97
    check_fingerprints(fingerprint_documents(odd), odd)
    check_fingerprints(fingerprint_documents(docs, parts=1), docs)
    assert fingerprint_documents(empty).count() == 0
    one = fingerprint_documents(docs.limit(1)).first()
    assert one["near_next"] == 1.0


def test_fingerprints_ignore_offset(texts):
    body = max(texts.values(), key=lambda t: len(t or ""))[:20_000]
    a, b = sketches([body, "a few words put before it " + body])
    assert likeness(a[None], b[None])[0] > 0.9


# 4 — license scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def check_licenses(df, table):
    want = Counter()
    for r in table.select("doc_id", "text").collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        at, found = [], set()
        for phrase, label in BASE.items():
            p = phrase.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += hits
            found |= {label} if hits else set()
        want[(r["doc_id"], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))] += 1
    got = df.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    return got


def test_licenses(spark, docs, odd, empty):
    check_licenses(scan_licenses(docs), docs)
    check_licenses(scan_licenses(odd), odd)
    assert scan_licenses(empty).count() == 0
    bsd = next(t for t, label in TEMPLATES.items() if label == "bsd").split()
    pairs = list(zip(bsd[:-1], bsd[1:], strict=True))[:13]
    rows = [
        (1, "x MIT  License, mit-license. MIT license"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under the quite Apache License, Version 2.0"),
        (4, "general public general public license"), (5, "license mit"),
        (6, "Redistribution and use, in source and binary forms, with or without any modification, are permitted"), (7, "in source and in forms"),
        (8, " ".join(f"{a} {b} zz" for a, b in pairs)), (9, " ".join(reversed(bsd))), (10, " ".join(bsd[8:] + bsd[:8])),
        (11, "before " + " ".join(bsd) + " after"), (11, "before " + " ".join(bsd) + " after"), (12, " ".join(bsd[:7]) + " zz zz " + " ".join(bsd[7:])),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in check_licenses(scan_licenses(table), table)}
    assert got[1]["n_base"] == 3 and got[1]["labels"] == "mit" and got[2]["labels"] == "cc-by-nc" and "apache" in got[3]["labels"] and got[6]["labels"] == "bsd" and got[7]["labels"] == ""
    assert got[11]["labels"] == got[12]["labels"] == "bsd" and got[11]["score"] == 1.0  # whole, and with two words put in
    assert not any("bsd" in got[i]["labels"] for i in (8, 9, 10))  # scattered, backwards, halves swapped


def plain_licenses(text):
    """(labels, score) by trying every diagonal of every template."""
    words = WORD.findall(text.translate(LOWER))
    base, more, score = set(), set(), 0.0
    for t, label in [*BASE.items(), *TEMPLATES.items()]:
        want = t.split()
        n = len(want) - 1
        held = Counter(i - j for i in range(len(words) - 1) for j in range(n) if words[i : i + 2] == want[j : j + 2])
        if t in BASE:
            base |= {label} if n in held.values() else set()
            continue
        for d in held:
            share = min(1.0, sum(held[d + x] for x in range(4)) / n)
            if share >= 0.85:
                span, best = words[max(0, d) : d + len(want) + 3], {(-1, -1): 0}
                for i, w in enumerate(span):
                    for j, x in enumerate(want):
                        best[i, j] = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0), best.get((i - 1, j - 1), 0) + (w == x))
                share = best[len(span) - 1, len(want) - 1] / len(want)
                more |= {label} if share >= 0.85 else set()
            score = max(score, share)
    return ",".join(sorted(base | more)), 1.0 if base else score


def test_license_labels_equal_plain_scan(spark, texts):
    """Labels and score by brute force, over real texts with templates cut, changed and shuffled into them."""
    rng = np.random.default_rng(2)
    rows = []
    for i, t in sorted(texts.items()):
        words = " ".join((t or "").split()[:200]).split()
        for template in rng.choice(list(TEMPLATES), 2):
            piece = template.split()
            for _ in range(rng.integers(0, 5)):
                at = rng.integers(0, len(piece))
                piece[at : at + rng.integers(0, 2)] = ["odd"] * rng.integers(0, 2)
                if not piece:
                    break
            at = rng.integers(0, len(words) + 1)
            words[at:at] = piece
        rows.append((i, " ".join(words)))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: plain_licenses(t) for i, t in rows}
    assert {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in got} == {i: (labels, round(score, 9)) for i, (labels, score) in want.items()}
    assert sum(bool(r["labels"]) for r in got) > 50


# 5 — substring deduplication

def test_repeats(spark, texts, odd, empty):
    words = [w for t in texts.values() for w in (t or "").split()]
    passage = " ".join(words[100:160])
    rows = [(i, " ".join(words[1000 * i + 200 : 1000 * i + 400])) for i in range(1, 11)]
    planted = [(i, t if i % 2 else " ".join(t.split()[: 20 + i]) + " " + passage + " " + " ".join(t.split()[20 + i :])) for i, t in rows]
    table = spark.createDataFrame(planted, "doc_id long, text string").withColumn("n_chars", __import__("pyspark").sql.functions.lit(1))
    got = repeated_spans(table).collect()
    assert {r["doc_id"] for r in got} == {4, 6, 8, 10} and {r["first_doc_id"] for r in got} == {2}
    for r in got:
        raw = dict(planted)[r["doc_id"]].encode()
        piece = raw[r["start"] : r["start"] + r["length"]].decode()
        assert piece.strip() == passage
    cut = {r["doc_id"]: r["text"] for r in dedup_substrings(table).collect()}
    assert all(cut[i] == t for i, t in planted if i % 2 or i == 2)
    assert all(len(cut[i].split()) < len(t.split()) - 25 for i, t in planted if i in (4, 6, 8, 10))
    assert repeated_spans(empty).count() == 0 and dedup_substrings(empty).count() == 0
    again = dedup_substrings(odd, min_words=3)
    kept = {(r["doc_id"], r["text"]) for r in again.collect()}
    assert again.columns == odd.columns and (1, None) in kept and (6, "") in kept and (5, "same words again and again here") in kept and again.count() == odd.count()


def plain_chunks(text):
    """(start, bytes) of each chunk, byte by byte."""
    raw, gear = text.encode(), [plain_mix((i + 1) * 0x9E3779B97F4A7C15 & WORD_MASK) for i in range(256)]
    blank = lambda b: b == 32 or 9 <= b <= 13
    hits = [i for i in range(15, len(raw)) if sum(gear[raw[i - j]] << j for j in range(16)) >> 20 & 31 == 0]
    begins = [i for i in range(1, len(raw)) if blank(raw[i - 1]) and not blank(raw[i])]
    marks = sorted({next(b for b in begins if b > h) for h in hits if begins and begins[-1] > h})
    cuts, last = [], 0
    for c in [*marks, len(raw)]:
        while c - last > 112:
            at = last + 112
            while raw[at] & 0xC0 == 0x80 and at > last + 1:
                at -= 1
            cuts.append(at)
            last = at
        if c - last >= 16 or c == len(raw) > last:
            cuts.append(c)
            last = c
    return [(a, raw[a:b]) for a, b in zip([0, *cuts], cuts)]


def plain_end(a, i, b, j, step):
    """Words' worth of bytes that go on alike from a[i] and b[j] in the direction of step, one by one."""
    at = lambda x, k: x[k] if 0 <= k < len(x) else 32
    n = 0
    while 0 <= i + step * n < len(a) and 0 <= j + step * n < len(b) and a[i + step * n] == b[j + step * n]:
        n += 1
    blank = lambda c: c == 32 or 9 <= c <= 13
    if n and not (blank(a[i + step * (n - 1)]) or (blank(at(a, i + step * n)) and blank(at(b, j + step * n)))):
        while n and not blank(a[i + step * (n - 1)]):
            n -= 1
    return n


def plain_spans(rows, min_words):
    """(key, start, length, chunks, words, first holder, all first holders) of every span, by the letter."""
    pieces = {(k, t): plain_chunks(t) for k, t in rows if k is not None and t}
    first, raws = {}, {k: t.encode() for k, t in rows if k is not None and t}
    for (k, _), found in pieces.items():
        for start, piece in found:
            first[piece] = min(first.get(piece, (k, start)), (k, start))
    out = set()
    for (k, text), found in pieces.items():
        runs, run, raw = [], [], text.encode()
        for start, piece in [*found, (None, None)]:
            if piece is not None and first[piece][0] < k:
                run.append((start, piece))
            elif run:
                begin, end = run[0][0], run[-1][0] + len(run[-1][1])
                blank = lambda c: c == 32 or 9 <= c <= 13
                words = sum(not blank(raw[i]) and (i == 0 or blank(raw[i - 1])) for i in range(begin, end))
                holders = Counter(first[p][0] for _, p in run)
                most = min(h for h, n in holders.items() if n == max(holders.values()))
                (h1, at1), (h2, at2) = first[run[0][1]], first[run[-1][1]]
                left = plain_end(raw, begin - 1, raws[h1], at1 - 1, -1)
                right = plain_end(raw, end, raws[h2], at2 + len(run[-1][1]), 1)
                words += len(raw[begin - left : begin].split()) + len(raw[end : end + right].split())
                runs.append([begin - left, end + right, len(run), words, (-len(run), most), set(holders)])
                run = []
        spans = []
        for r in sorted(runs, key=lambda r: r[:2]):
            if spans and r[0] <= spans[-1][1]:
                s = spans[-1]
                s[1], s[2], s[3], s[4], s[5] = max(s[1], r[1]), s[2] + r[2], s[3] + r[3], min(s[4], r[4]), s[5] | r[5]
            else:
                spans.append(r)
        out |= {(k, a, b - a, n, w, m[1], tuple(sorted(h))) for a, b, n, w, m, h in spans if w >= min_words}
    return out


def test_passages_are_cut_to_their_ends(spark, texts):
    """Of planted passages of 51 words, nearly all goes, and nothing beside them."""
    rng = np.random.default_rng(5)
    words = [w for t in texts.values() for w in (t or "").split()]
    rows, share = [], []
    passages = [" ".join(words[3000 + 60 * i : 3051 + 60 * i]) for i in range(12)]
    for i, p in enumerate(passages):
        for c in range(3):
            own = [f"w{rng.integers(10**9)}" for _ in range(80)]
            cut = int(rng.integers(5, 70))
            rows.append((100 * c + i, " ".join([*own[:cut], p, *own[cut:]])))
    kept = {r["doc_id"]: r["text"] for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        own = [w for w in t.split() if w.startswith("w") and w[1:].isdigit()]
        left = kept[i].split()
        assert [w for w in left if w in own] == own
        if i < 100:
            assert kept[i] == t
        else:
            share.append(1 - (len(left) - len(own)) / 51)
    assert np.median(share) >= 0.95 and min(share) > 0.5


def test_ends_go_on_over_long_words(spark):
    word = "".join(chr(97 + i % 23) for i in range(1000))
    rows = [(1, f"start here {word}{word[:300]} tail of one sentence that is shared"), (2, f"other start {word}{word[:300]} tail of one sentence that is shared"), (3, f"x {word[:700]}y tail of one sentence that is shared now")]
    got = {(r["doc_id"], r["start"], r["length"], r["n_chunks"], r["n_words"], r["first_doc_id"], tuple(r["holders"])) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()}
    assert got == plain_spans(rows, 1)


@pytest.mark.parametrize("parts", [1000, 3])
def test_spans_equal_plain_version(spark, docs, texts, parts, monkeypatch):
    """All spans and their columns by brute force; with few parts, common digests join as a broadcast."""
    monkeypatch.setattr(chunk_dedup, "HOT_PARTS", parts)
    got = {(r["doc_id"], r["start"], r["length"], r["n_chunks"], r["n_words"], r["first_doc_id"], tuple(r["holders"])) for r in repeated_spans(docs).collect()}
    assert got == plain_spans(texts.items(), 16) and got
    line = "one common line of text that every document has somewhere in its middle part"
    rows = [(i, f"start {i} of it {i * 7919} {line} and end {i * 104729} here") for i in range(40)] + [(50, line), (50, line), (None, line), (51, "x" * 500), (52, "x" * 500)]
    got = {(r["doc_id"], r["start"], r["length"], r["n_chunks"], r["n_words"], r["first_doc_id"], tuple(r["holders"])) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()}
    assert got == plain_spans(rows, 1)


# 6 — sharding

def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 40, 1000, 4096, 5001):
        assert sorted(feistel(np.arange(n), n, 7).tolist()) == list(range(n))


def check_sharding(df, n, shards):
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n and set(by) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert n < shards or max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_sharding_keeps_clashing_columns(spark):
    F = __import__("pyspark").sql.functions
    df = spark.range(50).select(F.col("id").alias("doc_id"), *[F.lit(c).alias(c) for c in ("_base", "_PART", "_place", "__place", "Row_No", "_order_0", "count")])
    got = shard_rows(df, ["doc_id"], 4)
    assert [c for c in df.columns if c != "Row_No"] + ["row_no", "shuffled", "shard", "slot"] == got.columns
    rows = got.collect()
    assert len(rows) == 50 and all(r["_base"] == "_base" and r["_PART"] == "_PART" and r["_order_0"] == "_order_0" for r in rows)
    assert sorted(r["row_no"] for r in rows) == sorted(r["shuffled"] for r in rows) == list(range(50))


def test_sharding(spark, docs, odd, empty):
    df = registry.op6_sharding(spark, DATA)
    check_sharding(df, docs.count(), 40)
    want = {r["doc_id"]: ((0 if r["text"] is None else len(r["text"].encode())) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in df.collect()} == want
    key = lambda d: sorted((r["doc_id"], r["shard"], r["slot"]) for r in d.collect())
    assert key(df) == key(registry.op6_sharding(spark, DATA))
    check_sharding(shard_rows(odd, ["doc_id", "text"], 4), odd.count(), 4)  # its own row_no and slot make way
    check_sharding(shard_rows(odd.withColumn("slot", odd["doc_id"]), ["slot", "text"], 4), odd.count(), 4)
    order = sorted(((r["doc_id"] or 0, r["text_crc32"], r["size"]), (r["shard"], r["slot"])) for r in df.collect())
    places = feistel(np.arange(len(order)), len(order), 42)  # the law by itself: the row's number in order decides its place
    assert [at for _, at in order] == [(int(p) % 40, int(p) // 40) for p in places]
    assert shard_rows(empty.select("doc_id"), ["doc_id"], 4).count() == 0


# 7 — SimHash

def simhash(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def groups(prints, radius):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [16_384, 8])
def test_simhash(docs, texts, tile):
    prints = {i: simhash(t) for i, t in texts.items()}
    got = near_duplicates(docs, tile_rows=tile).collect()
    assert {r["doc_id"]: r["f0"] & (1 << 64) - 1 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(prints, 4)


def test_simhash_odd(odd, empty):
    got = defaultdict(set)
    for r in near_duplicates(odd).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert near_duplicates(odd).count() == odd.count()
    assert got[1] == got[2] == got[3] == {1} and got[5] == got[6] == {5}
    assert near_duplicates(empty).count() == 0


def jaccard_groups(texts, k=5, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return root


def crowd(texts):
    """Variants of one text on both sides of the limit, and pairs that are near in a crowd of which all others are too far."""
    rng = np.random.default_rng(5)
    texts, base = dict(texts), [f"w{i}" for i in rng.integers(0, 5000, 400)]
    for i in range(60):  # a changed word changes five shingles: from 0.95 down to 0.6 alike to the base, less to each other
        words = list(base)
        for at in rng.choice(400, 2 + i // 4, replace=False):
            words[at] = f"x{i}y{at}"
        texts[10_000 + i] = " ".join(words)
    for i in range(30):
        words = texts[10_059 - i].split()
        words[7] = "other"
        texts[20_000 + i] = " ".join(words)
    return texts


def test_near_duplicate_groups(spark, texts):
    """Same groups as all pairs of whole shingle sets."""
    texts = crowd(texts)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_duplicate_groups(table).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == jaccard_groups(texts)


def test_exact_forest_in_tiles(texts):
    """Tiles of one group: their links join the same groups as all pairs, and none is false."""
    texts = crowd({i: t for i, t in texts.items() if i < 40})
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts.values()), pa.string())], ["text"])
    block = next(blocks([batch], "text", 1 << 30))
    grams, at = shingle_sets(block, 5)
    prints = np.asarray([fingerprint(grams[a:b], 8) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
    sets, rows = Sets(prints, grams, at), np.random.default_rng(1).permutation(len(texts))
    tiles = np.array_split(rows, 3)
    links = [exact_forest(sets, a, b, 0.8, 128) for i, a in enumerate(tiles) for b in tiles[i:]]
    root = np.arange(len(rows))
    for x, y in (pair for a, b in links for pair in zip(a, b, strict=True)):
        root[root == root[x]] = root[y]
    want = list(jaccard_groups(texts).values())
    assert len(set(zip(want, root.tolist(), strict=True))) == len(set(want)) == len(set(root.tolist()))


@pytest.mark.parametrize("tile", [None, 2000])
def test_drop_near_duplicates(spark, texts, tile, monkeypatch):
    """One row of each group, by counts; groups larger than a tile give the same."""
    if tile:
        monkeypatch.setattr(near_dedup, "TILE_GRAMS", tile)
    texts = crowd(texts)
    rows = [*texts.items(), *((i, texts[i]) for i in (1, 2, 2, 10_000)), (1, "a text of its own under a key that has another"), (None, texts[3]), (None, "no key here"), (None, "no key here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, texts[i]) for i in set(jaccard_groups(texts).values())) + Counter([rows[-4], rows[-1]])
    assert Counter((r["doc_id"], r["text"]) for r in drop_near_duplicates(table).collect()) == want


def test_near_duplicates_odd(odd, empty):
    got = defaultdict(set)
    for r in near_duplicate_groups(odd).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got[1] == got[2] == got[3] == {1} and got[5] == got[6] == {5} and got[4] == {4} and got[7] == {7} and got[10] == {10}
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 9 and drop_near_duplicates(empty).count() == near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize(("parts", "radius"), [(1, 4), (1, 15), (2, 26), (4, 56)])
def test_forest_keeps_all_components(parts, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (40, parts), dtype=np.uint64)
    bits = base[rng.integers(0, 40, 700)]
    for _ in range(4):
        bits = bits ^ np.where(rng.random(bits.shape) < 0.6, np.uint64(1) << rng.integers(0, 64, bits.shape, dtype=np.uint64), np.uint64(0))
    bits = np.unique(bits, axis=0)
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
    root = np.arange(len(bits))
    for i, j in zip(*np.nonzero(apart <= radius), strict=True):
        root[root == root[i]] = root[j]
    for same in (True, False):
        left, right = (bits, bits) if same else (bits[:300], bits[300:])
        a, b = forest(left, right, radius, same)
        got = np.arange(len(bits))
        for i, j in zip(a, b + (0 if same else 300), strict=True):
            assert apart[i, j] <= radius and got[i] != got[j]  # a true link that joins two trees
            got[got == got[i]] = got[j]
        if same:
            assert len(np.unique(got)) == len(np.unique(root)) and all(len(np.unique(got[root == r])) == 1 for r in np.unique(root))
        else:
            cross = np.arange(len(bits))
            for i, j in zip(*np.nonzero(apart[:300, 300:] <= radius), strict=True):
                cross[cross == cross[i]] = cross[300 + j]
            assert all(len(np.unique(got[cross == r])) == 1 for r in np.unique(cross))


# 8 — language ID

def test_language(spark, odd, empty):
    got = registry.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(truth) and all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and truth[r["doc_id"]] is not None]
    assert np.mean(right) > 0.95
    model = LanguageModel.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    seen = defaultdict(set)
    for r in identify_languages(odd, model, keep=("text",)).collect():
        seen[r["doc_id"]].add(r["lang_pred"])
    assert seen[1] == seen[2] == seen[3] == seen[9] == {"und"} and "und" not in seen[5]
    assert identify_languages(empty, model).count() == 0
    nothing = LanguageModel.fit(empty)
    assert {r["lang_pred"] for r in identify_languages(odd, nothing).collect()} == {"und"}


def test_language_of_short_texts(spark):
    model = LanguageModel.fit(spark.createDataFrame([("the cat is here a b", "en"), ("a dog", "en"), ("die Katze ist da", "de")], "text string, lang string"))
    texts = ["A.", "a", "7 x", "\u00e9", "\u044f", "die", "zq", "...", "", None]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 3, 4, 5, 6)] == ["en", "en", "en", "en", "de", "en"]
    assert got[2]["lang_pred"] != "und" and all(got[i]["score"] > 0 and got[i]["languages"] for i in range(7))
    assert got[4]["score"] == pytest.approx(2 / 3)  # no known trigram: two of three rows are English
    assert {got[i]["lang_pred"] for i in (7, 8, 9)} == {"und"}


def test_language_mixture(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = LanguageModel.fit(table)
    by = {r["lang"]: r["text"] for r in table.where("length(text) between 2000 and 3000").collect()}
    rows = [(1, by["en"][:1500] + "\n" + by["fr"][:700]), (2, by["de"][:2000])]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["languages"] == "en,fr" and 0.55 < got[1]["score"] < 0.8
    assert got[2]["languages"] == "de" and got[2]["score"] == 1.0


# 9 — decontamination

def test_decontamination(spark, docs, texts, odd, empty):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")

    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    have = {i: shingles(t) for i, t in texts.items()}
    want = set()
    for r in items.collect():
        q = shingles(r["text"])
        want |= {(i, r["item_id"], len(q & s), len(q)) for i, s in have.items() if q and len(q & s) >= 0.6 * len(q)}
    got = contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["hits"], r["n_shingles"]) for r in got} == want and want
    probe = spark.createDataFrame([(1, "same words again and again here"), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "one")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(odd, probe).collect()} == {(5, 1), (6, 1), (4, 4)}
    assert contaminated(empty, probe).count() == 0 and contaminated(odd, probe.where("false")).count() == 0
    only = spark.createDataFrame([(7, " ".join(f"w{i % 977}x{i}" for i in range(20_000, 20_012)))], "item_id long, text string")  # a few words deep in a very long text
    assert [(r["doc_id"], r["hits"], r["n_shingles"]) for r in contaminated(odd, only).collect()] == [(7, 8, 8)]
    long_item = spark.createDataFrame([(1, " ".join(texts[max(texts, key=lambda i: len(texts[i] or ""))].split()[:3000]))], "item_id long, text string")
    assert contaminated(docs, long_item).count() >= 1


# 10 — toxicity

def test_toxicity(spark, odd, empty):
    got = registry.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    pairs = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    tp = sum(p and y for _, p, y in pairs)
    assert tp / max(1, sum(p for _, p, _ in pairs)) > 0.9 and tp / sum(y for *_, y in pairs) > 0.9
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = fit_toxicity(odd, labels)
    scored = score_toxicity(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert score_toxicity(empty, model).count() == 0
    assert score_toxicity(odd, fit_toxicity(empty, labels.where("false"))).count() == odd.count()


def test_lexicons_count_all_labelled_rows(spark):
    rows = [(i, f"plain words number {i}" + (" grobnak" if i % 40 == 0 else ""), int(i % 10 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    quiet, fired = model.accuracies["mined_words"]  # 10 rows of class 1 have the word
    assert fired > 0.2 and quiet < 0.01


def test_classifier_learns_from_unlabelled_rows(spark):
    """Rows without a label count by their posterior: leaving them out changes the weights, and a word that only they have can not be told apart."""
    rows = [(i, f"text {i % 11} of a kind" + (" you idiot grobnak" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(300)]
    more = [(1000 + i, f"other {i % 7} text" + (" grobnak moron" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = lambda r: spark.createDataFrame([x[:2] for x in r], "doc_id long, text string")
    with_them, without = fit_toxicity(docs([*rows, *more]), labels), fit_toxicity(docs(rows), labels)
    assert not np.allclose(with_them.weights, without.weights)
    probe = docs([(1, "grobnak"), (2, "text of a kind"), (3, ""), (4, None)])
    got = {r["doc_id"]: r["score"] for r in score_toxicity(probe, with_them).collect()}
    assert got[1] > 0.5 > max(got[2], got[3], got[4])


def test_feature_counts_equal_plain_count(spark, docs, texts):
    """Rows of each class that have a word or prefix once, and twice or more, by brute force."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["toxic"] is not None}
    got = {r["feature"]: (r["one"], r["zero"]) for r in feature_counts(labelled(docs, classes_of(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id", "toxic"), "doc_id", "text")).collect()}
    want = defaultdict(lambda: [0, 0])
    word = re.compile(rb"[A-Za-z\x80-\xff]+")
    for i, y in labels.items():
        if i not in texts:
            continue
        seen = Counter()
        for w in word.findall((texts[i] or "").translate(LOWER).encode()):
            for column, n in enumerate((None, 4, 5, 6, 7, 8, 9)):
                if n is None or len(w) >= n:
                    piece = w if n is None else w[:n]
                    seen[column, plain_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(piece)) & WORD_MASK) >> 46] += 1
        for (column, bucket), n in seen.items():
            for c in (column, column + 7)[: 1 + (n > 1)]:
                want[c << 18 | bucket][1 - y] += 1
        want[14 << 18][1 - y] += 1
    assert got == {f: tuple(n) for f, n in want.items()}


def plain_label_model(patterns, counts, prior, known, rounds=25):
    """The label model's posteriors voter by voter and row by row."""
    m, eps = len(VOTERS), 1e-4
    rows = [(p, n, None) for p, n in zip(patterns, counts)] + [(p, w, c) for p, c, w in zip(*known)]
    post = {p: 0.5 if p else 0.02 for p in patterns}
    bit = lambda p, v: p >> v & 1
    for _ in range(rounds):
        rates, silence, corr = [], [], [[0.0] * m for _ in range(m)]
        for c in (0, 1):
            weight = [(n * (post[p] if c else 1 - post[p])) if y is None else n * (y == c) for p, n, y in rows]
            total = sum(weight) + 2.0
            mean = [(sum(w for (p, _, _), w in zip(rows, weight) if bit(p, v)) + 0.02) / total for v in range(m)]
            silence.append((sum(w for (p, _, _), w in zip(rows, weight) if p == 0) + 0.02) / total)
            rates.append([min(1 - eps, max(eps, x)) for x in mean])
            for a in range(m):
                for b in range(m):
                    if a != b:
                        both = sum(w for (p, _, _), w in zip(rows, weight) if bit(p, a) and bit(p, b)) / total - mean[a] * mean[b]
                        scale = math.sqrt(max(mean[a] * (1 - mean[a]), 1e-6)) * math.sqrt(max(mean[b] * (1 - mean[b]), 1e-6))
                        corr[a][b] += 0.5 * min(1, max(0, both / scale))
        share = [1 / (1 + sum(corr[v])) for v in range(m)]
        for p in post:
            odds = math.log(prior / (1 - prior)) + (min(0, math.log(silence[1] / silence[0])) if p == 0 else 0)
            odds += sum(share[v] * max(0, math.log(rates[1][v] / rates[0][v])) for v in range(m) if bit(p, v))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post


def test_label_model_equals_plain_version():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.15
    votes = sum((np.where(y, rng.random(3000) < 0.6, rng.random(3000) < 0.03) << v for v in (0, 3, 5)), np.zeros(3000, np.int64))
    votes |= (votes & 1) << 7
    patterns, counts = np.unique(votes, return_counts=True)
    known = (votes[:300], y[:300].astype(float), np.full(300, 2.0))
    model = LabelModel(patterns, counts.astype(float), 0.15, known)
    want = plain_label_model(patterns.tolist(), counts.tolist(), 0.15, [k.tolist() for k in known])
    assert dict(zip(patterns.tolist(), model.posterior(patterns).tolist())) == pytest.approx(want, abs=1e-9)


def test_scores_equal_plain_sum(spark, docs, texts):
    """A score is the logistic of the intercept and the weights of the words and prefixes that a text has once, and twice or more."""
    rng = np.random.default_rng(4)
    weights = np.zeros(14 << 18)
    some = rng.choice(len(weights), len(weights) // 3, replace=False)
    weights[some] = rng.normal(size=len(some)) / 50
    model = ToxicityModel(weights, -0.3, {}, np.empty(0))
    word = re.compile(rb"[A-Za-z\x80-\xff]+")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    for i in sorted(texts)[:60]:
        seen = Counter()
        for w in word.findall((texts[i] or "").translate(LOWER).encode()):
            for column, n in enumerate((None, 4, 5, 6, 7, 8, 9)):
                if n is None or len(w) >= n:
                    piece = w if n is None else w[:n]
                    seen[column << 18 | plain_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(piece)) & WORD_MASK) >> 46] += 1
        total = -0.3 + sum(weights[f] + (weights[f + (7 << 18)] if n > 1 else 0) for f, n in seen.items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)


def test_label_model_shares_weight_of_dependent_voters():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.1
    fire = lambda hit, miss: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < miss)
    a, b = fire(0.7, 0.01), fire(0.6, 0.01)
    votes = a * 1 | b * 2 | a * 4  # the third voter repeats the first
    patterns, counts = np.unique(votes, return_counts=True)
    model = LabelModel(patterns, counts.astype(float), 0.1)
    assert model.share[0] < 0.7 and model.share[1] > model.share[0] and len(VOTERS) == model.m
    assert (model.posterior(votes) > 0.5)[y].mean() > 0.6 and (model.posterior(votes) > 0.5)[~y].mean() < 0.05


def test_grams_stay_in_their_row():
    words = np.arange(10, dtype=np.uint64)
    hashes, start, place = gram_hashes(words, np.array([0, 3, 3, 5, 10]), 3)
    assert start.tolist() == [0, 3, 5, 6, 7] and place.tolist() == [0, 1, 1, 2, 5] and len(set(hashes.tolist())) == 5
