"""Source divergence, license scan and tokenizer alignment against plain Python on small, nasty tables."""

import hashlib
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_operators import SCHEMA, SF, nasty, rows, sort  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), SCHEMA)


# Source divergence

def op11(data, least=3, ranks=200):
    groups, counts, held = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in data:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.low(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    kept = {lang: {t for t, n in held[lang].items() if n >= least} for lang, _ in groups}
    out = []

    def shares(own, lang):
        total = sum(n for t, n in own.items() if t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (own[t] + 1) // total for t in kept[lang]}

    by_group = {g: shares(counts[g], g[0]) for g in groups}
    for lang, source in groups:
        whole = Counter()
        for other in groups:
            if other[0] == lang:
                whole.update(counts[other])
        p, all_ = by_group[lang, source], shares(whole, lang)
        parts = {"pair": [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept[lang]), o[1]) for o, q in by_group.items() if o[0] == lang and o[1] != source],
                 "term": [((p[t] - all_[t]) ** 2 // all_[t], t) for t in kept[lang] if counts[lang, source][t] and p[t] > all_[t]]}
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < ranks]
    return sort(out)


def odd_sources():
    rng = random.Random(8)
    terms = ["a", "ab", "ABCDEFGH", "abcdefghi", "sixteenletterwrd", "seventeenletterwd", "é" * 5, "ü" * 40, "long" * 300, "日本", "x" * 8, "y" * 16, "Z" * 33]
    data = [(" ".join(rng.choice(terms) + rng.choice(["", "1", "-", "x"]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, ""]),
             rng.choice(["s1", "s2", "s3", None, "é"])) for _ in range(120)]
    return data + [(None, "xx", "lonely"), ("", "xx", "other"), ("one term", "yy", None), ("same same same", "zz", "a"), ("same", "zz", "b"), ("SAME", "zz", "a")]


def test_divergence(spark, docs, monkeypatch):
    from tokenloom.llm import divergence

    data = odd_sources()
    table = spark.createDataFrame([(*d, 7, "x") for d in data], "text string, lang string, source string, n long, term string")
    assert rows(divergence.audit_sources(table)) == op11(data)
    assert rows(divergence.audit_sources(table, 1, 4)) == op11(data, 1, 4)
    assert rows(divergence.audit_sources(docs)) == op11([(r[1], r[2], r[3]) for r in nasty()])
    assert divergence.audit_sources(table.limit(0)).count() == 0
    # Several tiles and blocks, and counts after every few terms.
    for name, value in (("TILE", 2), ("TERMS", 3), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert rows(divergence.audit_sources(table)) == op11(data)


def test_radix_order():
    from tokenloom.llm.divergence import radix_order

    rng = np.random.default_rng(1)
    for high in (1, 3, 2**16, 2**40):
        a, b = rng.integers(0, 5, 2000).astype(np.uint32), rng.integers(0, high, 2000).astype(np.uint64)
        assert (radix_order([a, b]) == np.lexsort((np.arange(2000), b, a))).all()


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F
    from tokenloom.llm.divergence import share, shares

    rng = random.Random(3)
    data = [(x, x + rng.randrange(d)) for d in (1, 1000, 10**9, 4 * 10**15) for x in (rng.randrange(1, d + 1) for _ in range(50))] + [(1, 1), (5, 5)]
    want = [1 + 10**9 * x // d for x, d in data]
    assert shares(*np.array(data, dtype=np.int64).T).tolist() == want
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, x long, d long")
    assert [r[0] for r in table.orderBy("i").select(share(F.col("x"), F.col("d"))).collect()] == want


# License scan

def op12(data, phrases, notices, percent):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t or ""))

    given = [(split(t), k, 100, True) for t, k in phrases] + [(split(t), k, percent, False) for t, k in notices]
    step = max(len(w) for w, *_ in given)
    out = []
    for d, text in data:
        w = split(text)
        pairs = list(zip(w, w[1:]))
        places, base, labels, score = [], set(), set(), 0.0
        for t, label, share, phrase in given:
            tokens = set(zip(t, t[1:]))
            if phrase:
                at = [i for i in range(len(w) - len(t) + 1) if w[i:i + len(t)] == t]
                if at:
                    places, score = places + at, 1.0
                    base.add(label)
                continue
            for block in range(len(pairs) // step + 1):
                common = len(tokens & set(pairs[block * step:(block + 2) * step]))
                if 100 * common >= share * len(tokens):
                    labels.add(label)
                    score = max(score, common / len(tokens))
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    return sort(out)


def license_texts():
    from tokenloom.llm.licenses import NOTICES

    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "software", "license", "by", "cc", "mit", "gnu", "public", "w" + str(rng.randrange(50))])
    texts = [None, "", " . ", "mit", "MIT License", "cc by cc by cc-by-cc by", "gnu general public license " * 3, "GNU  General\nPublic-License", "Apache License" * 4,
             "mit licenseé émit license", "x " * 20000 + "mit license", "gnu general public licence"]
    for text, _ in NOTICES:
        own = text.split(" ")
        for lost in (0, 1, 3):
            left = own[:]
            for _ in range(lost):
                left[rng.randrange(len(left))] = "gone"
            texts.append(" ".join([word() for _ in range(rng.randrange(90))] + left + [word() for _ in range(rng.randrange(90))]))
    texts += [" ".join(word() for _ in range(400)) for _ in range(20)]
    return [(i, t) for i, t in enumerate(texts)] + [(4, "another text: mit license"), (None, "apache license"), (4, texts[4])]


def test_licenses(spark, monkeypatch):
    from tokenloom.llm import licenses
    from tokenloom.llm.licenses import NOTICES, PHRASES, find_licenses, scan_licenses, template_table

    data = license_texts()
    table = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, label string, row int")
    given = template_table(spark, PHRASES, NOTICES)
    want = op12(data, PHRASES, NOTICES, 80)
    assert rows(scan_licenses(table, given)) == want
    assert len({w[6] for w in want}) > 8 and {w[7] for w in want} - {0.0, 1.0}
    # A phrase that repeats a token, a template of one word, and a low threshold.
    phrases, notices = [("the the the", "thrice"), ("cc by cc", "again")], [("w1 w2 w3 w4", "low"), ("the software of the license by the software", "mixed")]
    odd = template_table(spark, [*phrases, ("single", "none")], notices, 50)
    more = [(100, "the the the the the"), (101, "cc by cc by cc"), *data]
    texts = spark.createDataFrame(more, "doc_id long, text string")
    assert rows(scan_licenses(texts, odd)) == op12(more, phrases, notices, 50)
    assert scan_licenses(table, template_table(spark, [], [])).where("n_base > 0 or labels <> ''").count() == 0
    assert scan_licenses(table.limit(0), given).count() == 0
    finds = find_licenses(table, given)[1]
    assert {(r.start, r.stop, r.label) for r in finds.where("phrase").collect()} >= {(0, 2, "mit"), (4, 8, "gpl")}
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", -1)
    assert rows(scan_licenses(table, given)) == want


# Tokenizer alignment

def paths():
    import public_tokenizers

    return [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def op13(data):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path, _ = paths()
    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    # The byte-level table as its authors describe it: printable bytes stand for themselves, others follow from 256.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def piece(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs = []
    for d, text in data:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        x = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
        y = [piece(i) for i in b]
        if b"".join(x) != b"".join(y) or (text and b"".join(x) != (" " + text).encode()):
            a, b, x, y = [], [], [], []
        at_a, at_b = {int(e): k for k, e in enumerate(np.cumsum([len(t) for t in x]))}, {int(e): k for k, e in enumerate(np.cumsum([len(t) for t in y]))}
        ends = sorted(set(at_a) & set(at_b))
        groups, i, j = [], 0, 0
        for e in ends:
            groups.append(",".join(map(str, a[i:at_a[e] + 1])) + "|" + ",".join(map(str, b[j:at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        docs.append((d, len(a), len(b), [(a[at_a[e]], b[at_b[e]]) for e in ends], hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(p for r in docs for p in r[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sort([(d, n, m, len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest) for d, n, m, links, digest in docs])


def test_alignment(spark):
    from tokenloom.llm.alignment import compare_tokenizers

    odd = [(r[0], r[1]) for r in nasty()] + [(50, "<|endoftext|> <s> </s> <unk> [INST] <0x41>"), (51, "a▁b"), (52, "  two  blanks  "), (53, "\n\n\t x"),
                                             (54, "\U0001f600‍ éé ﬁ 　  "), (55, "\x00 nul \x1f"), (56, "z" * 5000), (57, "1234567890 ' 's 'LL")]
    data = odd + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    table = spark.createDataFrame([(*r, 1, "p") for r in data], "doc_id long, text string, links int, pair string")
    want = op13(data)
    assert sum(w[1] > 0 for w in want) > len(data) - 12 and any(w[1] == 0 and w[7] == "" for w in want)
    assert rows(compare_tokenizers(table, *paths())) == want
    assert rows(compare_tokenizers(table, *paths()[:2])) == want
    assert compare_tokenizers(table.limit(0), *paths()).count() == 0


def test_common_ends():
    from tokenloom.llm.alignment import common_ends

    rng = random.Random(5)
    for share in (0.02, 0.3, 0.9):
        for _ in range(60):
            n = rng.randrange(1, 200)
            a, b = (sorted({x for x in range(1, n) if rng.random() > share} | {n}) for _ in range(2))
            left, right = common_ends(a, b)
            both = sorted(set(a) & set(b))
            assert [a[i] for i in left] == both and [b[j] for j in right] == both
    assert [len(x) for x in common_ends([], [])] == [0, 0]


def test_places_of_pairs():
    from tokenloom.llm.alignment import PairTable

    rng = np.random.default_rng(2)
    for n, high in ((1, 1), (500, 9), (200_000, 40_000)):
        pairs = np.unique(rng.integers(0, high, n) << 32 | rng.integers(0, 20_000, n))
        assert (PairTable(pairs).places(pairs) == np.arange(len(pairs))).all()


def test_all_pairs_are_known_beforehand():
    from tokenloom.llm.alignment import PAIRS, byte_tokens, piece_tokens, possible_pairs

    a, b = [b"ab", b"b", b"", b"cab"], [b"b", b"ab", b"xcab", b"b"]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))}
    assert {(p >> 32, p & 0xFFFFFFFF) for p in possible_pairs(a, b).tolist()} == want and len(want) == len(possible_pairs(a, b))
    x, y = byte_tokens(paths()[0]), piece_tokens(paths()[1])
    assert len(possible_pairs(x, y)) <= min(PAIRS, sum(2 * len(t) for t in x) + sum(len(t) for t in y))
