"""Text operators against plain Python, and on null, empty, long, repeated and clashing rows."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from courtlens.llm import katz, language, licenses, mixing, packing, pii, simhash, variants
from courtlens.llm.common import TIDY, bit_map, is_set, remainder, words_of
from courtlens.llm.components import components
from courtlens.llm.queries import vocabulary
from courtlens.sources.tables import shared_folder
from .conftest import LONG, ODD

# ---- personal data -------------------------------------------------------------------------------


def naive_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_plain_spans_equal_the_patterns():
    random.seed(3)
    for _ in range(20_000):
        text = "".join(random.choice("a@.1 2+-@.(é") for _ in range(random.randint(0, 30)))
        assert [tuple(s) for s in pii.plain_spans(text)] == naive_spans(text), text
    text = "pay 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (555) 010-9999, 10.0.0.256 10.0.0.25"
    assert [tuple(s) for s in pii.plain_spans(text)] == naive_spans(text)
    pii.plain_spans("9" * 200_000 + "a" * 200_000 + "@" * 1000)


@pytest.mark.parametrize("text, kind, found", [
    ("write to john.doe [at] example (dot) com now", "email", "john.doe [at] example (dot) com"),
    ("john dot doe at mail dot example dot org today", "email", "john dot doe at mail dot example dot org"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
    ("xx jоhn＠exаmple．com x", "email", "jоhn＠exаmple．com"),
    ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("é a\u200bb@c\u200b.com", "email", "a\u200bb@c\u200b.com"),
])
def test_disguises_are_mapped_back(text, kind, found):
    spans = pii.hidden_spans(text, pii.plain_spans(text))
    assert [(pii.KINDS[s.kind], text[s.start:s.end]) for s in spans] == [(kind, found)]


@pytest.mark.parametrize("text", ["meet at noon, look at the dot on it", "one two three go", "the point is at la punkt", "über naïve façade — “quotes” … ñ", ""])
def test_clean_texts_have_no_hidden_spans(text):
    assert pii.hidden_spans(text, pii.plain_spans(text)) == []


@pytest.mark.parametrize("text, masked", [
    ("to jоhn@example.com now", "to <email> now"),
    ("to alice@example.cоm now", "to <email> now"),
    ("at +1 555 123 456７ ok", "at <phone> ok"),
])
def test_disguises_that_reach_beyond_a_plain_span(text, masked):
    plain = pii.plain_spans(text)
    hidden = pii.hidden_spans(text, plain)
    assert plain and len(hidden) == 1 and hidden[0].start <= plain[0].start and plain[0].end <= hidden[0].end
    assert pii.masked(text) == masked


@pytest.mark.parametrize("text, found", [
    ("maria at firma dot pl", "maria at firma dot pl"),
    ("ask maria at firma dot online now", "maria at firma dot online"),
    ("maria arobase firma point pl", "maria arobase firma point pl"),
    ("john-AT-host.org", "john-AT-host.org"),
    ("a dot " * 30 + "z at mail dot se", "a dot " * 30 + "z at mail dot se"),
])
def test_said_addresses_of_any_ending_and_length(text, found):
    assert [text[s.start:s.end] for s in pii.hidden_spans(text, pii.plain_spans(text))] == [found]


@pytest.mark.parametrize("text", ["water at boiling point and above", "stood at red dot and left", "we met at meeting point we knew", "look at my dot pl"])
def test_sentences_are_no_said_addresses(text):
    assert pii.hidden_spans(text, pii.plain_spans(text)) == []


@pytest.mark.parametrize("text", [
    "the shop at home dot depot sale", "stop at noon dot please call", "sat at table point de vue", "met at some point in may"])
def test_words_are_no_endings(text):
    assert pii.hidden_spans(text, pii.plain_spans(text)) == []


@pytest.mark.parametrize("text", ["j_doe at firma dot depot", "j dot doe at firma dot depot", "doe at mail dot firma dot depot", "maria at firma point com"])
def test_more_evidence_allows_any_ending(text):
    assert [text[s.start:s.end] for s in pii.hidden_spans(text, pii.plain_spans(text))] == [text]


def test_long_blanks_and_many_addresses_take_linear_time():
    started = time.monotonic()
    blanks = " " * 1_000_000
    text = f"bob at host dot com,{blanks}dot{blanks}, a at{blanks}, one{blanks}two"
    assert pii.hidden_spans(text, pii.plain_spans(text))[0] == pii.Span(0, 0, 19)
    many = " ".join(f"u{i} [at] host{i} (dot) org, a{i}@b.com" for i in range(50_000))
    plain = pii.plain_spans(many)
    assert len(plain) == 50_000 and len(pii.hidden_spans(many, plain)) == 50_000
    assert time.monotonic() - started < 60


def test_rewriting_keeps_places():
    copy = pii.Rewritten("abcdef")
    copy.apply([(1, 3, "X"), (4, 5, "")])
    assert copy.text == "aXdf"
    copy.apply([(1, 3, "YZ")])
    assert copy.text == "aYZf" and copy.source(1, 2)[:2] == (1, 4) and copy.source(3, 4)[:2] == (5, 6)


def test_find_and_mask_on_odd_rows(documents):
    docs = documents(ODD + [(9, "mail a.b@c.org or 10.1.2.3")])
    rows = {(r["doc_id"], r["spans"]): r for r in pii.find(docs).collect()}
    assert len(pii.find(docs).collect()) == len(ODD) + 1
    found = rows[(9, "email:5:14,ip:18:26")]
    assert (found["n_email"], found["n_ip"]) == (1, 1)
    assert found["base_sha256"] == hashlib.sha256(b"email:5:14,ip:18:26").hexdigest()
    assert rows[(1, "")]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    row = masked.where("doc_id = 9").first()
    assert row["text"] == "mail <email> or <ip>" and row["n_chars"] == len(row["text"])
    assert masked.where("doc_id = 1").first()["text"] is None
    assert pii.find(documents([])).count() == 0 and pii.mask(documents([])).count() == 0


# ---- language ------------------------------------------------------------------------------------


def test_language_on_held_out_and_odd_rows(spark, documents, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = remainder("doc_id", 4) == 2
    model = language.train(docs.where(~held))
    out = language.predict(docs, model, {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "held_out": held}).toPandas()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id] == out.held_out.tolist()
    assert (out.lang == out.lang_pred)[out.held_out].mean() > 0.97
    odd = {r["doc_id"]: r for r in language.predict(documents(ODD), model, {"doc_id": F.col("doc_id")}).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert odd[8]["lang_pred"] == "en" and 0 <= odd[7]["score"] <= 1
    empty = language.train(documents([]))
    assert {r["lang_pred"] for r in language.predict(documents(ODD), empty, {"doc_id": F.col("doc_id")}).collect()} == {"und"}


def plain_grams(text):
    """Bucket of every run of 1 to 3 characters of the lower-cased text."""
    low, out = text.lower(), []
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            value = 11
            for c in low[i:i + n]:
                value = (value * 0x9E3779B1 + ord(c)) % 2**32
            out.append(((value ^ value >> 15) * 0x85EBCA77) % 2**32 >> 17)
    return collections.Counter(out)


def found_grams(texts):
    out = collections.defaultdict(collections.Counter)
    for numbers, codes, ends, cut in language._batches(texts):
        owner = np.repeat(numbers, np.diff(ends, prepend=0))
        for bucket in language._buckets(codes, ends, cut):
            for i, g in zip(owner.tolist(), bucket.tolist()):
                if g < language.BUCKETS:
                    out[i][g] += 1
    return out


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_language_grams_equal_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    texts = ["abca", "", None, "zé", "q", "Onde thetion rea, ÄÖ!", "a" * 50, "xy" * 9]
    found = found_grams(texts)
    assert all(found[i] == plain_grams(t or "") for i, t in enumerate(texts))


def test_every_gram_of_a_long_text_counts_once():
    text = "".join(random.Random(2).choices("abcdé ", k=600_000))
    plain = plain_grams(text)
    counts = np.zeros(language.BUCKETS + 1, dtype=np.int64)
    for _, codes, ends, cut in language._batches([text]):
        for bucket in language._buckets(codes, ends, cut):
            counts += np.bincount(bucket, minlength=language.BUCKETS + 1)
    assert {g: n for g, n in enumerate(counts[:-1].tolist()) if n} == dict(plain)


def test_language_equals_plain_naive_bayes(documents):
    rng = random.Random(7)
    letters = {"en": "abcdef th", "fr": "abcdéè qu", "de": "abcdäö ch"}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.randint(0, 40))), lang) for i, lang in enumerate(rng.choices(list(letters), k=60))]
    docs = documents([*rows, (99, None, "en"), (98, "no label here", None)])
    model = language.train(docs)
    out = language.predict(docs, model, {"doc_id": F.col("doc_id")}).collect()
    logs = {}
    for lang in letters:
        total = sum((plain_grams(t) for _, t, l in rows if l == lang), collections.Counter())
        size = sum(total.values()) + 0.1 * language.BUCKETS
        logs[lang] = lambda g, total=total, size=size: math.log((total[g] + 0.1) / size)
    texts = {i: t for i, t, _ in rows} | {98: "no label here"}
    assert len(out) == 62
    for r in out:
        text = texts.get(r["doc_id"])
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        points = {lang: sum(n * log(g) for g, n in plain_grams(text).items()) for lang, log in logs.items()}
        best = max(sorted(points), key=points.__getitem__)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 / sum(math.exp(p - points[best]) for p in points.values()))


@pytest.mark.parametrize("text", ["½ ²", "① Ⅷ", "12 _ !", " ", "٣"])
def test_signs_that_are_no_letters(text):
    model = language.Model(["en", "fr"], np.zeros((2, language.BUCKETS + 1)), np.zeros(2))
    assert model.predict([text])[0] == ["und"] and model.predict([text + "a"])[0] == ["en"] and not language.has_letter(text)


def test_accepted_rows(documents):
    rows = [(1, "the cat sat on the mat and then the dog", "en"), (2, "le chat est sur la table avec le chien", "fr"), (3, None, "en"), (4, "12 ½", "fr"), (5, "zzzz", None)]
    docs = documents(rows)
    model = language.train(docs)
    out = language.accepted(docs, model)
    assert out.columns == docs.columns and {1, 2} <= {r.doc_id for r in out.collect()} <= {1, 2, 5}
    assert {r.doc_id for r in language.accepted(docs, model, least=1.1).collect()} == set()
    unlabelled = language.train(docs.limit(0))
    assert {r.doc_id for r in language.accepted(docs, unlabelled).collect()} == {1, 2, 5}


# ---- SimHash -------------------------------------------------------------------------------------


def naive_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_equal_plain_ones():
    for text in (None, "", "a", "a B", "a b c", "A b c D e f a b c", "é\u00a0x y\x0bz\x1cw v", "one two three " * 50):
        assert simhash.fingerprint(text) % (1 << 64) == naive_fingerprint(text)


def plans_of(monkeypatch, module):
    """Plans of what the module and the components stage from now on."""
    plans = []
    for where in (module, sys.modules[components.__module__]):
        def spied(df, name, staged=where.stage):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return staged(df, name)

        monkeypatch.setattr(where, "stage", spied)
    return plans


def test_no_side_of_a_join_of_fingerprints_goes_through_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3 * 50 + k) % 997}" for k in range(60)) + f" {i}") for i in range(60)], "doc_id long, text string")
    plans = plans_of(monkeypatch, simhash)
    plans.append(simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("Broadcast" in p for p in plans)


def test_no_side_of_a_join_of_shingles_goes_through_the_driver(spark, monkeypatch):
    words = [[f"w{g}x{k}" for k in range(80)] for g in range(8)]
    docs = spark.createDataFrame([(8 * n + g, " ".join(w[:40] + [f"v{n}"] + w[40:])) for n in range(4) for g, w in enumerate(words)], "doc_id long, text string")
    plans = plans_of(monkeypatch, simhash)
    kept = simhash.keep_one(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans) and sorted(r.doc_id for r in kept.collect()) == list(range(8))


def test_no_side_of_a_join_of_words_goes_through_the_driver(spark, documents, monkeypatch):
    words = spark.createDataFrame([("linkea", 3), ("linkeb", 8), ("linkxb", 20)], "word string, n long")
    near = variants.near(words)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 2
    plans = plans_of(monkeypatch, variants)
    out = variants.variants(documents([(1, "linkea " * 3 + "linkeb " * 8 + "linkxb " * 20)]))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans) and out.count() == 3


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_links_equal_all_pairs(spark, crowd):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 20)] + [0, 1, 3, 7, -1, -2]
    fps = set(base)
    for x in base:
        for n in (1, 2, 3, 2, 1):
            flips = rng.choice(64, n, replace=False)
            fps.add(int(np.uint64(x % 2**64) ^ np.uint64(sum(1 << int(b) for b in flips)).astype(np.uint64)) )
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) % 2**64).bit_count() <= 2}


def test_groups_of_odd_rows(documents):
    docs = documents(ODD)
    out = simhash.near_duplicates(docs).toPandas()
    groups = {i: c for i, c in zip(out.doc_id, out.component_id) if i == i}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[6] == 5 and groups[8] == 8 and len(out) == len(ODD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]  # the row without an id is alone
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.keep_one(documents([])).count() == 0


def test_rows_without_an_id_are_kept_by_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a, "x"), (None, a, "y"), (None, b, "x"), (1, c, "x"), (None, c, "y"), (None, None, "x"), (None, "", "y")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, `group` string"))
    assert kept.columns == ["doc_id", "text", "group"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, a), (0, b), (1, c)]


def test_one_of_similar_texts_stays(spark):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 240)]
        texts.append(words)
        for changed in (1, 2, 3, 5, 8, 12, 20, 40):
            other = list(words)
            for at in rng.choice(len(words), changed, replace=False):
                other[at] = f"v{rng.integers(0, 5000)}"
            texts.append(other)
        texts += [words[:120] + [f"u{g}{i}" for i in range(120)], words]
    runs = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def linked(a, b):
        shared = len(runs[a] & runs[b])
        return shared / (len(runs[a]) + len(runs[b]) - shared) >= 0.8

    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if linked(a, b)]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [i for i, r in enumerate(root) if i == r]
    for g in range(6):  # one changed word of 240 goes, half a text or 40 changed words stay
        assert 11 * g + 1 not in kept and 11 * g + 10 not in kept and {11 * g, 11 * g + 8, 11 * g + 9} <= set(kept)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- packing -------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary())
    texts = [None, "", "  ", "It's I'LL 'S don't x's", "é ́x ñ a\u200bc ﬁ ½ 12a3 İ Σ ΑΣ", "<|endoftext|> a<|startoftext|>b", "a\x1cb \x85c\u2003d", "Word, word. (word) | --- a.b,c 3.14 $5",
             "\ue000 x", "ÀÉ straße,ok", LONG[:5000]]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.Coder(vocabulary()).encode(pa.array(texts))]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_fullest_is_the_best_subset():
    random.seed(1)
    for _ in range(200):
        counts = dict(collections.Counter(random.randint(1, 12) for _ in range(random.randint(0, 7))))
        room = random.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.fullest(counts, room)
        assert all(0 < n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def check_packed(out, capacity):
    for _, seq in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert seq["offset"].tolist() == (np.cumsum(seq["length"]) - seq["length"]).tolist() and seq["length"].sum() <= capacity


def test_packing_round_trip(documents, monkeypatch):
    docs = documents(ODD)
    cut = packing.pieces(docs, vocabulary(), 64).toPandas()
    for deals in (packing.PER_WINDOW, 50):
        monkeypatch.setattr(packing, "PER_WINDOW", deals)
        out = packing.pack_documents(docs, vocabulary(), 64).toPandas()
        check_packed(out, 64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(str, out[names].values.tolist())) == sorted(map(str, cut[names].values.tolist()))
        assert out["sequence_id"].nunique() == math.ceil(out["length"].sum() / 64)
    assert (cut[cut.doc_id == 1].length == 1).all() and cut[cut.doc_id == 8].length.sum() > 64
    assert packing.pack_documents(documents([]), vocabulary()).count() == 0


# ---- language model ------------------------------------------------------------------------------


def naive_katz(texts, held):
    """Scores by dictionaries, as the operator's docstring has it."""
    coded = [words_of(t) + [b"\n"] for t in texts]
    words, pairs = collections.Counter(), collections.Counter()
    for t, h in zip(coded, held):
        if not h:
            words.update(t)
            pairs.update(zip([b"\n", *t[:-1]], t))
    total, kinds = sum(words.values()), len(words)
    base = [sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t) for t in coded]
    f1, f2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in (words, pairs))
    keep = lambda f, r: f[r] * r if r <= katz.TRUSTED else r
    used = sum(keep(f1, r) for r in words.values())
    whole = total if total - used > 0 else total + 1
    prob = lambda w: keep(f1, words[w]) / whole if words[w] else (whole - used) / whole
    after = collections.defaultdict(dict)
    for (v, w), r in pairs.items():
        after[v][w] = r
    weights = {}
    for v, seen in after.items():
        n, u = sum(seen.values()), sum(keep(f2, r) for r in seen.values())
        n = n if n - u > 1e-9 else n + 1
        weights[v] = n, (n - u) / n / (1 - sum(map(prob, seen)))
    score = [0.0] * len(coded)
    for i, t in enumerate(coded):
        for v, w in zip([b"\n", *t[:-1]], t):
            p = prob(w) if v not in after else keep(f2, after[v][w]) / weights[v][0] if w in after[v] else weights[v][1] * prob(w)
            score[i] += math.log10(p)
    for v, seen in after.items():  # every distribution sums to one
        mass = sum(keep(f2, r) / weights[v][0] for r in seen.values())
        mass += weights[v][1] * (sum(prob(w) for w in words if w not in seen) + (whole - used) / whole)
        assert abs(mass - 1) < 1e-9
    return coded, words, base, score


@pytest.mark.parametrize("sizes", [None, (40, 60, 5)])
def test_katz_scores_equal_plain_ones(documents, monkeypatch, sizes):
    if sizes:  # several parts, chunks of few rows and frequent histories
        monkeypatch.setattr(katz, "WORDS", sizes[0])
        monkeypatch.setattr(katz, "PAIRS", sizes[1])
        monkeypatch.setattr(katz, "FREQUENT", sizes[2])
        monkeypatch.setattr(katz, "CHUNK_ROWS", 7)
    random.seed(2)
    texts = [" ".join(random.choice("abcdefghij") * random.randint(1, 2) for _ in range(random.randint(0, 30))) for _ in range(60)]
    texts += ["A b c new words a a a", "x", "", None]
    held = [i % 5 == 1 for i in range(len(texts))]
    docs = documents(list(enumerate(texts)))
    out = katz.score(docs, F.col("doc_id") % 5 == 1).toPandas().sort_values("doc_id")
    coded, words, base, score = naive_katz(texts, held)
    assert out.held_out.tolist() == held and out.n_tokens.tolist() == [len(t) for t in coded]
    assert out.n_known.tolist() == [sum(w in words for w in t) for t in coded]
    assert set(out.train_tokens) == {sum(words.values())}
    assert np.allclose(out.base_score, base) and np.allclose(out.score, score)


def test_katz_on_odd_rows(documents):
    out = katz.score(documents(ODD), remainder("doc_id", 5) == 1).toPandas()
    assert len(out) == len(ODD) and out.doc_id.isna().sum() == 1 and np.isfinite(out.score).all()
    assert katz.score(documents([]), F.lit(False)).count() == 0
    untrained = katz.score(documents(ODD), F.lit(True)).toPandas()
    assert (untrained.train_tokens == 0).all() and (untrained.score == 0).all()


# ---- mixing --------------------------------------------------------------------------------------


def test_rates_meet_the_targets(spark, folder):
    from courtlens.llm.queries import quality_labels
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), quality_labels(spark, folder)
    out = mixing.rates(docs, labels).toPandas()
    assert (out.rate >= 0).all()
    for name, share in mixing.TARGETS.items():
        assert abs((out.rate * out.n_tokens * out[f"p_{name}"]).sum() / out.n_tokens.sum() - share) < 1e-4
    known = out.merge(labels.toPandas(), on="doc_id")
    best = known[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy().argmax(axis=1)
    assert np.mean([mixing.DOMAINS[k] == d for k, d in zip(best, known.domain)]) > 0.9


def test_unreachable_targets_give_least_squares(spark):
    rows = [(i, 10 + i, p, 1 - p, 0.0) for i, p in enumerate((0.9, 0.8, 0.6, 0.7))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double")
    targets = {"high": 0.1, "low": 0.9, "toxic": 0.0}
    steps = mixing.fit_rates(members, targets)
    rate = np.array([r.r for r in members.select(mixing.rate_after(steps).alias("r")).collect()])
    n, p = np.array([r[1] for r in rows], float), np.array([r[2:] for r in rows])
    def miss(x):
        return (((n * x) @ p - np.array([0.1, 0.9, 0.0]) * n.sum()) ** 2).sum()
    best = np.ones(4)
    for _ in range(20_000):
        best = np.maximum(0, best - 0.002 * (p @ ((n * best) @ p - np.array([0.1, 0.9, 0.0]) * n.sum())) / 10)
    assert (rate >= 0).all() and miss(rate) <= miss(best) * 1.02 + 1e-6


def test_mixture_on_odd_rows(spark, documents):
    docs = documents(ODD)
    labels = spark.createDataFrame([(5, "high"), (8, "low"), (5, "low"), (None, "high"), (99, "toxic"), (4, None)], "doc_id long, domain string")
    assert mixing.rates(docs, labels).count() == len(ODD)
    out = mixing.sampled(docs, labels)
    plain = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    drawn = collections.Counter((r.doc_id, r.text) for r in out.collect())
    rate = {r.doc_id: r.rate for r in mixing.rates(docs, labels).collect()}
    assert out.columns == docs.columns and set(drawn) <= set(plain)
    assert all(math.floor(rate[i]) * n <= drawn[i, t] <= math.ceil(rate[i]) * n for (i, t), n in plain.items())
    none = labels.limit(0)
    assert mixing.rates(docs, none).count() == len(ODD)
    assert mixing.rates(documents([]), labels).count() == 0 and mixing.sampled(documents([]), labels).count() == 0


# ---- licenses ------------------------------------------------------------------------------------


def naive_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for t in licenses.BASE:
        phrase = t.text.split()
        found = [i for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
        places += found
        labels |= {t.label} if found else set()
    return len(words), places, ",".join(sorted(labels))


def test_license_places_equal_plain_ones(documents):
    random.seed(4)
    pool = "under the mit license apache version 2 cc by nc é x".split()
    texts = [" ".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(80)]
    texts += ["Released UNDER the MIT-License. under the mit license", "CC BY-NC CC by nc 4.0", "(Apache License, Version 2.0)", None, "", LONG + "Under the MIT License",
              "permission is hereby granted, at no cost and free of charge to any person obtaining a copy of this software and associated documentation files"]
    out = {r["doc_id"]: r for r in licenses.annotate(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        n, places, labels = naive_places(text)
        row = out[i]
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (n, len(places), labels), text
        assert (row["first_word"], row["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert set(filter(None, labels.split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert out[len(texts) - 1]["labels"] == "mit" and out[len(texts) - 1]["base_labels"] == ""
    rows = [(None, "nothing here at all"), (None, "under the mit license"), (7, "cc by nc"), (7, "plain words only"), (7, None), (None, "under the mit license")]
    found = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["base_labels"]) for r in licenses.annotate(documents(rows)).collect())
    assert found == {(None, 4, 0, ""): 1, (None, 4, 1, "mit"): 2, (7, 3, 1, "cc-by-nc"): 1, (7, 3, 0, ""): 1, (7, 0, 0, ""): 1}
    assert licenses.annotate(documents(ODD)).count() == len(ODD) and licenses.annotate(documents([])).count() == 0


def test_all_pairs_at_four_fifths_are_linked_and_no_others(spark):
    rng = random.Random(7)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 90, 200]))]
        for _ in range(12):
            other = list(base)
            for at in rng.sample(range(len(base)), rng.randint(1, max(2, len(base) // 25))):
                other[at] = f"v{rng.randrange(4000)}"
            texts.append(other)
    runs = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b])]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [i for i, r in enumerate(root) if i == r]


def test_equal_fingerprints_are_not_copies(spark):
    texts = [" ".join(["ha"] * 300 + [f"z{g}x{i}" for i in range(60)]) for g in range(6)]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(6))


def test_fingerprints_are_the_first_way_to_similar_texts(spark):
    words = [f"w{k}" for k in range(400)]
    line = " ".join(["the same long line of a page foot"] * 60)
    texts = [" ".join(words), " ".join(words[:399] + ["other"]), line + " one", line + " two and more", "far from all of these texts", "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash._shingles(docs, "doc_id", "text").cache()
    named = {r["fp"]: r["doc_id"] for r in rows.orderBy(F.desc("doc_id")).collect()}
    prints = {r["doc_id"]: r["print"] for r in rows.collect()}
    assert prints == {k: simhash.fingerprint(t) for k, t in enumerate(texts)}
    met = {tuple(sorted((named[r["u"]], named[r["v"]]))) for r in simhash._near_prints(rows).collect()}
    near = {(a, b) for a in range(6) for b in range(a + 1, 6) if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 2}
    assert met == near and (0, 1) in met
    placed = spark.createDataFrame([(1, 9, 0, 5), (2, 9, 0, 5), (2, 9, 1, -7), (3, 9, 0, -8), (4, 9, 0, -8), (4, 9, 1, 6)], "fp long, size int, at int, token int")
    assert {r["token"] for r in simhash._shared(placed).collect()} == {5, -8}


def test_near_duplicates_leave_few_files(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900 + i, t) for i, t in enumerate(texts[:50])], "doc_id long, text string")
    before = spark.conf.get(TIDY)
    folder = os.path.dirname(shared_folder(spark, "none")).removeprefix("file:")
    already = set(os.listdir(folder))
    kept = simhash.keep_one(docs)
    left = {f.rsplit("-", 1)[0] for f in os.listdir(folder) if f not in already}
    assert "groups" in left and not left & {"shingled", "classes", "placed", "shared", "met", "shingles"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    assert spark.conf.get(TIDY) == before


def test_sketches_drop_no_link_and_spare_most_lists(spark):
    rng = np.random.default_rng(5)
    lists = [np.zeros(0, np.int32)]
    for size in (1, 5, 60, 64, 65, 300, 1100):
        base = rng.choice(np.arange(-2**31, 2**31, 97), 2 * size, replace=False).astype(np.int32)
        lists += [np.sort(base[a:a + n]) for a in (0, size // 20, size // 10, size // 4, size) for n in (size, size * 9 // 10, size * 4 // 5) if n]
    sketches = [simhash._sketch(x) for x in lists]
    for x, p in zip(lists, sketches):
        assert len(p) * 8 <= max(64, 2 * len(x))
        for y, q in zip(lists, sketches):
            assert simhash._least_apart(p, q) == simhash._least_apart(q, p) <= len(np.setxor1d(x, y))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(lists)], "fp long, shingles array<int>")
    pairs = [(a, b) for b in range(len(lists)) for a in range(b)]
    near = {(a, b) for a, b in pairs if 5 * len(np.intersect1d(lists[a], lists[b])) >= 4 * len(np.union1d(lists[a], lists[b]))}
    met = spark.createDataFrame(pairs, "u long, v long")
    possible = {tuple(r) for r in simhash._possible(rows, met).collect()}
    assert near <= possible and len(possible) < len(near) + len(pairs) // 10
    assert {tuple(r) for r in simhash._confirmed(rows, met).collect()} == near


def test_only_linked_rows_travel_for_their_root(spark):
    rows = spark.createDataFrame([(5, k, 9, 0, k == 1) for k in (1, 2, -3, 4, 1 + (1 << 25))], "token int, fp long, size int, at int, is_pivot boolean")
    roots = spark.createDataFrame([(-3, -3), (1, -3)], "fp long, root long")
    named = simhash._named(rows, roots)
    assert {(r.fp, r.root) for r in named.collect()} == {(1, -3), (2, 2), (-3, -3), (4, 4), (1 + (1 << 25), 1 + (1 << 25))}


def test_only_open_ids_travel(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (3, "d"), (None, "e"), (4, "f"), (4, "g")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 1), (None, None), (4, 1), (4, 4)], "doc_id long, component_id long")
    kept = simhash._kept(docs, found, "doc_id", "text")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (2, "b"), (4, "f")]


def test_a_bit_map_takes_no_job_for_each_partition(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "23")):
        spark.conf.set(n, value)
    group = "bit map"
    spark.sparkContext.setJobGroup(group, group)
    try:
        hashes = np.arange(0, 1 << 22, 77777)
        bits = bit_map(spark.createDataFrame([(int(h),) for h in hashes], "h long"), 1 << 22)
        assert is_set(bits, hashes).all() and np.unpackbits(bits).sum() == len(hashes)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for n, value in zip(names, before):
            spark.conf.set(n, value)
