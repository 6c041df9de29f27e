"""Slot shards, spelling variants and phrases against plain Python, and on odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from courtlens.llm import common, phrases, sharding, variants
from .conftest import LONG, ODD

# ---- slot shards ---------------------------------------------------------------------------------


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("per_window", [sharding.PER_WINDOW, 3])
def test_shards_are_even_and_gapless(documents, per_window):
    rng = random.Random(5)
    docs = documents([(i, "é" * rng.randint(0, 400)) for i in range(3000)])
    out = rows_of(sharding.shard(docs, shards=7, slots=256, per_window=per_window))
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    weights, grown = collections.Counter(), collections.Counter()
    for r in out:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        weights[r["shard"]] += r["size"]
        grown[r["next_shard"]] += r["size"]
        assert r["next_shard"] in (r["shard"], 7)
    assert set(weights) == set(range(7)) and max(weights.values()) < 1.02 * min(weights.values())
    assert set(grown) == set(range(8)) and max(grown.values()) < 1.1 * min(grown.values())
    for shard in range(7):
        places = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert places == list(range(len(places)))
    slots = {}
    assert all(slots.setdefault(r["virtual_slot"], r["shard"]) == r["shard"] for r in out)


def test_copies_of_one_record_are_spread(spark):
    rows = [(None, "same words " * 5)] * 3000 + [(i, f"text {i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = rows_of(sharding.shard(docs, shards=5, slots=512, crowd=100))
    weights = collections.Counter()
    for r in out:
        weights[r["shard"]] += r["size"]
    assert len(out) == 4500 and max(weights.values()) < 1.05 * min(weights.values())
    for shard in range(5):
        places = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert places == list(range(len(places)))


def test_shards_of_odd_rows(documents):
    out = rows_of(sharding.shard(documents(ODD)))
    assert len(out) == len(ODD)
    sizes = collections.Counter((r["doc_id"], r["size"]) for r in out)
    assert sizes == collections.Counter((d, len((t or "").encode()) + 16) for d, t in ODD)
    assert sharding.shard(documents([])).count() == 0
    again = rows_of(sharding.shard(documents(ODD, extra=False)))
    key = lambda r: (str(r["doc_id"]), r["size"], r["virtual_slot"], r["shard"], r["next_shard"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_edits_of_the_slot_map(spark):
    rng = random.Random(1)
    loads = [sharding.Slot(s, rng.randint(1, 1000), 1) for s in range(500)]
    first = sharding.first_map(loads, 6, 500)
    more = sharding.grown(first, loads)
    assert all(more[s] in (first[s], 6) for s in first) and set(more.values()) == set(range(7))
    drifted = [sharding.Slot(s.slot, s.bytes * (5 if first[s.slot] == 2 else 1), 1) for s in loads]
    even = sharding.evened(first, drifted)
    size = {s.slot: s.bytes for s in drifted}
    weights = collections.Counter()
    for s, shard in even.items():
        weights[shard] += size[s]
    assert max(weights.values()) - min(weights.values()) <= 0.01 * sum(weights.values()) / 6
    assert all(even[s] == first[s] or first[s] == 2 or even[s] != 2 for s in first)
    assert sharding.evened(first, []) == first and sharding.grown({}, []) == {}
    maps = sharding.SlotMaps(spark)
    maps.write(1, first)
    maps.write(2, more)
    assert {r.virtual_slot: r.shard for r in maps.read(2).collect()} == more
    with pytest.raises(Exception):
        maps.write(1, more)  # a version is written once


# ---- spelling variants ---------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_variants_equal_all_pairs(documents, symbols):
    rng = random.Random(symbols)
    letters = "abÀÿé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=60)).replace("ab", "Ab") + ". x-Y") for i in range(60)]
    rows += [(None, " ".join(words[:40])), (3, None), (4, ""), (61, "a" * 3000 + " " + "a" * 2999 + " b")] * 3
    rows += [(70, " ".join(["link" + end] * n)) for end, n in (("ea", 3), ("eb", 8), ("xb", 20), ("xby", 70))]
    out = {tuple(r) for r in variants.variants(documents(rows), symbols=symbols).collect()}
    assert out == plain_variants(rows)
    assert {(form, root) for word, form, root, *_ in out if word == "linkea"} == {("linkeb", "linkxby")}


@pytest.mark.parametrize("together", [1 << 20, 5])
def test_neighbourhood_is_full(monkeypatch, together):
    monkeypatch.setattr(variants, "_TOGETHER", together)
    rng = np.random.default_rng(2)

    def hash_of(word):
        return int(variants.hashes_of(word, np.array([len(word)]))[0])

    for _ in range(30):
        words = rng.integers(1, 4, (2, rng.integers(1, 8))).astype(np.uint64)
        got = {(0, False): set(), (1, False): set(), (0, True): set(), (1, True): set()}
        for row, keys, longer in variants.neighbourhoods(words, 3):
            for r, k in zip(row.tolist(), keys.tolist()):
                got[r, longer].add(k)
        for r, word in enumerate(words):
            replaced, inserted = set(), set()
            for i in range(len(word) + 1):
                for c in (1, 2, 3):
                    inserted.add(hash_of(np.insert(word, i, c)))
                    if i < len(word) and c > word[i]:
                        other = word.copy()
                        other[i] = c
                        replaced.add(hash_of(other))
            assert got[r, False] == replaced and got[r, True] == inserted


def test_variants_of_odd_rows(documents):
    out = {tuple(r) for r in variants.variants(documents(ODD)).collect()}
    assert out == plain_variants(ODD)
    assert variants.variants(documents([])).count() == 0


# ---- phrases -------------------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found, longer = [], collections.Counter()
        for p, a in f.items():
            if a < least or len(p) < 2:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), p, f[p[:k]], f[p[k:]]))
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        kept = sorted(x for x in found if 100 * longer[x[3]] < 80 * -x[1])
        total = sum(n for p, n in f.items() if len(p) == 1)
        out |= {(lang, rank, phrase.decode(), -a, left, right, total, -score)
                for rank, (score, a, phrase, _, left, right) in enumerate(kept[:top], 1)}
    return out


def phrase_rows(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(120):
        words = [rng.choice("a b c é Ü d\x00 x y".split(" ")) for _ in range(rng.randint(0, 60))]
        words += [rng.choice([". ", " , ", "\n", "\t", "\x0b", " "]).join(["so", "it", "goes"]), passage.upper() if i % 3 == 0 else ""]
        rows.append((i, " ".join(words), rng.choice(["en", "fr", None])))
    return rows + [(None, "so it goes", "en"), (7, None, "en"), (7, "", None), (8, " \t.\n", "de")] * 2


@pytest.mark.parametrize("bits,size", [(1 << 27, 1 << 22), (1 << 16, 300)])
def test_phrases_equal_plain_counts(documents, monkeypatch, bits, size):
    monkeypatch.setattr(common, "MARKS", bits)
    monkeypatch.setattr(phrases, "_BYTES", size)
    rows = phrase_rows(size)
    out = rows_of(phrases.mine(documents(rows).repartition(3), least=12, top=25))
    assert {tuple(list(r.values())[:8]) for r in out} == plain_phrases(rows, 12, 25)
    on_passage = {r["path"]: r for r in out if r["path"] and r["phrase"].startswith("p")}
    assert all(r["path_words"] >= 30 and 0 <= r["path_at"] <= r["path_words"] - 4 for r in on_passage.values()) and len(on_passage) <= 3


def test_phrases_of_odd_rows(documents):
    rows = [(d, t, "en") for d, t in ODD]
    out = rows_of(phrases.mine(documents(rows)))
    assert {tuple(list(r.values())[:8]) for r in out} == plain_phrases(rows, 30, 2000) and LONG
    assert phrases.mine(documents([])).count() == 0


def test_flows_follow_from_edges(spark):
    words = [random.Random(3).choice("abc") for _ in range(200)]
    graph = phrases.edges(spark.createDataFrame([("en", " ".join(words), 2)], "lang string, run string, n long"))
    for size, level in enumerate(phrases.flows(graph), 1):
        plain = collections.Counter(" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
        assert {r.gram: r.n for r in level.collect()} == {g: 2 * n for g, n in plain.items()}
