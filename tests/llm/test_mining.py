"""Phrases, near vectors and conversation repair against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import make

from gristmill.llm import cap_filters, dialogue, phrases


def phrases_by_force(rows, least=30, top=2000, covered=80):
    f, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            words[lang] += len(w)
            f.update((lang, tuple(w[k : k + n])) for n in (1, 2, 3, 4) for k in range(len(w) - n + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[k : k + n]) for (lang, w), a in found.items() for n in range(2, len(w)) for k in range(len(w) - n + 1) if 100 * a >= covered * f[lang, w[k : k + n]]}
    by_lang = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r, p.decode(), -a, x, y, words[lang], -s) for lang, each in by_lang.items() for r, (s, a, p, x, y) in enumerate(sorted(each)[:top], 1)}


def phrase_rows(n=400, seed=5):
    """Zipf-like words, a very common pair, a passage that many texts share, pieces without marks, repeated words."""
    rng = random.Random(seed)
    words = ["the", "of", "Über", "naïve", "日本", "x1", "a|b", "don't", *(f"w{k}" for k in range(60))]
    rows = [("en", None), (None, "one two " * 40), ("und", "ONE two\tone  two"), ("en", ""), ("en", "la " * 500), ("de", "no break " * 40), ("en", "x" * 3000)]
    for k in range(n):
        w = [words[min(int(rng.expovariate(0.12)), len(words) - 1)] for _ in range(rng.randint(1, 60))]
        if k % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = ["very", "common", "pair"]
        if k % 7 == 0:
            w += "a passage of words that several texts share".split()
        rows.append((rng.choice(["en", "en", "de", None]), "".join(x + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]) for x in w)))
    return rows


@pytest.mark.parametrize("most,least", [(phrases.NUMBERED, 30), (25, 30), (0, 12)])
def test_phrases(spark, most, least, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, t, 1, "clash") for lang, t in rows], "lang string, text string, n int, word string").repartition(7)
    out = phrases.collocations(docs, least=least, most=most)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == phrases_by_force(rows, least)
    few = {tuple(r) for r in phrases.collocations(docs, least=least, top=5, most=most).collect()}
    assert few == phrases_by_force(rows, least, top=5)


def test_no_phrases(spark, empty):
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(make(spark, [(1, None, "en", "a"), (2, "a b", "en", "a")])).collect() == []


def test_long_pieces_and_slices(monkeypatch):
    """Slices end between pieces, and a piece that is longer than a slice stays whole."""
    import pyarrow as pa

    texts = ["a bb ccc. dd " * 50 + "\n", "no end " * 100 + "\n", "\n", "tail\n"]
    seeds = np.array([1, 1, 1, 2], np.uint64)

    def hashes(size):
        monkeypatch.setattr(phrases, "SLICE", size)
        out = []
        for w in phrases.tokenise(pa.array(texts), seeds):
            piece = np.concatenate(([0], np.cumsum(np.diff(w.piece) != 0)))
            out += [(int(h), int(r)) for h, r in zip(w.hash, w.row)]
            assert all(len(set(w.row[piece == p])) == 1 for p in set(piece))
        return out

    whole = hashes(1 << 20)
    assert len(whole) == 50 * 4 + 200 + 1 and all(hashes(n) == whole for n in (1, 16, 64, 300))
    assert len({h for h, _ in whole}) == 4 + 2 + 1


def test_two_words_of_one_hash_end_the_job(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "one two")], "lang string, text string")
    rows = phrases.vocabulary(docs).collect()
    assert sorted((r.word, r.n) for r in rows) == [("one", 1), ("two", 1)] and len({r.h for r in rows}) == 2


def vectors_by_force(rows, least=0.95):
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)] = min(ids.get(top(k), i), i)
    return Counter((i, links[k], ids.get(top(k)), i is not None and i == ids.get(top(k))) for k, (i, _) in enumerate(rows))


def vector_rows(seed=4):
    rng, out = np.random.default_rng(seed), []
    for size in (40, 12, 7, 3, 2, 1, 1):
        centre = rng.standard_normal(24)
        out += [(centre + rng.standard_normal(24) * 0.1).astype(np.float32).tolist() for _ in range(size)]
    chain = rng.standard_normal(24)
    step = rng.standard_normal(24) * 0.08
    out += [(chain + k * step).astype(np.float32).tolist() for k in range(20)]
    rows = list(enumerate(out))
    rows += [(1000 + k, out[k % 3]) for k in range(25)] + [(5, out[5]), (None, out[0]), (None, [9.0, 1.0]), (2000, None), (2001, []), (2002, [0.0] * 24)]
    return rows + [(2003, [None] * 24), (2004, [float("nan")] + [1.0] * 23), (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [3.0])]


@pytest.mark.parametrize("tile", [16, 1024])
def test_near_vectors(spark, tile):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, node string").repartition(4)
    found = Counter(tuple(r) for r in cap_filters.near_vectors(df, tile=tile).collect())
    assert found == vectors_by_force(rows)


def test_near_vectors_of_strings_and_none(spark):
    df = spark.createDataFrame([("b", [1.0, 1.0]), ("a", [1.0, 1.0]), ("c", [1.0, -1.0])], "vec_id string, embedding array<double>")
    assert {tuple(r) for r in cap_filters.near_vectors(df).collect()} == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)}
    assert cap_filters.near_vectors(df.limit(0)).collect() == []


def test_filters_are_decoded_whole():
    """Decoding part by part gives the filters that all directions, made one by one, give; vectors close by share one."""
    rng = np.random.default_rng(3)
    p = cap_filters.plan(4000)._replace(filters=1000)
    x = rng.standard_normal((50, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, number = cap_filters.decode(x, p, 1)
    rotation, words = cap_filters._code(24, p.filters, p.seed, 1)
    assert len(words) == 2
    directions = np.concatenate([np.repeat(words[0], len(words[1]), axis=0), np.tile(words[1], (len(words[0]), 1))], axis=1)
    want = set(zip(*np.nonzero(x @ rotation @ directions.T >= cap_filters._cap(24, p.share))))
    assert {(r, n & ((1 << 40) - 1)) for r, n in zip(row.tolist(), number.tolist())} == {(int(a), int(b)) for a, b in want}
    assert abs(len(row) / 50 - p.share * len(directions)) < 0.5 * p.share * len(directions)


def test_recall_of_filters():
    """Of 1,000 pairs at a cosine of 0.95 to 0.97, the hardest, 0.98 share a filter, whatever the number of vectors."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((1000, 64))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.95, 0.97, (1000, 1))
    y = cos * x + np.sqrt(1 - cos**2) * away
    for n in (2000, 50_000, 1_000_000):
        p = cap_filters.plan(n)
        passed = [[set() for _ in range(1000)] for _ in range(2)]
        for side, v in enumerate((x, y)):
            for code in range(p.codes):
                for k in range(0, 1000, 50):
                    for r, f in zip(*(z.tolist() for z in cap_filters.decode(v[k : k + 50], p, code))):
                        passed[side][k + r].add(f)
        assert sum(bool(a & b) for a, b in zip(*passed)) >= 0.98 * 1000
        assert np.mean([len(a) for a in passed[0]]) < 2 * p.codes * 12


def repaired_by_force(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[c] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    keep, fill, name = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (2, 2, 3, 2), {2: "user", 3: "assistant"}
    out = set()
    for c, v in by.items():
        v.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        turns = {t for t, _, _ in v if t is not None}
        seen, fault = set(), []
        for _, role, text in v:
            said = text.strip(" \t\n\v\f\r")
            fault.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:  # all edits, cheapest and ASCII-least first
            cost, audit, i, s, lines = heapq.heappop(heap)
            if (i, s) in done:
                continue
            done.add((i, s))
            if i == len(v) and s in (0, 3):
                break
            heapq.heappush(heap, (cost + 3, audit + "I", i, fill[s], (*lines, name[fill[s]] + ":")))
            if i < len(v):
                _, role, text = v[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, lines))
                if fault[i] not in ("b", "d"):
                    more = 3 * (fault[i] == "t")
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, fill[s], (*lines, f"{name[fill[s]]}:{text}")))
                    if (s, role[:1]) in keep:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, keep[s, role[:1]], (*lines, f"{role}:{text}")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((c, gaps, *(fault.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversation_rows(seed=1):
    rng, rows = random.Random(seed), []
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ä"], ["Yes.", "no", " ", "", None, "a!  ", "b?\n", "hm . x", "日本。", "x "]
    for c in [*range(120), None]:
        rows += [(c, rng.choice([t, t, t, None, 3]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, 12))]
    rows += [(900, t, rng.choice(roles[:6]), rng.choice(["Yes.", "no", f"x{t}.", f"x{t}"])) for t in range(700)]  # of many blocks
    return [*rows, rows[0], rows[0], (901, 5, "user", "long " * 50_000 + ".")]


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_repair(spark, block, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, at int, code string").repartition(5)
    found = [tuple(r) for r in dialogue.repair_conversations(df).collect()]
    assert len(found) == len(set(found)) and set(found) == repaired_by_force(rows)


def test_repaired_turns(spark):
    """The operator itself gives the turns; a conversation of which nothing is left has none, and none is lost."""
    turns = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "More?"), (2, 1, "tool", " "), (3, 1, "system", "Be kind.")], "conv long, turn long, role string, text string")
    whole, repaired = dialogue.repair(turns)
    assert {(r.conv, r.cost, r.audit) for r in whole.collect()} == {(1, 3, "KR"), (2, 4, "D"), (3, 4, "D")}
    assert [(r.role, r.text) for r in repaired.orderBy("conv", "at", "nth").collect()] == [("user", "Hi."), ("assistant", "More?")]
    assert dialogue.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    dropped = next((c, 1) for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    out = dialogue.repair_conversations(spark.createDataFrame([(*dropped, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in out] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
