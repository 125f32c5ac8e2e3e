import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from fixtures import make
from pyspark.sql import functions as F

from gristmill.llm import bin_shards, common, fair_mix, licenses, line_dedup, lsm_dedup, quality, simhash_ball, tier_packing, token_files, toxicity
from gristmill.llm.queries import vocabulary
from gristmill.llm.tokens import tokenizer

WS = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}


def norm(t):
    return WS.sub("", t or "")


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def groups_by_force(rows):
    by = defaultdict(list)
    for d, t, *_ in rows:
        by[norm(t)].append((-len(t or ""), d is None, d))
    return Counter((d, min(by[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2], len(by[norm(t)])) for d, t, *_ in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, rows, weak):
    digest = (lambda c: F.hex(F.crc32(c) % 7)) if weak else lsm_dedup.sha256
    out = lsm_dedup.exact_groups(docs, digest=digest).cache()
    assert got(out, "doc_id", "keep_id", "group_size") == groups_by_force(rows)
    assert out.where("kept").count() == len({norm(t) for _, t, *_ in rows})
    if not weak:
        assert got(out, "doc_id", "digest") == Counter((d, hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows)


def test_exact_dedup(docs, rows, empty):
    out = lsm_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert Counter(norm(r.text) for r in found) == Counter({norm(t): 1 for _, t, *_ in rows})
    for r in found:
        assert len(r.text or "") == max(len(t or "") for _, t, *_ in rows if norm(t) == norm(r.text))
    assert lsm_dedup.exact_dedup(empty).count() == 0


def test_index_lookup_and_merge(spark):
    index = lsm_dedup.DigestIndex(spark, memtable=3)
    for k in range(2):
        index.flush(spark.range(10).select(F.concat(F.lit("d"), F.col("id") % 4).alias("digest"), (F.col("id") + 10 * k).alias("id"), F.lit(5).cast("long").alias("length")))
    merged = {r.digest: (r.keep_id, r.group_size) for r in index.compact().collect()}
    assert merged == {"d0": (0, 6), "d1": (1, 6), "d2": (2, 4), "d3": (3, 4)}
    assert index.lookup(["d3"]).count() == 4


def fp_by_force(text):
    ws = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")]
    if not ws:
        return 0
    sh = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_force(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def test_near_groups(docs, rows):
    prints = [fp_by_force(t) for _, t, *_ in rows]
    comp = components_by_force(prints)
    least = defaultdict(list)
    for (d, *_), c in zip(rows, comp):
        least[c].append(d)
    want = Counter((d, f"{p:016x}", min((x for x in least[c] if x is not None), default=None)) for (d, *_), p, c in zip(rows, prints, comp))
    assert got(simhash_ball.near_groups(docs), "doc_id", "fingerprint", "component_id") == want


def test_ball_links_are_complete(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(base)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = simhash_ball.links(df)
    pairs = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    at = {x: k for k, x in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(at[a])] = find(at[b])
    want = components_by_force(fps)
    assert len({(find(k), want[k]) for k in range(len(fps))}) == len({find(k) for k in range(len(fps))}) == len(set(want))


def test_near_dedup_keeps_one(docs, rows, empty):
    out = simhash_ball.near_dedup(docs)
    assert out.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash_ball.near_groups(docs).where("doc_id is not null").collect()}
    kept = {r.doc_id for r in out.collect()}
    assert {groups[d] for d in groups} <= kept
    assert simhash_ball.near_groups(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    out = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {x: find(x) for x in linked}


def mix_by_force(rows, weights=(3, 1, 2), share=1.5, most=2):
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, capped = share * sum(size.values()), set()
    while True:
        left = budget - sum(most * size[s] for s in capped)
        total = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / total > most * size[s]}
        if not over:
            return size, {s: most * size[s] if s in capped else left * w[s] / total for s in names}
        capped |= over


def test_mix(docs, rows, empty):
    out = fair_mix.mix(docs).collect()
    size, target = mix_by_force(rows)
    taken, largest = Counter(), Counter()
    assert Counter((r.doc_id, r.source, r.taken // r["size"] if r["size"] else 0) for r in out).keys() >= {(d, s, 0) for d, t, _, s in rows if not norm(t)}
    for r in out:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert len(out) == len(rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    again = got(fair_mix.mix(docs.repartition(3)), "doc_id", "text", "taken")
    assert again == Counter((r.doc_id, r.text, r.taken) for r in out)
    mixed = fair_mix.mixed_corpus(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert fair_mix.mix(empty).count() == 0


def test_mix_many_sources(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 60), "en", f"s{int(rng.random() ** 3 * 9)}") for k in range(4000)]
    out = fair_mix.mix(make(spark, rows))
    size, target = mix_by_force(rows)
    found = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    for s in size:
        assert abs(found[s].taken - target[s]) <= 60 and math.isclose(found[s].target, target[s], rel_tol=1e-9)
    ordered = fair_mix.mixed_corpus(make(spark, rows), ordered=True)
    assert ordered.count() == out.agg(F.sum("copies")).first()[0]


def stats_by_force(t):
    t = t or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
    cover = {k + j for k in range(len(ws) - 2) if tri[tuple(ws[k : k + 3])] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, rows, empty):
    out = quality.quality_rules(docs, weight=5)
    want = Counter()
    for d, t, *_ in rows:
        s = stats_by_force(t)
        want[(d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.where("base_failed and kept").count() == 0 and out.where("kept is null").count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns


def test_quality_thresholds_adapt(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = [" ".join(word() + ("*" if rng.random() < 0.3 and k % 2 else "") for _ in range(80)) for k in range(600)]
    rows = [(k, t, "en", "code" if k % 2 else "prose") for k, t in enumerate(clean)]
    rows += [(1000 + k, " ".join(word() + ("*" if rng.random() < 0.35 else "") for _ in range(80)), "en", "prose") for k in range(20)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(make(spark, rows)).collect()}
    assert all(kept[k] for k in range(600)) and not any(kept[1000 + k] for k in range(20))


def test_junk_in_one_source_and_an_odd_clean_one(spark):
    """Fences are a group's own: a source of many repeats stays, one that is half junk doesn't hide it, and the same text is judged by its source."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))

    def text(share):
        again = [word() for _ in range(3)]
        return " ".join(" ".join(again if rng.random() < share else [word() for _ in range(3)]) for _ in range(60))

    rows = [(k, text(0.0), "en", f"s{k % 4}") for k in range(800)]
    rows += [(1000 + k, text(rng.uniform(0.1, 0.35)), "en", "odd") for k in range(200)]
    same = " ".join(["aaaaa bbbbb ccccc"] * 27 + [text(0.0)[:600]])
    rows += [(2000 + k, " ".join(word() + rng.choice(["*", "#", ""]) for _ in range(90)), "en", "s0") for k in range(60)]
    rows += [(3000, same, "en", "odd"), (3001, rows[0][1], "en", "odd"), (3002, same, "en", "s1")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(make(spark, rows)).collect()}
    assert all(kept[k] for k in range(800)) and all(kept[1000 + k] for k in range(200))
    assert not any(kept[2000 + k] for k in range(60))
    assert kept[3000] and kept[3001] and not kept[3002]


def test_sketch_is_mergeable_and_close(spark):
    values = [random.Random(k).lognormvariate(0, 2) for k in range(3000)]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "p int, v double")
    parts = quality.sketch(df, ["p"], "v", 0.01).groupBy("bin").agg(F.sum("n").alias("n")).withColumn("k", F.lit(1))
    whole = quality.sketch(df.withColumn("k", F.lit(1)), ["k"], "v", 0.01)
    at = {"low": 0.25, "high": 0.9}
    a, b = quality.quantiles(parts, ["k"], at, 0.01).first(), quality.quantiles(whole, ["k"], at, 0.01).first()
    assert (a.low, a.high) == (b.low, b.high)
    for q, v in ((0.25, a.low), (0.9, a.high)):
        assert abs(v / np.quantile(values, q) - 1) < 0.02


@pytest.mark.parametrize("kind", list(NAMES))
def test_cached_tokenizer(rows, kind):
    tok = tokenizer(vocabulary(NAMES[kind]))
    rng = random.Random(5)
    alphabet = "ab'sTé ñ  \n\t.!?1２3  ́日<|endoftext|> \x1f-_"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for t in [t for _, t, *_ in rows if t] + more:
        assert tok.ids(t).tolist() == tok.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs, rows, empty):
    tok = tokenizer(vocabulary(NAMES["bytes"]))
    out = tier_packing.pack_documents(docs, vocabulary(NAMES["bytes"]), unit_tokens=20_000).collect()
    want = Counter((d, zlib.crc32(np.append(tok.ids(t), 1).astype("<u4").tobytes()), len(tok.ids(t)) + 1) for d, t, *_ in rows)
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[d].append(np.append(tok.ids(t), 1).astype("<u4"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for d, xs in ids.items():
        assert sum(r.length for r in pieces[d]) == sum(map(len, xs))
        if len(xs) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for rs in windows.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rs[0].window <= 2048 and at & (at - 1) == 0
    assert sum(want.values()) == len(rows)
    assert tier_packing.pack_documents(empty, vocabulary(NAMES["bytes"])).count() == 0


def test_pack_keeps_short_documents_whole():
    rng = random.Random(9)
    lengths = [rng.choice([1, 30, 255, 256, 700, 1500, 2047, 2048, 5000]) for _ in range(500)]
    windows = list(tier_packing.pack(lengths))
    assert all(sum(n for *_, n in pieces) == size for size, pieces in windows)
    cut = Counter(doc for _, pieces in windows for doc, *_ in pieces)
    assert sum(cut[k] > 1 for k, n in enumerate(lengths) if n < 2048) <= len(windows) // 2
    groups = tier_packing.step_groups([s for s, _ in windows], 8192)
    total = Counter()
    for (s, _), g in zip(windows, groups):
        total[g] += s
    assert all(v == 8192 for g, v in total.items() if g != max(total))


def test_token_files(docs, rows, empty, spark):
    path = vocabulary(NAMES["words"])
    tok = tokenizer(path)
    folder = common.new_path(spark, "test-tokens")
    files = token_files.write_tokens(docs, folder, path, file_tokens=5000)
    out = token_files.read_tokens(files, folder).orderBy("start").collect()
    start, last = 0, -1
    for r in out:
        assert r.start == start and (r.doc_id is None or r.doc_id >= last)
        start, last = start + r.n_tokens, last if r.doc_id is None else r.doc_id
    want = Counter((d, len(tok.ids(t)) + 1, zlib.crc32(np.append(tok.ids(t), 2).astype("<u4").tobytes())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert token_files.round_trip(empty, path).count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    path = str(tmp_path / "x.zst")
    docs = [(k, np.arange(k * 7 % 900, dtype="<u2")) for k in range(300)]
    fs, name = pafs.FileSystem.from_uri(f"file://{path}")
    with fs.open_output_stream(name, compression=None) as out:
        writer = token_files.FrameWriter(out, frame_tokens=1000)
        for d, ids in docs:
            writer.add(d, ids)
        writer.close()
    with fs.open_input_file(name) as f:
        reader = token_files.FrameReader(f)
        assert len(reader.entries) > 50
        for k in (250, 3, 299):
            assert reader.document(k).tolist() == docs[k][1].tolist()
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain == b"".join(ids.tobytes() for _, ids in docs)
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(bytes(data))
    with fs.open_input_file(name) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.FrameReader(f))


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 400))]
        bins, out = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = [(r, b) for b, r in enumerate(bins) if r >= sizes[k]]
            if not fit:
                bins.append(100)
                fit = [(100, len(bins) - 1)]
            b = min(fit)[1]
            bins[b] -= sizes[k]
            out.append((k, b))
        assert bin_shards.best_fit_decreasing(sizes, 100) == [b for _, b in sorted(out)]
    tree = bin_shards.RemainingTree(leaf=4)
    for k in range(100):
        tree.add((k, k))
    assert [tree.take(k)[0] for k in (50, 50, 99, 0)] == [50, 51, 99, 0] and tree.take(100) is None


def test_shards(docs, rows, empty):
    out = bin_shards.assign(docs, shards=6).collect()
    slots, load, where = defaultdict(list), Counter(), defaultdict(set)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    group = Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
        group[r.text_crc32] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for c, s in where.items() if group[c] <= sum(load.values()) / 6)
    biggest = max(r["size"] for r in out)
    assert max(load.values()) <= max(sum(load.values()) / 6 * 1.1, biggest)
    assert bin_shards.assign(empty).count() == 0


def test_hot_group_is_split(spark):
    rows = [(k, "hot " * 50, "en", "a") for k in range(900)] + [(1000 + k, f"cold {k} " * 50, "en", "a") for k in range(900)]
    load = [r["s"] for r in bin_shards.assign(make(spark, rows), shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(load) == 8 and max(load) < 1.03 * sum(load) / 8


def test_licenses(spark, empty):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit), (2, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit.upper().replace("\n\n", "\n")), (3, mit + " extra words"), (4, None), (5, "..."), (6, licenses.KNOWN["ISC"].replace("fee", "FEE,")), (7, "LICENCED under the Apache Licence -- version 2.0"), (7, "LICENCED under the Apache Licence -- version 2.0")]
    out = licenses.license_scan(make(spark, [(d, t, "en", "a") for d, t in rows]))
    assert got(out, "doc_id", "license") == Counter({(1, "MIT"): 1, (2, "MIT"): 1, (3, None): 1, (4, None): 1, (5, None): 1, (6, "ISC"): 1, (7, "Apache-2.0 (line)"): 2})
    assert licenses.license_scan(empty).count() == 0


def test_wrapped_licenses(spark):
    wrap = lambda name: "\n".join(re.sub(r" (copyright|\\(c\\))", r"\n\1", x, flags=re.I) for x in licenses.KNOWN[name].split("\n"))
    heads = ["", "Copyright (c) 2020 Some One\n", "Copyright 2020 Some One\nCopyright 2021, Other\n\n", "The ISC License\n\nCopyright Some One\n(c) Other\n\n", "(c) 2019 A\nAll rights reserved.\n"]
    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"]
    rows = [(k, h + wrap(n)) for k, n in enumerate(names) for h in heads]
    assert all(re.search("(?im)^copyright", t) for _, t in rows)
    out = licenses.license_scan(make(spark, [(d, t, "en", "a") for d, t in rows]))
    assert got(out, "doc_id", "license") == Counter({(k, n): len(heads) for k, n in enumerate(names)})


def test_common_heads_of_licenses(spark):
    """Titles with names in brackets, holders on any number of lines, numbers or bullets; a text that only ends with a licence is none."""
    mit, bsd = licenses.KNOWN["MIT"], licenses.KNOWN["BSD-3-Clause"]
    heads = ["The MIT License (MIT)\n\nCopyright (c) 2015 Some One\n\n", "MIT License\n\nCopyright (c) 2015\n  Some One and the\n  other authors <a@b.org>\n\n", "".join(f"Copyright (c) {1950 + k} Holder {k}\n" for k in range(120)) + "\n"]
    heads += ["Copyright Some One, without a year\n", "© 2020 Some One\n", "/*\n * Copyright (C) 2001 A\n * and B\n */\n", "(c) Some One\n"]
    rows = [(k, h + mit) for k, h in enumerate(heads)]
    rows += [(100, re.sub(r"(?m)^[0-9]\. ", "* ", bsd)), (101, re.sub(r"(?m)^([0-9])\. ", r"(\1) ", bsd)), (102, "BSD 3-Clause License\n\nCopyright (c) 2017, Some One\nAll rights reserved.\n\n" + re.sub(r"(?m)^[0-9]\. ", "- ", bsd))]
    rows += [(200, "An essay on rights.\n" + mit), (201, "Copyright 2020 A\n" + "prose " * 60 + "\n" + mit), (202, mit[:-40]), (203, "The MIT License (MIT)"), (204, "x\n" * 20_000 + mit)]
    found = {r.doc_id: r.license for r in licenses.license_scan(make(spark, [(d, t, "en", "a") for d, t in rows])).collect()}
    assert [found[k] for k in range(len(heads))] == ["MIT"] * len(heads)
    assert {found[k] for k in (100, 101, 102)} == {"BSD-3-Clause"} and {found[k] for k in range(200, 205)} == {None}


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_normalised_lines():
    assert line_dedup.normalised_lines("A_ b,  c-12 00 4\u00a0\u00c9\u2026\n\n_") == ["a b c 0 0 0 \u00e9", "", ""]
    assert line_dedup.normalised_lines(None) == line_dedup.normalised_lines("") == [""]
    assert line_dedup.normalised_lines(" 1\t2\n\r\n x ") == ["0 0", "", "x"]


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == edits(a, b)


def test_lines_of_one_fingerprint(spark):
    lines = [" ".join(["la"] * n) for n in (5, 9, 10, 11, 30, 31)]  # one word: all have one set of n-grams
    out = line_dedup.line_decisions(make(spark, [(k, x, "en", "a") for k, x in enumerate(lines)]))
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_line_dedup(docs, rows, empty, spark):
    out = line_dedup.line_decisions(docs)
    lines = [(d, r, k, x) for r, (d, t, *_) in enumerate(rows) for k, x in enumerate(line_dedup.normalised_lines(t))]
    long = sorted({x for *_, x in lines if len(x.split()) >= 5})
    parent = {x: x for x in long}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(long):
        for b in long[:k]:
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and sum((Counter(a) - Counter(b)).values()) <= most and line_dedup.edit_distance(a, b) <= most:
                parent[find(a)] = find(b)
    groups = Counter(find(x) for *_, x in lines if x in parent)
    assert out.count() == len(rows)
    assert out.agg(F.sum("n_dropped")).first()[0] == sum(n - 1 for n in groups.values())
    assert line_dedup.line_decisions(empty).count() == 0
    base = "the quick brown fox jumps over the lazy dog near the old river bank again and again until the sun goes down behind the far blue hills"
    near = make(spark, [(1, base + "\nshort one", "en", "a"), (2, "short one\n" + base.upper() + "!", "en", "a"), (3, "A completely different line of many other words\n" + base, "en", "a")])
    assert {r.doc_id: r.dropped for r in line_dedup.line_decisions(near).collect()} == {1: [], 2: [1], 3: [1]}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(near).collect()}[2] == "short one"
    again = near.unionByName(near.where("doc_id = 1")).unionByName(near.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    left = line_dedup.drop_lines(again)
    assert left.columns == near.columns and sorted(r.text for r in left.collect()) == sorted([base + "\nshort one", "short one", "short one", "short one", "A completely different line of many other words"])
    named = near.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    assert {r.doc_id: r.dropped for r in line_dedup.line_decisions(named).collect()} == {"id-1": [], "id-2": [1], "id-3": [1]}


def test_lines_by_edit_similarity_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    lines = [" ".join(["la"] * n) for n in range(5, 60)]  # 55 lines of one SimHash and one set of 5-grams
    for n in [*range(5, 25)] * 3:
        base = [word() for _ in range(n)]
        typo = list(" ".join(base))
        typo[typo.index(" ") + 1] = "z"
        lines += [" ".join(base), "".join(typo), " ".join(base[:-1] + ["end"])]
    lines = sorted(set(lines))
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[:k]:
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and find(a) != find(b) and sum((Counter(a) - Counter(b)).values()) <= most and edits(a, b) <= most:
                parent[find(a)] = find(b)
    firsts = {}
    for k, x in enumerate(lines):
        firsts.setdefault(find(x), k)
    out = line_dedup.line_decisions(make(spark, [(k, x, "en", "a") for k, x in enumerate(lines)]))
    assert {r.doc_id for r in out.collect() if not r.n_dropped} == set(firsts.values())


def toxic_corpus(n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    insults = ["worthless", "idiot", "moron", "pathetic"]
    out = []
    for k in range(n):
        ws = [word() for _ in range(rng.randint(30, 200))]
        if k % 3 == 0:
            for _ in range(2):
                ws[rng.randrange(len(ws))] = rng.choice(insults)
        out.append((" ".join(ws), int(k % 3 == 0)))
    return out


def test_toxicity_held_out_and_gapped(spark, docs, empty):
    data = toxic_corpus()
    model = toxicity.fit([t for t, _ in data], [y for _, y in data], landmarks=64)
    fresh = toxic_corpus(seed=2)
    s = toxicity.score([t for t, _ in fresh], toxicity.unpacked(model))
    y = np.array([v for _, v in fresh])
    assert ((s >= 0.3) == y).mean() > 0.97
    clean = [t for t, v in fresh if not v]
    for form in ("wor-thle-ss", "i.d.i.o.t", "patxhetic", "mo ron"):
        hidden = toxicity.score([t + f" {form} and more" for t in clean[:50]], toxicity.unpacked(model))
        assert hidden.mean() > 5 * toxicity.score(clean[:50], toxicity.unpacked(model)).mean(), form
    out = toxicity.toxicity_scores(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.unpacked(toxicity.train(docs, labels))[0].shape == (toxicity.N_CODES,)
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.toxicity_scores(empty, none).count() == 0


@pytest.mark.parametrize("edit", ["letter", "word", "tenth"])
def test_line_recall_by_length(spark, edit):
    """Pairs of an edit similarity of 0.8 or more end in one group, 0.9 of them at least in each class of length."""
    rng = random.Random(9)
    letters = "abcdefghilmnoprstu"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    classes, lines, pairs = [(5, 9), (10, 19), (20, 39), (40, 79), (80, 160)], [], []
    for c, (low, high) in enumerate(classes):
        for _ in range(60):
            ws = [word() for _ in range(rng.randint(low, high))]
            new = list(ws)
            if edit == "letter":
                k = rng.randrange(len(ws))
                new[k] = new[k][:-1] + rng.choice(letters.replace(new[k][-1], ""))
            else:
                for k in rng.sample(range(len(ws)), 1 if edit == "word" else max(1, len(ws) // 10)):
                    new[k] = word()
            a, b = " ".join(ws), " ".join(new)
            if a != b and line_dedup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
                pairs.append((c, len(lines), len(lines) + 1))
                lines += [a, b]
    out = line_dedup.line_decisions(make(spark, [(k, x, "en", "a") for k, x in enumerate(lines)]))
    gone = {r.doc_id for r in out.collect() if r.n_dropped}
    for c in range(len(classes)):
        own = [b in gone for k, _, b in pairs if k == c]
        assert len(own) > 20 and sum(own) >= 0.9 * len(own), (classes[c], sum(own), len(own))
    assert not gone & {a for _, a, _ in pairs}


def test_all_lines_of_a_block_are_compared(spark):
    """Lines with a long part in common, whose partners are not their neighbours by length: every candidate counts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    common, lines = [word() for _ in range(24)], []
    for _ in range(150):
        own = [word() for _ in range(14)]
        other = list(own)
        for k in rng.sample(range(14), 7):
            other[k] = word()
        lines += [" ".join(common + own), " ".join(common + other)]
    lines = sorted(set(lines))
    encoded, sizes = [x.encode() for x in lines], np.array([len(x) for x in lines])
    keys, at = line_dedup.line_keys(encoded, sizes)
    blocks = {}
    for k, x in zip(keys.tolist(), at.tolist()):
        blocks.setdefault(k, set()).add(x)
    bins = [line_dedup.bins(encoded, gram).astype(np.uint8) for gram, _, _ in line_dedup.KINDS]
    in_kind = [(sizes >= low) & (sizes <= high) for _, low, high in line_dedup.KINDS]
    near = lambda a, b: any(m[a] and m[b] and (v[a] == v[b]).sum() >= n for v, m, n in zip(bins, in_kind, line_dedup.AGREE))
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for own in blocks.values() for a in own for b in own if a < b}:
        most = int(0.2 * max(sizes[a], sizes[b]) + 1e-9)
        if find(a) != find(b) and near(a, b) and line_dedup.edit_distance(lines[a], lines[b]) <= most:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert 20 < len({find(k) for k in range(len(lines))}) < 280
    for tile in (line_dedup.TILE, 16):  # in one group, and dealt in parts
        whole, line_dedup.TILE = line_dedup.TILE, tile
        try:
            out = line_dedup.line_decisions(make(spark, [(k, x, "en", "a") for k, x in enumerate(lines)])).collect()
        finally:
            line_dedup.TILE = whole
        assert {r.doc_id for r in out if not r.n_dropped} == {find(k) for k in range(len(lines))}


def test_pairs_that_are_not_similar_stay_in_their_task(spark, monkeypatch):
    """Lines that are candidates of each other, none similar: no work table has more rows than lines have blocks."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    common = [word() for _ in range(24)]
    lines = [" ".join(common + [word() for _ in range(16)]) for _ in range(160)]
    made, cut = {}, line_dedup.cut

    def counted(df, label, **options):
        out = cut(df, label, **options)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    out = line_dedup.line_decisions(make(spark, [(k, x, "en", "a") for k, x in enumerate(lines)]))
    assert out.agg({"n_dropped": "sum"}).first()[0] == 0
    assert max(made.values()) <= len(line_dedup.KINDS) * line_dedup.BLOCKS * len(lines), made


def test_edit_distances_of_many_pairs():
    rng = random.Random(2)
    for size in (1, 20, 63, 64, 65, 200, 600):
        pairs = []
        for _ in range(60):
            x = [rng.choice("abcdé ") for _ in range(rng.randint(max(1, size * 2 // 3), size))]
            y = list(x)
            for _ in range(rng.randint(0, max(1, size // 3))):
                k = rng.randrange(len(y) + 1)
                y[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
            pairs.append(sorted(("".join(x), "".join(y) or "q"), key=len))
        most = np.array([max(int(rng.choice([0.05, 0.2, 0.3]) * len(y)), len(y) - len(x)) for x, y in pairs])
        found = line_dedup.edit_distances(*zip(*pairs), most)
        for k, (x, y) in enumerate(pairs):
            true = line_dedup.edit_distance(x, y)
            assert found[k] == true if true <= most[k] else found[k] > most[k]
        like = line_dedup.similar(*zip(*pairs), 0.8)
        assert like.tolist() == [line_dedup.edit_distance(x, y) <= int(max(len(x), len(y)) * (1 - 0.8) + 1e-9) for x, y in pairs]


@pytest.mark.parametrize("share", [0.02, 0.05])
def test_line_recall_with_letters_changed(spark, share):
    """Letters changed at random all over a line: 0.9 of the lines at least in each class of length meet their original."""
    rng = random.Random(3)
    letters = "abcdefghilmnoprstu"
    classes, lines, pairs = [(8, 12), (13, 19), (20, 39), (40, 79), (80, 160)], [], []
    for c, (low, high) in enumerate(classes):
        for _ in range(80):
            new = list(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high))))
            lines.append("".join(new))
            for k in rng.sample([k for k, x in enumerate(new) if x != " "], max(1, int(share * len(new)))):
                new[k] = rng.choice(letters.replace(new[k], ""))
            pairs.append((c, len(lines)))
            lines.append("".join(new))
    out = line_dedup.line_decisions(make(spark, [(k, x, "en", "a") for k, x in enumerate(lines)]))
    gone = {r.doc_id for r in out.collect() if r.n_dropped}
    for c in range(len(classes)):
        own = [b in gone for k, b in pairs if k == c]
        assert sum(own) >= 0.9 * len(own), (classes[c], sum(own), len(own))
