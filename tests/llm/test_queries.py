"""Each registered query and the pipeline on a small folder of tables, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import make
from pyspark.sql import functions as F
from test_operators import WORD, components_by_force, fp_by_force, groups_by_force, norm, stats_by_force

import corpus_pipeline
from gristmill.llm import bin_shards, fair_mix, licenses, line_dedup, lsm_dedup, quality, queries, simhash_ball, tier_packing, token_files, toxicity
from gristmill.llm.tokens import tokenizer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents (with junk, copies and near copies) and labels in a folder; with the documents' rows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = [word() for _ in range(3000)]
    texts = []
    for k in range(160):
        ws = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        if k % 4 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["worthless", "idiot"])
        texts.append("\n".join(" ".join(ws[a : a + 20]) for a in range(0, len(ws), 20)))
    texts += [texts[3], texts[3].replace(" ", "  "), texts[5], " ".join(words[:30]), None, "", "la " * 90]
    long = [rng.choice(words) for _ in range(3000)]
    near = list(long)
    near[1500] = "changed"
    texts += [" ".join(long), " ".join(near)]
    rows = [(k, t, rng.choice(["en", "de"]), rng.choice(["a", "a", "b", None])) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(k, k % 2, int(k % 4 == 0)) for k in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def run(spark, tables, name):
    out = queries.queries()[name](spark, tables[0])
    found = out.collect()
    assert len(found) >= len(tables[1])
    return {r.doc_id: r for r in found} if len(found) == len(tables[1]) else found


def test_op1(spark, tables):
    found = run(spark, tables, "op1_toxicity")
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op1_learns_no_held_out_label(spark, tables, tmp_path):
    """Labels of held-out rows may be anything: the scores stay the same."""
    first = run(spark, tables, "op1_toxicity")
    other = spark.read.parquet(f"{tables[0]}/labels.parquet")
    flipped = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    other.withColumn("toxic", flipped).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{tables[0]}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: r.score for r in queries.op1_toxicity(spark, str(tmp_path)).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in first.items())


def test_op2_and_op4(spark, tables):
    assert all(r.license is None for r in run(spark, tables, "op2_license_scan").values())
    found = run(spark, tables, "op4_line_dedup")
    seen, dropped = {}, defaultdict(list)
    for d, t, *_ in tables[1]:
        for k, x in enumerate(line_dedup.normalised_lines(t)):
            if len(x.split()) >= 5 and seen.setdefault(x, (d, k)) != (d, k):
                dropped[d].append(k)
    extra = {d: set(r.dropped) - set(dropped[d]) for d, r in found.items()}
    assert all(set(dropped[d]) <= set(r.dropped) and r.n_dropped == len(r.dropped) for d, r in found.items())
    assert {d for d, x in extra.items() if x} == {len(tables[1]) - 1}  # the near copy's one long line


def test_op3(spark, tables):
    found = run(spark, tables, "op3_token_files")
    tok, at = tokenizer(queries.vocabulary("word_bpe_49k.json")), 0
    for d, t, *_ in tables[1]:
        ids = np.append(tok.ids(t or ""), 2).astype("<u4")
        assert (found[d].start, found[d].n_tokens, found[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op5(spark, tables):
    found = run(spark, tables, "op5_lsm_exact_dedup")
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found.values()) == groups_by_force(tables[1])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found.values())


def test_op6(spark, tables):
    found = run(spark, tables, "op6_bin_shards").values()
    load, slots = Counter(), defaultdict(list)
    for r in found:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    texts = {d: t or "" for d, t, *_ in tables[1]}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()), "bytes", None) for r in found)
    assert all(0 <= s < 40 and sorted(v) == list(range(len(v))) for s, v in slots.items())


def fences_by_force(rows, spread=4.0, reach=10.0, weight=30):
    """Exact quantiles instead of sketched ones."""
    def of(s):
        n = max(1, s[0])
        return {"symbols": s[2] / n, "repeats": s[4] / n, "dup_lines": 100 * s[3] / n, "word_length": s[1] / n}

    good = [(lang, src, of(s)) for _, lang, src, s in rows if not (s[0] < 50 or 100 * s[4] > 50 * s[0])]
    at = lambda vs, q: sorted(vs)[max(0, math.ceil(len(vs) * q - 1e-9) - 1)]
    tops = {"symbols": 0.9, "repeats": 0.95, "dup_lines": 0.98, "word_length": 0.9}
    least = {"symbols": 0.15, "repeats": 0.25, "dup_lines": 2.0, "word_length": 0.5}
    out = {}
    for m in tops:
        everything = [v[m] for *_, v in good]
        for lang, src in {(a, b) for a, b, _ in good}:
            own, mid = [v[m] for a, b, v in good if (a, b) == (lang, src)], [v[m] for a, _, v in good if a == lang]
            two = [(len(mid) * at(mid, q) + weight * at(everything, q)) / (len(mid) + weight) for q in (0.25, 0.75, tops[m])]
            one = [(len(own) * at(own, q) + weight * t) / (len(own) + weight) for q, t in zip((0.25, 0.75, tops[m]), two)]
            gap = max(spread * (one[1] - one[0]), reach * min(one[2] - one[1], two[2] - two[1]), least[m])
            out[lang, src, m] = (one[0] - gap, one[1] + gap)
    return of, out


def test_op7(spark, tables):
    found = run(spark, tables, "op7_quality_rules")
    rows = [(d, lang, src, stats_by_force(t)) for d, t, lang, src in tables[1]]
    of, fences = fences_by_force(rows)
    for d, lang, src, s in rows:
        r, failed = found[d], s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*s, failed)
        v, near, inside = of(s), False, True
        for m in v:
            low, high = fences.get((lang, src, m), (-9e9, 9e9))
            near |= min(abs(v[m] - high), abs(v[m] - low)) < 0.05 * max(1e-9, abs(high))
            inside &= v[m] <= high and (m != "word_length" or v[m] >= low)
        assert near or r.kept == (not failed and inside)


def test_op8(spark, tables):
    found = run(spark, tables, "op8_simhash_ball")
    prints = [fp_by_force(t) for _, t, *_ in tables[1]]
    comp = components_by_force(prints)
    least = {}
    for (d, *_), c in zip(tables[1], comp):
        least.setdefault(c, d)
    assert all((found[d].fingerprint, found[d].component_id) == (f"{p:016x}", least[c]) for (d, *_), p, c in zip(tables[1], prints, comp))


def test_op9(spark, tables):
    found = run(spark, tables, "op9_tier_packing")
    check_packing(found, {d: t for d, t, *_ in tables[1]})


def check_packing(found, texts):
    tok, by = tokenizer(queries.vocabulary("byte_bpe_50k.json")), defaultdict(list)
    pieces = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0
    assert set(pieces) == set(texts)
    for d, parts in pieces.items():
        ids, at = np.append(tok.ids(texts[d] or ""), 1).astype("<u4"), Counter()
        for start, n, crc, size in parts:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc and size == len(ids)
            at.update(range(start, start + n))
        assert set(at) == set(range(len(ids))) and len(set(at.values())) == 1


def targets_by_force(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: (budget - sum(fixed.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_op10(spark, tables):
    found, sizes = run(spark, tables, "op10_fair_mix"), Counter()
    for _, t, _, s in tables[1]:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets_by_force(sizes), Counter()
    for d, t, _, s in tables[1]:
        r = found[d]
        assert r["size"] == len(WORD.findall(t or "")) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 6100 for s in sizes)  # two copies of the longest document


def test_pipeline(spark, tables):
    """Each stage on what its predecessor kept, against plain Python, and what run() gives at last."""
    docs, texts = spark.read.parquet(f"{tables[0]}/documents.parquet"), {d: t for d, t, *_ in tables[1]}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    rules, exact, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    one = rules(spark, docs, tables[0]).cache()
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert {r.doc_id for r in one.collect()} == {d for d, k in verdict.items() if k} and one.columns == docs.columns
    two = exact(spark, one, tables[0]).cache()
    groups = defaultdict(list)
    for r in one.collect():
        groups[norm(r.text)].append(r)
    assert {r.doc_id for r in two.collect()} == {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    three = near(spark, two, tables[0]).cache()
    rows = sorted(two.collect(), key=lambda r: r.doc_id)
    comp = components_by_force([fp_by_force(r.text) for r in rows])
    first = {}
    for r, c in zip(rows, comp):
        first.setdefault(c, r.doc_id)
    assert {r.doc_id for r in three.collect()} == set(first.values()) and three.columns == docs.columns
    four = mix(spark, three, tables[0])
    times = Counter(r.doc_id for r in four.collect())
    assert times == Counter({r.doc_id: r.copies for r in fair_mix.mix(three).collect() if r.copies})
    last = corpus_pipeline.run(spark, tables[0]).collect()
    check_packing(last, {d: texts[d] for d in times})


def test_string_ids(spark, tables):
    """Ids of any type, in every operator that doesn't say otherwise; ids' own order decides."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    named = docs.withColumn("doc_id", F.format_string("https://x/%04d", "doc_id"))
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet").withColumn("doc_id", F.format_string("https://x/%04d", "doc_id"))
    as_id = lambda d: None if d is None else f"https://x/{d:04d}"
    plain, text = lsm_dedup.exact_groups(docs).collect(), lsm_dedup.exact_groups(named).collect()
    assert {(as_id(r.doc_id), as_id(r.keep_id), r.group_size) for r in plain} == {(r.doc_id, r.keep_id, r.group_size) for r in text}
    plain, text = simhash_ball.near_groups(docs).collect(), simhash_ball.near_groups(named).collect()
    assert {(as_id(r.doc_id), as_id(r.component_id)) for r in plain} == {(r.doc_id, r.component_id) for r in text}
    assert {as_id(r.doc_id) for r in quality.quality_filter(docs).collect()} == {r.doc_id for r in quality.quality_filter(named).collect()}
    assert {as_id(r.doc_id) for r in line_dedup.line_decisions(docs).where("n_dropped > 0").collect()} == {r.doc_id for r in line_dedup.line_decisions(named).where("n_dropped > 0").collect()}
    n = docs.count()
    assert licenses.license_scan(named).count() == bin_shards.assign(named, 7).count() == fair_mix.mix(named).count() == n
    assert tier_packing.pack_documents(named, queries.vocabulary("byte_bpe_50k.json")).select("doc_id").distinct().count() == n
    model = toxicity.train(named, labels)
    assert toxicity.toxicity_scores(named, model).where("score between 0 and 1").count() == n
    with pytest.raises(ValueError, match="integers"):
        token_files.write_tokens(named, "file:///tmp/none", queries.vocabulary("word_bpe_49k.json"))


def test_repeated_and_null_ids(spark):
    """Stages judge rows, not ids: rows of one id with different texts stay or go by themselves."""
    good = " ".join(f"word{k}" for k in range(200))
    other = " ".join(f"term{k}" for k in range(200))
    docs = make(spark, [(1, good, "en", "a"), (1, "too short", "en", "a"), (2, other, "en", "a"), (None, other, "en", "a"), (None, other, "en", "a"), (1, good, "en", "a")])
    assert sorted(r.text for r in quality.quality_filter(docs).collect()) == sorted([good, good, other, other, other])
    near = simhash_ball.near_dedup(docs)
    assert near.columns == docs.columns and sorted((r.doc_id, r.text) for r in near.collect()) == sorted([(1, good), (1, "too short"), (2, other)])
    assert sorted((r.doc_id, r.text) for r in lsm_dedup.exact_dedup(docs).collect()) == sorted([(1, good), (1, "too short"), (2, other)])


def test_toxicity_without_latin_letters(spark):
    """Landmarks without letters don't end the fit; other scripts are learned."""
    assert toxicity.unpacked(toxicity.fit(["123 456 789 000"] * 40, [0, 1] * 20))[0].shape == (toxicity.N_CODES,)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(3, 9)))
    data = [(" ".join(["тупица" if k % 2 and j == 7 else word() for j in range(40)]), k % 2) for k in range(300)]
    model = toxicity.unpacked(toxicity.fit([t for t, _ in data[:200]], [y for _, y in data[:200]], landmarks=32))
    s = toxicity.score([t for t, _ in data[200:]], model)
    assert ((s >= 0.3) == np.array([y for _, y in data[200:]])).mean() > 0.9
    clean = "где дом там лес " * 70_000
    assert len(clean) > toxicity.RUN
    for at in (10, toxicity.RUN - 8, toxicity.RUN + 40):  # also across the end of a part
        assert toxicity.score([clean[:at] + " тупица " + clean[at:]], model)[0] > toxicity.score([clean], model)[0]


def test_kernel_equals_a_plain_one():
    """The decision value of a window is the sum over its gapped subsequences, each weighed by its gaps and its code."""
    rng = np.random.default_rng(3)
    text, weights = "some kind of w.o.r.d here", rng.normal(size=toxicity.N_CODES).astype(np.float32)
    x, _ = toxicity.encode([text])
    plain = np.zeros(len(x))
    for i in range(len(x) - toxicity.SPAN + 1):
        for a in range(1, toxicity.SPAN):
            for b in range(a + 1, toxicity.SPAN):
                for c in range(b + 1, toxicity.SPAN):
                    plain[i] += toxicity.DECAY ** (c - 3) * weights[(x[i] << 15) | (x[i + a] << 10) | (x[i + b] << 5) | x[i + c]]
    want = [plain[k : k + toxicity.WIDTH].sum() for k in range(len(x))]
    assert np.allclose(toxicity.window_scores(x, weights), want, atol=1e-3)


def test_adjacent_spellings(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(licenses.canonical(F.col("t"))).first()[0]
    assert one(" Licence licence, LICENCE text") == "license license license text"
    assert one("sub-licence sub licence non-commercial") == "sublicense sublicense noncommercial"
    assert re.fullmatch(r"\S+( \S+)*", one(licenses.KNOWN["MIT"]))


def test_hot_ids_and_nulls_in_token_files(spark):
    """Ids that most rows have are dealt to several ranges; the order of ids holds, and all comes back."""
    rows = [(5, f"text {k}", "en", "a") for k in range(200)] + [(None, f"none {k}", "en", "a") for k in range(100)] + [(k, "x", "en", "a") for k in range(40)]
    found = token_files.round_trip(make(spark, rows), queries.vocabulary("word_bpe_49k.json")).collect()
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert Counter(order) == Counter(d for d, *_ in rows)
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    spread = token_files._by_id_range(make(spark, rows).select("doc_id", "text")).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in spread) < 120


def stages_of(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_of_nothing_and_of_repeated_rows(spark, tables, tmp_path):
    """An empty table runs through all stages; repeated rows, null ids, and columns with the operators' own names make no more documents."""
    docs = make(spark, tables[1])
    (tmp_path / "none").mkdir(), (tmp_path / "twice").mkdir()
    assert stages_of(spark, docs.limit(0), tmp_path / "none") == []
    odd = docs.withColumns({"_gm_digest": F.lit("x"), "_gm_id": F.lit(1), "_gm_row": F.lit(2), "key": F.lit("k"), "kept": F.lit(True)})
    twice = odd.unionByName(odd).unionByName(odd.where("doc_id % 10 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    found = stages_of(spark, twice, tmp_path / "twice")
    texts = {d for d, *_ in tables[1]}
    assert found and {r.doc_id for r in found} <= texts
    copies = Counter(r.doc_id for r in found if r.start == 0)
    assert max(copies.values()) <= 2


def test_own_columns_and_repeated_ids(spark, tmp_path):
    """Columns with the names that operators use stay as they are; rows of one id are told apart."""
    line = "this line is said in every one of these documents"
    rows = [(k, f"{line}\nown words of number {k} and nothing more", 7 + k, f"d{k}", 100 + k, "x") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gm_row long, _gm_digest string, _gm_id long, _gm_dropped string")
    out = line_dedup.drop_lines(df)
    assert out.columns == df.columns and sorted((r.doc_id, r._gm_row, r._gm_digest, r._gm_id) for r in out.collect()) == [(r[0], r[2], r[3], r[4]) for r in rows]
    assert sum(line in r.text for r in out.collect()) == 1
    assert sorted(tuple(r) for r in lsm_dedup.exact_dedup(df.unionByName(df)).collect()) == sorted(rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(None, 1)], "doc_id long, toxic int")
    again = df.unionByName(df.where("doc_id < 2").withColumn("text", F.lit("short")))
    assert toxicity.train(again, labels) == toxicity.train(df.select("doc_id", "text"), labels)
    same = df.withColumn("doc_id", F.when(F.col("doc_id") > 2, 1))
    bin_shards.write_shards(same, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r._gm_row, r.text) for r in back.collect()) == sorted((r[2], r[1]) for r in rows)
    with pytest.raises(ValueError, match="shard"):
        bin_shards.write_shards(df.withColumn("shard", F.lit(1)), str(tmp_path / "t"))
