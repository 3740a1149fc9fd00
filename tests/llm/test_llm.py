"""The operators against brute force on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticegrid.llm import (
    base,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_gam,
    quality_rules,
    queries,
    suffix_dedup,
    topk,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_dropped int, _row string, _key string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def prose(rng, n, stems=("ta", "ro", "mi", "ken", "sul", "vor", "ah", "ling", "der", "pos")):
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n))


def texts():
    rng = random.Random(3)
    passage = prose(rng, 60)
    out = [None, "", "  \n\t ", "one", "two words", "ünïcode Straße 東京 ok", "a\x0bb\x0cc\rd"]
    out += [prose(rng, rng.randint(5, 160)) for _ in range(25)]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(8)]
    family = prose(rng, 120).split()
    for _ in range(12):
        copy = list(family)
        copy[rng.randrange(120)] = "changed"
        out.append(" ".join(copy))
    out += [out[9]] * 3 + ["same same same " * 80, "x" * 700, prose(rng, 6000), "line one here\nshared line of all\n" + prose(rng, 60)]
    out += [f"{prose(rng, 55)}\nvisit page {i} of our big site\n{prose(rng, 10)}" for i in range(16)]
    return out


@pytest.fixture(scope="module")
def rows():
    sources = [None, "a", "b", "b", "c"]
    out = [(i, t, ["en", None][i % 2], sources[i % 5], None if t is None else len(t), "s", 7, "r", "k") for i, t in enumerate(texts())]
    return out + [out[12], out[12], out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1: mixing

def test_mix_takes_its_targets(docs, rows):
    got = mixing.mix(docs, block_words=64).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    taken, target = collections.Counter(), {}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix(docs.repartition(7), block_words=64).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_targets_stop_at_twice_the_size(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    assert got["a"] == 20 and got["c"] == 20  # weights 3, 1, 2, 3: 2240 by 1 and 3 for b and null, null stops at 1000
    assert got[None] == 1000 and got["b"] == 1.5 * 1520 - 1040


def test_every_prefix_of_the_schedule_is_near_the_weights(spark):
    counts = spark.createDataFrame([(1, 600, 50, 0), (2, 200, 500, 600), (3, 200, 10, 800)], "src int, slots long, blocks long, first_slot long")
    order = [r["src"] for r in mixing.schedule(counts).orderBy("slot").collect()]
    assert collections.Counter(order) == {1: 600, 2: 200, 3: 200}
    for n in range(50, 1000, 50):
        assert abs(order[:n].count(1) - 0.6 * n) < 8


def test_mixed_documents_keep_columns(docs, empty):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and 0 < got.count()
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_every_prefix_of_the_mixed_documents_is_near_the_weights(spark):
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "abcd"[min(i % 7, 3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["source"]: r["taken"] for r in mixing.mix(df, block_words=256).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    out = mixing.mixed_documents(df, "slot", "place", block_words=256)
    assert out.columns == [*df.columns, "slot", "place"]
    got = [(r["source"], len(r["text"].split())) for r in out.orderBy("slot", "place").collect()]
    total, seen = sum(n for _, n in got), collections.Counter()
    assert abs(total - sum(taken.values())) < 0.01 * total
    done = 0
    for source, n in got:
        seen[source] += n
        done += n
        assert all(abs(seen[s] - done * taken[s] / total) < 8 * 256 for s in taken)  # a few blocks, however far along


# 2: suffix dedup

def brute_repeats(texts_, length):
    raw = [(t or "").encode() for t in texts_]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        yield len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("group_rows", [suffix_dedup.GROUP_ROWS, 1])
def test_repeats_against_brute_force(docs, rows, monkeypatch, group_rows):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)  # 1: every lead is counted string by string
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 40)  # many boundaries
    got = sorted(tuple(r) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == sorted((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 200), strict=True))


def test_many_equal_rows_repeat_each_other(spark):
    rng = random.Random(12)
    same, other = prose(rng, 150), prose(rng, 150)
    rows_ = [(1, same)] * 300 + [(2, other), (3, f"{other[:400]} end"), (4, prose(rng, 90))]
    got = sorted(tuple(r) for r in suffix_dedup.without_repeats(spark.createDataFrame(rows_, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows_, brute_repeats([t for _, t in rows_], 200), strict=True))


def test_no_documents_no_repeats(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    tokens = [rng.integers(0, 5, 300), rng.integers(0, 5, 300), rng.integers(0, 5, 300)]
    order = suffix_dedup.multikey_order([t.copy() for t in tokens])
    assert [tuple(t[i] for t in tokens) for i in order] == sorted(zip(*tokens, strict=True))


# 3: quality rules

def test_rules_against_brute_force(docs, rows):
    got = sorted((tuple(r) for r in quality_rules.judge(docs, limit_documents=3).collect()), key=repr)
    norm = lambda x: " ".join(words(x)).lower()
    held = collections.Counter()
    for r in rows:
        held.update({(r[3], norm(x)) for x in (r[1] or "").split("\n") if words(x)})
    want = []
    for r in rows:
        text, w = r[1] or "", words(r[1])
        lines = [x for x in text.split("\n") if words(x)]
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        shared = sum(len(words(x)) for x in lines if held[r[3], norm(x)] > 3)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), shared,
                     failed, not failed and 2 * (len(w) - shared) >= len(w)))
    assert got == sorted(want, key=repr)


def test_rules_on_nothing(empty):
    assert quality_rules.judge(empty).count() == 0


# 4: near duplicates

def brute_components(rows_, percent, width):
    sets = {}
    for i, t in rows_:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = words(w)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


@pytest.mark.parametrize("percent, width, block", [(85, 3, 2048), (80, 5, 2), (60, 3, 3)])
def test_components_against_brute_force(docs, rows, monkeypatch, percent, width, block):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)
    got = near_dedup.link(docs, percent, width).collect()
    assert len(got) == len(rows)
    want = brute_components([(r[0], r[1]) for r in rows], percent, width)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_chain_reaches_its_smallest_id(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(2, 3)], "x long, y long")
    got = {r["rep"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 2: 2, 3: 2}


def test_one_of_each_group_stays(docs, empty):
    got = near_dedup.without_near_copies(docs)
    assert got.columns == docs.columns
    kept = {i for i, r in by_id(near_dedup.link(docs)).items() if r["kept"]}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(kept)
    assert near_dedup.link(empty).count() == 0


def test_pruning_bounds_are_safe():
    for n, m in near_dedup.least_agreements(85):
        draws = np.random.default_rng(n).binomial(n, 0.85, 200_000)
        assert (draws < m).mean() < 1e-4


# 5: line dedup

def test_recurring_templates_go(docs, empty):
    got = line_dedup.without_lines(docs, "_a", "_b")
    texts_ = {r["doc_id"]: r for r in got.collect()}
    numbered = [r for r in docs.collect() if r["text"] and "of our big site" in r["text"]]
    assert len(numbered) == 16
    for r in numbered:
        left = texts_[r["doc_id"]]
        assert left["text"] == "\n".join(x for x in r["text"].split("\n") if "big site" not in x) and left["_b"] == 1
        assert left["n_chars"] == len(left["text"])
    others = [r for r in docs.collect() if r not in numbered]
    assert all(texts_[r["doc_id"]]["text"] == r["text"] for r in others)
    assert got.columns == [*docs.columns, "_a", "_b"]
    assert line_dedup.without_lines(empty, "_a", "_b").count() == 0


def test_copies_of_a_text_lose_the_same_lines(spark):
    rng = random.Random(41)
    texts_ = [f"{prose(rng, 12)}\nthe footer of page {i} here\n{prose(rng, 12)}" for i in range(14)]
    rows_ = [(i, t) for i, t in enumerate([t for k, t in enumerate(texts_) for _ in range(1 + k % 4)])]
    got = line_dedup.without_lines(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows_) and all(r["n_dropped"] == 1 and "footer" not in r["text"] for r in got)


def test_pipeline_limit_does_not_grow_with_the_table(spark):
    text = F.concat_ws("\n", F.md5(F.concat(F.lit("a"), "doc_id")), F.when(F.col("doc_id") % 500 == 7, "the same footer line here"), F.md5(F.concat(F.lit("b"), "doc_id")))
    df = spark.range(9000).withColumnRenamed("id", "doc_id").withColumn("text", text).withColumn("source", F.lit("a"))
    got = corpus_pipeline.line_templates(spark, df, FOLDER)
    assert got.count() == 9000 and got.filter(F.col("text").contains("footer")).count() == 0  # 18 documents of 9,000 had it


def group_of_near_copies():
    """60 near copies; a line that 12 other documents have, and one that 8 others and all the copies have."""
    rng = random.Random(21)
    whole = [prose(rng, 12) for _ in range(30)] + ["a line of eight others and the group"]
    out = []
    for i in range(60):
        lines = list(whole)
        lines[i % 30] += f" changed {i}" if i else ""
        out.append((i, "\n".join(lines), "a"))
    for i in range(60, 80):
        shared = "a footer of twelve other documents" if i < 72 else "a line of eight others and the group"
        out.append((i, f"{prose(rng, 40)}\n{shared}\n{prose(rng, 30)}", "b"))
    return out


@pytest.mark.parametrize("few", [line_dedup.BROADCAST_ROWS, 0])
def test_one_whole_document_of_a_large_group_of_near_copies_stays(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", few)
    rows_ = group_of_near_copies()
    df = spark.createDataFrame([*rows_, rows_[0], (None, rows_[3][1], "a")], "doc_id long, text string, source string").repartition(3)
    cut = base.stage(corpus_pipeline.line_templates(spark, df, FOLDER), "test-cut")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_copies(spark, cut, FOLDER).filter("doc_id is not null").collect()}
    want = {i: "\n".join(x for x in t.split("\n") if "footer" not in x) for i, t, _ in [rows_[0], *rows_[60:]]}
    assert got == want
    assert cut.filter("doc_id is null").first()["text"] == rows_[3][1]


# 6: packing

def test_pieces_round_trip(docs, rows):
    files = queries.tokenizer_files()
    exact = packing.encoder(files[0], None)
    got = packing.pack(docs, *files, capacity=64, partition_pieces=40).collect()
    pieces = collections.Counter()
    for r in rows:
        ids = [*exact(r[1] or ""), 2]
        at = packing.cuts(len(ids), 64)
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            pieces[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.03 * packing.lower_bound(np.array([r["length"] for r in got]), 64) + 1


def test_both_encoders_agree_on_odd_texts():
    files = queries.tokenizer_files()
    quick, exact = packing.encoder(*files), packing.encoder.__wrapped__(files[0], None)
    for text in ["", " ", "a<|endoftext|>b", "x" * 5000, "naïve 東京 \n\n\t 12345 !!", " \x00é"]:
        assert quick(text) == exact(text)


def test_bound_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 101, 40)
        bins, offsets, free = packing.best_fit(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(free) and (free >= 0).all()
        assert all(np.bincount(bins, lengths) <= 100)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def test_nothing_to_pack(empty):
    assert packing.pack(empty, *queries.tokenizer_files()).count() == 0


# 7: personal data

def test_base_emails_are_the_leftmost_matches():
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("ab.@- x1", k=rng.randint(0, 30)))
        assert pii.emails(text) == [m.span() for m in pattern.finditer(text)]


def test_base_numbers_are_the_leftmost_matches():
    plain = [(pii.IP, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (pii.CARD, r"[0-9]([\x20-]?[0-9])+")]
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices("12.. -x", k=rng.randint(0, 30)))
        for quick, pattern in plain:
            assert [m.span() for m in quick.finditer(text)] == [m.span() for m in re.finditer(pattern, text)]


@pytest.fixture(scope="module")
def net():
    rng = random.Random(8)
    return pii.train([prose(rng, 200) for _ in range(20)])


def test_network_finds_held_out_forms(net):
    x, y = pii.labelled_windows([prose(random.Random(9), 300)], 400, np.random.default_rng(123))
    found = net.decode(x)
    assert (found == y)[y > 0].mean() > 0.8 and (found > 0)[y == 0].mean() < 0.02


def test_windows_without_a_digit_or_at_change_nothing(net):
    rng = random.Random(4)
    some = [f"{prose(rng, 40)} (988) 555-2485 {prose(rng, 60)} jo.e@mäil.example.org {prose(rng, 30)}", prose(rng, 300), "", "1", "5" * 1000]
    assert pii.decoded(net, some) == pii.decoded(net, some, everywhere=True)


def test_spans_add_to_the_base(spark, net, empty):
    rng = random.Random(5)
    text = f"{prose(rng, 30)} mail a.b@c.example.org or 10.0.0.1, card 4111 1111 1111 1111 and +1 (212) 555-0123 then (988) 555-2485. {prose(rng, 9)}"
    found = pii.find(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "9" * 5000)], "doc_id long, text string"), net)
    got = by_id(found)
    base_spans = pii.base_spans(text)
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 1, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(pii.written(base_spans).encode()).hexdigest()
    assert set(pii.written(base_spans).split(",")) <= set(got[1]["spans"].split(","))
    assert got[2]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["n_card"] == 0
    assert pii.find(empty, net).count() == 0


# 8: top-k

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)] + [(340, None), (341, [None] * 12), (342, [float("nan")] * 12), (343, []), (344, [1.0])]
    vectors += [(400, [-0.5] * 12), (500, [0.0] * 12)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = topk.search(df, F.col("vec_id") % 100 == 0, shard_rows=50, query_rows=3)
    whole = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:10]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_large_numbers_are_exact(spark):
    vectors = [(100, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [2e6, 6.0])]
    got = topk.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") == 100)
    assert [(r["vec_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 100).count() == 0


# 9: quality classifier

def test_classifier_on_held_out_rows(spark, empty):
    rng = random.Random(10)
    rows_ = []
    for i in range(400):
        text = prose(rng, rng.randint(20, 200))
        bad = i % 4 == 0
        if bad:
            text = rng.choice([text.upper() + "!!", " ".join(f"{w}###" for w in text.split()), " ".join([text.split()[0]] * 60)])
        rows_.append((i, text, int(not bad)))
    df = spark.createDataFrame(rows_, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    model = quality_gam.learn(df.select("doc_id", "text"), labels, F.col("doc_id") % 5 != 0)
    got = quality_gam.scored(df.select("doc_id", "text", "quality"), model).filter("doc_id % 5 = 0").collect()
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in got]) > 0.95
    odd = quality_gam.scored(spark.createDataFrame([(1, None), (2, ""), (3, "a " * 300_000)], "doc_id long, text string"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]
    assert quality_gam.scored(empty.select("doc_id", "text"), model).count() == 0
    blank = quality_gam.learn(df.select("doc_id", "text"), labels.limit(0), F.lit(True))
    assert quality_gam.scored(df.select("doc_id", "text"), blank).first()["score"] == 0.5


def test_trees_against_plain_code():
    rng = np.random.default_rng(5)
    loss = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        g, h = rng.normal(size=n), rng.random(n)
        parts = [range(n)]
        for _ in range(2):  # three leaves, the best cut each time
            cuts = [(loss(g[p[0]:c], h[p[0]:c]) + loss(g[c:p[-1] + 1], h[c:p[-1] + 1]) - loss(g[list(p)], h[list(p)]), k, c)
                    for k, p in enumerate(parts) for c in p[1:]]
            if cuts and max(cuts)[0] > 1e-9:
                _, k, c = max(cuts, key=lambda x: x[0])
                parts[k:k + 1] = [range(parts[k][0], c), range(c, parts[k][-1] + 1)]
        want = np.zeros(n)
        for p in parts:
            want[list(p)] = g[list(p)].sum() / (h[list(p)].sum() + 1)
        assert quality_gam.shallow_tree(g, h, 3) == pytest.approx(want)
        g, h = rng.normal(size=(n + 1, 4)), rng.random((n + 1, 4))
        best = max((sum(loss(g[a, b], h[a, b]) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))), i, j)
                   for i in range(1, n + 1) for j in range(1, 4))
        gain, step = quality_gam.pair_tree(g, h)
        assert gain == pytest.approx(best[0] - loss(g, h))
        for a in (slice(0, best[1]), slice(best[1], None)):
            for b in (slice(0, best[2]), slice(best[2], None)):
                assert step[a, b] == pytest.approx(g[a, b].sum() / (h[a, b].sum() + 1))


def test_measures_do_not_depend_on_the_neighbours(rows):
    """Each text alone, and all of them in one array: the same numbers, and the plain ones where they are simple."""
    held = [r[1] or "" for r in rows]
    flat = lambda some: quality_gam.measures(*(lambda b: (np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)])))([t.encode() for t in some]))
    together = flat(held)
    for text, got in zip(held, together, strict=True):
        alone = dict(zip(quality_gam.NAMES, flat([text])[0], strict=True))
        assert got == pytest.approx(list(alone.values()))
        w, low = words(text), [x.lower() for x in words(text)]
        assert alone["words"] == pytest.approx(np.log1p(len(w)))
        assert alone["letters_per_word"] == pytest.approx(sum(len(x.encode()) for x in w) / max(1, len(w)))
        assert alone["per_line"] == pytest.approx(np.log1p(len(w) / (1 + text.count("\n"))))
        assert alone["echo"] in (pytest.approx(sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(1, len(w))),
                                 pytest.approx(sum(a == b for a, b in zip(low, low[1:], strict=False)) / max(1, len(w))))


# 10: language

def test_automaton_knows_exactly_the_stretches():
    rng = random.Random(11)
    symbols = [rng.randint(0, 3) for _ in range(60)]
    following = language_id.suffix_automaton(symbols)
    known = {tuple(symbols[a:b]) for a in range(60) for b in range(a + 1, 61)}
    for _ in range(3000):
        some, state = [rng.randint(0, 3) for _ in range(rng.randint(1, 8))], 1
        for s in some:
            state = following[state].get(s, 0)
        assert (state > 0) == (tuple(some) in known)


def test_languages_are_told_apart(spark, empty):
    rng = random.Random(12)
    kinds = {"aa": ("ta", "ro", "mi", "ken"), "bb": ("sul", "vor", "ah", "ling"), "cc": ("éa", "ôu", "ien", "tra")}
    rows_ = [(i, prose(rng, rng.randint(5, 80), kinds[k]), k) for i, k in enumerate(list(kinds) * 60)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    parser = language_id.Parser(language_id.training_texts(df, F.col("doc_id") % 4 != 0))
    got = language_id.identify(df, parser, "doc_id", "lang").filter("doc_id % 4 = 0").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "ta" * 50_000), (5, "東京")], "doc_id long, text string")
    got = {i: (r["lang_pred"], r["score"]) for i, r in by_id(language_id.identify(odd, parser, "doc_id")).items()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa" and got[5][0] in kinds
    nothing = language_id.Parser(language_id.training_texts(empty, F.lit(True)))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing, "doc_id").collect()} == {"und"}


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(14)
    rows_ = [(i, prose(rng, 30, ("ta", "ro", "mi")), "aa") for i in range(40)] + [(100 + i, prose(rng, 3000, ("sul", "vor", "ah")), "bb") for i in range(12)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    texts_ = language_id.training_texts(df, F.lit(True), longest=500)
    assert sorted(texts_) == ["aa", "bb"] and all(len(t) == 500 for t in texts_["bb"]) and len(texts_["bb"]) == 12
    assert all(any(t in r[1] for r in rows_[40:]) for t in texts_["bb"])
    got = language_id.identify(df, language_id.Parser(texts_), "lang").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    mixed = spark.createDataFrame([(1, "x" * 900, "cc"), (2, "short", "cc")], "doc_id long, text string, lang string")
    assert [len(t) for t in language_id.training_texts(mixed, F.lit(True), longest=500)["cc"]] == [5, 500]  # short ones first


@pytest.mark.parametrize("cells", [language_id.TABLE_CELLS, 0])
def test_phrases_against_a_plain_parse(monkeypatch, cells):
    monkeypatch.setattr(language_id, "TABLE_CELLS", cells)  # 0: steps are searched
    rng = random.Random(13)
    parser = language_id.Parser({"aa": [prose(rng, 50, ("ta", "ro"))], "bb": [prose(rng, 50, ("sul", "ta"))]})
    text = prose(rng, 200)
    for lang, column in zip(parser.languages, parser.phrases([text]).T, strict=True):
        step = lambda s, c: int(parser.step(np.array([s]), np.array([c]))[0])
        root, total = parser.roots[parser.languages.index(lang)], 0
        codes = parser.codes(text.lower()).tolist()
        for at in range(0, len(codes), language_id.PIECE):
            state, total = root, total + 1
            for c in codes[at:at + language_id.PIECE]:
                now = step(state, c)
                total, state = (total, now) if now else (total + 1, step(root, c) or root)
        assert column[0] == total


# shared helpers and the pipeline

def test_hashes_of_stretches():
    raw = np.frombuffer(b"abcabcabcd", np.uint8)
    h = base.Stretches(raw).hashes(np.array([0, 3, 6, 0]), np.array([3, 6, 9, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    words_, doc, _, _ = base.hashed_words(np.frombuffer(b"ab cdab ab", np.uint8), np.array([0, 5, 5, 10]))
    assert doc.tolist() == [0, 0, 2, 2] and words_[0] == words_[2] == words_[3]


def test_ranges_are_merged():
    a, b = base.merged(np.array([5, 0, 8, 20]), np.array([8, 3, 9, 22]))
    assert (a.tolist(), b.tolist()) == ([0, 5, 20], [3, 9, 22])


def test_rows_without_any_value(spark, net):
    """Null ids, texts, languages and sources: a row each, and no crash; very large ids stay exact."""
    big = 2 ** 60 + 1
    df = spark.createDataFrame([(None, None, None, None), (None, "a few words", None, "a"), (big, "a few words", "en", None), (2, None, "en", "a")],
                               "doc_id long, text string, lang string, source string")
    ids = [None, None, big, 2]
    key = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    want = sorted((i is None, i or 0) for i in ids)
    parser = language_id.Parser(language_id.training_texts(df, F.lit(True)))
    model = quality_gam.learn(df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    results = [mixing.mix(df), suffix_dedup.without_repeats(df), quality_rules.judge(df), near_dedup.link(df), line_dedup.without_lines(df),
               packing.pack(df, *queries.tokenizer_files()), pii.find(df, net), quality_gam.scored(df.select("doc_id", "text"), model),
               language_id.identify(df, parser, "doc_id")]
    for result in results:
        assert key(result.collect()) == want


FOLDER = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, docs, empty):
    for table in (docs, empty):
        now = table
        for name, step in corpus_pipeline.STAGES:
            before, now = now, base.stage(step(spark, now, FOLDER), f"test-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == table.columns
            if name == "near_copies":
                assert now.count() <= before.count()
    assert now.count() == 0
