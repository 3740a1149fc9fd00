"""The pipeline on a small folder: every stage against plain Python on what the stage before kept, and the run as a whole."""

import collections
import random

import pytest
from test_llm import brute_components, prose, words

import corpus_pipeline
from noticegrid.llm import base, packing, quality_gam, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    """Clean prose, junk, a recurring footer, a group of near copies, exact copies, repeated rows, null and empty texts, no id."""
    rng = random.Random(31)
    clean = lambda n: "\n".join(prose(rng, rng.randint(9, 14)).capitalize() + "." for _ in range(n))
    junk = lambda: " ".join(rng.choices(["$$$", "###", "BUY", "1000", "!!!", "&|&", "%%"], k=120))
    whole = clean(30).split("\n") + ["A line of eight others and the group."]
    texts = []
    for i in range(40):  # near copies of one another
        lines = list(whole)
        lines[i % 30] += f" changed {i}" if i else ""
        texts.append("\n".join(lines))
    texts += [f"{clean(8)}\nvisit page {i} of our big site\n{clean(4)}" for i in range(20)]
    texts += [f"{clean(8)}\nA line of eight others and the group.\n{clean(4)}" for _ in range(8)]
    texts += ["visit page 7 of our big site"] + [clean(rng.randint(5, 30)) for _ in range(60)] + [junk() for _ in range(40)]
    texts += [texts[100], texts[100], texts[101], None, "", " \n ", "x", clean(400)]
    rows = [(i, t, "en", [None, "a", "b", "b"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[90], rows[90], (None, texts[95], "en", "a", len(texts[95]))], {i: int("$$$" not in (t or "") and bool(t)) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, quality = documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, q, 0) for i, q in quality.items() if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What goes into each stage, and what comes out of the last."""
    tables = [base.read(spark, folder, "documents")]
    for name, step in corpus_pipeline.STAGES:
        tables.append(base.stage(step(spark, tables[-1], folder), f"test-{name}"))
    return tables


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_all_but_the_last_keep_the_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_rejected_documents_go(stages, spark, folder):
    model = quality_gam.learn(stages[0], base.read(spark, folder, "labels"), queries.fold(5) != 0)
    scored = quality_gam.scored(stages[0], model, "score_").collect()
    assert rows_of(stages[1]) == sorted((tuple(r)[:-1] for r in scored if r["score_"] >= 0.3), key=repr)
    left = {r["doc_id"] for r in stages[1].collect()}
    _, quality = documents()
    assert len([i for i, q in quality.items() if not q and i < 170 and i in left]) <= 4 and len([i for i, q in quality.items() if q and i not in left]) <= 4


def plain_lines(rows):
    texts = sorted({r[1] for r in rows if r[1]})
    shingles = {}
    for t in texts:
        w = words(t.lower())
        shingles[t] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    cls = {t: t for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if 100 * len(shingles[a] & shingles[b]) >= 65 * len(shingles[a] | shingles[b]):
                old, new = cls[a], cls[b]
                cls = {t: new if c == old else c for t, c in cls.items()}
    masked = lambda line: ["<*>" if any(c.isdigit() for c in t) else t for t in words(line)]
    lines = [(t, k, tuple(masked(x))) for t in texts for k, x in enumerate(t.split("\n")) if words(x)]
    leaf = lambda tokens: (len(tokens), tokens[:3])
    held = lambda pairs: {k for k, v in (lambda d: [d[a].add(cls[t]) for a, t in pairs] and d or d)(collections.defaultdict(set)).items() if len(v) > 10}
    leaves = held([(leaf(x), t) for t, _, x in lines])
    lines = [x for x in lines if leaf(x[2]) in leaves]
    constant = held([((leaf(x), p, token), t) for t, _, x in lines for p, token in enumerate(x) if token != "<*>"])
    template = lambda x: tuple(token if (leaf(x), p, token) in constant else "<*>" for p, token in enumerate(x))
    good = [(t, k, (leaf(x), template(x))) for t, k, x in lines
            if 0 < sum(c != "<*>" for c in template(x)) and 2 * sum(c != "<*>" for c in template(x)) >= len(x)]
    recurring = held([(a, t) for t, _, a in good])
    gone = collections.defaultdict(set)
    for t, k, a in good:
        if a in recurring:
            gone[t].add(k)
    for r in rows:
        if r[1] and gone[r[1]]:
            text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[1]])
            if words(text):
                yield (r[0], text, *r[2:4], len(text))
        else:
            yield r


def test_recurring_lines_go(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    assert after == sorted(plain_lines(before), key=repr)
    assert sum("big site" in (r[1] or "") for r in before) > 10 and not any("big site" in (r[1] or "") for r in after)
    assert any("eight others" in (r[1] or "") for r in after)  # the group counts once


def test_one_document_of_each_group_stays(stages):
    before = rows_of(stages[2])
    found = brute_components([(r[0], r[1]) for r in before if r[0] is not None], 80, 5)
    want = {r for r in before if r[0] is None or found[r[0]][2]}
    assert rows_of(stages[3]) == sorted(want, key=repr)
    assert len(before) - len(want) > 30


def test_sources_come_near_their_targets(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = collections.Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    open_, weight, due, target = sorted(size, key=lambda s: (s is None, s)), {}, 1.5 * sum(size.values()), {}
    for i, s in enumerate(open_):
        weight[s] = (3, 1, 2)[i % 3]
    while open_:
        level = due / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * size[s]]
        for s in full or open_:
            target[s] = 2 * size[s] if full else weight[s] * level
            due -= target[s]
        open_ = [s for s in open_ if s not in target]
    taken, times = collections.Counter(), collections.Counter(tuple(r) for r in after)
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    longest = max(len(words(r["text"])) for r in before)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in target)
    known = collections.Counter(tuple(r) for r in before)
    assert all(n <= 2 * known[r] for r, n in times.items())


def plain_pieces(rows):
    exact = packing.encoder(queries.tokenizer_files()[0], None)
    for r in rows:
        ids = [*exact(r["text"] or ""), 2]
        at = packing.cuts(len(ids), 1024)
        yield from ((r["doc_id"], k, a, b - a) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)))


def test_every_id_is_packed_once(stages):
    got = stages[5].collect()
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got)
    assert pieces == collections.Counter(plain_pieces(stages[4].collect()))
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_the_run_is_its_stages(spark, folder, stages):
    shown = lambda df: rows_of(df.select("doc_id", "piece", "start", "length", "ids_crc32"))
    assert shown(corpus_pipeline.run(spark, folder)) == shown(stages[5])
