"""Alignment, differencing and repair of conversations against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticegrid.llm import alignment, conversations, queries, windows

DOCS = "doc_id long, text string, n_a string, pairs string, key int, part int, ids string"
TALKS = "conv_id long, turn long, role string, text string, part int, lines string, held string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    stems = ["the ", "Straße", "naïve ", "東京", "  ", "\n", "'s ", "don't", "12345", "…", "token", "ization ", "\t", "🙂", "<|endoftext|>", "<s>", "<0x0A>", "(x)"]
    out = ["".join(rng.choices(stems, k=rng.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "a", "\n\n", "▁ is a mark", *out, out[3], out[3], "word " * 5000, "x" * 3000, "<|endoftext|> is text"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 4 else None, t, "n", "p", 1, 2, "i") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], rows[7]], DOCS).repartition(3).cache()


# 11: alignment

def side_a():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def read(text):
        ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in ids]
    return read


def side_b():
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def token(i):
        piece = pieces.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte and pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def read(text):
        ids = pieces.encode(text)
        return ids, [token(i) for i in ids]
    return read


def plain_alignment(texts_):
    one, two, found = side_a(), side_b(), []
    for text in texts_:
        found.append(None)
        if not text:
            continue
        (ids_a, bytes_a), (ids_b, bytes_b) = one(text), two(text)
        if b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, b))) for b in (bytes_a, bytes_b))
        links = [(a, b) for a, x, n in zip(ids_a, ends_a, map(len, bytes_a), strict=True)
                 for b, y, m in zip(ids_b, ends_b, map(len, bytes_b), strict=True) if x - n < y and y - m < x] if len(ids_a) < 4000 else None
        groups, start = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a, strict=True) if start < e <= end) + "|"
                          + ",".join(str(i) for i, e in zip(ids_b, ends_b, strict=True) if start < e <= end)) if links is not None else None
            start = end
        found[-1] = (len(ids_a), len(ids_b), groups, links)
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = f
            yield (n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest())


@pytest.mark.parametrize("block", [alignment.BLOCK_PAIRS, 40])
def test_alignment_against_plain_code(spark, texts, docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)  # 40: several blocks of counts
    monkeypatch.setattr(alignment, "HELD_PAIRS", 100)
    short = docs.filter("doc_id is null or length(text) < 2000 or text is null")
    rows = [(r["doc_id"], r["text"]) for r in short.collect()]
    got = alignment.align(short, *map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *p) for (i, _), p in zip(rows, plain_alignment([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)


def test_ends_meet_on_random_cuts():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a, b = (np.unique(np.r_[rng.integers(1, n + 1, rng.integers(0, 2 * n + 1)), n]) for _ in range(2))
        if rng.random() < 0.3:
            b = a.copy()
        last_a, last_b = alignment.common_ends(a, b)
        assert a[last_a].tolist() == b[last_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_alignment_of_nothing_and_of_long_texts(spark, docs):
    files = list(map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    assert alignment.align(docs.limit(0), *files).count() == 0
    got = alignment.align(docs.filter("length(text) >= 2000"), *files, whole_groups=True).collect()
    assert len(got) == 2 and all(len(r["groups"].split(";")) == r["n_groups"] > 100 for r in got)


# 12: differencing

def test_windows_hold_every_id_once(spark, docs, texts):
    files = queries.tokenizer_files()
    got = windows.pack(docs, *files, capacity=64, partition_bytes=2000).collect()
    tokenizer = Tokenizer.from_file(files[0])
    want = collections.Counter()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    copies = collections.Counter(r["doc_id"] for r in docs.collect())
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        mine = pieces.pop(r["doc_id"])
        covered = collections.Counter()
        for start, length, crc, total in mine:
            assert total == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            covered.update(range(start, start + length))
        assert covered == dict.fromkeys(range(len(ids)), copies[r["doc_id"]])
        want["ids"] += copies[r["doc_id"]] * len(ids)
    assert not pieces and sum(r["length"] for r in got) == want["ids"]
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        ends = list(itertools.accumulate(n for _, n in held))
        assert [o for o, _ in held] == [0, *ends[:-1]]
        assert ends[-1] <= 64 and ends[-1] & (ends[-1] - 1) == 0  # full or a power of two: nothing is padded
    again = windows.pack(docs, *files, capacity=64, partition_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert windows.pack(docs.limit(0), *files).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(4)
    for n, k in ((40, 3), (200, 20), (7, 7), (3, 9)):
        lengths = rng.integers(1, 500, n)
        held = np.bincount(windows.differenced(lengths, k), lengths, minlength=k)
        assert held.sum() == lengths.sum() and len(held) == k
        if n >= 5 * k:
            assert held.max() - held.min() < 100
    two = windows.differenced(np.array([8, 7, 6, 5, 4]), 2)  # 8 - 7 and 6 - 5 are 1, 4 - 1 is 3, 3 - 1 is 2
    assert two[0] == two[2] != two[1] == two[3] == two[4]
    window, count = windows.balanced(np.full(10, 33), 64)  # no two fit into one window
    assert count == 10 and sorted(window.tolist()) == list(range(10))


# 13: conversations

def plain_search(rows):
    """Every sequence of edits that may be cheapest: breadth first over (place, state), nothing pruned but by cost and audit at the end."""
    best = {0: (0, "")}

    def with_inserts(states):
        for _ in range(3):
            for s, (cost, audit) in list(states.items()):
                t = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                states[t] = min(states.get(t, (10 ** 9, "")), (cost + 3, audit + "I"))
        return states
    for code in rows:
        after = {}
        for s, (cost, audit) in with_inserts(best).items():
            ways = [(s, cost + 4, audit + "D")]
            if code != "d":
                more, then = 3 * code.isupper(), {0: 2, 1: 2, 2: 3, 3: 2}[s]
                ways.append((then, cost + more + 3, audit + "R"))
                if code.lower() == "uuau"[s]:
                    ways.append((then, cost + more, audit + "K"))
                if code.lower() == "s" and s == 0:
                    ways.append((1, cost + more, audit + "K"))
            for t, c, a in ways:
                after[t] = min(after.get(t, (10 ** 9, "")), (c, a))
        best = after
    with_inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain_repair(rows):
    blank, talks = " \t\n\x0b\x0c\r", collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        dealt = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
        talks[conv] += [(turn, "user" if dealt == 4 else role, text)] * (0 if dealt == 0 else 2 if dealt == 3 else 1)
    for conv, said in talks.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, count = set(), "", collections.Counter()
        for _, role, text in said:
            end = text.rstrip(blank)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            code = role[:1] if role[:1] in tuple("sua") else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        cost, audit = plain_search(codes)
        left, lines, due = iter(said), [], 0
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(left)
            if letter != "D":
                system = letter == "K" and role[0] == "s"
                lines.append(f"{role if letter == 'K' else ('user', 'assistant')[due % 2]}:{text}")
                due += not system
        turns = [t for t, _, _ in said if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost,
               audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " ", "", None, "naïve 東京.", "a:b\nc."]) if rng.random() < 0.6 else f"Answer {rng.random()}."
            out.append((conv, None if rng.random() < 0.05 else turn, role, text))
    out += [out[5], out[5]]
    out += [(1000, t, "user" if rng.random() < 0.6 else "assistant", f"Turn {t % 150}{rng.choice('.? ')}") for t in range(400)]  # one with most rows
    out += [(1001, 3, "user", "Same."), (1001, 3, "user", "Same."), (1002, 10 ** 12, "system", "Rules."), (1002, -5, "assistant", "x" * 100_000 + ".")]
    return out


@pytest.fixture(params=["1", "6", "40"])
def partitions(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_repair_against_plain_code(spark, talks, partitions):
    rows = spark.createDataFrame([(*r, 1, "l", "h") for r in talks], TALKS)
    got = sorted(map(tuple, conversations.repair(conversations.damaged(rows)).collect()), key=str)
    assert got == sorted(plain_repair(talks), key=str)


def test_repaired_rows_are_the_hashed_ones(spark, talks):
    rows = conversations.damaged(spark.createDataFrame([(*r, 1, "l", "h") for r in talks], TALKS))
    said = collections.defaultdict(list)
    for r in conversations.repaired_rows(rows).orderBy("conv_id", "part", "seg", "place").collect():
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in conversations.repair(rows).collect():
        assert hashlib.sha256("\n".join(said[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


def test_search_proves_the_least_audit():
    rng = random.Random(1)
    for _ in range(1500):
        rows = "".join(rng.choice("ssuuuaaaxdSUAXuuaa") for _ in range(rng.randint(0, 14)))
        assert conversations.search(rows)[conversations.ASSISTANT] == plain_search(rows)
        for state, bound in enumerate(conversations.suffix_bounds(rows)[0]):
            ends = conversations.search(rows, state, False)
            assert all(bound <= cost + 3 * conversations.CLOSING[end] for end, (cost, _) in ends.items())


def test_no_conversations(spark):
    rows = spark.createDataFrame([], TALKS)
    assert conversations.repair(conversations.damaged(rows)).count() == 0
    dropped = [t for t in range(400) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:2]
    alone = conversations.damaged(spark.createDataFrame([(7, t, "user", "Hm.", 1, "l", "h") for t in dropped], TALKS))
    assert [tuple(r) for r in conversations.repair(alone).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert alone.filter(F.col("held")).count() == 0
