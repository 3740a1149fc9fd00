"""Language identification by cross-parsing entropy.

Per language, labelled text becomes a suffix automaton: every stretch of that text is a path from its root. A text is parsed against
each language greedily into the longest stretches the automaton knows. A language that describes a text well needs
few of them. A phrase is charged the bits that name a place in the training text, so languages with more
training text do not win by its length; the language with the fewest bits wins, ties go to the first by name.

Automata are built on the driver from a bounded sample: documents in order of a hash of their id, those of at most `longest`
characters first and then stretches of that length from longer ones, until a language has `letters` characters. Texts are parsed whole, in pieces of `PIECE` characters, all pieces
and languages of a batch step by step at once; there is no shuffle.

A null text, or one without any letter, is `und` with score 0; so is everything if nothing can be learned. Repeated rows get the
same answer each. An empty table gives no rows. Further columns are not looked at, but for those the caller carries along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid.llm.base import hashed_share

LETTERS = 40_000
LONGEST = 8_000
DOCUMENTS = 400
OVERSAMPLE = 4
PIECE = 256
AT_ONCE = 4096
TABLE_CELLS = 50_000_000
GAP, UNKNOWN = 0, 1


def training_texts(docs: DataFrame, usable: Column, documents: int = DOCUMENTS, longest: int = LONGEST) -> dict[str, list[str]]:
    """Per language, texts in order of a hash of their id; at most `documents` of at most `longest` characters.

    Longer texts follow the others, each as one stretch that begins at a place its id is hashed to; so a language of long texts only is learned too.
    Of a language with many documents only a share chosen by that hash is ranked, about OVERSAMPLE times what is wanted.
    """
    named = docs.filter(usable & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == lang, hashed_share(F.col("doc_id"), OVERSAMPLE * documents, n)) for lang, n in sorted(counts.items())])
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "text")
    long = F.length("text") > longest
    begin = (F.pmod(F.xxhash64("doc_id", F.lit("begin")), F.greatest(F.length("text") - longest, F.lit(1)).cast("long")) + 1).cast("int")
    rows = named.filter(share & (F.length("text") > 0)) \
        .select("lang", "doc_id", long.alias("long"), F.when(long, F.substr("text", begin, F.lit(longest))).otherwise(F.col("text")).alias("text")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= documents) \
        .orderBy("lang", "rank").toLocalIterator()
    out: dict[str, list[str]] = {}
    for row in rows:
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The steps of each state of the automaton of all stretches; state 0 is none, 1 is the root."""
    following: list[dict[int, int]] = [{}, {}]
    longest, link, last = [0, 0], [0, 0], 1
    for s in symbols:
        new = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(1)
        p = last
        while p and s not in following[p]:
            following[p][s] = new
            p = link[p]
        if p:
            q = following[p][s]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p and following[p].get(s) == q:
                    following[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return following


class Parser:
    """All languages' automata, and the codes of characters.

    Steps are kept as sorted numbers (state * width + symbol); they are spread into a table of states by symbols where that has at most
    TABLE_CELLS cells, as for alphabets, and searched otherwise, as for thousands of signs.
    """

    def __init__(self, texts: dict[str, list[str]], letters: int = LETTERS):
        self.languages = sorted(texts)
        cut = {}
        for lang in self.languages:
            taken, total = [], 0
            for text in texts[lang]:
                if total < letters:
                    taken.append(text.lower())
                    total += len(text)
            cut[lang] = "\n".join(taken)
        known = sorted({c for text in cut.values() for c in text if c.isalpha()})
        self.code = {c: i + 2 for i, c in enumerate(known)}
        self.width = len(known) + 2
        steps, self.roots, self.bits, offset = [], [], [], 0
        for lang in self.languages:
            following = suffix_automaton(self.codes(cut[lang]).tolist())
            self.roots.append(offset + 1)
            steps += [((offset + state) * self.width + s, offset + to) for state, step in enumerate(following) for s, to in step.items()]
            self.bits.append(np.log2(len(cut[lang]) + 2))
            offset += len(following)
        steps.sort()
        self.at, self.to = np.array([a for a, _ in steps], np.int64), np.array([b for _, b in steps], np.int32)
        self.table = None
        if offset * self.width <= TABLE_CELLS:
            self.table = np.zeros(offset * self.width, np.int32)
            self.table[self.at] = self.to
            self.at = self.to = None

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes with its symbol; 0 if nowhere."""
        asked = state.astype(np.int64) * self.width + symbol
        if self.table is not None:
            return self.table[asked]
        place = np.minimum(np.searchsorted(self.at, asked), len(self.at) - 1)
        return np.where(self.at[place] == asked, self.to[place], 0)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        distinct, where = np.unique(points, return_inverse=True)
        of = [self.code.get(chr(c), UNKNOWN if chr(c).isalpha() else GAP) for c in distinct.tolist()]
        return np.array(of, np.int32)[where]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """[text, language]: how many phrases the text parses into."""
        codes = [self.codes(t.lower()) for t in texts]
        sizes = np.array([len(c) for c in codes])
        per = -(-sizes // PIECE)
        of = np.repeat(np.arange(len(texts)), per)
        begin = np.concatenate([np.arange(k) * PIECE for k in per]) if len(per) else np.zeros(0, int)
        size = np.minimum(sizes[of] - begin, PIECE)
        everything = np.concatenate([*codes, np.zeros(PIECE, np.int32)])
        begin = begin + (np.cumsum(sizes) - sizes)[of]
        out = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), AT_ONCE):
            rows = order[at:at + AT_ONCE]
            np.add.at(out, of[rows], self._parse(everything, begin[rows], size[rows]).T)
        return out

    def _parse(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(begin), axis=1)
        count = np.ones(state.shape, np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            symbol = codes[begin[:live] + t]
            now = self.step(state[:, :live], symbol)
            miss = now == 0
            if miss.any():
                count[:, :live] += miss
                again = self.step(roots, symbol)
                now = np.where(miss, np.where(again == 0, roots, again), now)
            state[:, :live] = now
        return count

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its share of the weight exp2(-bits) per hundred characters."""
        sound = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if sound:
            held = [texts[i] for i in sound]
            bits = self.phrases(held) * np.array(self.bits)
            best = bits.argmin(axis=1)
            gap = (bits - bits.min(axis=1, keepdims=True)) / np.array([[len(t)] for t in held]) * 100
            share = 1 / np.exp2(-np.minimum(gap, 60)).sum(axis=1)
            for i, b, s in zip(sound, best, share, strict=True):
                names[i], scores[i] = self.languages[b], s
        return names, scores


def identify(docs: DataFrame, parser: Parser, *carried: str) -> DataFrame:
    """The carried columns, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            names, scores = [], []
            for at in range(0, len(texts), 128):
                some = held.value.best(texts[at:at + 128])
                names += some[0]
                scores.append(some[1])
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in carried), pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                    [*carried, "lang_pred", "score"])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*carried, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")
