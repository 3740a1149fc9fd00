"""Personal data: rules for four kinds, and a character-level bidirectional LSTM with CRF transitions.

The rules give base spans. The network is trained in numpy on the driver from labelled spans: windows from a
bounded sample of texts, with the rules' spans, and with spans of the four kinds in many more forms written into
them (and numbers that are none of them). A text is cut into windows that overlap by half; each is decoded by
Viterbi; a character's tag is taken from the window it lies most centrally in, and runs of tags over
the whole text become spans, checked against the loosest shape of their kind. Spans that touch no base span are added.

A span of any kind holds a digit or an @, so only windows with one of these in reach of a window's half are decoded. Every
character within 48 of one is decoded; an added span that reaches further from its only one may be cut short. Texts are processed whole, in one pass without a shuffle.

A null text is an empty text; both have no spans. Very long texts give more windows, decoded a bounded number at a time. Repeated
rows get the same spans each. An empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.base import hashed_share

KINDS = ("email", "ip", "card", "phone")
WINDOW, HALF, MARGIN = 64, 32, 32
AT_ONCE = 1024
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 8_000
OVERSAMPLE = 50
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 260, 48, 0.02, 7

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Matches can not begin inside a run of digits: it would have matched from its first digit.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def small_parts(text: str) -> bool:
    return all(len(p) < 4000 and int(p) <= 255 for p in re.findall("[0-9]+", text))


def emails(text: str) -> list[Span]:
    """As the leftmost matches of local part, @, domain: each @ is tried once, with the local part that ends at it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    if not re.search("[0-9@]", text):
        return {k: [] for k in KINDS}
    valid: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
        ("ip", IP, small_parts), ("card", CARD, is_card), ("phone", PHONE, lambda s: 9 <= len(digits_of(s)) <= 15)]
    return {"email": emails(text)} | {k: [m.span() for m in p.finditer(text) if ok(m.group())] for k, p, ok in valid}


LOOSE: dict[str, Callable[[str], bool]] = {
    "email": lambda s: bool(re.fullmatch(r"[^\s@]{1,64}@[^\s@]{2,253}", s)) and any(c.isalpha() for c in s),
    "ip": lambda s: bool(re.fullmatch(r"[0-9]{1,3}(?:[\s\[\](){}]*\.[\s\[\](){}]*[0-9]{1,3}){3}", s)) and small_parts(s),
    "card": lambda s: bool(re.fullmatch(r"[0-9](?:[\s./_-]{0,2}[0-9])+", s)) and is_card(s),
    "phone": lambda s: bool(re.fullmatch(r"\+?[0-9(](?:[\s().\/-]{0,3}[0-9])+", s)) and 9 <= len(digits_of(s)) <= 15
    and bool(re.search(r"[\s()./-]", s)),
}

TAGS = 1 + 2 * len(KINDS)  # nothing; then begin and inside of each kind
SYMBOLS = 132
PAD, WIDE, OTHER = 129, 130, 131


def symbols(text: str) -> np.ndarray:
    """Characters as classes: letters by case, digits as one, other ASCII as itself."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where(points < 128, points, np.where(points < 0x2000, WIDE, OTHER))
    out[(out >= 48) & (out <= 57)] = 48
    out[(out >= 97) & (out <= 122)] = 97
    out[(out >= 65) & (out <= 90)] = 65
    return out


def tags_of(length: int, spans: dict[str, list[Span]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for k, kind in enumerate(KINDS):
        for a, b in spans[kind]:
            if not out[a:b].any():
                out[a:b], out[a] = 2 + 2 * k, 1 + 2 * k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights: per direction symbol, state and bias to gates; states to tags; tag to tag."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.w = {"out": rng.normal(0, 0.3, (2 * h, TAGS)), "out_b": np.zeros(TAGS), "next": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, 0.3, (SYMBOLS, 4 * h)), f"h{d}": rng.normal(0, 0.3, (h, 4 * h)),
                       f"b{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def run(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States [place, row, unit] of one direction (x: symbols [place, row]), and what the way back needs."""
        n, h = x.shape[1], HIDDEN
        state, cell, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        out = np.zeros((len(x), n, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = self.w[f"x{d}"][x[t]] + state @ self.w[f"h{d}"] + self.w[f"b{d}"]
            gates, new = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before = cell
            cell = gates[:, h:2 * h] * before + gates[:, :h] * new
            bent = np.tanh(cell)
            kept.append((t, state, before, gates, new, bent))
            state = gates[:, 2 * h:] * bent
            out[t] = state
        return out, kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.run(d, x)[0] for d in "fb"], axis=2)
        return states @ self.w["out"] + self.w["out_b"]

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """The best tags of each window: [row, place]."""
        scores = self.scores(windows.T)
        best, back = scores[0] + self.w["first"], []
        for t in range(1, len(scores)):
            ways = best[:, :, None] + self.w["next"]
            back.append(ways.argmax(axis=1))
            best = ways.max(axis=1) + scores[t]
        tags = [best.argmax(axis=1)]
        for step in reversed(back):
            tags.append(step[np.arange(len(step)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def slopes(self, x: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean negative log-likelihood (x, tags: [place, row])."""
        h, places, n = HIDDEN, len(x), x.shape[1]
        ways = {d: self.run(d, x) for d in "fb"}
        states = np.concatenate([ways[d][0] for d in "fb"], axis=2)
        scores = states @ self.w["out"] + self.w["out_b"]
        pool = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        ahead, behind = [scores[0] + self.w["first"]], [np.zeros((n, TAGS), np.float32)]
        for t in range(1, places):
            ahead.append(pool(ahead[-1][:, :, None] + self.w["next"], 1) + scores[t])
        for t in range(places - 1, 0, -1):
            behind.append(pool(self.w["next"] + (scores[t] + behind[-1])[:, None, :], 2))
        behind = behind[::-1]
        total = pool(ahead[-1], 1)[:, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        d_scores, rows = np.zeros_like(scores), np.arange(n)
        for t in range(places):
            d_scores[t] = np.exp(ahead[t] + behind[t] - total)
            d_scores[t][rows, tags[t]] -= 1
            if t:
                both = ahead[t - 1][:, :, None] + self.w["next"] + (scores[t] + behind[t])[:, None, :]
                g["next"] += np.exp(both - total[:, :, None]).sum(axis=0)
                np.add.at(g["next"], (tags[t - 1], tags[t]), -1)
        g["first"] += d_scores[0].sum(axis=0)
        g["out"] += np.einsum("tnh,tnk->hk", states, d_scores)
        g["out_b"] += d_scores.sum(axis=(0, 1))
        d_states = d_scores @ self.w["out"].T
        for at, d in enumerate("fb"):
            d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, state, before, gates, new, bent in reversed(ways[d][1]):
                d_state = d_state + d_states[t][:, at * h:(at + 1) * h]
                i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                d_cell = d_cell + d_state * o * (1 - bent ** 2)
                dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_state * bent * o * (1 - o),
                                     d_cell * i * (1 - new ** 2)], axis=1)
                np.add.at(g[f"x{d}"], x[t], dz)
                g[f"h{d}"] += state.T @ dz
                g[f"b{d}"] += dz.sum(axis=0)
                d_state, d_cell = dz @ self.w[f"h{d}"].T, d_cell * f
        return {k: v / n for k, v in g.items()}


def invented(rng: np.random.Generator) -> tuple[str | None, str]:
    """A kind and a string of that kind; or None and a number that is no personal data."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(map(chr, rng.integers(97, 123, rng.integers(a, b))))
    pick = lambda *x: x[rng.integers(len(x))]
    kind = pick(*KINDS, None, None)
    if kind == "email":
        local = pick(word(2, 9), f"{word(1, 8)}.{word(2, 8)}", f"{word(2, 8)}.{digits(2)}", f"{word(2, 7)}{digits(2)}", f"{word(2, 6)}é{word(1, 3)}")
        return kind, f"{local}@{pick(word(3, 9), f'mail{digits(1)}.{word(3, 8)}', word(2, 5) + 'ö' + word(2, 4))}{pick('.com', '.org', '.net', '.de', '')}"
    if kind == "ip":
        dot = pick(".", ".", ".", "[.]", " . ")
        return kind, dot.join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "card":
        start = pick("4", "51", "37", "6011") + digits(pick(11, 12, 13))
        start = start[:15]
        number = next(start + c for c in "0123456789" if luhn(start + c))
        gap = pick("", "", " ", "-", ".", "  ")
        return kind, gap.join(number[i:i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        area, mid, end = digits(3), digits(3), digits(4)
        return kind, pick(f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}",
                          f"+{digits(2)} {area} {mid}{end}", f"0{area}/{mid}{end}", f"+{digits(1)}-{area}-{mid}-{end}")
    return None, pick(f"version {digits(1)}.{digits(1)}", digits(rng.integers(1, 13)), f"{digits(2)}.{digits(2)}.20{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}",
                      "AKIA" + "".join(pick(*"ABCDEFGHJKLMNP234567") for _ in range(16)), "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(16, 41))),
                      f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"${digits(3)}.{digits(2)}", f"@{word(2, 7)}", f"#{digits(5)}")


def labelled_windows(texts: list[str], count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags [row, place]: one window in four as it stands, at a digit or @ where the text has one."""
    x, y = np.full((count, WINDOW), PAD), np.zeros((count, WINDOW), np.int64)
    texts = [t for t in texts if t] or ["a text without anything else in it. " * 4]
    marked = [(t, m.start()) for t in texts for m in re.finditer(r"[0-9@]+", t)]
    for row in range(count):
        if marked and row % 4 == 0:
            text, at = marked[rng.integers(len(marked))]
            a = max(0, at - int(rng.integers(0, WINDOW)))
            part = text[max(0, a - WINDOW):a + 2 * WINDOW]
            shift, spans = a - max(0, a - WINDOW), base_spans(part)
        else:
            text = texts[rng.integers(len(texts))]
            a = int(rng.integers(0, max(1, len(text) - WINDOW)))
            kind, value = invented(rng)
            at = int(rng.integers(0, WINDOW))
            left, right = text[a:a + at], text[a + at:a + 2 * WINDOW]
            joint = ("", " ", ", ", "(", ": ")[rng.integers(5)] if left[-1:].isspace() else " "
            tail = (" ", ". ", ", ", "\n", ")")[rng.integers(5)]
            part, start = f"{left}{joint}{value}{tail}{right}", len(left) + len(joint)
            spans = {k: [(start, start + len(value))] if k == kind else [] for k in KINDS}
            shift = int(rng.integers(0, WINDOW // 2))
        s, t = symbols(part), tags_of(len(part), spans)
        n = len(s[shift:shift + WINDOW])
        x[row, :n], y[row, :n] = s[shift:shift + n], t[shift:shift + n]
    return x, y


def train(texts: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        x, y = labelled_windows(texts, BATCH, rng)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in net.slopes(x.T, y.T).items():
            g = np.clip(g, -1, 1)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.w[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def windows_of(codes: np.ndarray, everywhere: bool = False) -> np.ndarray:
    """The numbers of the windows to decode; window k begins at k * HALF."""
    n = max(1, -(-(len(codes) - WINDOW) // HALF) + 1)
    if everywhere:
        return np.arange(n)
    seen = np.r_[0, np.cumsum((codes == 48) | (codes == 64))]
    begin = np.arange(n) * HALF
    a, b = np.maximum(begin - MARGIN, 0), np.minimum(begin + WINDOW + MARGIN, len(codes))
    return np.flatnonzero(seen[b] > seen[np.minimum(a, len(codes))])


def decoded(net: Network, texts: list[str], everywhere: bool = False) -> list[dict[str, list[Span]]]:
    """The network's spans of each text, from all its windows."""
    codes = [symbols(t) for t in texts]
    jobs = [(i, int(k)) for i, c in enumerate(codes) if len(c) for k in windows_of(c, everywhere)]
    tags = [np.zeros(len(c), np.int64) for c in codes]
    for at in range(0, len(jobs), AT_ONCE):
        part = jobs[at:at + AT_ONCE]
        x = np.full((len(part), WINDOW), PAD)
        for row, (i, k) in enumerate(part):
            held = codes[i][k * HALF:k * HALF + WINDOW]
            x[row, :len(held)] = held
        for (i, k), found in zip(part, net.decode(x), strict=True):
            last = (k * HALF + WINDOW) >= len(codes[i])
            a, b = 0 if k == 0 else HALF // 2, WINDOW if last else WINDOW - HALF // 2
            place = tags[i][k * HALF + a:k * HALF + b]
            place[:] = found[a:a + len(place)]
    return [spans_of(t, text) for t, text in zip(tags, texts, strict=True)]


def spans_of(tags: np.ndarray, text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    kind = np.r_[0, (tags + 1) // 2, 0]
    begins = np.r_[False, (tags % 2 == 1), False]
    for a in np.flatnonzero((kind > 0) & ((kind != np.r_[0, kind[:-1]]) | begins)):
        b = a + 1
        while kind[b] == kind[a] and not begins[b]:
            b += 1
        start, stop = int(a) - 1, int(b) - 1
        while start < stop and text[start] in " \t\r\n,;:.":
            start += 1
        while start < stop and text[stop - 1] in " \t\r\n,;:.":
            stop -= 1
        name = KINDS[kind[a] - 1]
        if LOOSE[name](text[start:stop]):
            out[name].append((start, stop))
    return out


def with_added(base: dict[str, list[Span]], more: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The base spans, and those of the network that touch no base span of any kind."""
    taken = [s for spans in base.values() for s in spans]
    free = lambda s: all(s[1] <= a or s[0] >= b for a, b in taken)
    return {k: sorted(base[k] + [s for s in more[k] if free(s)]) for k in KINDS}


def written(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def sample_texts(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[str]:
    """A bounded sample to train on: texts of at most `chars` characters, the first by a hash, half of them with a digit.

    Of many documents only a share chosen by their hash is looked at, large enough for texts with a digit to be one in fifty.
    """
    near = hashed_share(F.col("doc_id"), OVERSAMPLE * texts, docs.count())
    short = docs.filter(near & (F.length("text") > 0) & (F.length("text") <= chars)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    pick = lambda rows: [r["text"] for r in rows.orderBy("h", "text").limit(texts // 2).collect()]
    return pick(short) + pick(short.filter(F.col("text").rlike("[0-9]")))


def find(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, base counts per kind, the digest of the base spans, and all spans."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            more = decoded(held.value, texts)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], *(pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([written(with_added(b, m)) for b, m in zip(base, more, strict=True)], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
