"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels tokens (runs of anything but white space) with B- and I- of four kinds, or O. Its features are the
shapes of a token and of its two neighbours: characters by class, letters collapsed, up to four digits of a run kept,
with the length in steps; a few cue words have shapes of their own. It is trained on the driver, by gradient on the
log-likelihood, from the small labelled table that labelled_table() makes, once in a driver process. Sequences end after a token
that ends in . ! or ? and at a line's end; longer ones than SEQUENCE tokens are decoded in cuts that see OVERLAP tokens to either
side. Viterbi runs over all sequences of a batch at once.

A span that the field adds has its end punctuation taken off, must pass its kind's check and must not overlap a span of the
patterns, which all stay. Null text counts as empty and has no spans. Repeated rows each give a row. Texts are read
whole, in time linear in their length; numpy works on a window of WINDOW characters, cut at white space where there is some in its
last tenth, and sees MARGIN characters to either side of it.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import body, small_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SEQUENCE, OVERLAP, WINDOW, MARGIN = 200, 20, 1 << 20, 1 << 12

# The patterns' parts and the card digits' bounds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    digits = only_digits(s)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start. Each pattern is tried only where it can start, so time is linear."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    ips, cards, ip_end, card_end = [], [], 0, 0
    for run in DIGITS.finditer(text):
        at = run.start()
        if at >= ip_end and (m := IP.match(text, at)):
            ip_end = m.end()
            if is_ip(m[0]):
                ips.append((1, at, ip_end))
        if at >= card_end and (m := CARD.match(text, at)):
            card_end = m.end()
            if is_card(m[0]):
                cards.append((2, at, card_end))
    found += ips + cards
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return found


# Shapes

_CLASS = np.full(256, 4, np.uint64)  # 0 space, 1 digit, 2 capital, 3 letter, 4 other, 5 and up: marks of their own
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 3
for _i, _c in enumerate("@.-+()/:,;=_#\"'$%!?"):
    _CLASS[ord(_c)] = 5 + _i
_SHAPE_CHARS = 24
_MIX = np.random.default_rng(11).integers(1, 1 << 63, _SHAPE_CHARS + 2, dtype=np.uint64) | np.uint64(1)
LENGTHS = np.array([2, 3, 4, 5, 7, 9, 13, 16, 17, 20, 30])
# Words that announce personal data or look-alikes of it.
CUES = "at dot phone tel tel: phone: call fax mobile email e-mail mail mail: email: ip host address card visa credit version page isbn order no token password".split()


def tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of code points: each token's start, end and shape, and whether a sequence ends after it."""
    small = np.minimum(points, 255).astype(np.uint8)
    kind = _CLASS[small]
    word = kind != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, np.uint64), np.empty(0, bool)
    same = np.zeros(len(kind), bool)
    same[1:] = kind[1:] == kind[:-1]
    fourth = np.zeros(len(kind), bool)
    fourth[4:] = same[4:] & same[3:-1] & same[2:-2] & same[1:-3]
    keep = word & np.where(kind == 1, ~fourth, ~same)
    place = np.cumsum(keep)
    before = np.zeros(len(start), np.int64)
    before[:] = np.where(start > 0, place[start - 1], 0)
    at = np.flatnonzero(keep)
    owner = np.repeat(np.arange(len(start)), np.diff(np.append(before, place[-1])))
    rank = np.minimum(place[at] - 1 - before[owner], _SHAPE_CHARS)
    value = (kind[at] + np.uint64(1)) * _MIX[rank]
    shape = np.add.reduceat(value, np.searchsorted(at, start))
    length = np.searchsorted(LENGTHS, end - start, "right").astype(np.uint64)
    shape = (shape ^ shape >> np.uint64(29)) * _MIX[-1] + length
    last = small[end - 1]
    gap = np.append(start[1:], len(points))
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    stop = (last == 46) | (last == 33) | (last == 63) | (lines[gap] > lines[end])
    short = np.flatnonzero(end - start <= 8)
    lowered = np.where((small >= 65) & (small <= 90), small + 32, small).astype(np.uint64)
    for n in sorted({len(c) for c in CUES}):
        of = short[end[short] - start[short] == n]
        if len(of):
            code = np.zeros(len(of), np.uint64)
            for j in range(n):
                code = code << np.uint64(8) | lowered[start[of] + j]
            known = np.isin(code, [int.from_bytes(c.encode(), "big") for c in CUES if len(c) == n])
            shape[of[known]] = code[known] * _MIX[0]
    return start, end, shape, stop


# The labelled table

def labelled_table(rows: int = 900, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Sentences of (token, label), made from a rule: personal data in common and veiled forms, and numbers that are none."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeionrstlhdu") for _ in range(r.randint(1, 11)))
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    octet = lambda: str(r.randint(0, 255))
    domain = lambda: r.choice(["mail", "post", "web"]) + number(r.randint(0, 1))
    tld = lambda: r.choice(["com", "org", "net", "de", "io"])

    def card() -> str:
        lead = r.choice("3456") + number(14)
        return next(lead + d for d in "0123456789" if luhn(lead + d))

    def private() -> tuple[str, list[str]]:
        c = card()
        quads = [c[i : i + 4] for i in range(0, 16, 4)]
        a, b, d = r.randint(200, 999), r.randint(200, 999), number(4)
        return r.choice(
            [
                ("email", [f"{word()}{number(2)}@{domain()}.example.{tld()}"]),
                ("email", [f"{word()}.{word()}@{domain()}.{tld()}"]),
                ("email", [word(), "at", domain(), "dot", tld()]),
                ("email", [f"{word()}{number(2)}", "(at)", domain(), "(dot)", tld()]),
                ("email", [f"{word()}[at]{domain()}[dot]{tld()}"]),
                ("ip", [".".join(octet() for _ in range(4))]),
                ("card", [c]),
                ("card", quads),
                ("card", ["-".join(quads)]),
                ("card", [".".join(quads)]),
                ("phone", ["+1", f"({a})", f"{b}-{d}"]),
                ("phone", [f"+1-{a}-{b}-{d}"]),
                ("phone", [f"+49{number(10)}"]),
                ("phone", [f"({a})", f"{b}-{d}"]),
                ("phone", [f"{a}-{b}-{d}"]),
                ("phone", [f"{a}.{b}.{d}"]),
            ]
        )

    def public() -> list[str]:
        return r.choice(
            [
                [f"20{number(2)}-0{r.randint(1, 9)}-1{number(1)}"],
                [f"{number(2)}:{number(2)}"],
                [f"{number(1)}.{number(1)}.{number(1)}"],
                ["version", f"{number(1)}.0"],
                [f"${number(2)}.{number(2)}"],
                ["page", number(2), "of", number(3)],
                [number(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 20]))],
                ["token", "=", f'"{hexed(40)}"'],
                [f"password={hexed(18)}"],
                ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))],
                ["isbn", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}"],
                [f"{number(3)}-{number(4)}"],
                ["BY-NC", "4.0."],
                [r.choice(["%%%***", "&$!*#", "###", "--", "|", "@", "!!!!", "#%&"])],
                [f"{hexed(8)}-{hexed(4)}-{hexed(4)}"],
                ["at", word()],
                ["dot", word()],
                [f"{word()}@{word()}"],
                [word()] * r.randint(4, 9),
                [word() + r.choice(["", ".", ","]) + r.choice("#$%&*") * 3 for _ in range(r.randint(3, 8))],
            ]
        )

    out = []
    for _ in range(rows):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 3)):
            row += [(r.choice([str.lower, str.lower, str.lower, str.capitalize])(word()) + r.choice(["", "", "", ","]), "O") for _ in range(r.randint(1, 5))]
            if r.random() < 0.5:
                for _ in range(r.choice([1, 1, 1, 2])):
                    kind, parts = private()
                    end = r.choice(["", "", "", ",", ";", "."])
                    parts = [*parts[:-1], parts[-1] + end]
                    row += [(p, f"{'I' if i else 'B'}-{kind}") for i, p in enumerate(parts)]
            else:
                row += [(p, "O") for p in public()]
        if r.random() < 0.7:
            row.append((word() + r.choice(".!?"), "O"))
        out.append(row)
    return out


# The field

class Field:
    """Weights of a linear chain: emissions by shape of the token, the one before and the one after, and transitions."""

    def __init__(self, shapes: np.ndarray, weights: np.ndarray, step: np.ndarray) -> None:
        self.shapes, self.weights, self.step = shapes, weights, step

    def ids(self, shape: np.ndarray) -> np.ndarray:
        """Row of the weights for each shape; 0 for shapes that were not seen in training."""
        at = np.minimum(np.searchsorted(self.shapes, shape), len(self.shapes) - 1)
        return np.where(self.shapes[at] == shape, at + 1, 0)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        none = len(self.shapes) + 1  # before the first token and after the last
        w = self.weights
        return w[0, ids] + w[1, np.concatenate(([none], ids[:-1]))] + w[2, np.concatenate((ids[1:], [none]))]

    def decode(self, shape: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The best label of each token, by Viterbi over all sequences at once, longest first."""
        n, k = len(shape), len(LABELS)
        if not n:
            return np.empty(0, np.int64)
        score = self.emissions(self.ids(shape))
        first = np.concatenate(([0], np.flatnonzero(stop[:-1]) + 1))
        last = np.append(first[1:], n)
        cuts = -(-(last - first) // SEQUENCE)
        inner = np.repeat(first, cuts) + SEQUENCE * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        begin = np.maximum(inner - OVERLAP, np.repeat(first, cuts))
        end = np.minimum(inner + SEQUENCE + OVERLAP, np.repeat(last, cuts))
        order = np.argsort(begin - end, kind="stable")
        inner, begin, length, until = inner[order], begin[order], (end - begin)[order], np.repeat(last, cuts)[order]
        place = np.cumsum(length) - length  # cuts overlap, so each has room of its own
        back = np.zeros((int(length.sum()), k), np.int8)
        best, live = score[begin].copy(), len(begin)
        best[:, 2::2] = -1e9  # no I- at a sequence's start
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))
            ways = best[:live, :, None] + self.step
            back[place[:live] + t] = ways.argmax(1)
            best[:live] = ways.max(1) + score[begin[:live] + t]
        label = np.zeros(n, np.int64)
        now = best.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            at = begin[:live] + t
            own = (at >= inner[:live]) & (at < np.minimum(inner[:live] + SEQUENCE, until[:live]))
            label[at[own]] = now[:live][own]
            if t:
                now[:live] = back[place[:live] + t, now[:live]]
        return label


FORBIDDEN = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])


def train(rows: list[list[tuple[str, str]]], rounds: int = 150, rate: float = 0.1, decay: float = 2e-5) -> Field:
    """Maximum likelihood by Adam; forward and backward sums run over all sentences at once."""
    text = "\n".join(" ".join(w for w, _ in row) for row in rows)
    _, _, shape, _ = tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    shapes, ids = np.unique(shape, return_inverse=True)
    k, none, width, n = len(LABELS), len(shapes) + 1, max(map(len, rows)), len(rows)
    lengths = np.array([len(r) for r in rows])
    mask = np.arange(width) < lengths[:, None]
    seen = np.full((n, width), none)
    seen[mask] = ids + 1
    gold = np.zeros((n, width), np.int64)
    gold[mask] = [LABELS.index(x) for row in rows for _, x in row]
    sides = (seen, np.hstack([np.full((n, 1), none), seen[:, :-1]]), np.hstack([seen[:, 1:], np.full((n, 1), none)]))
    parts = [np.zeros((3, none + 1, k), np.float32), np.where(FORBIDDEN, -1e4, 0.0).astype(np.float32)]
    parts[0][0, :, 0] = 0.5
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    rng = np.random.default_rng(3)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for turn in range(1, rounds + 1):
        w, step = parts
        hidden = rng.random(seen.shape) < 0.05  # some shapes are hidden, so that unseen ones get weights
        own = [np.where(hidden & (s != none), 0, s) if i == 0 else s for i, s in enumerate(sides)]
        e = sum(w[i, s] for i, s in enumerate(own))
        e[:, 0, 2::2] = -1e4
        alpha, beta = np.zeros((2, n, width, k), np.float32)
        alpha[:, 0] = e[:, 0]
        for t in range(1, width):
            new = total(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = total(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = total(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        p[np.arange(n)[:, None], np.arange(width), gold] -= mask
        grads = [np.zeros_like(w), np.zeros_like(step)]
        for i, s in enumerate(own):
            np.add.at(grads[0][i], s[mask], p[mask])
        for t in range(1, width):
            on = mask[:, t]
            pair = np.exp(alpha[on, t - 1][:, :, None] + step + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
            grads[1] += pair.sum(0)
            np.add.at(grads[1], (gold[on, t - 1], gold[on, t]), -1.0)
        for i, (g, m) in enumerate(zip(grads, moments, strict=True)):
            g = g / n + decay * np.where(np.abs(parts[i]) < 1e3, parts[i], 0)
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            parts[i] = parts[i] - rate * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.999**turn)) + 1e-8)
        parts[1] = np.where(FORBIDDEN, np.float32(-1e4), parts[1])
    return Field(shapes, parts[0], parts[1])


@cache
def trained() -> Field:
    """The field of the labelled table, fitted once in a process."""
    return train(labelled_table())


# Words for @ and . stand in brackets or between white space. Each part is taken whole and never given back, so time is linear.
VEILED = re.compile(
    r"[A-Za-z0-9._%+-]++(?>\s*+[\[(]\s*+(?:at|AT|@)\s*+[\])]?+\s*+|\s++(?:at|AT)\s++|\s*+@\s*+)[A-Za-z0-9-]++"
    r"(?>(?>\s*+[\[(]\s*+(?:dot|DOT|\.)\s*+[\])]?+\s*+|\s++(?:dot|DOT)\s++|\s*+\.\s*+)[A-Za-z0-9-]++)++"
)


def holds(kind: int, s: str) -> bool:
    """Whether a string that the field marked can be of its kind."""
    digits = only_digits(s)
    if kind == 0:
        return VEILED.fullmatch(s) is not None and ("@" in s or any(c in s for c in "[(") or any(c.isdigit() for c in s))
    if kind == 1:
        return IP.fullmatch(s) is not None and is_ip(s)
    if kind == 2:
        return is_card(s) and re.fullmatch(r"[0-9](?:[\x20.-]?[0-9])+", s) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", s) is not None and any(c in s for c in "(-.")


def windows(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    while len(text) - at > WINDOW:
        part = text[at : at + WINDOW]
        cut = max(part.rfind(" ", WINDOW * 9 // 10), part.rfind("\n", WINDOW * 9 // 10))
        cut = cut + 1 if cut >= 0 else WINDOW
        yield at, part[:cut]
        at += cut
    yield at, text[at:]


def added_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """What the field marks in each text, before it is held against the patterns' spans."""
    found: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int, str]] = []  # text, its first and last own place, where the part begins, the part

    def work() -> None:
        joined = "\n".join(h[-1] for h in held)
        start, end, shape, stop = tokens(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        label = field.decode(shape, stop)
        marked = np.flatnonzero(label)
        if not len(marked):
            return
        first = marked[label[marked] % 2 == 1]
        ends = [j for j in np.append(first[1:], len(label))]
        offsets = np.cumsum([0, *[len(h[-1]) + 1 for h in held]])
        for i, until in zip(first.tolist(), ends, strict=True):
            kind, last = (int(label[i]) - 1) // 2, i
            while last + 1 < until and label[last + 1] == 2 * kind + 2:
                last += 1
            a, b = int(start[i]), int(end[last])
            raw = joined[a:b]
            body_ = raw.rstrip(".,;:!?\"'")
            lead = len(body_) - len(body_.lstrip("\"'"))
            body_ = body_[lead:]
            if body_ and "\n" not in body_ and holds(kind, body_):
                part = int(np.searchsorted(offsets, a, "right")) - 1
                row, low, high, at, _ = held[part]
                here = at + a + lead - int(offsets[part])
                if low <= here < high:
                    found[row].append((kind, here, here + len(body_)))

    size = 0
    for i, text in enumerate(texts):
        for at, part in windows(text):
            low = max(0, at - MARGIN)
            held.append((i, at, at + len(part), low, text[low : at + len(part) + MARGIN]))
            size += len(held[-1][-1]) + 1
            if size >= WINDOW:
                work()
                held, size = [], 0
    if held:
        work()
    return found


def all_spans(base: list[Span], extra: list[Span]) -> list[Span]:
    """The patterns' spans and those of the others that overlap none of them or of each other."""
    taken: list[tuple[int, int]] = []  # what the patterns cover, in order and apart
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    starts, out, last = [s for s, _ in taken], list(base), 0
    for kind, s, e in sorted(extra, key=lambda x: (x[1], -x[2])):
        before = bisect_left(starts, e)
        if s >= last and (not before or taken[before - 1][1] <= s):
            out.append((kind, s, e))
            last = e
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame, keep: list[str], text: str = "text", field: Field | None = None) -> DataFrame:
    """The columns in keep; n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans; spans: all of them."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field or trained())
    made = [*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() for v in batch.column(0)]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, shared.value)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([joined(all_spans(b, m)) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts, digests, spans], schema=pa.schema([*list(batch.schema)[1:], *made]))

    rows = docs.select(body(text).alias("__body"), *[F.col(c) for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, fields + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
