"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes long. A symbol's probability comes from the longest context that
the trie knows: its count less a half, over the total (escape method D); otherwise the escape, half the kinds over the total, and
then the context one byte shorter, without the symbols that the longer one had; in the end 1 over the symbols not yet
excluded, of 256. Symbols are the bytes of the text with A-Z lower-cased, then one end; a text's contexts begin with start marks.

Trie is the plain form, adaptive (it learns each symbol after coding it) or pretrained. At scale the pretrained form is
used: counts cover all training rows, are summed by Spark and all stay in use. A symbol's value depends on itself and the ORDER
bytes before it alone, its code. The values of the NODES most frequent codes are broadcast, and numpy looks them up for a million
positions at a time; all other codes of a text are resolved by joins with the whole trie, an order at a time. So the score is the
whole model's at every size, and NODES is a matter of speed. The word model beside it takes the TOP_WORDS most frequent words by
broadcast and all others by a join, so every count is exact.

Null text counts as empty and is one end. A null id counts as the empty string in the fold's hash. Repeated rows each
give a row. Without training rows all counts are zero. Long texts are coded a window at a time.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import body, doc_hash, small_batches, table
from seqweft.session import stored

ORDER, NODES, TOP_WORDS, FOLDS, HELD_OUT = 5, 1 << 20, 1 << 16, 7, 2
START, END, SYMBOLS = 0xFE, 0xFF, 256  # neither byte occurs in UTF-8
WINDOW, PENDING, FLUSH = 1 << 20, 1 << 22, 1 << 20


class Trie:
    """PPM in its plain form: counts by context, from the empty one up to `order` symbols."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.nodes = order, {}

    def _coded(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        x = bytes([START] * self.order) + raw + bytes([END])
        for i in range(self.order, len(x)):
            yield x[i - self.order : i], x[i]

    def learn(self, context: bytes, symbol: int) -> None:
        for j in range(self.order + 1):
            node = self.nodes.setdefault(context[self.order - j :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def train(self, raw: bytes) -> None:
        for context, symbol in self._coded(raw):
            self.learn(context, symbol)

    def log10(self, context: bytes, symbol: int) -> float:
        total, excluded = 0.0, set()
        for j in range(self.order, -1, -1):
            fresh = {s: n for s, n in self.nodes.get(context[self.order - j :], {}).items() if s not in excluded}
            if not fresh:
                continue
            whole = sum(fresh.values())
            if symbol in fresh:
                return total + math.log10((fresh[symbol] - 0.5) / whole)
            total += math.log10(len(fresh) / 2 / whole)
            excluded |= fresh.keys()
        return total - math.log10(SYMBOLS - len(excluded))

    def score(self, raw: bytes, adaptive: bool = False) -> float:
        """log10 of the text's probability; adaptive: each symbol is learned after it is coded."""
        total = 0.0
        for context, symbol in self._coded(raw):
            total += self.log10(context, symbol)
            if adaptive:
                self.learn(context, symbol)
        return total


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after its start marks, and where each text begins."""
    start = bytes([START] * order)
    x = np.frombuffer(b"".join([part for t in texts for part in (start, t, bytes([END]))]), np.uint8)
    return x, np.cumsum([0, *[order + len(t) + 1 for t in texts[:-1]]]) if texts else np.empty(0, np.int64)


def _codes(x: np.ndarray, order: int) -> np.ndarray:
    """For each position from `order` on, the symbol and the `order` before it, packed."""
    n = len(x) - order
    code = np.zeros(max(n, 0), np.int64)
    for j in range(order + 1):
        code <<= 8
        code |= x[j : j + n]
    return code


class Index:
    """Positions of sorted keys by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        size = 1 << max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        at, todo, slot = np.full(size, -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[at[slot[todo]] < 0]
            at[slot[free]] = free
            todo = todo[at[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.at, self.keys = at, np.where(at >= 0, keys[at], -1) if len(keys) else np.full(size, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.keys[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


class Tables:
    """A pretrained trie as arrays, for one machine; counts: for each order, sorted codes of context and symbol, and how often."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(counts) - 1
        self.symbols = [Index(codes) for codes, _ in counts]
        self.log_count = [np.log10(n - 0.5) for _, n in counts]
        self.contexts, self.own, self.own_escape, self.low, self.low_escape = [], [], [], [], []
        for j, (codes, n) in enumerate(counts):
            context, first = np.unique(codes >> 8, return_index=True)
            kinds = np.diff(np.append(first, len(codes)))
            total = np.add.reduceat(n, first) if len(first) else np.empty(0)
            self.contexts.append(Index(context))
            self.own.append(np.log10(total))
            self.own_escape.append(np.log10(kinds / 2) - self.own[-1])
            if j:  # one order lower, without this context's symbols
                shorter, lower_n = (1 << 8 * j) - 1, counts[j - 1][1]
                below = np.add.reduceat(lower_n[self.symbols[j - 1].find(codes & shorter)], first) if len(first) else np.empty(0)
                parent = self.contexts[j - 1].find(context & (shorter >> 8))
                rest_kinds, rest = self.kinds[parent] - kinds, self.total[parent] - below
                fresh = rest_kinds > 0
                self.low.append(np.where(fresh, np.log10(np.maximum(rest, 1)), 0.0))
                self.low_escape.append(np.where(fresh, np.log10(np.maximum(rest_kinds, 1) / 2) - self.low[-1], 0.0))
            else:
                self.low.append(np.zeros(len(first)))
                self.low_escape.append(np.zeros(len(first)))
            self.kinds, self.total = kinds, total
            if j == 0:
                self.last = -math.log10(SYMBOLS - len(codes)) if len(codes) < SYMBOLS else 0.0
        self.top = self.log_count[-1] - self.own[-1][self.contexts[-1].find(counts[-1][0] >> 8)] if len(counts[-1][0]) else np.empty(0)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last symbol after the symbols before it."""
        got = self.symbols[self.order].find(code)
        out = np.zeros(len(code))
        out[got >= 0] = self.top[got[got >= 0]]
        todo = np.flatnonzero(got < 0)
        upper = np.full(len(todo), -1, np.int64)
        for j in range(self.order, -1, -1):
            c = code[todo] & ((1 << 8 * (j + 1)) - 1)
            here = self.contexts[j].find(c >> 8)
            symbol = self.symbols[j].find(c) if j < self.order else np.full(len(todo), -1)
            hit, known, first = symbol >= 0, here >= 0, upper < 0
            above = np.maximum(upper, 0)
            size, escape = self._of(self.own[j], here), self._of(self.own_escape[j], here)
            if j < self.order:
                size = np.where(first, size, self._of(self.low[j + 1], above))
                escape = np.where(first, escape, self._of(self.low_escape[j + 1], above))
            out[todo[hit]] += self.log_count[j][symbol[hit]] - size[hit]
            out[todo[~hit & known]] += escape[~hit & known]
            todo, upper = todo[~hit], here[~hit]
        out[todo] += self.last
        return out

    @staticmethod
    def _of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return values[np.maximum(at, 0)] if len(values) else np.zeros(len(at))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        x, starts = _joined(texts, self.order)
        for at in range(self.order, len(x), WINDOW):
            part = x[at - self.order : at + WINDOW]
            value = self.log10(_codes(part, self.order))
            value[part[self.order :] == START] = 0.0
            inside = starts[(starts > at) & (starts < at + len(value))]
            first = np.searchsorted(starts, at, "right") - 1
            sums = np.add.reduceat(value, np.concatenate(([0], inside - at)))
            out[first : first + len(sums)] += sums
        return out


class Frequent:
    """Values of the most frequent codes. The others of a text are given out, to be looked up elsewhere."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, order: int) -> None:
        self.index, self.values, self.order = Index(codes), np.append(values, 0.0), order

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of what is known for each text; and sorted by text: text, code and how often of what is not."""
        out, rest, width = np.zeros(len(texts)), [], 8 * (self.order + 1)
        x, starts = _joined(texts, self.order)
        for at in range(self.order, len(x), WINDOW):
            part = x[at - self.order : at + WINDOW]
            code = _codes(part, self.order)
            got = self.index.find(code)
            inside = starts[(starts > at) & (starts < at + len(code))]
            first = np.searchsorted(starts, at, "right") - 1
            sums = np.add.reduceat(self.values[got], np.concatenate(([0], inside - at)))
            out[first : first + len(sums)] += sums
            missed = np.flatnonzero((got < 0) & (part[self.order :] != START))
            row = np.searchsorted(starts, missed + at, "right") - 1
            rest.append(np.unique(row << width | code[missed], return_counts=True))
        packed, times = _merged(rest) if rest else (np.empty(0, np.int64), np.empty(0, np.int64))
        return out, packed >> width, packed & ((1 << width) - 1), times


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


COUNTS = pa.schema([("code", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts of codes (highest order) and of words of what one task reads, given out whenever FLUSH kinds are held.

    The empty word stands for the end of a text.
    """

    def rows(codes, words, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], schema=COUNTS)

    def out(held, words) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(held[0]), 1 << 17):
            codes = held[0][at : at + (1 << 17)]
            yield rows(codes, [None] * len(codes), held[1][at : at + (1 << 17)])
        items = list(words.items())
        for at in range(0, len(items), 1 << 17):
            some = items[at : at + (1 << 17)]
            yield rows([None] * len(some), [w for w, _ in some], [n for _, n in some])

    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    held, waiting, symbols, words = none, [], 0, Counter()

    for batch in batches:
        texts = [lowered(v.as_py()) for v in batch.column(0)]
        for t in texts:
            words.update(t.split())
        words[b""] += len(texts)
        small = [t for t in texts if len(t) < PENDING]
        x, _ = _joined(small, order)
        for at in range(order, len(x), PENDING):
            code = _codes(x[at - order : at + PENDING], order)
            waiting.append(code[code & 0xFF != START])
            symbols += len(waiting[-1])
        if symbols >= PENDING:
            held = _merged([held, np.unique(np.concatenate(waiting), return_counts=True)])
            waiting, symbols = [], 0
        for t in texts:
            if len(t) >= PENDING:
                x, _ = _joined([t], order)
                for at in range(order, len(x), PENDING):
                    held = _merged([held, np.unique(_codes(x[at - order : at + PENDING], order), return_counts=True)])
        if len(held[0]) + len(words) > FLUSH:
            yield from out(held, words)
            held, words = none, Counter()
    if waiting:
        held = _merged([held, np.unique(np.concatenate(waiting), return_counts=True)])
    yield from out(held, words)


def gather(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """(code, word, n): counts over all rows of docs; in each row either code or word is null. A table in the shared folder."""
    small_batches(docs.sparkSession)
    parts = docs.select(body(text).alias("text")).mapInArrow(lambda it: _count(it, order), "code long, word binary, n long")
    return stored(parts.groupBy("code", "word").agg(F.sum("n").alias("n")), "counts")


def _at_least(df: DataFrame, most: int, floor: int = 1) -> int:
    """floor if at most `most` rows of df have it or more, else a higher n for which that holds."""
    steps = df.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    held, above = 0, 1 << 62
    for r in steps:
        held += r["rows"]
        if held > most:
            return max(floor, above)
        above = r["least"]
    return floor


def whole_trie(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(level, code, n): the counts of every context up to `order` symbols with its symbol. Tables in the shared folder.

    Each level is summed up from the one above, which has one row for each of its codes: fewer at each step.
    """
    level, out = counts.where("code is not null").select("code", "n"), None
    for n in range(order, -1, -1):
        if n < order:
            level = stored(level.groupBy(F.expr(f"code & {(1 << 8 * (n + 1)) - 1}L").alias("code")).agg(F.sum("n").alias("n")), "trie")
        named = level.select(F.lit(n).alias("level"), "code", "n")
        out = named if out is None else out.unionByName(named)
    return out


def build(counts: DataFrame, order: int = ORDER, nodes: int = NODES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For Tables, a trie on the driver: for each order at most `nodes` sorted codes, the most frequent, and their counts. score does not use it."""
    trie = whole_trie(counts, order)
    least, found = 1, []
    for level in range(order + 1):
        own = trie.where(F.col("level") == level)
        least = _at_least(own, nodes, least)
        got = own.where(F.col("n") >= least).select("code", "n").toArrow()
        code, n = (got.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
        at = np.argsort(code)
        found.append((code[at], n[at]))
    return found


def contexts(trie: DataFrame) -> DataFrame:
    """(level, context, total, kinds, rest, rest_kinds): of each context, and of the one a byte shorter without its symbols."""
    shorter = trie.select((F.col("level") + 1).alias("level"), F.col("code").alias("suffix"), F.col("n").alias("below"))
    entries = trie.withColumn("suffix", F.expr("code & (shiftleft(1L, 8 * level) - 1)")).join(shorter, ["level", "suffix"], "left")
    own = stored(entries.groupBy("level", F.expr("shiftright(code, 8)").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("below")), "contexts")
    parent = own.select((F.col("level") + 1).alias("level"), F.col("context").alias("suffix"), F.col("total").alias("all"), F.col("kinds").alias("all_kinds"))
    both = own.withColumn("suffix", F.expr("if(level = 0, 0L, context & (shiftleft(1L, 8 * (level - 1)) - 1))")).join(parent, ["level", "suffix"], "left")
    return stored(both.select("level", "context", "total", "kinds", (F.col("all") - F.col("below")).alias("rest"), (F.col("all_kinds") - F.col("kinds")).alias("rest_kinds")), "contexts")


def values(codes: DataFrame, trie: DataFrame, known: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, value): log10 of the probability of each distinct code's last symbol after those before it, by the whole trie.

    Down the orders, each code that an order lacks goes on as its suffix; suffixes are distinct again, so no key is hot. Up again,
    a code has n, its count; free, its value if no longer context is known; and after, its value if its own context excludes.
    """
    found, asked = [], codes
    for level in range(order, -1, -1):
        own = trie.where(F.col("level") == level).select("code", "n")
        near = known.where(F.col("level") == level).drop("level")
        here = asked.join(own, "code", "left").withColumn("context", F.expr("shiftright(code, 8)")).join(near, "context", "left").drop("context")
        found.append(stored(here, "found"))
        asked = found[-1].where("n is null").select(F.expr(f"code & {(1 << 8 * level) - 1}L").alias("code")).distinct()
    kinds = trie.where("level = 0").count()
    last = F.lit(-math.log10(SYMBOLS - kinds) if kinds < SYMBOLS else 0.0)
    out = None
    for level, here in enumerate(reversed(found)):
        if out is None:
            here = here.withColumns({"lower_n": F.lit(None).cast("long"), "lower_free": last, "lower_after": last})
        else:
            lower = out.select(F.col("code").alias("suffix"), *[F.col(c).alias(f"lower_{c}") for c in ("n", "free", "after")])
            here = here.withColumn("suffix", F.expr(f"if(n is null, code & {(1 << 8 * level) - 1}L, null)")).join(lower, "suffix", "left")
        # Without a symbol that the longer context lacks, the order is passed over.
        escape = F.expr("if(rest_kinds > 0, log10(rest_kinds / 2) - log10(rest), 0D)") if level else F.lit(0.0)
        after = F.when(F.col("lower_n").isNotNull(), F.log10(F.col("lower_n") - 0.5) - F.log10("rest")).otherwise(escape + F.col("lower_after"))
        here = here.withColumn("after", after)
        hit, through = F.log10(F.col("n") - 0.5) - F.log10("total"), F.expr("log10(kinds / 2) - log10(total)") + F.col("after")
        free = F.when(F.col("n").isNotNull(), hit).when(F.col("total").isNotNull(), through).otherwise(F.col("lower_free"))
        out = here.select("code", "n", free.alias("free"), "after")
    return out.select("code", F.col("free").alias("value"))


_BUILT: dict = {}


def _frequent(key: str, codes: np.ndarray, found: np.ndarray, order: int) -> Frequent:
    """The tables of one broadcast, made once in each worker process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Frequent(codes, found, order)
    return _BUILT[key]


def score(docs: DataFrame, training: DataFrame, keep: list[str], order: int = ORDER, text: str = "text") -> DataFrame:
    """The columns in keep, then n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    spark = docs.sparkSession
    counts = gather(training, order, text)
    trie = whole_trie(counts, order)
    known = contexts(trie)
    own = trie.where(F.col("level") == order)
    often = own.where(F.col("n") >= _at_least(own, NODES)).withColumn("context", F.expr("shiftright(code, 8)"))
    often = often.join(known.where(F.col("level") == order).select("context", "total"), "context").select("code", (F.log10(F.col("n") - 0.5) - F.log10("total")).alias("value")).toArrow()
    frequent = often.column("code").to_numpy().astype(np.int64), often.column("value").to_numpy().astype(np.float64)
    words = counts.where("word is not null").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _at_least(words, TOP_WORDS)
    top = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= least).collect()}
    size = math.log10(total + kinds + 1)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, frequent, top))
    pairs = lambda name, kind: pa.list_(pa.struct([(name, kind), ("times", pa.int64())]))
    made = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pairs("word", pa.binary())), ("codes", pairs("code", pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, (codes, found), known_words = shared.value
        model = _frequent(key, codes, found, order)
        logs = {w: math.log10(n + 1) for w, n in known_words.items()}
        for batch in batches:
            tokens, sure, base, rest, parts = [], [], [], [], []
            waiting: list[bytes] = []

            def flush() -> None:
                at = sum(len(p[0]) for p in parts)
                sums, row, code, times = model.score(waiting)
                parts.append((sums, row + at, code, times))
                waiting.clear()

            for v in batch.column(0):
                raw = lowered(v.as_py())
                seen = Counter(raw.split())
                seen[b""] += 1
                n, hits, logp, others = 0, 0, 0.0, []
                for w, times in seen.items():
                    n += times
                    if w in logs:
                        hits += times
                        logp += times * (logs[w] - size)
                    else:
                        others.append({"word": w, "times": times})
                tokens.append(n)
                sure.append(hits)
                base.append(logp)
                rest.append(others)
                waiting.append(raw)
                if sum(map(len, waiting)) >= PENDING:
                    flush()
            if waiting or not parts:
                flush()
            sums, row, code, times = (np.concatenate(p) for p in zip(*parts, strict=True))
            offsets = np.searchsorted(row, np.arange(len(sums) + 1))
            seldom = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(code, pa.int64()), pa.array(times, pa.int64())], names=["code", "times"]))
            made_columns = [pa.array(tokens, pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()), pa.array(sums), pa.array(rest, made[-2][1]), seldom]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made_columns], schema=pa.schema([*list(batch.schema)[1:], *made]))

    rows = docs.select(body(text).alias("__body"), *[F.col(c) for c in keep], F.monotonically_increasing_id().alias("__row"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    scored = stored(rows.mapInArrow(run, f"{fields}n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,times:long>>, codes array<struct<code:long,times:long>>"), "scored")
    seldom = scored.select("__row", F.inline("rest")).join(words.where(F.col("n") < least), "word", "left")
    logp = F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(size))
    none = F.lit(0.0)
    by_word = seldom.select("__row", logp.alias("__base"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("__known"), none.alias("__score"))
    codes = scored.select("__row", F.inline("codes"))
    by_code = codes.join(values(codes.select("code").distinct(), trie, known, order), "code").select("__row", none.alias("__base"), F.lit(0).cast("long").alias("__known"), (F.col("times") * F.col("value")).alias("__score"))
    more = by_word.unionByName(by_code).groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("__base", "__known", "__score")])
    return scored.join(more, "__row", "left").select(
        *[F.col(c) for c in keep],
        "n_tokens",
        (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("__base", none)).alias("base_score"),
        (F.col("score") + F.coalesce("__score", none)).alias("score"),
    )


def adaptive(docs: DataFrame, keep: list[str], order: int = ORDER, text: str = "text") -> DataFrame:
    """The columns in keep and score: each text coded by a trie that starts empty and learns as it goes (the plain form)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Trie(order).score(lowered(v.as_py()), adaptive=True) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], schema=pa.schema([*list(batch.schema)[1:], ("score", pa.float64())]))

    rows = docs.select(body(text).alias("__body"), *[F.col(c) for c in keep])
    return rows.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:]) + "score double")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = doc_hash() % FOLDS == HELD_OUT
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score(rows, docs.where(~held_out), ["doc_id", "held_out"])
