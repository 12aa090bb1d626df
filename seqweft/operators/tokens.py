"""Residue policies and tokenizations of sequences. Survey IDs in brackets; all of these are specified, not coded, there.

Token counts are closed forms of the length. Frequencies of 3-mers explode; those of 5-mers too, aggregated before the
shuffle. A byte-pair vocabulary is trained on a bounded, documented sample of distinct sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.functions.text import CANONICAL
from seqweft.operators.profile import fraction

STRATEGIES = {"single": 1, "3-mer": 3, "5-mer": 5}
POLICIES = ("keep", "replace_with_unk", "normalize", "drop")
MAX_TOKENS, UNK = 512, "<unk>"
NORMALIZE = {"B": "D", "Z": "E", "J": "L", "U": "C", "O": "K"}  # decided here, a parameter
NOTES = {
    "single": ("one residue a token", "smallest vocabulary, longest inputs"),
    "3-mer": ("overlapping triples", "dense vocabulary, length kept"),
    "5-mer": ("overlapping fives", "sparse vocabulary"),
    "bpe": ("merged by frequency", "shortest inputs, tied to its training sample"),
}


def n_tokens(length: Column, k: int) -> Column:
    """Overlapping k-mers without padding [TOK-01..03]."""
    return F.greatest(length - (k - 1), F.lit(0)).cast("bigint")


def kmers(seq: Column, k: int) -> Column:
    """The k-mers in order; none for shorter sequences. A pattern that looks ahead reads each place once; substring() would
    count from the start each time, which is the square of the length."""
    if k == 1:
        return F.array_remove(F.split(seq, ""), "")
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def with_unk(tokens: Column, residues: str | None = None) -> Column:
    """Each token with one of the residues, or any outside the canonical twenty, becomes one unknown token [RES-02]."""
    odd = (lambda t: F.translate(t, CANONICAL, "") != "") if residues is None else (lambda t: F.translate(t, residues, "") != t)
    return F.transform(tokens, lambda t: F.when(odd(t), F.lit(UNK)).otherwise(t))


def apply_policy(corpus: DataFrame, policy: str, mapping: dict[str, str] = NORMALIZE, residues: str | None = None) -> DataFrame:
    """keep, normalize and drop change the sequence; replace_with_unk works on tokens [RES-01..04, FLT-15].

    residues: those that the policy is for; without them all outside the canonical twenty.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy: one of {', '.join(POLICIES)}")
    seq = F.col("sequence")
    if policy == "normalize":
        used = {a: b for a, b in mapping.items() if residues is None or a in residues}
        return corpus.withColumn("sequence", F.translate(seq, "".join(used), "".join(used.values()))) if used else corpus
    if policy == "drop":
        return corpus.where(F.translate(seq, CANONICAL, "") == "") if residues is None else corpus.where(F.translate(seq, residues, "") == seq)
    return corpus


def token_frequency(corpus: DataFrame, strategy: str, policy: str = "keep", unknown: str = "") -> DataFrame:
    """token, n [AG-22, TOK-05]; unknown: residues whose tokens are unknown, whatever the policy."""
    k = STRATEGIES[strategy]
    made = kmers(F.col("sequence"), k)
    made = with_unk(made) if policy == "replace_with_unk" else with_unk(made, unknown) if unknown else made
    rows = apply_policy(corpus, policy).select(F.explode(made).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def strategy_summary(corpus: DataFrame, strategy: str, most: int = MAX_TOKENS, scope: str = "all", rare: int = 1, policy: str = "keep", unknown: str = "") -> DataFrame:
    """vocabulary_size, median_tokenized_length, fraction_exceeding_max_length, coverage of 20^k, rare tokens [AG-22..25, TOK-05..07].

    By policy and unknown as in token_frequency() [RES-02, RES-06].
    """
    k = STRATEGIES[strategy]
    freq = token_frequency(corpus, strategy, policy, unknown)
    corpus = apply_policy(corpus, policy)
    canonical = F.regexp_like("token", F.lit(f"^[{CANONICAL}]+$"))
    vocab = freq.agg(F.count("*").alias("vocabulary_size"), F.count_if(canonical).alias("canonical"), F.count_if(F.col("n") <= rare).alias("rare_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    hist = corpus.groupBy(n_tokens(F.length("sequence"), k).alias("t")).agg(F.count("*").alias("n"))
    lengths = hist.agg(F.percentile("t", F.lit(0.5), F.col("n")).cast("double").alias("median_tokenized_length"), fraction(F.sum(F.when(F.col("t") > most, F.col("n")).otherwise(0)), F.sum("n")).alias("fraction_exceeding_max_length"))
    one = F.lit(1).alias("__k")
    both = vocab.select("*", one).join(lengths.select("*", one), "__k")
    readable, ready = NOTES[strategy]
    return both.select(
        F.lit(strategy).alias("strategy_name"), F.lit("fixed").alias("variant_label"), F.lit(scope).alias("analysis_scope"), "vocabulary_size", "n_tokens", "median_tokenized_length", "fraction_exceeding_max_length",
        (F.col("canonical") / F.lit(float(20**k))).alias("coverage"), "rare_tokens", F.lit(readable).alias("interpretability_notes"), F.lit(ready).alias("downstream_readiness_notes"),
    )


def exceedance(corpus: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """For each strategy how many sequences have more than `most` tokens, and the windows they need [AG-24, CHN-01]."""
    n = {s: n_tokens(F.length("sequence"), k) for s, k in STRATEGIES.items()}
    sums = corpus.agg(F.count("*").alias("rows"), *[x for i, c in enumerate(n.values()) for x in (F.count_if(c > most).alias(f"e{i}"), F.coalesce(F.sum(F.ceil(c / most)), F.lit(0)).alias(f"w{i}"))])
    rows = F.array(*[F.struct(F.lit(s).alias("strategy_name"), F.col(f"e{i}").alias("n_exceeding"), fraction(F.col(f"e{i}"), F.col("rows")).alias("fraction_exceeding"), F.col(f"w{i}").cast("bigint").alias("n_windows")) for i, s in enumerate(n)])
    return sums.select(F.inline(rows))


def tokenized_lengths(corpus: DataFrame) -> DataFrame:
    """strategy_name, tokenized_length, count: what a histogram of each strategy shows [AG-23, SNK-21]; lengths are counted once."""
    hist = corpus.groupBy(F.length("sequence").alias("l")).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(s).alias("strategy_name"), n_tokens(F.col("l"), k).alias("tokenized_length")) for s, k in STRATEGIES.items()])
    return hist.select("n", F.inline(each)).groupBy("strategy_name", "tokenized_length").agg(F.sum("n").alias("count"))


def policy_sensitivity(corpus: DataFrame, primary: str = "keep", most: int = MAX_TOKENS, mapping: dict[str, str] = NORMALIZE) -> DataFrame:
    """For each policy: sequences affected and kept, residues kept, ambiguous residues left, share over `most` [RES-05, AG-28, VAL-08].

    One pass: the policies are columns of one aggregate, not a join or four scans.
    """
    if primary not in POLICIES:
        raise ValueError(f"primary: one of {', '.join(POLICIES)}")
    length = F.length("sequence").cast("bigint")
    odd = F.length(F.translate("sequence", CANONICAL, "")).cast("bigint")
    mapped = F.length(F.translate("sequence", CANONICAL + "".join(mapping), "")).cast("bigint")
    s = corpus.select(length.alias("l"), odd.alias("o"), mapped.alias("m")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.coalesce(F.sum("o"), F.lit(0)).alias("o"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count_if(F.col("o") > 0).alias("hit"), F.count_if(F.col("m") < F.col("o")).alias("changed"),
        F.coalesce(F.sum(F.when(F.col("o") == 0, F.col("l"))), F.lit(0)).alias("clean"), F.count_if(F.col("l") > most).alias("long"), F.count_if((F.col("l") > most) & (F.col("o") == 0)).alias("long_clean"),
    )
    c, none = F.col, F.lit(0).cast("bigint")
    row = lambda p, affected, kept, residues, left, long: F.struct(F.lit(p).alias("policy_name"), F.lit(p == primary).alias("is_primary_policy"), affected.alias("affected_sequence_count"), kept.alias("kept_sequence_count"), residues.alias("residue_count"), left.alias("ambiguous_left"), fraction(long, kept).alias("fraction_exceeding"))
    rows = [row("keep", none, c("n"), c("l"), c("o"), c("long")), row("replace_with_unk", c("hit"), c("n"), c("l"), none, c("long")), row("normalize", c("changed"), c("n"), c("l"), c("m"), c("long")), row("drop", c("hit"), c("n") - c("hit"), c("clean"), none, c("long_clean"))]
    return s.select(F.inline(F.array(*rows)))


def rare_residues(frequency: DataFrame, below: float = 1e-4) -> DataFrame:
    """Residues outside the canonical twenty that are seldom [RES-06]."""
    return frequency.where(~F.col("canonical") & (F.col("fraction") < below))


SAMPLE, GRID = 2000, (1000, 4000, 8000)


def bpe_sample(corpus: DataFrame, rows: int = SAMPLE) -> list[str]:
    """The distinct sequences with the smallest hashes: bounded, and the same on every run."""
    hashed = F.xxhash64("sequence")
    least = corpus.where("sequence is not null").select(hashed.alias("h")).distinct().orderBy("h").limit(rows)  # hashes are shuffled, not sequences
    few = corpus.select("sequence", hashed.alias("h")).join(F.broadcast(least), "h", "left_semi").select("sequence").distinct()
    return [r[0] for r in few.orderBy(hashed, "sequence").limit(rows).collect()]


def train_bpe(sample: list[str], size: int) -> str:
    """A byte-pair vocabulary of at most `size` entries as JSON [TOK-04]."""
    from tokenizers import Tokenizer, models, trainers

    model = Tokenizer(models.BPE(unk_token=UNK))
    model.train_from_iterator(sample, trainers.BpeTrainer(vocab_size=size, special_tokens=[UNK], show_progress=False))
    return model.to_str()


def corpus_informed_size(corpus: DataFrame, most: int = 32_000) -> int:
    """The next power of two of the number of distinct 3-mers, capped."""
    n = token_frequency(corpus, "3-mer").count()
    return min(most, 1 << max(0, (n - 1).bit_length()))


def encode_bpe(corpus: DataFrame, model: str) -> DataFrame:
    """assembly_id, sequence_id, tokens"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(model)
        for batch in batches:
            found = [coder.encode(v.as_py() or "").tokens for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["assembly_id", "sequence_id", "tokens"])

    return corpus.select("assembly_id", "sequence_id", "sequence").mapInArrow(run, "assembly_id string, sequence_id string, tokens array<string>")


def bpe_summary(corpus: DataFrame, sizes: tuple[int, ...] = GRID, informed: bool = True, most: int = MAX_TOKENS, sample: int = SAMPLE) -> DataFrame:
    """A row for each vocabulary of the fixed grid, and for the corpus-informed size, told apart by variant_label [TOK-04, VAL-09]."""
    texts = bpe_sample(corpus, sample)
    wanted = [(f"fixed_grid:{s}", s) for s in sizes] + ([(f"corpus_informed:{(n := corpus_informed_size(corpus))}", n)] if informed else [])
    out = None
    for label, size in wanted:
        tokens = encode_bpe(corpus, train_bpe(texts, size)).select(F.size("tokens").cast("bigint").alias("t"))
        hist = tokens.groupBy("t").agg(F.count("*").alias("n"))
        row = hist.agg(
            F.lit("bpe").alias("strategy_name"), F.lit(label).alias("variant_label"), F.lit(f"distinct sequences, {len(texts)} by hash").alias("analysis_scope"), F.lit(size).cast("bigint").alias("vocabulary_size"),
            F.percentile("t", F.lit(0.5), F.col("n")).cast("double").alias("median_tokenized_length"), fraction(F.sum(F.when(F.col("t") > most, F.col("n")).otherwise(0)), F.sum("n")).alias("fraction_exceeding_max_length"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def recommend(summaries: list[Counter | dict]) -> dict:
    """The strategy with least windows, then the smaller vocabulary, with the findings it rests on, three at least [REC-01]."""
    ranked = sorted(summaries, key=lambda s: (s["fraction_exceeding_max_length"], s["vocabulary_size"]))
    best = ranked[0]
    findings = {f"{s['strategy_name']}/{s['variant_label']}": [f"vocabulary {s['vocabulary_size']}", f"median length {s['median_tokenized_length'] or 0:g}", f"over the limit {s['fraction_exceeding_max_length']:.4f}"] for s in ranked}
    return {"recommended": f"{best['strategy_name']}/{best['variant_label']}", "findings": findings}
