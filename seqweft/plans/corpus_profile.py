"""The corpus run: FASTA files to a Parquet corpus, its profiles and token summaries, and a manifest. Survey IDs in brackets."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession

from seqweft.operators import dedupe, profile, tokens
from seqweft.plans.run import Manifest, RunConfig, save_artifact
from seqweft.sources.fasta import corpus_to_parquet, read_fasta


def run(spark: SparkSession, config: RunConfig) -> Manifest:
    """The corpus is parsed once and read back for each profile, which prunes to its columns [SNK-17, TOK-07, REC-01].

    Token tables follow both residue policies: the one for residues outside the twenty, and the one for those of them that are rare [RES-06].
    The recommendation rests on all strategies' rows. Byte-pair vocabularies see the residues as they are under replace_with_unk.
    """
    parsed = read_fasta(spark, config.data_root, config.sample)
    corpus = corpus_to_parquet(parsed, f"{config.output_root}/protein_corpus.parquet")
    scope = "all" if config.sample in (None, "all") else f"first {config.sample} files"
    manifest = Manifest(asdict(config))
    manifest.add("protein_corpus", "table", "parquet", f"{config.output_root}/protein_corpus.parquet", scope)
    rare = "".join(sorted(r["residue"] for r in tokens.rare_residues(profile.residue_frequency(corpus)).collect()))
    unknown = rare if config.rare_residue_policy == "replace_with_unk" else ""
    kept = tokens.apply_policy(corpus, config.rare_residue_policy, residues=rare) if rare else corpus
    used = tokens.apply_policy(kept, config.ambiguous_residue_mode)
    summaries = [tokens.strategy_summary(kept, s, config.max_length, scope, policy=config.ambiguous_residue_mode, unknown=unknown) for s in config.strategies if s in tokens.STRATEGIES]
    tables = {
        "parse_issues": (profile.issue_summary(parsed.issues), ["issue_type", "file_path"]),
        "column_profile": (profile.null_profile(corpus), ["column"]),
        "length_histogram": (profile.length_histogram(corpus), ["sequence_length"]),
        "length_cdf": (profile.length_cdf(corpus), ["sequence_length"]),
        "residue_frequency": (profile.residue_frequency(corpus), ["residue"]),
        "ambiguous_summary": (profile.ambiguous_summary(corpus), ["n_ambiguous"]),
        "duplicate_summary": (dedupe.duplicate_summary(corpus), ["duplicate_scope"]),
        "policy_comparison": (tokens.policy_sensitivity(corpus, config.ambiguous_residue_mode), ["policy_name"]),
    }
    if summaries:
        every = summaries[0]
        for s in summaries[1:]:
            every = every.unionByName(s)
        tables["tokenization_summary"] = (every, ["strategy_name"])
    if "bpe" in config.strategies:
        tables["bpe_summary"] = (tokens.bpe_summary(used, config.bpe_sizes, most=config.max_length), ["variant_label"])
    if summaries:
        rows = [r.asDict() for t in ("tokenization_summary", "bpe_summary") if t in tables for r in tables[t][0].collect()]
        best = tokens.recommend(rows)
        found = [(best["recommended"], name, "; ".join(f)) for name, f in best["findings"].items()]
        tables["recommendation"] = (spark.createDataFrame(found, "recommended string, strategy string, findings string"), ["strategy"])
    for name, (df, order) in tables.items():
        save_artifact(df, manifest, config.output_root, name, order, scope)
    save_artifact(dedupe.candidates(corpus), manifest, config.output_root, "protein_corpus", ["assembly_id", "sequence_id"], scope, "deduplicated")
    return manifest
